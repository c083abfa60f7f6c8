"""Runs described by a config: bars in, backtest and metrics out as files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxbar import sources
from fluxbar.functions import series
from fluxbar.operators import anomaly, backtest, bars, flow, pairs, studies

#: What a config may hold; every value of strategy and backtest.cost_bps must be given.
SECTIONS = {
    "data": {"path", "kind", "symbol", "renames", "start", "end", "seed"},
    "strategy": {"fast", "slow"},
    "backtest": {"cost_bps", "per_year", "lag", "most", "capital"},
    "outputs": {"folder"},
}


def read_config(path: str) -> dict:
    """A JSON config (YAML too, where a parser is installed), checked."""
    text = Path(path).read_text()
    if path.endswith((".yml", ".yaml")):
        import yaml

        return checked(yaml.safe_load(text))
    return checked(json.loads(text))


def checked(config: dict) -> dict:
    """The config; unknown sections or keys, or a missing strategy, raise ValueError."""
    if unknown := set(config) - set(SECTIONS) - {"experiment_id", "title", "hypothesis"}:
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    for name, known in SECTIONS.items():
        if unknown := set(config.get(name, {})) - known:
            raise ValueError(f"unknown keys in {name}: {sorted(unknown)}")
    if missing := {"fast", "slow"} - set(config.get("strategy", {})):
        raise ValueError(f"strategy lacks {sorted(missing)}")
    if "cost_bps" not in config.get("backtest", {}):
        raise ValueError("backtest lacks cost_bps")
    return config


def load(spark: SparkSession, data: dict) -> DataFrame:
    """Bars from files, or synthetic ones where the kind says so."""
    if data.get("kind") == "synthetic":
        return sources.synthetic_bars(spark, data.get("symbol", "A"), data["start"], data["end"], data.get("seed", 0))
    return sources.read_bars(spark, data["path"], data.get("kind", "parquet"), data.get("renames"), data.get("symbol"))


def evaluate(bars: DataFrame, config: dict) -> tuple[DataFrame, DataFrame]:
    """(backtest rows, metrics of each symbol) of bars with a timestamp column."""
    how, b = checked(config)["strategy"], config["backtest"]
    capital = b.get("capital", 1.0)
    signals = backtest.crossover(bars, how["fast"], how["slow"], order="timestamp")
    ran = backtest.run(signals, b["cost_bps"], b.get("lag", 1), b.get("most", 1.0), capital, order="timestamp")
    return ran, backtest.metrics(ran, b.get("per_year", 252), capital, order="timestamp")


def run_experiment(spark: SparkSession, config: dict) -> DataFrame:
    """Write equity and metrics as Parquet into outputs.folder, which must not hold them yet, and return the metrics as written."""
    folder = checked(config)["outputs"]["folder"].rstrip("/")
    ran, _ = evaluate(load(spark, config["data"]), config)
    ran.write.parquet(f"{folder}/equity")
    b = config["backtest"]
    written = spark.read.schema(ran.schema).parquet(f"{folder}/equity")
    backtest.metrics(written, b.get("per_year", 252), b.get("capital", 1.0), order="timestamp").write.parquet(f"{folder}/metrics")
    return spark.read.parquet(f"{folder}/metrics")


def run_pairs(frames: DataFrame, config: dict, folder: str | None = None) -> dict[str, DataFrame]:
    """selection, metrics and portfolio of a pairs config; with a folder they are written there, as Parquet and the metrics as JSON too.

    config: lookback, methods (name to the fields of pairs.Rules), cost_bps, per_year,
    train_share, least_rows, least_corr and, if not 1e-6, ridge. Unknown keys raise.
    """
    known = {"lookback", "methods", "cost_bps", "per_year", "train_share", "least_rows", "least_corr", "ridge"}
    if unknown := set(config) - known:
        raise ValueError(f"unknown keys: {sorted(unknown)}")
    methods = {name: pairs.Rules(**rules) for name, rules in config["methods"].items()}
    got = pairs.experiment(frames, methods=methods, **{k: v for k, v in config.items() if k != "methods"})
    tables = dict(zip(("selection", "metrics", "portfolio"), got, strict=True))
    return tables if folder is None else written(tables, folder, ("metrics",))


def written(tables: dict[str, DataFrame], folder: str, as_json: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The tables as written to the folder as Parquet; those of as_json are written as JSON and CSV too."""
    out = {}
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
        out[name] = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")
        if name in as_json:
            out[name].write.json(f"{folder}/{name}-json")
            out[name].write.option("header", True).csv(f"{folder}/{name}-csv")
    return out


def run_pairs_config(spark: SparkSession, config: dict) -> DataFrame:
    """run_pairs() over the Parquet frames at data.path into outputs.folder; the metrics as written."""
    rest = {k: v for k, v in config.items() if k not in ("data", "outputs", "experiment_id", "title")}
    return run_pairs(spark.read.parquet(config["data"]["path"]), rest, config["outputs"]["folder"])["metrics"]


def prepare_futures(spark: SparkSession, raw: str, out: str, roots: list[str] | None = None, zone: str = "America/New_York") -> DataFrame:
    """Continuous series of the files <root>.parquet (ts, symbol, close, volume) of a folder, written partitioned by root; returns root, rows, contracts, rolls, start and end.

    Only single contracts count. Sessions are days in the zone; contracts expire in
    the order of their last sessions, ties by symbol. Of bars that repeat a contract
    and time, the one of the largest volume counts, ties the largest close.
    """
    every = sources.load_roots(spark, raw, roots)
    code = F.expr("substring(symbol, length(root) + 1)")
    kept = every.where(F.col("symbol").startswith(F.col("root")) & code.rlike(r"^[FGHJKMNQUVXZ]\d{1,2}$") & (F.col("close") > 0))
    one = kept.groupBy("root", "symbol", "ts").agg(F.max(F.struct("volume", "close")).alias("b")).select("root", "symbol", "ts", "b.*")
    one = one.withColumn("session", F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone)))
    daily = one.groupBy("root", "session", "symbol").agg(F.sum("volume").alias("volume"))
    last = daily.groupBy("root", "symbol").agg(F.max("session").alias("last"))
    ranks = last.select("root", "symbol", F.row_number().over(Window.partitionBy("root").orderBy("last", "symbol")).alias("expiry_rank"))
    schedule = bars.contract_schedule(daily.join(ranks, ["root", "symbol"]))
    bars.continuous(one, schedule).write.partitionBy("root").parquet(out)
    return spark.read.parquet(out).groupBy("root").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("active").alias("contracts"), F.count_if("rolled").alias("rolls"), F.min("ts").alias("start"), F.max("ts").alias("end"),
    )


def universe(closes: DataFrame, shares: DataFrame, top: int) -> DataFrame:
    """(rank, symbol, close, shares, market_cap) of the `top` largest by last close times shares, ties by symbol.

    closes are (symbol, ts, close) and shares (symbol, ts, shares), of each the last
    positive value of a symbol counts; symbols without either go.
    """
    tidy = lambda df, c: df.where(F.col(c) > 0).groupBy(F.upper(F.trim("symbol")).alias("symbol")).agg(F.max(F.struct("ts", c))[c].alias(c))
    both = tidy(closes, "close").join(tidy(shares, "shares"), "symbol").withColumn("market_cap", F.col("close") * F.col("shares"))
    best = both.orderBy(F.desc("market_cap"), "symbol").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("market_cap"), "symbol"))).select("rank", "symbol", "close", "shares", "market_cap")


def research_summary(panel: DataFrame, bar: str, value: str, fits: DataFrame) -> DataFrame:
    """(part, name, value): each root's mean share, the share of bars in which it is the largest (ties: first by name), and how many fits there are of each kind."""
    shares = flow.shares(panel, bar, value).where("share IS NOT NULL")
    mean = shares.groupBy(F.col("root").alias("name")).agg(F.avg("share").alias("value")).withColumn("part", F.lit("mean_share"))
    top = shares.groupBy(bar).agg(F.min_by("root", F.struct(-F.col("share"), "root")).alias("name"))
    often = top.groupBy("name").agg(F.count(F.lit(1)).cast("double").alias("n"))
    often = often.join(F.broadcast(top.agg(F.count(F.lit(1)).alias("all")))).select("name", (F.col("n") / F.col("all")).alias("value"), F.lit("largest").alias("part"))
    kinds = fits.where("kind IS NOT NULL").groupBy(F.col("kind").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("part", F.lit("kind"))
    return mean.unionByName(often).unionByName(kinds).select("part", "name", "value")


def report(spark: SparkSession, folder: str, by: str, n: int = 20) -> str:
    """leaderboard() as a Markdown table."""
    rows = leaderboard(spark, folder, by, n)
    lines = [rows.columns, ["-"] * len(rows.columns), *rows.collect()]
    return "\n".join("|" + "|".join("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in line) + "|" for line in lines)


def leaderboard(spark: SparkSession, folder: str, by: str, n: int = 10) -> DataFrame:
    """The best rows by a column over all metrics that experiments wrote as JSON below the folder, with where they come from."""
    rows = spark.read.json(f"{folder}/*/metrics-json").withColumn("path", F.input_file_name())
    return rows.orderBy(F.desc(by), "path").limit(n)


def flow_research(panel: DataFrame, roots: list[str], bar: str, window: int, least: int, quantile: float, horizon: int) -> dict[str, DataFrame]:
    """features of a panel (root, bar, close, notional, signed), their concentration by bar, entries of extreme flow, and the study of returns after them."""
    w = series("root", order=bar)
    found = flow.features(panel, bar, "notional", "signed", window, least).withColumn("strength", F.abs("flow"))
    marked = anomaly.entry_masks(found, ["root"], "strength", quantile)
    ahead = marked.withColumn("forward", F.lead(F.log("close"), horizon).over(w) - F.log("close"))
    return {"features": found, "concentration": flow.concentration(found, bar, roots), "entries": marked, "study": studies.threshold_study(ahead, ["root"], "entry", "forward")}
