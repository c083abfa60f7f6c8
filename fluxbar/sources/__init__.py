"""Readers, sinks, checks, and the market tables that the benchmark's tables stand in for."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxbar.functions import series

BAR_COLUMNS = ("timestamp", "symbol", "open", "high", "low", "close", "volume")


def read_bars(spark: SparkSession, path: str, kind: str = "parquet", renames: dict[str, str] | None = None, symbol: str | None = None) -> DataFrame:
    """Bars from Parquet, ORC, JSON or CSV files (a glob or a folder), normalised and checked."""
    if kind == "csv":
        raw = spark.read.csv(path, header=True, inferSchema=True)
    elif kind in ("parquet", "orc", "json"):
        raw = spark.read.format(kind).load(path)
    else:
        raise ValueError(f"unknown kind of source: {kind}")
    bars = normalise_bars(raw, renames, symbol)
    validate_bars(bars)
    return bars


def normalise_bars(raw: DataFrame, renames: dict[str, str] | None = None, symbol: str | None = None) -> DataFrame:
    """The bar columns with their types: missing open, high and low are the close, a missing volume is 0. Not sorted."""
    df = raw.withColumnsRenamed(renames or {})
    absent = dict.fromkeys(("open", "high", "low"), F.col("close")) | {"volume": F.lit(0.0)} | ({} if symbol is None else {"symbol": F.lit(symbol)})
    kinds = {"timestamp": "timestamp", "symbol": "string"}
    return df.select(*[(F.col(c) if c in df.columns else absent.get(c, F.col(c))).try_cast(kinds.get(c, "double")).alias(c) for c in BAR_COLUMNS])


def bar_checks(bars: DataFrame) -> DataFrame:
    """One row: how many bars there are, have a price that is not over 0, a high under their low, and repeat a (symbol, timestamp)."""
    prices = F.least("open", "high", "low", "close")
    alone = bars.groupBy("symbol", "timestamp").agg(F.count(F.lit(1)).alias("n"), F.count_if(prices <= 0).alias("low"), F.count_if(F.col("high") < F.col("low")).alias("crossed"))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return alone.agg(total("n").alias("bars"), total("low").alias("not_positive"), total("crossed").alias("crossed"), total(F.col("n") - 1).alias("repeated"))


def validate_bars(bars: DataFrame) -> None:
    """Raise on missing columns, no rows, or what bar_checks counts."""
    if missing := set(BAR_COLUMNS) - set(bars.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    found = bar_checks(bars).first().asDict()
    if not found.pop("bars"):
        raise ValueError("no bars")
    if wrong := {k: n for k, n in found.items() if n}:
        raise ValueError(f"bars that are wrong: {wrong}")


def noise(seed: int, part: str, day: Column) -> Column:
    """A standard normal number for each day, the same wherever it is worked out: Box and Muller's transform of two hashes."""
    unit = lambda k: (F.pmod(F.xxhash64(F.lit(f"{seed}:{part}:{k}"), day), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)
    return F.sqrt(-2 * F.log(unit(0))) * F.cos(2 * math.pi * unit(1))


def synthetic_bars(spark: SparkSession, symbol: str, start: str, end: str, seed: int = 0, memory: int = 30) -> DataFrame:
    """Business-day bars whose log price strays from that of 50 and comes back: a decaying sum of the last shocks.

    Days open where the one before closed but for a gap, the range widens with a
    day's own shocks, and volume follows the range. The same for the same seed.
    """
    days = spark.sql(f"SELECT explode(sequence(DATE'{start}', DATE'{end}')) AS day").where(F.dayofweek("day").between(2, 6))
    n, own = F.datediff("day", F.lit("1970-01-01").cast("date")), series(order="day")
    shocks = F.collect_list(noise(seed, "shock", n)).over(own.rowsBetween(-memory, 0))
    stray = F.aggregate(shocks, F.lit(0.0), lambda s, x: 0.9 * s + 0.012 * x)
    df = days.select("day", n.alias("n"), F.exp(math.log(50.0) + stray).alias("close"))
    df = df.withColumn("open", F.coalesce(F.lag("close").over(own), F.col("close")) * F.exp(0.002 * noise(seed, "gap", F.col("n"))))
    up, down = (F.abs(noise(seed, side, F.col("n"))) * 0.004 for side in ("up", "down"))
    df = df.withColumns({"high": F.greatest("open", "close") * F.exp(up), "low": F.least("open", "close") * F.exp(-down)})
    volume = F.round(2000 * (1 + 40 * F.log(F.col("high") / F.col("low"))) * F.exp(0.2 * noise(seed, "volume", F.col("n"))))
    return df.select(F.col("day").cast("timestamp").alias("timestamp"), F.lit(symbol).alias("symbol"), "open", "high", "low", "close", volume.alias("volume"))


def load_roots(spark: SparkSession, folder: str, roots: list[str] | None = None) -> DataFrame:
    """The Parquet files <root>.parquet of a folder as one table with their root; those asked for that are missing or empty add nothing.

    Without a list all files of the folder are read. Columns that a file lacks are null.
    """
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(files)
    names = sorted(f.getPath().getName().removesuffix(".parquet") for f in found if f.getPath().getName().endswith(".parquet"))
    out = None
    for root in names if roots is None else [r for r in roots if r in names]:
        own = spark.read.parquet(f"{folder}/{root}.parquet").withColumn("root", F.lit(root))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"no table of {roots} in {folder}")
    return out


def read_through(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at the path, built and written there first if it isn't yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_sorted(df: DataFrame, path: str, keys: list[str], partitions: int | None = None) -> None:
    """Parquet in the order of keys: range partitions, each sorted by itself, so no task holds all rows."""
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.option("compression", "zstd").parquet(path)


def between(df: DataFrame, column: str, start, end, closed: bool = True) -> DataFrame:
    """start <= column <= end, or < end if not closed; reaches the scan."""
    c = F.col(column)
    return df.where((c >= F.lit(start)) & ((c <= F.lit(end)) if closed else (c < F.lit(end))))


def matching(df: DataFrame, wanted: dict) -> DataFrame:
    """Rows with the wanted values; columns that df lacks are passed over."""
    for column, value in wanted.items():
        if column in df.columns:
            df = df.where(F.col(column) == F.lit(value))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars out of orders: a symbol for each priority, prices at a level where returns stay small."""
    price = F.lit(100.0) + F.col("o_totalprice") / 50000.0
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts")).agg(
        F.min_by(price, "o_orderkey").alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, "o_orderkey").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades out of events: a root for each type, size and side from the number in props."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("long")
    t = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("root"), "ts", F.col("event_id").alias("seq"), (F.lit(100.0) + F.col("value") / 10).alias("price"),
        (1 + k % 5).cast("double").alias("size"), F.when(k % 3 == 0, "B").when(k % 3 == 1, "A").otherwise("N").alias("side"), k.alias("k"), F.col("user_id"),
    )
    sign = F.when(F.col("side") == "B", 1.0).when(F.col("side") == "A", -1.0).otherwise(0.0)
    return t.withColumn("notional", F.col("price") * F.col("size")).withColumn("signed", sign * F.col("notional"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hour bars of each root: last price, volume, notional, signed notional and count."""
    return trades(spark, sf_dir).groupBy("root", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(
        F.max_by("price", F.struct("ts", "seq")).alias("close"), F.sum("size").alias("volume"), F.sum("notional").alias("notional"),
        F.sum("signed").alias("signed"), F.count(F.lit(1)).alias("n"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-of-book quotes around the trades' prices."""
    t = trades(spark, sf_dir)
    return t.select("root", "ts", "seq", (F.col("price") - 0.01 * (1 + F.col("k") % 4)).alias("bid"), (F.col("price") + 0.01 * (1 + F.col("k") % 3)).alias("ask"), (1 + F.col("k") % 7).cast("double").alias("bid_size"), (1 + F.col("k") % 6).cast("double").alias("ask_size"))


#: The same tables in SQL.
DAILY_SQL = """daily AS (
  SELECT o_orderpriority AS symbol, o_orderdate AS ts, arg_min(100.0::DOUBLE + o_totalprice / 50000.0::DOUBLE, o_orderkey) AS open, max(100.0::DOUBLE + o_totalprice / 50000.0::DOUBLE) AS high,
         min(100.0::DOUBLE + o_totalprice / 50000.0::DOUBLE) AS low, arg_max(100.0::DOUBLE + o_totalprice / 50000.0::DOUBLE, o_orderkey) AS close, count(*)::DOUBLE AS volume
  FROM orders GROUP BY 1, 2)"""
TRADES_SQL = """raw AS (SELECT *, regexp_extract(props, '(\\d+)', 1)::BIGINT AS k FROM events),
trades AS (
  SELECT event_type AS root, ts, event_id AS seq, 100.0::DOUBLE + value / 10 AS price, (1 + k % 5)::DOUBLE AS size,
         CASE k % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'A' ELSE 'N' END AS side, k, user_id,
         (100.0::DOUBLE + value / 10) * (1 + k % 5) AS notional,
         CASE k % 3 WHEN 0 THEN 1.0 WHEN 1 THEN -1.0 ELSE 0.0 END::DOUBLE * ((100.0::DOUBLE + value / 10) * (1 + k % 5)) AS signed FROM raw)"""
HOURLY_SQL = TRADES_SQL + """,
hourly AS (
  SELECT root, date_trunc('hour', ts) AS hour, arg_max(price, (ts, seq)) AS close, sum(size) AS volume, sum(notional) AS notional, sum(signed) AS signed, count(*) AS n
  FROM trades GROUP BY 1, 2)"""
QUOTES_SQL = TRADES_SQL + """,
quotes AS (
  SELECT root, ts, seq, price - 0.01::DOUBLE * (1 + k % 4) AS bid, price + 0.01::DOUBLE * (1 + k % 3) AS ask, (1 + k % 7)::DOUBLE AS bid_size, (1 + k % 6)::DOUBLE AS ask_size FROM trades)"""
