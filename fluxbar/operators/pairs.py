"""Pair trading: a state machine over z-scores, targets, and the returns of positions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxbar.functions import div, guarded, safe_corr, series, trailing
from fluxbar.operators.windows import rolling_beta


@dataclass(frozen=True)
class Rules:
    """entry and exit are bounds of |z|; the next three count rows. confirm: a distance that entries must exceed too; min_change: of both legs' targets, smaller ones are not followed."""

    entry: float = 2.0
    exit: float = 0.5
    rebalance: int = 1
    min_hold: int = 0
    cooldown: int = 0
    confirm: float | None = None
    min_change: float = 0.0

    def __post_init__(self):
        if not self.exit < self.entry:
            raise ValueError("exit must be under entry")


def step(state: int, z: float, usable: bool, confirmed: bool, may_enter: bool, may_exit: bool, r: Rules) -> int:
    """The next state: -1 short the spread, 1 long, 0 flat."""
    if not usable:
        return 0 if may_exit else state
    side = -1 if z > r.entry else 1 if z < -r.entry else 0
    if state == 0:
        return side if may_enter and confirmed else 0
    if may_exit and abs(z) < r.exit:
        return 0
    if may_exit and side == -state:
        return side if r.confirm is None or (may_enter and confirmed) else 0
    return state


def fold(z, beta, r: Rules, distance=None) -> tuple[list[int], list[float], list[float]]:
    """States and both legs' targets along a series; decisions fall on the rebalance rows only, counted from the series' start."""
    state, held, wait, legs = 0, 0, 0, (0.0, 0.0)
    states, one, two = [], [], []
    for i in range(len(z)):
        before, due = state, i % r.rebalance == 0
        usable = math.isfinite(z[i]) and math.isfinite(beta[i])
        if due:
            confirmed = r.confirm is None or (math.isfinite(distance[i]) and distance[i] > r.confirm)
            state = step(state, z[i], usable, confirmed, wait == 0, held >= r.min_hold, r)
        if state:
            held, wait = (held + 1 if state == before else 1), 0
        elif before:
            held, wait = 0, r.cooldown
        else:
            held, wait = 0, max(wait - 1, 0)
        if not state:
            legs = (0.0, 0.0)
        elif due and usable:
            legs = (-state * beta[i] / (abs(beta[i]) + 1), state / (abs(beta[i]) + 1))
        states.append(state)
        one.append(legs[0])
        two.append(legs[1])
    return states, one, two


def followed(one: list[float], two: list[float], least: float) -> tuple[list[float], list[float]]:
    """Both legs' targets where they are `least` or more away, together, from those last followed; these elsewhere."""
    at, out = (0.0, 0.0), []
    for legs in zip(one, two, strict=True):
        if abs(legs[0] - at[0]) + abs(legs[1] - at[1]) >= least:
            at = legs
        out.append(at)
    return [a for a, _ in out], [b for _, b in out]


def run(frames: DataFrame, lookback: int, rules: Rules, cost_bps: float, lag: int = 1, pair: str = "pair", order: str = "ts") -> DataFrame:
    """frames (pair, ts, log_price_a/b, log_return_a/b, optionally distance) with z, state, targets, positions, turnover and net return.

    The rolling moments are window functions, the fold runs once for each pair over
    its whole series, and what follows from the targets is window functions again.
    """
    w = series(pair, order=order)
    df = rolling_beta(frames, "log_price_b", "log_price_a", w, lookback)
    kind = {f.name: f.dataType.simpleString() for f in frames.schema}
    if "distance" not in frames.columns:
        df = df.withColumn("distance", F.lit(None).cast("double"))
    columns = ["log_return_a", "log_return_b", "z", "beta", "distance"]

    def each(pdf):
        import numpy as np

        pdf = pdf.sort_values(order)
        states, one, two = fold(pdf["z"].to_numpy(float), pdf["beta"].to_numpy(float), rules, pdf["distance"].astype(float).to_numpy() if rules.confirm is not None else np.full(len(pdf), math.nan))
        one, two = followed(one, two, rules.min_change)
        return pdf.assign(state=states, target_a=one, target_b=two)

    schema = f"{pair} {kind[pair]}, {order} {kind[order]}, " + ", ".join(f"{c} double" for c in columns) + ", state int, target_a double, target_b double"
    done = df.select(pair, order, *columns).groupBy(pair).applyInPandas(each, schema)
    return returns(done, cost_bps, lag, pair, order)


def pair_distance(frames: DataFrame, lookback: int, ridge: float = 1e-6, pair: str = "pair", order: str = "ts") -> DataFrame:
    """frames with distance, pull_a and pull_b: both log prices against their moments over the last `lookback` rows, this one included.

    distance is the Mahalanobis distance and (pull_a, pull_b) the inverse covariance
    times the deviation, each in closed form over window functions. All are NULL
    until the window is full, where it misses a price, and where the covariance with
    `ridge` on its diagonal is singular.
    """
    t = trailing(series(pair, order=order), lookback)
    a, b = F.col("log_price_a"), F.col("log_price_b")
    both = F.when(a.isNotNull() & b.isNotNull(), a)
    va, vb, ab = F.var_samp(a).over(t) + ridge, F.var_samp(b).over(t) + ridge, F.covar_samp(a, b).over(t)
    moments = F.struct((a - F.avg(a).over(t)).alias("a"), (b - F.avg(b).over(t)).alias("b"), va.alias("va"), vb.alias("vb"), ab.alias("ab"))
    df = frames.withColumn("__m", guarded(moments, both, t, lookback))
    m = {k: F.col(f"__m.{k}") for k in ("a", "b", "va", "vb", "ab")}
    det = m["va"] * m["vb"] - m["ab"] * m["ab"]
    df = df.withColumn("pull_a", div(m["vb"] * m["a"] - m["ab"] * m["b"], det)).withColumn("pull_b", div(m["va"] * m["b"] - m["ab"] * m["a"], det))
    square = m["a"] * F.col("pull_a") + m["b"] * F.col("pull_b")
    return df.withColumn("distance", F.when(square >= 0, F.sqrt(square))).drop("__m")


def distance_fold(distance, pull_a, pull_b, r: Rules) -> tuple[list[int], list[float], list[float]]:
    """States (1 in a position) and both legs' targets. Legs lie against the pull, of gross 1, and are set anew on the rebalance rows.

    A row without a distance has no targets; it ends a position that may end and
    leaves holding and waiting times as they are.
    """
    state, held, wait, legs = 0, 0, 0, (0.0, 0.0)
    states, one, two = [], [], []
    for i, d in enumerate(distance):
        if not math.isfinite(d):
            if held >= r.min_hold:
                state = 0
            states.append(state)
            one.append(0.0)
            two.append(0.0)
            continue
        before, due = state, i % r.rebalance == 0
        if due and state and held >= r.min_hold and d < r.exit:
            state = 0
        elif due and not state and not wait and d > r.entry:
            state = 1
        if not state:
            legs, held, wait = (0.0, 0.0), 0, r.cooldown if before else max(wait - 1, 0)
        else:
            held, wait = held + 1 if before else 1, 0
            gross = abs(pull_a[i]) + abs(pull_b[i])
            if due and 0 < gross < math.inf:
                legs = (-pull_a[i] / gross, -pull_b[i] / gross)
        states.append(state)
        one.append(legs[0])
        two.append(legs[1])
    return states, one, two


def run_distance(frames: DataFrame, lookback: int, rules: Rules, cost_bps: float, ridge: float = 1e-6, lag: int = 1, pair: str = "pair", order: str = "ts") -> DataFrame:
    """As run(), with positions entered and left by the Mahalanobis distance; entry and exit are its bounds."""
    kind = {f.name: f.dataType.simpleString() for f in frames.schema}
    columns = ["log_return_a", "log_return_b", "distance", "pull_a", "pull_b"]

    def each(pdf):
        pdf = pdf.sort_values(order)
        states, one, two = distance_fold(*[pdf[c].to_numpy(float) for c in columns[2:]], rules)
        one, two = followed(one, two, rules.min_change)
        return pdf.assign(state=states, target_a=one, target_b=two)

    schema = f"{pair} {kind[pair]}, {order} {kind[order]}, " + ", ".join(f"{c} double" for c in columns) + ", state int, target_a double, target_b double"
    done = pair_distance(frames, lookback, ridge, pair, order).select(pair, order, *columns).groupBy(pair).applyInPandas(each, schema)
    return returns(done, cost_bps, lag, pair, order)


def returns(done: DataFrame, cost_bps: float, lag: int = 1, pair: str = "pair", order: str = "ts") -> DataFrame:
    w = series(pair, order=order)
    for s in ("a", "b"):
        done = done.withColumn(f"position_{s}", F.coalesce(F.lag(f"target_{s}", lag).over(w), F.lit(0.0)))
    change = [F.abs(F.col(f"position_{s}") - F.coalesce(F.lag(f"position_{s}").over(w), F.lit(0.0))) for s in ("a", "b")]
    done = done.withColumn("turnover", change[0] + change[1])
    gross = F.expm1(F.col("position_a") * F.col("log_return_a") + F.col("position_b") * F.col("log_return_b"))
    return done.withColumn("net", gross - F.col("turnover") * (cost_bps / 1e4)).withColumn("active", F.abs("position_a") + F.abs("position_b") > 0)


def portfolio(done: DataFrame, order: str = "ts") -> DataFrame:
    """Equal weight over the pairs of each time."""
    return done.groupBy(order).agg(F.avg("net").alias("net"), F.sum(F.col("active").cast("int")).alias("active"), F.countDistinct("pair").alias("pairs"), F.avg("turnover").alias("turnover"))


def additive_metrics(df: DataFrame, keys: list[str], order: str, x: str, per_year: float) -> DataFrame:
    """n, total, annualised volatility and Sharpe ratio, t and additive drawdown of returns that add up."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__sum", F.sum(x).over(w)).withColumn("__top", F.max("__sum").over(w))
    ratio = F.try_divide(F.avg(x), F.nullif(F.stddev_samp(x), F.lit(0.0)))
    return df.groupBy(*keys).agg(
        F.count(x).alias("n"), F.sum(x).alias("total"), (F.stddev_samp(x) * per_year**0.5).alias("volatility"), (ratio * per_year**0.5).alias("sharpe"),
        (ratio * F.sqrt(F.count(x).cast("double"))).alias("t"), F.min(F.col("__sum") - F.col("__top")).alias("drawdown"),
    )


def compound_metrics(df: DataFrame, keys: list[str], order: str, x: str, active: str, turnover: str, per_year: float) -> DataFrame:
    """n, compounded and annualised return, volatility, Sharpe ratio, drawdown, share of active rows, turnover and rows that trade; missing returns count as 0."""
    past = series(*keys, order=order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__x", F.coalesce(x, F.lit(0.0))).withColumn("__e", F.product(1 + F.col("__x")).over(past)).withColumn("__top", F.max("__e").over(past))
    sd = F.coalesce(F.stddev_samp("__x"), F.lit(0.0))
    ratio = F.coalesce(div(F.avg("__x"), F.nullif(sd, F.lit(0.0))), F.lit(0.0))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (F.max_by("__e", order) - 1).alias("total_return"), (F.pow(1 + F.avg("__x"), F.lit(per_year)) - 1).alias("annual_return"),
        (sd * per_year**0.5).alias("volatility"), (ratio * per_year**0.5).alias("sharpe"), F.min(F.col("__e") / F.col("__top") - 1).alias("max_drawdown"),
        F.avg(F.coalesce(F.col(active).cast("double"), F.lit(0.0))).alias("active_share"), F.sum(F.coalesce(turnover, F.lit(0.0))).alias("turnover"), F.count_if(F.col(turnover) > 0).alias("trades"),
    )


def experiment(frames: DataFrame, lookback: int, methods: dict[str, Rules], cost_bps: float, per_year: float, train_share: float, least_rows: int, least_corr: float, ridge: float = 1e-6) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(selection, metrics, portfolio) of pair methods, each run over whole series and measured on the rows after the training share.

    methods names Rules for zscore, zscore_mahalanobis (its Rules.confirm is the
    distance) and mahalanobis. A pair is selected if it has least_rows rows and a
    correlation of log prices of least_corr or more, by size, over its training rows.
    """
    w, whole = series("pair", order="ts"), Window.partitionBy("pair")
    placed = frames.withColumn("__i", F.row_number().over(w)).withColumn("__n", F.count(F.lit(1)).over(whole))
    train = F.col("__i") <= F.floor(F.col("__n") * train_share)
    placed = placed.withColumns({f"__train_{k}": F.when(train, F.col(f"log_price_{k}")) for k in ("a", "b")})
    selection = placed.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), safe_corr("__train_a", "__train_b").alias("corr"))
    selection = selection.withColumn("selected", F.coalesce((F.col("n") >= least_rows) & (F.abs("corr") >= least_corr), F.lit(False)))
    kept = frames.join(selection.where("selected").select("pair"), "pair", "left_semi")
    ran = None
    for name, rules in methods.items():
        if name == "mahalanobis":
            own = run_distance(kept, lookback, rules, cost_bps, ridge)
        else:
            own = run(pair_distance(kept, lookback, ridge) if name == "zscore_mahalanobis" else kept, lookback, rules, cost_bps)
        own = own.select(F.lit(name).alias("method"), "pair", "ts", "net", "active", "turnover")
        ran = own if ran is None else ran.unionByName(own)
    placed = ran.withColumn("__i", F.row_number().over(series("method", "pair", order="ts"))).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("method", "pair")))
    tested = placed.where(F.col("__i") > F.floor(F.col("__n") * train_share)).drop("__i", "__n")
    metrics = compound_metrics(tested, ["method", "pair"], "ts", "net", "active", "turnover", per_year)
    together = tested.groupBy("method", "ts").agg(F.avg("net").alias("net"), F.sum(F.col("active").cast("int")).alias("active_pairs"), F.countDistinct("pair").alias("pairs"), F.avg("turnover").alias("turnover"))
    return selection, metrics, together
