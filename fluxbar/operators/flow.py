"""Shares of activity across roots: concentration, dynamics, and trade-size buckets. Long form: a row for each (bar, root)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxbar.functions import div, series
from fluxbar.operators.windows import rolling_z


def shares(panel: DataFrame, bar: str, value: str) -> DataFrame:
    """panel with share: value over the bar's total, NULL where that is 0."""
    return panel.withColumn("share", div(F.col(value), F.nullif(F.sum(value).over(Window.partitionBy(bar)), F.lit(0.0))))


def concentration(panel: DataFrame, bar: str, roots: list[str]) -> DataFrame:
    """One row for each bar: entropy, its share of the maximum, HHI, effective number, Gini, variance, distance from equal shares, largest share and its root.

    Roots without a row count with share 0; ties of the largest share go to the first in the list.
    """
    k = len(roots)
    place = F.array_position(F.array(*[F.lit(r) for r in roots]), F.col("root"))
    by_share = Window.partitionBy(bar).orderBy("share", "root")
    n = F.count(F.lit(1)).over(Window.partitionBy(bar))
    ranked = panel.withColumn("__i", F.row_number().over(by_share) + k - n).withColumn("__place", place)
    s = F.col("share")
    entropy = -F.sum(F.when(s > 0, s * F.log(s)).otherwise(0.0))
    hhi = F.sum(s * s)
    return ranked.groupBy(bar).agg(
        entropy.alias("entropy"), (entropy / F.log(F.lit(float(k)))).alias("entropy_share"), hhi.alias("hhi"), F.exp(entropy).alias("effective"),
        (div(2 * F.sum(F.col("__i") * s), k * F.sum(s)) - (k + 1) / k).alias("gini"), (hhi / k - F.pow(F.sum(s) / k, F.lit(2))).alias("variance"),
        F.sqrt(hhi - 2 * F.sum(s) / k + 1 / k).alias("from_equal"), F.max("share").alias("max_share"),
        F.max_by("root", F.struct("share", -F.col("__place"))).alias("dominant_root"),
    )


def dynamics(panel: DataFrame, bar: str) -> DataFrame:
    """panel with rank in its bar (largest share first, ties alike), and each root's velocity, acceleration and rank change."""
    w = series("root", order=bar)
    df = panel.withColumn("rank", F.rank().over(Window.partitionBy(bar).orderBy(F.desc("share"))))
    df = df.withColumn("velocity", F.col("share") - F.lag("share").over(w))
    return df.withColumn("acceleration", F.col("velocity") - F.lag("velocity").over(w)).withColumn("rank_change", F.col("rank") - F.lag("rank").over(w))


def size_buckets(trades: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.9, 0.99), names: tuple[str, ...] = ("small", "medium", "large", "very_large"), value: str = "notional") -> DataFrame:
    """trades with bucket: the first whose quantile of the root (linear between values) the value doesn't exceed. The thresholds are one row a root."""
    limits = trades.groupBy(F.col("root").alias("__root")).agg(F.percentile(value, F.array(*[F.lit(q) for q in quantiles])).alias("__q"))
    joined = trades.join(limits, F.col("root") == F.col("__root"))
    bucket = F.lit(names[-1])
    for i in range(len(quantiles) - 1, -1, -1):
        bucket = F.when(F.col(value) <= F.element_at("__q", i + 1), names[i]).otherwise(bucket)
    return joined.withColumn("bucket", bucket).drop("__root", "__q")


def features(panel: DataFrame, bar: str, value: str, signed: str, window: int, least: int) -> DataFrame:
    """Each root's share, its velocity and its signed flow over the bar's total, and the z-score of each against its own last rows, this one included."""
    w = series("root", order=bar)
    df = shares(panel, bar, value).withColumn("flow", div(F.col(signed), F.nullif(F.sum(value).over(Window.partitionBy(bar)), F.lit(0.0))))
    df = df.withColumn("velocity", F.col("share") - F.lag("share").over(w))
    return df.withColumns({f"{c}_z": rolling_z(c, w, window, least) for c in ("share", "velocity", "flow")})
