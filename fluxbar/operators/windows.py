"""Returns, rolling statistics, forward sums, ranks and runs over ordered series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fluxbar.functions import div, guarded, ln, trailing


def simple_return(x: str, w: WindowSpec) -> Column:
    return F.coalesce(div(F.col(x), F.lag(x).over(w)) - 1, F.lit(0.0))


def log_return(x: str, w: WindowSpec) -> Column:
    return F.coalesce(ln(x) - F.lag(ln(x)).over(w), F.lit(0.0))


def rolling_mean(x: str, w: WindowSpec, n: int) -> Column:
    t = trailing(w, n)
    return guarded(F.avg(x).over(t), x, t, n)


def rolling_z(x: str, w: WindowSpec, n: int, least: int | None = None) -> Column:
    """(x - mean) / sample deviation of the last n rows; NULL under `least` (n) values or without spread."""
    t = trailing(w, n)
    return guarded(div(F.col(x) - F.avg(x).over(t), F.nullif(F.stddev_samp(x).over(t), F.lit(0.0))), x, t, least or n)


def rolling_sum(x: str, w: WindowSpec, n: int) -> Column:
    t = trailing(w, n)
    return guarded(F.sum(x).over(t), x, t, n)


def forward_sum(x: str, w: WindowSpec, h: int) -> Column:
    """Sum of the next h rows; NULL where fewer follow."""
    ahead = w.rowsBetween(1, h)
    return guarded(F.sum(x).over(ahead), x, ahead, h)


def rolling_beta(df: DataFrame, y: str, x: str, w: WindowSpec, n: int) -> DataFrame:
    """df with beta (covariance over variance of the last n rows), spread y - beta x, and the spread's z over n spreads."""
    t = trailing(w, n)
    both = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.col(x))
    df = df.withColumn("beta", guarded(div(F.covar_samp(y, x).over(t), F.nullif(F.var_samp(x).over(t), F.lit(0.0))), both, t, n))
    df = df.withColumn("spread", F.col(y) - F.col("beta") * F.col(x))
    return df.withColumn("z", rolling_z("spread", w, n))


def signal_position(signal: str, w: WindowSpec, lag: int = 1, most: float = 1.0) -> Column:
    return F.least(F.greatest(F.coalesce(F.lag(signal, lag).over(w), F.lit(0.0)), F.lit(0.0)), F.lit(most))


def turnover(position: str, w: WindowSpec) -> Column:
    """Absolute change; the first row's is its position."""
    return F.abs(F.col(position) - F.coalesce(F.lag(position).over(w), F.lit(0.0)))


def deciles(x: str, w: WindowSpec, whole: WindowSpec, buckets: int = 10) -> Column:
    """Bucket from 1 on by position r of n: the smallest b with (r-1)/(n-1) <= b/buckets."""
    r, n = F.row_number().over(w), F.count(x).over(whole)
    return F.greatest(F.ceil(div((r - 1) * F.lit(float(buckets)), n - 1)), F.lit(1)).cast("int")


def average_rank(x: str, keys: list[str]) -> Column:
    """Rank with ties at their mean."""
    w = Window.partitionBy(*keys).orderBy(x)
    return F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, x)) - 1) / 2.0


def episodes(df: DataFrame, flag: str, keys: list[str], order: str) -> DataFrame:
    """Runs of true flags: keys, start, end, n."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = (F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False))).cast("int")
    marked = df.withColumn("__run", F.sum(changed).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(flag)
    return marked.groupBy(*keys, F.col("__run").alias("run")).agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count(F.lit(1)).alias("n"))


def hold_mask(flag: str, w: WindowSpec, k: int) -> Column:
    """True on a flagged row and the k rows after it."""
    return F.max(F.col(flag).cast("int")).over(w.rowsBetween(-k, 0)) == 1


def chronological_split(df: DataFrame, key: str, share: float) -> DataFrame:
    """df with train: whether the row's key is among the first floor(share n) of the n distinct keys, 1 to n - 1 of them.

    The keys are numbered by themselves, not the rows, range by range; the last one of the training part is one row.
    """
    from fluxbar.operators.panels import global_index

    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    n = keys.agg(F.count(F.lit(1)).alias("__n"))
    cut = F.least(F.greatest(F.floor(F.col("__n") * share), F.lit(1)), F.col("__n") - 1)
    last = global_index(keys, [key], "__r").join(F.broadcast(n)).where(F.col("__r") == cut - 1).select(F.col(key).alias("__last"))
    return df.join(F.broadcast(last), how="left").withColumn("train", F.coalesce(F.col(key) <= F.col("__last"), F.lit(False))).drop("__last")
