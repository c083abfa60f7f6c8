"""Studies on thresholds and events, selection by rules, sweeps, and principal axes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxbar.operators.stats import return_stats


def threshold_study(df: DataFrame, keys: list[str], flag: str, forward: str) -> DataFrame:
    """return_stats of the forward return where the flag holds, with the others' mean as base_bps and the excess over it.

    A missing flag counts as false. Groups without a flagged row have none in the result.
    """
    known = df.withColumn("__flag", F.coalesce(F.col(flag), F.lit(False)))
    both = return_stats(known, [*keys, "__flag"], forward)
    hit = both.where("__flag").drop("__flag")
    base = both.where("not __flag").select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("mean_bps").alias("base_bps"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return hit.join(base, cond, "left").drop(*[f"__{k}" for k in keys]).withColumn("excess_bps", F.col("mean_bps") - F.col("base_bps"))


def train_thresholds(df: DataFrame, train: str, columns: dict[str, float], keys: list[str]) -> DataFrame:
    """df with x_over for each column x: whether it reaches the quantile that the training rows of its series give. One row of thresholds a series."""
    limits = df.where(F.col(train)).groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(*[F.percentile(c, F.lit(q)).alias(f"__at_{c}") for c, q in columns.items()])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
    joined = df.join(limits, cond, "left")
    over = [F.coalesce(F.col(c) >= F.col(f"__at_{c}"), F.lit(False)).alias(f"{c}_over") for c in columns]
    return joined.select(*df.columns, *over)


def first_reason(checks: list[tuple[str, Column]], otherwise: str = "selected") -> Column:
    """The name of the first check that fails, in the given order. A check whose value is missing fails."""
    out = None
    for name, ok in checks:
        failed = ~F.coalesce(ok, F.lit(False))
        out = F.when(failed, name) if out is None else out.when(failed, name)
    return F.lit(otherwise) if out is None else out.otherwise(F.lit(otherwise))


def cost_sweep(ran: DataFrame, keys: list[str], costs_bps: list[float]) -> DataFrame:
    """Total and mean return for each cost of a run with position, ret and turnover; all costs in the one pass that reads it."""
    each = ran.select(*keys, "position", "ret", "turnover", F.explode(F.array(*[F.lit(float(c)) for c in costs_bps])).alias("cost_bps"))
    net = F.col("position") * F.col("ret") - F.col("turnover") * F.col("cost_bps") / 1e4
    return each.groupBy(*keys, "cost_bps").agg((F.product(1 + net) - 1).alias("total_return"), F.avg(net).alias("mean_net"))


def decide(results: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """results with a column for each rule (missing values fail) and passed: whether all hold."""
    out, passed = results, F.lit(True)
    for name, rule in rules:
        out = out.withColumn(name, F.coalesce(rule, F.lit(False)))
        passed = passed & F.col(name)
    return out.withColumn("passed", passed)


def principal_axes(df: DataFrame, columns: list[str], k: int = 3) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """df with pc1 ... pck, the loadings (a row each axis) and the axes' shares of variance, of the standardised columns.

    Moments come from one pass; the matrix on the driver has a row a column. Rows with
    a missing value have no coordinates and take no part. Constant columns weigh 0.
    An axis points to where its largest loading is positive.
    """
    names, n = columns, len(columns)
    whole = F.lit(True)
    for c in names:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    rows = df.where(whole)
    upper = [(i, j) for i in range(n) for j in range(i, n)]
    got = rows.agg(*[F.avg(c) for c in names], *[F.covar_pop(names[i], names[j]) for i, j in upper]).first()
    if got[0] is None:
        raise ValueError("no whole rows")
    cov = np.zeros((n, n))
    for at, (i, j) in enumerate(upper):
        cov[i, j] = cov[j, i] = got[n + at]
    sd = np.sqrt(np.diag(cov))
    scale = np.where(sd > 0, 1 / np.where(sd > 0, sd, 1), 0)
    values, vectors = np.linalg.eigh(cov * np.outer(scale, scale))
    order = np.argsort(-values, kind="stable")[: min(k, n)]
    axes = vectors[:, order].T
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    share = values[order] / values.sum() if values.sum() > 0 else np.zeros(len(order))
    weight = axes * scale
    out = df
    for a, w in enumerate(weight):
        at = F.lit(0.0)
        for c, x, m in zip(names, w, got[:n], strict=True):
            at = at + (F.col(c) - F.lit(float(m))) * F.lit(float(x))
        out = out.withColumn(f"pc{a + 1}", F.when(whole, at))
    return out, axes, share


def clusters(df: DataFrame, columns: list[str], k: int = 3, seed: int = 0) -> DataFrame:
    """Rows without missing values, with the cluster of k-means on the standardised columns."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    whole = df.dropna(subset=columns)
    vectors = VectorAssembler(inputCols=columns, outputCol="__raw").transform(whole)
    scaled = StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=True).fit(vectors).transform(vectors)
    model = KMeans(k=k, seed=seed, featuresCol="__scaled", predictionCol="cluster").fit(scaled)
    return model.transform(scaled).drop("__raw", "__scaled")


def leaderboard(results: DataFrame, by: str, keys: list[str], most: int) -> DataFrame:
    """The `most` rows with the largest absolute `by`, largest first, ties by keys; missing values go."""
    return results.where(F.col(by).isNotNull()).orderBy(F.desc(F.abs(by)), *keys).limit(most)


