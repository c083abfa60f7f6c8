"""Row positions, samples and splits over whole tables, and shapes of (key, time) panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxbar.functions import div, safe_corr, series


def global_index(df: DataFrame, order: list[str], name: str = "row_index", parts: int = 512) -> DataFrame:
    """df with the row's position from 0 on in the order of `order`, whose first column is a number, date or time and decides most of it.

    The first column's quantiles cut the rows into ranges; positions within a range
    are counted side by side and shifted by the sizes of the ranges before it. Only
    rows that share one value of the first column must stay together. Missing values
    come first. Rows alike in all of `order` are placed in any order.
    """
    kind = df.schema[order[0]].dataType.typeName()
    first = F.unix_micros(F.col(order[0]).cast("timestamp")).cast("double") if kind in ("timestamp", "timestamp_ntz", "date") else F.col(order[0]).cast("double")
    cuts = df.agg(F.array_distinct(F.percentile_approx(first, F.array(*[F.lit(i / parts) for i in range(1, parts)]), 20 * parts)).alias("cuts")).first()["cuts"] or []
    # The bucket of a row is the number of cuts up to its value; the cuts are literals, so that retried tasks deal rows alike.
    bucket = F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("__first"))), F.lit(-1)) if cuts else F.lit(0)
    keyed = df.withColumn("__first", first).withColumn("__bucket", F.when(F.col("__first").isNull(), -1).otherwise(bucket)).drop("__first")
    sizes = keyed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__size"))
    # parts + 1 rows at most.
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("__bucket").alias("__at"), F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order)) - 1
    placed = keyed.withColumn("__within", within).join(F.broadcast(offsets), F.col("__bucket") == F.col("__at"))
    return placed.withColumn(name, (F.col("__before") + F.col("__within")).cast("long")).drop("__bucket", "__at", "__before", "__within")


def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("__n"))


def linspace_rows(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """At most `most` rows at equal distances in the order, first and last included, with row_index; all rows if there are no more."""
    indexed = global_index(df, order)
    if most < 2:
        return indexed.where(F.col("row_index") < most)
    at = F.bround(F.col("__k") * (F.col("__n") - 1) / F.lit(float(most - 1)), 0).cast("long")
    wanted = _count(df).where(F.col("__n") > most).select("__n", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("__k")).select(at.alias("__want")).distinct()
    few = _count(df).where(F.col("__n") <= most).select(F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("__n") - 1, F.lit(0)))).alias("__want"))
    return indexed.join(F.broadcast(wanted.union(few)), F.col("row_index") == F.col("__want"), "left_semi")


def embargo_split(df: DataFrame, order: list[str], share: float, embargo: int) -> DataFrame:
    """df with part: train up to floor(share n) rows (1 to n - 1), then `embargo` rows marked so, then test."""
    n = _count(df).select(F.least(F.greatest(F.floor(F.col("__n") * share), F.lit(1)), F.col("__n") - 1).alias("__cut"))
    i = F.col("row_index")
    part = F.when(i < F.col("__cut"), "train").when(i < F.col("__cut") + embargo, "embargo").otherwise("test")
    return global_index(df, order).join(F.broadcast(n)).withColumn("part", part).drop("__cut")


def first_active(df: DataFrame, keys: list[str], order: str, active: Column) -> DataFrame:
    """Rows from each series' first active one on; series without any go. The starts are one row a series."""
    starts = df.where(active).groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min(order).alias("__start"))
    cond = F.col(order) >= F.col("__start")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.join(starts, cond, "left_semi")


def cells(panel: DataFrame, on: str, roots: list[str], values: list[str], fill: float | None = 0.0) -> DataFrame:
    """A row for each time of the panel and each of the listed roots; values missing there are `fill`."""
    grid = panel.select(F.col(on).alias("__on")).distinct().withColumn("__root", F.explode(F.array(*[F.lit(r) for r in roots])))
    full = grid.join(panel, (F.col("__on") == F.col(on)) & (F.col("__root") == F.col("root")), "left")
    return full.select(F.col("__on").alias(on), F.col("__root").alias("root"), *[F.coalesce(F.col(v), F.lit(fill)).alias(v) for v in values])


def wide(panel: DataFrame, on: str, roots: list[str], value: str) -> DataFrame:
    """A column for each listed root, a row for each time; missing cells are NULL."""
    return panel.groupBy(on).pivot("root", roots).agg(F.first(value))


def from_first(x: str, w) -> Column:
    """x over the series' first value, less 1."""
    return div(F.col(x), F.nullif(F.first(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))) - 1


def changed(x: str, w) -> Column:
    """Whether x differs from the row before it; false on the first row."""
    return F.coalesce(~F.col(x).eqNullSafe(F.lag(x).over(w)) & (F.row_number().over(w) > 1), F.lit(False))


def time_checks(df: DataFrame, keys: list[str], time: str, arrival: str, gap_seconds: float) -> DataFrame:
    """For each series in order of arrival: rows, times that repeat the one before, that go back, and gaps of more than gap_seconds."""
    step = F.unix_micros(F.col(time).cast("timestamp")) - F.lag(F.unix_micros(F.col(time).cast("timestamp"))).over(series(*keys, order=arrival))
    stepped = df.select(*keys, step.alias("__step"))
    return stepped.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("__step") == 0).alias("repeated"),
        F.count_if(F.col("__step") < 0).alias("backward"), F.count_if(F.col("__step") > gap_seconds * 1e6).alias("gaps"),
    )


def correlations_with(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """(column, corr): each column's correlation with the target, all in one pass; NULL where a side is constant."""
    one = df.agg(*[safe_corr(c, target).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("corr")) for c in columns])
    return one.select(F.inline(pairs))


def describe(df: DataFrame, keys: list[str], x: str, quantiles: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """n, mean, sd, min, max and the quantiles q5, q25, ... (linear between values) of each group, in one pass."""
    q = F.percentile(x, F.array(*[F.lit(p) for p in quantiles]))
    got = df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"), q.alias("__q"))
    return got.select(*keys, "n", "mean", "sd", "min", "max", *[F.element_at("__q", i + 1).alias(f"q{round(p * 100)}") for i, p in enumerate(quantiles)])
