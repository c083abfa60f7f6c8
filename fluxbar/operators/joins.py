"""As-of, band and pair joins as equi-joins, unions and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxbar.operators.bars import ranges


def asof(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str], tie: str | None = None, forward: bool = False, parts: int | None = None) -> DataFrame:
    """left with the values of the last right row at or before it (forward: the first at or after it) in its group.

    A union in one order and a running last value: rows are shuffled once by `by`,
    and no pair of rows is formed. tie orders right rows of one time. Rows without a
    time or a key find nothing and are not found. A task holds a group's rows; with
    parts, for large groups, those of one of so many ranges of times.
    """
    keys = [c for c in left.columns]
    l = left.select(*keys, *[F.lit(None).cast(right.schema[v].dataType).alias(f"__{v}") for v in values], F.lit(None).cast(right.schema[tie].dataType if tie else "long").alias("__tie"), F.lit(True).alias("__left"))
    others = [F.col(c) if c in by or c == on else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in keys]
    for c in (on, *by):
        right = right.where(F.col(c).isNotNull())
    r = right.select(*others, *[F.col(v).alias(f"__{v}") for v in values], (F.col(tie) if tie else F.lit(0).cast("long")).alias("__tie"), F.lit(False).alias("__left"))
    both, order, within = l.unionByName(r), [], list(by)
    if parts:
        place = ranges(both, on, parts)
        both, within, order = both.withColumns({"__range": place(F.col(on)), "__handed": F.lit(False)}), [*by, "__range"], [F.desc("__handed")]
        both = both.unionByName(_handed_on(r.withColumn("__range", place(F.col(on))), on, by, [f"__{v}" for v in values], forward, parts), allowMissingColumns=True)
    # Forward goes back from the end: Spark works a frame that reaches to the end out anew for each row. At one time right rows come first.
    way = F.desc if forward else F.asc
    w = Window.partitionBy(*within).orderBy(*order, way(on), F.col("__left"), way("__tie"))
    row = F.when(~F.col("__left"), F.struct(*[F.col(f"__{v}").alias(v) for v in values]))
    filled = both.withColumn("__row", F.last(row, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = F.when(F.col(on).isNotNull(), F.col("__row"))
    return filled.where("__left").select(*keys, *[found[v].alias(v) for v in values])


def _handed_on(r: DataFrame, on: str, by: list[str], values: list[str], forward: bool, parts: int) -> DataFrame:
    """For each range after one with right rows (forward: before it), up to the next such range, the row that is carried into it: `parts` rows a key at most."""
    at, pick = F.struct(on, "__tie"), F.min_by if forward else F.max_by
    ends = r.groupBy(*by, "__range").agg(pick(F.struct(*values), at).alias("__end"))
    step, last = (-1, 0) if forward else (1, parts - 1)
    following = F.lead("__range").over(Window.partitionBy(*by).orderBy(F.desc("__range") if forward else F.asc("__range")))
    ends = ends.withColumn("__to", F.coalesce(following, F.lit(last))).where(F.col("__range") != last)
    to = F.explode(F.sequence(F.col("__range") + step, F.col("__to"), F.lit(step)))
    return ends.select(*by, "__end.*", to.alias("__range")).withColumns({"__left": F.lit(False), "__handed": F.lit(True)})


def band(events: DataFrame, series: DataFrame, keys: list[str], position: str, before: int, after: int, values: list[str]) -> DataFrame:
    """Each event with the series rows from `before` positions before it to `after` after it, as column rel: an equi-join on the shifted position."""
    wide = events.withColumn("rel", F.explode(F.sequence(F.lit(-before), F.lit(after))))
    wide = wide.withColumn("__at", F.col(position) + F.col("rel"))
    r = series.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(position).alias("__p"), *values)
    cond = F.col("__at") == F.col("__p")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__{k}"))
    return wide.join(r, cond).drop("__at", "__p", *[f"__{k}" for k in keys])


def pairs_of(roots: list[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """(class, a, b) for roots of one class, in the order of the list."""
    return [(ca, a, b) for i, (a, ca) in enumerate(roots) for b, cb in roots[i + 1 :] if ca == cb]


def align(panel: DataFrame, a: str, b: str, key: str, on: str, values: list[str]) -> DataFrame:
    """The rows of two series side by side, as value_a and value_b, on common times."""
    one = panel.where(F.col(key) == a).select(on, *[F.col(v).alias(f"{v}_a") for v in values])
    two = panel.where(F.col(key) == b).select(on, *[F.col(v).alias(f"{v}_b") for v in values])
    return one.join(two, on)
