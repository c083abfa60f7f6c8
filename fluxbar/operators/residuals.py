"""Relative value across a panel: residuals, per-root entry and exit states, normalised positions, and their returns."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxbar.functions import div, series


def cross_sectional_z(panel: DataFrame, on: str, x: str) -> DataFrame:
    w = Window.partitionBy(on)
    return panel.withColumn("cross_z", div(F.col(x) - F.avg(x).over(w), F.nullif(F.stddev_samp(x).over(w), F.lit(0.0))))


def residual(panel: DataFrame, on: str, x: str) -> DataFrame:
    """panel with residual: x less its mean over the roots of the time."""
    return panel.withColumn("residual", F.col(x) - F.avg(x).over(Window.partitionBy(on)))


def convergence(panel: DataFrame, order: str, entry: float, exit_: float, stop: float | None = None, gate: str | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """panel (root, order, z, and the columns of also) with position: against z from |z| >= entry until it is within exit; beyond stop flat, and in again while the gate is on. A fold a root."""
    kinds = {f.name: f.dataType.simpleString() for f in panel.schema}
    rows = panel.select("root", order, "z", *also, (F.col(gate) if gate else F.lit(True)).alias("__gate"))

    def fold(pdf):
        pdf = pdf.sort_values(order)
        p, out = 0.0, []
        for z, on in zip(pdf["z"], pdf["__gate"], strict=True):
            if z is None or not math.isfinite(z):
                p = 0.0
            else:
                if (p > 0 and z >= -exit_) or (p < 0 and z <= exit_):
                    p = 0.0
                if stop is not None and p and abs(z) > stop:
                    p = 0.0
                if not p and on and abs(z) >= entry:
                    p = -math.copysign(1.0, z)
            out.append(p)
        return pdf.assign(position=out)[["root", order, "z", *also, "position"]]

    return rows.groupBy("root").applyInPandas(fold, ", ".join(["root string", f"{order} {kinds[order]}", "z double", *[f"`{c}` {kinds[c]}" for c in also], "position double"]))


def normalise(panel: DataFrame, on: str, demean: bool = True) -> DataFrame:
    """panel with weight: positions of a time less their mean (where any is held), over the sum of their sizes."""
    w = Window.partitionBy(on)
    held = F.sum(F.abs("position")).over(w) > 0
    df = panel.withColumn("__p", F.when(held, F.col("position") - (F.avg("position").over(w) if demean else F.lit(0.0))).otherwise(0.0))
    return df.withColumn("weight", F.coalesce(div(F.col("__p"), F.nullif(F.sum(F.abs("__p")).over(w), F.lit(0.0))), F.lit(0.0))).drop("__p")


def portfolio(panel: DataFrame, on: str, ret: str, cost_bps: float, lag: int = 1) -> DataFrame:
    """One row a time: gross return of the lagged weights, turnover of the unlagged ones, cost and net."""
    w = series("root", order=on)
    df = panel.withColumn("__held", F.coalesce(F.lag("weight", lag).over(w), F.lit(0.0)))
    df = df.withColumn("__turn", F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(w), F.lit(0.0))))
    out = df.groupBy(on).agg(F.sum(F.col("__held") * F.coalesce(ret, F.lit(0.0))).alias("gross"), F.sum("__turn").alias("turnover"))
    return out.withColumn("cost", F.col("turnover") * (cost_bps / 1e4)).withColumn("net", F.col("gross") - F.col("cost"))


def cost_variants(df: DataFrame, multipliers: list[float]) -> DataFrame:
    """Each row under each multiple of its cost."""
    return df.withColumn("multiplier", F.explode(F.array(*[F.lit(m) for m in multipliers]))).withColumn("net", F.col("gross") - F.col("cost") * F.col("multiplier"))


def position_backtest(panel: DataFrame, on: str, ret: str, cost_bps: dict[str, float], otherwise: float, lag: int = 1) -> DataFrame:
    """portfolio() with each root's own cost; roots that cost_bps doesn't name cost `otherwise`."""
    own = F.lit(otherwise)
    for root, bps in cost_bps.items():
        own = F.when(F.col("root") == root, F.lit(float(bps))).otherwise(own)
    w = series("root", order=on)
    df = panel.withColumn("__turn", F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(w), F.lit(0.0))))
    cost = df.groupBy(on).agg(F.sum(F.col("__turn") * own / 1e4).alias("cost"))
    done = portfolio(panel, on, ret, 0.0, lag).drop("cost", "net").join(cost, on)
    return done.withColumn("net", F.col("gross") - F.col("cost"))
