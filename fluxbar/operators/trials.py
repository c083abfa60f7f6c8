"""Trials of a rule: what is fitted comes from the first part of the days, what is reported from the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxbar.functions import clip, div, guarded, ln, series, trailing
from fluxbar.operators import panels, residuals, stats, windows


def split_days(df: DataFrame, keys: list[str], day: str, share: float) -> DataFrame:
    """df with train: whether the day is among the first floor(share n) of its series' n days, 1 to n - 1 of them. Only days are numbered, not rows."""
    days = df.select(*keys, F.col(day).alias(day)).where(F.col(day).isNotNull()).distinct()
    every = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(every)
    cut = F.least(F.greatest(F.floor(n * share), F.lit(1)), n - 1)
    return df.join(days.withColumn("train", F.row_number().over(every.orderBy(day)) <= cut), [*keys, day])


def summary(rows: DataFrame, keys: list[str], order: list[str], per_year: Column | float) -> DataFrame:
    """n, gross, cost, net, mean in basis points, t, Sharpe ratio, hit rate and the deepest fall of the summed net for each group; without spread t and ratio are 0.

    rows have gross and cost, missing ones count as 0. per_year may be an aggregate.
    """
    gross, cost = F.coalesce("gross", F.lit(0.0)), F.coalesce("cost", F.lit(0.0))
    past = series(*keys, order=order).rowsBetween(Window.unboundedPreceding, 0)
    df = rows.withColumns({"gross": gross, "cost": cost}).withColumn("net", F.col("gross") - F.col("cost"))
    df = df.withColumn("__sum", F.sum("net").over(past)).withColumn("__top", F.max("__sum").over(past))
    ratio = F.coalesce(div(F.avg("net"), F.nullif(F.stddev_samp("net"), F.lit(0.0))), F.lit(0.0))
    year = F.lit(float(per_year)) if isinstance(per_year, int | float) else per_year
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("gross").alias("gross"), F.sum("cost").alias("cost"), F.sum("net").alias("net"), (F.avg("net") * 1e4).alias("mean_bps"),
        (ratio * F.sqrt(F.count(F.lit(1)).cast("double"))).alias("t"), (ratio * F.sqrt(year)).alias("sharpe"), F.avg((F.col("net") > 0).cast("double")).alias("hit_rate"),
        F.min(F.col("__sum") - F.col("__top")).alias("drawdown"),
    )


def event_drift(events: DataFrame, order: str, share: float, cost_bps: float, least_train: int = 5, least_test: int = 1) -> DataFrame:
    """The later events with position, gross and cost, from events (root, order, seen, later).

    A root follows the sign of the move seen, or goes against it, as the slope of
    later on seen over the earlier events says; with too few events of either part,
    or no slope, it stays flat. Events without either move take no part. All roots
    are split at the same time.
    """
    both = windows.chronological_split(events.where("seen IS NOT NULL AND later IS NOT NULL"), order, share)
    fit = both.groupBy("root").agg(
        F.count_if("train").alias("__train"), F.count_if(~F.col("train")).alias("__test"),
        F.regr_slope(F.when(F.col("train"), F.col("later")), F.when(F.col("train"), F.col("seen"))).alias("__slope"),
    )
    enough = (F.col("__train") >= least_train) & (F.col("__test") >= least_test)
    side = F.when(enough, F.coalesce(F.signum("__slope"), F.lit(0.0))).otherwise(0.0)
    rows = both.where(~F.col("train")).join(fit, "root").withColumn("position", side * F.signum("seen"))
    rows = rows.withColumn("gross", F.col("position") * F.col("later")).withColumn("cost", F.abs("position") * (cost_bps / 1e4))
    return rows.drop("train", "__train", "__test", "__slope")


def impact_decay(bars: DataFrame, order: str, day: str, flow: str, ret: str, quantile: float, share: float, cost_bps: float) -> DataFrame:
    """The later bars of extreme flow and return of one sign, with side (continue or fade), position, gross and cost.

    Both thresholds are quantiles of sizes over a root's earlier bars; whether to go
    on with the move or against it is the sign of the mean next return along it
    after the earlier extreme bars, against it where that is 0 or there are none.
    Bars without a next return take no part.
    """
    nxt = F.lead(ret).over(series("root", order=order))
    df = split_days(bars.withColumn("__next", nxt), ["root"], day, share)
    limits = df.where("train").groupBy("root").agg(F.percentile(F.abs(flow), quantile).alias("__f"), F.percentile(F.abs(ret), quantile).alias("__r"))
    extreme = (F.abs(flow) >= F.col("__f")) & (F.abs(ret) >= F.col("__r")) & (F.signum(flow) == F.signum(ret))
    hot = df.join(limits, "root").where(extreme & F.col("__next").isNotNull())
    along = hot.where("train").groupBy("root").agg(F.avg(F.signum(ret) * F.col("__next")).alias("__along"))
    side = F.when(F.col("__along") > 0, 1.0).otherwise(-1.0)
    rows = hot.where(~F.col("train")).join(along, "root", "left").withColumn("side", F.when(side > 0, "continue").otherwise("fade")).withColumn("position", side * F.signum(ret))
    rows = rows.withColumn("gross", F.col("position") * F.col("__next")).withColumn("cost", F.abs("position") * (cost_bps / 1e4))
    return rows.drop("train", "__next", "__f", "__r", "__along")


def reversal_scores(panel: DataFrame, on: str, price: str, within: list[str], lookback: int, least: int, entry: float, deadband: float = 0.0) -> DataFrame:
    """panel with score, from -1 to 1: against the z-score of the price less its mean over the columns `within`, cut at +-entry; 0 under the deadband."""
    gap = F.col(price) - F.avg(price).over(Window.partitionBy(*within))
    t = trailing(series("root", order=on), lookback)
    df = panel.withColumn("__gap", gap)
    z = guarded(div(F.col("__gap") - F.avg("__gap").over(t), F.nullif(F.stddev_samp("__gap").over(t), F.lit(0.0))), "__gap", t, least)
    df = df.withColumn("__z", z)
    return df.withColumn("score", F.when(F.abs("__z") < deadband, 0.0).otherwise(-clip(F.col("__z"), -entry, entry) / entry)).drop("__gap", "__z")


def weights(panel: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """panel with weight: the score over the sum of sizes of its group; missing scores weigh 0."""
    clean = F.coalesce(F.col(score), F.lit(0.0))
    return panel.withColumn("weight", F.coalesce(div(clean, F.nullif(F.sum(F.abs(clean)).over(Window.partitionBy(*by)), F.lit(0.0))), F.lit(0.0)))


def held_ahead(panel: DataFrame, keys: list[str], on: str, ret: str, cost_bps: float) -> DataFrame:
    """(keys, on, gross, turnover, cost): each time's weights earn the returns of the next time. The panel has every root at each time.

    The first time's weights are no turnover.
    """
    w = series(*keys, "root", order=on)
    df = panel.withColumn("__ahead", F.coalesce(F.lead(ret).over(w), F.lit(0.0)))
    df = df.withColumn("__turn", F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(w), F.col("weight"))))
    out = df.groupBy(*keys, on).agg(F.sum(F.col("weight") * F.col("__ahead")).alias("gross"), F.sum("__turn").alias("turnover"))
    return out.withColumn("cost", F.col("turnover") * (cost_bps / 1e4))


def full_panel(panel: DataFrame, on: str, roots: list[str], values: list[str]) -> DataFrame:
    """A row for each time and root, missing values NULL."""
    return panels.cells(panel, on, roots, values, None)


def residual_basket(panel: DataFrame, on: str, price: str, ret: str, within: list[str], lookback: int, entry: float, cost_bps: float, share: float) -> DataFrame:
    """The later times of the portfolio that holds reversal_scores() over their sum of sizes."""
    scored = weights(reversal_scores(panel, on, price, within, lookback, lookback // 2, entry), [on])
    return windows.chronological_split(held_ahead(scored, [], on, ret, cost_bps), on, share).where(~F.col("train")).drop("train")


def carry_momentum(panel: DataFrame, on: str, price: str, carry: str, ret: str, back: int, cost_bps: float, share: float) -> DataFrame:
    """(method, on, gross, turnover, cost) of the later times for portfolios by carry, momentum and the mean of both, each as a z-score across the roots of a time."""
    across = Window.partitionBy(on)
    z = lambda c: div(F.col(c) - F.avg(c).over(across), F.nullif(F.stddev_samp(c).over(across), F.lit(0.0)))
    df = panel.withColumn("__m", F.col(price) - F.lag(price, back).over(series("root", order=on)))
    df = df.withColumns({"momentum": z("__m"), "carry_z": z(carry)}).withColumn("combined", (F.col("momentum") + F.col("carry_z")) / 2)
    long_ = df.select("root", on, F.col(ret).alias("__ret"), F.col("carry_z").alias("carry"), "momentum", "combined").unpivot(["root", on, "__ret"], ["carry", "momentum", "combined"], "method", "score")
    rows = held_ahead(weights(long_, ["method", on]), ["method"], on, "__ret", cost_bps)
    return windows.chronological_split(rows, on, share).where(~F.col("train")).drop("train")


def clocked_features(bars: DataFrame, order: str, day: str, ret: str, features: list[str], limit: float, share: float, cost_bps: float, least: int = 3) -> DataFrame:
    """(root, feature, order, day, position, turnover, gross, cost) of the later days' bars.

    A position is the feature of the bar before, cut at +-limit, with the sign of the
    slope of the next return on the feature; the fit takes pairs of bars that both
    lie in the root's earlier days, and is flat with fewer than `least` of them.
    """
    long_ = split_days(bars, ["root"], day, share).unpivot(["root", order, day, ret, "train"], features, "feature", "x")
    w = series("root", "feature", order=order)
    df = long_.withColumns({"__next": F.lead(ret).over(w), "__stays": F.col("train") & F.coalesce(F.lead("train").over(w), F.lit(False)), "__before": F.lag("x").over(w)})
    fit = stats.regression(df.where("__stays"), ["root", "feature"], "__next", "x").select("root", "feature", F.when(F.col("n") >= least, F.coalesce(F.signum("slope"), F.lit(0.0))).otherwise(0.0).alias("__side"))
    df = df.join(fit, ["root", "feature"], "left").withColumn("position", F.coalesce(F.col("__side") * clip(F.col("__before"), -limit, limit), F.lit(0.0)))
    df = df.withColumn("turnover", windows.turnover("position", w)).withColumn("gross", F.col("position") * F.col(ret)).withColumn("cost", F.col("turnover") * (cost_bps / 1e4))
    return df.where(~F.col("train")).select("root", "feature", order, day, "position", "turnover", "gross", "cost")


def retest(panel: DataFrame, on: str, price: str, rolled: str, lookbacks: list[int], entry: float, deadband: float, pause: int, costs: list[float]) -> DataFrame:
    """(lookback, cost_bps, on, gross, turnover, exposure, cost), from each lookback's first time with a position on.

    Weights by reversal_scores(); a root that has just rolled, or did within the last
    `pause` rows, weighs 0. The panel has every root at each time; changes of price
    that miss a side count as 0.
    """
    one = series("root", order=on)
    df = panel.withColumn("__ret", F.col(price) - F.lag(price).over(one)).withColumn("__roll", F.coalesce(F.col(rolled), F.lit(False)))
    df = df.withColumn("__rest", windows.hold_mask("__roll", one, pause))
    every = None
    for back in lookbacks:
        scored = reversal_scores(df, on, price, [on], back, max(2, back // 2), entry, deadband)
        scored = weights(scored.withColumn("score", F.when(F.col("__rest"), 0.0).otherwise(F.col("score"))), [on])
        sizes = scored.groupBy(on).agg(F.sum(F.abs("weight")).alias("exposure"))
        rows = held_ahead(scored, [], on, "__ret", 0.0).drop("cost").join(sizes, on).withColumn("lookback", F.lit(back))
        every = rows if every is None else every.unionByName(rows)
    first = every.where("exposure > 0").groupBy("lookback").agg(F.min(on).alias("__first"))
    kept = every.join(first, "lookback").where(F.col(on) >= F.col("__first")).drop("__first")
    return kept.withColumn("cost_bps", F.explode(F.array(*[F.lit(float(c)) for c in costs]))).withColumn("cost", F.col("turnover") * F.col("cost_bps") / 1e4)


def gated_convergence(prices: DataFrame, on: str, price: str, gate: str, lookback: int, entry: float, exit_: float, stop: float, cost_bps: float, multipliers: list[float]) -> DataFrame:
    """The portfolio of residuals.convergence() on the log price less its mean over the roots, under each multiple of the cost.

    Positions are taken on only where the column `gate` is true. Prices that aren't
    positive are missing, and a missing z-score ends a position.
    """
    w = series("root", order=on)
    x = residuals.residual(prices.withColumn("__x", ln(price)), on, "__x").withColumn("ret", F.col("__x") - F.lag("__x").over(w))
    z = x.withColumn("z", windows.rolling_z("residual", w, lookback)).withColumn("gate", F.coalesce(gate, F.lit(False)))
    held = residuals.normalise(residuals.convergence(z.select("root", on, "z", "gate", "ret"), on, entry, exit_, stop, "gate", ("ret",)), on)
    return residuals.cost_variants(residuals.portfolio(held, on, "ret", cost_bps), multipliers)
