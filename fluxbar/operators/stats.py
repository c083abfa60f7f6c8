"""Studies of forward returns, and the tests behind them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxbar.functions import div, safe_corr, series
from fluxbar.operators.bars import ranges
from fluxbar.operators.windows import average_rank, deciles


def return_stats(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """n, mean, median and deviation in basis points, t, hit rate and ratio for each group; without spread t and ratio are NULL."""
    n = F.count(x)
    sd = F.when(n == 1, F.lit(0.0)).otherwise(F.stddev_samp(x))
    ratio = div(F.avg(x), F.nullif(sd, F.lit(0.0)))
    return df.where(F.col(x).isNotNull()).groupBy(*keys).agg(
        n.alias("n"), (F.avg(x) * 1e4).alias("mean_bps"), (F.median(x) * 1e4).alias("median_bps"), (sd * 1e4).alias("sd_bps"),
        (ratio * F.sqrt(n.cast("double"))).alias("t"), F.avg((F.col(x) > 0).cast("double")).alias("hit_rate"), ratio.alias("ratio"),
    )


def decile_study(df: DataFrame, key: str, feature: str, forward: str, order: str, buckets: int = 10) -> DataFrame:
    """return_stats of the forward return for each bucket of the feature; ties of the feature by `order`."""
    both = df.where(F.col(feature).isNotNull() & F.col(forward).isNotNull())
    whole = Window.partitionBy(key)
    both = both.withColumn("decile", deciles(feature, whole.orderBy(feature, order), whole, buckets))
    return return_stats(both, [key, "decile"], forward)


def information_coefficient(df: DataFrame, keys: list[str], feature: str, forward: str, least: int = 30, distinct: int = 5) -> DataFrame:
    """Spearman correlation with its t-distributed p-value; NULL under `least` pairs or `distinct` values of either side."""
    both = df.where(F.col(feature).isNotNull() & F.col(forward).isNotNull())
    both = both.withColumn("__x", average_rank(feature, keys)).withColumn("__y", average_rank(forward, keys))
    out = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), safe_corr("__x", "__y").alias("ic"), F.countDistinct(feature).alias("__dx"), F.countDistinct(forward).alias("__dy"))
    ok = (F.col("n") >= least) & (F.col("__dx") >= distinct) & (F.col("__dy") >= distinct)
    out = out.withColumn("ic", F.when(ok, F.col("ic"))).drop("__dx", "__dy")
    t = F.col("ic") * F.sqrt(div((F.col("n") - 2).cast("double"), F.nullif(1 - F.col("ic") * F.col("ic"), F.lit(0.0))))
    return out.withColumn("t", t).withColumn("p", t_p_value(F.col("t"), F.col("n") - 2))


def student_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t: the regularised incomplete beta function by its continued fraction."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if x > 0 else 0.0
    if x > (a + 1) / (a + b + 2):
        return 1 - front * _beta_fraction(1 - x, b, a) / b
    return front * _beta_fraction(x, a, b) / a


def _beta_fraction(x: float, a: float, b: float) -> float:
    """Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 300):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + k / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def t_p_value(t: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def of(t, df):
        return t.combine(df, lambda a, b: None if a is None or a != a or b is None or b <= 0 else student_sf2(abs(a), b))

    return of(t, df.cast("double"))


def benjamini_hochberg(df: DataFrame, p: str, keys: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """df with q: p m / rank, made monotone from the largest p down, at most 1; rows without p keep NULL and don't count.

    A task holds a group's rows. With parts, for large groups, it holds the distinct p
    of one of so many ranges; p must then be the same whenever it is worked out.
    """
    keys = keys or []
    seen = df.where(F.col(p).isNotNull())
    if parts:
        done = _q_by_ranges(seen, p, keys, parts)
    else:
        seen = seen.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(p)))
        seen = seen.withColumn("__raw", F.col(p) * F.count(F.lit(1)).over(Window.partitionBy(*keys)) / F.col("__i"))
        # From the largest p down: Spark works a frame that reaches to the end out anew for each row.
        down = Window.partitionBy(*keys).orderBy(F.desc("__i")).rowsBetween(Window.unboundedPreceding, 0)
        done = seen.withColumn("q", F.least(F.min("__raw").over(down), F.lit(1.0))).drop("__i", "__raw")
    return done.unionByName(df.where(F.col(p).isNull()).withColumn("q", F.lit(None).cast("double")))


def _q_by_ranges(seen: DataFrame, p: str, keys: list[str], parts: int) -> DataFrame:
    """seen with q. Rows of one p share the last one's rank and so q, which is worked out once for each p.

    Ranks are shifted by the sizes of the ranges before, least values come down from the ranges after.
    """
    place = ranges(seen.where(~F.isnan(p)), p, parts)
    each = seen.groupBy(*keys, p).agg(F.count(F.lit(1)).alias("__n")).withColumn("__range", place(F.col(p)))
    own, whole = Window.partitionBy(*keys, "__range"), Window.partitionBy(*keys)
    each = each.withColumn("__i", F.sum("__n").over(own.orderBy(p).rowsBetween(Window.unboundedPreceding, 0)))

    def joined(one: DataFrame, many: DataFrame, on: str, how: str = "inner") -> DataFrame:
        named = many.withColumnsRenamed({c: f"__of_{c}" for c in [*keys, on]})
        cond = F.col(on) == F.col(f"__of_{on}")
        for k in keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
        return one.join(named, cond, how).drop(*[f"__of_{c}" for c in [*keys, on]])

    # `parts` rows at most a key.
    sizes = each.groupBy(*keys, "__range").agg(F.sum("__n").alias("__size"))
    before = F.sum("__size").over(whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*keys, "__range", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__size").over(whole).alias("__m"))
    each = joined(each, sizes, "__range").withColumn("__raw", F.col(p) * F.col("__m") / (F.col("__before") + F.col("__i")))
    lows = each.groupBy(*keys, "__range").agg(F.min("__raw").alias("__low"))
    lows = lows.select(*keys, "__range", F.min("__low").over(whole.orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)).alias("__later"))
    q = F.least(F.min("__raw").over(own.orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)), "__later", F.lit(1.0))
    return joined(seen, joined(each, lows, "__range").select(*keys, p, q.alias("q")), p, "left")


def regression(df: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """Slope, its t, correlation and sign agreement of y on x; the slope's sign names momentum or mean reversion."""
    slope, sxx, syy, sxy = F.regr_slope(y, x), F.regr_sxx(y, x), F.regr_syy(y, x), F.regr_sxy(y, x)
    n = F.regr_count(y, x)
    residual = div(syy - slope * sxy, (n - 2).cast("double"))
    out = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(
        n.alias("n"), slope.alias("slope"), div(slope, F.nullif(F.sqrt(div(residual, sxx)), F.lit(0.0))).alias("t"), safe_corr(x, y).alias("corr"),
        F.avg((F.signum(x) == F.signum(y)).cast("double")).alias("sign_agreement"),
    )
    return out.withColumn("kind", F.when(F.col("slope") > 0, "momentum").when(F.col("slope") < 0, "mean_reversion"))


def half_life(df: DataFrame, keys: list[str], x: str, order: str) -> DataFrame:
    """-ln 2 / b of the change on the level before it; infinite where b is not below 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    df = df.withColumn("__lag", F.lag(x).over(w)).withColumn("__delta", F.col(x) - F.col("__lag"))
    b = F.regr_slope("__delta", "__lag")
    return df.groupBy(*keys).agg(F.when(b < 0, -math.log(2) / b).when(b.isNotNull(), F.lit(float("inf"))).alias("half_life"))


#: MacKinnon (1994) response surfaces of the ADF test with a constant, one series: bounds and coefficients by rising power.
ADF_MIN, ADF_STAR, ADF_MAX = -18.83, -1.61, 2.74
ADF_SMALL = (2.1659, 1.4412, 0.038269)
ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def adf(x: np.ndarray, max_lag: int | None = None) -> tuple[float, float, int]:
    """Augmented Dickey-Fuller statistic, p-value and lag (by AIC); NaN for under 20 values or a constant series."""
    x = np.asarray(x, float)
    x = x[np.isfinite(x)]
    n = len(x)
    if n < 20 or x.std() == 0:
        return math.nan, math.nan, 0
    most = min(math.ceil(12 * (n / 100) ** 0.25) if max_lag is None else max_lag, n // 2 - 2)
    dx = np.diff(x)

    def fit(lag: int, start: int):
        y = dx[start:]
        cols = [np.ones(len(y)), x[start:-1]] + [dx[start - k : len(dx) - k] for k in range(1, lag + 1)]
        a = np.column_stack(cols)
        coef, *_ = np.linalg.lstsq(a, y, rcond=None)
        return a, y, coef, float(((y - a @ coef) ** 2).sum())

    def aic(lag: int) -> float:
        a, y, _, rss = fit(lag, most)
        return len(y) * math.log(max(rss, 1e-300) / len(y)) + 2 * a.shape[1]

    lag = min(range(most + 1), key=aic)
    a, y, coef, rss = fit(lag, lag)
    var = rss / max(1, len(y) - a.shape[1]) * np.linalg.pinv(a.T @ a)[1, 1]
    stat = float(coef[1] / math.sqrt(var)) if var > 0 else math.nan
    return stat, adf_p_value(stat), lag


def adf_p_value(stat: float) -> float:
    if not math.isfinite(stat):
        return math.nan
    if stat > ADF_MAX:
        return 1.0
    if stat < ADF_MIN:
        return 0.0
    z = sum(c * stat**k for k, c in enumerate(ADF_SMALL if stat <= ADF_STAR else ADF_LARGE))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def cointegration(panel: DataFrame, pairs: DataFrame, order: str, value: str, max_lag: int | None = 1) -> DataFrame:
    """(a, b, n, beta, statistic, p, half_life) for each pair of roots: OLS of a on b, and the unit-root test of its residual. Pairs run side by side."""
    one = panel.select(F.col("root").alias("a"), F.col(order).alias("__t"), F.col(value).alias("ya"))
    two = panel.select(F.col("root").alias("b"), F.col(order).alias("__t"), F.col(value).alias("yb"))
    joined = pairs.select("a", "b").join(one, "a").join(two, ["b", "__t"])

    def test(keys, pdf):
        import pandas as pd

        pdf = pdf.dropna(subset=["ya", "yb"]).sort_values("__t")
        y, x = pdf["ya"].to_numpy(), pdf["yb"].to_numpy()
        var = x.var(ddof=1) if len(x) > 1 else 0.0
        beta = float(np.cov(x, y)[0, 1] / var) if var > 0 else math.nan
        r = y - beta * x - (y - beta * x).mean() if len(x) else y
        stat, p, _ = adf(r, max_lag)
        b = np.polyfit(r[:-1], np.diff(r), 1)[0] if len(r) > 2 and r[:-1].std() > 0 else math.nan
        return pd.DataFrame([(*keys, len(x), beta, stat, p, -math.log(2) / b if b < 0 else math.inf)], columns=["a", "b", "n", "beta", "statistic", "p", "half_life"])

    return joined.groupBy("a", "b").applyInPandas(test, "a string, b string, n long, beta double, statistic double, p double, half_life double")


def day_bootstrap(daily: DataFrame, x: str, iterations: int = 2000, block: int = 5, seed: int = 0, most_days: int = 100_000) -> dict[str, float]:
    """Observed sum and percentiles of block-bootstrapped sums of a daily series; days are few and bounded by most_days."""
    rows = daily.select(x).limit(most_days + 1).collect()
    if len(rows) > most_days:
        raise ValueError("too many days")
    v = np.array([r[0] for r in rows], float)
    if not len(v):
        return {"observed": math.nan, "p05": math.nan, "p50": math.nan, "p95": math.nan}
    rng = np.random.default_rng(seed)
    starts = rng.integers(0, len(v), (iterations, -(-len(v) // block)))
    at = (starts[:, :, None] + np.arange(block)).reshape(iterations, -1)[:, : len(v)] % len(v)
    sums = v[at].sum(1)
    return {"observed": float(v.sum())} | {f"p{q:02}": float(np.percentile(sums, q)) for q in (5, 50, 95)}


def rows_a_year(order: str) -> Column:
    """Rows of a group over the years (of 365.25 days) from its first time to its last."""
    us = F.unix_micros(F.col(order).cast("timestamp"))
    return F.count(F.lit(1)) / F.greatest((F.max(us) - F.min(us)) / F.lit(365.25 * 86400e6), F.lit(1e-9))


def metric_block(df: DataFrame, keys: list[str], order: str, x: str) -> DataFrame:
    """n, compounded log returns, volatility and Sharpe ratio by the rows a year that elapsed time gives, drawdown, and the 95 % quantile of the moves' sizes."""
    past = series(*keys, order=order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__sum", F.sum(x).over(past)).withColumn("__top", F.max("__sum").over(past))
    sd = F.nullif(F.stddev_samp(x), F.lit(0.0))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.expm1(F.sum(x)).alias("compounded"), (sd * F.sqrt(rows_a_year(order))).alias("volatility"), (F.avg(x) / sd * F.sqrt(rows_a_year(order))).alias("sharpe"),
        F.min(F.expm1(F.col("__sum") - F.col("__top"))).alias("drawdown"), F.percentile(F.abs(x), 0.95).alias("move_q95"),
    )
