"""Long-only backtest of a signal with costs, and its metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxbar.functions import div, series
from fluxbar.operators.windows import rolling_mean, signal_position, simple_return, turnover


def crossover(bars: DataFrame, fast: int, slow: int, key: str = "symbol", order: str = "ts") -> DataFrame:
    """bars with fast_ma, slow_ma and signal: 1 while the fast mean is over the slow one."""
    if fast >= slow:
        raise ValueError("fast must be under slow")
    w = series(key, order=order)
    df = bars.withColumn("fast_ma", rolling_mean("close", w, fast)).withColumn("slow_ma", rolling_mean("close", w, slow))
    return df.withColumn("signal", F.when(F.col("fast_ma") > F.col("slow_ma"), 1.0).otherwise(0.0))


def run(bars: DataFrame, cost_bps: float, lag: int = 1, most: float = 1.0, capital: float = 1.0, key: str = "symbol", order: str = "ts") -> DataFrame:
    """bars with ret, position, turnover, cost, net, equity and drawdown. One shuffle, by the series."""
    w = series(key, order=order)
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    df = bars.withColumn("ret", simple_return("close", w)).withColumn("position", signal_position("signal", w, lag, most))
    df = df.withColumn("turnover", turnover("position", w)).withColumn("cost", F.col("turnover") * (cost_bps / 1e4))
    df = df.withColumn("net", F.col("position") * F.col("ret") - F.col("cost"))
    df = df.withColumn("equity", F.lit(capital) * F.product(1 + F.col("net")).over(past))
    return df.withColumn("drawdown", F.col("equity") / F.max("equity").over(past) - 1)


def metrics(ran: DataFrame, per_year: int, capital: float = 1.0, key: str = "symbol", order: str = "ts") -> DataFrame:
    """One row for each series; without spread, volatility and Sharpe ratio are 0."""
    sd = F.coalesce(F.stddev_samp("net"), F.lit(0.0))
    return ran.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), (F.max_by("equity", order) / capital - 1).alias("total_return"),
        (F.pow(1 + F.avg("net"), F.lit(per_year)) - 1).alias("annual_return"), (sd * per_year**0.5).alias("volatility"),
        F.coalesce(div(F.avg("net"), F.nullif(sd, F.lit(0.0))) * per_year**0.5, F.lit(0.0)).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"), F.avg("position").alias("mean_position"), F.sum("turnover").alias("turnover"),
        F.count_if(F.col("turnover") > 0).alias("trades"),
    )
