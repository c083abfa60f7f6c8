"""Pair experiments, flow research, decayed moments, root tables and sinks."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxbar import sources
from fluxbar.operators import anomaly, bars, pairs, residuals
from fluxbar.plans import experiments


def plain_ewma(x, half_life, least, ridge):
    alpha = 1 - 0.5 ** (1 / half_life)
    mean, cov, out = x[0], ridge * np.eye(x.shape[1]), [None]
    for t in range(1, len(x)):
        d = x[t] - mean
        own = cov + ridge * np.trace(cov) / len(cov) * np.eye(len(cov))
        out.append((math.sqrt(d @ np.linalg.inv(own) @ d), mean.copy(), cov.copy()) if t >= least else None)
        mean, cov = mean + alpha * d, (1 - alpha) * cov + alpha * np.outer(d, d)
    return out


def test_decayed_moments_are_the_recursion(spark):
    rng = np.random.default_rng(0)
    x = np.cumsum(rng.normal(size=(700, 3)), 0)
    rows = [("u", i, *map(float, r)) for i, r in enumerate(x)] + [("u", 10_000, None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "u string, t int, a double, b double, c double")
    want = plain_ewma(x, 20, 30, 1e-6)
    found = anomaly.ewma_mahalanobis(df, ["u"], "t", ["a", "b", "c"], 20, 30).orderBy("t").collect()
    assert [r.distance is None for r in found] == [w is None for w in want] + [True]
    assert [r.distance for r in found if r.distance is not None] == pytest.approx([w[0] for w in want if w], rel=1e-6)
    rest = anomaly.ewma_residual(df, ["u"], "t", ["a", "b", "c"], 20, 30).orderBy("t").collect()
    for t in (30, 31, 299, 699):
        _, mean, cov = want[t]
        inner = cov[1:, 1:] + 1e-6 * np.trace(cov[1:, 1:]) / 2 * np.eye(2)
        assert rest[t].residual_a == pytest.approx(x[t, 0] - mean[0] - cov[0, 1:] @ np.linalg.solve(inner, x[t, 1:] - mean[1:]), rel=1e-6)
    assert rest[700].residual_a is None and rest[0].residual_b is None


def frames(spark, n=160):
    rng = np.random.default_rng(4)
    rows = []
    for pair in ("p/q", "p/r"):
        a = np.cumsum(rng.normal(0, 0.01, n)) + 4
        b = (a if pair == "p/q" else np.cumsum(rng.normal(0, 0.01, n)) + 4) + rng.normal(0, 0.006, n)
        rows += [(pair, i, float(a[i]), float(b[i]), float(a[i] - a[i - 1]) if i else 0.0, float(b[i] - b[i - 1]) if i else 0.0) for i in range(n)]
    return spark.createDataFrame(rows, "pair string, ts int, log_price_a double, log_price_b double, log_return_a double, log_return_b double")


def test_small_changes_are_not_followed(spark):
    assert pairs.followed([0.1, 0.5, 0.55, 0.0], [0.0, -0.5, -0.5, 0.0], 0.2) == ([0.0, 0.5, 0.5, 0.0], [0.0, -0.5, -0.5, 0.0])
    assert pairs.followed([0.1, 0.0], [0.0, 0.0], 0.0) == ([0.1, 0.0], [0.0, 0.0])
    free = pairs.run(frames(spark), 20, pairs.Rules(1.2, 0.4), 1.0).agg(F.sum("turnover")).first()[0]
    held = pairs.run(frames(spark), 20, pairs.Rules(1.2, 0.4, min_change=0.2), 1.0).agg(F.sum("turnover")).first()[0]
    assert 0 < held < free


def test_pair_experiment_selects_tests_and_writes(spark, tmp_path):
    methods = {"zscore": {"entry": 1.2, "exit": 0.4}, "zscore_mahalanobis": {"entry": 1.2, "exit": 0.4, "confirm": 0.5}, "mahalanobis": {"entry": 1.2, "exit": 0.4}}
    config = {"lookback": 20, "methods": methods, "cost_bps": 1.0, "per_year": 252, "train_share": 0.5, "least_rows": 100, "least_corr": 0.8}
    one = frames(spark)
    corr = {p: np.corrcoef(*np.array([(r.log_price_a, r.log_price_b) for r in one.where((F.col("pair") == p) & (F.col("ts") < 80)).orderBy("ts").collect()]).T)[0, 1] for p in ("p/q", "p/r")}
    got = experiments.run_pairs(one, config, str(tmp_path / "run"))
    chosen = {r.pair for r in got["selection"].where("selected").collect()}
    assert chosen == {p for p, c in corr.items() if abs(c) >= 0.8} and "p/q" in chosen
    ran = pairs.run(one, 20, pairs.Rules(1.2, 0.4), 1.0).where("pair = 'p/q' and ts >= 80").orderBy("ts").collect()
    equity = np.cumprod([1 + r.net for r in ran])
    m = got["metrics"].where("method = 'zscore' and pair = 'p/q'").first()
    assert m.n == 80 and m.total_return == pytest.approx(equity[-1] - 1) and m.max_drawdown == pytest.approx(min(equity / np.maximum.accumulate(equity) - 1))
    assert m.trades == sum(r.turnover > 0 for r in ran) and got["metrics"].count() == 3 * len(chosen) and got["portfolio"].count() == 3 * 80
    best = experiments.leaderboard(spark, str(tmp_path), "total_return", 1).first()
    assert best.total_return == max(r.total_return for r in got["metrics"].collect())
    assert json.loads(got["metrics"].toJSON().first())["n"] == 80 and (tmp_path / "run" / "metrics-csv").exists()
    with pytest.raises(ValueError):
        experiments.run_pairs(one, config | {"speed": 1})


def test_roots_and_read_through(spark, tmp_path):
    for root, extra in (("A", {}), ("B", {"volume": 2.0})):
        df = spark.createDataFrame([(1.0,)], "close double")
        for c, v in extra.items():
            df = df.withColumn(c, F.lit(v))
        df.write.parquet(str(tmp_path / f"{root}.parquet"))
    every = {(r.root, r.volume) for r in sources.load_roots(spark, str(tmp_path)).collect()}
    assert every == {("A", None), ("B", 2.0)} and sources.load_roots(spark, str(tmp_path), ["B", "C"]).count() == 1
    with pytest.raises(FileNotFoundError):
        sources.load_roots(spark, str(tmp_path), ["C"])
    built = []
    build = lambda: built.append(1) or spark.range(3)
    assert [sources.read_through(spark, str(tmp_path / "kept"), build).count() for _ in range(2)] == [3, 3] and built == [1]


def test_variance_threshold_and_costs(spark):
    rows = [("A", d, h, 0.01 * (h + 1)) for d in range(4) for h in range(3)]
    df = spark.createDataFrame(rows, "root string, day int, hour int, ret double")
    assert bars.variance_threshold(df, F.col("day") < 3, 2).first().threshold == pytest.approx((1 + 4 + 9) * 1e-4 / 2)
    panel = spark.createDataFrame([("A", 1, 1.0, 0.0), ("B", 1, -1.0, 0.0), ("A", 2, 0.0, 0.1), ("B", 2, -1.0, 0.2)], "root string, t int, weight double, ret double")
    found = {r.t: r for r in residuals.position_backtest(panel, "t", "ret", {"A": 2.0}, 5.0).collect()}
    assert found[1].cost == pytest.approx(7e-4) and found[2].cost == pytest.approx(2e-4) and found[2].gross == pytest.approx(-0.1) and found[2].net == pytest.approx(-0.1002)


def test_synthetic_bars_come_back(spark):
    df = sources.synthetic_bars(spark, "A", "2015-01-01", "2024-12-31", 5)
    n, mean, sd = df.agg(F.count("close"), F.avg(F.log("close")), F.stddev_samp(F.log("close"))).first()
    assert n > 2500 and abs(mean - math.log(50)) < 0.02 and 0.01 < sd < 0.05
    sources.validate_bars(df)
    assert df.where("high < greatest(open, close) or low > least(open, close) or volume <= 0").isEmpty()
    assert sources.synthetic_bars(spark, "A", "2015-01-01", "2015-03-01", 6).first().close != df.first().close
