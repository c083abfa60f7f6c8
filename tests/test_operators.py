"""Hand-checkable vectors, slow folds as oracles, and edge cases."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxbar import cli, sources
from fluxbar.functions import div, finite, safe_corr, series
from fluxbar.operators import anomaly, backtest, bars, flow, joins, pairs, residuals, stats, windows

DAY = dt.datetime(2024, 1, 1)


def frame(spark, columns, rows):
    return spark.createDataFrame(rows, columns)


def prices(spark, closes, signals=None):
    rows = [(DAY + dt.timedelta(i), "A", float(c), float(signals[i]) if signals else 0.0) for i, c in enumerate(closes)]
    return frame(spark, "ts timestamp, symbol string, close double, signal double", rows)


def test_signal_is_lagged_and_costs_count(spark):
    ran = backtest.run(prices(spark, [100, 101, 102, 103], [0, 1, 1, 0]), 0.0).orderBy("ts").collect()
    assert [r.position for r in ran] == [0, 0, 1, 1]
    ran = backtest.run(prices(spark, [100, 100, 100], [1, 0, 1]), 10.0)
    assert ran.agg(F.sum("cost")).first()[0] == pytest.approx(0.002)
    m = backtest.metrics(ran, 252).first()
    assert m.total_return < 0 and m.trades == 2
    with pytest.raises(ValueError):
        backtest.crossover(ran, 5, 5)


def test_bars_are_checked(spark, tmp_path):
    good = sources.synthetic_bars(spark, "A", "2024-01-01", "2024-02-01", 1)
    sources.validate_bars(good)
    assert good.collect() == sources.synthetic_bars(spark, "A", "2024-01-01", "2024-02-01", 1).collect() and good.count() == 24
    for bad in (good.union(good.limit(1)), good.withColumn("close", F.lit(0.0)), good.withColumn("high", F.lit(1.0)), good.limit(0), good.drop("low")):
        with pytest.raises(ValueError):
            sources.validate_bars(bad)
    raw = good.select(F.col("timestamp").alias("t"), F.col("close").alias("px"))
    for kind in ("parquet", "csv"):
        path = str(tmp_path / kind)
        raw.write.option("header", True).format(kind).save(path)
        read = sources.read_bars(spark, path, kind, {"t": "timestamp", "px": "close"}, "A")
        assert read.count() == 24 and read.where("high <> close or volume <> 0").isEmpty()
    sources.write_sorted(good, str(tmp_path / "sorted"), ["timestamp"], 2)
    assert spark.read.parquet(str(tmp_path / "sorted")).count() == 24
    with pytest.raises(ValueError):
        sources.read_bars(spark, "x", "xml")


def test_missing_is_null(spark):
    df = frame(spark, "x double, y double", [(1.0, 0.0), (math.nan, 1.0), (math.inf, 2.0), (None, 3.0)])
    assert [r[0] for r in df.select(finite("x")).collect()] == [1.0, None, None, None]
    assert df.select(div(F.col("x"), F.col("y"))).first()[0] is None
    flat = frame(spark, "x double, y double", [(1.0, 2.0), (1.0, 3.0)])
    assert flat.select(safe_corr("x", "y")).first()[0] is None and flat.limit(0).select(safe_corr("x", "y")).first()[0] is None


def test_rolling_beta_guards_both_levels(spark):
    rng = np.random.default_rng(0)
    rows = [("p", i, float(a), float(2 * a + e)) for i, (a, e) in enumerate(zip(rng.normal(size=30), rng.normal(size=30), strict=True))]
    out = windows.rolling_beta(frame(spark, "k string, t long, a double, b double", rows), "b", "a", series("k", order="t"), 5).orderBy("t").collect()
    assert [r.beta is None for r in out] == [i < 4 for i in range(30)] and [r.z is None for r in out] == [i < 8 for i in range(30)]
    a, b = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    assert out[20].beta == pytest.approx(np.cov(a[16:21], b[16:21])[0, 1] / a[16:21].var(ddof=1))


def test_value_bars_match_a_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(k, i, float(v)) for k in "ab" for i, v in enumerate(rng.uniform(0, 5, 300))]
    df = frame(spark, "k string, i long, notional double", rows)
    found = {(r.k, r.bar_id): (r.first_i, r.last_i, r.n, r.complete) for r in bars.value_boundaries(df, 20, ["i"], keys=["k"]).collect()}
    want = {}
    for k in "ab":
        bar, total, first, n = 0, 0.0, 0, 0
        own = [r for r in rows if r[0] == k]
        for _, i, v in own:
            total, n = total + v, n + 1
            if total >= 20 or i == len(own) - 1:
                want[k, bar] = (first, i, n, total >= 20)
                bar, total, first, n = bar + 1, 0.0, i + 1, 0
    assert found == want
    assigned = bars.assign_bars(df, bars.value_boundaries(df, 20, ["i"], keys=["k"]), ["i"], ["k"]).collect()
    assert all(want[r.k, r.bar_id][0] <= r.i <= want[r.k, r.bar_id][1] for r in assigned) and len(assigned) == len(rows)
    assert bars.value_boundaries(df.limit(0), 20, ["i"]).count() == 0


def test_contract_rolls_forward_by_volume(spark):
    rows = [("A", i, s, float(v), r) for i, (h, m) in enumerate([(200, 40), (20, 400)]) for s, v, r in (("H6", h, 0), ("M6", m, 1))]
    rows += [("A", 2, "H6", 900.0, 0), ("A", 2, "M6", 1.0, 1), ("A", 3, "H6", 5.0, 0), ("A", 3, "M6", 0.0, 1)]
    out = bars.contract_schedule(frame(spark, "root string, session int, symbol string, volume double, expiry_rank int", rows)).orderBy("session").collect()
    assert [(r.active, r.is_roll) for r in out] == [("H6", False), ("M6", True), ("M6", False), ("H6", True)]


def test_asof_directions_and_ties(spark):
    left = frame(spark, "k string, t long, id long", [("a", 5, 1), ("a", 1, 2), ("b", 5, 3)])
    right = frame(spark, "k string, t long, v long, s long", [("a", 5, 10, 1), ("a", 5, 11, 2), ("a", 3, 12, 3), ("b", 6, 13, 4)])
    got = lambda forward: {r.id: r.v for r in joins.asof(left, right, "t", ["k"], ["v"], "s", forward).collect()}
    assert got(False) == {1: 11, 2: None, 3: None} and got(True) == {1: 10, 2: 12, 3: 13}


@pytest.mark.parametrize(("forward", "parts"), [(False, None), (False, 6), (True, None), (True, 6)])
def test_asof_of_large_groups(spark, forward, parts):
    """No frame reaches to the end of a group, which Spark works out anew for each row; rows without a time or a key match nothing, as in SQL."""
    rng = np.random.default_rng(5)
    left = [(k, None if i % 40 == 0 else int(t), i) for i, (k, t) in enumerate(zip(rng.choice(["a", "b", "c", None], 1500), rng.integers(-20, 320, 1500), strict=True))]
    right = [(k, None if i % 15 == 0 else int(t), None if i % 4 == 0 else i, int(s)) for i, (k, t, s) in enumerate(zip(rng.choice(["a", "b", None], 90), rng.choice([*range(0, 40), *range(250, 300)], 90), rng.integers(0, 3, 90), strict=True))]
    right = list({r[:2] + r[3:]: r for r in right}.values())
    out = joins.asof(frame(spark, "k string, t long, id long", left), frame(spark, "k string, t long, v long, s long", right), "t", ["k"], ["v"], "s", forward, parts=parts)
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower().replace("unboundedpreceding$(), unboundedfollowing$()", "")
    want = {}
    for k, t, i in left:
        near = [r for r in right if k is not None and r[0] == k and t is not None and r[1] is not None and (r[1] >= t if forward else r[1] <= t)]
        want[i] = (min if forward else max)(near, key=lambda r: (r[1], r[3]))[2] if near else None
    got = out.collect()
    assert {r.id: r.v for r in got} == want and len(got) == len(left) and out.columns == ["k", "t", "id", "v"]
    assert len({*want.values()}) > 20


def test_pairs_of_one_class_in_list_order():
    assert joins.pairs_of([("z", "x"), ("a", "x"), ("b", "y")]) == [("x", "z", "a")]


def test_pair_states_follow_the_rules():
    z = [0.0, 2.5, 1.0, 0.4, -2.5, 2.5, math.nan, 0.0]
    states, one, two = pairs.fold(z, [1.0] * 8, pairs.Rules(2.0, 0.5))
    assert states == [0, -1, -1, 0, 1, -1, 0, 0]
    assert all(abs(a) + abs(b) <= 1 + 1e-12 for a, b in zip(one, two, strict=True))
    assert pairs.fold(z, [1.0] * 8, pairs.Rules(999.0, 0.5))[0] == [0] * 8
    assert pairs.fold([2.5, 0, 2.5, 2.5], [1.0] * 4, pairs.Rules(2, 0.5, cooldown=2))[0] == [-1, 0, 0, 0]
    assert pairs.fold([2.5, 0, 0, 0], [1.0] * 4, pairs.Rules(2, 0.5, min_hold=2))[0] == [-1, -1, 0, 0]
    assert pairs.fold(z, [1.0] * 8, pairs.Rules(2.0, 0.5, confirm=1.0), [math.nan] * 8)[0] == [0] * 8
    with pytest.raises(ValueError):
        pairs.Rules(1.0, 1.0)


def test_mahalanobis_and_residuals_match_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 1]])
    df = frame(spark, "u string, t long, a double, b double, c double", [("u", i, *map(float, r)) for i, r in enumerate(x)])
    d = [r.distance for r in anomaly.rolling_mahalanobis(df, ["u"], "t", ["a", "b", "c"], 30, 20, 0.0).orderBy("t").collect()]
    h = x[40:70]
    want = math.sqrt((x[70] - h.mean(0)) @ np.linalg.inv(np.cov(h.T)) @ (x[70] - h.mean(0)))
    assert d[70] == pytest.approx(want) and d[:20] == [None] * 20
    e = anomaly.rolling_ridge_residual(df, ["u"], "t", ["a", "b", "c"], 30, 20).orderBy("t").collect()
    z = np.column_stack([np.ones(30), h[:, 1:]])
    coef = np.linalg.solve(z.T @ z + np.diag([0, 1, 1]), z.T @ h[:, 0])
    assert e[70].residual_a == pytest.approx(x[70, 0] - np.array([1, *x[70, 1:]]) @ coef)
    w = [r.distance for r in anomaly.ewma_mahalanobis(df, ["u"], "t", ["a", "b", "c"], 10, 5).orderBy("t").collect()]
    assert w[:5] == [None] * 5 and all(v >= 0 for v in w[5:])
    flags = anomaly.quantile_flags(df.withColumn("d", F.when(F.col("t") > 0, F.col("a"))), "d")
    assert flags.where("t = 0 and d_q90").isEmpty() and 0 < flags.where("d_q90").count() <= 9


def test_tests_have_known_values():
    assert stats.student_sf2(2.0, 10) == pytest.approx(0.0733880, abs=1e-6) and stats.student_sf2(0.0, 5) == 1.0
    assert stats.student_sf2(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert stats.adf_p_value(-2.86) == pytest.approx(0.05, abs=0.002) and stats.adf_p_value(-3.43) == pytest.approx(0.01, abs=0.001)
    rng = np.random.default_rng(0)
    walk = rng.normal(size=500).cumsum()
    assert stats.adf(walk)[1] > 0.05 > stats.adf(rng.normal(size=500))[1] and math.isnan(stats.adf(np.ones(50))[1]) and math.isnan(stats.adf(walk[:10])[1])


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.005, None]
    out = {r.p: r.q for r in stats.benjamini_hochberg(frame(spark, "p double", [(x,) for x in p]), "p").collect()}
    assert [round(out[x], 6) for x in (0.005, 0.01, 0.03, 0.04)] == [0.02, 0.02, 0.04, 0.04] and out[None] is None


@pytest.mark.parametrize("parts", [None, 5])
def test_q_values_of_large_groups(spark, parts):
    """No frame reaches to the end of a group, which Spark works out anew for each row; ties, missing keys and missing p count as in a plain loop."""
    rng = np.random.default_rng(4)
    rows = [(k, i, None if i % 50 == 0 else float(x)) for k in ("a", None) for i, x in enumerate(np.round(rng.random(2000) ** 3, 3))] + [("b", 0, 0.7), ("c", 0, math.nan), ("c", 1, 0.5)]
    df = frame(spark, "k string, i long, p double", rows)
    want = {}
    for keys in ([], ["k"]):
        for k in {r[0] if keys else 0 for r in rows}:
            own = sorted((r for r in rows if r[2] is not None and (not keys or r[0] == k)), key=lambda r: (math.isnan(r[2]), r[2]))
            least = 1.0
            for i in range(len(own), 0, -1):
                raw = own[i - 1][2] * len(own) / i
                least = least if math.isnan(raw) else min(least, raw)
                want[own[i - 1][:2]] = least
        out = stats.benjamini_hochberg(df, "p", keys, parts=parts)
        assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower().replace("unboundedpreceding$(), unboundedfollowing$()", "")
        got = out.collect()
        assert len(got) == len(rows) and out.columns == ["k", "i", "p", "q"]
        assert {(r.k, r.i): r.q for r in got if r.p is not None} == want and all(r.q is None for r in got if r.p is None)
    assert stats.benjamini_hochberg(df.limit(0), "p", parts=parts).count() == 0


def test_bootstrap_is_seeded(spark):
    df = frame(spark, "x double", [(float(i % 3),) for i in range(60)])
    a = stats.day_bootstrap(df, "x", 200, seed=1)
    assert a == stats.day_bootstrap(df, "x", 200, seed=1) and a["p05"] <= a["p50"] <= a["p95"] and a["observed"] == 60


def test_convergence_and_normalisation(spark):
    z = [0.0, 2.0, 1.0, 0.1, -2.0, 4.0, math.nan]
    df = frame(spark, "root string, t long, z double", [("a", i, v) for i, v in enumerate(z)] + [("b", i, 0.0) for i in range(7)])
    out = residuals.normalise(residuals.convergence(df, "t", 1.5, 0.25, 3.0), "t")
    assert [r.position for r in out.where("root = 'a'").orderBy("t").collect()] == [0, -1, -1, 0, 1, -1, 0]
    assert [r.weight for r in out.where("t = 1").orderBy("root").collect()] == pytest.approx([-0.5, 0.5])
    p = residuals.portfolio(out.withColumn("ret", F.lit(0.01)), "t", "ret", 10.0).orderBy("t").collect()
    assert p[1].turnover == pytest.approx(1.0) and p[1].gross == 0


def test_shares_add_up(spark):
    df = frame(spark, "t long, root string, v double", [(1, "a", 1.0), (1, "b", 3.0), (2, "a", 5.0), (3, "a", 0.0)])
    sh = flow.shares(df, "t", "v")
    c = {r.t: r for r in flow.concentration(sh, "t", ["a", "b"]).collect()}
    assert c[1].hhi == pytest.approx(0.625) and c[1].gini == pytest.approx(0.25) and c[1].dominant_root == "b" and c[2].effective == pytest.approx(1) and c[3].hhi is None


def test_streaming_time_bars(spark, tmp_path):
    from fluxbar import streaming

    t = sources.trades(spark, "/root/testdata/sf0.001").withColumn("ts", F.col("ts").cast("timestamp"))
    t.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    q = streaming.time_bars(stream).writeStream.format("memory").queryName("live_bars").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    live, all_ = spark.table("live_bars"), bars.time_bars(t)
    assert live.count() > 0 and live.exceptAll(all_).isEmpty()


def test_sql_command(spark):
    args = cli.parser().parse_args(["query", "SELECT count(*) AS n FROM nation", "--tables", "/root/testdata/sf0.001"])
    assert cli.execute(spark, args).first().n == 25


def test_filters_reach_the_scan(spark):
    plan = sources.between(sources.table(spark, "/root/testdata/sf0.001", "orders"), "o_orderkey", 1, 5).select("o_orderkey")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey,1)" in text and "ReadSchema: struct<o_orderkey:bigint>" in text


def test_pair_distance_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.normal(0, 0.01, (40, 2)), axis=0)
    rows = [("p", i, float(a), None if i == 30 else float(b), 0.0, 0.0) for i, (a, b) in enumerate(x)]
    frames = spark.createDataFrame(rows, "pair string, ts int, log_price_a double, log_price_b double, log_return_a double, log_return_b double")
    got = {r.ts: r for r in pairs.pair_distance(frames, 10, 1e-4).collect()}
    for i in range(40):
        if i < 9 or i >= 30:  # the missing price is within the last ten rows to the end
            assert got[i].distance is None and got[i].pull_a is None
            continue
        w = x[i - 9 : i + 1]
        d, inverse = x[i] - w.mean(0), np.linalg.inv(np.cov(w, rowvar=False) + 1e-4 * np.eye(2))
        assert math.isclose(got[i].distance, math.sqrt(d @ inverse @ d), rel_tol=1e-6)
        assert np.allclose([got[i].pull_a, got[i].pull_b], inverse @ d, rtol=1e-6, atol=1e-9)
    done = pairs.run_distance(frames, 10, pairs.Rules(1.5, 0.5), 1.0, 1e-4).collect()
    assert len(done) == 40 and all(abs(r.target_a) + abs(r.target_b) <= 1 + 1e-12 for r in done)
    assert pairs.run_distance(frames.limit(0), 10, pairs.Rules(1.5, 0.5), 1.0).count() == 0


def test_distance_states_follow_the_rules():
    nan = math.nan
    d = [3, 1, 0.2, 3, nan, 3, 0.2, 3]
    states, one, two = pairs.distance_fold(d, [1.0] * 8, [-3.0] * 8, pairs.Rules(2, 0.5))
    assert states == [1, 1, 0, 1, 0, 1, 0, 1] and one[0] == -0.25 and two[0] == 0.75 and one[4] == 0.0
    held = pairs.distance_fold(d, [1.0] * 8, [-3.0] * 8, pairs.Rules(2, 0.5, min_hold=3, cooldown=2))[0]
    assert held == [1, 1, 1, 1, 0, 1, 1, 1]  # a row without a distance starts no waiting time
    assert pairs.distance_fold([3, 0.2, 3, 3, 3], [1.0] * 5, [-3.0] * 5, pairs.Rules(2, 0.5, cooldown=2))[0] == [1, 0, 0, 0, 1]
    every = pairs.distance_fold(d, [1.0] * 8, [-3.0] * 8, pairs.Rules(2, 0.5, rebalance=2))[0]
    assert every == [1, 1, 0, 0, 0, 0, 0, 0]


def test_carry_takes_the_next_to_expire(spark):
    rows = [("A", 1, "AH6", 100.0), ("A", 1, "AM6", 110.0), ("A", 1, "AU6", 130.0), ("A", 2, "AM6", 120.0), ("A", 2, "AU6", 0.0), ("A", 3, "AU6", 90.0), ("B", 1, "BH6", 5.0)]
    daily = spark.createDataFrame(rows, "root string, session int, symbol string, close double")
    plan = spark.createDataFrame([("A", 1, "AH6"), ("A", 2, "AM6"), ("A", 3, "AU6"), ("A", 4, "AU6"), ("B", 1, "BH6"), ("B", 2, None)], "root string, session int, active string")
    got = bars.carry(daily, plan).collect()
    assert [(r.root, r.session, r.second) for r in got] == [("A", 1, 110.0)] and math.isclose(got[0].carry, math.log(100 / 110))
    assert bars.carry(daily.limit(0), plan).count() == 0


def test_robust_distance_isn_t_moved_by_outliers(spark):
    assert math.isclose(anomaly.chi2_quantile(0.5, 2), 2 * math.log(2), rel_tol=1e-9) and math.isclose(anomaly.chi2_quantile(0.975, 1), 5.023886, rel_tol=1e-6)
    rng = np.random.default_rng(5)
    clean = rng.multivariate_normal([1, -2], [[1, 0.6], [0.6, 2]], 380)
    x = np.vstack([clean, rng.normal([14, 14], 0.2, (20, 2))])
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(400, None, 1.0), (401, math.nan, 1.0)]
    df = spark.createDataFrame(rows, "i int, a double, b double")
    got = {r.i: r.distance for r in anomaly.robust_distance(df, ["a", "b"], tries=50, finalists=2).collect()}
    assert got[400] is None and got[401] is None
    inverse = np.linalg.inv(np.cov(clean, rowvar=False))
    plain = np.sqrt(np.einsum("ij,jk,ik->i", clean - clean.mean(0), inverse, clean - clean.mean(0)))
    assert min(got[i] for i in range(380, 400)) > 8 > max(got[i] for i in range(380))
    assert np.corrcoef(plain, [got[i] for i in range(380)])[0, 1] > 0.99
    assert {r.distance for r in anomaly.robust_distance(df.limit(5), ["a", "b"]).collect()} == {None}


def test_hourly_vectors_take_all_roots(spark):
    from fluxbar.plans import market

    sf = "/root/testdata/sf0.001"
    wide, roots = market._wide(spark, sf)
    assert roots == market.roots_of(spark, sf) and len(roots) > 3 and set(roots) < set(wide.columns)
    assert wide.count() == sources.hourly(spark, sf).select("hour").distinct().count()


@pytest.mark.parametrize("name", ["o024_semi_join_days", "o046_asof_backward", "o048_asof_forward"])
def test_whole_table_joins_give_the_rows_of_their_sql(spark, name):
    import duckdb

    from fluxbar import catalog

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    key = lambda r: tuple(-1 if x is None else round(x, 6) for x in r)
    got = sorted(key(r) for r in catalog.queries()[name](spark, sf).collect())
    assert got == sorted(key(r) for r in db.execute(catalog.oracle_sql()[name]).fetchall()) and len(got) > 0
    if name != "o024_semi_join_days":
        assert len(got) == spark.read.parquet(f"{sf}/events.parquet").count()
