"""Trials of rules against loops, and bars looked up range by range."""

import bisect
import math
import random

import pytest
from pyspark.sql import functions as F

from fluxbar import cli
from fluxbar.operators import bars, trials
from fluxbar.plans import experiments


@pytest.mark.parametrize("parts", [1, 7, 512])
def test_bars_found_by_ranges_are_the_first_boundaries(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice("ab"), rng.randrange(60), i, rng.random() * 10) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, t long, seq long, notional double")
    for keys in ([], ["k"]):
        ends = bars.value_boundaries(df, 40, ["t", "seq"], keys=keys)
        got = bars.assign_bars(df, ends, ["t", "seq"], keys, parts).collect()
        assert len(got) == len(rows)
        last = {}
        for e in ends.collect():
            last.setdefault(e.k if keys else None, []).append(((e.last_t, e.last_seq), e.bar_id))
        for r in got:
            own = sorted(last[r.k if keys else None])
            assert r.bar_id == own[bisect.bisect_left([at for at, _ in own], (r.t, r.seq))][1]


def test_trades_after_the_last_boundary_have_no_bar(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "t long, notional double")
    ends = spark.createDataFrame([(0, 3), (1, 6)], "bar_id long, last_t long")
    got = bars.assign_bars(df, ends, ["t"]).orderBy("t").collect()
    assert [r.bar_id for r in got] == [0] * 4 + [1] * 3 + [None] * 3
    none = bars.assign_bars(df, ends.where("false"), ["t"]).collect()
    assert [r.bar_id for r in none] == [None] * 10
    assert bars.assign_bars(df.where("false"), ends, ["t"]).count() == 0


def test_bar_details_keep_the_last_price(spark):
    rows = [(0, "a", 1, 5.0, 10.0, "small"), (0, "a", 2, 6.0, 30.0, "large"), (1, "b", 3, 9.0, 4.0, "small"), (2, "a", 4, 7.0, 1.0, "other")]
    df = spark.createDataFrame(rows, "bar_id long, root string, t long, price double, notional double, bucket string")
    got = {(r.bar_id, r.root): (r.last_price, r.small, r.large) for r in bars.bar_details(df, ["a", "b"], ["t"], ["small", "large"]).collect()}
    assert got == {(0, "a"): (6.0, 0.25, 0.75), (0, "b"): (None, None, None), (1, "a"): (6.0, None, None), (1, "b"): (9.0, 1.0, 0.0), (2, "a"): (7.0, 0.0, 0.0), (2, "b"): (9.0, None, None)}


def test_days_are_split_series_by_series(spark):
    df = spark.createDataFrame([("a", d) for d in (1, 2, 3, 4, 4)] + [("b", 9), ("c", 1), ("c", 2), ("c", None)], "k string, d int")
    got = trials.split_days(df, ["k"], "d", 0.5).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("d", "train"))).alias("x")).collect()
    assert {r.k: [tuple(v) for v in r.x] for r in got} == {"a": [(1, True), (2, True), (3, False), (4, False), (4, False)], "b": [(9, False)], "c": [(1, True), (2, False)]}


def test_summary_of_known_returns(spark):
    df = spark.createDataFrame([("a", 1, 0.02, 0.01), ("a", 2, -0.03, None), ("a", 3, None, 0.0), ("b", 1, 1.0, 0.0)], "k string, t int, gross double, cost double")
    a, b = trials.summary(df, ["k"], ["t"], 4).orderBy("k").collect()
    net = [0.01, -0.03, 0.0]
    mean = sum(net) / 3
    sd = math.sqrt(sum((x - mean) ** 2 for x in net) / 2)
    assert (a.n, a.t, a.sharpe, a.hit_rate, a.drawdown) == (3, pytest.approx(mean / sd * math.sqrt(3)), pytest.approx(mean / sd * 2), pytest.approx(1 / 3), pytest.approx(-0.03))
    assert (b.t, b.sharpe, b.drawdown) == (0, 0, 0)


def test_event_drift_follows_the_earlier_slope(spark):
    rows = [("up", t, (-1) ** t * 0.01 * t, (-1) ** t * 0.02 * t) for t in range(1, 11)] + [("down", t, (-1) ** t * 0.01 * t, -((-1) ** t) * 0.02 * t) for t in range(1, 11)]
    rows += [("few", t, 0.01, 0.01) for t in (1, 9, 10)] + [("up", 11, None, 0.1)]
    got = trials.event_drift(spark.createDataFrame(rows, "root string, t int, seen double, later double"), "t", 0.6, 2.0).collect()
    assert sorted({r.t for r in got}) == [7, 8, 9, 10]
    for r in got:
        side = {"up": 1, "down": -1, "few": 0}[r.root]
        assert (r.position, r.gross) == (side * math.copysign(1, r.seen), pytest.approx(side * abs(r.later) * (1 if r.root == "up" else -1) if r.root != "few" else 0))
        assert r.cost == pytest.approx(abs(side) * 2e-4)


def test_first_weights_are_no_turnover_and_earn_the_next_return(spark):
    rows = [("a", 1, 0.5, 0.1), ("b", 1, -0.5, 0.1), ("a", 2, 1.0, 0.2), ("b", 2, 0.0, None), ("a", 3, 0.0, 0.4), ("b", 3, 0.0, 0.3)]
    got = trials.held_ahead(spark.createDataFrame(rows, "root string, t int, weight double, r double"), [], "t", "r", 10.0).orderBy("t").collect()
    assert [(r.turnover, r.gross) for r in got] == [(0, pytest.approx(0.1)), (1.0, pytest.approx(0.4)), (1.0, 0)]
    assert got[1].cost == pytest.approx(1e-3)


def test_scores_are_cut_and_rest_under_the_deadband(spark):
    rows = [(r, t, p) for t in range(12) for r, p in (("a", (-1.0) ** t * (10 if t == 11 else 1)), ("b", 0.0))]
    df = spark.createDataFrame(rows, "root string, t int, p double")
    got = {(r.root, r.t): r.score for r in trials.reversal_scores(df, "t", "p", ["t"], 6, 3, 1.5, 0.2).collect()}
    assert got[("a", 1)] is None and got[("a", 11)] == 1.0 and -1 <= got[("a", 10)] < 0
    flat = trials.reversal_scores(df.withColumn("p", F.lit(1.0)), "t", "p", ["t"], 6, 3, 1.5).collect()
    assert {r.score for r in flat} == {None}


def test_commands_write_tables(spark, tmp_path):
    rows = [("ESH6", "2026-01-05 15:00:00", 100.0, 9.0), ("ESH6", "2026-01-05 15:00:00", 99.0, 1.0), ("ESM6", "2026-01-05 15:00:00", 110.0, 2.0), ("ESH6", "2026-01-06 15:00:00", 101.0, 3.0), ("ESM6", "2026-01-06 15:00:00", 112.0, 8.0)]
    rows += [("ESM6", "2026-01-07 15:00:00", 113.0, 8.0), ("ESH6-ESM6", "2026-01-07 15:00:00", 1.0, 99.0)]
    df = spark.createDataFrame(rows, "symbol string, ts string, close double, volume double").withColumn("ts", F.to_timestamp_ntz("ts"))
    df.write.parquet(str(tmp_path / "raw" / "ES.parquet"))
    args = cli.parser().parse_args(["prepare-futures", str(tmp_path / "raw"), str(tmp_path / "out"), "--roots", "ES, NQ"])
    (r,) = cli.prepared(spark, args).collect()
    assert (r.root, r["rows"], r.contracts, r.rolls) == ("ES", 3, 2, 1)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("ts").collect()
    assert [x.active for x in got] == ["ESH6", "ESM6", "ESM6"] and got[1].cont_logret == pytest.approx(math.log(112 / 110)) and got[0].cont_close == pytest.approx(100)

    closes = spark.createDataFrame([(" a", 1, 5.0), ("A", 2, 2.0), ("B", 1, 3.0), ("C", 1, -1.0), ("D", 1, 9.0)], "symbol string, ts int, close double")
    shares = spark.createDataFrame([("A", 1, 10.0), ("B", 1, 10.0), ("C", 1, 10.0), ("E", 1, 1.0)], "symbol string, ts int, shares double")
    closes.write.parquet(str(tmp_path / "closes"))
    shares.write.parquet(str(tmp_path / "shares"))
    args = cli.parser().parse_args(["build-universe", *[str(tmp_path / f) for f in ("closes", "shares", "top")], "--top", "2"])
    assert [(r["rank"], r.symbol, float(r.market_cap)) for r in cli.prepared(spark, args).orderBy("rank").collect()] == [("1", "B", 30.0), ("2", "A", 20.0)]

    spark.createDataFrame([("x", 1.5), ("y", None)], "name string, score double").write.json(str(tmp_path / "runs" / "a" / "metrics-json"))
    text = experiments.report(spark, str(tmp_path / "runs"), "score")
    assert text.splitlines()[0].startswith("|name|score") and "|x|1.5|" in text
