"""Row positions, panel shapes, selections, principal axes and config runs against plain Python."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxbar import cli, sources
from fluxbar.functions import series
from fluxbar.operators import panels, studies, windows
from fluxbar.plans import experiments

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "ts timestamp_ntz, seq long, x double"


def rows_of(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    at = rng.integers(0, 50, n)
    return spark.createDataFrame([(DAY + dt.timedelta(minutes=int(a)), i, float(a)) for i, a in enumerate(at)], SCHEMA)


@pytest.mark.parametrize("n", [0, 1, 2, 300])
def test_global_index_is_the_sorted_position(spark, n):
    df = rows_of(spark, n)
    want = {r.seq: i for i, r in enumerate(sorted(df.collect(), key=lambda r: (r.ts, r.seq)))}
    got = panels.global_index(df, ["ts", "seq"], parts=8).collect()
    assert {r.seq: r.row_index for r in got} == want and len(got) == n


def test_global_index_with_one_value_and_with_missing_ones(spark):
    df = spark.createDataFrame([(None, 3, 1.0), (DAY, 1, 1.0), (DAY, 2, 1.0), (None, 4, 1.0)], SCHEMA)
    assert {r.seq: r.row_index for r in panels.global_index(df, ["ts", "seq"]).collect()} == {3: 0, 4: 1, 1: 2, 2: 3}


def test_linspace_rows(spark):
    for n, most in ((300, 7), (300, 1), (5, 9), (0, 3)):
        got = sorted(r.row_index for r in panels.linspace_rows(rows_of(spark, n), ["ts", "seq"], most).collect())
        want = list(range(n)) if n <= most else sorted({int(x) for x in np.round(np.linspace(0, n - 1, most))})
        assert got == want


def test_splits(spark):
    parts = {r.row_index: r.part for r in panels.embargo_split(rows_of(spark, 10), ["ts", "seq"], 0.6, 2).collect()}
    assert [parts[i] for i in range(10)] == ["train"] * 6 + ["embargo"] * 2 + ["test"] * 2
    days = spark.createDataFrame([(DAY + dt.timedelta(i // 2),) for i in range(10)], "day timestamp_ntz")
    assert windows.chronological_split(days, "day", 0.5).where("train").count() == 4


def test_cells_first_active_and_changes(spark):
    panel = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "a", None)], "t int, root string, v double")
    got = {(r.t, r.root): r.v for r in panels.cells(panel, "t", ["a", "b"], ["v"]).collect()}
    assert got == {(1, "a"): 1.0, (1, "b"): 0.0, (2, "a"): 0.0, (2, "b"): 2.0, (3, "a"): 0.0, (3, "b"): 0.0}
    assert [r.t for r in panels.first_active(panel, ["root"], "t", F.col("v") > 1).collect()] == [2]
    one = panel.withColumn("k", F.lit(1)).select("t", panels.changed("root", series("k", order="t")).alias("c"))
    assert [r.c for r in one.orderBy("t").collect()] == [False, True, True]


def test_correlations_of_constant_columns_are_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 7.0, 5.0)], "x double, y double, c double")
    got = {r.column: r.corr for r in panels.correlations_with(df, "x", ["y", "c"]).collect()}
    assert got["y"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 7])[0, 1]) and got["c"] is None


def test_reasons_come_in_order_and_missing_values_fail(spark):
    df = spark.createDataFrame([(1, 0.5), (9, None), (9, 0.1), (9, 0.9)], "n int, c double")
    got = df.select(studies.first_reason([("short", F.col("n") > 5), ("low", F.col("c") > 0.3)]).alias("r")).collect()
    assert [r.r for r in got] == ["short", "low", "low", "selected"]
    assert [r.passed for r in studies.decide(df, [("a", F.col("n") > 5), ("b", F.col("c") > 0.3)]).collect()] == [False, False, False, True]


def test_threshold_study_compares_with_the_complement(spark):
    df = spark.createDataFrame([("a", True, 0.03), ("a", True, 0.01), ("a", False, 0.01), ("a", None, -0.01), ("b", False, 0.1)], "root string, flag boolean, y double")
    r = studies.threshold_study(df, ["root"], "flag", "y").collect()
    assert len(r) == 1 and r[0].n == 2 and r[0].mean_bps == pytest.approx(200) and r[0].base_bps == pytest.approx(0) and r[0].excess_bps == pytest.approx(200)


def test_principal_axes_equal_those_of_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(99, None, 1.0, 1.0, 1.0)], "i int, a double, b double, c double, d double")
    got, axes, share = studies.principal_axes(df, ["a", "b", "c", "d"], 3)
    z = (x - x.mean(0)) / x.std(0)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    assert share == pytest.approx(s[:3] ** 2 / (s**2).sum())
    assert np.abs((axes * vt[:3]).sum(1)) == pytest.approx(np.ones(3))
    rows = {r.i: r for r in got.collect()}
    assert rows[99].pc1 is None
    assert [rows[i].pc2 for i in range(60)] == pytest.approx(list(z @ axes[1]))
    with pytest.raises(ValueError):
        studies.principal_axes(df.where("i < 0"), ["a"], 1)


def test_clusters_part_what_is_apart(spark):
    df = spark.createDataFrame([(float(c * 100 + i), float(i)) for c in range(3) for i in range(5)] + [(None, 1.0)], "x double, y double")
    got = studies.clusters(df, ["x"], 3, seed=1).collect()
    assert len(got) == 15 and len({(int(r.x // 100), r.cluster) for r in got}) == 3


def test_experiment_writes_what_it_returns(spark, tmp_path):
    config = {
        "data": {"kind": "synthetic", "symbol": "A", "start": "2024-01-01", "end": "2024-06-28", "seed": 3},
        "strategy": {"fast": 5, "slow": 20}, "backtest": {"cost_bps": 2.0}, "outputs": {"folder": str(tmp_path / "out")},
    }
    (tmp_path / "c.json").write_text(json.dumps(config))
    m = experiments.run_experiment(spark, experiments.read_config(str(tmp_path / "c.json"))).collect()
    equity = spark.read.parquet(str(tmp_path / "out/equity"))
    assert len(m) == 1 and m[0].n == equity.count()
    assert m[0].total_return == pytest.approx(equity.orderBy(F.desc("timestamp")).first().equity - 1)
    assert cli.parser().parse_args(["run-experiment", "x.json"]).config == "x.json"


@pytest.mark.parametrize("bad", [{"extra": 1}, {"strategy": {"fast": 1}}, {"strategy": {"fast": 1, "slow": 2}}, {"strategy": {"fast": 1, "slow": 2, "x": 1}}])
def test_configs_are_checked(bad):
    with pytest.raises(ValueError):
        experiments.checked(bad)


def test_filters_pass_over_columns_that_are_not_there(spark):
    df = spark.createDataFrame([("a",), ("b",)], "k string")
    assert sources.matching(df, {"k": "a", "gone": 1}).count() == 1
