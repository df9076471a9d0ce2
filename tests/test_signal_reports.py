"""Reports over as-of points: signals, correlations, in-sample rates, the sweep against no stop."""

import pytest
from pyspark.sql import functions as F

from candela.operators import evaluation

COLUMNS = "symbol long, date date, signal string, score double, fillable boolean, ret_5 double, ret_10 double, ret_20 double, excess_10 double, stop_loss double, path_ret double, path_hit boolean"


@pytest.fixture
def points(spark):
    rows = [
        (1, None, "BUY", 60.0, True, 1.0, 2.0, 3.0, 1.0, 9.0, -2.0, True),
        (2, None, "BUY", 70.0, True, 1.0, 4.0, 3.0, 2.0, 9.0, 3.0, False),
        (3, None, "HOLD", 40.0, True, -1.0, -3.0, None, None, 9.0, None, None),
        (4, None, "HOLD", 50.0, True, -1.0, -1.0, None, -1.0, None, None, None),
        (5, None, "HOLD", 55.0, False, None, None, None, None, 9.0, None, None),
    ]
    return spark.createDataFrame(rows, COLUMNS)


def test_baseline_counts_plans(points):
    row = evaluation.baseline(points).first()
    assert (row.points, row.unfillable_pct, row.completed, row.censored, row.not_evaluated) == (5, 20.0, 2, 1, 1)
    assert (row.excess_10_n, row.ret_20_n) == (3, 2)
    assert "completed" not in evaluation.baseline(points.drop("path_ret")).columns


def test_signals_leave_out_what_cannot_be_filled(points):
    got = {r.signal: r for r in evaluation.by_signal(points).collect()}
    assert (got["BUY"].share, got["HOLD"].share) == (50.0, 50.0)
    assert (got["BUY"].stop_hit, got["HOLD"].stop_hit) == (50.0, None)
    assert (got["BUY"].lift_hit, got["BUY"].lift_mean) == (50.0, 2.5)
    assert (got["HOLD"].path_ret_n, got["HOLD"].excess_10_mean) == (0, -1.0)
    assert evaluation.by_signal(points.limit(0)).count() == 0


def test_doubtful_signals_and_scores(spark, points):
    signals = evaluation.by_signal(points)
    ics = spark.createDataFrame([("a", 1.9), ("b", -2.5), ("c", None)], "score string, t double")
    got = {(r.kind, r["name"]) for r in evaluation.doubtful(signals, ics).collect()}
    assert ("score", "a") in got and not {("score", "b"), ("score", "c")} & got
    # Two of two and none of two hold the base rate of one half in their intervals.
    assert {("signal", "BUY"), ("signal", "HOLD")} <= got


def test_ic_and_quintiles_with_excess(spark):
    n = 60
    rows = spark.range(n).select("id", F.col("id").alias("symbol"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 6).cast("int")).alias("date"), F.col("id").cast("double").alias("score"), (F.col("id") * 2.0).alias("ret_10"), (-F.col("id").cast("double")).alias("excess_10"))
    row = evaluation.rank_ic(rows, ["score"], excess="excess_10").first()
    assert (row.n, row.days) == (n, 6)
    assert row.pooled_ic == pytest.approx(1.0) and row.pooled_excess_ic == pytest.approx(-1.0) and row.mean_ic == pytest.approx(1.0)
    got = {r.quintile: r.mean_excess for r in evaluation.score_quintiles(rows, "score", excess="excess_10").collect()}
    assert sorted(got) == [1, 2, 3, 4, 5] and got[1] > got[5]


@pytest.mark.parametrize("n", [29, 30])
def test_insample_needs_thirty(spark, n):
    rows = spark.range(n).select((F.col("id") * 3.0).alias("win_10"), F.col("id").cast("double").alias("ret_10"))
    got = evaluation.insample_validity(rows).collect()
    assert (len(got) > 0) == (n >= 30)
    assert all(r.pooled_ic == pytest.approx(1.0) and r.pred_mean is not None for r in got)


def test_sweep_against_no_stop(spark):
    swept = spark.createDataFrame([("atr_1", 10, -1.0, True), ("atr_1", 10, 3.0, False), ("atr_1", 10, None, None), ("atr_1", 20, 1.0, False)], "variant string, horizon int, ret double, hit boolean")
    entries = spark.createDataFrame([(10.0, 0.5, 2.0, 4.0), (20.0, None, 1.0, -2.0)], "close double, atr double, ret_10 double, ret_20 double")
    got = {(r.variant, r.horizon): r for r in evaluation.sweep_report(swept, entries).collect()}
    assert len(got) == 4
    a, none = got["atr_1", 10], got["none", 10]
    assert (a.censored, a.stop_hit, a.vs_none, a.atr_pct) == (1, 50.0, -0.5, 5.0)
    assert (none.censored, none.stop_hit, none.vs_none, none.ret_n) == (None, 0.0, 0.0, 2)
