"""Flags of one pass against the operators that take a window for each step, and pooled rank correlations against ranks in one sort."""

import random

import pytest
from pyspark.sql import functions as F

from candela.operators import evaluation as ev
from candela.operators import indicators as ind
from candela.operators import normalise as norm
from candela.plans import fixtures as fx
from tests.test_one_pass import SCHEMA, rows, series
from tests.test_walks import unread


def test_flags_of_one_pass_are_those_of_windows(spark):
    for odd in (False, True):
        bars = spark.createDataFrame(series(odd), SCHEMA).persist()
        frame = ind.recursions(ind.rsi(ind.vol_ratio(ind.bollinger(ind.sma(norm.change_pct(bars))))))
        want = ev.condition_flags(frame).select(*bars.columns, "kdj_j", "rsi_6", *ev.FLAGS)
        got = ev.flagged_bars(bars)
        assert rows(got.drop("t")) == rows(want)
        grid = ev.asof_grid(want, 40, 3, 20)
        assert rows(ev.flagged_bars(bars, ev.on_grid(40, 3, 20))) == rows(grid) and grid.count() > 20


def test_graded_bars_exchange_nothing_but_the_ticks(spark, sf, tmp_path):
    bars = ev.horizon_returns(ev.entry_fill(fx.daily_bars(spark, unread(sf, tmp_path)), 1.5))
    assert ev.flagged_bars(bars, ev.on_grid())._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_pooled_correlations_equal_ranks_in_one_sort(spark):
    rng = random.Random(8)
    data = [(s, x, round(rng.gauss(0.1 * x, 2), k)) for s, k in (("a", 2), ("b", 0), ("c", 6)) for x in (rng.choice([1.0, 2.0, 2.5]) if s == "b" else round(rng.gauss(0, 3), 4) for _ in range(3000))]
    data += [("few", 1.0, 2.0), ("few", 2.0, 1.0)] + [("flat", 1.0, float(k)) for k in range(9)]
    df = spark.createDataFrame(data, "score string, x double, y double").repartition(7)
    got = {r.score: (r.n, r.ic) for r in ev.pooled_spearman(df).collect()}
    want = ev.spearman(ev.pooled_rank(ev.pooled_rank(df, "score", "x", "_rx"), "score", "y", "_ry"), 5, "score")
    want = {r.score: (r.n, r.ic) for r in want.collect()}
    assert got.keys() == want.keys() and got["few"] == want["few"] == (2, None) and got["flat"] == want["flat"] == (9, None)
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in "abc")


def test_pooled_correlations_move_rows_once(spark):
    """Values of x are as many as rows here: they are dealt in ranges, without a join or a second exchange of them."""
    df = spark.range(100_000).select(F.lit("a").alias("score"), (F.col("id") * 7919 % 100_003).cast("double").alias("x"), (F.col("id") % 50).cast("double").alias("y"))
    plan = ev.pooled_spearman(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning(") == 1 and "SortMergeJoin" not in plan and "hashpartitioning(score#" in plan
    import re

    assert not re.search(r"hashpartitioning\(score#\d+, x#", plan)
