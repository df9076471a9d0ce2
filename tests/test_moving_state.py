"""State at points from blocks of a series, against the operators on copied histories, odd values included."""

import random

import pytest
from pyspark.sql import functions as F

from candela.functions.windows import KEY
from candela.operators import causal, evaluation
from candela.operators import levels as lev
from candela.operators import profile as prof
from candela.operators import structure as st
from candela.plans import fixtures as fx


def rows(df, columns):
    return sorted(map(repr, df.select(columns).collect()))


@pytest.fixture(scope="module")
def bars_of_supplier(spark, sf):
    """Bars with some prices and volumes missing."""
    odd = lambda c, n: F.when(F.hash("date", F.lit(n)) % n != 0, F.col(c)).alias(c)
    return fx.derive(spark, sf, fx.DAILY).where("symbol <= 2").select(KEY, "date", odd("open", 17), odd("high", 13), odd("low", 23), odd("close", 19), odd("volume", 7), "amount").persist()


def test_divergence_at_points(spark):
    """Missing and NaN values, plateaus, points with fewer bars than the look-back, blocks shorter than it."""
    rng, data = random.Random(5), []
    for s in range(6):
        c = 100.0
        for i in range(300):
            c = max(1.0, c + rng.choice([-1.0, 0.0, 0.0, 1.0]))
            dif = rng.choice([None, float("nan")]) if rng.random() < 0.03 else round(rng.gauss(0, 1), 1)
            data.append((s, i, None if rng.random() < 0.03 else float("nan") if s == 5 and rng.random() < 0.02 else c, dif, None if rng.random() < 0.2 else 0.5))
    df = spark.createDataFrame(data, "symbol long, date int, close double, dif double, atr double")
    points = causal.Points(warmup=25, step=7)
    columns = [KEY, "bullish_divergence", "bearish_divergence"]
    want = rows(st.macd_divergence(evaluation.asof_slices(df, st.PIVOT_ROWS, points.warmup, points.step, points.longest)), columns)
    marked = points.marked(df).persist()
    assert "True" in str(want) and rows(st.moving_divergence(marked), columns) == rows(st.moving_divergence(marked, block=25), columns) == want


def test_profile_state_at_points(spark, bars_of_supplier):
    marked = causal._profiled(bars_of_supplier, causal.Points(warmup=150, step=70)).persist()
    got, want = prof.moving_profile_state(marked), prof.profile_state(prof.moving_profile(marked))
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and got.count() > 5 and rows(got, columns) == rows(want, columns)
    assert prof.moving_profile_state(marked.where("t < 0")).count() == 0


def test_clusters_of_a_side_are_walked_in_order(spark):
    """A side of many candidates takes no array: one row each, joined while near the mean and the first price."""
    nan = float("nan")
    prices = {(1, "support"): [100.0, 101.0, 102.4, 104.9, 106.0], (1, "resistance"): [120.0, nan, nan], (2, "support"): [50.0]}
    data = [(s, side, p, f"x{i}", 5, "A", 110.0) for (s, side), ps in prices.items() for i, p in enumerate(ps)]
    out = lev.cluster_levels(spark.createDataFrame(data, "symbol long, side string, price double, source string, weight int, category string, close double").repartition(3))
    assert "aggregate(" not in out._jdf.queryExecution().toString()
    got = {}
    for r in out.orderBy("price", "source").collect():
        got.setdefault((r.symbol, r.side), []).append(r.cluster)
    assert got == {(1, "support"): [0, 0, 1, 2, 2], (1, "resistance"): [0, 1, 1], (2, "support"): [0]}


def test_week_sums_are_differences(spark, bars_of_supplier):
    """No window of weeks is summed anew for each week: the plan has running frames alone, besides the list of 19 weeks."""
    plan = causal.weekly_part(bars_of_supplier, causal.Points(warmup=150, step=70))._jdf.queryExecution().optimizedPlan().toString()
    assert "-19, -1" in plan and "-249, -1" not in plan
