"""Indicators, marks and profiles of many series in one pass, against the operators that take a window for each step."""

import random

from pyspark.sql import functions as F

from candela.functions.windows import KEY
from candela.operators import causal
from candela.operators import indicators as ind
from candela.operators import normalise as norm
from candela.operators import profile as prof
from candela.operators import structure as st
from candela.plans import catalog_structure as cs

SCHEMA = "symbol long, date int, open double, high double, low double, close double, volume double, amount double"


def rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def series(odd: bool = False):
    """Forty series of several lengths and prices; odd: with missing values, NaN, infinity, tiny and huge prices."""
    rng, data = random.Random(4), []
    for s in range(40):
        c = (100.0, 3.0, 5000.0, 20000.0)[s % 4] * (1e16 if odd and s == 9 else 1e-9 if odd and s == 10 else 1)
        for i in range((1, 4, 14, 19, 29, 60, 130, 260)[s % 8]):
            c = round(max(c * 0.5, c * (1 + rng.gauss(0, 0.02))), 2 if s != 10 or not odd else 15)
            row = [c * (1 + rng.random() * 0.01), c * (1 + rng.random() * 0.03), c * (1 - rng.random() * 0.03), c, float(rng.randrange(0, 50))]
            if odd and s % 5 == 1:
                row = [None if rng.random() < 0.04 else x for x in row]
            if odd and s % 5 == 2 and rng.random() < 0.01:
                row[3] = rng.choice((float("nan"), float("inf")))
            data.append((s, i, *row, c * 10))
    rng.shuffle(data)
    return data


def test_indicators_of_one_pass_are_those_of_windows(spark):
    for odd in (False, True):
        bars = spark.createDataFrame(series(odd), SCHEMA).persist()
        whole = st.volume_features(norm.change_pct(ind.vol_ratio(ind.bollinger(ind.sma(ind.atr(ind.recursions(bars)))))))
        got = st.day_features(bars).drop("_i", "_n")
        assert rows(got) == rows(whole)
        assert st.day_features(bars, 1).count() == 40


def test_newest_state_takes_no_moving_window(spark):
    bars = spark.createDataFrame(series(), SCHEMA)
    for state in (cs.day_state(bars), cs.week_state(bars.selectExpr("*", "date_add(date'2020-01-01', date) as _d").drop("date").withColumnRenamed("_d", "date"))):
        plan = state._jdf.queryExecution().optimizedPlan().toString()
        assert "_held" not in plan and "lag(ma_" not in plan


def test_marks_of_one_pass_are_swings_gaps_and_waves(spark):
    for odd in (False, True):
        data = [r for r in series(odd) if not (odd and r[0] % 5 == 1 and r[0] % 2)]
        bars = spark.createDataFrame(data, SCHEMA).persist()
        marks = st.level_marks(bars).persist()
        assert rows(st.marked_swings(marks)) == rows(st.swing_points(bars))
        assert rows(st.marked_gaps(marks)) == rows(st.price_gaps(bars))
        assert rows(st.marked_waves(marks)) == rows(st.fibonacci_wave(bars))


def test_newest_profile_of_one_pass(spark):
    bars = spark.createDataFrame(series(), SCHEMA).persist()
    got, want = ({r[KEY]: r.asDict(True) for r in x.collect()} for x in (prof.newest_profile_state(bars), prof.profile_state(prof.volume_profile(bars))))
    assert got.keys() == want.keys()
    for s, row in want.items():
        peaks, same = row.pop("peaks"), got[s].pop("peaks")
        assert got[s] == row
        assert [p["bin"] for p in peaks] == [p["bin"] for p in same]


def test_swings_of_points_need_no_join(spark):
    """Those of each point are the swings of its history."""
    bars = spark.createDataFrame(series(), SCHEMA).persist()
    points = causal.Points(warmup=50, step=7)
    swings = causal.swing_part(bars, points)
    assert "Join" not in swings._jdf.queryExecution().optimizedPlan().toString()
    seen = points.marked(bars)
    at = seen.where("point is not null").select("point", F.col(KEY).alias("_s"), F.col("t").alias("_t"))
    cut = seen.drop("point").join(at, (F.col(KEY) == F.col("_s")) & (F.col("t") <= F.col("_t"))).select(F.col("point").alias(KEY), "date", "high", "low")
    assert swings.count() > 1000 and rows(swings) == rows(st.swing_points(cut))
