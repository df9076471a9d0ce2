"""Parts shared by levels and state rows, moving ranks and coarser bars, against plain computations."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from candela.functions.ranks import moving_ranks
from candela.operators import indicators, normalise, profile, structure
from candela.plans.catalog_structure import day_frame
from candela.sources.bars import latest

NAN = float("nan")


def series(lengths, seed=1):
    rng, rows = random.Random(seed), []
    for symbol, n in enumerate(lengths):
        close = 100.0
        for i in range(n):
            close = round(close * (1 + rng.uniform(-0.05, 0.05)), 2)
            spread = round(rng.uniform(0.1, 2.0), 2)
            rows.append((symbol, dt.date(2020, 1, 1) + dt.timedelta(i), close, close + spread, close - spread, close, float(rng.randrange(1, 900))))
    return rows


BARS = "symbol int, date date, open double, high double, low double, close double, volume double"


@pytest.mark.parametrize("window,block", [(5, 7), (5, 3), (1, 4), (250, 1 << 16)])
def test_moving_ranks(spark, window, block):
    rng = random.Random(window)
    rows = [(s, i, rng.choice([None, NAN, 0.0, 1.0, 1.5, -2.0, float("inf")]), f"extra {i}") for s in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "symbol int, date int, x double, _note string")
    got = {(r.symbol, r.date): r for r in moving_ranks(df, ["x"], window, block=block).collect()}
    assert len(got) == len(rows)
    sound = lambda v: v is not None and not math.isnan(v)
    for s, i, x, note in rows:
        near = [v for t, j, v, _ in rows if t == s and i - window < j <= i and sound(v)]
        want = (len(near), sum(v < x for v in near), sum(v <= x for v in near)) if sound(x) else (len(near), None, None)
        r = got[s, i]
        assert (r.x_n, r.x_below, r.x_upto, r._note) == (*want, note)


def test_moving_ranks_of_an_empty_table(spark):
    df = spark.createDataFrame([], "symbol int, date int, x double")
    assert moving_ranks(df, ["x"], 5).columns == ["symbol", "date", "x", "x_n", "x_below", "x_upto"]
    assert moving_ranks(df, ["x"], 5).count() == 0


def test_last_state_is_the_newest_row_with_its_divergences(spark):
    bars = spark.createDataFrame(series([1, 29, 30, 45, 130]), BARS)
    frame = day_frame(bars)
    got = {r.symbol: r.asDict() for r in structure.last_state(frame).collect()}
    newest = {r.symbol: r.asDict() for r in latest(frame).collect()}
    marks = {r.symbol: r for r in structure.macd_divergence(frame).collect()}
    assert set(got) == set(newest) == {0, 1, 2, 3, 4} and set(marks) == {2, 3, 4}
    for s, n in enumerate([1, 29, 30, 45, 130]):
        row = got[s]
        assert row.pop("n") == n
        flags = (row.pop("bullish_divergence"), row.pop("bearish_divergence"))
        assert flags == ((marks[s].bullish_divergence, marks[s].bearish_divergence) if s in marks else (None, None))
        assert row == newest[s]


def test_profile_state_is_its_parts(spark):
    found = profile.volume_profile(spark.createDataFrame(series([1, 20, 300], 2), BARS)).persist()
    got = {r.symbol: r for r in profile.profile_state(found).collect()}
    peaks = {}
    for r in profile.profile_peaks(found).orderBy("symbol", "bin").collect():
        peaks.setdefault(r.symbol, []).append((r.bin, r.centre, r.density))
    for part in (profile.profile_poc(found), profile.profit_ratio(found), profile.concentration(found)):
        for r in part.collect():
            assert {c: got[r.symbol][c] for c in part.columns} == r.asDict()
    assert {s: [tuple(p) for p in r.peaks] for s, r in got.items() if r.peaks} == peaks and peaks


def test_a_mean_of_sma_serves_the_bands(spark):
    bars = spark.createDataFrame(series([25], 3), BARS)
    own = indicators.bollinger(bars).select("date", "boll_mid", "boll_upper").collect()
    assert sorted(own) == sorted(indicators.bollinger(indicators.sma(bars)).select("date", "boll_mid", "boll_upper").collect())


def test_days_from_hours_are_days_from_half_hours(spark):
    rng = random.Random(4)
    rows = []
    for s in range(2):
        for i in rng.sample(range(400), 150):
            low = rng.randrange(50, 90)
            rows.append((s, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=30 * i), float(low + 1), float(low + 5), float(low), float(low + 2), float(rng.randrange(99))))
    rows.append((0, dt.datetime(2024, 1, 1, 0, 10), 1.0, 1.0, 1.0, None, 1.0))  # no close: no bar
    half = spark.createDataFrame(rows, BARS.replace("date date", "date timestamp"))
    days = normalise.roll_up(half, "day").collect()
    assert sorted(days) == sorted(normalise.roll_up(normalise.roll_up(half, "hour"), "day").collect())
    first = min((r for r in rows if r[0] == 1), key=lambda r: r[1])
    one = next(r for r in days if r.symbol == 1 and r.date == first[1].date())
    of_day = [r for r in rows if r[0] == 1 and r[1].date() == one.date]
    assert (one.open, one.high, one.low, one.volume) == (first[2], max(r[3] for r in of_day), min(r[4] for r in of_day), sum(r[6] for r in of_day))
    assert one.close == max(of_day, key=lambda r: r[1])[5]
    assert normalise.roll_up(half.where(F.lit(False)), "day").count() == 0
