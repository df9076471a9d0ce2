"""As-of state against a rerun on every history, exits against the walker of paths, first hits against a scan."""

import math
import random

import pytest
from pyspark.sql import functions as F

from candela.functions import first_hit as fh
from candela.operators import causal, evaluation, exits
from candela.operators import indicators as ind
from candela.operators import levels as lev
from candela.operators import scoring as sc
from candela.plans.catalog_scoring import state_of
from candela.plans.catalog_structure import candidates, closes

COLUMNS = "symbol long, date date, open double, high double, low double, close double, volume double, amount double"


def walk(seed, n, symbol):
    """Bars with gaps, limit days and a few without volume."""
    import datetime

    rng, c, day, out = random.Random(seed), 100.0, datetime.date(2020, 1, 1), []
    for _ in range(n):
        day += datetime.timedelta(days=rng.choice([1, 1, 1, 1, 3]))
        o = round(c * math.exp(rng.gauss(0, 0.006)), 2)
        close = round(o * math.exp(rng.gauss(0, 0.012)), 2)
        high, low = round(max(o, close) * (1 + rng.random() * 0.006), 2), round(min(o, close) * (1 - rng.random() * 0.006), 2)
        if rng.random() < 0.05:
            o = high = low = close = round(c * 0.97, 2)
        volume = 0.0 if rng.random() < 0.02 else float(rng.randrange(100, 1000))
        out.append((symbol, day, o, high, low, close, volume, round(close * volume, 2)))
        c = close
    return out


@pytest.fixture(scope="module")
def bars(spark):
    rows = walk(1, 420, 1) + walk(2, 330, 2) + walk(3, 271, 3) + walk(4, 272, 4) + walk(5, 40, 5)
    return spark.createDataFrame(rows, COLUMNS).persist()


@pytest.fixture(scope="module")
def points():
    return causal.Points(step=17)


@pytest.fixture(scope="module")
def both(spark, bars, points):
    """(causal state, bands), and the same from whole copied histories."""
    slices = evaluation.asof_slices(bars, lookback=None, step=17).persist()
    bands = lev.levels(candidates(spark, None, slices), closes(slices)).persist()
    return causal.asof_state(bars, points), (sc.score_all(state_of(slices, bands)).persist(), bands, slices)


def keyed(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict(recursive=True) for r in df.collect()}


def near(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == pytest.approx(b, rel=1e-9, abs=1e-9) or (math.isnan(a) and math.isnan(b))
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(near, a, b))
    return a == b


def test_state_equals_a_rerun_on_each_history(both):
    (got, _), (want, _, _) = both
    names = sorted(set(got.columns) & set(want.columns))
    assert {"bullish_score", "signal", "stop_loss", "week_ma_20", "poc", "conc_90", "bullish_divergence", "supports", "strategies", "n", "vp_state", "kdj_j"} <= set(names)
    got, want = keyed(got.select(names), "symbol"), keyed(want.select(names), "symbol")
    assert got.keys() == want.keys() and len(got) > 10 and 3 not in {k[0] // evaluation.SLICE for k in got}
    for k in want:
        off = [c for c in names if not near(got[k][c], want[k][c])]
        assert not off, (k, {c: (got[k][c], want[k][c]) for c in off})


def test_bands_equal_a_rerun_on_each_history(both):
    (_, got), (_, want, _) = both
    got, want = keyed(got, "symbol", "label"), keyed(want, "symbol", "label")
    assert got.keys() == want.keys() and len(got) > 50
    for k in want:
        assert all(near(got[k][c], want[k][c]) for c in want[k]), (k, got[k], want[k])


def test_patterns_equal_a_rerun_on_each_history(bars, both, points):
    (state, _), (whole, _, slices) = both
    want = sc.similar_patterns(ind.recursions(ind.atr(ind.sma(slices, (20, 60)))), whole)
    got = keyed(causal.asof_patterns(bars, state, points), "symbol")
    want = keyed(want, "symbol")
    assert got.keys() == want.keys() and any(r["samples"] >= 5 for r in want.values())
    for k in want:
        assert all(near(got[k][c], want[k][c]) for c in want[k]), (k, got[k], want[k])


def test_later_bars_change_nothing(spark, bars, points):
    """Points of a series cut short are those of the whole one."""
    cut = spark.createDataFrame(walk(1, 420, 1)[:360], COLUMNS)
    part, _ = causal.asof_state(cut, points)
    whole, _ = causal.asof_state(bars.where("symbol = 1"), points)
    part, whole = keyed(part, "symbol"), keyed(whole, "symbol")
    assert part and part.keys() < whole.keys()
    assert all(near(part[k][c], whole[k][c]) for k in part for c in part[k])


def test_no_points(spark, bars):
    state, bands = causal.asof_state(bars.where("symbol = 5"))
    assert state.count() == 0 and bands.count() == 0
    assert causal.asof_patterns(bars.where("symbol = 5"), state).count() == 0


def test_first_hit_against_a_scan(spark, monkeypatch):
    monkeypatch.setattr(fh, "FAN", 4)
    rng = random.Random(9)
    series = {s: [None if rng.random() < 0.05 else round(rng.gauss(50, 20), 1) for _ in range(n)] for s, n in ((1, 300), (2, 61), (3, 4), (4, 1))}
    events = [(s, i, None if rng.random() < 0.05 else round(rng.gauss(15, 20), 1)) for s, xs in series.items() for i in range(len(xs))]
    df = spark.createDataFrame(events, "symbol long, i int, level double")
    rows = spark.createDataFrame([(s, i, x) for s, xs in series.items() for i, x in enumerate(xs)], "symbol long, i int, value double")
    got = {(r.symbol, r.i): r.hit for r in fh.first_hit(df, rows, 300).collect()}
    want = {(s, i): next((j for j in range(i + 1, len(series[s])) if level is not None and series[s][j] is not None and series[s][j] <= level), None) for s, i, level in events}
    assert got == want and len({w for w in want.values()}) > 50 and None in want.values()


def test_exits_equal_the_walk_to_the_end(spark):
    """Long runs of locked days, so that sales wait beyond any fixed number of bars; open positions only where data end."""
    rows, rng = [], random.Random(4)
    for symbol in range(6):
        c, days = 50.0, []
        for k in range(260):
            locked = 60 <= k < 60 + 25 * symbol or rng.random() < 0.1
            o = round(c * 0.9, 2) if locked else round(c * rng.uniform(0.97, 1.05), 2)
            low, close, high = (o, o, o) if locked else (round(o * rng.uniform(0.94, 1), 2), round(o * rng.uniform(0.97, 1.06), 2), None)
            low = min(low, close)
            high = o if locked else (None if rng.random() < 0.2 else round(max(o, close) * 1.01, 2))
            if rng.random() < 0.03:
                o = rng.choice([float("nan"), 0.0, None])
            days.append((symbol, k, o, high, low, close))
            c = max(close, 5.0)
        rows += days
    df = spark.createDataFrame(rows, "symbol long, k int, open double, high double, low double, close double")
    df = df.withColumn("date", F.expr("date_add(date'2020-01-01', k)"))
    path = F.collect_list(F.struct("open", "high", "low", "close")).over(evaluation.series().rowsBetween(1, 100_000))
    whole = df.withColumn("path", path)
    stop = F.col("close") * 0.95
    for horizon in (0, 1, 10, 20):
        want = whole.select("symbol", "k", evaluation.executable_exit(F.col("path"), stop, horizon, 10.0).alias("x"))
        got = exits.forward_days(df, 10.0, 20).select("symbol", "k", exits.exit_within(F.col("days"), stop, horizon).alias("x"))
        got, want = keyed(got, "symbol", "k"), keyed(want, "symbol", "k")
        assert got == want
    sold = [r["x"] for r in want.values()]
    assert {x["hit"] for x in sold} == {True, False, None}
    open_ = [k for k, r in want.items() if r["x"]["price"] is None]
    assert open_ and all(k > 200 for _, k in open_)
    null = exits.forward_days(df, 10.0).select(exits.exit_within(F.col("days"), F.lit(None).cast("double"), 10).alias("x")).where("x.hit")
    assert null.count() == 0
