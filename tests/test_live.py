"""Live merge over micro-batches, moving means of any prices, bootstrap draws against plain versions."""

import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from candela.functions.tables import shared_path
from candela.functions.windows import moving_means
from candela.operators.regime import block_bootstrap
from candela.streaming import live

BARS = "symbol long, date date, open double, high double, low double, close double, volume double, amount double, provenance string"
SNAPSHOTS = "symbol long, date date, ts int, open double, high double, low double, close double, volume double, amount double"


def day(k):
    return datetime.date(2024, 1, 25) + datetime.timedelta(days=k)


def state(spark, path, turn):
    return sorted(map(tuple, live.read_history(spark, path, turn).select("symbol", "date", "high", "low", "close", "volume", "amount", "provenance").collect()))


def test_batches_merge_and_repeats_change_nothing(spark):
    path = shared_path(spark, "history")
    rows = [(s, day(k), 10.0, 11.0, 9.0, 10.0, 5.0, 50.0, "reliable/historical" if s == 1 else None) for s in (1, 2, 3) for k in range(10)]
    live.create_history(spark.createDataFrame(rows, BARS), path)
    # Several snapshots of a day (the newest counts), an old one, one without a price, a new day without volume, a new symbol.
    batch = spark.createDataFrame([
        (1, day(9), 1, 10.0, 12.0, 8.0, 11.0, 6.0, 60.0), (1, day(9), 2, 10.0, 13.0, 9.5, 12.0, 7.0, 0.0), (1, day(10), 3, 12.0, 12.5, 11.5, 12.6, 1.0, None),
        (1, day(3), 4, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), (2, day(10), 1, 10.0, 10.0, 10.0, 10.0, 0.0, 0.0), (3, day(9), 1, 10.0, 0.0, 9.0, 10.0, 1.0, 1.0), (4, day(11), 1, 5.0, 6.0, 4.0, 5.5, 2.0, 11.0),
    ], SNAPSHOTS)
    live.merge_batch(batch, path, 0)
    once = state(spark, path, 1)
    got = {(r[0], r[1]): r[2:] for r in once}
    assert len(once) == len(got) == 32
    assert got[1, day(9)] == (13.0, 9.0, 12.0, 7.0, 50.0, "unknown/mixed") and got[1, day(10)] == (12.6, 11.5, 12.6, 1.0, 12.6, "unknown/mixed")
    assert got[1, day(3)] == (11.0, 9.0, 10.0, 5.0, 50.0, "unknown/mixed") and got[3, day(9)][-1] == "unknown/unknown"
    assert got[4, day(11)] == (6.0, 4.0, 5.5, 2.0, 11.0, "unknown/unknown") and (2, day(10)) not in got
    live.merge_batch(batch, path, 0)
    assert state(spark, path, 1) == once
    later = spark.createDataFrame([(1, day(10), 5, 12.0, 14.0, 11.0, 13.0, 3.0, 39.0), (2, day(9), 5, 10.0, 10.5, 9.9, 10.2, 6.0, 61.0)], SNAPSHOTS)
    live.merge_batch(later, path, 1)
    got = {(r[0], r[1]): r[2:] for r in state(spark, path, 2)}
    assert got[1, day(10)] == (14.0, 11.0, 13.0, 3.0, 39.0, "unknown/mixed") and got[2, day(9)][:4] == (11.0, 9.0, 10.2, 6.0) and len(got) == 32
    live.merge_batch(later.limit(0), path, 2)
    assert len(state(spark, path, 3)) == 32


@pytest.mark.parametrize("scale", [1e-6, 1e-3, 1.0, 1e6, 1e15])
def test_moving_means(spark, scale):
    rng = random.Random(2)
    xs = [None if rng.random() < 0.05 else rng.uniform(0.5, 1.5) * scale for _ in range(120)]
    xs[60] = float("nan")
    df = spark.createDataFrame([(s, k, x) for s in (1, 2) for k, x in enumerate(xs[: 120 if s == 1 else 50])], "symbol int, date int, x double")
    got = {(r.symbol, r.date): r for r in moving_means(df, F.col("x"), {"m5": 5, "m30": 30}).collect()}
    assert len(got) == 170
    for (s, k), r in got.items():
        for n, m in ((5, r.m5), (30, r.m30)):
            seen = [x for x in xs[max(0, k - n + 1) : k + 1] if x is not None]
            if len(seen) < n:
                assert m is None
            else:
                assert m == pytest.approx(sum(seen) / n, rel=2e-9, nan_ok=True)


def test_bootstrap_draws(spark):
    rng = random.Random(3)
    gains = {1: [rng.gauss(0.02, 1) for _ in range(70)], 2: [rng.gauss(0, 1) for _ in range(54)]}
    df = spark.createDataFrame([(s, k, g) for s, gs in gains.items() for k, g in enumerate(gs)], "symbol int, pos int, gain double")
    got = {r.symbol: r.p_value for r in block_bootstrap(df, iterations=250).collect()}
    sums = [sum(gains[1][k : k + 11]) for k in range(60)]
    draw = lambda i, b: sums[int(hashlib.md5(f"{i}:{b}".encode()).hexdigest()[:15], 16) % 60]
    assert got == {1: sum(sum(draw(i, b) for b in range(1, 7)) <= 0 for i in range(250)) / 250, 2: None}
