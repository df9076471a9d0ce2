"""Blocked scans against a plain walk."""

import random

import pytest
from pyspark.sql import functions as F

from candela.functions import folds


@pytest.mark.parametrize("block", [2, 4, 64])
def test_scan_against_a_walk(spark, monkeypatch, block):
    monkeypatch.setattr(folds, "BLOCK", block)  # small blocks use every level of composition
    rng = random.Random(block)
    rows = [(s, i, None if rng.random() < 0.1 else rng.uniform(1, 9), "kept") for s, n in ((1, 150), (2, 1), (None, 70)) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "symbol int, date int, x double, _i string")
    filled = F.coalesce("x", F.lit(3.0))
    steps = {"ema": folds.ema_step(F.col("x"), 12), "slow": folds.decay_step(filled, 1 / 3, 50.0), "poisoned": folds.decay_step(F.col("x"), 1 / 3, 50.0)}
    got = folds.affine_scan(df, steps).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"symbol", "date", "x", "_i", "ema", "slow", "poisoned"}
    state = {}
    for r in sorted(got, key=lambda r: r.date):
        ema, slow, poisoned = state.get(r.symbol, (None, 50.0, 50.0))
        ema = None if r.x is None else r.x if ema is None else 11 / 13 * ema + 2 / 13 * r.x
        slow = 2 / 3 * slow + 1 / 3 * (3.0 if r.x is None else r.x)
        poisoned = None if poisoned is None or r.x is None else 2 / 3 * poisoned + 1 / 3 * r.x
        state[r.symbol] = ema, slow, poisoned
        assert (r.ema, r.slow, r.poisoned) == tuple(None if v is None else pytest.approx(v, rel=1e-12) for v in state[r.symbol])
    assert folds.affine_scan(df.limit(0), steps).count() == 0


def test_long_series_in_bounded_arrays(spark):
    n = 200_000
    df = spark.range(n).select(F.lit(1).alias("symbol"), F.col("id").cast("int").alias("date"), F.lit(2.0).alias("x"))
    got = folds.affine_scan(df, {"y": folds.decay_step(F.col("x"), 0.25, 10.0)}).agg(F.count("y").alias("n"), F.min("y").alias("low"), F.max("y").alias("high")).head()
    assert got.n == n and got.low == pytest.approx(2.0) and got.high == pytest.approx(8.0)
