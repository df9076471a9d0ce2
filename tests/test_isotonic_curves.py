"""The isotonic fit of every symbol."""

import random

import pytest
from pyspark.sql import functions as F

from candela.operators import regime
from candela.plans import catalog


def plain(points):
    """max over starts of the min over ends of the weighted mean; points: (value, weight)."""
    mean = lambda a, b: sum(v * w for v, w in points[a : b + 1]) / sum(w for _, w in points[a : b + 1])
    n = len(points)
    return [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]


def test_curves(spark):
    rng = random.Random(3)
    curves = {k: [(round(rng.random(), 2), rng.randrange(1, 9)) for _ in range(rng.randrange(1, 7))] for k in range(30)}
    rows = [(k, i, v, float(w)) for k, points in curves.items() for i, (v, w) in enumerate(points)] + [(50, 0, None, 0.0), (0, 9, None, 0.0)]
    got = {(r.symbol, r.bin): r.fitted for r in regime.isotonic_curves(spark.createDataFrame(rows, "symbol int, bin int, value double, weight double")).collect()}
    want = {(k, i): pytest.approx(x) for k, points in curves.items() for i, x in enumerate(plain(points))}
    assert got == want | {(50, 0): None, (0, 9): None}


def test_points_that_share_a_place(spark):
    rows = [(1, 0, 0.9, 1.0), (1, 0, 0.1, 3.0), (1, 1, 0.2, 4.0), (1, 1, 0.2, 4.0)]
    got = regime.isotonic_curves(spark.createDataFrame(rows, "symbol int, bin int, value double, weight double")).collect()
    assert sorted((r.bin, round(r.fitted, 9)) for r in got) == [(0, round(2.8 / 12, 9))] * 2 + [(1, round(2.8 / 12, 9))] * 2


def test_query_fits_every_symbol(spark, sf):
    rows = catalog.QUERIES["p10_isotonic"](spark, sf).where(F.col("fitted").isNotNull())
    assert {r.symbol for r in rows.select("symbol").distinct().collect()} == set(range(5))
