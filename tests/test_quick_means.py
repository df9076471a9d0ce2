"""Moving means of prices add longs where these hold the sums, decimals elsewhere, with the same result."""

import random

from pyspark.sql import functions as F

from candela.functions import windows


def test_longs_and_decimals_agree(spark, monkeypatch):
    rng = random.Random(3)
    # Symbol 1: prices; 2: too large for longs; 3: missing values and NaN; 4: a float's noise.
    value = {1: lambda i: round(rng.uniform(1, 300), 2), 2: lambda i: round(rng.uniform(1e6, 2e6), 2), 3: lambda i: (None, float("nan"), 5.25)[i % 3] if i < 9 else 7.1, 4: lambda i: 10.3 - 9.2}
    df = spark.createDataFrame([(s, i, f(i)) for s, f in value.items() for i in range(60)], "symbol int, date int, x double").persist()
    means = lambda: windows.moving_means(df, F.col("x"), {"m3": 3, "m20": 20})
    plan = means()._jdf.queryExecution().analyzed().toString()
    assert "_q" in plan
    quick = sorted(map(repr, means().collect()))
    monkeypatch.setattr(windows, "QUICK_WINDOW", 0.0)
    assert quick == sorted(map(repr, means().collect()))
