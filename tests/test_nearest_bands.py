"""Ranked bands in one pass over a symbol's candidates, against the walk, the aggregation and the window."""

import random

from candela.operators import levels as lev


def rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def test_bands_of_one_pass(spark):
    """Ties, equal sources, NaN, prices in chains, symbols over the limit of a batch; one exchange of the candidates."""
    rng, data = random.Random(3), []
    for s in range(120):
        for k in range(rng.choice([1, 2, 30, 90])):
            price = float("nan") if rng.random() < 0.02 else round(100 * rng.uniform(0.8, 1.2), rng.choice([0, 2]))
            side = "support" if price < 100 else "resistance"
            data.append((s, price, rng.choice([5, 8, 22, 35]), f"x{rng.randrange(20)}", rng.choice("ABCD"), 100.0, side))
    sided = spark.createDataFrame(data, "symbol long, price double, weight int, source string, category string, close double, side string").repartition(5)
    got, want = lev.nearest_bands(sided), lev.rank_bands(lev.score_bands(lev.cluster_levels(sided)))
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in (before, "7", "1"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            assert rows(lev.nearest_bands(sided)) == rows(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert rows(lev.nearest_bands(sided.where("symbol < 0"))) == []
    prices = spark.createDataFrame([(s, 100.0) for s in range(120)], "symbol long, close double")
    plan = lev.levels(sided.drop("close", "side"), prices)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 0 and plan.count("Window") == 1
