"""The newest state of a symbol from its last bars behind the recursions, against whole series."""

import random

from pyspark.sql import functions as F

from candela.functions.windows import KEY
from candela.operators import causal
from candela.operators import indicators as ind
from candela.operators import normalise as norm
from candela.operators import structure as st
from candela.plans import catalog_structure as cs


def rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def test_newest_state_needs_the_last_bars_alone(spark):
    """Series shorter and longer than the longest mean, one with missing closes; n counts all bars."""
    rng, data = random.Random(9), []
    for s, n in enumerate((5, 29, 249, 250, 251, 600, 600)):
        c = 100.0
        for i in range(n):
            c = round(max(1.0, c + rng.gauss(0, 1)), 2)
            data.append((s, i, c, c + 1, c - 1, None if s == 6 and rng.random() < 0.02 else c, float(rng.randrange(1, 50)), c * 10))
    bars = spark.createDataFrame(data, "symbol long, date int, open double, high double, low double, close double, volume double, amount double").persist()
    recent = cs.recent_frame(bars)
    assert recent.groupBy(KEY).count().agg(F.max("count")).head()[0] == 250
    whole = st.volume_features(norm.change_pct(ind.vol_ratio(ind.atr(ind.bollinger(ind.sma(ind.recursions(bars)))))))
    assert rows(cs.day_state(bars)) == rows(st.last_state(whole))


def test_wave_reads_no_frame_of_120_bars(spark):
    bars = spark.createDataFrame([(s, i, 100.0 + (i * 7 + s) % 23, 90.0 + (i * 5 + s) % 19) for s in range(2) for i in range(300)], "symbol long, date int, high double, low double").persist()
    points = causal.Points(warmup=50, step=7)
    waves = causal.wave_part(bars, points)
    assert "-119, " not in waves._jdf.queryExecution().optimizedPlan().toString()
    seen = points.marked(bars)
    at = seen.where("point is not null").select("point", F.col(KEY).alias("_s"), F.col("t").alias("_t"))
    cut = seen.drop("point").join(at, (F.col(KEY) == F.col("_s")) & (F.col("t") <= F.col("_t"))).select(F.col("point").alias(KEY), "date", "high", "low")
    assert rows(waves) == rows(st.fibonacci_wave(cut))
