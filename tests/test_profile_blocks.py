"""Profiles at points from blocks of a series, against those of each history."""

from pyspark.sql import functions as F

from candela.functions.windows import KEY
from candela.operators import causal
from candela.operators import profile as prof
from candela.plans import fixtures as fx


def rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def test_profile_at_points_in_blocks(spark, sf):
    """Blocks shorter and longer than the look-back, bars without volume or with a missing price."""
    odd = lambda c, n: F.when(F.hash("date", F.lit(n)) % n != 0, F.col(c)).alias(c)
    bars = fx.derive(spark, sf, fx.DAILY).where("symbol <= 2").select(KEY, "date", odd("open", 17), odd("high", 13), odd("low", 23), odd("close", 19), odd("volume", 7)).persist()
    marked = causal.Points(warmup=150, step=70).marked(bars).persist()
    profile = causal.profile_part(bars, causal.Points(warmup=150, step=70))
    got = rows(profile)
    cut = bars.join(marked.where("point is not null").select(KEY, F.col("date").alias("_to"), "point"), KEY).where("date <= _to")
    assert got == rows(prof.volume_profile(cut.withColumn(KEY, F.col("point")).drop("_to", "point")))
    plain = causal.prof.moving_profile
    try:
        causal.prof.moving_profile = lambda m: plain(m, block=100)
        assert rows(causal.profile_part(bars, causal.Points(warmup=150, step=70))) == got
    finally:
        causal.prof.moving_profile = plain
