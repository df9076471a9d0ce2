"""Quintiles over several range partitions whose bounds are sampled."""

import pytest
from pyspark.sql import functions as F

from candela.operators import evaluation

CONF = {"spark.sql.execution.rangeExchange.sampleSizePerPartition": "2", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false"}


@pytest.fixture
def sampled(spark):
    old = {k: spark.conf.get(k, None) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_quintiles_of_sampled_ranges(sampled):
    n = 20_001
    pit = sampled.range(0, n, 1, 12).select(F.col("id").alias("symbol"), F.lit("2020-01-01").cast("date").alias("date"), ((F.col("id") * 7919) % n).cast("double").alias("score"), (F.col("id") % 7).cast("double").alias("ret_10"))
    got = {r.quintile: (r.ret_n, r.from_score, r.to_score) for r in evaluation.score_quintiles(pit, "score").collect()}
    assert got == {1: (4001, 0, 4000), **{q: (4000, 4000 * (q - 1) + 1, 4000 * q) for q in range(2, 6)}}
