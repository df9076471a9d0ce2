"""Daily job over several batches, means of prices of any size, pooled ranks."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from candela.functions.tables import shared_path
from candela.operators import evaluation, indicators
from candela.streaming import bars as streaming


@pytest.mark.parametrize("prices", [[0.0047, 0.0048, 0.0049, 0.005, 0.0051], [2e10 + i for i in range(5)], [1e19] * 5, [1e-12 * i for i in range(1, 6)]])
def test_means_of_prices_of_any_size(spark, prices):
    rows = [(1, f"2020-01-0{i + 1}", c, c, c) for i, c in enumerate(prices)]
    df = spark.createDataFrame(rows, "symbol int, date string, close double, high double, low double")
    assert indicators.sma(df, (5,)).orderBy("date").collect()[-1].ma_5 == pytest.approx(sum(prices) / 5, rel=1e-9)
    changes = [b - a for a, b in zip(prices[1:], prices[2:])]
    assert indicators.atr(df, 2).orderBy("date").collect()[-1].atr == pytest.approx(sum(map(abs, changes[-2:])) / 2, rel=1e-6)
    gain, loss = (sum(max(0.0, s * x) for x in changes[-2:]) / 2 for s in (1, -1))
    assert indicators.rsi(df, (2,)).orderBy("date").collect()[-1].rsi_2 == pytest.approx(100 - 100 / (1 + gain / (loss + 1e-9)))


def test_daily_job_keeps_all_rows_of_a_date(spark):
    source, out, schema = shared_path(spark, "in"), shared_path(spark, "out"), "date date, symbol string, value double"
    one, two = datetime.date(2020, 1, 1), datetime.date(2020, 1, 2)
    job = lambda rows: rows.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        streaming.daily_job(stream, out, out + "-at", job).awaitTermination()
        return {r.date: (r.n, r.total) for r in spark.read.parquet(out).collect()}

    for rows in ([(one, "a", 1.0), (one, "b", 2.0)], [(one, "a", 3.0), (two, "b", 4.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    assert run() == {one: (3, 6.0), two: (1, 4.0)}
    spark.createDataFrame([(one, "c", 5.0)], schema).coalesce(1).write.mode("append").parquet(source)
    assert run() == {one: (4, 11.0), two: (1, 4.0)}


def test_pooled_ranks_against_plain_ranks(spark):
    rng = random.Random(3)
    rows = [(f"s{i % 2}", float(rng.randrange(40))) for i in range(900)]
    got = evaluation.pooled_rank(spark.createDataFrame(rows, "score string, x double").repartition(7), "score", "x", "r").collect()
    assert len(got) == len(rows)
    for r in got:
        same = [x for s, x in rows if s == r.score]
        assert r.r == sum(x < r.x for x in same) + (same.count(r.x) + 1) / 2


def test_slices_hold_the_whole_prefix(spark):
    rows = [(1, f"{t:04d}", float(t)) for t in range(290)]
    got = evaluation.asof_slices(spark.createDataFrame(rows, "symbol int, date string, close double"), lookback=None, step=3)
    sizes = {r.symbol % evaluation.SLICE: (r.n, r.last) for r in got.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max("close").alias("last")).collect()}
    assert sizes == {t: (t + 1, float(t)) for t in range(249, 290 - 22 + 1, 3)}
