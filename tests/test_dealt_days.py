"""Days of a long series are dealt to as many tasks as their number of ticks asks for."""

from pyspark.sql import functions as F

from candela.plans import fixtures as fx


def test_tasks_grow_with_the_ticks(spark, monkeypatch):
    monkeypatch.setattr(fx, "TASK_TICKS", 100)
    ticks = spark.range(5000).select((F.col("id") % 2).cast("int").alias("symbol"), F.expr("date_add(date'2020-01-01', cast(id % 250 as int))").alias("day"), (F.col("id") % 11 - 5).alias("st"), "id")
    dealt, plain = fx.walked(ticks, ("id",), 5000), fx.walked(ticks, ("id",))
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert dealt.rdd.getNumPartitions() == 50 and sum(sizes) == 5000 and max(sizes) <= 400
    rows = lambda df: sorted(map(tuple, df.select("id", "rn", "walk").collect()))
    assert rows(dealt) == rows(plain)
