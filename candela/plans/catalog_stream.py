"""Queries over streaming operators and sinks, each with its DuckDB SQL where there is one."""

from __future__ import annotations

import uuid
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.functions.tables import shared_path as folder
from candela.functions.windows import from_end
from candela.operators import scoring as sc
from candela.plans import catalog_bars as cb
from candela.plans.catalog_bars import B, daily, query
from candela.plans.catalog_scoring import STATE, state
from candela.plans.fixtures import derive
from candela.sources import sinks
from candela.sources.bars import latest
from candela.streaming import bars as sb
from candela.streaming import live

_LOCAL = set(cb.QUERIES)


def run_stream(df: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """A stream run to its end into a Parquet table of the shared folder."""
    out, at = folder(spark, name), folder(spark, f"{name}-at")
    df.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


CLOSED = """select event_type as symbol, date_trunc('hour', cast(ts as timestamp)) as ts, min_by(value, (ts, event_id)) as open, max(value) as high, min(value) as low, max_by(value, (ts, event_id)) as close, count(*) as volume
from events group by 1, 2 having date_trunc('hour', cast(ts as timestamp)) + interval 1 hour <= (select max(cast(ts as timestamp)) - interval 1 hour from events)"""


def _ordered(events: DataFrame) -> DataFrame:
    rows = events.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("price"), F.lit(1).cast("long").alias("volume"))
    return rows.withColumn("tick", F.struct("ts", "event_id"))


@query("st1_stream_bars", CLOSED)
def _(spark, d):
    return run_stream(sb.stream_bars(_ordered(event_stream(spark, d))), spark, "st1")


@query("st2_closed_bars", f"select count(*) as bars, max(ts) as newest from ({CLOSED}) c")
def _(spark, d):
    return run_stream(sb.stream_bars(_ordered(event_stream(spark, d))), spark, "st2").agg(F.count(F.lit(1)).alias("bars"), F.max("ts").alias("newest"))


#: Live snapshots of four kinds: same date, newer date, newer without volume, without a price; and an older date.
SNAPSHOT = """select symbol, case symbol % 5 when 0 then date when 4 then date - 30 else date + 1 end as date, open, high, low, case when symbol % 5 = 3 then 0e0 else close * 1.01e0 end as close,
  case when symbol % 5 = 2 then 0e0 else volume * 2 end as volume, amount * 2 as amount from {0}"""
MERGED = f"""{B}, l as (select * from bars qualify row_number() over (partition by symbol order by date desc) = 1), s as ({SNAPSHOT.format('l')})
select symbol, date, b.open, case when s.symbol is null then b.high else greatest(b.high, s.high, s.close) end as high, case when s.symbol is null then b.low else least(b.low, s.low, s.close) end as low,
  coalesce(s.close, b.close) as close, coalesce(s.volume, b.volume) as volume, coalesce(s.amount, b.amount) as amount, s.symbol is not null as merged
from bars b left join (select * from s where symbol % 5 = 0) s using (symbol, date)
union all select symbol, date, open, greatest(high, close), least(low, close), close, volume, amount, true from s where symbol % 5 = 1"""


def snapshots(spark, d):
    last = latest(daily(spark, d))
    return spark.sql(SNAPSHOT.format("{last}"), last=last)


@query("st3_merge_live", MERGED, "high low close amount")
def _(spark, d):
    return sb.merge_live_bar(daily(spark, d), snapshots(spark, d))


#: Four runs of snapshots over a history without its last two bars (r counts from the end): the last kept bar changes; a new
#: bar, unfinished (without volume for one in five symbols); its end, an old snapshot and one without a price; the last bar.
RUNS = (
    "select symbol, date, 1 as ts, open, high, low, close*1.01e0 as close, volume*2 as volume, amount*2 as amount from {0} where r = 3",
    "select symbol, date, 2 as ts, open, high, low, close*0.99e0 as close, case when symbol % 5 = 2 then 0e0 else volume/2 end as volume, amount/2 as amount from {0} where r = 2",
    "select symbol, date, 3 as ts, open, high, low, case when r = 5 then close*2 when r = 1 then 0e0 else close end as close, volume, amount from {0} where r = 2 or r = 5 or (r = 1 and symbol % 7 = 0)",
    "select symbol, date, 4 as ts, open, high, low, close, volume, 0e0 as amount from {0} where r = 1",
)
STREAMED = f"""{B}, n as (select *, row_number() over (partition by symbol order by date desc) as r from bars)
select symbol, date, open, case when r = 3 then greatest(high, close*1.01e0) else high end as high, case when r = 3 then least(low, close*1.01e0) when r = 2 and symbol % 5 <> 2 then least(low, close*0.99e0) else low end as low,
  case when r = 3 then close*1.01e0 else close end as close, case when r = 3 then volume*2 else volume end as volume, case when r = 3 then amount*2 when r = 1 then volume*close else amount end as amount,
  case when symbol % 2 = 0 then 'unknown/mixed' else 'estimated/current' end as provenance from n"""


@query("st3_merge_stream", STREAMED, "high low close amount")
def _(spark, d):
    path, inbox, at = (folder(spark, f"st3-{x}") for x in ("history", "snapshots", "at"))
    numbered = daily(spark, d).withColumn("r", from_end())
    tag = F.when(F.col("symbol") % 2 == 0, "reliable/historical").otherwise("estimated/current")
    live.create_history(numbered.where("r > 2").drop("r").withColumn("provenance", tag), path)
    for run in RUNS:
        rows = spark.sql(run.format("{n}"), n=numbered)
        rows.write.mode("append").parquet(inbox)
        live.merge_stream(spark.readStream.schema(rows.schema).parquet(inbox), path, at).awaitTermination()
    return live.read_history(spark, path, len(RUNS))


@query("st4_late_snapshot", f"{B} select symbol, count(*) as bars, max(date) as last_date, false as merged from bars group by symbol")
def _(spark, d):
    late = latest(daily(spark, d)).withColumns({"date": F.date_sub("date", 30), "close": F.col("close") * 1.01, "volume": F.col("volume") * 2})
    merged = sb.merge_live_bar(daily(spark, d), late)
    return merged.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.max("date").alias("last_date"), F.max("merged").alias("merged"))


@query("st5_newest", "select event_type as symbol, max(cast(ts as timestamp)) as ts, max_by(event_id, (ts, event_id)) as event_id, max_by(value, (ts, event_id)) as price from events group by 1")
def _(spark, d):
    name = f"newest_{uuid.uuid4().hex}"
    stream = sb.newest(_ordered(event_stream(spark, d)).drop("volume"), "tick").drop("tick")
    # The state has a row a symbol; a batch that reruns overwrites the same table.
    out = folder(spark, name)
    query_ = stream.writeStream.outputMode("complete").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(out)).option("checkpointLocation", folder(spark, "st5-at")).trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.read.parquet(out)


@query("st6_daily_job", "select cast(ts as date) as date, event_type as symbol, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def _(spark, d):
    out, at = folder(spark, "st6"), folder(spark, "st6-at")
    job = lambda b: b.groupBy("date", F.col("event_type").alias("symbol")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    sb.daily_job(event_stream(spark, d).withColumn("date", F.col("ts").cast("date")), out, at, job).awaitTermination()
    return spark.read.parquet(out)


@query("k3_scan_results", f"{STATE} select symbol, close, unnest(string_split(strategies, ',')) as strategy from screened where strategies <> ''")
def _(spark, d):
    path = folder(spark, "k3")
    sinks.write_scan(sc.score_all(state(spark, d)).select("symbol", "close", "strategies"), path)
    views = [sinks.read_scan(spark, path, s).select("symbol", "close", F.lit(s).alias("strategy")) for s in sc.STRATEGIES]
    return reduce(DataFrame.unionByName, views)


@query("k1_calibration", f"{B} select symbol, 'v2' as model_version, timestamp '2026-01-02 00:00:00' as generated_at, count(*) as n from bars where symbol % 3 = 0 group by symbol")
def _(spark, d):
    path, now = folder(spark, "k1"), datetime(2026, 1, 2, 12)
    rows = daily(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).withColumns({"model_version": F.expr("case when symbol % 3 = 0 then 'v2' else 'v1' end"), "generated_at": F.lit(datetime(2026, 1, 2))})
    sinks.write_calibration(rows, path)
    return sinks.read_calibration(spark, path, "symbol bigint, model_version string, generated_at timestamp, n bigint", "v2", now)


@query("k4_funding_cache", "select cast(o_orderdate as date) as date, round(sum(o_totalprice), 2) as balance from orders group by 1")
def _(spark, d):
    from candela.plans.fixtures import FUNDING

    path, now = folder(spark, "k4"), datetime(2026, 1, 2)
    sinks.write_funding_cache(derive(spark, d, FUNDING), path, now)
    assert sinks.read_funding_cache(spark, path, 10**9, now) is None and sinks.read_funding_cache(spark, path + "-none", 1, now) is None
    return sinks.read_funding_cache(spark, path, 100, now)


@query("k2_evaluation", f"{B} select symbol, count(*) as n from bars group by symbol")
def _(spark, d):
    path = folder(spark, "k2")
    rows = daily(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    sinks.write_evaluation(rows.agg(F.sum("n").alias("bars")), rows, path, "run")
    return spark.read.schema("symbol bigint, n bigint").option("header", True).csv(f"{path}/latest/points")


QUERIES = {k: v for k, v in cb.QUERIES.items() if k not in _LOCAL}
ORACLE = {k: cb.ORACLE[k] for k in QUERIES if k in cb.ORACLE}
