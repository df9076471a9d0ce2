"""Market-bar tables that the registered queries read: Spark derives them from the given tables.

The tables hold no price series, so a walk is made from integer steps (running sums of integers are exact, so that every
engine gets the same prices). The texts run unchanged on Spark and on DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TICKS = """
select l_suppkey as symbol, cast(l_shipdate as date) as date, l_quantity as q, cast(round(l_discount*100) as int)-5 as st,
       row_number() over (partition by l_suppkey order by l_shipdate,l_orderkey,l_linenumber,l_partkey,l_extendedprice) as rn
from lineitem"""
PRICED = f"""
select symbol, date, q, rn, round(100*exp(sum(st) over (partition by symbol order by rn rows between unbounded preceding and current row)*4e-3),2) as px
from ({TICKS}) t"""
DAILY = f"""
select symbol, date, min_by(px,rn) as open, max(px) as high, min(px) as low, max_by(px,rn) as close, sum(q) as volume, round(sum(q*px),2) as amount
from ({PRICED}) p group by symbol, date"""
INDEX_DAILY = """
select symbol, date, min_by(px,rn) as open, max(px) as high, min(px) as low, max_by(px,rn) as close, sum(q) as volume, round(sum(q*px),2) as amount
from (select symbol, date, q, rn, round(1000*exp(sum(st) over (partition by symbol order by rn rows between unbounded preceding and current row)*1e-3),2) as px
      from (select cast(n_regionkey as int) as symbol, cast(l_shipdate as date) as date, l_quantity as q, cast(round(l_discount*100) as int)-5 as st,
                   row_number() over (partition by n_regionkey order by l_shipdate,l_orderkey,l_linenumber,l_partkey,l_extendedprice,l_suppkey) as rn
            from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey) t) p
group by symbol, date"""
HOURLY = """
select symbol, ts, min_by(px,rn) as open, max(px) as high, min(px) as low, max_by(px,rn) as close, round(sum(v),2) as volume
from (select symbol, date_trunc('hour', t) as ts, v, rn, round(1000*exp(sum(st) over (partition by symbol order by rn rows between unbounded preceding and current row)*1e-3),2) as px
      from (select symbol, cast(ts as timestamp) as t, value as v, cast(round(value*100) as bigint)%11-5 as st,
                   row_number() over (partition by event_type order by ts, event_id) as rn
            from events join (select event_type, cast(dense_rank() over (order by event_type) - 1 as int) as symbol from (select distinct event_type from events) k) k using (event_type)) e) p
group by symbol, ts"""
#: Half-hours: the walk of HOURLY, cut at every thirty minutes.
HALF_HOURLY = HOURLY.replace("date_trunc('hour', t)", "date_trunc('hour', t) + case when minute(t) >= 30 then interval '30' minute else interval '0' minute end")
#: Days of the same walk.
EVENT_DAILY = HOURLY.replace("date_trunc('hour', t)", "cast(t as date)").replace("symbol, ts, min_by", "symbol, ts as date, min_by").replace("as volume", "as volume, round(sum(v),2) as amount")
FUNDING = "select cast(o_orderdate as date) as date, round(sum(o_totalprice),2) as balance from orders group by 1"
INSTRUMENTS = "select s_suppkey as symbol, s_name as name, r_name as industry from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey"
TABLES = ("lineitem", "supplier", "nation", "region", "orders", "events")


def derive(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The table that a text above gives over the parquet tables of a folder."""
    used = [t for t in TABLES if t in text]
    return spark.sql(text.replace("{", "{{").replace("}", "}}") if not used else _named(text, used), **{f"_{t}": spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


_INDEX_TICKS = """
select cast(n_regionkey as int) as symbol, cast(l_shipdate as date) as day, l_quantity as q, cast(round(l_discount*100) as int)-5 as st, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_suppkey
from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey"""
_EVENT_TICKS = """
select k.symbol, cast(ts as date) as day, cast(ts as timestamp) as t, value as v, cast(round(value*100) as bigint)%11-5 as st, ts, event_id
from events join (select event_type, cast(dense_rank() over (order by event_type) - 1 as int) as symbol from (select distinct event_type from events) k) k using (event_type)"""


#: Ticks that a task sorts: some 50 MB of rows.
TASK_TICKS = 500_000


def walked(ticks: DataFrame, order: tuple[str, ...], rows: int | None = None) -> DataFrame:
    """ticks (symbol, day, st, ...) with rn, their place within the day, and walk, the sum of st up to each in the series.

    A series may be a fifth of its table, so none is sorted as a whole: sums of days give what a day starts from, and each
    day's ticks are sorted apart. Sums of integers are exact, so this is the one running sum of a series. With the number of
    rows, days are dealt to so many tasks that what one reads doesn't grow with the table.
    """
    # Of the ticks as they lie: a task leaves a row a day, so only these are exchanged.
    days = ticks.groupBy("symbol", "day").agg(F.sum("st").alias("_total"))
    if rows is not None:
        least = int(ticks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ticks = ticks.repartition(max(least, -(-rows // TASK_TICKS)), "symbol", "day")
    w = Window.partitionBy("symbol", "day").orderBy(*order)
    ahead = Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(F.col("symbol").alias("_symbol"), F.col("day").alias("_day"), F.sum("_total").over(ahead).alias("_before"))
    within = ticks.withColumns({"rn": F.row_number().over(w), "_within": F.sum("st").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    out = within.join(F.broadcast(days), F.col("symbol").eqNullSafe(F.col("_symbol")) & F.col("day").eqNullSafe(F.col("_day")))
    walk = F.coalesce(F.col("_before") + F.col("_within"), "_before", "_within")
    return out.withColumn("walk", walk).drop("_symbol", "_day", "_before", "_within")


def _rows(spark: SparkSession, sf_dir: str, table: str) -> int:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


def _walk_bars(ticks: DataFrame, by: list[str], *sums: Column) -> DataFrame:
    rows = ticks.withColumn("px", F.expr("round(1000*exp(walk*1e-3),2)"))
    return rows.groupBy(*by).agg(F.min_by("px", "rn").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "rn").alias("close"), *sums)


_DAY_TICKS = "select l_suppkey as symbol, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity as q, cast(round(l_discount*100) as int)-5 as st from lineitem"


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of DAILY, from one exchange of the ticks by symbol: their places and running sums share a sort."""
    order = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    w = Window.partitionBy("symbol").orderBy(*order)
    walk = F.sum("st").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = derive(spark, sf_dir, _DAY_TICKS).select("symbol", F.col("l_shipdate").cast("date").alias("date"), "q", F.row_number().over(w).alias("rn"), walk.alias("walk"))
    rows = rows.withColumn("px", F.expr("round(100*exp(walk*4e-3),2)"))
    return rows.groupBy("symbol", "date").agg(
        F.min_by("px", "rn").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "rn").alias("close"),
        F.sum("q").alias("volume"), F.round(F.sum(F.col("q") * F.col("px")), 2).alias("amount"),
    )


def index_daily(spark: SparkSession, sf_dir: str, only: int | None = None) -> DataFrame:
    """The table of INDEX_DAILY, or its rows of one symbol."""
    text = _INDEX_TICKS if only is None else f"{_INDEX_TICKS} where n_regionkey = {only}"
    ticks = walked(derive(spark, sf_dir, text), ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_suppkey"), _rows(spark, sf_dir, "lineitem"))
    bars = _walk_bars(ticks, ["symbol", "day"], F.sum("q").alias("volume"), F.round(F.sum(F.col("q") * F.col("px")), 2).alias("amount"))
    return bars.withColumnRenamed("day", "date")


def half_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of HALF_HOURLY."""
    ticks = walked(derive(spark, sf_dir, _EVENT_TICKS), ("ts", "event_id"), _rows(spark, sf_dir, "events"))
    ticks = ticks.withColumn("half", F.expr("date_trunc('hour', t) + case when minute(t) >= 30 then interval '30' minute else interval '0' minute end"))
    # A half-hour lies in one day, so its ticks stay in the day's task.
    bars = _walk_bars(ticks, ["symbol", "day", "half"], F.round(F.sum("v"), 2).alias("volume"))
    return bars.drop("day").withColumnRenamed("half", "ts")


def _named(text: str, tables: list[str]) -> str:
    import re

    return re.sub(rf"\b({'|'.join(tables)})\b", r"{_\1}", text)
