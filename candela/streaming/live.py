"""Live snapshots merged into a bar history by a stream, touching only the months they fall into.

A history is a folder: `bars`, Parquet by month, and `series`, one row a symbol with its last date and provenance, in two
copies by turns. Each micro-batch reads the copy of its turn, rewrites the months of the rows it takes, and writes the
other copy. A batch that runs again finds the same copy and gives the same rows, so it changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from candela.functions.tables import stored
from candela.functions.windows import KEY
from candela.streaming.bars import OHLC

#: Provenance of a series that a live snapshot has changed, if it was a reliable one (status/basis).
MIXED, RELIABLE = "unknown/mixed", "reliable/"
TAKEN = ("volume", "amount", "turnover")


def _months(bars: DataFrame) -> DataFrame:
    return bars.withColumn("month", F.date_format("date", "yyyy-MM"))


def create_history(bars: DataFrame, path: str) -> None:
    """Lay down a history of bars (symbol, date, prices, volume, ...); a column provenance becomes one of the series.

    A series whose bars have several provenances, or none, is unknown.
    """
    spare = bars.drop("provenance")
    _months(spare).repartition("month").write.partitionBy("month").parquet(f"{path}/bars")
    tag = F.when((F.count_distinct("provenance") == 1) & (F.count("provenance") == F.count(F.lit(1))), F.min("provenance")) if "provenance" in bars.columns else F.lit(None).cast("string")
    bars.groupBy(KEY).agg(F.max("date").alias("last"), F.coalesce(tag, F.lit("unknown/unknown")).alias("provenance")).write.parquet(f"{path}/series/0")


def read_history(spark: SparkSession, path: str, turn: int) -> DataFrame:
    """The bars, each with its series' provenance after `turn` micro-batches."""
    return spark.read.parquet(f"{path}/bars").drop("month").join(spark.read.parquet(f"{path}/series/{turn % 2}").select(KEY, "provenance"), KEY)


def merge_batch(snapshots: DataFrame, path: str, batch: int) -> None:
    """Merge snapshots (symbol, date, ts, prices, volume, ...) into the history, as micro-batch number `batch`.

    Of several of a symbol and date the newest counts. Those without four prices above 0, or older than the series' last
    date, change nothing. On the last date: close replaced, high and low widened, volume, amount and turnover taken if
    above 0. On later dates: a new bar each if its volume is above 0; an amount it lacks is volume times close. A series
    that a snapshot has changed is no longer of reliable provenance.
    """
    spark = snapshots.sparkSession
    bars, series = spark.read.parquet(f"{path}/bars"), spark.read.parquet(f"{path}/series/{batch % 2}")
    fields = [c for c in snapshots.columns if c not in (KEY, "date")]
    newest = snapshots.groupBy(KEY, "date").agg(F.max_by(F.struct(*fields), "ts").alias("_r")).select(KEY, "date", "_r.*").drop("ts")
    for c in OHLC:
        newest = newest.where(F.col(c) > 0)
    live = newest.join(series.select(KEY, "last"), KEY, "left").withColumn("_new", F.col("last").isNull() | (F.col("date") > F.col("last")))
    live = live.where((F.col("_new") & (F.col("volume") > 0)) | (F.col("date") == F.col("last"))).drop("last")
    live = stored(_months(live), "live")
    months = live.select("month").distinct()
    part = bars.join(F.broadcast(months), "month", "left_semi")  # months of one batch: a few rows
    of = lambda c: F.col(f"s.{c}")
    both = part.alias("b").join(live.alias("s"), [KEY, "date"], "left").where(~F.coalesce(of("_new"), F.lit(False)))
    known = [c for c in part.columns if c not in (KEY, "date", "month")]
    change = {"high": F.greatest("b.high", of("high"), of("close")), "low": F.least("b.low", of("low"), of("close")), "close": F.coalesce(of("close"), "b.close")}
    for c in known:
        if c in fields and c not in OHLC:
            change[c] = F.coalesce(F.when(of(c) > 0, of(c)) if c in TAKEN else of(c), F.col(f"b.{c}"))
    kept = both.select(KEY, "date", *(change.get(c, F.col(f"b.{c}")).alias(c) for c in known), F.col("b.month").alias("month"))
    new = live.where("_new").withColumns({"high": F.greatest("high", "close"), "low": F.least("low", "close")})
    if "amount" in fields:
        new = new.withColumn("amount", F.coalesce(F.when(F.col("amount") > 0, F.col("amount")), F.col("volume") * F.col("close")))
    merged = kept.unionByName(new.select(*(c for c in kept.columns if c in new.columns)), allowMissingColumns=True)
    stored(merged, "months").repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(f"{path}/bars")
    moved = live.groupBy(KEY).agg(F.max("date").alias("_to"))
    after = series.join(moved, KEY, "full")
    mixed = F.col("_to").isNotNull() & F.coalesce(F.col("provenance").startswith(RELIABLE), F.lit(False))
    after = after.select(KEY, F.greatest("last", "_to").alias("last"), F.when(mixed, MIXED).otherwise(F.coalesce("provenance", F.lit("unknown/unknown"))).alias("provenance"))
    after.write.mode("overwrite").parquet(f"{path}/series/{(batch + 1) % 2}")


def merge_stream(snapshots: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Merge each micro-batch of a stream of snapshots into the history under path; runs to the end of what is there."""
    merge = lambda batch, number: merge_batch(batch, path, number)
    return snapshots.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
