"""Streaming bars: ticks to closed bars, live snapshots merged into history, newest quotes and the daily job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from candela.functions.windows import KEY

OHLC = ("open", "high", "low", "close")


def stream_bars(ticks: DataFrame, bucket: str = "1 hour", late: str = "1 hour", order: str = "tick") -> DataFrame:
    """Closed bars of a tick stream (symbol, ts, tick, price, volume); also runs on a batch.

    In append mode a bar is given once its window lies behind the watermark, so unfinished bars never appear; ticks later
    than `late` are dropped. State holds one row for each symbol and open window.
    """
    w = F.window("ts", bucket)
    bars = ticks.withWatermark("ts", late).groupBy(KEY, w.alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"),
    )
    return bars.select(KEY, F.col("w.start").alias("ts"), *OHLC, "volume")


def merge_live_bar(history: DataFrame, snapshot: DataFrame) -> DataFrame:
    """History with one live snapshot row a symbol merged in; a snapshot older than the last bar changes nothing.

    Same date: close replaced, high and low widened, volume, amount and turnover taken if above 0, change replaced. Newer
    date: appended unless its volume is 0, high and low widened by the close. Snapshots with a price of 0 or less, or none,
    are ignored. merged tells the rows that the snapshot made or changed.
    """
    valid = snapshot
    for c in OHLC:
        valid = valid.where(F.col(c) > 0)
    last = history.groupBy(KEY).agg(F.max("date").alias("_last"))
    live = valid.join(last, KEY, "left")
    same, newer = live.where(F.col("date") == F.col("_last")), live.where((F.col("date") > F.col("_last")) | F.col("_last").isNull())
    changed = same.select(KEY, "date", *(F.col(c).alias(f"_{c}") for c in snapshot.columns if c not in (KEY, "date")))
    rows = history.join(changed, [KEY, "date"], "left").withColumn("merged", F.col("_close").isNotNull())
    rows = rows.withColumns({"high": F.greatest("high", "_high", "_close"), "low": F.least("low", "_low", "_close"), "close": F.coalesce("_close", "close")})
    for c in ("volume", "amount", "turnover"):
        if c in history.columns and c in snapshot.columns:
            rows = rows.withColumn(c, F.when(F.col(f"_{c}") > 0, F.col(f"_{c}")).otherwise(F.col(c)))
    if "change_pct" in history.columns and "change_pct" in snapshot.columns:
        rows = rows.withColumn("change_pct", F.coalesce("_change_pct", "change_pct"))
    appended = newer.where(F.col("volume") > 0).withColumns({"high": F.greatest("high", "close"), "low": F.least("low", "close"), "merged": F.lit(True)})
    return rows.select(*history.columns, "merged").unionByName(appended.select(*[c for c in history.columns if c in appended.columns], "merged"), allowMissingColumns=True)


def newest(snapshots: DataFrame, by: str = "ts") -> DataFrame:
    """The newest snapshot of each symbol: batch, or a stream in update or complete mode (one row of state a symbol)."""
    rest = [c for c in snapshots.columns if c != KEY]
    return snapshots.groupBy(KEY).agg(F.max_by(F.struct(*rest), by).alias("_r")).select(KEY, "_r.*")


def daily_job(bars: DataFrame, path: str, checkpoint: str, job) -> StreamingQuery:
    """Run job(rows of a date) for every date that has had rows since the last run; its result has one folder a date.

    bars: a stream with a column date. Its rows are kept beside the result, by date and batch, and a date that gets more of
    them is computed again from all it has, so no batch pushes out another's. A repeated batch writes the same folders
    again. Rows without a date count as a date of their own. The timer is outside.
    """
    inbox, kinds = f"{path.rstrip('/')}-rows", bars.schema
    overwrite = lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")

    def once(batch: DataFrame, batch_id: int) -> None:
        overwrite(batch.withColumn("_batch", F.lit(batch_id))).partitionBy("date", "_batch").parquet(inbox)
        held = batch.sparkSession.read.schema(StructType([*kinds, StructField("_batch", LongType())])).parquet(inbox)
        touched = held.where(F.col("_batch") == batch_id).select(F.col("date").alias("_date")).distinct()
        rows = held.join(touched, F.col("date").eqNullSafe(F.col("_date")), "left_semi")
        overwrite(job(rows.select(*batch.columns))).partitionBy("date").parquet(path)

    return bars.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedupe_snapshots(snapshots: DataFrame, by: str = "ts") -> DataFrame:
    """Of several snapshots of a symbol and date, the newest (batch)."""
    w = Window.partitionBy(KEY, "date").orderBy(F.desc(by))
    return snapshots.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")
