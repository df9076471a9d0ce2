"""Sinks: calibration documents, evaluation reports, scan results and a guarded funding cache."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.functions.windows import KEY

CALIBRATION_AGE, CACHE_SHARE = timedelta(hours=24), 0.8


def write_calibration(documents: DataFrame, path: str) -> None:
    """One nested JSON document a symbol, in a folder of its own; symbols that are written again are replaced.

    documents: symbol, model_version, generated_at and the document's fields.
    """
    documents.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(KEY).json(path)


def read_calibration(spark: SparkSession, path: str, schema, model_version: str, now: datetime) -> DataFrame:
    """Documents of this model version that are younger than a day; the symbol's folder prunes the scan."""
    rows = spark.read.schema(schema).json(path)
    return rows.where((F.col("model_version") == model_version) & (F.col("generated_at") > F.lit(now - CALIBRATION_AGE)) & (F.col("generated_at") <= F.lit(now)))


def write_evaluation(metrics: DataFrame, points: DataFrame, path: str, run: str) -> None:
    """Metrics as JSON and the flat point-in-time rows as CSV under the run's name, and both again under latest."""
    for name in (run, "latest"):
        metrics.write.mode("overwrite").json(f"{path}/{name}/metrics")
        points.write.mode("overwrite").option("header", True).csv(f"{path}/{name}/points")


def write_scan(scored: DataFrame, path: str) -> None:
    """Replace the whole result set."""
    scored.write.mode("overwrite").parquet(path)


def read_scan(spark: SparkSession, path: str, strategy: str | None = None) -> DataFrame:
    """The result set, or the rows that pass one strategy."""
    rows = spark.read.parquet(path)
    return rows if strategy is None else rows.where(F.array_contains("strategies", strategy))


def write_funding_cache(funding: DataFrame, path: str, now: datetime) -> None:
    funding.withColumn("written_at", F.lit(now)).write.mode("overwrite").parquet(path)


def read_funding_cache(spark: SparkSession, path: str, wanted: int, now: datetime, most_age: timedelta = CALIBRATION_AGE) -> DataFrame | None:
    """The cached series, or None if it is older than most_age or shorter than 0.8 of what is wanted."""
    try:
        rows = spark.read.parquet(path)
    except Exception as e:  # a missing path is an ordinary miss
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    n, at = rows.agg(F.count(F.lit(1)), F.max("written_at")).head()
    return rows.drop("written_at") if n >= CACHE_SHARE * wanted and at is not None and now - at <= most_age else None
