"""Shared folder, package shipping, Bloom filters and skew-safe joins for this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.functions.tables import shared_path, stored

__all__ = ["bloom", "join_groups", "maybe_in", "shared_path", "ship", "stored"]

#: A group that holds more than 1/HOT_PARTS of the rows is hot, so there are at most HOT_PARTS hot groups.
HOT_PARTS = 256
#: Rows of one bitmap of a Bloom filter: the built-in bitmap functions use 4,096 bytes.
BITMAP_BITS = 1 << 15
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 512


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once for each application, and whole texts in small batches.

    The batch size is changed only where it has its default: 10,000 long documents at once would fill a worker's memory.
    """
    if spark.conf.get(BATCH_SETTING) == "10000":
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_candela_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    to = os.path.join(tempfile.mkdtemp(prefix="candela-"), f"candela_{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"candela/{p.relative_to(root)}")
    sc.addPyFile(to)
    sc._candela_shipped = True


# Bloom filters as rows (bucket, bits): 4,096-byte bitmaps, so m bits take m/8 bytes at most, whatever the input.


def _cells(hashed: Column, bits: int) -> tuple[Column, Column]:
    """Two cells in [0, bits) of a 64-bit hash; bits is a power of two up to 2**31."""
    return hashed.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(hashed, 32).bitwiseAND(F.lit(bits - 1))


def _bitmaps(cells: DataFrame) -> DataFrame:
    """cells: distinct values in column cell."""
    bucket, place = F.shiftright("cell", 15), F.col("cell").bitwiseAND(F.lit(BITMAP_BITS - 1))
    return cells.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(place).alias("bits"))


def bloom(keys: DataFrame, hashed: Column, bits: int, least: int = 1, name: str = "bloom") -> DataFrame:
    """Bloom filter of the hashes that occur, or (least=2) whose two cells were both hit twice or more."""
    hit = keys.select(F.explode(F.array(*_cells(hashed, bits))).alias("cell")).groupBy("cell")
    cells = hit.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("cell")
    return stored(_bitmaps(cells), name)


def maybe_in(df: DataFrame, hashed: Column, filter_: DataFrame, bits: int, flag: str) -> DataFrame:
    """df with a boolean column: false where the hash is certainly not in the filter. The filter is broadcast."""
    out = df.withColumn("_bf_hash", hashed)
    held = []
    for i, cell in enumerate(_cells(F.col("_bf_hash"), bits)):
        one = filter_.select(F.col("bucket").alias(f"_bf_bucket{i}"), F.col("bits").alias(f"_bf_bits{i}"))
        out = out.withColumn(f"_bf_cell{i}", cell).withColumn(f"_bf_bucket{i}", F.shiftright(f"_bf_cell{i}", 15))
        out = out.join(F.broadcast(one), f"_bf_bucket{i}", "left")
        place = F.col(f"_bf_cell{i}").bitwiseAND(F.lit(BITMAP_BITS - 1))
        byte = F.conv(F.hex(F.substr(F.col(f"_bf_bits{i}"), (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
        held.append(F.coalesce(F.getbit(byte, place.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False)))
    return out.withColumn(flag, held[0] & held[1]).drop(*(f"_bf_{x}{i}" for i in (0, 1) for x in ("bucket", "bits", "cell")), "_bf_hash")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, weight: str, how: str = "left", parts: int = HOT_PARTS) -> DataFrame:
    """rows joined with groups (one row a key; weight: how many of the rows have it), whatever the skew.

    Keys with over 1/parts of the weight are parts at most, so they are broadcast; the others are shuffled.
    """
    total = groups.agg(F.sum(weight)).head()[0] or 0
    floor = max(2, total // parts + 1)
    hot = F.broadcast(groups.where(F.col(weight) >= floor))
    rest = rows.join(hot.select(key), key, "left_anti").join(groups.where(F.col(weight) < floor), key, how)
    return rows.join(hot, key).unionByName(rest)
