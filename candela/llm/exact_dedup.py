"""Exact dedup with two-pass Bloom filtering (DataFrame functions only).

Pass 1 hashes every row and counts hits on two cells per hash, which is all that leaves its task (a count a cell); cells
hit twice or more form a Bloom filter of possibly repeated hashes. Pass 2 probes it by broadcast: a row whose hash is
certainly alone passes straight through; only the others shuffle to be counted exactly. The filter is sized from the
number of rows, up to MOST_BITS; a full one only makes more rows shuffle, and results never depend on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.llm._shared import bloom, join_groups, maybe_in, stored

#: Bits for each row, and at most: 128 MB of bitmaps, which serve up to about 134 million texts.
ROW_BITS, MOST_BITS = 8, 1 << 30
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """text with A-Z alone in lower case (null: empty). Texts of ASCII alone take lower(), which is faster."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def filter_size(rows: int) -> int:
    """Bits of a filter for so many rows: a power of two."""
    return min(MOST_BITS, 1 << max(16, (ROW_BITS * rows - 1).bit_length()))


def annotate_copies(
    df: DataFrame, content: Column, id_col: str, keep: str = "max", carry: tuple[str, ...] = (), filter_bits: int | None = None
) -> DataFrame:
    """One row per row of df: _id, _row (struct of the carried columns, null if none), sha256, keep_id, group_size, kept.

    content: string or binary column; rows are copies if its bytes are equal. Of copies, the row with the largest
    (keep="max") or smallest id is kept; rows that repeat this id too are told apart, so exactly one is kept. Null ids
    lose to any other; keep_id is null only if all ids of a group are null. An empty table gives an empty result.
    """
    row = F.struct(*(df[c] for c in carry)) if carry else F.lit(None).cast("string")
    base = df.select(df[id_col].alias("_id"), F.sha2(content.cast("binary"), 256).alias("sha256"), row.alias("_row"))
    base = stored(base.withColumn("_rid", F.monotonically_increasing_id()), "digests")
    filter_bits = filter_bits or filter_size(base.count())
    hashed = F.xxhash64("sha256")
    repeated = bloom(base, hashed, filter_bits, least=2, name="repeated")
    probed = maybe_in(base, hashed, repeated, filter_bits, "_maybe")
    alone, maybe = probed.where(~F.col("_maybe")), probed.where("_maybe").drop("_maybe")
    # Null ids sort below all others for max; for min the flag puts them last.
    rank = F.struct(F.col("_id").isNotNull().alias("has"), "_id", "_rid") if keep == "max" else F.struct(F.col("_id").isNull().alias("has"), "_id", "_rid")
    groups = maybe.groupBy("sha256").agg((F.max if keep == "max" else F.min)(rank).alias("_best"), F.count(F.lit(1)).alias("group_size"))
    groups = stored(groups.select("sha256", F.col("_best._id").alias("keep_id"), F.col("_best._rid").alias("_keep_rid"), "group_size"), "copies")
    counted = join_groups(maybe, groups, "sha256", "group_size", "inner").withColumn("kept", F.col("_rid") == F.col("_keep_rid"))
    columns = ["_id", "_row", "sha256", "keep_id", "group_size", "kept"]
    single = alone.withColumns({"keep_id": F.col("_id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    return single.select(columns).unionByName(counted.select(columns))


def exact_dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", filter_bits: int | None = None) -> DataFrame:
    """The rows of df that stay (largest id of each group of texts equal but for the case of A-Z), its columns alone.

    Nulls in any column are kept as they are; a null text equals an empty one, and a null id loses to any other. Of rows
    that repeat the largest id too, one stays. Texts are compared whole by SHA-256. An empty table gives an empty result.

    df is read twice and never stored: rows that are certainly alone keep their place, of the others each task sends one
    candidate for a text on.
    """
    names = [f"_c{i}" for i in range(len(df.columns))]
    row = F.struct(*(df[c].alias(n) for c, n in zip(df.columns, names)))
    rows = df.select(row.alias("_row"), df[id_col].alias("_id"), F.sha2(lower_ascii(df[text_col]).cast("binary"), 256).alias("sha256"))
    filter_bits = filter_bits or filter_size(df.count())
    hashed = F.xxhash64("sha256")
    probed = maybe_in(rows, hashed, bloom(rows, hashed, filter_bits, least=2, name="repeated"), filter_bits, "_maybe")
    best = probed.where("_maybe").groupBy("sha256").agg(F.max_by("_row", F.struct(F.col("_id").isNotNull(), "_id")).alias("_row"))
    kept = probed.where(~F.col("_maybe")).select("_row").unionByName(best.select("_row"))
    return kept.select(*(F.col(f"_row.{n}").alias(c) for c, n in zip(df.columns, names)))


def exact_dedup_report(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", filter_bits: int | None = None) -> DataFrame:
    """One row per row of df: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Only digests are stored. Of rows that repeat the largest id of a text, one is kept.
    """
    out = annotate_copies(df, lower_ascii(df[text_col]), id_col, filter_bits=filter_bits)
    return out.select(F.col("_id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = f"""
with t as (select doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) as text_sha256 from documents)
select doc_id, max(doc_id) over (partition by text_sha256) as keep_id,
       count(*) over (partition by text_sha256) as group_size,
       row_number() over (partition by text_sha256 order by doc_id desc nulls last) = 1 as kept, text_sha256
from t
"""
