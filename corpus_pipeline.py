"""A training corpus from `documents`, in stages that each write and reread Parquet.

Quality classifier, exact dedup, near-dedup, mixing of sources, BPE. Each stage works on all that the one before
kept; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from candela.llm._shared import stored
from candela.llm.bpe import bpe_report, tokenizer_path
from candela.llm.exact_dedup import exact_dedup
from candela.llm.mixing import mix_documents, unpack
from candela.llm.near_copies import near_copy_dedup
from candela.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from labels of rows that are not held out."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard similarity of 5-word shingles 0.8 or more) the row with the smallest id stays."""
    return near_copy_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the tempered source, language and topic shares."""
    mixed = mix_documents(docs)
    return mixed.where("sampled").select(*unpack(mixed, docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document.

    Workers outlive stages, and here hold what earlier ones left, so this one remembers less than op7 alone does.
    """
    return bpe_report(docs, tokenizer_path(), memory=1 << 16)


STAGES = [("quality", quality), ("exact_dedup", exact), ("simhash_dedup", near), ("mixing", mixing), ("bpe", encode)]

#: The classifier and the encoder have no SQL form; the tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
