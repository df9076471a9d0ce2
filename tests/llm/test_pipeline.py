"""Registered queries against their SQL, and the pipeline against a plain version of each stage."""

import hashlib

import duckdb
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from candela.llm import bpe, mixing, quality, registry  # noqa: E402
from tests.llm.test_dedup import lower  # noqa: E402
from tests.llm.test_near_copies import plain_kept  # noqa: E402


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = registry.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    clean = lambda rows: sorted(map(str, rows))
    want = con.sql(f"select {', '.join(columns)} from ({registry.ORACLE_SQL[name]}) q").fetchall()
    assert clean(tuple(r[c] for c in columns) for r in got.collect()) == clean(want)


def test_stages_against_plain_versions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, docs
    stage = dict(corpus_pipeline.STAGES)
    good = {r.doc_id for r in quality.op8_quality(spark, sf).collect() if r.predicted}
    kept = stage["quality"](spark, kept, sf)
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == good

    rows = kept.collect()
    best = {}
    for r in rows:
        best[lower(r.text)] = max(best.get(lower(r.text), -1), r.doc_id)
    kept = stage["exact_dedup"](spark, kept, sf)
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == set(best.values())

    want = plain_kept([(r.doc_id, r.text) for r in kept.collect()])
    kept = stage["simhash_dedup"](spark, kept, sf)
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == want

    mixed = mixing.mix_documents(kept)
    drawn = {r.doc_id for r in mixed.where("sampled").select(*mixing.unpack(mixed, columns)).collect()}
    kept = stage["mixing"](spark, kept, sf)
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == drawn

    library = Tokenizer.from_file(bpe.tokenizer_path())
    want = {r.doc_id: hashlib.sha256(" ".join(map(str, library.encode(r.text or "", add_special_tokens=False).ids)).encode()).hexdigest() for r in kept.collect()}
    assert {r.doc_id: r.ids_sha256 for r in stage["bpe"](spark, kept, sf).collect()} == want
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf).collect()} == want


def test_stages_on_odd_and_empty_tables(spark, sf):
    rows = [(1, None, None, None, None, "a"), (1, None, None, None, None, "a"), (None, "", "en", "s", 0, "b"), (3, "word " * 20_000, "en", "s", 9, None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, sf).columns == odd.columns
        assert stage(spark, odd, sf).count() <= 4 and stage(spark, odd.limit(0), sf).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, odd, sf).count() == 4
