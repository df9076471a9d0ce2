"""Exact dedup, SimHash near-dedup and the Bloom filter under them."""

import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from candela.llm import _shared, simhash
from candela.llm.exact_dedup import exact_dedup, exact_dedup_report

DOCS = "doc_id long, text string, lang string, kept string, _row string, sha256 long"


def rows_of(df, key=None):
    return sorted(map(tuple, df.collect()), key=key or (lambda r: tuple((x is None, str(x)) for x in r)))


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def docs(spark):
    rng = random.Random(1)
    texts = ["", None, "A b", "a B", "É x", "é x", "long " * 40_000, "LONG " * 40_000, "x\ny"]
    rows = [(i if rng.random() < 0.9 else None, rng.choice(texts), rng.choice(["en", None]), "k", None, i) for i in range(120)]
    rows += [(500, "tie", None, None, "r", 1), (500, "tie", None, None, "r", 1)]
    return spark.createDataFrame(rows, DOCS).repartition(5), rows


def test_report_against_plain_version(spark):
    df, rows = docs(spark)
    got = exact_dedup_report(df).collect()
    groups = {}
    for r in rows:
        groups.setdefault(lower(r[1]), []).append(r[0])
    assert len(got) == len(rows)
    for r in got:
        same = next(ids for t, ids in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(same)
        assert r.keep_id == max((i for i in same if i is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)


def test_dedup_keeps_one_row_of_each_text_and_its_columns(spark):
    df, rows = docs(spark)
    got = exact_dedup(df)
    assert got.columns == df.columns
    kept = got.collect()
    assert len(kept) == len({lower(r[1]) for r in rows}) == len({lower(r.text) for r in kept})


def test_full_filter_gives_the_same_result(spark):
    df, _ = docs(spark)
    small = exact_dedup_report(df, filter_bits=1 << 16)
    tiny = exact_dedup_report(df, filter_bits=2)
    assert rows_of(small.drop("kept")) == rows_of(tiny.drop("kept"))


def test_empty_tables(spark):
    df = spark.createDataFrame([], DOCS)
    assert exact_dedup(df).collect() == [] and exact_dedup_report(df).collect() == []
    assert simhash.near_dedup(df).collect() == [] and simhash.near_duplicates(df).collect() == []


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("h"))
    f = _shared.bloom(keys, F.col("h"), 1 << 20)
    assert _shared.maybe_in(keys, F.col("h"), f, 1 << 20, "m").where("not m").count() == 0
    others = spark.range(5000, 9000).select(F.xxhash64("id").alias("h"))
    assert _shared.maybe_in(others, F.col("h"), f, 1 << 20, "m").where("m").count() < 40


def test_join_groups_with_a_hot_key(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    got = _shared.join_groups(rows, groups, "k", "n", "inner")
    assert got.count() == 5000 and got.where("least > id").count() == 0


def plain_fingerprint(text, width=3):
    words = lower(text).encode().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", ["", None, "  \n", "one", "One two", "a b c", "É É x\x0by z", "a b c a b c " * 300, "w%d " * 70_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_of_a_text_over_a_block(monkeypatch):
    text = " ".join(f"w{i * i % 997}" for i in range(500))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text)


@pytest.mark.parametrize("paired", [32, 3])
def test_links_against_all_pairs(spark, monkeypatch, paired):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rng = random.Random(paired)
    centre, fps = rng.getrandbits(64), [0, 1, 3, 7, 1 << 63, (1 << 64) - 1]
    for _ in range(150):
        x = centre if rng.random() < 0.6 else rng.getrandbits(64)
        for _ in range(rng.randrange(5)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    fps = sorted(set(fps))
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    found = {r.fp: r.root for r in simhash.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()}
    got = [found.get(x, x) for x in signed]
    want = plain_components(fps)
    assert {frozenset(i for i, g in enumerate(got) if g == k) for k in got} == {frozenset(i for i, g in enumerate(want) if g == k) for k in want}


def test_near_dedup_on_documents(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(5, base), (3, base + " more"), (9, base.upper()), (4, "other " * 50), (None, base), (7, None), (8, ""), (8, "")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, fp string, component long")
    fps = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(fps)
    least = {}
    for (i, _), r in zip(rows, roots):
        least[r] = min(x for x in (least.get(r), i) if x is not None) if (least.get(r), i) != (None, None) else None
    want = sorted([(i, t) for (i, t), r in zip(rows, roots) if i is None or i == least[r]], key=str)
    got = simhash.near_dedup(df)
    assert got.columns == df.columns
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=str) == want
