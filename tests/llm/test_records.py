"""WARC round trips, sharding, mixing and neighbours."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from candela.llm import ann, mixing, sharding, warc
from candela.llm._shared import shared_path
from tests.conftest import DATA


def round_trip(spark, df, chunk):
    return warc.read_warc(warc.write_warc(warc.chunked(warc.with_revisits(df), chunk), shared_path(spark, "test")))


def test_warc_round_trip(spark):
    big = "héllo wörld" * 60_000
    rows = [(1, "u", big), (2, "u\r\nX: y", big), (3, None, "x" * 100), (4, "u", "x" * 100), (5, "u", "x" * 99), (6, "u", "x" * 99), (7, "u", None), (8, "u", ""), (None, "u", big), (1, "v", big)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, kept string, sha256 int")
    parts = {}
    for r in round_trip(spark, df, 1 << 16).collect():
        parts.setdefault((r.archive, r.record_id), []).append(r)
    assert len(parts) == len(rows)
    for chunks in parts.values():
        chunks.sort(key=lambda r: r.chunk_no)
        assert [r.chunk_no for r in chunks] == list(range(len(chunks))) and [r.last for r in chunks] == [False] * (len(chunks) - 1) + [True]
        digest, seen = hashlib.sha256(), 0
        for r in chunks:
            digest.update(r.chunk)
            seen += len(r.chunk)
            assert (r.bytes_so_far, r.sha256_so_far) == (seen, digest.hexdigest()) and len(r.chunk) <= warc.CHUNK
    last = [c[-1] for c in parts.values()]
    kinds = sorted(((r.page_id or 0), r.record_type, r.refers_to or 0, r.payload_bytes) for r in last)
    size = len(big.encode())
    assert kinds == sorted([(1, "response", 0, size), (1, "revisit", 1, size), (2, "revisit", 1, size), (0, "revisit", 1, size), (3, "response", 0, 100), (4, "revisit", 3, 100), (5, "response", 0, 99), (6, "response", 0, 99), (7, "response", 0, 0), (8, "response", 0, 0)])
    whole = next(c for c in parts.values() if c[0].page_id == 1 and c[0].record_type == "response")
    assert len(whole) > 1 and b"".join(r.chunk for r in whole).decode() == big


def test_warc_empty_table(spark):
    assert round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string"), 100).count() == 0


def test_lookup_table_fills_by_turns():
    shards = tuple("abcdefg")
    table = sharding.fill_table(shards, 97)
    left = {s: [(sharding._hash("offset", s) + j * (sharding._hash("skip", s) % 96 + 1)) % 97 for j in range(97)] for s in shards}
    want, k = {}, 0
    while len(want) < 97:
        s = shards[k % 7]
        slot = next(x for x in left[s] if x not in want)
        want[slot] = k % 7
        k += 1
    assert table == [want[i] for i in range(97)]
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1


def test_losing_a_shard_moves_few_keys():
    before, after = (sharding.fill_table(sharding.SHARDS[:n], sharding.SLOTS) for n in (16, 15))
    assert sum(a != b for a, b in zip(before, after) if a != 15) / sharding.SLOTS < 0.15
    with pytest.raises(ValueError):
        sharding.fill_table(("a", "b"), 100)


def test_shards_of_keys(spark):
    df = spark.createDataFrame([(1, "x", "y"), (1, "x", "y"), (None, None, None)], "doc_id long, slot string, shard string")
    got = sharding.assign_shards(df, F.col("doc_id")).collect()
    assert len(got) == 3 and all(r.shard in sharding.SHARDS for r in got) and len({(r.doc_id, r.shard) for r in got}) == 2
    assert sharding.assign_shards(df.limit(0), F.col("doc_id")).count() == 0


def test_raking_meets_the_marginals():
    rng = random.Random(3)
    mass = {(f"s{i}", f"l{j}", f"t{k}"): rng.random() * 100 + 1 for i in range(6) for j in range(3) for k in range(4)}
    targets = mixing.tempered(mass)
    raked = mixing.rake(mass, targets)
    total = sum(mass.values())
    for k, dim in enumerate(mixing.DIMS):
        for c, share in targets[dim].items():
            assert sum(m for cell, m in raked.items() if cell[k] == c) == pytest.approx(share * total, rel=1e-6)
    got = mixing.calibrate(mass, raked, 0.6 * total)
    assert sum(mass[c] * p for c, (_, p) in got.items()) == pytest.approx(0.6 * total)
    assert max(p for _, p in got.values()) <= 1
    assert all(p == pytest.approx(1) for _, p in mixing.calibrate(mass, raked, total).values())


def test_mixing_edges(spark):
    rows = [(1, None, None, None, "x"), (1, None, None, None, "x"), (None, "", "en", "s", None), (3, "word " * 50_000, "en", "s", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, weight string")
    mixed = mixing.mix_documents(df)
    got = mixed.select(*mixing.unpack(mixed, df.columns), "tokens", "probability", "sampled").collect()
    assert len(got) == 4 and all(0 <= r.probability <= 1 and r.tokens >= 1 for r in got)
    assert mixing.mix_documents(df.limit(0)).count() == 0


def test_walk_gathers_the_nearest_pairs():
    rng = np.random.default_rng(1)
    for _ in range(100):
        a, b = rng.normal(size=5), rng.normal(size=7)
        held = rng.integers(0, 4, (5, 7))
        need = int(rng.integers(1, held.sum() + 3))
        sums = (a[:, None] + b).ravel()
        order = np.argsort(sums)
        enough = np.flatnonzero(np.cumsum(held.ravel()[order]) >= need)
        assert ann.walk(a, b, held, need) == pytest.approx(sums[order][enough[0] if len(enough) else -1])


def brute(x, ids, q, k=20):
    s = (x * x[q]).sum(1)
    s[ids == ids[q]] = -np.inf
    return ids[np.lexsort((ids, -s))[:k]]


def test_recall(spark):
    pdf = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet").toPandas()
    x, ids = np.stack(pdf["embedding"]).astype(float), pdf["vec_id"].to_numpy()
    got = ann.op10_neighbours(spark, f"{DATA}/sf0.1").toPandas().groupby("query_id")["vec_id"].apply(list)
    asked = np.flatnonzero(ids % 20 == 0)
    assert len(got) == len(asked)
    assert np.mean([len(set(brute(x, ids, q)) & set(got[ids[q]])) / 20 for q in asked]) >= 0.9


def test_neighbour_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (8, [1.0]), (20, [0.5, 0.5]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, "s") for r in rows], "vec_id long, embedding array<double>, score string")
    got = ann.neighbours(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(got)] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 1, 0.5), (20, 3, 2, 0.5)]
    assert ann.neighbours(df.limit(0), "vec_id", "embedding", F.lit(True)).collect() == []
