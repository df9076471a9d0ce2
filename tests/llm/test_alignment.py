"""Alignment against a plain version that encodes whole texts, and the monoid's laws."""

import collections
import hashlib
import random
from functools import reduce

import public_tokenizers
import pytest

from candela.llm import alignment as A

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  two  spaces ", "\n\n a\n b", "tab\there", "▁a ▁", "x▁ y", "<s> </s> <unk> <|endoftext|> <0x41>", "日本語 テスト 😀 é ́", "a\x00b c", "don't I'll we've 'tis",
    "x" * 3000, "word " * 900, "ab cd ef  gh", "a\x1c b \x85 c", "a​ b ᠎ c﻿ d", "12 345 6.7, (8)", "end.\nNext, a|b don’t (x).\n\n Go\n", "été.\nÀ l'eau: naïve; œuf æ ß×÷", "x.y a,b 'quoted' e.g. I'm. we'll!", "ÉÊ!! ## ...", "\r\n x",
]


def plain(texts):
    """The contract, from whole texts."""
    aligner = A.Aligner(*PATHS)
    tokens = []
    for t in texts:
        a = aligner.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = aligner.b.encode(t) if t else []
        sides = [[of[i] for i in ids] for of, ids in ((aligner.bytes_a, a), (aligner.bytes_b, b))]
        tokens.append((a, b, *sides) if t and all(b"".join(s) == (" " + t).encode() for s in sides) else ([], [], [], []))
    links, digests = [], []
    for a, b, bytes_a, bytes_b in tokens:
        ends = []
        for ids, parts in ((a, bytes_a), (b, bytes_b)):
            at, out = 0, {}
            for i, p in zip(ids, parts):
                at += len(p)
                out.setdefault(at, []).append(i)
            ends.append(out)
        common = sorted(set(ends[0]) & set(ends[1]))
        links.append([(x, y) for e in common for x in ends[0][e] for y in ends[1][e]])
        groups, low = [], 0
        for e in common:
            groups.append("|".join(",".join(str(i) for at, ids in side.items() if low < at <= e for i in ids) for side in ends))
            low = e
        digests.append((len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    times = collections.Counter(p for ls in links for p in ls)
    most = {}
    for (_, b), n in times.items():
        most[b] = max(most.get(b, 0), n)
    return [(n_a, n_b, n_g, len(ls), sum(times[p] == most[p[1]] for p in ls), sum(times[p] for p in ls), sha) for (n_a, n_b, n_g, sha), ls in zip(digests, links)], times, most


def random_texts(n=120):
    rng = random.Random(6)
    alphabet = "abcdeth  \n.,'1é日😀\t▁ -"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 90))) for _ in range(n)]


def rows(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return {r[0]: tuple(r)[1:] for r in df.select(names).collect()}


@pytest.mark.parametrize("size", [1 << 16, 40, 3])
def test_whole_results(spark, size, monkeypatch):
    """Also with ranges of a few bytes, so that groups lie across them and several levels compose."""
    monkeypatch.setattr(A, "FAN_IN", 4)
    texts = ODD + random_texts()
    df = spark.createDataFrame([(k, t, k, "x") for k, t in enumerate(texts)], "doc_id long, text string, rid long, pairs string").repartition(3)
    want, times, most = plain(texts)
    per_text, pairs = A.align_tokenizers(df, *PATHS, size=size)
    got = rows(per_text)
    for k, t in enumerate(texts):
        assert got[k] == want[k], (k, t and t[:60])
    assert len(got) == len(texts)
    assert {((r.a_id, r.b_id), r.links, r.best) for r in pairs.collect()} == {(p, n, n == most[p[1]]) for p, n in times.items()}


def test_query_equals_a_plain_version(spark, sf, monkeypatch):
    """Few hot pairs, so that most links go by the shuffled join."""
    import duckdb

    monkeypatch.setattr(A, "HOT_PAIRS", 64)
    table = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    want, _, _ = plain([t for _, t in table])
    assert rows(A.op13_alignment(spark, sf)) == {d: w for (d, _), w in zip(table, want)}


def test_repeated_null_and_no_rows(spark):
    df = spark.createDataFrame([(None, "one two"), (1, "one two"), (1, "one two"), (2, None)], "doc_id long, text string")
    per_text, _ = A.align_tokenizers(df, *PATHS)
    got = sorted(per_text.collect(), key=str)
    assert len(got) == 4 and sum(r.doc_id is None for r in got) == 1
    full = [r for r in got if r.n_a]
    assert len(full) == 3 and all(r.count_sum == 3 * r.n_links == 3 * r.n_best for r in full)
    per_text, pairs = A.align_tokenizers(df.where("doc_id = 9"), *PATHS)
    assert per_text.count() == 0 and pairs.count() == 0


def test_fragments_compose_in_any_order():
    aligner, rng = A.Aligner(*PATHS), random.Random(1)
    text = "unbelievable straßenbahn 日本語テスト reconsideration's 12345 x" * 3
    whole, *_ = aligner.fragment(text, 0, 0, len(text.encode()) + 1)
    parts = [aligner.fragment(w, start, low, high)[0] for low, high, start, w in aligner.ranges(text, 5)]
    assert len(parts) > 10 and any(not p.closes for p in parts)
    flat = lambda f: (f.closes, f.prefix, ";".join(f.closed), f.suffix)
    for _ in range(50):
        left = list(parts)
        while len(left) > 1:
            k = rng.randrange(len(left) - 1)
            left[k : k + 2] = [A.compose(left[k], left[k + 1])]
        assert flat(left[0]) == flat(whole) == flat(reduce(A.compose, parts))


def test_memory_is_bounded():
    aligner = A.Aligner(*PATHS, memory=8)
    words = [f"w{k % 40}" for k in range(400)]
    for k in range(0, 400, 5):
        assert aligner.pieces(words[k : k + 5]) == A.Aligner(*PATHS).pieces(words[k : k + 5]) if k < 20 else aligner.pieces(words[k : k + 5])
    assert len(aligner.known) <= 8 and len(aligner.older) <= 8 and len(aligner.parts) <= 16


def test_a_long_word_lies_in_two_windows_at_most():
    aligner = A.Aligner(*PATHS)
    windows = [w for *_, w in aligner.ranges("ab " + "x" * 5000 + " cd", 100)]
    assert sum("xx" in w for w in windows) == 2
