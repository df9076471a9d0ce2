"""Line-first cleaning against a plain version."""

import collections
import hashlib
import random
import re

import pytest

from candela.llm import line_rules as L

PROSE = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen."
LONG = " ".join(f"w{k} x{k % 7}." for k in range(40))


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    base = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), base


def cases():
    rng = random.Random(8)
    small = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(60))) for _ in range(60)]
    odd = ["".join(rng.choice("ab #|\t\n\r\x0b\x0c\x1c é😀.") for _ in range(rng.randrange(200))) for _ in range(60)]
    fixed = [None, "", " \n\t ", PROSE, f"{PROSE}\n" * 5, LONG, f"{LONG}\nMenu | Home | Shop | Help\n© 2020 All rights reserved.\n", "a b c " * 20_000, f"{LONG}\r\n{LONG}"]
    return fixed + small + odd


@pytest.mark.parametrize("bits", [22, 61, 1])
def test_base_equals_a_plain_version(spark, monkeypatch, bits):
    """61 bits leave three to the hash, so that windows collide; 1 leaves no text short enough for packed keys."""
    monkeypatch.setattr(L, "PLACE_BITS", bits)
    texts = cases()
    df = spark.createDataFrame([(k, t, k, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_words int, kept string")
    got = {r.doc_id: r for r in L.clean_lines(df).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(t), (k, t and t[:80])


def test_lines_that_fail_and_texts_that_lose_too_much(spark):
    bad = ["Home | Products | About us", "no mark at the end", "THIS IS SHOUTED.", "12 / 34.", "function() { return 1; }.", "All rights reserved.", "a# b# c#.", "» Next » Last »"]
    good = ["He said: “Stop!”", "A sentence (in brackets.)", "Ελλάδα είναι εδώ.", "終わりました。", "Ok…", "", "  \t", f"{LONG} and then it breaks"]
    for line in bad + good:
        r = L.clean_lines(spark.createDataFrame([(1, f"{LONG}\n{line}\n{LONG}x.")], "doc_id long, text string")).head()
        want = [LONG, *([line] if line in good else []), f"{LONG}x."]
        assert r.cleaned == "\n".join(want), line
        assert (r.n_failed_lines, r.failed_chars) == ((1, len(re.sub(r"\s", "", line))) if line in bad else (0, 0)), line
    menu = "\n".join(f"Home{k} | Shop{k} | Help{k}" for k in range(30))
    rows = [(1, f"{LONG}\n{menu}"), (2, LONG), (None, LONG), (2, LONG), (3, None)]
    got = sorted((r.doc_id or 0, r.kept, r.base_failed) for r in L.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, True, False), (1, False, False), (2, True, False), (2, True, False), (3, False, True)]
    assert L.clean_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_its_sql_and_keeps_clean_documents(spark, sf):
    import duckdb

    got = L.op11_line_rules(spark, sf)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(f"select {', '.join(got.columns)} from ({L.OP11_SQL})").fetchall()
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted(want)
    good = {r[0] for r in con.execute(f"select doc_id from '{sf}/labels.parquet' where quality = 1").fetchall()}
    kept = {r[0]: r[got.columns.index("kept")] for r in rows}
    failed = {r[0] for r in rows if r[got.columns.index("base_failed")]}
    assert all(kept[d] for d in good - failed) and len(good - failed) > 40
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert hashlib.sha256(b"").hexdigest() not in {r[got.columns.index("cleaned_sha256")] for r in rows if r[got.columns.index("kept")]}
