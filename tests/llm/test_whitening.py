"""Whitening against dense eigenvectors, and exact sums against plain ones."""

import math

import numpy as np
import pytest

from candela.llm import whitening as W


def dense(table):
    """Rows of the contract by plain means: {(id, component): (deviation, |whitened|)}, explained."""
    rows = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in table]
    n = len(rows)
    sums = [sum(col) for col in zip(*(x for _, x in rows))]
    c = np.array([[(n * e - s) / n for e, s in zip(x, sums)] for _, x in rows])
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(32, len(sums), int((values > 1e-12 * values.sum()).sum()))
    w = c @ axes[:, :k] / np.sqrt(values[:k])
    out = {(i, j + 1): (sum((n * e - s) ** 2 for e, s in zip(x, sums)), w[r, j]) for r, (i, x) in enumerate(rows) for j in range(k)}
    return n, out, values[:k] / values.sum()


def compare(got, table):
    n, want, explained = dense(table)
    assert sorted((r.vec_id, r.component) for r in got) == sorted(want)
    sign = {}
    for r in got:
        deviation, whitened = want[r.vec_id, r.component]
        assert r.n == n and r.deviation == deviation
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9) and r.identity_error < 1e-9
        if abs(whitened) > 1e-3:
            assert sign.setdefault(r.component, np.sign(whitened * r.whitened)) == np.sign(whitened * r.whitened)
        assert abs(r.whitened) == pytest.approx(abs(whitened), abs=1e-6)


def test_query_equals_dense_eigenvectors(spark, sf):
    import duckdb

    table = duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet'").fetchall()
    compare(W.op12_whitening(spark, sf).collect(), [r for r in table if r[1] and all(e is not None and math.isfinite(e) for e in r[1])])


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    table = [(k, (rng.standard_normal(5) * [9, 4, 2, 1, 0.5]).astype(np.float32).tolist()) for k in range(60)] + [(7, [1.0, 2.0, 3.0, 4.0, 5.0])] * 2
    odd = [(100, None), (101, []), (102, [1.0, None, 3.0, 4.0, 5.0]), (103, [float("nan"), 1.0, 1.0, 1.0, 1.0]), (104, [1.0, float("inf"), 1.0, 1.0, 1.0]), (105, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in table + odd], "vec_id long, embedding array<float>, component int, n string").repartition(5)
    got = W.whiten(df).collect()
    assert len(got) == 62 * 5
    n, _, explained = dense([(k, v) for k, (_, v) in enumerate(table)])
    assert {r.n for r in got} == {62} and [r.explained for r in sorted(got, key=lambda r: r.component)][::62] == pytest.approx(list(explained))
    covariance = np.cov(np.array([[r.whitened for r in sorted(got, key=lambda r: (r.component, r.vec_id, r.deviation))]]).reshape(5, 62), bias=True)
    assert np.abs(covariance - np.eye(5)).max() < 1e-9
    assert W.whiten(df.where("vec_id is null")).count() == 0
    assert W.whiten(df.where("vec_id = 7")).count() == 3  # two of three vectors are equal: one component
    assert W.whiten(df.where("vec_id = 3")).count() == 0


def test_large_entries_stay_exact():
    x = np.array([[2**60, -(2**60), 5], [2**60 - 1, 3, 7]], dtype=np.int64)
    assert W._exact_sum(x) == [2**61 - 1, 3 - 2**60, 12]
    fit = W.Centred(2, W._exact_sum(x))
    assert fit.squares(x) == [None, None]
    small = np.array([[3, 9], [4, 1], [5, 5]], dtype=np.int64)
    assert W.Centred(3, [12, 15]).squares(small) == [9 + 144, 144, 9]


@pytest.mark.parametrize("spectrum", ["falling", "clustered", "flat", "low"])
def test_jacobi_davidson(spectrum):
    """Dimensions far beyond the block, so that restarts, locking and corrections all act."""
    d, k = 400, 8
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    values = {"falling": 1e4 / np.arange(1, d + 1), "clustered": np.repeat(np.arange(d // 4, 0, -1.0), 4), "flat": np.linspace(2, 1, d), "low": np.r_[np.arange(6, 0, -1.0), np.zeros(d - 6)]}[spectrum]
    a = (q * values) @ q.T
    calls = []
    got, axes = W.jacobi_davidson(lambda block: calls.append(block.shape[1]) or a @ block, d, k)
    assert got == pytest.approx(values[:k], rel=1e-11, abs=1e-11)
    assert np.linalg.norm(a @ axes - axes * got, axis=0).max() < 1e-11 * values[0] and np.abs(axes.T @ axes - np.eye(k)).max() < 1e-12
    assert max(calls) <= 2 * (k + W.GUARD) + k
