"""Whitening of embeddings: leading components of their covariance by block Jacobi-Davidson.

The covariance is never formed. It is applied to a block of directions by a Spark job: each task centres its vectors,
multiplies them twice and passes on one row a dimension, which a grouped sum adds up. The driver holds a few blocks of
d x (components) numbers. Each outer step takes Ritz pairs of the search space (Rayleigh-Ritz), locks leading ones whose
residual is at double precision, and extends the space by solutions of the projected correction equations
(I - ZZ')(V - theta)(I - ZZ') t = -r of the others, which MINRES solves for all of them at once: one job a step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.llm._shared import ship

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components at most, and more directions than that in each block.
COMPONENTS, GUARD = 32, 4
#: Largest residual of a locked pair, against the largest eigenvalue; MINRES steps and the part of its residual that it
#: leaves; outer steps; blocks in the search space before it restarts from its best half.
TOLERANCE, INNER, INNER_LEFT, OUTER, BLOCKS = 1e-13, 8, 0.02, 300, 6
#: Entries whose integer has more bits than this count as not finite.
MOST_BITS = 61
ROWS = 1024
Apply = Callable[[np.ndarray], np.ndarray]


def _scaled(vectors: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the vectors that take part, their entries as integers): those of d finite entries."""
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == d)
    if not len(at):
        return at, np.empty((0, d), dtype=np.int64)
    entries = vectors.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), d) * float(SCALE)
    with np.errstate(invalid="ignore"):
        fits = (np.abs(entries) < 2.0**MOST_BITS).all(axis=1)
    return at[fits], np.floor(entries[fits]).astype(np.int64) + SHIFT


def _exact_sum(x: np.ndarray) -> list[int]:
    """Sums of the columns as Python integers."""
    high, low = (x >> 24).sum(axis=0), (x & 0xFFFFFF).sum(axis=0)
    return [(int(h) << 24) + int(l) for h, l in zip(high, low)]


class Centred:
    """Counts and sums of a fit list; turns entries into deviations from its mean."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], dtype=np.int64)
        self.part = np.array([(s % n) / n for s in sums])

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """x - S/n as doubles: the integer part is taken off exactly."""
        return (x - self.whole).astype(np.float64) - self.part

    def squares(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n*x - S)^2, exact; None if it doesn't fit a long."""
        far = (np.abs(x - self.whole).max(initial=0) + 1) * float(self.n)
        if far * far * x.shape[1] < 2.0**62:
            left = np.array([s % self.n for s in self.sums], dtype=np.int64)
            return ((self.n * (x - self.whole) - left) ** 2).sum(axis=1).tolist()
        exact = (sum((self.n * int(e) - s) ** 2 for e, s in zip(row, self.sums)) for row in x)
        return [e if e < 1 << 63 else None for e in exact]


def _summed(vectors: DataFrame, rows: Callable[[Iterator[pa.Array]], np.ndarray | None], width: int) -> np.ndarray:
    """Sum over tasks of the matrices that rows() makes of each task's vectors: they meet by row number."""
    names = [f"c{k}" for k in range(width)]
    schema = pa.schema([("i", pa.int32()), *((c, pa.float64()) for c in names)])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = rows(b.column(0) for b in batches)
        if out is not None:
            columns = [pa.array(np.ascontiguousarray(out[:, k])) for k in range(width)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), *columns], schema=schema)

    made = vectors.mapInArrow(task, ", ".join(["i int", *(f"{c} double" for c in names)]))
    found = made.groupBy("i").agg(*(F.sum(c).alias(c) for c in names)).toPandas().sort_values("i")
    return found[names].to_numpy()


def fit_list(vectors: DataFrame, d: int) -> Centred | None:
    """Number and exact sums of the vectors that take part; None if there are none."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for batch in batches:
            x = _scaled(batch.column(0), d)[1]
            n, sums = n + len(x), [a + b for a, b in zip(sums, _exact_sum(x))]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))], names=["i", "n", "s"]
            )

    found = vectors.mapInArrow(task, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    if not found:
        return None
    return Centred(found[0].n, [int(r.s) for r in sorted(found, key=lambda r: r.i)])


def covariance_product(vectors: DataFrame, fit: Centred, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(covariance times block, variance of each dimension) by one job; block: d x any number of directions."""
    d, width = block.shape

    def rows(columns: Iterator[pa.Array]) -> np.ndarray | None:
        out = None
        for column in columns:
            c = fit.deviations(_scaled(column, d)[1])
            if len(c):
                part = np.hstack([c.T @ (c @ block), np.square(c).sum(axis=0)[:, None]])
                out = part if out is None else out + part
        return out

    total = _summed(vectors, rows, width + 1) / fit.n
    return total[:, :width], total[:, width]


def _orthonormal(block: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """Orthonormal directions of block outside the span of the others (orthonormal themselves)."""
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > 0] / norms[norms > 0]
    for least in (1e-8, 0.5):
        for _ in range(2):
            for o in others:
                block = block - o @ (o.T @ block)
        if not block.shape[1]:
            break
        left, size, _ = np.linalg.svd(block, full_matrices=False)
        block = left[:, size > least]
    return block


def block_minres(apply: Apply, rhs: np.ndarray, steps: int, left: float) -> np.ndarray:
    """MINRES on every column of rhs at once, each a system of its own: apply takes and gives a block."""
    first = np.linalg.norm(rhs, axis=0)
    x, before, w, w_before = np.zeros_like(rhs), np.zeros_like(rhs), np.zeros_like(rhs), np.zeros_like(rhs)
    safe = lambda y: np.where(y == 0, 1.0, y)
    v, beta, eta = rhs / safe(first), np.zeros_like(first), first.copy()
    c = c_before = np.ones_like(first)
    s = s_before = np.zeros_like(first)
    for _ in range(steps):
        p = apply(v)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - beta * before
        beta_next = np.linalg.norm(p, axis=0)
        delta, rho2, rho3 = c * alpha - c_before * s * beta, s * alpha + c_before * c * beta, s_before * beta
        rho1 = np.hypot(delta, beta_next)
        live = (rho1 > 0) & (eta != 0)
        c_before, s_before = c, s
        c, s = np.where(live, delta / safe(rho1), 1.0), np.where(live, beta_next / safe(rho1), 0.0)
        w_before, w = w, np.where(live, (v - rho3 * w_before - rho2 * w) / safe(rho1), 0.0)
        x, eta = x + c * eta * w, np.where(live, -s * eta, 0.0)
        before, v, beta = v, p / safe(beta_next), beta_next
        if (np.abs(eta) <= left * first).all():
            break
    return x


def _ritz(space: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values, falling, their vectors, images and residual norms."""
    h = space.T @ image
    values, y = np.linalg.eigh((h + h.T) / 2)
    values, y = values[::-1], y[:, ::-1]
    u, au = space @ y, image @ y
    return values, u, au, np.linalg.norm(au - u * values, axis=0)


def jacobi_davidson(apply: Apply, d: int, k: int, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """(k largest eigenvalues, falling; their unit vectors) of a symmetric positive semidefinite matrix that apply() multiplies.

    The search starts from fixed pseudo-random directions, so the same table gives the same components.
    """
    width = min(d, k + GUARD)
    rng = np.random.default_rng(17)
    space = _orthonormal(rng.standard_normal((d, width)))
    image, locked, top = apply(space), np.empty((d, 0)), 0.0
    for _ in range(OUTER):
        values, u, au, residuals = _ritz(space, image)
        top = max(top, values[0])
        done = 0
        while done < min(k - locked.shape[1], len(values)) and residuals[done] <= tolerance * top:
            done += 1
        locked, space, image, values = np.hstack([locked, u[:, :done]]), u[:, done:], au[:, done:], values[done:]
        whole = locked.shape[1] + space.shape[1] >= d
        if locked.shape[1] >= k or whole:
            # All pairs once more, with fresh products: nothing larger may be left among the others.
            every = np.hstack([locked, space]) if whole else np.hstack([locked, space[:, : width + k]])
            values, u, au, residuals = _ritz(every, apply(every))
            if whole or (residuals[:k] <= 2 * tolerance * values[0]).all():
                return values[:k], u[:, :k]
            locked, space, image = np.empty((d, 0)), u, au
            values = values.copy()
        want = min(width, k - locked.shape[1] + GUARD, space.shape[1])
        z, theta = np.hstack([locked, space[:, :want]]), values[:want]
        outside = lambda x: x - z @ (z.T @ x)
        shifted = lambda x: outside(apply(x) - x * theta)  # noqa: E731, B023
        rhs = -outside(image[:, :want] - space[:, :want] * theta)
        corrections = outside(block_minres(shifted, rhs, INNER, INNER_LEFT))
        if space.shape[1] + want > BLOCKS * width:
            space, image = space[:, : BLOCKS // 2 * width], image[:, : BLOCKS // 2 * width]
        new = _orthonormal(corrections, locked, space)
        if not new.shape[1]:
            new = _orthonormal(rng.standard_normal((d, min(width, d - locked.shape[1] - space.shape[1]))), locked, space)
        space, image = np.hstack([space, new]), np.hstack([image, apply(new)])
    raise RuntimeError(f"components did not reach a residual of {tolerance} in {OUTER} steps")


def whiten(df: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty or hold null or non-finite entries (or such that floor(64 c) has over 61 bits) take no
    part; nor do those of another length than most (of equally common lengths the larger counts). Components of no
    variance (below 1e-12 of all) have no rows, so there may be fewer than components or dimensions, and none for a
    single vector or equal ones. A deviation beyond a long is null. Null ids stay, repeated rows count and come as often
    as they occur, other columns are left out whatever their names, and an empty table gives an empty result.
    """
    ship(df.sparkSession)
    base = df.select(df[id_col].alias("id"), df[vector_col].alias("v")).where("v is not null")
    if df.schema[vector_col].dataType.elementType.typeName() not in ("float", "double"):
        base = base.withColumn("v", F.col("v").cast("array<double>"))
    vectors = base.select("v")
    schema = f"id {df.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    name = lambda out: out.withColumnRenamed("id", id_col)
    length = vectors.groupBy(F.size("v").alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).head()
    fit = fit_list(vectors, length.d) if length else None
    if not fit:
        return name(df.sparkSession.createDataFrame([], schema))
    d = length.d
    variance = covariance_product(vectors, fit, np.zeros((d, 1)))[1]
    trace = float(variance.sum())
    values, axes = jacobi_davidson(lambda block: covariance_product(vectors, fit, block)[0], d, min(components, d)) if trace > 0 else (np.empty(0), np.empty((d, 0)))
    axes, values = axes[:, values > 1e-12 * trace], values[values > 1e-12 * trace]
    if not len(values):
        return name(df.sparkSession.createDataFrame([], schema))
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(values))]) / np.sqrt(values)
    explained, k = values / trace, len(values)

    def moments(columns: Iterator[pa.Array]) -> np.ndarray | None:
        out = None
        for column in columns:
            w = fit.deviations(_scaled(column, d)[1]) @ axes
            if len(w):
                part = np.vstack([w.T @ w, w.sum(axis=0)])
                out = part if out is None else out + part
        return out

    sums = _summed(vectors, moments, k) / fit.n
    error = float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                at, x = _scaled(batch.column(1), d)
                if len(at):
                    m = len(at)
                    columns = [
                        batch.column(0).take(pa.array(np.repeat(at, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, fit.n)),
                        pa.array(fit.squares(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array((fit.deviations(x) @ axes).ravel()),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * k, error)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return name(base.mapInArrow(rows, schema))


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
