"""Approximate nearest neighbours by an inverted multi-index, for the largest inner product.

The two halves of a vector are quantised apart, so an index of n centroids a half has n squared cells. A query walks the
centroid pairs in order of summed distance (minus the inner product with each half) with a heap, until the cells walked
hold SHARE of all entries and a few more; a walk is the set of pairs up to one summed distance, so that number alone travels with the
query. Only entries of the cells that a query walks are scored. Entries lie in blocks of neighbouring first-half
centroids, queries in parts of them; an entry block meets the parts that have a query walking it, in groups of bounded
size. Centroids are fitted on SAMPLE vectors at most, their number grows with the table; every vector is indexed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.llm._shared import ship, stored

#: SHARE was set from measured recall: neighbours in these 64-dimensional vectors are diffuse, see the README.
SHARE, SAMPLE = 0.38, 16_384
#: Centroids of a half: PER_ROOT times the root of the number of vectors, within these bounds. Entries gathered beside SHARE, for each wanted.
PER_ROOT, FEWEST, MOST, GATHER = 3.0, 8, 128, 5
#: Rows of an entry block and of a query part; both sides of a group are held in memory. Queries scored at once. Queries of a walking task.
ENTRY_ROWS, QUERY_ROWS, AT_ONCE, WALKERS = 4_096, 16_384, 512, 256


def sound(vector: Column) -> Column:
    """Vectors that take part: not null, not zero, every component finite."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & whole & F.exists(vector, lambda x: x != 0)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k centroids at most; fewer if there are fewer vectors."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        nearest = np.argmin(np.square(c).sum(1) - 2 * x @ c.T, axis=1)
        sums, n = np.zeros_like(c), np.bincount(nearest, minlength=len(c))
        np.add.at(sums, nearest, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def walk(a: np.ndarray, b: np.ndarray, held: np.ndarray, need: int) -> float:
    """Summed distance of the last centroid pair that a walk needs to gather `need` entries.

    a, b: distances to the centroids of each half; held[i, j]: entries of each cell. Pairs come off the heap in order of
    a[i] + b[j]; a pair enters it when both its neighbours before it have left.
    """
    by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    a, b, held = a[by_a].tolist(), b[by_b].tolist(), held[np.ix_(by_a, by_b)].tolist()
    done = [0] * len(a)  # pairs that have left each row
    heap, got, last = [(a[0] + b[0], 0, 0)], 0, float("-inf")
    while heap:
        last, i, j = heapq.heappop(heap)
        got += held[i][j]
        done[i] = j + 1
        if got >= need:
            break
        if j + 1 < len(b) and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if i + 1 < len(a) and done[i + 1] == j:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
    return last


def _split(vectors: pd.Series) -> tuple[np.ndarray, int]:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return x, x.shape[1] // 2


def layout(counts: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(first block, blocks) of each list of rows: lists in order share a block of `limit` rows, a longer one has its own."""
    first, pieces, block, filled = [], [], 0, 0
    for c in counts.tolist():
        if filled and filled + c > limit:
            block, filled = block + 1, 0
        first.append(block)
        pieces.append(max(1, -(-c // limit)))
        if c > limit:
            block, filled = block + pieces[-1], 0
        else:
            filled += c
    return np.array(first, dtype=np.int64), np.array(pieces, dtype=np.int64)


def score_block(q: pd.DataFrame, e: pd.DataFrame, one: np.ndarray, two: np.ndarray, k: int) -> Iterator[tuple]:
    """(query id, ids, exact scores) of each query's best entries of a block, among the cells that the query walks."""
    e = e.sort_values(["i", "j"], kind="stable")
    (x, h), (y, _) = _split(e["vec"]), _split(q["vec"])
    ids, i, j = e["vec_id"].to_numpy(), e["i"].to_numpy(), e["j"].to_numpy()
    starts = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
    ends = np.append(starts[1:], len(ids))
    for s in range(0, len(q), AT_ONCE):
        part, own, radius = y[s : s + AT_ONCE], q["query_id"].to_numpy()[s : s + AT_ONCE], q["radius"].to_numpy()[s : s + AT_ONCE]
        walked = (-part[:, :h] @ one.T)[:, i[starts]] - (part[:, h:] @ two.T)[:, j[starts]] <= radius[:, None]
        rough = np.full((len(part), len(ids)), -np.inf)
        for c, (a, b) in enumerate(zip(starts, ends)):
            if len(who := np.flatnonzero(walked[:, c])):
                rough[who, a:b] = part[who] @ x[a:b].T
        rough[ids[None] == own[:, None]] = -np.inf
        for n, r in enumerate(rough):
            low = np.partition(r, -k)[-k] if len(r) > k else -np.inf
            at = np.flatnonzero((r > -np.inf) & (r >= low - 1e-9 * (1 + abs(low)) if low > -np.inf else True))
            exact = (x[at] * part[n]).sum(axis=1)  # the same order of summation in every block
            best = np.lexsort((ids[at], -exact))[:k]
            if len(best):
                yield own[n], ids[at][best], exact[best]


def neighbours(
    df: DataFrame, id_col: str, vec_col: str, is_query: Column, k: int = 20, share: float = SHARE, centroids: int | None = None, sample: int = SAMPLE
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest found of each query, its own id left out.

    Ties go to the smaller id. Vectors that aren't sound, or whose length isn't the commonest one, take no part. Rows that
    repeat a query's id are asked once and give one answer. Other columns of df, of whatever name, are left out. An empty
    table gives an empty result. centroids: of each half; by default their number follows the number of vectors.
    """
    spark = df.sparkSession
    ship(spark)
    out = "query_id long, rank int, vec_id long, score double"
    vectors = df.where(df[id_col].isNotNull() & sound(df[vec_col])).select(
        df[id_col].cast("long").alias("vec_id"), df[vec_col].cast("array<double>").alias("vec"), is_query.alias("asked")
    )
    lengths = vectors.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").head()
    if lengths is None:
        return spark.createDataFrame([], out)
    vectors = vectors.where(F.size("vec") == lengths["d"])
    first = vectors.select("vec_id", "vec").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    x, half = _split(first["vec"])
    centroids = centroids or min(MOST, max(FEWEST, round(PER_ROOT * lengths["count"] ** 0.5)))
    one, two = k_means(x[:, :half], centroids), k_means(x[:, half:], centroids)
    # Neighbouring numbers stand for neighbouring centroids, so that a block holds lists that are walked together.
    one = one[np.argsort(one @ np.linalg.svd(one - one.mean(axis=0), full_matrices=False)[2][0])] if half else one

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, h = _split(pdf["vec"])
                i = np.argmin(np.square(one).sum(1) - 2 * x[:, :h] @ one.T, axis=1)
                j = np.argmin(np.square(two).sum(1) - 2 * x[:, h:] @ two.T, axis=1)
                yield pdf.assign(i=i.astype(np.int32), j=j.astype(np.int32))

    entries = stored(vectors.mapInPandas(cells, "vec_id long, vec array<double>, asked boolean, i int, j int"), "entries")
    held, asking = np.zeros((len(one), len(two)), dtype=np.int64), np.zeros(len(one), dtype=np.int64)
    for r in entries.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.count_if("asked").alias("q")).collect():  # MOST**2 rows at most
        held[r["i"], r["j"]] = r["n"]
        asking[r["i"]] += r["q"]
    need = int(np.ceil(share * held.sum())) + GATHER * k
    in_list = held.sum(axis=1)
    block_of, part_of = layout(in_list, ENTRY_ROWS), layout(asking, QUERY_ROWS)

    def place(of: tuple[np.ndarray, np.ndarray], key: str) -> Column:
        at, pieces = (F.element_at(F.array(*map(F.lit, a.tolist())), F.col("i") + 1) for a in of)
        return at + F.pmod(F.xxhash64(key), pieces)

    def walks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, h = _split(pdf["vec"])
                a, b = -x[:, :h] @ one.T, -x[:, h:] @ two.T
                radius = np.array([walk(p, q, held, need) for p, q in zip(a, b)])
                at = []
                for p, q, r in zip(a, b, radius):
                    lists = np.flatnonzero((p + q.min() <= r) & (in_list > 0))
                    at.append(np.unique(np.concatenate([np.arange(block_of[0][i], block_of[0][i] + block_of[1][i]) for i in lists])))
                yield pd.DataFrame({"query_id": pdf["vec_id"], "vec": pdf["vec"], "part": pdf["part"], "radius": radius, "block": at})

    tasks = max(1, -(-int(asking.sum()) // WALKERS))
    queries = entries.where("asked").withColumn("part", place(part_of, "vec_id")).repartition(tasks, "vec_id").dropDuplicates(["vec_id"])
    queries = queries.mapInPandas(walks, "query_id long, vec array<double>, part long, radius double, block array<long>")
    queries = stored(queries.withColumn("block", F.explode("block")), "walks")
    meetings = queries.select(F.col("block").alias("block"), F.col("part").alias("part")).distinct()
    blocks = entries.select("vec_id", "vec", "i", "j", place(block_of, "vec_id").alias("block")).join(meetings, "block")

    def rerank(q: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        rows = list(score_block(q, e, one, two, k)) if len(q) and len(e) else []
        return pd.DataFrame(rows, columns=["query_id", "ids", "scores"])

    keys = ["block", "part"]
    found = queries.groupBy(keys).cogroup(blocks.groupBy(keys)).applyInPandas(rerank, "query_id long, ids array<long>, scores array<double>")
    pairs = F.explode(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("scores").alias("score"))).alias("e")
    each = found.select("query_id", pairs).select("query_id", "e.*")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours(vectors, "vec_id", "embedding", F.col("vec_id") % 20 == 0)
