"""SimHash near-dedup for a similarity: near copies by exact Jaccard similarity of 5-word shingles.

Pairs of similarity 0.8 lie up to 17 of 64 bits apart. With so wide a budget the segments of a pigeonring have few bits
each, so a segment alone can't be a key: each value would hold a good part of all documents. Keys are MinHash bands
instead (a band of five minima is shared by two texts of similarity s with probability s^5, one of 24 bands at 0.8 with
0.9999). A pair that shares a key must pass the pigeonring on its SimHash fingerprints, eight segments and BITS in all,
and their Hamming distance; what is left is confirmed on whole shingle sets (64-bit hashes of them).

Texts with one shingle set are one node. A key with more than PAIRED nodes is not expanded into pairs. Its nodes are first
compared with one of them, another for each key that they share. Then those outside the largest component that this gives are compared with all nodes of the
key, in blocks of bounded size that give only links between components: the result is as if all pairs had been compared,
and a large group of near copies costs its size times what the first step left.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.llm._shared import bloom, join_groups, maybe_in, ship, stored
from candela.llm.exact_dedup import filter_size
from candela.llm.simhash import SEED, components, in_chain, majority, without_larger_ids

WORDS, LEAST, BANDS, ROWS = 5, 0.8, 24, 5
#: Nodes of one key that are compared in pairs.
PAIRED = 32
#: Segments and bits of the pigeonring: the distance at 0.8 has mean 10 and deviation 3.
RING, BITS = 8, 24
#: Rows and bytes of text of a block of a crowded key, about.
BLOCK_ROWS, BLOCK_BYTES = 1024, 1 << 22
#: Shingles whose minima are taken at once.
BLOCK = 1 << 12
_FACTORS = np.random.default_rng(SEED).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words_each: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's shingles; a text of fewer words is one shingle, one of none has none."""
    words = (text or "").encode(errors="surrogatepass").lower().split()  # bytes: A-Z and the six ASCII spaces alone
    if not words:
        return np.empty(0, dtype=np.uint64)
    data = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(words_each, len(words))
    starts, ends = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(data[a:b], SEED) for a, b in zip(starts, ends)), dtype=np.uint64, count=len(starts)))


def signature(hashes: np.ndarray) -> list[int]:
    """One signed long a band."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(hashes), BLOCK):
        least = np.minimum(least, (hashes[k : k + BLOCK, None] * _FACTORS).min(axis=0))
    keys = [xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def bits_of(hashes: np.ndarray) -> int:
    """SimHash fingerprint of a shingle set, as a signed long."""
    ones = sum((majority(hashes[k : k + BLOCK].astype(">u8").tobytes()) for k in range(0, len(hashes), BLOCK)), np.zeros(64, np.int64))
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def _signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = []
        for t in texts:
            h = shingles(t)
            node = int.from_bytes(xxhash.xxh64_digest(h.tobytes(), SEED), "big", signed=True)
            rows.append((node, len(h), bits_of(h), signature(h)))
        yield pd.DataFrame(rows, columns=["node", "size", "fp", "keys"])


_kept_shingles = lru_cache(maxsize=64)(shingles)


def jaccard(a: str | None, b: str | None) -> float:
    x, y = _kept_shingles(a), _kept_shingles(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def _jaccards(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([jaccard(x, y) for x, y in zip(a, b)], dtype="float64")


def cross_links(left: list[tuple], right: list[tuple]) -> list[tuple[int, int]]:
    """Links (node, node) between rows (node, root, hashes) of both sides with different roots: one for each two roots, from each row."""
    sizes = np.array([len(h) for _, _, h in right])
    vocabulary, at = np.unique(np.concatenate([h for _, _, h in right]), return_inverse=True)
    starts, roots = np.concatenate(([0], np.cumsum(sizes)[:-1])), np.array([r for _, r, _ in right])
    holds, found, out = np.zeros(len(vocabulary), dtype=np.int32), set(), []
    for node, root, hashes in left:
        place = np.searchsorted(vocabulary, hashes)
        place = place[place < len(vocabulary)]
        place = place[np.isin(vocabulary[place], hashes, assume_unique=True)]
        holds[place] = 1
        both = np.add.reduceat(holds[at], starts)
        holds[place] = 0
        for k in np.flatnonzero((both / (sizes + len(hashes) - both) >= LEAST) & (roots != root)):
            if (pair := (root, roots[k])) not in found:
                found.add(pair)
                out.append((node, right[k][0]))
    return out


def keys_of(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(value, node, size, fp) of each key of each node; and for each value of several nodes their number and one of them."""
    keyed = nodes.select("node", "size", "fp", F.explode("keys").alias("value"))
    one = F.min(F.struct(F.xxhash64("node", "value").alias("h"), F.col("node"), F.col("size"), F.col("fp"))).alias("one")
    return keyed, stored(keyed.groupBy("value").agg(F.count(F.lit(1)).alias("n"), one).where("n > 1"), "keys")


def candidates(keyed: DataFrame, counts: DataFrame) -> DataFrame:
    """Different pairs (a, b), a < b, of nodes that share a key, whose sizes allow the similarity and that pass the pigeonring.

    Of keys with more than PAIRED nodes, the pairs with the key's representative.
    """
    few = keyed.join(counts.where(F.col("n") <= PAIRED).select("value"), "value")
    few = few.groupBy("value").agg(F.array_sort(F.collect_list(F.struct("node", "size", "fp"))).alias("all"))
    pairs = few.select(F.posexplode("all").alias("at", "x"), "all").select("x", F.explode(F.expr("slice(all, at + 2, size(all))")).alias("y"))
    many = counts.where(F.col("n") > PAIRED).select("value", "n", F.struct("one.node", "one.size", "one.fp").alias("r"))
    stars = join_groups(keyed, many, "value", "n", "inner").select(F.struct("node", "size", "fp").alias("o"), "r")
    stars = stars.where("o.node <> r.node").select(F.least("o", "r").alias("x"), F.greatest("o", "r").alias("y"))
    x, y = F.col("x.fp"), F.col("y.fp")
    fit = (F.least("x.size", "y.size") >= LEAST * F.greatest("x.size", "y.size")) & in_chain(x, y, RING, BITS)
    near = pairs.unionByName(stars).where(fit).where(F.bit_count(x.bitwiseXOR(y)) <= BITS)
    return stored(near.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), "candidates")


def texts_of(wanted: DataFrame, texts: DataFrame, nodes: DataFrame, filter_bits: int | None) -> DataFrame:
    """wanted (node and others, a row a node) with the node's text. texts: text and its hash th; nodes: node, th.

    Only texts of these nodes move: a Bloom filter of their hashes clears the others.
    """
    wanted = stored(wanted.join(nodes.select("node", "th"), "node"), "wanted")
    filter_bits = filter_bits or filter_size(wanted.count())
    probed = maybe_in(texts, F.col("th"), bloom(wanted, F.col("th"), filter_bits, name="texts"), filter_bits, "_maybe").where("_maybe")
    return stored(probed.groupBy("th").agg(F.any_value("text").alias("text")).join(wanted, "th").drop("th"), "texts")


def confirmed(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, filter_bits: int | None) -> DataFrame:
    """The pairs whose texts have a Jaccard similarity of LEAST or more."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    held = texts_of(ends, texts, nodes, filter_bits)

    def side(rows: DataFrame, c: str) -> DataFrame:
        end = held.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"), F.col("n").alias(f"n_{c}"))
        return join_groups(rows, end, c, f"n_{c}", "inner")

    both = side(side(pairs, "a"), "b")
    return stored(both.select("a", "b", F.pandas_udf(_jaccards, "double")("text_a", "text_b").alias("j")).where(F.col("j") >= LEAST), "near")


def crowded_links(keyed: DataFrame, counts: DataFrame, roots: DataFrame, texts: DataFrame, nodes: DataFrame, filter_bits: int | None) -> DataFrame:
    """Links (a, b) that connect different components (roots: node, root) through keys with more than PAIRED nodes."""
    many = counts.where(F.col("n") > PAIRED).select("value", "n")
    members = join_groups(keyed.select("value", "node"), many, "value", "n", "inner").join(roots, "node", "left")
    members = stored(members.select("value", "node", F.coalesce("root", "node").alias("root")), "members")
    sizes = members.groupBy("value", "root").agg(F.count(F.lit(1)).alias("k"))
    open_ = sizes.groupBy("value").agg(F.max(F.struct("k", "root")).alias("top"), F.count(F.lit(1)).alias("roots"), F.sum("k").alias("n")).where("roots > 1")
    open_ = stored(open_.select("value", F.col("top.root").alias("top"), (F.col("n") - F.col("top.k")).alias("rest"), "n"), "open")
    members = stored(join_groups(members, open_, "value", "n", "inner"), "open-members")
    held = texts_of(members.groupBy("node").agg(F.count(F.lit(1)).alias("times")), texts, nodes, filter_bits)
    rows = stored(join_groups(members.withColumnRenamed("n", "_n"), held, "node", "times", "inner").withColumnRenamed("_n", "n"), "crowd")
    # As many blocks as rows and bytes ask for; each of the outside part meets each of the whole.
    weights = rows.groupBy("value").agg(F.sum(F.octet_length("text")).alias("bytes"))
    rows = join_groups(rows, weights.join(open_.select("value", F.col("n").alias("w")), "value"), "value", "w", "inner")
    split = lambda n: F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(F.col("bytes") * n / F.col("n") / BLOCK_BYTES), F.lit(1)).cast("long")
    parts, blocks = split(F.col("rest")), split(F.col("n"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    seed = F.xxhash64("node")
    outside = rows.where("root <> top").withColumn("part", F.pmod(seed, parts)).withColumn("block", every(blocks))
    whole = rows.withColumn("block", F.pmod(seed, blocks)).withColumn("part", every(parts))
    keys = ["value", "part", "block"]
    columns = [F.col(c).alias(c) for c in (*keys, "node", "root", "text")]

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        sides = [[(n, r, shingles(t)) for n, r, t in zip(s["node"], s["root"], s["text"])] for s in (left, right)]
        return pd.DataFrame(cross_links(*sides) if len(left) and len(right) else [], columns=["a", "b"])

    found = outside.select(*columns).groupBy(keys).cogroup(whole.select(*columns).groupBy(keys)).applyInPandas(compare, "a long, b long")
    return stored(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "crowd-links")


def near_copies(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", filter_bits: int | None = None) -> DataFrame:
    """One row per row of df: id and component (smallest id reachable by pairs of similarity LEAST or more, its own included).

    Null, empty and blank texts are one component. Null ids: ignored by the minimum; a component of null ids alone has
    component null. Rows that repeat an id keep it. Other columns, of whatever name, are left out; an empty table gives an
    empty result.
    """
    ship(df.sparkSession)
    texts = df.select(F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    signed = F.pandas_udf(_signed, "node long, size int, fp long, keys array<long>")(df[text_col])
    rows = df.select(df[id_col].alias("id"), F.xxhash64(df[text_col]).alias("th"), signed.alias("s")).select("id", "th", "s.*")
    rows = stored(rows, "signatures")
    first = lambda c: F.any_value(c).alias(c)
    nodes = rows.groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.min("th").alias("th"), first("size"), first("fp"), first("keys"))
    nodes = stored(nodes, "nodes")
    keyed, counts = keys_of(nodes)
    near = confirmed(candidates(keyed, counts), texts, nodes, filter_bits).select("a", "b")
    roots = components(near)
    if counts.where(F.col("n") > PAIRED).limit(1).count():
        more = crowded_links(keyed, counts, roots.withColumnRenamed("fp", "node"), texts, nodes, filter_bits)
        roots = components(near.unionByName(more))
    tied = nodes.select("node", "least", "n").join(roots.withColumnRenamed("fp", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = tied.groupBy("root").agg(F.min("least").alias("component"))
    of = stored(tied.join(whole, "root").select("node", "n", "component"), "components")
    return join_groups(rows.select("id", "node"), of, "node", "n", "inner").select("id", "component")


def near_copy_dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", filter_bits: int | None = None) -> DataFrame:
    """The rows of df of which no row of their component has a smaller id; its columns alone. Rows with a null id stay."""
    return without_larger_ids(df, near_copies(df, text_col, id_col, filter_bits), id_col, filter_bits)
