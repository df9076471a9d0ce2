"""SimHash near-dedup with pigeonring filtering.

Fingerprints link if they differ in at most 2 of 64 bits. On a ring of four 16-bit segments some segment must start a
chain whose cumulative differences stay within the proportional budget l*2/4 for every length l: 0 bits over one
segment, 1 over two, 1 over three, 2 over four. So segment i is equal, and i+1 or i+2 is too: candidates share a 32-bit
key of two segments. A candidate must pass the chain test before its full Hamming distance is taken.

Copies of a fingerprint are one node. A key shared by many different fingerprints is not expanded into pairs: those
fingerprints are linked, exactly and in linear space, through the values one bit away (two fingerprints are within 2
bits if and only if they share such a value or are such a value of each other).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.llm._shared import bloom, join_groups, maybe_in, ship, stored
from candela.llm.exact_dedup import filter_size

SEGMENTS, WIDTH, MOST_BITS = 4, 16, 2
#: Fingerprints of one key that are compared in pairs; keys with more take the linear way.
PAIRED = 32
#: Shingles hashed at once, so that memory doesn't grow with a text.
BLOCK = 1 << 15
SEED = 42


def majority(hashes: bytes) -> np.ndarray:
    """For each of 64 bits, how many of the 8-byte big-endian hashes have it."""
    return np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, words_each: int = 3) -> int:
    """Unsigned 64-bit SimHash of a whole text: bit set if it is in over half of the shingles' hashes."""
    words = (text or "").encode(errors="surrogatepass").lower().split()  # bytes: A-Z and the six ASCII spaces alone
    if not words:
        return 0
    data = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(words_each, len(words))
    starts, ends = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, dtype=np.int64)
    for k in range(0, len(starts), BLOCK):
        ones += majority(b"".join([digest(data[a:b], SEED) for a, b in zip(starts[k : k + BLOCK], ends[k : k + BLOCK])]))
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big")


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def fingerprints(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Rows (id, fp): the fingerprint as a signed long. Null, empty and blank texts have fingerprint 0."""
    ship(df.sparkSession)
    return df.select(df[id_col].alias("id"), F.pandas_udf(_fingerprints, "long")(df[text_col]).alias("fp"))


def _segment(fp: Column, i: int, segments: int = SEGMENTS) -> Column:
    width = 64 // segments
    return F.shiftrightunsigned(fp, width * (segments - 1 - i % segments)).bitwiseAND(F.lit((1 << width) - 1))


def in_chain(x: Column, y: Column, segments: int = SEGMENTS, most: int = MOST_BITS) -> Column:
    """Some segment starts a chain within the budgets: l of them in a row differ in l * most / segments bits at most."""
    differ = [F.bit_count(_segment(x.bitwiseXOR(y), i % segments, segments)).cast("int") for i in range(2 * segments)]
    # sums[i]: bits that differ before segment i of the ring, gone round twice
    sums = F.aggregate(F.array(*differ), F.array(F.lit(0)), lambda s, d: F.concat(s, F.array(F.element_at(s, -1) + d)))
    ring = F.struct(sums.alias("sums"))
    chain = lambda s, i: F.forall(F.sequence(F.lit(1), F.lit(segments)), lambda n: F.get(s, i + n) - F.get(s, i) <= F.floor(n * most / segments))
    found = F.transform(F.array(ring), lambda r: F.exists(F.sequence(F.lit(0), F.lit(segments - 1)), lambda i: chain(r["sums"], i)))
    return F.get(found, F.lit(0))


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b), a < b, of a table of different fingerprints (column fp): enough to connect whatever is within 2 bits."""
    keys = [F.struct(F.lit(n).alias("pair"), F.concat_ws("-", _segment(F.col("fp"), i), _segment(F.col("fp"), j)).alias("value")) for n, (i, j) in enumerate(combinations(range(SEGMENTS), 2))]
    keyed = nodes.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.pair", "k.value")
    # The largest number of each key's fingerprints decides its way; the counts have one row for each shared key.
    counts = stored(keyed.groupBy("pair", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "keys")
    shared = stored(keyed.join(counts, ["pair", "value"]), "keyed")
    few = shared.where(F.col("n") <= PAIRED).groupBy("pair", "value").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    pairs = few.select(F.posexplode("fps").alias("at", "a"), "fps").select("a", F.explode(F.expr("slice(fps, at + 2, size(fps))")).alias("b"))
    pairs = pairs.where(in_chain(F.col("a"), F.col("b"))).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS)
    many = shared.where(F.col("n") > PAIRED).select("fp").distinct()
    flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b)) for b in range(64)))
    near = many.select("fp", F.explode(flips).alias("via")).groupBy("via").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    # A value has 65 fingerprints around it at most; each links to the smallest of them.
    stars = near.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    return stored(pairs.select("a", "b").unionByName(stars).distinct(), "links")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (fp, root): for each end of an edge the smallest fingerprint connected with it.

    Rounds of star contraction: larger neighbours move to the smallest neighbour, then smaller ones do, until nothing
    changes. Edges are written to the shared folder each round, so no lineage grows.
    """
    now = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    signed = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head()
    last = signed(now)
    for _ in range(rounds):
        if not last[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = stored(small.where("u <> v").distinct(), "round")
        if (then := signed(now)) == last:
            break
        last = then
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return now.select(F.col("u").alias("fp"), F.col("v").alias("root"))


def near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of df: id, fp, component (smallest id reachable by links, its own included), size of the component's fingerprint group.

    Null ids: ignored by the minimum; a component of null ids alone has component null. Rows that repeat an id keep it.
    """
    rows = stored(fingerprints(df, text_col, id_col), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    roots = components(links(nodes))
    tied = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    whole = tied.groupBy("root").agg(F.min("least").alias("component"), F.sum("n").alias("size"))
    of = stored(tied.join(whole, "root").select("fp", "n", "component"), "components")
    return join_groups(rows, of, "fp", "n", "inner").drop("n")


def near_dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", filter_bits: int | None = None) -> DataFrame:
    """The rows of df of which no row of their component has a smaller id; its columns alone.

    Ids that go form a Bloom filter; rows certainly outside pass straight through, only the others shuffle with their texts.
    Rows with a null id stay.
    """
    return without_larger_ids(df, near_duplicates(df, text_col, id_col), id_col, filter_bits)


def without_larger_ids(df: DataFrame, found: DataFrame, id_col: str, filter_bits: int | None) -> DataFrame:
    """The rows of df but for those whose id is larger than its component. found: id, component."""
    gone = stored(found.where("id > component").select(F.col("id").alias("_gone")).distinct(), "gone")
    filter_bits = filter_bits or filter_size(gone.count())
    names = [f"_c{i}" for i in range(len(df.columns))]
    packed = df.select(df[id_col].alias("_id"), F.struct(*(df[c].alias(n) for c, n in zip(df.columns, names))).alias("_row"))
    probed = maybe_in(packed, F.xxhash64("_id"), bloom(gone, F.xxhash64("_gone"), filter_bits), filter_bits, "_maybe")
    stay = probed.where(~F.col("_maybe")).select("_row")
    maybe = probed.where("_maybe").join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("_row")
    return stay.unionByName(maybe).select(*(F.col(f"_row.{n}").alias(c) for c, n in zip(df.columns, names)))


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
