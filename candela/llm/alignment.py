"""Alignment of two tokenizers' tokens by their byte ranges.

Byte offsets where tokens of both end cut a text into groups. A byte range of a text yields a fragment: the open prefix up
to its first common end, the closed groups after it, and the open suffix after its last one (or open tokens alone, if no
common end lies in it). Fragments of neighbouring ranges compose, and composing is associative, so a very long text is cut
into ranges that other tasks encode, and a tree of bounded groups puts its fragments together.

A range is encoded within the words that reach into it. Both tokenizers end a token before a space between two other
characters (the first one's pattern, and no piece of the second crosses it), so text may be cut there before encoding.
Within a word they both do so between a letter and a mark that no piece of the second joins, and around line ends.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.llm._shared import join_groups, ship, stored
from candela.llm.bpe import _byte_letters

#: Bytes of a range; fragments that one task composes; words remembered by a worker, twice at most, those up to LONGEST.
RANGE_BYTES, FAN_IN, MEMORY, LONGEST = 1 << 16, 16, 1 << 18, 64
#: A pair of ids is one long: B's id in the low bits.
LOW = 24
#: Pairs that hold over 1/HOT_PAIRS of all links, so HOT_PAIRS of them at most, are broadcast; the others are shuffled.
HOT_PAIRS = 1 << 16
#: Not beside a space to cut at: white space to either tokenizer or to Python.
BESIDE = "[^\\s\u2581\u180e\u200b\ufeff]"
CUT = re.compile(f"(?<={BESIDE}) (?={BESIDE})")
#: Letters to every version of Unicode, marks that may be cut off behind one, and the first tokenizer's pattern (fixed values).
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?|*&#$%\"'’)"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = re.compile(f" [{LETTERS}]+")


class Piece(NamedTuple):
    """A word with the space before it, aligned; links: a long for each, as bytes."""

    sound: bool
    n_a: int
    n_b: int
    groups: str
    links: bytes


class Fragment(NamedTuple):
    """Part of an aligned text. Without a common end (closes is false) all its tokens are in the prefix."""

    closes: bool
    prefix: tuple[list[int], list[int]]
    closed: list[str]
    suffix: tuple[list[int], list[int]]


def written(a: list[int], b: list[int]) -> str:
    return ",".join(map(str, a)) + "|" + ",".join(map(str, b))


UNSOUND = Piece(False, 0, 0, "", b"")


def joined(parts: list[Piece]) -> Piece:
    """The piece of a word from those of its parts."""
    if len(parts) == 1:
        return parts[0]
    if not all(p.sound for p in parts):
        return UNSOUND
    return Piece(True, sum(p.n_a for p in parts), sum(p.n_b for p in parts), ";".join([p.groups for p in parts]), b"".join([p.links for p in parts]))


def compose(left: Fragment, right: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges. Associative."""
    join = lambda x, y: (x[0] + y[0], x[1] + y[1])
    if not left.closes:
        return right._replace(prefix=join(left.prefix, right.prefix))
    if not right.closes:
        return left._replace(suffix=join(left.suffix, right.prefix))
    middle = written(*join(left.suffix, right.prefix))
    return Fragment(True, left.prefix, [*left.closed, middle, *right.closed], right.suffix)


class Aligner:
    """Both tokenizers, their tokens' bytes, and a memory of words."""

    def __init__(self, path_a: str, path_b: str, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        byte_of = {c: i for i, c in enumerate(_byte_letters())}
        with open(path_a, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.bytes_a = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t, i in vocab.items()}
        specials = {c["content"] for c in json.loads(self.a.to_str())["added_tokens"]}
        # Ids are merge ranks in this format, so the same vocabulary serves the faster encoder of plain words.
        ranks = {self.bytes_a[i]: i for t, i in vocab.items() if t not in specials}
        self.plain_a = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.bytes_b = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces}
        texts = [p for i, p in pieces if not self.b.is_byte(i)]
        self.cuttable = not any(re.search("[^▁]▁|[\n]", p) for p in texts)
        free = re.escape("".join(m for m in MARKS if not any(re.search(f"[{LETTERS}]{re.escape(m)}", p) for p in texts)))
        self.within = re.compile(f"(?<=[{LETTERS}])(?=[{free}\n])|(?<={BESIDE})(?=\n)|(?<=\n)(?={BESIDE})")
        self.line_end = self.b.encode("\n")
        self.memory, self.known, self.older, self.parts = memory, {}, {}, {}

    def words(self, text: str) -> list[str]:
        """The text cut where both tokenizers end a token before a space; those spaces are left out."""
        return CUT.split(text) if self.cuttable else [text]

    def tokens(self, parts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of each part by both. A part starts with its space, or behind a cut within a word."""
        a = self.a.encode_batch_fast(parts, add_special_tokens=False)
        # The second tokenizer sets a space before each text; parts without one come behind a line end, whose ids go.
        b = self.b.encode([p[1:] if p[0] == " " else "\n" + p for p in parts], num_threads=1)
        return [(x.ids, y if p[0] == " " else y[len(self.line_end) :]) for p, x, y in zip(parts, a, b)]

    def aligned(self, a: list[int], b: list[int]) -> Iterator[tuple[list[int], list[int]]]:
        """(A ids, B ids) of each group; tokens after the last common end are left out."""
        i = j = from_a = from_b = end_a = end_b = 0
        while True:
            if end_a <= end_b and i < len(a):
                end_a, i = end_a + len(self.bytes_a[a[i]]), i + 1
            elif j < len(b):
                end_b, j = end_b + len(self.bytes_b[b[j]]), j + 1
            else:
                return
            if end_a == end_b:
                yield a[from_a:i], b[from_b:j]
                from_a, from_b = i, j

    def piece(self, part: str, a: list[int], b: list[int]) -> Piece:
        want = part.encode()
        if b"".join([self.bytes_a[i] for i in a]) != want or b"".join([self.bytes_b[i] for i in b]) != want:
            return UNSOUND
        groups = list(self.aligned(a, b))
        return Piece(True, len(a), len(b), ";".join([written(x, y) for x, y in groups]), array("q", [x[-1] << LOW | y[-1] for x, y in groups]).tobytes())

    def plain_pieces(self, parts: list[str]) -> list[Piece]:
        """As piece(), of parts that are a space and letters: encoded in a row, as both tokenizers cut between them."""
        whole = "".join(parts)
        a, b = self.plain_a.encode_ordinary(whole), self.b.encode(whole[1:], num_threads=1)
        bytes_a, bytes_b = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
        if b"".join(bytes_a) != (want := whole.encode()) or b"".join(bytes_b) != want:
            return [self.piece(p, x, y) for p, (x, y) in zip(parts, self.tokens(parts))]
        digits_a, digits_b = list(map(str, a)), list(map(str, b))
        out, i, j = [], 0, 0
        for p in parts:
            left_a = left_b = len(p.encode())
            first_a, first_b, from_a, from_b, groups, links = i, j, i, j, [], []
            while left_a or left_b:
                if left_a >= left_b:
                    left_a -= len(bytes_a[i])
                    i += 1
                else:
                    left_b -= len(bytes_b[j])
                    j += 1
                if left_a == left_b:
                    groups.append(f"{','.join(digits_a[from_a:i])}|{','.join(digits_b[from_b:j])}")
                    links.append(a[i - 1] << LOW | b[j - 1])
                    from_a, from_b = i, j
            out.append(Piece(True, i - first_a, j - first_b, ";".join(groups), array("q", links).tobytes()))
        return out

    def parts_of(self, words: list[str]) -> list[list[Piece]]:
        """The pieces of each word's parts, by a memory of parts that is cleared when full."""
        cut = [self.within.split(" " + w) if self.cuttable else [" " + w] for w in words]
        if len(self.parts) > self.memory:
            self.parts = {}
        known = self.parts
        new = {p: None for parts in cut for p in parts if p not in known}
        plain = [p for p in new if PLAIN.fullmatch(p)]
        if plain:
            new.update(zip(plain, self.plain_pieces(plain)))
        if odd := [p for p, found in new.items() if found is None]:
            new.update(zip(odd, (self.piece(p, *ids) for p, ids in zip(odd, self.tokens(odd)))))
        out = [[known.get(p) or new[p] for p in parts] for parts in cut]
        if len(new) <= self.memory:
            known.update((p, found) for p, found in new.items() if len(p) <= LONGEST)
        return out

    def pieces(self, words: list[str]) -> list[Piece]:
        """Each word with the space before it, aligned; by memory of two halves, the older of which goes when the newer is full."""
        known, older = self.known, self.older
        out = list(map(known.get, words))
        if None in out:
            new = {w: older.get(w) for w, p in zip(words, out) if p is None}
            missing = [w for w, p in new.items() if p is None]
            new.update(zip(missing, map(joined, self.parts_of(missing))))
            out = [p or new[w] for w, p in zip(words, out)]
            if len(known) + len(new) > self.memory:
                self.older, self.known = known, {}
            if len(new) <= self.memory:
                self.known.update((w, p) for w, p in new.items() if len(w) <= LONGEST)
        return out

    def ranges(self, text: str, size: int) -> Iterator[tuple[int, int, int, str]]:
        """(from, to, start, window) of each range of about size bytes: the window holds the words that reach into it.

        Offsets count the space before the text; start is the window's. A range ends within a word at most once a word,
        so a word lies in two windows at most, however long it is.
        """
        words = self.words(text)
        starts = np.concatenate([[0], np.cumsum([len(w.encode()) + 1 for w in words])])
        bounds, last = [0], -1
        for at in range(size, int(starts[-1]), size):
            word = int(np.searchsorted(starts, at, side="right")) - 1
            if word != last:
                bounds.append(at)
            last = word
        bounds.append(int(starts[-1]))
        for low, high in zip(bounds, bounds[1:]):
            first, end = int(np.searchsorted(starts, low, side="right")) - 1, int(np.searchsorted(starts, high, side="left"))
            yield low, high, int(starts[first]), " ".join(words[first:end])

    def fragment(self, window: str, start: int, low: int, high: int) -> tuple[Fragment, int, int, list[bytes]] | None:
        """(fragment, number of A and B tokens, links) of the tokens that end in (low, high]; None if a word's bytes differ."""
        prefix, closed, links, open_a, open_b, n_a, n_b = None, [], [], [], [], 0, 0
        words = self.words(window)
        for word, whole in zip(words, self.pieces(words)):
            if not whole.sound:
                return None
            end = start + 1 + len(word.encode())
            if prefix is not None and not open_a and not open_b and low <= start and end <= high:
                closed.append(whole.groups)
                links.append(whole.links)
                n_a, n_b = n_a + whole.n_a, n_b + whole.n_b
            else:
                ((a, b),) = self.tokens([" " + word])
                ends_a, ends_b = (start + np.cumsum([len(of[i]) for i in ids]) for of, ids in ((self.bytes_a, a), (self.bytes_b, b)))
                common = np.intersect1d(ends_a, ends_b)
                (i, to_a), (j, to_b) = (np.searchsorted(ends, (low, high), side="right").tolist() for ends in (ends_a, ends_b))
                n_a, n_b = n_a + to_a - i, n_b + to_b - j
                for e in common[(common > low) & (common <= high)]:
                    to_i, to_j = (int(np.searchsorted(ends, e, side="right")) for ends in (ends_a, ends_b))
                    group = open_a + a[i:to_i], open_b + b[j:to_j]
                    if prefix is None:
                        prefix = group
                    else:
                        closed.append(written(*group))
                    links.append(array("q", [group[0][-1] << LOW | group[1][-1]]).tobytes())
                    i, j, open_a, open_b = to_i, to_j, [], []
                open_a, open_b = open_a + a[i:to_a], open_b + b[j:to_b]
            start = end
        if prefix is None:
            return Fragment(False, (open_a, open_b), [], ([], [])), n_a, n_b, links
        return Fragment(True, prefix, closed, (open_a, open_b)), n_a, n_b, links


@lru_cache(maxsize=1)
def aligner_of(path_a: str, path_b: str) -> Aligner:
    """One for each Python worker, so that its memory outlives a task."""
    return Aligner(path_a, path_b)


def _counted(links: list[bytes]) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of links, distinct ones, how often each)."""
    every = np.frombuffer(b"".join(links), dtype=np.int64)
    pairs, times = np.unique(every, return_counts=True)
    return len(every), pairs, times.astype(np.int64)


PAIRS = "pairs array<long>, times array<long>"
WHOLE = f"n_a long, n_b long, n_groups long, groups_sha256 string, {PAIRS}"
RANGE = "at int, ranges int, low long, high long, start long, window string"
PART = f"sound boolean, closes boolean, prefix_a array<int>, prefix_b array<int>, closed string, suffix_a array<int>, suffix_b array<int>, n_a long, n_b long, n_groups long, {PAIRS}"
ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
NO_TOKENS = (0, 0, 0, "", [], [])
BROKEN = (False, False, [], [], "", [], [], 0, 0, 0, [], [])


def _columns(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def _batch(batch: pa.RecordBatch, passed: int, rows: list[tuple], ddl: str, at: list[int] | None = None) -> pa.RecordBatch:
    """rows under the columns of ddl, behind the first columns of batch (rows at of it, else all in order)."""
    kept = [c if at is None else c.take(pa.array(at, pa.int64())) for c in batch.columns[:passed]]
    made = [pa.array(c, ARROW[d.split()[1]]) for c, d in zip(zip(*rows), ddl.split(", "))]
    return pa.RecordBatch.from_arrays(kept + made, names=batch.schema.names[:passed] + _columns(ddl))


def _short_texts(path_a: str, path_b: str):
    """_id, rid, text -> whole results, in one step."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(path_a, path_b)
        for batch in batches:
            rows = []
            for text in batch.column(2):
                pieces = aligner.pieces(aligner.words(text.as_py())) if text.is_valid and text.as_py() else []
                if pieces and all(p.sound for p in pieces):
                    _, n_a, n_b, groups, links = zip(*pieces)
                    n, pairs, times = _counted(links)
                    rows.append((sum(n_a), sum(n_b), n, hashlib.sha256(";".join(groups).encode()).hexdigest(), pairs, times))
                else:
                    rows.append(NO_TOKENS)
            if rows:
                yield _batch(batch, 2, rows, WHOLE)

    return task


def _cut_texts(path_a: str, path_b: str, size: int):
    """_id, rid, text -> a row for each range."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(path_a, path_b)
        for batch in batches:
            for k, text in enumerate(batch.column(2)):
                made = list(aligner.ranges(text.as_py(), size))
                yield _batch(batch, 2, [(n, len(made), *r) for n, r in enumerate(made)], RANGE, [k] * len(made))

    return task


def _encode_ranges(path_a: str, path_b: str):
    """Ranges -> their fragments."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(path_a, path_b)
        for batch in batches:
            rows = []
            for low, high, start, window in zip(*(batch.column(k).to_pylist() for k in range(4, 8))):
                made = aligner.fragment(window, start, low, high)
                rows.append(_part(*made) if made else BROKEN)
            if rows:
                yield _batch(batch, 4, rows, PART)

    return task


def _part(f: Fragment, n_a: int, n_b: int, links: list[bytes]) -> tuple:
    return True, f.closes, *f.prefix, ";".join(f.closed), *f.suffix, n_a, n_b, *_counted(links)


def _composed(frame: pd.DataFrame) -> pd.DataFrame:
    """Neighbouring fragments of one text (FAN_IN at most) as one."""
    frame = frame.sort_values("at")
    columns = ["rid", "at", "ranges", *_columns(PART)]
    head = (frame["rid"].iloc[0], frame["at"].iloc[0] // FAN_IN, -(-frame["ranges"].iloc[0] // FAN_IN))
    if not frame["sound"].all():
        return pd.DataFrame([(*head, *BROKEN)], columns=columns)
    parts = (Fragment(r.closes, (list(r.prefix_a), list(r.prefix_b)), [r.closed] if r.closed else [], (list(r.suffix_a), list(r.suffix_b))) for r in frame.itertuples())
    f = reduce(compose, parts)
    pairs, place = np.unique(np.concatenate([np.asarray(p, dtype=np.int64) for p in frame["pairs"]]), return_inverse=True)
    times = np.bincount(place, weights=np.concatenate([np.asarray(t, dtype=np.int64) for t in frame["times"]]), minlength=len(pairs)).astype(np.int64)
    row = (*head, True, f.closes, *f.prefix, ";".join(f.closed), *f.suffix, *(int(frame[c].sum()) for c in ("n_a", "n_b", "n_groups")), pairs, times)
    return pd.DataFrame([row], columns=columns)


def _finished(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The one fragment of each text -> its whole result."""
    for frame in frames:
        rows = []
        for r in frame.itertuples():
            groups = ";".join(filter(None, [written(list(r.prefix_a), list(r.prefix_b)), r.closed])) if r.closes else ""
            rows.append((r.rid, r.n_a, r.n_b, r.n_groups, hashlib.sha256(groups.encode()).hexdigest(), r.pairs, r.times) if r.sound else (r.rid, *NO_TOKENS))
        yield pd.DataFrame(rows, columns=["rid", *_columns(WHOLE)])


def aligned_texts(df: DataFrame, path_a: str, path_b: str, text_col: str, id_col: str, size: int) -> DataFrame:
    """_id, rid and the columns of WHOLE for each row, stored. rid is a number of its own for each row."""
    base = df.select(df[id_col].alias("_id"), (F.monotonically_increasing_id() * 2).alias("rid"), df[text_col].alias("text"))
    long, kind = F.coalesce(F.octet_length("text"), F.lit(0)) > size, df.schema[id_col].dataType.simpleString()
    short = base.where(~long).mapInArrow(_short_texts(path_a, path_b), f"_id {kind}, rid long, {WHOLE}")
    ranges = base.where(long).withColumn("rid", F.col("rid") + 1).mapInArrow(_cut_texts(path_a, path_b, size), f"_id {kind}, rid long, {RANGE}")
    encoded = ranges.repartition("rid", "at").mapInArrow(_encode_ranges(path_a, path_b), f"_id {kind}, rid long, at int, ranges int, {PART}")
    encoded = stored(encoded, "fragments")
    left, parts = encoded.agg(F.max("ranges")).head()[0] or 0, encoded.drop("_id")
    keys = "rid long, at int, ranges int"
    while left > 1:
        grouped = parts.groupBy("rid", F.floor(F.col("at") / FAN_IN).alias("_parent"))
        parts, left = grouped.applyInPandas(_composed, f"{keys}, {PART}"), -(-left // FAN_IN)
    done = parts.mapInPandas(_finished, f"rid long, {WHOLE}").join(encoded.where("at = 0").select("_id", "rid"), "rid")
    return stored(short.unionByName(done), "aligned")


def align_tokenizers(df: DataFrame, path_a: str, path_b: str, text_col: str = "text", id_col: str = "doc_id", size: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(one row per row of df: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; pairs: a_id, b_id, links, best).

    A is a byte-level BPE file of the tokenizers library and encodes a space and the text; B is a sentencepiece model with a
    space of its own before the text. A text that is null or empty, or whose tokens' bytes aren't its own, has no tokens:
    zeros and an empty string. Pairs counts, over all texts, how often tokens a and b end together; best marks the highest
    count of b (ties included). Null ids stay, rows that repeat give a row each and count each, other columns are left out
    whatever their names, and an empty table gives empty results.
    """
    ship(df.sparkSession)
    aligned = aligned_texts(df, path_a, path_b, text_col, id_col, size)
    links = aligned.select("rid", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("rid", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    counts = links.groupBy("pair").agg(F.sum("times").alias("links")).withColumn("b_id", F.col("pair").bitwiseAND(F.lit((1 << LOW) - 1)).cast("int"))
    counts = stored(counts, "pair-counts")
    highest = counts.groupBy("b_id").agg(F.max("links").alias("most"))  # a row for each piece of B's vocabulary at most
    counts = counts.join(F.broadcast(highest), "b_id").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))
    counts = stored(counts, "pairs")
    found = join_groups(links, counts, "pair", "links", "inner", parts=HOT_PAIRS)
    sums = found.groupBy("rid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("links")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = aligned.drop("pairs", "times").join(sums, "rid", "left")
    per_text = out.select(F.col("_id").alias(id_col), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")
    pairs = counts.select(F.shiftright("pair", LOW).cast("int").alias("a_id"), F.col("pair").bitwiseAND(F.lit((1 << LOW) - 1)).cast("int").alias("b_id"), "links", "best")
    return per_text, pairs


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align_tokenizers(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]
