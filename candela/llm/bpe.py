"""BPE encoding and decoding with forced-boundary splitting.

Two neighbouring bytes that stand side by side in no vocabulary token can never end up in one token, so a word is cut
between them before any merge; the fragments are encoded on their own and their ids concatenated. Merges act on
neighbours alone, so this equals encoding the whole word.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.llm._shared import ship

#: Fixed values of the tokenizer format: its white space, its word pattern and its byte alphabet (printable bytes stand
#: for themselves, the others for the code points from 256 on).
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + SPACE + r"\p{L}\p{N}]+"
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Text without combining marks or letters that NFC changes, and of the same classes in every version of Unicode.
STABLE = re.compile("[\x00-\u02ff]+")
#: Pieces of text remembered by each Python worker, twice at most; and fragments. Longer ones are not remembered.
MEMORY, LONGEST = 1 << 18, 64
#: Bits of an id within the key of a pair, and below the rank of its merge.
WIDE = 24
ID = (1 << WIDE) - 1
#: Fragments up to so many bytes are merged by a plain scan; a pair without a merge ranks last.
SHORT, NO_MERGE = 48, 1 << 60


def _byte_letters() -> list[str]:
    rest = iter(range(256, 512))
    return [chr(b) if b in set(PRINTABLE) else chr(next(rest)) for b in range(256)]


class Codec:
    """Encoder and decoder of one tokenizer file (byte alphabet, word-end suffix, NFC, lower case, spaces dropped)."""

    def __init__(self, path: str, memory: int | None = None):
        self.memory = memory or MEMORY
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end, vocab = model["end_of_word_suffix"], model["vocab"]
        self.token = {i: t for t, i in vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.digits = {i: str(i) for i in self.token}
        letters = _byte_letters()
        self.first = [vocab[c] for c in letters]
        self.last = [vocab[c + self.end] for c in letters]
        self.merges = {}
        for rank, (a, b) in enumerate(tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]):
            self.merges[vocab[a] << WIDE | vocab[b]] = rank << WIDE | vocab[a + b]
        self.path, self.library = path, None
        byte_of = self.byte_of = {c: b for b, c in enumerate(letters)}
        self.inside = {(byte_of[x], byte_of[y]) for t in vocab for form in (t, t.removesuffix(self.end)) for x, y in zip(form, form[1:])}
        self.joined = [bytes((a, b) in self.inside for b in range(256)) for a in range(256)]
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.spaces, self.odd_spaces, self.words = re.compile(f"[{SPACE}]+"), re.compile("[\x1c-\x1f]"), regex.compile(WORD)
        self.known: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}
        self.fragments: dict[tuple[bytes, bool], list[int]] = {}
        self.hollow = False  # whether a piece without ids was met

    def fragment(self, data: bytes, final: bool) -> list[int]:
        """Ids of bytes without a forced boundary inside; lowest rank first, then leftmost."""
        ids = [self.first[b] for b in data]
        if final:
            ids[-1] = self.last[data[-1]]
        if len(ids) > SHORT:
            return self.long_fragment(ids)
        found = self.merges.get
        ranks = [found(a << WIDE | b, NO_MERGE) for a, b in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < NO_MERGE:
            i = ranks.index(least)
            ids[i] = least & ID
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = found(ids[i - 1] << WIDE | ids[i], NO_MERGE)
            if i < len(ranks):
                ranks[i] = found(ids[i] << WIDE | ids[i + 1], NO_MERGE)
        return ids

    def long_fragment(self, ids: list[int | None]) -> list[int]:
        """As fragment(), with a heap: n log n steps for n bytes."""
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranked = ((merges.get(a << WIDE | b, NO_MERGE), i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])))
        heap = [x for x in ranked if x[0] < NO_MERGE]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j, new = after[i], rank & ID
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for at, pair in ((i, (new, ids[k]) if k < n else None), (before[i], (ids[before[i]], new) if before[i] >= 0 else None)):
                if pair and (pair[0] << WIDE | pair[1]) in merges:
                    heapq.heappush(heap, (merges[pair[0] << WIDE | pair[1]], at, *pair))
        return [x for x in ids if x is not None]

    def word(self, data: bytes) -> list[int]:
        """Ids of one word: cut at the forced boundaries, encode the fragments, concatenate."""
        joined, fragments = self.joined, self.fragments
        cuts = [i for i in range(1, len(data)) if not joined[data[i - 1]][data[i]]]
        out: list[int] = []
        for a, b in zip([0, *cuts], [*cuts, len(data)]):
            key = data[a:b], b == len(data)
            if (ids := fragments.get(key)) is None:
                ids = self.fragment(*key)
                if b - a <= LONGEST:
                    if len(fragments) >= self.memory:
                        fragments.clear()
                    fragments[key] = ids
            out += ids
        return out

    def by_library(self, raw: str) -> list[bytes]:
        """Words of text with marks or letters on which versions of Unicode may differ: the library's own tables decide."""
        from tokenizers import Tokenizer

        t = self.library = self.library or Tokenizer.from_file(self.path)
        return [bytes(self.byte_of[c] for c in w) for w, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(raw))]

    def chunk(self, raw: str) -> tuple[int, str, str]:
        """(number of ids, ids, tokens) of text without white space, both joined by one space; a special token is itself."""
        if raw in self.special:
            return 1, self.digits[self.special[raw]], raw
        if raw.isascii():
            text = raw.lower()
            words = [text.encode()] if text.isalpha() else [w.encode() for w in self.words.findall(text)]
        elif STABLE.fullmatch(raw):
            text = raw.lower()
            words = [w.encode() for w in self.words.findall(text)]
        else:
            words = self.by_library(raw)
        ids = [i for w in words for i in self.word(w)]
        return len(ids), " ".join([self.digits[i] for i in ids]), " ".join([self.token[i] for i in ids])

    def pieces(self, text: str) -> list[str]:
        """The text without its white space; special tokens in it are pieces of their own."""
        out: list[str] = []
        for part in self.at_special.split(text) if "<|" in text else (text,):
            if part in self.special:
                out.append(part)
            else:
                out += filter(None, self.spaces.split(part)) if self.odd_spaces.search(part) else part.split()
        return out

    def encode(self, text: str) -> list[tuple[int, str, str]]:
        """As chunk(), for each piece of the text that has ids."""
        pieces = self.pieces(text)
        out = list(map(self.known.get, pieces))
        if None in out:
            for k, got in enumerate(out):
                if got is None:
                    out[k] = self.recall(pieces[k])
        return [got for got in out if got[0]] if self.hollow else out

    def recall(self, raw: str) -> tuple[int, str, str]:
        """As chunk(), by memory: of two halves, the older of which goes when the newer is full."""
        if (got := self.known.get(raw)) is None:
            got = self.older.get(raw) or self.chunk(raw)
            self.hollow = self.hollow or not got[0]
            if len(raw) <= LONGEST:
                if len(self.known) >= self.memory:
                    self.older, self.known = self.known, {}
                self.known[raw] = got
        return got

    def ids(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.encode(text) for i in ids.split()]

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so the tokens are joined by one space, special ones included."""
        return " ".join(self.token[i] for i in ids)


@lru_cache(maxsize=2)
def codec_of(path: str, memory: int | None = None) -> Codec:
    """One codec for each Python worker, so that what it remembers outlives a task."""
    return Codec(path, memory)


def bpe_digests(text: Column, path: str, memory: int | None = None) -> Column:
    """Struct (n_tokens, ids_sha256, decoded_sha256) of a text column; a null text counts as empty."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = codec_of(path, memory)
        sha = lambda parts: hashlib.sha256(" ".join(parts).encode()).hexdigest()
        for batch in batches:
            rows = []
            for text in batch:
                n, ids, tokens = zip(*got) if (got := codec.encode(text or "")) else ((), (), ())
                rows.append((sum(n), sha(ids), sha(tokens)))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests(text)


def bpe_encode(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """df with columns ids (array<int>) and decoded (string), in place of any of these names. Null texts count as empty."""
    ship(df.sparkSession)

    @F.pandas_udf("ids array<int>, decoded string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = codec_of(path)
        for batch in batches:
            ids = [codec.ids(t or "") for t in batch]
            yield pd.DataFrame({"ids": ids, "decoded": [codec.decode(i) for i in ids]})

    kept = [df[c] for c in df.columns if c not in ("ids", "decoded")]
    out = df.select(*kept, both(df[text_col]).alias("_bpe"))
    return out.select(*[c for c in out.columns if c != "_bpe"], "_bpe.*")


def bpe_report(df: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", memory: int | None = None) -> DataFrame:
    """One row per row of df: id, n_tokens, ids_sha256, decoded_sha256. Rows stay where they are: no shuffle.

    A null text counts as empty; null ids stay, rows that repeat give a row each, other columns are left out, and an empty
    table gives an empty result. memory: pieces of text that a worker remembers; fewer take more time and change nothing else.
    """
    ship(df.sparkSession)
    return df.select(id_col, bpe_digests(df[text_col], path, memory).alias("d")).select(id_col, "d.*")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    return bpe_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
