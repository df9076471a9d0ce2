"""Token counts by a count-only Viterbi over a unigram vocabulary.

Words are the runs between Unicode white space, each with the word mark before it. An Aho-Corasick automaton gives the
pieces that end at each character; the dynamic programme carries only the best score, its number of tokens and whether
the last one is unknown, never the path. Tie rule of the tokenizer: of equal scores the piece that starts first stays.
A character without a piece of its own is unknown, at the lowest score of all pieces less 10; runs of unknown characters
count as one token.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.llm._shared import ship
from candela.llm.bpe import SPACE

MARK, UNKNOWN, PENALTY = "▁", "<unk>", 10.0
#: Words remembered by each task, those up to LONGEST characters.
MEMORY, LONGEST = 1 << 17, 64


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, without its control and byte pieces; the unknown one is first."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return [(UNKNOWN, 0.0), *((sp.id_to_piece(i), sp.get_score(i)) for i in usual)]


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.pieces = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.pieces.add_word(piece, (len(piece), score))
        self.pieces.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - PENALTY
        self.spaces, self.odd_spaces = re.compile(f"[{SPACE}]+"), re.compile("[\x1c-\x1f]")
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Number of tokens of a word with its mark."""
        n = len(word)
        best, count, unk = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        at = 0  # characters whose best path is known
        reached = alone = False

        def close() -> None:
            # The character's own start comes last, so an unknown one must score higher than what ends here already.
            nonlocal at
            if not alone and (not reached or best[at] + self.unknown > best[at + 1]):
                best[at + 1], count[at + 1], unk[at + 1] = best[at] + self.unknown, count[at] + (not unk[at]), True
            at += 1

        for end, (length, score) in self.pieces.iter(word):
            while at < end:
                close()
                reached = alone = False
            start = end + 1 - length
            alone = alone or length == 1
            if not reached or best[start] + score > best[end + 1]:
                reached = True
                best[end + 1], count[end + 1], unk[end + 1] = best[start] + score, count[start] + 1, False
        while at < n:
            close()
            reached = alone = False
        return count[n]

    def text(self, text: str) -> int:
        words = [w for w in self.spaces.split(text) if w] if self.odd_spaces.search(text) else text.split()
        counts = list(map(self.known.get, words))
        if None in counts:
            for k, c in enumerate(counts):
                if c is None:
                    counts[k] = self.recall(words[k])
        return sum(counts)

    def recall(self, w: str) -> int:
        if (c := self.known.get(w)) is None:
            c = self.word(MARK + w)
            if len(w) <= LONGEST:
                if len(self.known) >= MEMORY:
                    self.known.clear()
                self.known[w] = c
        return c


def count_tokens(text: Column, path: str) -> Column:
    """Tokens of a text column, long; null and empty texts have 0."""

    @F.pandas_udf("long")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(unigram_vocabulary(path))
        for batch in batches:
            yield pd.Series([counter.text(t or "") for t in batch], dtype="int64")

    return counts(text)


def with_token_counts(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """df with a column n_tokens (a column of this name is replaced). Whole texts, no shuffle.

    Null and empty texts have 0; rows that repeat give a row each; an empty table gives an empty result.
    """
    ship(df.sparkSession)
    return df.withColumn("n_tokens", count_tokens(df[text_col], path))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    return with_token_counts(docs, vocabulary_path()).drop("text")
