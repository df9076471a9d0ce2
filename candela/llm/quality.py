"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata of the text.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)), linear in the number of
features. It is fitted on a bounded sample of labelled rows (SAMPLE, those with the smallest hash of their id); every
text is read whole and scored where it lies.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.llm._shared import ship

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 12_000
BUCKETS, RANK, THRESHOLD = 1 << 12, 8, 0.3
#: Passes over the sample, and rows seen in all of them at least.
EPOCHS, SEEN = 8, 60_000
#: Words of a text hashed at once, and words remembered by each task, those up to LONGEST bytes.
BLOCK, MEMORY, LONGEST = 1 << 16, 1 << 16, 64
#: Structure statistics, then metadata: the text's length and number of lines as powers of two, one feature each.
STATS, LENGTHS, LINES = 15, 24, 16
WIDTH = BUCKETS + STATS + LENGTHS + LINES

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARKS = np.zeros(256, bool)
_MARKS[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_USUAL = np.zeros(256, bool)
_USUAL[[ord(c) for c in ".,'-"]] = True


class Featurizer:
    """Text -> (feature indices, values), sparse. Empty and null texts have their metadata features alone."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def bucket(self, word: bytes) -> int:
        if (b := self.known.get(word)) is None:
            b = zlib.crc32(word.lower()) % BUCKETS
            if len(word) <= LONGEST:
                if len(self.known) >= MEMORY:
                    self.known.clear()
                self.known[word] = b
        return b

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        data = (text or "").encode(errors="surrogatepass")
        size, words = len(data), data.split()
        n, counts, ends = len(words), np.zeros(BUCKETS), 0
        for k in range(0, n, BLOCK):
            counts += np.bincount(np.fromiter(map(self.bucket, words[k : k + BLOCK]), dtype=np.int64), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        value = np.log1p(counts[at])
        value /= np.linalg.norm(value) or 1.0
        stats = np.zeros(STATS)
        lines = data.split(b"\n")
        if n:
            b = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
            letters = max(1, b[65:91].sum() + b[97:123].sum() + b[128:].sum())
            ends = sum(w[-1] < 128 and not w[-1:].isalnum() for w in words)
            full = [x for x in lines if x.strip()]
            stats[:] = [
                b[_UPPER].sum() / letters, b[_DIGIT].sum() / size, b[_MARKS & ~_USUAL].sum() / size, b[_MARKS & _USUAL].sum() / size,
                b[128:].sum() / size, min(1.0, b[124] / n), min(1.0, b[33] / n), min(1.0, b[[35, 36, 37, 38, 42]].sum() / n),
                ends / n, len(set(words)) / n, min(1.0, size / n / 20), 1 - len(set(full)) / max(1, len(full)),
                min(1.0, len(full) / n), sum(w.isupper() and len(w) > 1 for w in words) / n,
                sum(map(bytes.__eq__, words, words[1:])) / n,
            ]
        tail = np.flatnonzero(stats)
        length, rows = min(LENGTHS - 1, size.bit_length()), min(LINES - 1, len(lines).bit_length())
        index = np.concatenate((at, BUCKETS + tail, [BUCKETS + STATS + length, BUCKETS + STATS + LENGTHS + rows]))
        return index.astype(np.int32), np.concatenate((value, stats[tail], [0.5, 0.5])).astype(np.float32)


class FactorisationMachine:
    """Second-order factorisation machine for labels 0 and 1, fitted with AdaGrad on mini-batches in a fixed order."""

    def __init__(self, width: int = WIDTH, rank: int = RANK, seed: int = 11):
        self.rng = np.random.default_rng(seed)
        self.w0, self.w = 0.0, np.zeros(width, np.float32)
        self.v = self.rng.normal(0, 0.05, (width, rank)).astype(np.float32)

    def margin(self, index: np.ndarray, value: np.ndarray) -> float:
        """One row, in time linear in its features."""
        vx = self.v[index] * value[:, None]
        total = vx.sum(axis=0)
        return float(self.w0 + self.w[index] @ value + 0.5 * (total @ total - np.square(vx).sum()))

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(index, value), -30, 30))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, seen: int = SEEN, batch: int = 64, rate: float = 0.1, decay: float = 1e-5) -> "FactorisationMachine":
        """epochs passes, or more until `seen` rows have been seen. Without rows it stays as it is."""
        if not rows:
            return self
        gw, gv, g0 = np.full_like(self.w, 1e-2), np.full_like(self.v, 1e-2), 1e-2
        for _ in range(max(epochs, -(-seen // max(1, len(rows))))):
            order = self.rng.permutation(len(rows))
            for k in range(0, len(order), batch):
                part = [rows[i] for i in order[k : k + batch]]
                sizes = np.array([len(i) for i, _ in part])
                index, value = np.concatenate([i for i, _ in part]), np.concatenate([x for _, x in part])
                row, at = np.repeat(np.arange(len(part)), sizes), np.concatenate(([0], np.cumsum(sizes)[:-1]))
                vx = self.v[index] * value[:, None]
                total = np.add.reduceat(vx, at, axis=0)
                margin = self.w0 + np.add.reduceat(self.w[index] * value, at) + 0.5 * (np.square(total).sum(1) - np.add.reduceat(np.square(vx).sum(1), at))
                slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[order[k : k + batch]]).astype(np.float32)
                used, place = np.unique(index, return_inverse=True)
                dw, dv = np.zeros(len(used), np.float32), np.zeros((len(used), self.v.shape[1]), np.float32)
                each = slope[row] * value
                np.add.at(dw, place, each)
                np.add.at(dv, place, each[:, None] * (total[row] - vx))
                dw, dv = dw / len(part) + decay * self.w[used], dv / len(part) + decay * self.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= rate * dv / np.sqrt(gv[used])
                d0 = float(slope.mean())
                g0 += d0 * d0
                self.w0 -= rate * d0 / g0**0.5
        return self


def held_out(id_column: Column) -> Column:
    """Rows that labels are never learnt from: crc32 of the id's text, modulo 5, is 0."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _features(batches: Iterator) -> Iterator[pd.DataFrame]:
    featurize = Featurizer()
    for pdf in batches:
        rows = [featurize(t) for t in pdf["text"]]
        yield pd.DataFrame({"id": pdf["id"], "label": pdf["label"], "at": [i.tobytes() for i, _ in rows], "x": [x.tobytes() for _, x in rows]})


def fit_quality(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> FactorisationMachine:
    """Model fitted on `sample` labelled rows at most, none of them held out. Labels other than 0 and 1 are left out.

    Only the sample's features reach the driver: `sample` rows, each with BUCKETS features at most. Texts stay away.
    """
    ship(docs.sparkSession)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(known), "id")
    got = rows.mapInPandas(_features, "id long, label int, at binary, x binary").orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    pairs = [(np.frombuffer(a, np.int32), np.frombuffer(x, np.float32)) for a, x in zip(got["at"], got["x"])]
    return FactorisationMachine().fit(pairs, got["label"].to_numpy(dtype=np.float32))


def quality_score(text: Column, model: FactorisationMachine) -> Column:
    """Score in 0..1 of a text column, higher: label 1 likelier; null and empty texts have one too."""
    w0, w, v = model.w0, model.w, model.v

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine, featurize = FactorisationMachine(1), Featurizer()
        machine.w0, machine.w, machine.v = w0, w, v
        for texts in batches:
            yield pd.Series([machine.score(*featurize(t)) for t in texts], dtype="float64")

    return F.pandas_udf(scores, "double")(text)


def quality_report(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, held_out, score, predicted. Rows stay where they are.

    Null and empty texts have a score; a null id counts as empty text for held_out; rows that repeat give a row each; other
    columns are left out; an empty table gives an empty result, and without labels every margin is that of an unfitted model.
    """
    model = fit_quality(docs, labels, text_col, id_col)
    out = docs.select(docs[id_col], held_out(docs[id_col]).alias("held_out"), quality_score(docs[text_col], model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the model doesn't reject, with their columns alone."""
    model = fit_quality(docs, labels, text_col, id_col)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    packed = docs.select(*(docs[c].alias(n) for c, n in zip(docs.columns, names)), docs[text_col].alias("_text"))
    kept = packed.withColumn("_score", quality_score(F.col("_text"), model)).where(F.col("_score") >= threshold)
    return kept.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names)))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    return quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
