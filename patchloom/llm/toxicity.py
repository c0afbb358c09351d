"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Every document is the set of its hashed unigrams, bigrams and skip-grams. The
model is fitted on at most `MAX_TRAINING_ROWS` labelled rows, those with the
smallest hashes, in one task; per-coordinate rates and L1 leave few weights,
which are broadcast (2 ** BITS of them at most) to score every document.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.llm.common import crc_of_id, cut, only

BITS = 20
#: Gaps of the word pairs: 1 is a bigram, more a skip-gram.
GAPS = (1, 2, 3)
MAX_TRAINING_ROWS = 20_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.1
CUTOFF = 0.3
#: The log odds of a document about which nothing is known, as where no row is labelled.
UNTRAINED = -4.0
WORD = re.compile(r"\w+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Codes(dict):
    """Hashes of words, kept for words seen before; emptied when it has grown to a million words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        raw = word.encode("utf-8", "surrogatepass")
        h = self[word] = zlib.crc32(raw) << 32 | zlib.adler32(raw)
        return h


def features(text: str | None, codes: Codes, bits: int = BITS) -> np.ndarray:
    """The distinct feature numbers of a text; number 0 is the bias, which every text has."""
    words = WORD.findall((text or "").lower())
    h = np.fromiter(map(codes.__getitem__, words), dtype=np.uint64, count=len(words)) * _ODD
    parts = [h]
    for gap in GAPS:
        if len(h) > gap:
            parts.append((h[:-gap] * _ODD + h[gap:] + np.uint64(min(gap, 2))) * _ODD)
    at = np.concatenate(parts)
    at = (at ^ (at >> np.uint64(32))) * _ODD >> np.uint64(64 - bits)
    return np.concatenate([[0], np.unique(np.maximum(at, 1)).astype(np.int64)])


def sigmoid(x: float) -> float:
    x = max(-35.0, min(35.0, x))
    return 1 / (1 + math.exp(-x))


class Ftrl:
    """FTRL-proximal over binary features: z and n per coordinate, weights made when needed."""

    def __init__(self, bits: int = BITS):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 0, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = sigmoid(float(w.sum())) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _is_held_out(key: str) -> Column:
    return F.pmod(crc_of_id(key), F.lit(4)) == 2


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", bound: int = MAX_TRAINING_ROWS) -> DataFrame:
    """label, text, turn: the labelled rows with the smallest hashes, `bound` at most, never held-out ones.

    A key with contradicting labels counts as toxic; null labels are no labels. A key that
    repeats among the documents has a row for each, which count towards the bound.
    """
    known = only(labels, key, "toxic").filter(f"`{key}` is not null and toxic is not null").filter(~_is_held_out(key))
    known = known.groupBy(key).agg(F.max("toxic").alias("label")).withColumn("turn", F.xxhash64(F.lit("turn"), key))
    # The number of rows is bounded by the parameter, so the ids can be broadcast.
    first = F.broadcast(cut(known.orderBy("turn", key).limit(bound)))
    rows = only(docs, key, text).join(first, key).select("label", F.col(text).alias("text"), "turn")
    # A key that repeats among the documents brings more rows than labels.
    return rows.orderBy("turn", F.xxhash64("text"), "label").limit(bound)


def fit(rows: DataFrame, bits: int = BITS) -> dict[int, float]:
    """The weights other than zero. `rows` are bounded; they are learned in the order of their hashes in one task."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, seen = Codes(), []
        for batch in batches:
            seen += [(features(t, codes, bits).astype(np.uint32), y) for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        model = Ftrl(bits)
        for _ in range(EPOCHS):
            for at, y in seen:
                model.learn(at.astype(np.int64), y)
        every = np.flatnonzero(model.n)
        w = model.weights(every)
        yield pa.RecordBatch.from_arrays([pa.array(every[w != 0], pa.int64()), pa.array(w[w != 0], pa.float64())], ["at", "w"])

    one = rows.repartition(1).sortWithinPartitions("turn", "text").select("label", "text")
    return {r.at: r.w for r in one.mapInArrow(learn, "at long, w double").collect()}


def score(docs: DataFrame, weights: dict[int, float], key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), bits: int = BITS) -> DataFrame:
    """key, the columns to keep, held_out, score and predicted for every row; null and empty texts are scored by the bias."""
    cols = [c for c in dict.fromkeys((key, *keep)) if c != text] + [text]
    numbers = np.fromiter(weights, dtype=np.int64, count=len(weights))
    values = np.fromiter(weights.values(), dtype=np.float64, count=len(weights))
    sent = docs.sparkSession.sparkContext.broadcast((numbers, values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(1 << bits)
        w[sent.value[0]] = sent.value[1]
        if not len(sent.value[0]):
            w[0] = UNTRAINED
        codes = Codes()
        for batch in batches:
            s = [sigmoid(float(w[features(t, codes, bits)].sum())) for t in batch.column(len(cols) - 1).to_pylist()]
            kept = [batch.column(i) for i in range(len(cols)) if cols[i] != text or text in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(s, pa.float64())], [*out, "score"])

    out = [c for c in cols if c != text or text in keep]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in out) + ", score double"
    scored = only(docs, *cols).mapInArrow(run, schema)
    return scored.select(*[F.col(f"`{c}`") for c in out], _is_held_out(key).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Fits on the labelled rows that are not held out and scores every row; empty tables give empty results."""
    return score(docs, fit(training_rows(docs, labels, key, text)), key, text, keep)
