"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are present or absent: word unigrams, the same cut to their first
four and five letters (so that inflected forms share a weight), bigrams, and skip-grams
over one and two words, hashed to ``1 << bits`` coordinates. Training sees a bounded sample of
labelled rows (about ``max_rows``) in one FTRL-proximal learner, which skips coordinates of
fewer than ``min_rows`` sampled rows; L1 leaves few weights non-zero, and these are broadcast.

Defined cases: a null or empty text has the bias alone as its score; a null id is kept;
repeated rows are scored each; a text of any length is scored whole; without labelled
rows of both classes every score is the share of toxic rows (0.0 without any).
Columns beside the id and the text are not read.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX_A, MIX_C, Words, map_arrow, mixed, remainder, sample_fraction

BITS = 21
MAX_ROWS = 12_000
MIN_ROWS = 4
EPOCHS = 6
ALPHA, BETA, L1, L2 = 0.1, 1.0, 2.5, 1.0
THRESHOLD = 0.3


def _derive(word: bytes) -> tuple[int, int, int]:
    text = unicodedata.normalize("NFKC", word.decode()).casefold()
    lo, hi = 0, len(text)
    while lo < hi and not text[lo].isalnum():
        lo += 1
    while hi > lo and not text[hi - 1].isalnum():
        hi -= 1
    text = text[lo:hi]
    digest = xxhash.xxh3_64_intdigest
    return digest(text.encode()), digest(("4:" + text[:4]).encode()), digest(("5:" + text[:5]).encode())


class Features:
    def __init__(self, bits: int = BITS):
        self.mask = np.uint64((1 << bits) - 1)
        self.words = Words(_derive, 3)

    def all(self, text: str | None) -> np.ndarray:
        """Coordinates of a text, with repeats."""
        tokens = text.encode().split() if text else []
        if not tokens:
            return np.zeros(0, np.int64)
        rows = self.words.numbers(tokens)
        h = rows[:, 0]
        parts = [h, rows[:, 1], rows[:, 2]]
        for gap in (1, 2, 3):
            if len(h) > gap:
                parts.append(mixed(h[:-gap] * MIX_A + h[gap:] * MIX_C + np.uint64(gap)))
        return (np.concatenate(parts) & self.mask).astype(np.int64)


class Ftrl:
    """FTRL-proximal with per-coordinate rates; coordinate ``1 << bits`` is the unpenalised bias."""

    def __init__(self, bits: int = BITS):
        self.size = (1 << bits) + 1
        self.z, self.n = np.zeros(self.size), np.zeros(self.size)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(np.asarray(at) == self.size - 1, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _trainer(bits: int, epochs: int, min_rows: int):
    def train(batches):
        features, rows = Features(bits), []
        for batch in batches:
            for doc, text, y in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                at = np.append(np.unique(features.all(text)), 1 << bits).astype(np.int32)
                same = xxhash.xxh3_64_intdigest(text or "")
                rows.append((same, xxhash.xxh3_64_intdigest(str(doc)), at, int(y)))
        rows.sort(key=lambda r: r[:2])  # an order that doesn't depend on how rows arrive
        rows = [(at, y) for i, (same, _, at, y) in enumerate(rows) if i == 0 or rows[i - 1][0] != same]  # copies would count as evidence
        if not rows:
            return
        seen = np.zeros((1 << bits) + 1, np.int32)
        for at, _ in rows:
            seen[at] += 1
        rows = [(y, at[seen[at] >= min(min_rows, len(rows))]) for at, y in rows]
        model = Ftrl(bits)
        for _ in range(epochs):
            for y, at in rows:
                model.learn(at, y)
        w = model.weights(np.arange(model.size))
        keep = np.flatnonzero(np.abs(w) > 1e-6)
        yield pa.record_batch({"at": pa.array(keep, pa.int64()), "w": pa.array(w[keep], pa.float64())})

    return train


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", train=None, bits: int = BITS, max_rows: int = MAX_ROWS, min_rows: int = MIN_ROWS, epochs: int = EPOCHS):
    """(coordinates, weights, prior): the sparse model. ``train`` is a filter on doc_id; the sample is bounded by ``max_rows`` rows (about)."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
    if train is not None:
        known = known.where(train)
    n, positive = known.agg(F.count("*"), F.coalesce(F.sum("_y"), F.lit(0))).first()
    if n == 0 or positive in (0, n):
        return np.zeros(0, np.int64), np.zeros(0), (positive / n if n else 0.0)
    keep = sample_fraction("doc_id", max_rows / n)
    rows = documents.select("doc_id", "text").where(keep).join(known.where(keep), "doc_id")
    out = map_arrow(rows.select(F.col("doc_id").cast("string"), "text", "_y").repartition(1), _trainer(bits, epochs, min_rows), "at long, w double")
    mean = out.toPandas()  # at most (1 << bits) + 1 rows
    return mean["at"].to_numpy(np.int64), mean["w"].to_numpy(float), positive / n


class Scorer:
    """Probability of a text under a sparse model."""

    def __init__(self, model, bits: int = BITS):
        at, w, self.prior = model
        self.dense = np.zeros((1 << bits) + 1)
        self.dense[at] = w
        self.hot, self.bias, self.known, self.features = self.dense != 0, self.dense[-1], len(at) > 0, Features(bits)

    def __call__(self, text: str | None) -> float:
        if not self.known:
            return float(self.prior)
        at = self.features.all(text)
        at = np.unique(at[self.hot[at]])
        return float(1.0 / (1.0 + np.exp(-np.clip(self.bias + self.dense[at].sum(), -500, 500))))


def score(documents: DataFrame, model, key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """``key, score`` for each row."""
    small = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema[key].dataType

    def run(batches):
        scorer = Scorer(small.value, bits)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer(t.as_py()) for t in batch.column(1)], pa.float64())], names=["k", "score"])

    picked = documents.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return map_arrow(picked, run, f"k {kind.simpleString()}, score double").withColumnRenamed("k", key)


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted``; learns from ids whose crc32 mod 4 is not 2."""
    model = fit(documents, labels, train=remainder("doc_id", 4) != 2)
    return score(documents, model).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(documents: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` with a score below ``threshold``, all columns kept."""
    at = documents.columns.index("text")
    small = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(small.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer(t.as_py()) < threshold for t in batch.column(at)], pa.bool_()))

    return map_arrow(documents, run, documents.schema)
