"""Language identification: string kernels, Nyström landmarks, kernel ridge regression.

The kernel is the blended spectrum of presence: K(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|)
where G(x) is the set of (hashed) character n-grams of 1 to ``MAX_N`` characters of the whole
text in lower case. A bounded sample of ``max_rows`` labelled rows, and of ``least_rows`` of each rarer language
(all of them if it has fewer), gives ``landmarks`` landmarks (as many for each language as can be) and the ridge regression in their Nyström
space, one language against the rest. Since the kernel is a dot product of presence
vectors, landmarks and coefficients fold into one matrix; a batch of texts is scored by
one product of its presence matrix with it.

Defined cases: a null text or one without a letter is ``und`` with score 0; equal margins
go to the alphabetically first language; a table without labelled rows predicts ``und``
everywhere; very long texts are read whole; ids may be null or repeated; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MIX_A, map_arrow, remainder, sample_fraction

BITS, MAX_N = 16, 4
MAX_ROWS, LEAST_ROWS, LANDMARKS, RIDGE = 4000, 50, 240, 1e-2
BATCH = 128


def grams(text: str) -> np.ndarray:
    """Sorted distinct hashed n-grams of a text."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    seen = np.zeros(1 << BITS, bool)
    h = np.zeros(len(a) + 1, np.uint64)
    for n in range(1, MAX_N + 1):
        if len(a) < n:
            break
        h = h[:-1] * MIX_A + a[n - 1 :] + np.uint64(1)
        g = h + np.uint64(n)
        g = (g ^ (g >> np.uint64(29))) * MIX_A
        seen[(g >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return np.flatnonzero(seen)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def kernel(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Blended-spectrum presence kernel between two lists of gram sets."""
    y_dense = np.zeros((1 << BITS, len(y)), np.float32)
    for j, g in enumerate(y):
        y_dense[g, j] = 1 / np.sqrt(max(1, len(g)))
    return np.array([y_dense[g].sum(0) / np.sqrt(max(1, len(g))) for g in x]).reshape(len(x), len(y))


def _solver(landmarks: int):
    """One bounded sample in, the columns used and the folded matrix out."""

    def solve(batches):
        rows = []
        for batch in batches:
            for doc, text, lang in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if text and has_letter(text):
                    rows.append((xxhash.xxh3_64_intdigest(str(doc)), lang, grams(text).astype(np.int32)))
        rows.sort(key=lambda r: (r[0], r[1]))
        if not rows:
            return
        langs = sorted({r[1] for r in rows})
        by = {x: [r[2] for r in rows if r[1] == x] for x in langs}
        marks = [g for x in langs for g in by[x][: max(1, landmarks // len(langs))]]
        sets = [r[2] for r in rows]
        y = np.array([[1.0 if r[1] == x else -1.0 for x in langs] for r in rows])
        k_mm, k_nm = kernel(marks, marks).astype(float), kernel(sets, marks).astype(float)
        value, vector = np.linalg.eigh(k_mm)
        keep = value > 1e-6 * value.max()
        to_space = vector[:, keep] / np.sqrt(value[keep])
        phi = np.hstack([k_nm @ to_space, np.ones((len(sets), 1))])
        weight = 1.0 / y.shape[0] * np.ones(len(sets))
        beta = np.linalg.solve((phi * weight[:, None]).T @ phi + RIDGE / len(sets) * np.eye(phi.shape[1]), (phi * weight[:, None]).T @ y)
        alpha = to_space @ beta[:-1]
        folded = np.zeros((1 << BITS, len(langs)), np.float32)
        for g, a in zip(marks, alpha, strict=True):
            folded[g] += (a / np.sqrt(max(1, len(g)))).astype(np.float32)
        for j, x in enumerate(langs):
            yield pa.record_batch({"lang": [x], "bias": [float(beta[-1, j])], "column": pa.array([folded[:, j].tobytes()], pa.binary())})

    return solve


def fit(documents: DataFrame, train: Column | None = None, max_rows: int = MAX_ROWS, landmarks: int = LANDMARKS, least_rows: int = LEAST_ROWS):
    """(languages, biases, matrix) from about ``max_rows`` labelled rows and ``least_rows`` of each rarer language."""
    known = documents.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    if train is not None:
        known = known.where(train)
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row for each language, like the model
    n = sum(sizes.values())
    if not n:
        return [], np.zeros(0), np.zeros((1 << BITS, 0), np.float32)
    rare = {x: least_rows / k for x, k in sizes.items() if least_rows * n > max_rows * k}
    keep = F.when(F.col("lang").isin(list(rare)), F.lit(False)).otherwise(sample_fraction("doc_id", max_rows / n))
    for x, rate in rare.items():
        keep = keep | ((F.col("lang") == x) & sample_fraction("doc_id", rate))
    sample = known.where(keep).select(F.col("doc_id").cast("string"), "text", "lang").repartition(1)
    rows = sorted(map_arrow(sample, _solver(landmarks), "lang string, bias double, column binary").collect(), key=lambda r: r["lang"])  # a row for each language
    if not rows:
        return [], np.zeros(0), np.zeros((1 << BITS, 0), np.float32)
    return [r["lang"] for r in rows], np.array([r["bias"] for r in rows]), np.stack([np.frombuffer(r["column"], np.float32) for r in rows], 1)


def predict(documents: DataFrame, model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred, score`` for each row."""
    small = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches):
        langs, bias, matrix = small.value
        presence = np.zeros((BATCH, 1 << BITS), np.float32)
        for batch in batches:
            texts = batch.column(1)
            pred, scores = ["und"] * len(texts), np.zeros(len(texts))
            for at in range(0, len(texts), BATCH if langs else max(1, len(texts))):
                part = [texts[i].as_py() for i in range(at, min(at + BATCH, len(texts)))]
                use = [i for i, t in enumerate(part) if t and has_letter(t)] if langs else []
                sizes = np.ones(len(use))
                for j, i in enumerate(use):
                    g = grams(part[i])
                    presence[j] = 0
                    presence[j, g] = 1
                    sizes[j] = max(1, len(g))
                margin = presence[: len(use)] @ matrix / np.sqrt(sizes)[:, None] + bias
                for j, i in enumerate(use):
                    best = int(margin[j].argmax())
                    pred[at + i], scores[at + i] = langs[best], float(np.clip((margin[j, best] + 1) / 2, 0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(scores, pa.float64())], names=["k", "lang_pred", "score"])

    picked = documents.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return map_arrow(picked, run, f"k {kind}, lang_pred string, score double").withColumnRenamed("k", key)


def language(documents: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; learns from ids whose crc32 mod 3 is not 1."""
    model = fit(documents, remainder("doc_id", 3) != 1)
    return predict(documents, model).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
