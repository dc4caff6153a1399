"""Interpolated modified Kneser-Ney bigram model, counted in Spark and scored from memory maps.

Tokens are the words of a text with A-Z in lower case, then one end token; n-grams do
not cross texts (a start marker stands before the first token). Tasks count bigrams and tokens of
a few million tokens at a time and deal them, packed, to shards: tokens by token, bigrams by context; the bigrams of a
frequent context are dealt by context and word together, so they are in all shards alike. Which contexts are frequent is guessed from a sample
of about ``SAMPLE_TOKENS`` tokens (``MOST_HOT`` contexts at most); any guess gives the same model. A shard adds them up. From its distinct bigrams it hands on
what each context adds up to and how many contexts each token follows, which a second round adds up by
context and by token. Every shard is written as sorted hash arrays to the shared folder, under a name that follows from its kind and
number and appears only when the file is whole (a repeated task writes the same again); the driver gets a few sums and no list of files.
Workers memory-map the files (from a store that can't be mapped a file, which ``SHARD_TOKENS`` bounds, is
read when it is needed and dropped) and look up the distinct words and bigrams of a few million tokens at a time, in sorted order.

p(w | h) = max(c(h w) - D(c(h w)), 0) / c(h) + gamma(h) p(w), and
p(w) = max(k(w) - D'(k(w)), 0) / k(.) + gamma' / (V + 1), k(w) being the number of contexts of
w, each level with three discounts from its counts of counts, V the distinct training tokens;
one unknown word shares the uniform part. A context never seen leaves p(w).
Words are told apart by 48 bits of their hash, bigrams by 64.

Defined cases: a null or empty text is the end token alone; repeated rows count each; very
long texts are read whole; without training rows every token has probability 1; a null id
trains (its remainder is 0); other columns are not read.
"""

from __future__ import annotations

import pickle
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MIX_A, ascii_words, below, cut, files_for, fresh_dir, local_path, map_arrow, mixed, open_input, remainder, whole_output, word_hashes

SHARD_TOKENS = 3_000_000
FLUSH = 2_000_000
SAMPLE_TOKENS, MOST_HOT = 1_000_000, 10_000
END, START = np.uint64(0x5EED0FE2D), np.uint64(0x57A27)
ID = np.uint64((1 << 48) - 1)
ROWS = "kind string, shard int, data binary, sums array<bigint>"
SCHEMA = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("data", pa.binary()), ("sums", pa.list_(pa.int64()))])


def token_hashes(text: str | None) -> np.ndarray:
    """Ids of the tokens of a text, the end token included."""
    tokens = ascii_words(text)
    return np.append(word_hashes(tokens) & ID, END)


def gram(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(mixed(context * MIX_A) ^ word)


def _split(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (ids >> np.uint64(32)).astype(np.uint16), ids.astype(np.uint32)


def _joined(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(np.uint64) << np.uint64(32)) | low


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((mixed(h) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _added(keys: np.ndarray, *counts: np.ndarray):
    """Distinct sorted keys with the sums of their counts."""
    if not len(keys):
        return keys, *counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], *(np.add.reduceat(c[order].astype(np.int64), first) for c in counts)


def _small(counts: np.ndarray) -> np.ndarray:
    """Counts in the narrowest type that holds them all."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def bigram_shard(context: np.ndarray, g: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each bigram (hash ``g``); ``hot`` has the contexts that are dealt by bigram."""
    at = np.minimum(np.searchsorted(hot, context), max(len(hot) - 1, 0))
    often = hot[at] == context if len(hot) else np.zeros(len(context), bool)
    return shard_of(np.where(often, g, context), shards)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _packed(arrays) -> bytes:
    """Integer arrays behind their number, types and lengths: 6 bytes each, as a flush gives a shard little where shards are many."""
    return b"".join([bytes([len(arrays)]), *(struct.pack("<2sI", a.dtype.str[1:].encode(), len(a)) for a in arrays), *(a.tobytes() for a in arrays)])


def _unpacked(blob: bytes) -> list[np.ndarray]:
    at, out = 1 + 6 * blob[0], []
    for i in range(blob[0]):
        kind, length = struct.unpack_from("<2sI", blob, 1 + 6 * i)
        out.append(np.frombuffer(blob, "<" + kind.decode(), length, at))
        at += out[-1].nbytes
    return out


def _by_shard(kind: str, shard: np.ndarray, shards: int, pack):
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in range(shards):
        rows = order[cuts[s] : cuts[s + 1]]
        if len(rows):
            yield kind, s, _packed(pack(rows)), None


def _flush(tokens: list[np.ndarray], shards: int, hot: np.ndarray):
    """Packed counts of some texts for each shard."""
    words = np.concatenate(tokens)
    before = np.concatenate([np.concatenate([[START], t[:-1]]) for t in tokens]).astype(np.uint64)
    single, n = np.unique(words, return_counts=True)
    yield from _by_shard("tokens", shard_of(single, shards), shards, lambda r: (*_split(single[r]), _small(n[r])))
    order = np.lexsort((words, before))
    before, words = before[order], words[order]
    first = np.flatnonzero(np.concatenate([[True], (before[1:] != before[:-1]) | (words[1:] != words[:-1])]))
    count = np.diff(np.concatenate([first, [len(words)]]))
    before, words = before[first], words[first]

    def pack(r):  # each context once
        first = _runs(before[r])
        return *_split(before[r][first]), _small(np.diff(np.append(first, len(r)))), *_split(words[r]), _small(count[r])

    yield from _by_shard("bigrams", bigram_shard(before, gram(before, words), hot, shards), shards, pack)


def _counter(shards: int, hot: np.ndarray):
    def run(batches):
        held, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(token_hashes(text.as_py()))
                size += len(held[-1])
                if size >= FLUSH:
                    yield _table(_flush(held, shards, hot))
                    held, size = [], 0
        if held:
            yield _table(_flush(held, shards, hot))

    return run


def _table(rows) -> pa.RecordBatch:
    rows = list(rows)
    return pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(SCHEMA)], schema=SCHEMA)


def _path(folder: str, kind: str, shard: int) -> str:
    return f"{folder}/{kind}-{shard:08d}"


def _save(folder: str, kind: str, shard: int, *arrays: np.ndarray) -> None:
    """Arrays, each at a multiple of 8 bytes, behind their lengths and type names."""
    head = pickle.dumps([(str(a.dtype), len(a)) for a in arrays])
    with whole_output(_path(folder, kind, shard)) as f:
        f.write(len(head).to_bytes(8, "little") + head + b"\0" * (-len(head) % 8))
        for a in arrays:
            f.write(memoryview(np.ascontiguousarray(a)).cast("B") if len(a) else b"")
            f.write(b"\0" * (-a.nbytes % 8))


def _load(path: str) -> list[np.ndarray] | None:
    """The arrays of a file, memory-mapped where that can be; None if there is none."""
    where = local_path(path)
    try:
        if where is None:
            with open_input(path) as f:
                raw = np.frombuffer(f.read(), np.uint8)
        else:
            raw = np.memmap(where, np.uint8, "r")
    except FileNotFoundError:
        return None
    n = int.from_bytes(raw[:8].tobytes(), "little")
    at, out = 8 + n + -n % 8, []
    for kind, length in pickle.loads(raw[8 : 8 + n].tobytes()):
        size = np.dtype(kind).itemsize * length
        out.append(raw[at : at + size].view(kind))
        at += size + -size % 8
    return out


def _counts_of_counts(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def _bytes_and_more(count: np.ndarray):
    """Counts in a byte each; 255 stands for the count at its place in the second pair of arrays."""
    more = np.flatnonzero(count >= 255)
    return np.minimum(count, 255).astype(np.uint8), more.astype(np.int64), count[more].astype(np.int64)


def _merge(kind: str, shard: int, blobs: list[bytes], folder: str, shards: int):
    """Adds a shard up, writes it, and gives its sums (counts of counts and totals) and what the next round needs."""
    parts = list(map(_unpacked, blobs))
    every = lambda i: np.concatenate([p[i] for p in parts])
    ids = _joined(every(0), every(1))
    if kind == "bigrams":
        ids = np.repeat(ids, every(2))
    if kind in ("tokens", "follows"):
        keys, count = _added(ids, every(2))
        _save(folder, kind, shard, keys, count)
        yield kind, shard, None, [*_counts_of_counts(count), int((count >= 3).sum()), int(count.sum()), len(keys)]
        return
    if kind == "contexts":
        _save(folder, kind, shard, *_added(ids, *map(every, range(2, 6))))
        return
    w, count = _joined(every(3), every(4)), every(5).astype(np.int64)
    del parts
    order = np.lexsort((w, ids))
    context, w, count = ids[order], w[order], count[order]
    del order, ids
    first = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (w[1:] != w[:-1])]))
    count = np.add.reduceat(count, first)
    context, w = context[first], w[first]
    own = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    totals = [np.add.reduceat(x.astype(np.int64), own) for x in (count, count == 1, count == 2, count >= 3)]
    contexts = context[own]
    yield from _by_shard("contexts", shard_of(contexts, shards), shards, lambda r: (*_split(contexts[r]), *(_small(t[r]) for t in totals)))
    g = gram(context, w)
    order = np.argsort(g)
    _save(folder, "bigrams", shard, g[order], *_bytes_and_more(count[order]))
    yield "bigrams", shard, None, [*_counts_of_counts(count), 0, 0, 0]
    single, n = np.unique(w, return_counts=True)
    yield from _by_shard("follows", shard_of(single, shards), shards, lambda r: (*_split(single[r]), _small(n[r])))


def _merger(folder: str, shards: int):
    """Rows with data are merged; those with sums, of the round before, are passed on."""

    def run(batches):
        key, held, passed = None, [], []
        for batch in batches:
            sums = batch.column(3).to_pylist()
            for i, (kind, shard, data) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)):
                if not data.is_valid:
                    passed.append((kind, shard, None, sums[i]))
                    continue
                if (kind, shard) != key:
                    if held:
                        yield _table(_merge(*key, held, folder, shards))
                    key, held = (kind, shard), []
                held.append(data.as_py())
        if held:
            yield _table(_merge(*key, held, folder, shards))
        yield _table(passed)

    return run


def _discounts(n: list[int]) -> np.ndarray:
    """D for counts 0, 1, 2 and 3 or more."""
    n1, n2, n3, n4 = n
    if not n1:
        return np.zeros(4)
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(x, 0.0), k) for k, x in zip((1, 2, 3), d, strict=True))])


def _words_of(batches):
    for batch in batches:
        tokens = [token_hashes(t.as_py()) for t in batch.column(0)]
        w, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *tokens]), return_counts=True)
        yield pa.record_batch({"w": pa.array(w.astype(np.int64)), "n": pa.array(n.astype(np.int64))})


def frequent(texts: DataFrame, size: float, shards: int) -> np.ndarray:
    """Sorted ids of the words that may be contexts of a tenth of a shard or more, and the start marker."""
    if shards == 1:
        return np.zeros(0, np.uint64)
    few = below(F.xxhash64(F.lit("hot"), "text"), SAMPLE_TOKENS / size)
    counts = map_arrow(texts.where(few), _words_of, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "w").limit(MOST_HOT).collect()
    least = min(SAMPLE_TOKENS, size) / (10 * shards)
    return np.sort(np.array([int(START), *(r["w"] for r in top if r["n"] >= least)], np.uint64))


def train(texts: DataFrame, text: str = "text", folder: str | None = None, shard_tokens: int = SHARD_TOKENS) -> dict:
    """Counts ``texts`` and returns the model: its files by shard and a few sums."""
    spark = texts.sparkSession
    folder = folder or fresh_dir(spark, "lm")
    picked = texts.select(F.col(text).cast("string").alias("text"))
    size = picked.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) / 6 + 1)).first()[0]
    if size is None:
        return {"shards": 0, "N": 0, "V": 0}
    shards = max(1, -(-int(size) // shard_tokens))

    def merged(rows):
        return map_arrow(rows.repartition(shards, "kind", "shard").sortWithinPartitions("kind", "shard"), _merger(folder, shards), ROWS)

    hot = frequent(picked, size, shards)
    done = cut(merged(merged(map_arrow(picked, _counter(shards, hot), ROWS))), files_for(picked))
    told = done.select("kind", F.posexplode("sums")).groupBy("kind", "pos").agg(F.sum("col").alias("n"))
    sums: dict[str, list[int]] = {k: [0] * 7 for k in ("tokens", "bigrams", "follows")}
    for row in told.collect():  # seven numbers for each of three kinds
        sums[row["kind"]][row["pos"]] = row["n"]
    low = sums["follows"]
    return {
        "shards": shards, "hot": hot, "folder": folder, "N": sums["tokens"][5], "V": sums["tokens"][6], "D2": _discounts(sums["bigrams"][:4]), "D1": _discounts(low[:4]),
        "K": low[5], "spread": (low[0], low[1], low[4]),
    }


class Model:
    """Look-ups of a trained model; files are mapped when first needed."""

    def __init__(self, state: dict):
        self.s, self.open = state, {}
        if state["N"]:
            self.mapped = local_path(state["folder"]) is not None
            self.gamma1 = float(np.dot(state["D1"][1:], state["spread"])) / state["K"]

    def find(self, kind: str, keys: np.ndarray, shard: np.ndarray, width: int = 1) -> np.ndarray:
        """Values of sorted distinct keys, 0 where absent: (len(keys), width)."""
        out = np.zeros((len(keys), width), np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.s["shards"] + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            path = _path(self.s["folder"], kind, int(s))
            arrays = self.open.get(path) or _load(path)
            if arrays is None or not len(arrays[0]):
                continue
            if self.mapped:
                self.open[path] = arrays
            have, *values = arrays
            rows = order[cuts[s] : cuts[s + 1]]
            at = np.minimum(np.searchsorted(have, keys[rows]), len(have) - 1)
            hit = have[at] == keys[rows]
            rows, at = rows[hit], at[hit]
            if kind == "bigrams":
                count = values[0][at].astype(np.int64)
                more = np.flatnonzero(count == 255)
                count[more] = values[2][np.searchsorted(values[1], at[more])]
                out[rows, 0] = count
            else:
                for i in range(width):
                    out[rows, i] = values[i][at]
        return out

    def score(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known tokens, base score, score) of token arrays."""
        s, lengths = self.s, np.array(list(map(len, texts)))
        if not s["N"]:
            return np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts))
        words = np.concatenate(texts)
        start = np.cumsum(lengths) - lengths
        before = np.concatenate([[START], words[:-1]])
        before[start] = START
        single, at = np.unique(np.append(words, START), return_inverse=True)
        at, ctx_at = at[:-1], np.empty(len(words), np.int64)
        ctx_at[1:] = at[:-1]
        ctx_at[start] = np.searchsorted(single, START)
        shard = shard_of(single, s["shards"])
        count = self.find("tokens", single, shard)[:, 0]
        follows = self.find("follows", single, shard)[:, 0]
        p1 = np.maximum(follows - s["D1"][np.minimum(follows, 3)], 0) / s["K"] + self.gamma1 / (s["V"] + 1)
        ctx = self.find("contexts", single, shard, 4).astype(float)
        g, g_at = np.unique(gram(before, words), return_inverse=True)
        owner = np.zeros(len(g), np.uint64)
        owner[g_at] = before
        c = self.find("bigrams", g, bigram_shard(owner, g, s["hot"], s["shards"]))[:, 0]
        top = np.maximum(c - s["D2"][np.minimum(c, 3)], 0)
        h = ctx[ctx_at]
        seen = h[:, 0] > 0
        total = np.where(seen, h[:, 0], 1.0)
        p = np.where(seen, top[g_at] / total + (h[:, 1:] @ s["D2"][1:]) / total * p1[at], p1[at])
        base = np.log10((count + 1) / (s["N"] + s["V"] + 1))
        return np.add.reduceat((count[at] > 0).astype(np.int64), start), np.add.reduceat(base[at], start), np.add.reduceat(np.log10(p), start)


def score(documents: DataFrame, state: dict, key: str = "doc_id", text: str = "text", flush: int = FLUSH) -> DataFrame:
    """``key, n_tokens, n_known, base_score, score`` of each row."""
    held = documents.sparkSession.sparkContext.broadcast(state)  # a folder, a few numbers and ``MOST_HOT`` words
    kind = documents.schema[key].dataType.simpleString()

    def run(batches):
        model = Model(held.value)
        for batch in batches:
            texts = batch.column(1)
            out: list[list[np.ndarray]] = [[], [], [], []]
            part, size = [], 0
            for i in range(len(texts)):
                part.append(token_hashes(texts[i].as_py()))
                size += len(part[-1])
                if size >= flush or i == len(texts) - 1:
                    for o, v in zip(out, (np.array(list(map(len, part))), *model.score(part)), strict=True):
                        o.append(v)
                    part, size = [], 0
            arrays = [pa.array(np.concatenate(o) if o else [], t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["k", "n_tokens", "n_known", "base_score", "score"])

    picked = documents.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return map_arrow(picked, run, f"k {kind}, n_tokens long, n_known long, base_score double, score double").withColumnRenamed("k", key)


def lm_scores(documents: DataFrame, train_rows: Column | None = None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``; learns from ids whose crc32 mod 7 is not 2."""
    held_out = remainder("doc_id", 7) == 2
    state = train(documents.where(~held_out if train_rows is None else train_rows))
    return score(documents, state).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(state["N"]).cast("long").alias("train_tokens"), "base_score", "score")
