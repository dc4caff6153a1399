"""Near-duplicate documents: MinHash signatures in an LSH forest, links confirmed on full sets.

Documents with one and the same shingle set are one *class* first; only classes go on.
Every class has ``TREES`` signature orders of ``DEPTH`` min-hashes each. In the sorted order of a tree,
the classes that share a prefix are neighbours; a *region* is such a run, of ``MIN_DEPTH``
common min-hashes. A region of more than ``REGION`` classes (or ``WEIGHT`` shingles) is dealt into
parts, and each pair of parts meets in a task of its own (a *block*), so all its pairs are compared.

Inside a block, all signatures are compared, and what agrees well enough joins a
*cluster* (connected components, computed by Spark). Each cluster then meets once with its
texts, where every pair that the signatures allow is confirmed on the full shingle sets unless
both are linked already; clusters beyond a bound are dealt into blocks too, or confirmed in the
blocks of their regions where those are fewer rows (up to ``CROWD`` parts of ``CLUSTER`` classes a pair, beyond that of ``REGION``). Only spanning links leave a task. Rows are
linear in the classes but for crowds, where a class goes into as many blocks as there are parts.

A link is lost only if its classes share no region in any tree ((1 - 0.8**3)**16 = 1e-5 at a
similarity of 0.8) or if the estimate from 128 min-hashes is over 4 standard deviations low.

Defined cases: a null or empty text, or one without words, has an empty set, links with nothing
and is kept; fewer words than a shingle make one shingle; repeated rows of one doc_id are copies
of each other; rows with a null doc_id link with nothing, have a null component_id and are kept; very long texts are
read whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX_A, MIX_B, MIX_C, ascii_words, components, cut, files_for, groups_of, map_arrow, pair_blocks, partitions_for, shingles, spanning, stored, word_hashes

TREES, DEPTH, MIN_DEPTH = 16, 8, 3
HASHES = TREES * DEPTH
REGION, CLUSTER, CROWD, WEIGHT = 2048, 256, 24, 4_000_000
MARGIN = 0.15  # what an estimate may lie below the threshold: over 4 standard deviations of 128 min-hashes
_MULTIPLY = ((np.arange(1, HASHES + 1, dtype=np.uint64) * MIX_A) ^ ((np.arange(1, HASHES + 1, dtype=np.uint64) * MIX_B) >> np.uint64(31)) | np.uint64(1)).astype(np.uint32) | np.uint32(1)
_ADD = (np.arange(1, HASHES + 1, dtype=np.uint64) * MIX_C >> np.uint64(32)).astype(np.uint32)


def signature(hashes: np.ndarray) -> np.ndarray:
    """``HASHES`` min-hashes of 16 bits of a non-empty set."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, np.uint32(0xFFFFFFFF))
    for at in range(0, len(x), 2048):
        part = x[at : at + 2048]
        y = part[None, :] * _MULTIPLY[:, None] + _ADD[:, None]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        low = np.minimum(low, y.min(1))
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def _sketcher(words_per_shingle: int):
    def run(batches):
        for batch in batches:
            counts, digests, sigs = [], [], []
            for text in batch.column(1):
                tokens = ascii_words(text.as_py())
                s = shingles(word_hashes(tokens), words_per_shingle) if tokens else np.zeros(0, np.uint64)
                counts.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "digest", "sig"])

    return run


def sketch(documents: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, digest, sig``: digest and sig are null for empty sets."""
    kind = documents.schema[key].dataType.simpleString()
    picked = documents.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_arrow(picked, _sketcher(words), f"doc_id {kind}, n_shingles long, digest binary, sig binary")


def _parts(n: str, weight: str, most: int):
    """Parts that a group of ``n`` classes and ``weight`` shingles is dealt into; 1 up to ``most`` classes and ``WEIGHT``."""
    many = F.greatest(F.least(F.ceil(F.col(n) / (most // 2)), F.lit(CROWD)), F.ceil(F.col(n) / (REGION // 2)), F.ceil(F.col(weight) / (WEIGHT // 2)))
    return F.when((F.col(n) > most) | (F.col(weight) > WEIGHT), F.least(many, F.col(n))).otherwise(1).cast("int")


def forest(classes: DataFrame) -> DataFrame:
    """``region, id, parts, text_parts`` for every region of two classes or more: its parts for signatures and for texts."""
    branch = lambda t: F.substring(F.col("sig"), t * (2 * DEPTH) + 1, F.lit(2 * MIN_DEPTH))
    regions = F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(t, branch(t))))
    rows = classes.select("id", "weight", regions.alias("region"))
    size = rows.groupBy("region").agg(F.count("*").alias("_n"), F.sum("weight").alias("_w")).where("_n > 1")
    parts = size.select("region", _parts("_n", "_w", REGION).alias("parts"), _parts("_n", "_w", CLUSTER).alias("text_parts"))
    return rows.join(parts, "region").select("region", "id", "parts", "text_parts")


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def _likely(sig: np.ndarray, side: np.ndarray, least: float, block: int = 256):
    """Pairs (i, j, number of equal min-hashes) at or above ``least``, block by block: each pair of side 0 once, and those across sides 1 and 2."""
    for one, other in ((0, 0), (1, 2)):
        p, q = np.flatnonzero(side == one), np.flatnonzero(side == other)
        for a in range(0, len(p), block):
            left = sig[p[a : a + block]]
            for b in range(a if one == other else 0, len(q), block):
                right = sig[q[b : b + block]]
                same = np.zeros((len(left), len(right)), np.uint8)
                for k in range(HASHES):
                    same += left[:, k, None] == right[None, :, k]
                i, j = np.nonzero(same >= least * HASHES)
                if one == other:
                    keep = (i + a) < (j + b)
                    i, j = i[keep], j[keep]
                yield p[i + a], q[j + b], same[i, j]


def _column(batches, at: int) -> np.ndarray:
    return np.concatenate([b.column(at).to_numpy() for b in batches])


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), HASHES)


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _cluster_region(least: float):
    """Spanning edges of the classes of a block whose signatures agree."""

    def work(batches):
        ids = _column(batches, 1)
        if len(ids) < 2:
            return []
        sig = np.concatenate([_signatures(b.column(2)) for b in batches])
        if len(ids) == 2 and not _column(batches, 3).any():
            return [(int(ids.min()), int(ids.max()))] if (sig[0] == sig[1]).sum() >= least * HASHES and ids[0] != ids[1] else []
        root = spanning(len(ids), ((i, j) for i, j, _ in _likely(sig, _column(batches, 3), least)))
        least_id = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least_id, root, ids)
        return [(int(a), int(b)) for a, b in zip(least_id[root], ids, strict=True) if a != b]

    return work


def _confirm(words_per_shingle: int, percent: int, least: float):
    """Spanning links of a group, confirmed on full shingle sets."""
    def work(batches):
        ids = _column(batches, 1)
        if len(ids) < 2:
            return []
        sig = np.concatenate([_signatures(b.column(2)) for b in batches])
        texts = [t for b in batches for t in b.column(3)]
        sets: dict[int, np.ndarray] = {}

        def of(i):
            if i not in sets:
                sets[i] = shingles(word_hashes(ascii_words(texts[i].as_py())), words_per_shingle)
            return sets[i]

        union, left, out = _Union(len(ids)), [], []

        def test(i, j):
            if ids[i] == ids[j] or union.find(i) == union.find(j):
                return
            x, y = of(i), of(j)
            if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
                return
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                union.join(i, j)
                out.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))

        for i, j, same in _likely(sig, _column(batches, 4), least):
            order = np.argsort(-same.astype(np.int16), kind="stable")  # the surest first: what they link needs no test
            for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
                test(x, y)
        return out

    return work


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, a row for each row of ``documents``.

    Links are 100 * |intersection| >= percent * |union| of the sets of ``words``-word shingles;
    component_id is the smallest doc_id reachable over links.
    """
    spark = documents.sparkSession
    n = partitions_for(spark)
    least = max(0.05, percent / 100 - MARGIN)
    files = files_for(documents.select(key, text))
    all_docs = stored(sketch(documents, words, key, text), "sketch", files)
    sets = all_docs.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = stored(sets.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("weight"), F.first("sig").alias("sig")), "classes", files)
    regions = cut(forest(classes), files)
    members = pair_blocks(regions, "region").join(classes.select("id", "sig"), "id").select("group", "id", "sig", "side").repartition(n, "group").sortWithinPartitions("group", "id")
    agree = map_arrow(members, groups_of(_cluster_region(least), _EDGES), "a long, b long").distinct()
    clusters = components(agree, files=files).join(classes.select(F.col("id").alias("node"), "weight"), "node")
    clusters = cut(clusters.withColumnRenamed("node", "id"), files)
    size = clusters.groupBy("root").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    sized = cut(size.select("root", "n", _parts("n", "w", CLUSTER).alias("parts")).where("parts > 1"), files)
    few = clusters.select("id", "root")
    groups = few.join(sized.select("root"), "root", "left_anti").select(F.col("root").alias("group"), "id", F.lit(0).alias("side"))
    if not sized.isEmpty():
        wide = few.join(sized, "root").select("root", "id", "parts")
        # pairs to confirm share a region too; what takes fewer rows is done
        rows = regions.join(wide.select("id", "root"), "id").groupBy("root").agg(F.sum("text_parts").alias("rows"))
        dearer = cut(sized.join(rows, "root").where(F.col("rows") < F.col("n") * F.col("parts")).select("root"), files)
        groups = groups.unionByName(pair_blocks(wide.join(dearer, "root", "left_anti"), "root"))
        groups = groups.unionByName(pair_blocks(regions.join(wide.join(dearer, "root", "left_semi").select("id"), "id").select("region", "id", F.col("text_parts").alias("parts")), "region"))
    texts = documents.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    with_sig = groups.join(classes.select("id", "sig"), "id")
    met = texts.join(with_sig, "id").select("group", "id", "sig", "text", "side").repartition(n, "group").sortWithinPartitions("group", "id")
    links = map_arrow(met, groups_of(_confirm(words, percent, least), _EDGES), "a long, b long").distinct()
    roots = components(links, files=files)
    home = classes.select("digest", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("digest", F.coalesce("root", "id").alias("_root"))
    named = all_docs.select("doc_id", "n_shingles", "digest").join(home, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_root", "doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def near_dedup(documents: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with one document of each group: that of the smallest id (all rows of it)."""
    found = near_duplicates(documents, words, percent, key, text)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct()
    return documents.join(gone, key, "left_anti").select(documents.columns)
