"""Exact top-k inner products: columnar branch-and-bound over dimension blocks.

Candidates are packed into blocks in vertical (dimension-major) layout and query blocks visit
each candidate block. Every query brings a bound along, its k-th best score in one small block that all queries
search first. Dimensions are taken a block at a time, heaviest first; after each
block a candidate's score lies within ``partial +- |rest of q| * |rest of c|``, and the
candidates whose upper bound is below the k-th lower bound or the query's own bound are compacted away. What is left
gets its exact integer score.

Defined cases: vectors that are null or hold null or non-finite components, and rows
without an id, take no part; shorter vectors count as filled up with zeros (an empty one is
all zeros); a query is never its own neighbour, nor is another row of the same id; repeated rows
are candidates each, but one query; different vectors of one query id give one list, of their best scores together;
ties go to the smaller id; scores beyond a 64-bit integer are cut off at
its ends; an empty table gives no rows. Columns beside the id and vector are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, partitions_for

SCALE = 1024
LEAST_BLOCK, MOST_BYTES, QUERY_BLOCK, DIMS = 2048, 64 << 20, 256, 8
LONG = np.iinfo(np.int64)


def _packed(values: np.ndarray) -> bytes:
    """Values in the narrowest type that holds them all, behind its name."""
    top = np.abs(values).max(initial=0.0)
    kind = "i2" if top < 2**15 else "i4" if top < 2**31 else "f8"
    return kind.encode() + values.astype(kind).tobytes()


def _pack(queries: bool, blocks: int | None = None):
    """Rows (part, kind, n, dims, ids, values, bounds): the vectors of a batch by their part, or for each of ``blocks`` parts."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            lists = batch.column(1)
            length = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, int)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            width = int(length.max(initial=0))
            dense = np.zeros((len(ids), width))
            dense[np.repeat(np.arange(len(ids)), length), np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = np.floor(SCALE * flat)
            to = batch.column(2).to_numpy(zero_copy_only=False)
            out: dict[str, list] = {k: [] for k in ("part", "kind", "n", "dims", "ids", "values", "bounds")}
            bounds = batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64) if queries else np.zeros(0)

            def put(part, kind, rows):
                for key, value in zip(out, (part, kind, len(rows), width, ids[rows].tobytes(), _packed(dense[rows]), bounds[rows].tobytes() if queries else b""), strict=True):
                    out[key].append(value)

            if blocks is not None:
                for at in range(0, len(ids), QUERY_BLOCK):
                    put(0, 1, np.arange(at, min(at + QUERY_BLOCK, len(ids))))
                for key in out:  # one packing for all blocks
                    out[key] = out[key] * blocks if key != "part" else [p for p in range(blocks) for _ in out[key]]
            else:
                order = np.argsort(to, kind="stable")
                for rows in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                    step = QUERY_BLOCK if queries else max(1, len(rows))
                    for at in range(0, len(rows), step):
                        put(int(to[rows[0]]), int(queries), rows[at : at + step])
            yield pa.record_batch({"part": pa.array(out["part"], pa.int64()), "kind": pa.array(out["kind"], pa.int32()), "n": pa.array(out["n"], pa.int32()), "dims": pa.array(out["dims"], pa.int32()), "ids": pa.array(out["ids"], pa.binary()), "values": pa.array(out["values"], pa.binary()), "bounds": pa.array(out["bounds"], pa.binary())})

    return run


_PACKED = "part long, kind int, n int, dims int, ids binary, values binary, bounds binary"


class Block:
    """Candidates in vertical layout: row j holds component j of every candidate."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids = ids
        self.order = np.argsort(-(values**2).sum(0), kind="stable")  # heaviest dimensions first
        self.rows = np.ascontiguousarray(values.T[self.order])
        self.cuts = [*range(0, len(self.order), DIMS), len(self.order)] if len(self.order) else [0, 0]
        mass = np.zeros((len(self.cuts), len(ids)))
        for i in range(len(self.cuts) - 2, -1, -1):
            mass[i] = mass[i + 1] + (self.rows[self.cuts[i] : self.cuts[i + 1]] ** 2).sum(0)
        self.rest = np.sqrt(mass)
        self.peak = np.abs(values).max(initial=0.0)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, bounds: np.ndarray | None = None):
        """For each query its ``k`` best here, or those of them that reach its bound, as (query id, candidate ids, scores)."""
        d = len(self.order)
        q = np.zeros((len(queries), max(d, queries.shape[1])))
        q[:, : queries.shape[1]] = queries
        q = q[:, :d][:, self.order]
        exact = self.peak * np.abs(q).max(initial=0.0) * max(d, 1) < 2**52
        first = self.cuts[1]
        start = q[:, :first] @ self.rows[:first] if exact else None
        for i, query_id in enumerate(query_ids):
            alive, v = np.flatnonzero(self.ids != query_id), q[i]
            if exact:
                tails = np.sqrt(np.maximum(0, np.cumsum((v**2)[::-1])[::-1]))
                partial = start[i][alive]
                for c in range(1, len(self.cuts)):
                    if c > 1:
                        lo, hi = self.cuts[c - 1], self.cuts[c]
                        partial = partial + v[lo:hi] @ (self.rows[lo:hi] if len(alive) == len(self.ids) else self.rows[lo:hi, alive])
                    if c < len(self.cuts) - 1 and len(alive):
                        slack = tails[self.cuts[c]] * self.rest[c][alive] * (1 + 1e-9) + 1e-3
                        low = partial - slack
                        edge = -np.inf if bounds is None else bounds[i]
                        if len(alive) > k:
                            edge = max(edge, np.partition(low, len(low) - k)[len(low) - k])
                        keep = partial + slack >= edge
                        alive, partial = alive[keep], partial[keep]
                scores = np.rint(partial).astype(np.int64)
            else:
                whole = [sum(int(a) * int(b) for a, b in zip(v, self.rows[:, j], strict=True)) for j in alive]
                scores = np.array([min(max(x, LONG.min), LONG.max) for x in whole], np.int64)
            if len(alive) > k:
                edge = np.partition(scores, len(scores) - k)[len(scores) - k]
                keep = scores >= edge
                alive, scores = alive[keep], scores[keep]
            best = np.lexsort((self.ids[alive], -scores.astype(np.float64) if exact else ~scores))[:k]
            yield query_id, self.ids[alive[best]], scores[best]


def _searcher(k: int):
    def run(batches):
        part, held, block = None, [], None

        def unpack(row):
            kind = row["values"][:2].decode()
            return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["values"], kind, offset=2).reshape(row["n"], row["dims"]).astype(np.float64)

        for batch in batches:
            out = ([], [], [])
            for row in batch.to_pylist():
                if row["part"] != part:
                    part, held, block = row["part"], [], None
                if row["kind"] == 0:
                    held.append(unpack(row))
                    continue
                if block is None:
                    if not held:
                        continue
                    width = max(v.shape[1] for _, v in held)
                    block = Block(np.concatenate([i for i, _ in held]), np.concatenate([np.pad(v, ((0, 0), (0, width - v.shape[1]))) for _, v in held]))
                    held = []
                for query_id, ids, scores in block.search(*unpack(row), k, np.frombuffer(row["bounds"], np.float64)):
                    out[0].append(np.full(len(ids), query_id))
                    out[1].append(ids)
                    out[2].append(scores)
            if out[0]:
                yield pa.record_batch([pa.array(np.concatenate(x), pa.int64()) for x in out], names=["query_id", "vec_id", "score"])

    return run


_FOUND = "query_id long, vec_id long, score long"


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def top_k(embeddings: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", block: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of all rows for each row where ``is_query``.

    Queries visit candidate blocks of up to ``MOST_BYTES``, so what moves is queries x blocks, in two bytes a component
    where they are small; the candidates move once.
    """
    spark = embeddings.sparkSession
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("q"))
    n, dims = embeddings.where(F.col(key).isNotNull()).agg(F.count("*"), F.max(F.size(vector))).first()
    most = max(LEAST_BLOCK, MOST_BYTES // (8 * max(dims or 1, 1)))
    size = block or min(most, max(LEAST_BLOCK, -(-n // (2 * partitions_for(spark)))))
    blocks = max(1, -(-n // size))
    # ids are dealt by hash; with the vector, so rows of one id are kept apart
    to = F.pmod(F.xxhash64("id", F.xxhash64("v")), F.lit(blocks))
    candidates = rows.select("id", "v", to.alias("part"))
    queries = rows.where("q").select("id", "v").dropDuplicates(["id", "v"])

    def search(candidates: DataFrame, queries: DataFrame, blocks: int) -> DataFrame:
        met = map_arrow(candidates, _pack(False), _PACKED).unionByName(map_arrow(queries, _pack(True, blocks), _PACKED))
        met = met.repartition(min(blocks, 4096), "part").sortWithinPartitions("part", "kind")
        return map_arrow(met, _searcher(k), _FOUND)

    bound = F.lit(float("-inf")).alias("bound")
    if blocks > 1:
        # a bound from about a ``LEAST_BLOCK`` of candidates, dealt over a few tasks with the queries: any bound gives the same result
        few = F.pmod(F.xxhash64(F.lit("first"), "id"), F.lit(max(1, n // LEAST_BLOCK))) == 0
        tasks = max(1, min(blocks, partitions_for(spark)))
        first = rows.where(few).select("id", "v")
        copies = first.select("id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tasks - 1).cast("long"))).alias("part"))
        own = queries.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(tasks)).alias("part"), bound)
        met = map_arrow(copies, _pack(False), _PACKED).unionByName(map_arrow(own, _pack(True), _PACKED)).repartition(tasks, "part").sortWithinPartitions("part", "kind")
        found = map_arrow(met, _searcher(k), _FOUND).groupBy("query_id").agg(F.min("score").alias("s"), F.count("*").alias("c"))
        known = queries.join(found, queries["id"] == found["query_id"], "left")
        queries = known.select("id", "v", F.lit(0).cast("long").alias("part"), F.coalesce(F.when(F.col("c") == k, F.col("s").cast("double")), F.lit(float("-inf"))).alias("bound"))
    else:
        queries = queries.select("id", "v", F.lit(0).cast("long").alias("part"), bound)
    return _best(search(candidates, queries, blocks), k)
