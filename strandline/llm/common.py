"""Shared pieces: table access, stable splits, checkpoints, components, word hashes."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xBF58476D1CE4E5B9)
MIX_C = np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str | Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as the empty text."""
    col = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit(""))), F.lit(modulus))


def below(hashed: Column, fraction: float) -> Column:
    """Whether a 64-bit hash lies in the lowest ``fraction`` of all hashes, however small that is."""
    return F.lit(True) if fraction >= 1 else F.shiftrightunsigned(hashed, 1) < F.lit(int(fraction * (1 << 63)))


def sample_fraction(key: str, fraction: float) -> Column:
    """Stable row filter that keeps about ``fraction`` of the keys."""
    return below(F.xxhash64(F.lit("sample"), F.col(key)), fraction)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where the setting is absent and all tasks run in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            found = set_dir.get()
        elif spark.sparkContext._jsc.sc().isLocal():
            found = "file://" + tempfile.mkdtemp(prefix="strandline-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


FILE_BYTES = 16 << 20


def files_for(df: DataFrame) -> int:
    """How many files what comes of ``df`` may be written to: one for each ``FILE_BYTES`` of Catalyst's estimate of it and one for each core.

    Shuffles may have many more partitions than a small table needs files; at the size of a cluster it is the other way round.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(size // FILE_BYTES, 1 << 30) + df.sparkSession.sparkContext.defaultParallelism


def cut(df: DataFrame, files: int | None = None) -> DataFrame:
    """Cuts lineage with an eager, reliable checkpoint in the shared folder, of ``files`` files at most."""
    shared_dir(df.sparkSession)
    return (df.coalesce(files) if files else df).checkpoint(eager=True)


def stored(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder, as ``files`` files at most, and reads it again (columnar, prunable)."""
    spark, path = df.sparkSession, fresh_dir(df.sparkSession, name)
    (df.coalesce(files) if files else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _give_back() -> None:
    """Returns freed memory to the system, which idle workers would else hold until they are used again."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` by workers that keep no freed memory after a task."""

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    return df.mapInArrow(tidy, schema)


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


HOT_KEYS, LEAST_HOT = 10_000, 256


def components(edges: DataFrame, max_rounds: int = 60, files: int | None = None) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(node, root)`` per node, root the smallest node.

    Alternating large-star and small-star rounds, each an aggregation and a join on a node. The hubs of
    stars, which are ``HOT_KEYS`` nodes at most by their degree, are joined by a broadcast of their rows, so
    neither a component nor a hub meets in one task. Each round is checkpointed.
    An empty input gives an empty result; RuntimeError if ``max_rounds`` rounds do not settle it.
    """

    def with_least(rows: DataFrame, low: DataFrame, key: str, hot: int) -> DataFrame:
        """``rows`` with ``m`` of their ``key`` in ``low(u, m, d)``; a key of ``hot`` rows or more is not shuffled."""
        hubs = rows.join(F.broadcast(low.where(F.col("d") >= hot).select(F.col("u").alias("h"), F.col("m").alias("hm"))), F.col(key) == F.col("h"), "left")
        cold = hubs.where("h IS NULL").select("u", "v").join(low.where(F.col("d") < hot).select(F.col("u").alias(key), "m"), key)
        return hubs.where("h IS NOT NULL").select("u", "v", F.col("hm").alias("m")).unionByName(cold.select("u", "v", "m"))

    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), files)
    check = lambda rows: rows.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    last = check(e)
    for _ in range(max_rounds if last[0] else 0):
        hot = max(LEAST_HOT, -(-4 * last[0] // HOT_KEYS))
        # large star: each node's larger neighbours go to its least one (u > v in every row)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("d"))
        large = with_least(e, low, "v", hot).select("u", F.col("m").alias("v")).distinct()
        # small star: each node and its smaller neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
        small = with_least(large, low, "u", hot).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e = cut(small.where("u <> v").distinct(), files)
        now = check(e)
        if now == last:
            break
        last = now
    else:
        if last[0]:
            raise RuntimeError(f"the components did not settle in {max_rounds} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def pair_blocks(rows: DataFrame, key: str) -> DataFrame:
    """``group, id, side`` of rows (key, id, parts): a group for each pair of parts of a key.

    Side 0 meets all of its group; sides 1 and 2 are two parts, of which only pairs across are due.
    """
    own = F.pmod(F.xxhash64(F.lit("part"), F.col("id")), F.col("parts")).cast("int")
    met = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("_own") == F.col("_other"), 0).when(F.col("_own") < F.col("_other"), 1).otherwise(2)
    return met.select(F.xxhash64(F.lit(key), key, F.least("_own", "_other"), F.greatest("_own", "_other")).alias("group"), "id", side.alias("side"))


class groups_of:
    """Runs ``work(rows)`` on each group of consecutive rows with one value in column 0."""

    def __init__(self, work, schema: pa.Schema):
        self.work, self.schema = work, schema

    def __call__(self, batches):
        held, key, out = [], None, []
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(keys):
                continue
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]]), strict=True):
                if keys[lo] != key:
                    if held:
                        out += self.work(held)
                    held, key = [], keys[lo]
                held.append(batch.slice(int(lo), int(hi - lo)))
            if len(out) > 10_000:
                yield self._batch(out)
                out = []
        if held:
            out += self.work(held)
        yield self._batch(out)

    def _batch(self, rows):
        return pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(self.schema)], schema=self.schema)


def spanning(n: int, pairs) -> np.ndarray:
    """The smallest place that each of ``n`` places reaches over ``pairs``."""
    root = np.arange(n)
    for i, j in pairs:
        while (apart := root[i] != root[j]).any():
            i, j = i[apart], j[apart]
            low = np.minimum(root[i], root[j])
            np.minimum.at(root, root[i], low)
            np.minimum.at(root, root[j], low)
            while (root != root[root]).any():
                root = root[root]
    return root


class Words:
    """Ids of byte words, with one row of derived 64-bit numbers for each id.

    ``derive(word) -> tuple[int, ...]`` runs once for each new word; the table is
    emptied when it reaches ``limit`` words, which changes no result.
    """

    def __init__(self, derive, width: int, limit: int = 300_000):
        self.derive, self.width, self.limit = derive, width, limit
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.rows = np.zeros((1024, self.width), np.uint64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """(len(words), width) array."""
        if len(self.ids) > self.limit:
            self._reset()
        ids, get = self.ids, self.ids.get
        out = [get(w, -1) for w in words]
        if -1 in out:
            for i, k in enumerate(out):
                if k < 0:
                    w = words[i]
                    k = get(w, -1)
                    if k < 0:
                        k = ids[w] = len(ids)
                        if k >= len(self.rows):
                            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                        self.rows[k] = self.derive(w)
                    out[i] = k
        return self.rows[np.array(out, np.int64)]


def ascii_words(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and takes the words ``[^\\x20\\x09-\\x0D]+``."""
    return text.encode().lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; hashing anew is cheaper than a table of all words."""
    return np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * MIX_B
    h = (h ^ (h >> np.uint64(27))) * MIX_C
    return h ^ (h >> np.uint64(31))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than ``size`` make one shingle."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    size = min(size, n)
    h = np.full(n - size + 1, np.uint64(size), np.uint64)
    for k in range(size):
        h = mixed((h ^ words[k : n - size + 1 + k]) * MIX_A + np.uint64(k))
    return np.unique(h)


def local_path(uri: str) -> str | None:
    """The path of a ``file:`` URI or plain path, else None."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def open_output(uri: str):
    """A binary output stream for a URI that pyarrow's file systems know."""
    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(uri)
    system.create_dir(os.path.dirname(where), recursive=True)
    return system.open_output_stream(where)


def open_input(uri: str):
    path = local_path(uri)
    if path is not None:
        return open(path, "rb")
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(uri)
    return system.open_input_file(where)


@contextmanager
def whole_output(uri: str):
    """An output stream of a file that appears under its name once it is whole; a repeated write replaces it."""
    part = f"{uri}.{uuid.uuid4().hex}"
    with open_output(part) as stream:
        yield stream
    path = local_path(uri)
    if path is not None:
        os.replace(local_path(part), path)
        return
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(uri)
    own = fs.FileSystem.from_uri(part)[1]
    if system.get_file_info(where).type == fs.FileType.NotFound:
        system.move(own, where)
    else:  # another attempt was first, with the same content
        system.delete_file(own)
