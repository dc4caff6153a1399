"""Line dedup with a log-template tree.

A line is parsed at a fixed depth: its token count and its first ``LEAD`` tokens, with tokens that
hold a digit generalised, name a leaf. In a leaf, lines that agree place by place in at least
``SIMILAR`` percent of their tokens belong to one template, and so does whatever is reached over
such lines; the places in which the lines of a template differ are its variable fields
(``template_texts`` shows them), so a template may vary in more fields than any two of its lines do.
A template that recurs in ``min_docs`` documents or more is dropped from all but
the first of them (smallest doc_id). A line recurs only as far as it says something: it
needs ``min_tokens`` tokens.

Counting goes in two steps. Lines are first counted as hashes (leaf, line), pre-aggregated
per task, which also tells the leaves that no second document has; only lines of leaves with several
different lines and documents go on to template parsing. What a template is does not depend on counts
or order. A leaf of more than ``LEAF`` different lines (or ``WEIGHT`` tokens) is dealt into parts, and each pair of parts
is compared in a block of its own, or the lines that share a pigeonhole segment (two similar lines agree in
one whole segment at least) are, whichever is fewer rows; the links then meet in Spark. So no task gets an unbounded
leaf, and every pair of similar lines is found.

Defined cases: a null text stays null and an empty one empty; blank lines are never dropped
themselves; repeated rows of one doc_id are one document; ties go to the smaller doc_id, and
within a document every line of its first template stays; a document whose every worded line is
dropped goes (``keep_empty=True`` keeps it, empty); very long lines are read whole; extra columns pass through.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, cut, files_for, groups_of, map_arrow, pair_blocks, partitions_for, spanning, stored

LEAD, SIMILAR, MIN_TOKENS, MIN_DOCS = 3, 80, 5, 2
LEAF, WEIGHT = 384, 2_000_000
LEAST_BITS, MOST_BITS = 23, 27  # powers of two: 1 to 16 MB; the map only saves work, whatever is in it
ANY = b"<*>"


_DIGIT = re.compile(rb"[0-9]")


def parse(text: str, least: int):
    """(line number, tokens) of the lines of ``least`` tokens or more; tokens with a digit are all ``ANY``."""
    low = text.encode().lower()
    digits = _DIGIT.search(low) is not None
    for i, line in enumerate(low.split(b"\n")):
        tokens = line.split()
        if len(tokens) >= least:
            if digits and _DIGIT.search(line):
                tokens = [ANY if _DIGIT.search(t) else t for t in tokens]
            yield i, tokens


def _leaf(tokens: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b"%d " % len(tokens) + b" ".join(tokens[:LEAD]))


def _hashed(tokens: list[bytes]) -> bytes:
    """64-bit hashes of tokens, never 0."""
    return np.array([xxhash.xxh3_64_intdigest(t) | 1 for t in tokens], np.uint64).tobytes()


_LINES = pa.schema([("doc_id", pa.int64()), ("line_no", pa.int32()), ("leaf", pa.int64()), ("line", pa.int64()), ("tokens", pa.binary())])


def bits_for(leaves: int) -> int:
    """The power of two of a bit map's size: 32 to 64 bits a leaf between the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, (32 * leaves).bit_length()))


def _bitmap(power: int):
    """One bit map of the leaves of a task."""

    def run(batches):
        seen = np.zeros(1 << power, bool)
        for batch in batches:
            seen[(batch.column(0).to_numpy().astype(np.int64).view(np.uint64) >> np.uint64(64 - power)).astype(np.int64)] = True
        yield pa.record_batch({"bits": pa.array([np.packbits(seen, bitorder="little").tobytes()], pa.binary())})

    return run


def _either(power: int):
    """The bit maps of all tasks in one."""

    def run(batches):
        bits = np.zeros(1 << power >> 3, np.uint8)
        for batch in batches:
            for row in batch.column(0):
                bits |= np.frombuffer(row.as_py(), np.uint8)
        yield pa.record_batch({"bits": pa.array([bits.tobytes()], pa.binary())})

    return run


def _lines(min_tokens: int, likely=None):
    """Rows of the worded lines; with ``likely`` (a broadcast bit map) only of leaves that may be in it, with their tokens."""

    def run(batches):
        bits = None if likely is None else likely.value
        shift = None if bits is None else 65 - (8 * len(bits)).bit_length()
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            docs, numbers, leaves, lines, blobs = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if not text or doc is None:
                    continue
                for i, tokens in parse(text, min_tokens):
                    leaf = _leaf(tokens)
                    if bits is not None:
                        at = leaf >> shift
                        if not bits[at >> 3] >> (at & 7) & 1:
                            continue
                        blobs.append(_hashed(tokens))
                    docs.append(doc)
                    numbers.append(i)
                    leaves.append(leaf)
                    lines.append(digest(b" ".join(tokens)))
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(numbers, pa.int32()), signed(leaves), signed(lines), pa.array(blobs, pa.binary()) if bits is not None else pa.nulls(len(docs), pa.binary())], schema=_LINES)

    return run


_SQL_LINES = "doc_id long, line_no int, leaf long, line long, tokens binary"


def _segments(n: int, least: int, lead: int) -> np.ndarray:
    """Cuts of the places after ``lead`` (where all agree): of two lines that agree in ``least`` of ``n`` places, one segment at least is equal."""
    parts = n - least + 1 if n - least < n - lead else 1
    return np.linspace(lead, n, parts + 1).astype(int) if parts > 1 else np.array([n, n])


def _least(n: int, similar: int) -> int:
    return -(-similar * n // 100)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def links(tokens: np.ndarray, side: np.ndarray, least: int, block: int = 256):
    """Places (i, j) of the rows of ``tokens`` that agree in ``least`` places, block by block: each pair of side 0, and those across sides 1 and 2."""
    for one, other in ((0, 0), (1, 2)):
        p, q = np.flatnonzero(side == one), np.flatnonzero(side == other)
        for a in range(0, len(p), block):
            left = tokens[p[a : a + block]]
            for b in range(a if one == other else 0, len(q), block):
                right = tokens[q[b : b + block]]
                same = np.zeros((len(left), len(right)), np.int32)
                for k in range(tokens.shape[1]):
                    same += left[:, k, None] == right[None, :, k]
                i, j = np.nonzero(same >= least)
                yield p[i + a], q[j + b]


def _linked(similar: int):
    """(line, smallest line reached) of the lines of a group (group, line, tokens, side) that reach another."""

    def work(batches):
        lines = np.concatenate([b.column(1).to_numpy() for b in batches])
        if len(lines) < 2:
            return []
        blobs = [x for b in batches for x in b.column(2).to_pylist()]
        tokens = np.frombuffer(b"".join(blobs), np.uint64).reshape(len(lines), -1)
        least = _least(tokens.shape[1], similar)
        if len(lines) == 2:
            return [(int(lines.max()), int(lines.min()))] if (tokens[0] == tokens[1]).sum() >= least else []
        root = spanning(len(lines), links(tokens, np.concatenate([b.column(3).to_numpy() for b in batches]), least))
        smallest = np.full(len(lines), np.iinfo(np.int64).max)
        np.minimum.at(smallest, root, lines)
        return [(int(a), int(b)) for a, b in zip(lines, smallest[root], strict=True) if a != b]

    return work


def _parsed(rows: DataFrame, similar: int, n: int) -> DataFrame:
    """Links ``a, b`` of rows (group, line, tokens, side), a group in one task."""
    met = rows.select("group", "line", "tokens", "side").repartition(n, "group").sortWithinPartitions("group", "line")
    return map_arrow(met, groups_of(_linked(similar), _LINKS), "a long, b long")


def _segment_rows(similar: int, lead: int):
    """(leaf, line, tokens) in; (key, leaf, line) of each segment out."""
    schema = pa.schema([("key", pa.int64()), ("leaf", pa.int64()), ("line", pa.int64())])

    def run(batches):
        for batch in batches:
            keys, leaves, lines = [], [], []
            for leaf, line, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n = len(blob) // 8
                cuts = _segments(n, _least(n, similar), min(lead, n))
                for p, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                    keys.append(xxhash.xxh3_64_intdigest(b"%d %d " % (leaf, p) + blob[8 * a : 8 * b]))
                    leaves.append(leaf)
                    lines.append(line)
            yield pa.record_batch([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(leaves, pa.int64()), pa.array(lines, pa.int64())], schema=schema)

    return run


def _parts(m: str, n: str):
    """Parts that ``m`` lines of ``n`` tokens each are dealt into; 1 within the bounds."""
    many = F.greatest(F.ceil(F.col(m) / (LEAF // 2)), F.ceil(F.col(m) * F.col(n) / (WEIGHT // 2)))
    return F.when((F.col(m) > LEAF) | (F.col(m) * F.col(n) > WEIGHT), F.least(many, F.col(m))).otherwise(1).cast("int")


def _parsed_large(rows: DataFrame, sized: DataFrame, similar: int, n: int, files: int) -> DataFrame:
    """``line, template`` of rows (leaf, line, tokens) of the leaves of ``sized`` (leaf, m, n, parts) that exceed the bounds."""
    keys = stored(map_arrow(rows, _segment_rows(similar, LEAD), "key long, leaf long, line long"), "segments", files)
    shared = keys.groupBy("key", "leaf").agg(F.count("*").alias("k")).where("k > 1").join(sized.select("leaf", "n"), "leaf").select("key", "leaf", "k", _parts("k", "n").alias("parts"))
    shared = cut(shared, files)
    # of both ways the one of fewer rows
    dear = shared.groupBy("leaf").agg(F.sum(F.col("k") * F.col("parts")).alias("rows")).join(sized, "leaf", "right").where(F.coalesce("rows", F.lit(0)) > F.col("m") * F.col("parts")).select("leaf", "parts")
    dear = cut(dear, files)
    by_leaf = pair_blocks(rows.join(dear, "leaf").select("leaf", F.col("line").alias("id"), "parts"), "leaf")
    by_segment = keys.join(shared.join(dear.select("leaf"), "leaf", "left_anti").select("key", "parts"), "key").select("key", F.col("line").alias("id"), "parts")
    dealt = by_leaf.unionByName(pair_blocks(by_segment, "key")).withColumnRenamed("id", "line")
    found = _parsed(dealt.join(rows.select("line", "tokens"), "line"), similar, n)
    return components(found, files=files).select(F.col("node").alias("line"), F.col("root").alias("template")).where("line <> template")


def templates(lines: DataFrame, similar: int, n: int, min_tokens: int, texts: DataFrame, files: int) -> DataFrame:
    """``line, template``: lines whose template is named after another line, its smallest."""
    leaves = lines.groupBy("leaf").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min("line").alias("x"), F.max("line").alias("y"))
    open_ = cut(leaves.where("a <> b AND x <> y").select("leaf"), files)
    power = bits_for(open_.count())
    maps = map_arrow(map_arrow(open_.coalesce(8), _bitmap(power), "bits binary").repartition(1), _either(power), "bits binary").collect()  # one row of a bounded size
    likely = texts.sparkSession.sparkContext.broadcast(maps[0]["bits"] if maps else bytes(1 << power >> 3))
    # leaves that the bit map lets through by chance are parsed in vain: their lines have no second document
    met = map_arrow(texts, _lines(min_tokens, likely), _SQL_LINES).groupBy("leaf", "line").agg(F.first("tokens").alias("tokens"))
    with_tokens = stored(met, "tokens", files)
    likely.destroy()
    sizes = with_tokens.groupBy("leaf").agg(F.count("*").alias("m"), (F.max(F.length("tokens")) / 8).cast("long").alias("n"))
    large = cut(sizes.select("leaf", "m", "n", _parts("m", "n").alias("parts")).where("parts > 1"), files)
    whole = lambda rows: _parsed(rows.select(F.col("leaf").alias("group"), "line", "tokens", F.lit(0).alias("side")), similar, n).select(F.col("a").alias("line"), F.col("b").alias("template"))
    if large.isEmpty():
        return whole(with_tokens)
    split = _parsed_large(stored(with_tokens.join(large.select("leaf"), "leaf", "left_semi"), "large", files), large, similar, n, files)
    return whole(with_tokens.join(large.select("leaf"), "leaf", "left_anti")).unionByName(split)


def recurring(documents: DataFrame, similar: int = SIMILAR, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, line_no, template`` of every line to drop."""
    n = partitions_for(documents.sparkSession)
    texts = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    files = files_for(texts)
    lines = stored(map_arrow(texts, _lines(min_tokens), _SQL_LINES).drop("tokens"), "lines", files)
    joined = cut(templates(lines, similar, n, min_tokens, texts, files), files)
    # a hot line is one row per task after the partial aggregation, here and below
    named = lines.select("doc_id", "line").groupBy("line").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n"))
    named = named.join(joined, "line", "left").withColumn("template", F.coalesce("template", "line"))
    joint = named.groupBy("template").agg(F.min("a").alias("first"), F.max("b").alias("last")).where("first <> last")
    if min_docs > 2:
        every = lines.join(joined, "line", "left").select(F.coalesce("template", "line").alias("template"), "doc_id").distinct()
        joint = joint.join(every.groupBy("template").count().where(F.col("count") >= min_docs).select("template"), "template", "left_semi")
    hot = cut(named.join(joint, "template").select("line", "template", "first"), files)
    return lines.join(hot, "line").where("doc_id <> first").select("doc_id", "line_no", "template")


def _dropper(at_text: int, at_drop: int, keep_empty: bool, names: list[str]):
    def run(batches):
        for batch in batches:
            texts, drops = batch.column(at_text), batch.column(at_drop)
            out, keep = [], []
            for i in range(len(texts)):
                drop = drops[i].as_py()
                if drop is None:
                    out.append(texts[i].as_py())
                    keep.append(True)
                    continue
                gone = set(drop)
                rest = [x for j, x in enumerate(texts[i].as_py().split("\n")) if j not in gone]
                alive = any(x and not x.isspace() for x in rest)
                out.append("\n".join(rest) if alive else "")
                keep.append(alive or keep_empty)
            columns = [pa.array(out, pa.string()) if i == at_text else c for i, c in enumerate(batch.columns) if i != at_drop]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    return run


def line_dedup(documents: DataFrame, similar: int = SIMILAR, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS, keep_empty: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with recurring lines taken out of ``text``."""
    schema, names = documents.schema, set(documents.columns)
    own_id, own_lines = (next(f"{n}{i}" for i in range(len(names) + 1) if f"{n}{i}" not in names) for n in ("_drop_id", "_drop_lines"))
    drops = recurring(documents, similar, min_tokens, min_docs, key, text).groupBy(F.col("doc_id").alias(own_id)).agg(F.collect_set("line_no").alias(own_lines))
    met = documents.join(drops, documents[key].cast("long") == drops[own_id], "left").drop(own_id)
    at = met.columns.index(text)
    run = _dropper(at, len(met.columns) - 1, keep_empty, documents.columns)
    out = T.StructType([T.StructField(f.name, T.StringType() if f.name == text else f.dataType, True) for f in schema])
    return map_arrow(met, run, out)


def dropped(documents: DataFrame, **options) -> DataFrame:
    """``doc_id, n_dropped, lines`` of the documents that lose lines: the decisions as data."""
    return recurring(documents, **options).groupBy("doc_id").agg(F.count("*").alias("n_dropped"), F.sort_array(F.collect_list("line_no")).alias("lines"))


def template_texts(documents: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``template, tokens, n_lines``: the templates that lose lines, with ``<*>`` at places in which those lines differ."""
    gone = recurring(documents, key=key, text=text, **options)
    line = F.expr(f"split(element_at(split(lower(`{text}`), '\\n'), line_no + 1), '[ \\t\\r\\f\\x0B]+')")
    cut_out = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias(text)).dropDuplicates(["doc_id"]).join(gone, "doc_id")
    words = cut_out.select("template", F.transform(F.array_remove(line, ""), lambda x: F.when(x.rlike("[0-9]"), ANY.decode()).otherwise(x)).alias("w"))
    places = words.select("template", F.posexplode("w").alias("at", "w")).groupBy("template", "at").agg(F.min("w").alias("x"), F.max("w").alias("y"), F.count("*").alias("n_lines"))
    token = F.when(F.col("x") == F.col("y"), F.col("x")).otherwise(ANY.decode())
    ordered = F.array_sort(F.collect_list(F.struct("at", token.alias("w"))))
    return places.groupBy("template").agg(F.transform(ordered, lambda x: x["w"]).alias("tokens"), F.max("n_lines").alias("n_lines"))
