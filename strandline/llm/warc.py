"""WARC archives as a chunked record table.

``write`` puts a table of pages into gzip-per-record WARC 1.1 files in a shared folder: each task
writes files of its own name, and only the files of successful tasks are in the
returned manifest, so a lost or repeated task leaves nothing that is read. ``read``
streams archives back as rows of record id and chunk number; every chunk carries
the digest and byte count of the payload up to its end, so the last chunk holds those
of the whole payload, and no record is held in memory at once on this side.

Payloads of at least ``least`` bytes that are equal become one response (the smallest
page_id) and revisits of it. Defined cases: a null html is an empty payload; a null url
is written as ``urn:none``; rows of one page_id and one payload are all responses; rows without
a page_id are responses unless a row with an id has the same payload; an empty table
gives no files and no rows. Columns beside page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, files_for, fresh_dir, map_arrow, open_input, open_output, partitions_for

CHUNK = 1 << 20
FILE_BYTES = 1 << 28
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "path string, records long, bytes long"
CHUNKS = "path string, record_id string, chunk_no int, record_type string, page_id long, target_uri string, refers_to long, payload binary, payload_bytes long, payload_digest string, is_last boolean"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}') if page_id is not None else uuid.uuid4()}>"


def _head(kind: str, page_id, uri: str, size: int, digest: str, refers, payload_bytes: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {payload_bytes}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {record_id(refers)}", f"X-Refers-To-Page-Id: {refers}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return ("\r\n".join([*lines, f"Content-Length: {size}"]) + "\r\n\r\n").encode()


def _writer(folder: str, chunk: int, level: int):
    def run(batches):
        out, path, records, size, done = None, "", 0, 0, []
        for batch in batches:
            ids, urls, pages, digests, refers = (batch.column(i) for i in range(5))
            for i in range(len(ids)):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    out, records, size = open_output(path), 0, 0
                page, ref, digest = ids[i].as_py(), refers[i].as_py(), base32(digests[i].as_py())
                buffer = pages[i].as_buffer()  # not copied
                payload = memoryview(buffer) if buffer is not None else memoryview(b"")
                uri = urllib.parse.quote(urls[i].as_py() or "urn:none", safe=":/?#[]@!$&'()*+,;=%~")
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                kind = "response" if ref is None else "revisit"
                body = payload if ref is None else memoryview(b"")
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                parts = [_head(kind, page, uri, len(http) + len(body), digest, ref, len(payload)), http]
                for at in range(0, len(body), chunk):
                    for x in parts:
                        size += out.write(packer.compress(x))
                    parts = [body[at : at + chunk]]
                for x in [*parts, b"\r\n\r\n"]:
                    size += out.write(packer.compress(x))
                size += out.write(packer.flush())
                records += 1
                if size >= FILE_BYTES:
                    out.close()
                    out = None
                    done.append((path, records, size))
        if out is not None:
            out.close()
            done.append((path, records, size))
        yield pa.record_batch([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return run


HOT_KEYS, LEAST_HOT = 10_000, 256


def plan(pages: DataFrame, least: int = 0) -> DataFrame:
    """``page_id, url, html, sha1, refers_to``: refers_to is set on revisits.

    Payloads that very many pages share (``HOT_KEYS`` at most) are joined by a broadcast and their pages
    are then dealt by page, so empty or error pages don't meet in one task.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    hashed = rows.withColumn("sha1", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    hot = max(LEAST_HOT, -(-2 * pages.count() // HOT_KEYS))
    shared = hashed.where(F.octet_length("html") >= least).groupBy("sha1").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    often = shared.where(F.col("_n") >= hot).select(F.col("sha1").alias("_often"), F.col("_first").alias("_often_first"))
    seldom = shared.where(F.col("_n") < hot).select(F.col("sha1").alias("_key"), "_first")
    met = hashed.join(F.broadcast(often), F.col("sha1") == F.col("_often"), "left")
    own = F.unhex(F.sha1(F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
    met = met.withColumn("_key", F.when(F.col("_often").isNull(), F.col("sha1")).otherwise(own)).join(seldom, "_key", "left")
    first = F.when(F.col("_often").isNotNull(), F.col("_often_first")).otherwise(F.col("_first"))
    other = first.isNotNull() & ~F.col("page_id").eqNullSafe(first) & (F.octet_length("html") >= least)
    return met.select("page_id", "url", "html", "sha1", F.when(other, first).alias("refers_to"))


def write(pages: DataFrame, folder: str, least: int = 0, chunk: int = CHUNK, level: int = 1) -> DataFrame:
    """Writes the archives and returns their manifest."""
    return cut(map_arrow(plan(pages, least), _writer(folder, chunk, level), MANIFEST), files_for(pages))


class _Bytes:
    """Inflated bytes of a (gzip) stream, a block at a time: neither what is read nor what it inflates to exceeds a block."""

    def __init__(self, stream, block: int):
        self.stream, self.block, self.packed, self.buffer, self.unpacker, self.pending = stream, block, None, bytearray(), None, b""

    def more(self) -> bool:
        if not self.pending:
            self.pending = self.stream.read(self.block)
        if self.packed is None:
            self.packed = self.pending[:2] == b"\x1f\x8b"
        if not self.packed:
            data, self.pending = self.pending, b""
            self.buffer += data
            return bool(data)
        if self.unpacker is None:
            if not self.pending:
                return False
            self.unpacker = zlib.decompressobj(31)
        at_end = not self.pending
        data = self.unpacker.decompress(self.pending, self.block)
        self.buffer += data
        if self.unpacker.eof:
            self.pending, self.unpacker = self.unpacker.unused_data, None
        else:
            self.pending = self.unpacker.unconsumed_tail
        return bool(data) or not at_end

    def until(self, mark: bytes) -> bytes | None:
        at = 0
        while (end := self.buffer.find(mark, max(0, at))) < 0:
            at = len(self.buffer) - len(mark)
            if not self.more():
                return None
        found = bytes(self.buffer[:end])
        del self.buffer[: end + len(mark)]
        return found

    def take(self, n: int):
        """Pieces that add up to ``n`` bytes."""
        while n:
            if not self.buffer and not self.more():
                raise ValueError("archive ends inside a record")
            piece = bytes(self.buffer[:n])
            del self.buffer[: len(piece)]
            n -= len(piece)
            if piece:
                yield piece


def records(stream, block: int = 1 << 18):
    """(headers, pieces of the block) for each record; the pieces must be used before the next record."""
    source = _Bytes(stream, block)
    while True:
        head = source.until(b"\r\n\r\n")
        if head is None:
            return
        lines = head.decode("utf-8", "replace").strip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        yield headers, source.take(int(headers.get("content-length", 0)))
        source.until(b"\r\n\r\n")


def _chunks(headers: dict, pieces, chunk: int):
    """(chunk number, payload chunk, bytes so far, digest so far, last) of one record."""
    http = headers.get("content-type", "").startswith("application/http")
    digest, total, number, held, head = hashlib.sha1(), 0, 0, bytearray(), bytearray()
    for piece in pieces:
        if http:
            head += piece
            end = head.find(b"\r\n\r\n")
            if end < 0:
                continue
            piece, http = bytes(head[end + 4 :]), False
        held += piece
        while len(held) > chunk:
            part = bytes(held[:chunk])
            del held[:chunk]
            digest.update(part)
            total += len(part)
            yield number, part, total, base32(digest.copy().digest()), False
            number += 1
    part = bytes(held)
    digest.update(part)
    yield number, part, total + len(part), base32(digest.digest()), True


def _reader(chunk: int, payload: bool, batch_bytes: int = 1 << 23):
    schema = pa.schema([("path", pa.string()), ("record_id", pa.string()), ("chunk_no", pa.int32()), ("record_type", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("is_last", pa.bool_())])
    number = lambda x: int(x) if x is not None else None

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_input(path) as stream:
                    for headers, pieces in records(stream):
                        kind = headers.get("warc-type")
                        for no, part, total, digest, last in _chunks(headers, pieces, chunk):
                            if kind == "revisit":  # its payload is that of the record it refers to
                                total, digest = number(headers.get("x-payload-length")), headers.get("warc-payload-digest", "").removeprefix("sha1:")
                            elif last and digest != headers.get("warc-payload-digest", f"sha1:{digest}").removeprefix("sha1:"):
                                raise ValueError(f"{headers.get('warc-record-id')}: the payload's digest is another")
                            rows.append((path, headers.get("warc-record-id"), no, kind, number(headers.get("x-page-id")), headers.get("warc-target-uri"), number(headers.get("x-refers-to-page-id")), part if payload else None, total, digest, last))
                            size += len(part) * payload + 300
                            if size >= batch_bytes:
                                yield pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
                                rows, size = [], 0
        yield pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def read(spark: SparkSession, archives: DataFrame, chunk: int = CHUNK, payload: bool = True) -> DataFrame:
    """The chunk table of the archives whose paths are in ``archives.path``; ``payload=False`` leaves the bytes out."""
    tasks = min(partitions_for(spark), max(1, archives.count()))
    return map_arrow(archives.select("path").repartition(tasks), _reader(chunk, payload), CHUNKS)


def archive(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Writes ``pages`` and reads them back: one row per record, of its last chunk."""
    spark = pages.sparkSession
    manifest = write(pages, folder or fresh_dir(spark, "warc"), least)
    return read(spark, manifest, payload=False).where("is_last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
