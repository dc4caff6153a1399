"""Top-k search and WARC archives."""

import base64
import gzip
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from strandline.llm import topk, warc


def vectors(n=300, d=19, seed=1):
    rng, out = random.Random(seed), []
    for i in range(n):
        out.append((i, [rng.gauss(0, 0.3) for _ in range(d)]))
    out[7] = (7, None)
    out[8] = (8, [0.1, None])
    out[9] = (9, [float("nan")] * d)
    out[10] = (10, [float("inf")] + [0.0] * (d - 1))
    out[11] = (11, [])
    out[12] = (12, [0.5] * 3)
    out += [(1000 + i, out[20][1]) for i in range(30)] + [(None, out[20][1]), (20, out[20][1]), (100, out[100][1]), (100, out[100][1]), (200, out[200][1])]
    return out


def brute(rows, k=10):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in good if i % 100 == 0}:
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in good if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [None, 40, 1000])
def test_top_k(spark, block):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("part", F.lit(1))
    got = topk.top_k(df, F.col("vec_id") % 100 == 0, block=block)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_top_k_large_numbers_and_few_rows(spark):
    rows = [(0, [1e12, -3.0]), (1, [2e12, 5.0]), (2, [-1e12, 1.0]), (3, [7.0, 7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    top = 2**63 - 1
    want = [(q, r, i, max(-(2**63), min(top, s))) for q, r, i, s in brute(rows)]
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 100 == 0).collect())) == want
    assert topk.top_k(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def pages():
    big = "é" * 700_000
    return [(5, "http://a/ b", "x"), (3, None, "x"), (9, "u", None), (4, "u", ""), (6, "u", big), (2, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (8, "u", big), (7, "u", "y"), (None, "u", "z"), (11, "u", "z")]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("chunk", [warc.CHUNK, 1000])
def test_warc(spark, tmp_path, chunk):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").withColumn("sha1", F.lit("x")).repartition(3)
    manifest = warc.write(df, f"file://{tmp_path}/w", chunk=chunk)
    table = warc.read(spark, manifest, chunk=chunk)
    chunks = table.collect()
    first = {}
    for p, _, h in pages():
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    last = {r.page_id: r for r in chunks if r.is_last}
    assert len(last) == len(pages()) == manifest.agg(F.sum("records")).first()[0]
    for p, _, h in pages():
        r = last[p]
        assert (r.payload_bytes, r.payload_digest) == (len((h or "").encode()), digest(h))
        original = first.get(h or "")
        revisit = original is not None and original != p
        assert (r.record_type, r.refers_to) == (("revisit", original) if revisit else ("response", None))
        own = sorted((x for x in chunks if x.page_id == p), key=lambda x: x.chunk_no)
        assert [x.chunk_no for x in own] == list(range(len(own)))
        if not revisit:
            sofar = b""
            for x in own:
                sofar += x.payload
                assert x.payload_digest == base64.b32encode(hashlib.sha1(sofar).digest()).decode() and x.payload_bytes == len(sofar)
            assert sofar == (h or "").encode() and all(len(x.payload) <= chunk for x in own)
    text = b"".join(gzip.open(f).read() for f in (tmp_path / "w").iterdir())
    assert text.count(b"WARC-Type: response") + text.count(b"WARC-Type: revisit") == len(pages())
    assert {r.record_type for r in warc.archive(df, f"file://{tmp_path}/v", least=10**9).collect()} == {"response"}
    assert warc.archive(df.where("false")).count() == 0


def test_payloads_shared_by_many_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "LEAST_HOT", 3)
    rows = [(i, "u", ["", "same", f"own {i}", "two" if i < 8 else f"x{i}"][i % 4]) for i in range(40)] + [(None, "u", ""), (None, "u", "two")]
    got = {r.page_id: r.refers_to for r in warc.plan(spark.createDataFrame(rows, "page_id long, url string, html string")).collect() if r.page_id is not None}
    assert got == {i: {0: 0, 1: 1, 3: 3 if i < 8 else i}.get(i % 4, i) if i != {0: 0, 1: 1, 3: 3 if i < 8 else i}.get(i % 4, i) else None for i in range(40)}
    nulls = [r.refers_to for r in warc.plan(spark.createDataFrame(rows, "page_id long, url string, html string")).where("page_id IS NULL").collect()]
    assert sorted(nulls) == [0, 3]


def test_records_inflate_in_bounded_blocks():
    import io

    body = b"\0" * 40_000_000
    raw = gzip.compress(b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)) * 2
    source = warc._Bytes(io.BytesIO(raw), 1 << 16)
    for _ in range(2):
        assert source.until(b"\r\n\r\n")
        size = 0
        for piece in source.take(len(body)):
            size += len(piece)
            assert len(piece) <= 1 << 17 and len(source.buffer) <= 1 << 17
        assert size == len(body) and source.until(b"\r\n\r\n") == b""
    assert source.until(b"\r\n\r\n") is None


def test_plain_archives_are_read(tmp_path):
    import io

    body = b"HTTP/1.1 200 OK\r\n\r\nhello"
    one = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    for raw in (one * 3, gzip.compress(one * 3), gzip.compress(one) * 3):
        got = [b"".join(p for _, p, *_ in warc._chunks(h, pieces, 2)) for h, pieces in warc.records(io.BytesIO(raw), 7)]
        assert got == [b"hello"] * 3
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(b"nonsense\r\n\r\n")))
