"""Work that must not grow with the number of overlapping pairs."""

import random
import re

import brute
import pytest
from pyspark.sql import functions as F

from strandline import operators as ops

SCHEMA = "id long, chrom string, start long, end long, strand string"


def rows(seed, n, chroms=("c1", "c2", None), size=60):
    rng = random.Random(seed)
    out = [(i, rng.choice(chroms), s := rng.randrange(0, 150), s + rng.choice([0, 0, 1, 2, 7, 20, size]), rng.choice("+-.")) for i in range(n)]
    return out + [(n, "c1", 70, 70, "+"), (n + 1, "c1", 70, 71, "-"), (n + 2, "c1", 69, 71, "."), (n + 3, "c9", 5, 5, "+"), (n + 4, "c9", 5, 9, "+")]


A, B = rows(5, 150), rows(6, 25) + [(100, "c1", 0, 220, "+"), (101, "c2", 3, 190, "-"), (102, "c2", 3, 191, "-"), (103, "c2", 3, 191, "-"), (104, "c9", 5, 5, "-")]
DENSE = 300


@pytest.fixture(scope="module")
def a(spark):
    return spark.createDataFrame(A, SCHEMA)


@pytest.fixture(scope="module")
def b(spark):
    return spark.createDataFrame(B, SCHEMA)


def dense(spark, n=DENSE):
    """Two sets of n rows that all overlap each other."""
    return [spark.range(n).select("id", F.lit("c1").alias("chrom"), (F.col("id") % 50).alias("start"), (F.col("id") % 50 + 100).alias("end"), F.lit("+").alias("strand")) for _ in "ab"]


def joined(spark, df):
    """The most rows that came out of a join while ``df`` was computed."""
    df.write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    ran = store.executionsList().last().executionId()
    values, graph, most = store.executionMetrics(ran), store.planGraph(ran).allNodes(), 0
    for i in range(graph.size()):
        node = graph.apply(i)
        if "Join" in node.name():
            for k in range(node.metrics().size()):
                m = node.metrics().apply(k)
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(re.sub(r"\D", "", values.apply(m.accumulatorId()))))
    return most


def met(x, y, strand):
    return brute.hit(x, y) and x[1] is not None and (strand is None or (x[4] == y[4]) == (strand == "same"))


@pytest.mark.parametrize("strand", [None, "same", "opposite"])
@pytest.mark.parametrize("tile", [None, 16])
def test_report_once(a, b, strand, tile):
    want = {}
    for x in A:
        if found := [(y[2], y[3], y[0]) for y in B if met(x, y, strand)]:
            want[x[0]] = min(found)
    got = ops.intersect(a, b, report_once=True, write_a=True, write_b=True, strand=strand, tile=tile).collect()
    assert len(got) == len(want) and {r["id"]: (r["b_start"], r["b_end"], r["b_id"]) for r in got} == want


def test_report_once_makes_no_pairs(spark):
    df = ops.intersect(*dense(spark), report_once=True)
    assert joined(spark, df) <= 4 * DENSE and df.count() == DENSE


@pytest.mark.parametrize("tie,strand,flags", [("first", None, {}), ("last", None, {}), ("first", None, {"ignore_upstream": True}), ("last", None, {"ignore_downstream": True}), ("first", None, {"ignore_overlapping": True}), ("last", None, {"ignore_overlapping": True}), ("first", "same", {}), ("last", "opposite", {}), ("last", None, {"max_distance": 3})])
@pytest.mark.parametrize("tile", [None, 16])
def test_closest_one(a, b, tie, strand, flags, tile):
    every = {}
    for r in ops.closest(a, b, strand=strand, **flags).collect():
        every.setdefault(r["id"], []).append((r["b_start"], r["b_end"], r["b_id"], r["distance"], r["signed_distance"], r["b_chrom"]))
    assert sorted(every) == sorted(x[0] for x in A)
    pick = min if tie == "first" else max
    got = ops.closest(a, b, tie=tie, strand=strand, tile=tile, **flags).collect()
    assert sorted(r["id"] for r in got) == sorted(every)
    assert {r["id"]: (r["b_start"], r["b_end"], r["b_id"], r["distance"], r["signed_distance"], r["b_chrom"]) for r in got} == {k: pick(v) if len(v) > 1 else v[0] for k, v in every.items()}


@pytest.mark.parametrize("tie", ["first", "last"])
def test_closest_one_makes_no_pairs(spark, tie):
    df = ops.closest(*dense(spark), tie=tie)
    assert joined(spark, df) <= 20 * DENSE and df.count() == DENSE


def depths(x, strand):
    return [sum(y[2] <= p < y[3] for y in B if x[1] is not None and y[1] == x[1] and met((0, x[1], p, p + 1, x[4]), y, strand)) for p in range(x[2], x[3])]


@pytest.mark.parametrize("strand", [None, "same", "opposite"])
@pytest.mark.parametrize("tile", [None, 16])
def test_depths(a, b, strand, tile):
    want, every, bases = [], {}, []
    for x in A:
        at = depths(x, strand)
        bases += [(x[0], i + 1, d) for i, d in enumerate(at)]
        for d in set(at) or {0}:
            want.append((x[0], d, at.count(d), len(at), at.count(d) / len(at) if at else 1.0))
            every[d] = every.get(d, 0) + at.count(d)
    total = sum(every.values())
    got = lambda mode, *columns: sorted(tuple(r) for r in ops.coverage(a, b, mode, strand=strand, tile=tile).select(*columns).collect())
    assert got("hist", "id", "depth", "bases", "length", "fraction") == sorted(want)
    assert got("all", "depth", "bases", "length", "fraction") == sorted((d, n, total, n / total) for d, n in every.items())
    assert got("per_base", "id", "offset", "depth") == sorted(bases)


@pytest.mark.parametrize("mode", ["hist", "all", "per_base"])
def test_depths_make_no_pairs_of_rows(spark, mode):
    a, b = dense(spark)
    a = a.withColumns({"start": F.col("start") + F.col("id") * 5, "end": F.lit(2000).cast("long")})
    b = b.withColumns({"start": F.lit(1600).cast("long"), "end": F.lit(1700).cast("long")})
    assert joined(spark, ops.coverage(a, b, mode)) <= 6 * DENSE


def test_all_of_nothing(spark, a, b):
    assert ops.coverage(a.where("false"), b, "all").count() == 0 == ops.coverage(a.where("false"), b, "hist").count()
    assert [tuple(r) for r in ops.coverage(a.where("start = end"), b, "all").collect()] == [("all", 0, 0, 0, 1.0)]
    assert sorted(r.depth for r in ops.coverage(a, b.where("false"), "hist").collect()) == [0] * len(A)


def test_lengths_of_every_size(spark):
    """Rows of 1 base to a whole chromosome, so of many levels."""
    rows = [(i, "c", s, s + (1 << k)) for i, (k, s) in enumerate((k, s) for k in range(0, 21, 2) for s in (0, 5, 1023, 70_000))]
    schema = "id long, chrom string, start long, end long"
    a = spark.createDataFrame(rows, schema)
    b = spark.createDataFrame([(i, "c", p, p + n) for i, (p, n) in enumerate([(0, 3), (6, 2), (1000, 5000), (1024, 1), (3000, 90_000), (70_001, 1), (80_000, 1 << 20)])], schema)
    want = sorted((r.id, r.bases_covered) for r in ops.coverage(a, b).collect())
    hist = ops.coverage(a, b, "hist")
    assert sorted((r.id, r.n) for r in hist.groupBy("id").agg(F.sum(F.when(F.col("depth") > 0, F.col("bases")).otherwise(0)).alias("n")).collect()) == want
    assert sorted((r.id, r.n) for r in hist.groupBy("id").agg(F.sum("bases").alias("n")).collect()) == sorted((r[0], r[3] - r[2]) for r in rows)


@pytest.mark.parametrize("genome", [None, [("c2", 100), ("c1", 100), ("c3", 100)]])
def test_order_of_rows_at_one_position(spark, genome):
    """Ties are resolved by the data, not by the order in which rows arrive."""
    from strandline.sources import genome_frame
    from strandline.sources.validate import order_faults

    data, seen = [(p, c, s) for p, s in ((1, 7), (1, 3), (1, 9), (2, 9), (2, 4)) for c in ("c1", "c2", "c3", "c8")] + [(3, "c1", 1), (0, "c8", 5)], set()
    known = genome_frame(spark, genome) if genome else None
    for seed in range(4):
        random.Random(seed).shuffle(data)
        df = spark.createDataFrame(data, "pos long, chrom string, start long").coalesce(1)
        seen.add(tuple(sorted(tuple(r) for r in order_faults(df, known, "pos").select("_pos", "chrom", "start", "reason").collect())))
    (faults,) = seen
    falls = [(p, c, s) for p, c, s, why in faults if why == "start position decreases"]
    assert falls == sorted([(2, c, 4) for c in ("c1", "c2", "c3", "c8")] + [(1, "c8", 3), (3, "c1", 1)])
    assert [c for _, c, _, why in faults if why == "chromosomes are not in genome order"] == []


def test_strand_bits_are_strand_matches(spark):
    from strandline.functions.algebra import strand_bit, strand_bits, strand_matches

    strands = ["+", "-", ".", "x", "", None]
    df = spark.createDataFrame([(x, y) for x in strands for y in strands], "x string, y string")
    for which in ("same", "opposite"):
        both = df.select(strand_matches(F.col("x"), F.col("y"), which).alias("m"), (strand_bits("x", which).bitwiseAND(strand_bit("y")) != 0).alias("n"), "x", "y").collect()
        assert [r for r in both if r.m != r.n] == []


@pytest.mark.parametrize("which", ["same", "opposite"])
def test_rows_of_b_are_not_copied_for_each_strand(spark, which):
    """A row of B that sees all strands meets a near row of A from one place of an end, not from one for each group."""
    a, b = dense(spark)
    b = b.withColumns({"start": F.col("id") + 1000, "end": F.col("id") + 1010, "strand": F.lit(None).cast("string")})
    df = ops.closest(a, b, strand=which)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert df.count() == DENSE and "b__g" not in plan
