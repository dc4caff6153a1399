"""Operators against brute force on random rows with empty, nested, touching and equal rows."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from strandline import operators as ops
from strandline.plans.rangejoin import Bins, range_join
from strandline.sources import genome_frame

SCHEMA = "id long, chrom string, start long, end long, strand string"
SIZES = {"c1": 300, "c2": 120, "c3": 50, "c5": 40}


def rows(seed, n, chroms, long=False):
    rng, out = random.Random(seed), []
    for i in range(n):
        size = rng.choice([0, 0, 1, 5, 12, 30] + [250] * long)
        s = rng.randrange(0, 100)
        out.append((i, rng.choice(chroms), s, s + size, rng.choice("+-.")))
    out += [(n, chroms[0], 10, 20, "+"), (n + 1, chroms[0], 10, 20, "-"), (n + 2, chroms[0], 20, 30, "+"), (n + 3, chroms[0], 12, 12, "+")]
    return out


A, B = rows(1, 70, ["c1", "c2", "c3"], long=True), rows(2, 60, ["c1", "c2", "c4"], long=True)


@pytest.fixture(scope="module")
def a(spark):
    return spark.createDataFrame(A, SCHEMA)


@pytest.fixture(scope="module")
def b(spark):
    return spark.createDataFrame(B, SCHEMA)


@pytest.fixture(scope="module")
def genome(spark):
    return genome_frame(spark, SIZES.items())


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


PAIRS = sorted((x[0], y[0]) for x in A for y in B if brute.hit(x, y))


@pytest.mark.parametrize("bins", [None, Bins(16), Bins(4, 0), Bins(1, 1), Bins(1, 2), Bins(1024)])
def test_range_join_any_bins(a, b, bins):
    assert got(range_join(a, b, bins=bins), "id", "b_id") == PAIRS


@pytest.mark.parametrize("slop", [(0, 0), (7, 0), (0, 9), (200, 200)])
def test_window(a, b, slop):
    want = sorted((x[0], y[0]) for x in A for y in B if x[1] == y[1] and max(x[2] - slop[0], 0) < y[3] and y[2] < x[3] + slop[1])
    assert got(ops.window(a, b, left=slop[0], right=slop[1]), "id", "b_id") == want
    counts = {x[0]: 0 for x in A}
    for i, _ in want:
        counts[i] += 1
    assert got(ops.window(a, b, left=slop[0], right=slop[1], count=True, no_overlap=True), "id", "count") == sorted(counts.items())
    assert got(ops.window(a, b, left=slop[0], right=slop[1], no_overlap=True), "id") == sorted((i,) for i, n in counts.items() if not n)


def test_intersect_modes(a, b):
    assert got(ops.intersect(a, b), "id", "start", "end") == sorted((x[0], max(x[2], y[2]), min(x[3], y[3])) for x in A for y in B if brute.hit(x, y))
    assert got(ops.intersect(a, b, write_a=True), "id", "start") == sorted((x[0], x[2]) for x in A for y in B if brute.hit(x, y))
    assert got(ops.intersect(a, b, write_a=True, write_b=True), "id", "b_id") == PAIRS
    assert got(ops.intersect(a, b, write_b=True), "id", "b_id") == PAIRS
    hits = {i for i, _ in PAIRS}
    assert got(ops.intersect(a, b, unique=True), "id") == sorted((i,) for i in hits)
    assert got(ops.intersect(a, b, no_overlap=True), "id") == sorted((x[0],) for x in A if x[0] not in hits)
    assert got(ops.intersect(a, b, count=True), "id", "count") == sorted((x[0], sum(i == x[0] for i, _ in PAIRS)) for x in A)
    first = {}
    for x in A:
        for y in B:
            if brute.hit(x, y):
                first[x[0]] = min(first.get(x[0], (1e9, 1e9)), (y[2], y[3]))
    assert len(got(ops.intersect(a, b, report_once=True), "id")) == len(first)


def test_intersect_precedence(a, b):
    assert got(ops.intersect(a, b, no_overlap=True, count=True, unique=True), "id") == got(ops.intersect(a, b, no_overlap=True), "id")
    assert "count" in ops.intersect(a, b, count=True, unique=True, write_a=True).columns


@pytest.mark.parametrize("f,g,r", [(0.5, None, False), (None, 0.5, False), (0.5, None, True), (0.3, 0.9, True), (None, None, True)])
def test_fractions(a, b, f, g, r):
    def ok(x, y):
        ov = max(0, min(x[3], y[3]) - max(x[2], y[2]))
        fb = g if g is not None else f if r and f is not None else None
        return (f is None or (x[3] > x[2] and ov / (x[3] - x[2]) >= f)) and (fb is None or (y[3] > y[2] and ov / (y[3] - y[2]) >= fb))

    want = sorted((x[0], y[0]) for x in A for y in B if brute.hit(x, y) and ok(x, y))
    assert got(ops.intersect(a, b, write_b=True, fraction=f, fraction_b=g, reciprocal=r), "id", "b_id") == want


@pytest.mark.parametrize("which", ["same", "opposite"])
def test_strand(a, b, which):
    want = sorted((x[0], y[0]) for x in A for y in B if brute.hit(x, y) and (x[4] == y[4]) == (which == "same"))
    assert got(ops.intersect(a, b, write_b=True, strand=which), "id", "b_id") == want


def test_subtract(a, b):
    assert got(ops.subtract(a, b), "id", "start", "end") == sorted(brute.subtract(A, B))
    assert got(ops.subtract(a, b, remove_entire=True), "id") == got(ops.intersect(a, b, no_overlap=True), "id")
    assert ops.subtract(a.where("start < end"), a).count() == 0
    passing = [y for y in B]
    want = []
    for x in A:
        kept = [y for y in passing if brute.hit(x, y) and x[3] > x[2] and (min(x[3], y[3]) - max(x[2], y[2])) / (x[3] - x[2]) >= 0.5]
        want += brute.subtract([x], kept)
    assert got(ops.subtract(a, b, fraction=0.5), "id", "start", "end") == sorted(want)


@pytest.mark.parametrize("flags", [{}, {"io": True}, {"iu": True}, {"id_": True}, {"io": True, "iu": True}, {"io": True, "id_": True}, {"io": True, "iu": True, "id_": True}, {"most": 5}, {"io": True, "most": 3}])
@pytest.mark.parametrize("tile", [None, 16])
def test_closest(a, b, flags, tile):
    df = ops.closest(a, b, ignore_overlapping=flags.get("io", False), ignore_upstream=flags.get("iu", False), ignore_downstream=flags.get("id_", False), max_distance=flags.get("most"), tile=tile)
    key = lambda x: (x[0], -1 if x[1] is None else x[1], x[2])
    assert sorted(map(key, (tuple(r) for r in df.select("id", "b_id", "distance").collect()))) == sorted(map(key, brute.closest(A, B, **flags)))


def test_closest_ties(a, b):
    every = {}
    for r in ops.closest(a, b).collect():
        every.setdefault(r["id"], []).append((r["b_start"], r["b_end"], r["b_id"]))
    for tie, pick in (("first", min), ("last", max)):
        one = {r["id"]: (r["b_start"], r["b_end"], r["b_id"]) for r in ops.closest(a, b, tie=tie).collect()}
        assert one == {k: pick(v) if v[0][2] is not None else v[0] for k, v in every.items()}


@pytest.mark.parametrize("d", [0, 1, 10])
@pytest.mark.parametrize("tile", [None, 7])
def test_merge(a, d, tile):
    assert got(ops.merge(a, d, count=True, tile=tile), "chrom", "start", "end", "count") == sorted(brute.merge(A, d))


def test_merge_strand_and_columns(spark, a):
    want = sorted((c, s, e, st) for st in "+-." for c, s, e, _ in brute.merge([x for x in A if x[4] == st]))
    assert got(ops.merge(a, strand=True), "chrom", "start", "end", "strand") == want
    df = spark.createDataFrame([("c", 0, 5, "x", 1.0, "+"), ("c", 3, 8, "y", 3.0, "-"), ("c", 6, 9, "x", None, "+"), ("c", 20, 30, None, 7.0, "+")], "chrom string, start long, end long, name string, score double, strand string")
    one = ops.merge(df, operations={"score": ["sum", "min", "max", "mean", "median", "count"], "name": ["count_distinct", "collapse", "distinct", "first", "last"]}).orderBy("start").collect()
    assert one[0].asDict() == {"chrom": "c", "start": 0, "end": 9, "score_sum": 4.0, "score_min": 1.0, "score_max": 3.0, "score_mean": 2.0, "score_median": 2.0, "score_count": 2, "name_count_distinct": 2, "name_collapse": "x,y,x", "name_distinct": "x,y", "name_first": "x", "name_last": "x"}
    assert one[1]["name_collapse"] == "" and one[1]["name_first"] is None
    records = ops.merge(df, records=True).orderBy("start").first()
    assert (records["count"], records["names"], records["scores"], records["mean_score"]) == (3, ["x", "y", "x"], [1.0, 3.0], 2.0)
    assert ops.merge(df, strand=True, strand_mode="adjacent").count() == 4


def test_coverage(a, b):
    assert got(ops.coverage(a, b), "id", "n_overlaps", "bases_covered", "length") == sorted(brute.coverage(A, B))
    hist = {(r["id"], r["depth"]): r["bases"] for r in ops.coverage(a, b, "hist").collect()}
    assert hist == brute.histogram(A, B)
    mean = {r["id"]: r["mean_depth"] for r in ops.coverage(a, b, "mean").collect()}
    for x in A:
        total = sum(e - s for s, e in brute.segments(x, B))
        assert mean[x[0]] == pytest.approx(total / (x[3] - x[2]) if x[3] > x[2] else 0)
    every = {}
    for (_, d), n in hist.items():
        every[d] = every.get(d, 0) + n
    assert {r["depth"]: r["bases"] for r in ops.coverage(a, b, "all").collect()} == every
    base = ops.coverage(a, b, "per_base")
    assert base.count() == sum(x[3] - x[2] for x in A)
    want = sorted((x[0], p - x[2] + 1, sum(s <= p < e for s, e in brute.segments(x, B))) for x in A for p in range(x[2], x[3]))
    assert got(base, "id", "offset", "depth") == want


@pytest.mark.parametrize("tile", [None, 11])
def test_genomecov(a, genome, tile):
    want_hist, want_bga = {}, []
    for chrom, size in SIZES.items():
        d = brute.depth(A, chrom, size)
        for x in d:
            want_hist[chrom, x] = want_hist.get((chrom, x), 0) + 1
            want_hist["genome", x] = want_hist.get(("genome", x), 0) + 1
        s = 0
        for p in range(1, size + 1):
            if p == size or d[p] != d[s]:
                want_bga.append((chrom, s, p, d[s]))
                s = p
    assert {(r["chrom"], r["depth"]): r["bases"] for r in ops.genomecov(a, genome, tile=tile).collect()} == want_hist
    assert got(ops.genomecov(a, genome, "bga", tile=tile), "chrom", "start", "end", "depth") == sorted(want_bga)
    assert got(ops.genomecov(a, genome, "bg", tile=tile), "chrom", "start", "end", "depth") == sorted(x for x in want_bga if x[3])
    assert got(ops.genomecov(a, genome, "bg", scale=0.5, tile=tile), "chrom", "start", "end", "depth") == sorted((c, s, e, d // 2) for c, s, e, d in want_bga if d)
    assert ops.genomecov(a, genome, "per_base").count() == sum(SIZES.values())


@pytest.mark.parametrize("tile", [None, 13])
def test_complement(a, genome, tile):
    want = []
    for chrom, size in SIZES.items():
        free = [x == 0 for x in brute.depth(A, chrom, size)]
        s = None
        for p in range(size + 1):
            if p < size and free[p]:
                s = p if s is None else s
            elif s is not None:
                want.append((chrom, s, p))
                s = None
    solid = a.where("start < end")
    assert got(ops.complement(solid, genome, tile), "chrom", "start", "end") == sorted(want)
    twice = ops.complement(ops.complement(solid, genome), genome)
    assert got(ops.merge(twice), "chrom", "start", "end") == sorted((c, s, min(e, SIZES[c])) for c, s, e, _ in brute.merge([x for x in A if x[2] < x[3]]) if s < SIZES.get(c, 0))


@pytest.mark.parametrize("tile", [None, 9])
def test_jaccard_and_multiinter(spark, a, b, tile):
    both = any_ = runs = 0
    for chrom in ("c1", "c2", "c3", "c4"):
        x, y = brute.depth(A, chrom, 400), brute.depth(B, chrom, 400)
        both += sum(p > 0 and q > 0 for p, q in zip(x, y, strict=True))
        any_ += sum(p > 0 or q > 0 for p, q in zip(x, y, strict=True))
        runs += sum(x[i] > 0 and y[i] > 0 and not (i and x[i - 1] > 0 and y[i - 1] > 0) for i in range(400))
    one = ops.jaccard(a, b, tile).first()
    assert (one["intersection"], one["union"], one["n_intersections"]) == (both, any_, runs)
    assert one["jaccard"] == pytest.approx(both / any_)
    assert ops.jaccard(a, a).first()["jaccard"] == 1.0
    c = spark.createDataFrame(rows(3, 40, ["c1", "c3"]), SCHEMA)
    sets = [A, B, rows(3, 40, ["c1", "c3"])]
    want = []
    for chrom in ("c1", "c2", "c3", "c4"):
        cuts = sorted({p for s in sets for r in s if r[1] == chrom and r[2] < r[3] for p in r[2:4]})
        for s, e in zip(cuts, cuts[1:], strict=False):
            on = [int(any(r[1] == chrom and r[2] <= s and r[3] >= e and r[2] < r[3] for r in rows_)) for rows_ in sets]
            if any(on):
                want.append((chrom, s, e, sum(on), ",".join(str(i + 1) for i, x in enumerate(on) if x), *on))
    columns = ("chrom", "start", "end", "n", "list", "set1", "set2", "set3")
    assert got(ops.multiinter([a, b, c], tile=tile), *columns) == sorted(want)
    assert got(ops.multiinter([a, b, c], cluster=True, tile=tile), *columns) == sorted(x for x in want if x[3] == 3)


def test_slop(spark, genome):
    df = spark.createDataFrame([("c1", 100, 200, "-"), ("c1", 290, 300, "+"), ("cX", 0, 10, "+"), ("c1", 5, 9, "+")], "chrom string, start long, end long, strand string")
    assert got(ops.slop(df, genome, left=50, right=0, strand=True), "start", "end") == [(0, 9), (100, 250), (240, 300)]
    assert got(ops.slop(df, genome, 0.5, pct=True), "start", "end") == [(3, 11), (50, 250), (285, 300)]
    assert got(ops.slop(df, genome, 20), "start", "end") == [(0, 29), (80, 220), (270, 300)]


def test_sort(spark, genome):
    data = [(0, "chr10", 5, 9), (1, "chr2", 1, 100), (2, "chr2", 1, 3), (3, "chrX", 0, 1), (4, "chr2", 1, 3)]
    df = spark.createDataFrame(data, "id long, chrom string, start long, end long").coalesce(1)
    ids = lambda d: [r["id"] for r in d.collect()]
    assert ids(ops.sort(df)) == [0, 2, 4, 1, 3]
    assert ids(ops.sort(df, reverse=True)) == [3, 1, 4, 2, 0]
    assert ids(ops.sort(df, "natural")) == [2, 4, 1, 0, 3]
    assert ids(ops.sort(df, "size_asc")) == [2 + 1, 2, 4, 0, 1]
    assert ids(ops.sort(df, "size_desc")) == [1, 0, 2, 4, 3]
    assert ids(ops.sort(df, "chrom")) == [0, 1, 2, 4, 3]
    order = genome_frame(spark, [("chrX", 10), ("chr2", 10)])
    assert ids(ops.sort(df, genome=order)) == [3, 2, 4, 1, 0]
    with pytest.raises(ValueError):
        ops.sort(df, "nope")


def test_generate(spark):
    a, b = ops.generate(spark, "2K", 500, seed=1)
    assert (a.count(), b.count()) == (2000, 500)
    stats = a.select(F.min(F.col("end") - F.col("start")), F.max(F.col("end") - F.col("start")), F.min("start"), F.countDistinct("chrom")).first()
    assert 50 <= stats[0] and stats[1] <= 1000 and stats[2] >= 0 and stats[3] == 23
    assert a.exceptAll(ops.generate(spark, "2K", seed=1)[0]).count() == 0
    x, y = ops.generate(spark, 100, mode="identical")
    assert x.exceptAll(y).count() == 0
    assert ops.generate(spark, 1000, mode="skewed-a-gt-b")[1].count() == 100
    assert ops.generate(spark, 1000, mode="clustered")[0].count() == 1000
    with pytest.raises(ValueError):
        ops.generate(spark, 10, mode="nope")


def test_empty_inputs(spark, a, genome):
    none = a.where("false")
    assert ops.intersect(none, a).count() == 0 and ops.intersect(a, none).count() == 0
    assert ops.intersect(a, none, no_overlap=True).count() == len(A)
    assert ops.merge(none).count() == 0
    assert ops.closest(a, none).where("distance = -1").count() == len(A)
    assert got(ops.complement(none, genome), "chrom", "start", "end") == sorted((c, 0, n) for c, n in SIZES.items())
    assert ops.jaccard(none, none).first()["jaccard"] == 0.0
    assert ops.subtract(a, none).count() == len(A)
    assert ops.coverage(a, none).where("n_overlaps > 0").count() == 0


@pytest.mark.parametrize("tile", [None, 8])
def test_null_keys_are_groups_in_tiles(spark, tile):
    rows = [("c", 0, 5, None), ("c", 3, 9, None), ("c", 20, 22, "+"), (None, 1, 4, "+"), (None, 2, 30, "+"), ("c", 21, 40, "+")]
    df = spark.createDataFrame(rows, "chrom string, start bigint, end bigint, strand string")
    got = sorted((tuple(r) for r in ops.merge(df, strand=True, tile=tile).collect()), key=str)
    assert got == sorted([("c", 0, 9, None), ("c", 20, 40, "+"), (None, 1, 30, "+")], key=str)


def test_closest_keeps_rows_of_odd_strands(spark):
    a = spark.createDataFrame([("c", 10, 20, "x"), ("c", 10, 20, None), ("c", 10, 20, "+")], "chrom string, start bigint, end bigint, strand string")
    b = spark.createDataFrame([("c", 12, 14, "+"), ("c", 30, 40, "."), ("c", 50, 60, "-")], "chrom string, start bigint, end bigint, strand string")
    got = {r.strand: (r.b_start, r.distance) for r in ops.closest(a, b, strand="same").collect()}
    assert got == {"x": (30, 11), None: (12, 0), "+": (12, 0)}
    got = {r.strand: (r.b_start, r.distance) for r in ops.closest(a, b, strand="opposite").collect()}
    assert got == {"x": (12, 0), None: (12, 0), "+": (30, 11)}


def test_each_base_in_pieces(spark, monkeypatch):
    from strandline.plans import sweep

    monkeypatch.setattr(sweep, "PIECE", 7)
    genome = genome_frame(spark, [("c", 100), ("d", 3)])
    a = spark.createDataFrame([("c", 10, 40), ("c", 20, 30)], "chrom string, start bigint, end bigint")
    got = sorted((r.chrom, r.pos, r.depth) for r in ops.genomecov(a, genome, "per_base").collect())
    assert got == sorted([("c", p + 1, (10 <= p < 40) + (20 <= p < 30)) for p in range(100)] + [("d", p, 0) for p in (1, 2, 3)])


def test_plans_aggregate_by_hash(spark):
    a = spark.createDataFrame([("c", 10, 40, "n")], "chrom string, start bigint, end bigint, name string")
    for df in (ops.intersect(a, a, unique=True), ops.intersect(a, a, count=True), ops.intersect(a, a, no_overlap=True)):
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
