"""Small literal cases with their expected rows."""

import subprocess
import sys
from pathlib import Path

import pytest

from strandline import operators as ops
from strandline.sources import genome_frame, parse_bed

A = """chr1 100 200 a1 10 +
chr1 150 250 a2 20 -
chr1 300 400 a3 30 +
chr1 500 600 a4 40 -
chr1 550 650 a5 50 +
chr2 100 200 a6 60 +
chr2 300 400 a7 70 -
chr2 1000 2000 a8 80 +
chr3 50 100 a9 90 -
chr3 500 1000 a10 100 +"""
B = """chr1 120 180 b1 15 +
chr1 175 225 b2 25 -
chr1 350 450 b3 35 +
chr1 520 580 b4 45 -
chr1 700 800 b5 55 +
chr2 150 250 b6 65 +
chr2 350 380 b7 75 -
chr2 1500 1600 b8 85 +
chr3 75 125 b9 95 -
chr3 400 600 b10 105 +"""


@pytest.fixture(scope="module")
def bed(spark):
    return lambda text: parse_bed(spark, text.replace(" ", "\t"))


def spans(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or ("chrom", "start", "end"))).collect())


def one(*pairs):
    return "\n".join(f"chr1 {s} {e}" for s, e in pairs)


def test_pairs(bed):
    a, b = bed(A), bed(B)
    assert spans(ops.intersect(a, b, count=True), "name", "count") == sorted([("a1", 2), ("a2", 2), ("a3", 1), ("a4", 1), ("a5", 1), ("a6", 1), ("a7", 1), ("a8", 1), ("a9", 1), ("a10", 1)])
    assert ("a1", 100, 120) in spans(ops.subtract(a, b), "name", "start", "end") and ("a1", 180, 200) not in spans(ops.subtract(a, b), "name", "start", "end")
    assert spans(ops.intersect(a, b, strand="same", unique=True), "name") == [(n,) for n in sorted(["a1", "a2", "a3", "a4", "a6", "a7", "a8", "a9", "a10"])]
    assert ("a8", 1, 100, 1000, 0.1) in spans(ops.coverage(a, b), "name", "n_overlaps", "bases_covered", "length", "fraction")


def test_nested_and_touching(bed):
    nested = bed("chr1 100 500 outer 10 +\nchr1 150 200 i1 20 +\nchr1 250 300 i2 30 +\nchr1 350 400 i3 40 +\nchr1 600 700 x 50 -\nchr2 100 200 f 60 +\nchr2 150 300 o 70 +\nchr2 250 400 c 80 +")
    assert spans(ops.merge(nested)) == [("chr1", 100, 500), ("chr1", 600, 700), ("chr2", 100, 400)]
    touching = bed("chr1 100 200\nchr1 200 300\nchr1 300 400\nchr1 500 600\nchr1 601 700\nchr2 100 200\nchr2 200 201")
    assert spans(ops.merge(touching)) == [("chr1", 100, 400), ("chr1", 500, 600), ("chr1", 601, 700), ("chr2", 100, 201)]
    assert spans(ops.merge(touching, 1)) == [("chr1", 100, 400), ("chr1", 500, 700), ("chr2", 100, 201)]


def test_jaccard(bed):
    got = ops.jaccard(bed(one((100, 200), (150, 250), (300, 400))), bed(one((120, 180), (350, 450)))).first()
    assert tuple(got)[:2] == (110, 300) and got.n_intersections == 2
    assert tuple(ops.jaccard(bed(one((100, 200))), bed(one((200, 300)))).first()) == (0, 200, 0.0, 0)


def test_complement_slop_window(spark, bed):
    genome = genome_frame(spark, [("chr1", 500)])
    assert spans(ops.complement(bed(one((100, 200), (300, 400))), genome)) == [("chr1", 0, 100), ("chr1", 200, 300), ("chr1", 400, 500)]
    assert spans(ops.slop(bed("chr1 100 200 x 1 -"), genome, left=50, right=0, strand=True)) == [("chr1", 100, 250)]
    assert spans(ops.slop(bed(one((100, 200))), genome, 0.5, pct=True)) == [("chr1", 50, 250)]
    assert spans(ops.window(bed(one((500, 600))), bed(one((100, 200), (800, 900))), left=500, right=0), "b_start") == [(100,)]
    assert ops.intersect(bed(one((100, 200))), bed(one((50, 250))), fraction=0.6, reciprocal=True).count() == 0


def test_closest(bed):
    nested = ops.closest(bed(one((100, 200), (120, 150))), bed(one((180, 300), (400, 500))), ignore_overlapping=True)
    assert spans(nested, "start", "b_start", "distance") == [(100, 400, 201), (120, 180, 31)]
    none = ops.closest(bed(one((100, 200))), bed(one((150, 250))), ignore_overlapping=True, ignore_upstream=True, ignore_downstream=True).first()
    assert (none.b_chrom, none.b_start, none.b_end, none.distance) == (".", -1, -1, -1)
    assert ops.closest(bed(one((100, 200))), bed(one((200, 300)))).first().distance == 1


def test_multiinter_and_coverage_order(bed):
    sets = [bed(one((100, 200))), bed(one((150, 250))), bed(one((180, 280)))]
    assert spans(ops.multiinter(sets, cluster=True)) == [("chr1", 180, 200)]
    cov = ops.coverage(bed("chr2 0 100\nchr10 0 100"), bed("chr1 0 9\nchr2 50 100\nchr9 0 9\nchr10 0 50"))
    assert spans(cov, "n_overlaps", "bases_covered") == [(1, 50), (1, 50)]


def test_zero_length(bed):
    inside, edge = bed(one((150, 150))), bed(one((100, 100)))
    whole = bed(one((100, 200)))
    assert ops.intersect(inside, whole).count() == 1 and ops.intersect(edge, whole).count() == 0 and ops.intersect(inside, inside).count() == 0
    assert spans(ops.subtract(whole, inside)) == [("chr1", 100, 150), ("chr1", 150, 200)]


def test_edge_cases(bed):
    edge = bed("chr1 0 1\nchr1 100 100\nchr1 100 101\nchr1 999999999 1000000000\nchr10 100 200\nchr2 100 200\nchr1 100 200 d1 7 +\nchr1 100 200 d2 8 -\nchrM 100 200\nchrUn 100 200")
    assert ops.intersect(edge, edge, write_a=True).count() == 1 + 1 + 9 + 4
    assert [r.chrom for r in ops.sort(edge, "natural").collect()] == ["chr1"] * 6 + ["chr2", "chr10", "chrM", "chrUn"]


def test_entry_works_without_the_llm_folder(tmp_path):
    """The rest imports when the subpackage and the pipeline are gone."""
    import shutil

    root = Path(__file__).parent.parent
    shutil.copytree(root / "strandline", tmp_path / "strandline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'jaccard' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0 and int(done.stdout) > 50, done.stderr
