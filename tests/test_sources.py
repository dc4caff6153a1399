"""Readers, writers, validation, formats, API and command line."""

import io
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline import api
from strandline.__main__ import main
from strandline.functions.text import general6, parse_size, plain6, single7
from strandline.sources import format_bed, genome_frame, parse_bed, read_bed, read_genome, validate_sorted, write_bed
from strandline.sources.validate import order_faults

TEXT = """# comment
track name=x
browser position chr1
chr1\t100\t200\tx\t10\t+

chr1\t150\t250
chr2\t5\t5\ty\t2.5\t-\t5\t5\t255,0,0\t2\t10,20,\t0,30\tmore\tfields
chr2\t7\t9\tz\tabc\tq
"""


def test_parse(spark):
    rows = parse_bed(spark, TEXT).collect()
    assert [(r.chrom, r.start, r.end, r.name, r.score, r.strand) for r in rows] == [("chr1", 100, 200, "x", 10.0, "+"), ("chr1", 150, 250, None, None, None), ("chr2", 5, 5, "y", 2.5, "-"), ("chr2", 7, 9, "z", None, ".")]
    wide = rows[2]
    assert (wide.thick_start, wide.block_count, wide.block_sizes, wide.block_starts, wide.extra, wide.item_rgb) == (5, 2, [10, 20], [0, 30], ["more", "fields"], "255,0,0")
    assert [r.value for r in format_bed(parse_bed(spark, TEXT)).collect()] == ["chr1\t100\t200\tx\t10\t+", "chr1\t150\t250", "chr2\t5\t5\ty\t2.5\t-", "chr2\t7\t9\tz"]
    assert [r.value for r in format_bed(parse_bed(spark, TEXT), score_as_int=True).collect()][2] == "chr2\t5\t5\ty\t2\t-"
    assert parse_bed(spark, TEXT, bedtools_compatible=True).where("start = end").count() == 0


@pytest.mark.parametrize("line", ["chr1\t5", "chr1\tx\t9", "chr1\t1\ty", "chr1\t9\t3", "chr1\t-1\t3"])
def test_malformed(spark, line):
    assert parse_bed(spark, f"chr1\t1\t2\n{line}", mode="DROPMALFORMED").count() == 1
    with pytest.raises(Exception, match="Malformed line"):
        parse_bed(spark, line).collect()


def test_files(spark, tmp_path):
    (tmp_path / "g").write_text("#c\nchr2\t50\nchr1\t300\n\nchr2\t60\n")
    assert [tuple(r) for r in read_genome(spark, str(tmp_path / "g")).orderBy("ord").collect()] == [("chr2", 60, 0), ("chr1", 300, 1)]
    (tmp_path / "bad").write_text("chr1\n")
    with pytest.raises(Exception, match="Invalid genome line"):
        read_genome(spark, str(tmp_path / "bad")).collect()
    write_bed(parse_bed(spark, TEXT), str(tmp_path / "out"), single=True)
    assert read_bed(spark, str(tmp_path / "out")).count() == 4


def test_validate(spark):
    def frame(rows):
        return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos long, chrom string, start long")

    good = frame([("b", 1), ("b", 1), ("b", 5), ("a", 0)])
    validate_sorted(good, position="pos")
    with pytest.raises(ValueError, match="decreases"):
        validate_sorted(frame([("a", 5), ("a", 3)]), position="pos")
    with pytest.raises(ValueError, match="contiguous"):
        validate_sorted(frame([("a", 1), ("b", 1), ("a", 2)]), position="pos")
    order = genome_frame(spark, [("a", 10), ("b", 10)])
    with pytest.raises(ValueError, match="genome order"):
        validate_sorted(good, order, "pos")
    with pytest.raises(ValueError, match="not in the genome"):
        validate_sorted(frame([("z", 1)]), order, "pos")
    assert order_faults(frame([("a", 1), ("b", 2)]), order, "pos").count() == 0


def test_formats(spark):
    values = [0.0, 1.0, 0.5, 1 / 3, 0.00001234567, 123456.789, 1234567.0, 0.000123456789, 2 / 3, 0.6640625, 0.6640635, 0.1234565, 0.9999996, 12.34565, 1e-7, 0.25, 100.0, -0.75]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(general6("x")).collect()] == [f"{v:.6g}" for v in values]
    assert [r[0] for r in df.select(plain6("x")).collect()][:4] == ["0", "1", "0.5", "0.333333"]
    one = spark.range(1).select(single7(F.lit(1), F.lit(3)).alias("a"), single7(F.lit(1), F.lit(0)).alias("b")).first()
    assert (one.a, one.b) == ("0.3333333", "0.0000000")
    assert [parse_size(x) for x in ("1K", "5m", "2G", "17")] == [1000, 5_000_000, 2_000_000_000, 17]
    with pytest.raises(ValueError):
        parse_size("x")


def test_interval():
    i = api.Interval("chr1", 100, 200)
    assert len(i) == 100 and str(i) == "chr1\t100\t200" and repr(i) == "Interval('chr1', 100, 200)" and i.to_tuple() == ("chr1", 100, 200)
    assert i == api.Interval("chr1", 100, 200) and len({i, api.Interval("chr1", 100, 200)}) == 1
    assert i.overlaps(api.Interval("chr1", 199, 300)) and not i.overlaps(api.Interval("chr1", 200, 300)) and not i.overlaps(api.Interval("chr2", 100, 200))
    assert i.overlap_length(api.Interval("chr1", 150, 300)) == 50 and i.overlap_length(api.Interval("chr1", 300, 400)) == 0
    assert i.distance_to(api.Interval("chr1", 250, 300)) == 50 and i.distance_to(api.Interval("chr1", 0, 60)) == 40 and i.distance_to(i) == 0 and i.distance_to(api.Interval("chr2", 0, 1)) is None
    with pytest.raises(ValueError, match="start.*must be <= end"):
        api.Interval("chr1", 5, 4)


def test_interval_set(spark):
    s = api.parse_bed("chr1\t100\t200\nchr1\t150\t300\nchr1\t500\t600\n")
    assert len(s) == 3 and s[0] == api.Interval("chr1", 100, 200) and s[-1] == api.Interval("chr1", 500, 600)
    with pytest.raises(ValueError, match="out of bounds"):
        s[3]
    assert repr(s) == "IntervalSet(3 intervals)" and s.get(9) is None and s.chromosomes() == ["chr1"]
    query = api.Interval("chr1", 180, 510)
    assert s.find_overlap_indices(query) == [0, 1, 2] and s.count_overlaps(api.Interval("chr1", 120, 150)) == 1 and not s.has_overlap(api.Interval("chr2", 1, 2))
    assert s.find_overlaps(api.Interval("chr1", 120, 150)) == [api.Interval("chr1", 100, 200)]
    assert sorted(s.merge().to_list()) == [api.Interval("chr1", 100, 300), api.Interval("chr1", 500, 600)]
    other = api.IntervalSet.from_intervals([api.Interval("chr1", 190, 195)])
    assert len(s.intersect(other)) == 2 and s.non_overlapping(other).to_list() == [api.Interval("chr1", 500, 600)]
    s.add(api.Interval("chr0", 1, 2))
    s.sort()
    assert next(iter(s)) == api.Interval("chr0", 1, 2) and s.to_numpy().shape == (4, 2)
    assert len(api.from_numpy("c", np.array([[1, 2], [3, 4]]))) == 2
    with pytest.raises(ValueError):
        api.from_numpy("c", np.array([1, 2]))
    assert len(api.IntervalSet()) == 0


@pytest.fixture
def files(tmp_path):
    (tmp_path / "a.bed").write_text("chr1\t100\t200\ta1\t10\t+\nchr1\t300\t400\ta2\t20\t-\nchr2\t0\t50\ta3\t30\t+\n")
    (tmp_path / "b.bed").write_text("chr1\t150\t350\tb1\t1\t+\nchr3\t0\t10\tb2\t2\t-\n")
    (tmp_path / "g").write_text("chr1\t1000\nchr2\t100\n")
    return tmp_path


def run(*args):
    out = io.StringIO()
    with redirect_stdout(out):
        assert main([str(a) for a in args]) == 0
    return out.getvalue().splitlines()


def test_command_line(spark, files):
    a, b, g = files / "a.bed", files / "b.bed", files / "g"
    assert sorted(run("intersect", "-a", a, "-b", b)) == ["chr1\t150\t200\ta1\t10\t+", "chr1\t300\t350\ta2\t20\t-"]
    assert len(run("intersect", "-a", a, "-b", b, "-v")) == 1 and len(run("intersect", "-a", a, "-b", b, "-wa", "-wb")) == 2
    assert sorted(run("merge", "-i", a, "-d", "100")) == ["chr1\t100\t400", "chr2\t0\t50"]
    assert len(run("subtract", "-a", a, "-b", b)) == 3 and len(run("window", "-a", a, "-b", b)) == 2
    assert any("\t.\t-1\t-1" in x for x in run("closest", "-a", a, "-b", b, "-d"))
    assert len(run("coverage", "-a", a, "-b", b)) == 3 and len(run("coverage", "-a", a, "-b", b, "--hist")) == 5
    assert len(run("complement", "-i", a, "-g", g)) == 4 and len(run("slop", "-i", a, "-g", g, "-b", "10")) == 3
    assert len(run("genomecov", "-i", a, "-g", g, "--bg")) == 3
    assert run("jaccard", "-a", a, "-b", b) == ["100\t360\t0.277778\t2"]
    assert len(run("multiinter", "-i", a, b)) == 7
    assert [x.split("\t")[3] for x in run("sort", "-i", a, "--sizeA")] == ["a3", "a1", "a2"]
    assert main(["intersect", "-a", str(a), "-b", str(files / "b.bed"), "--strict-sorted"]) == 0


def test_output_files(spark, files):
    a, b, g = (str(files / x) for x in ("a.bed", "b.bed", "g"))
    read = lambda name: sorted(r.value for r in spark.read.text(str(files / name)).collect())
    assert api.coverage(a, b, str(files / "cov")) is None
    assert read("cov")[0].endswith("\t1\t50\t100\t0.5000000")
    api.genomecov(a, g, str(files / "hist"))
    assert "genome\t0\t850\t1100\t0.772727" in read("hist")
    api.jaccard(a, b, str(files / "jac"))
    assert read("jac") == ["100\t360\t0.277778\t2"]
    api.sort(a, str(files / "sorted"), reverse=True)
    assert len(read("sorted")) == 3
    api.complement(a, g, str(files / "gaps"))
    assert len(read("gaps")) == 4
    api.generate(str(files / "A"), str(files / "B"), 100, 50)
    assert len(read("A")) == 100 and len(read("B")) == 50
    with pytest.raises(ValueError):
        api.multiinter([a])
    api.multiinter([a, b], str(files / "multi"), header=True)
    assert (files / "multi").read_text().splitlines()[0] == f"chrom\tstart\tend\tnum\tlist\t{a}\t{b}" and (files / "multi").is_file()
    api.generate(str(files / "all" / "A.bed"), None, 20, mode="all")
    assert sorted(p.name for p in (files / "all").iterdir()) == sorted(api.ops.generate_modes())
    assert len((files / "all" / "clustered" / "A.bed").read_text().splitlines()) == 20


def test_errors_standard_input_and_stats(spark, files, monkeypatch, capsys):
    a, b = files / "a.bed", files / "b.bed"
    with pytest.raises(FileNotFoundError):
        api.merge(str(files / "none.bed"))
    (files / "bad.bed").write_text("chr1\t5\n")
    with pytest.raises(ValueError, match="Malformed line"):
        api.merge(str(files / "bad.bed"))
    assert main(["merge", "-i", str(files / "bad.bed")]) == 1 and main(["merge", "-i", str(files / "none.bed")]) == 1
    capsys.readouterr()
    monkeypatch.setattr("sys.stdin", io.StringIO(a.read_text()))
    assert run("intersect", "-a", "-", "-b", b, "-u", "--stats") and "rows of -: 3" in capsys.readouterr().err
    assert len(run("closest", "-a", a, "-b", b, "--same-strand")) == 3 and len(run("intersect", "-a", a, "-b", b, "--opposite-strand")) == 1
    assert run("jaccard", "-a", a, "-b", b, "--same-strand") == ["50\t410\t0.121951\t1"]


def test_window_sides_closest_lists_and_genome_lookups(spark, files):
    from strandline import operators as ops
    from strandline import sources

    a, b = (sources.read_bed(spark, str(files / x)).select("chrom", "start", "end", "strand") for x in ("a.bed", "b.bed"))
    assert ops.window(a, b, write_b=False).columns == a.columns and ops.window(a, b, write_a=False).columns[0] == "b_chrom"
    rows = {(r.chrom, r.start): r for r in ops.closest_lists(a, b).collect()}
    assert rows["chr1", 100].min_distance == 0 and not rows["chr2", 0].has_closest and rows["chr2", 0].min_distance is None
    g = sources.read_genome(spark, str(files / "g"))
    g = sources.insert(sources.insert(g, "chr9", 5), "chr1", 7)
    assert sources.chromosomes(g) == ["chr1", "chr2", "chr9"] and sources.chrom_size(g, "chr1") == 7 and not sources.has_chrom(g, "x")
