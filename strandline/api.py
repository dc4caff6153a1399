"""Python API: Interval, IntervalSet, and file functions that take paths or DataFrames.

File functions return a DataFrame, or write text to ``output`` (one file; '-' is standard output) and return None.
Paths may be '-' for standard input. What can't be read raises OSError, malformed text ValueError.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import operators as ops
from .functions.text import general6, plain6, single7
from .sources import bed, genome, validate

Source = "str | DataFrame | IntervalSet"


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


@contextmanager
def plain_errors():
    """Spark's exceptions as Python's: OSError for what isn't there, ValueError for malformed text."""
    try:
        yield
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "PATH_ALREADY_EXISTS" in str(e):
            raise (FileNotFoundError if "PATH_NOT_FOUND" in str(e) else FileExistsError)(str(e).split("SQLSTATE")[0].strip()) from None
        raise
    except Exception as e:
        text = str(e)
        at = min((i for i in (text.find("Malformed line"), text.find("Invalid genome line")) if i >= 0), default=-1)
        if at < 0 or not (isinstance(e, PySparkException) or "py4j" in type(e).__module__):
            raise
        raise ValueError(text[at:].split("\n")[0].strip()) from None


@dataclass(frozen=True, order=True)
class Interval:
    """A 0-based half-open interval."""

    chrom: str
    start: int
    end: int

    def __post_init__(self):
        if self.start < 0:
            raise ValueError(f"start ({self.start}) must be >= 0")
        if self.start > self.end:
            raise ValueError(f"start ({self.start}) must be <= end ({self.end})")

    def __len__(self) -> int:
        return self.end - self.start

    def __repr__(self) -> str:
        return f"Interval({self.chrom!r}, {self.start}, {self.end})"

    def __str__(self) -> str:
        return f"{self.chrom}\t{self.start}\t{self.end}"

    def overlaps(self, other: Interval) -> bool:
        return self.chrom == other.chrom and self.start < other.end and other.start < self.end

    def overlap_length(self, other: Interval) -> int:
        return max(0, min(self.end, other.end) - max(self.start, other.start)) if self.chrom == other.chrom else 0

    def distance_to(self, other: Interval) -> int | None:
        """None on different chromosomes, 0 if overlapping, else the bases between."""
        if self.chrom != other.chrom:
            return None
        if self.overlaps(other):
            return 0
        return self.start - other.end if other.end <= self.start else other.start - self.end

    def to_tuple(self) -> tuple[str, int, int]:
        return self.chrom, self.start, self.end


class IntervalSet:
    """Intervals in a DataFrame with columns chrom, start, end. ``add`` and ``sort`` change the set."""

    def __init__(self, df: DataFrame | None = None):
        self.df = df if df is not None else session().createDataFrame([], "chrom string, start bigint, end bigint")

    @classmethod
    def from_intervals(cls, intervals: Iterable[Interval]) -> IntervalSet:
        return cls(session().createDataFrame([i.to_tuple() for i in intervals], "chrom string, start bigint, end bigint"))

    def __len__(self) -> int:
        with plain_errors():
            return self.df.count()

    def __repr__(self) -> str:
        return f"IntervalSet({len(self)} intervals)"

    def __getitem__(self, i: int) -> Interval:
        n = len(self)
        at = i + n if i < 0 else i
        if not 0 <= at < n:
            raise ValueError(f"index {i} is out of bounds for {n} intervals")
        row = self.df.select("chrom", "start", "end").offset(at).first()
        return Interval(*row)

    def __iter__(self):
        with plain_errors():
            for row in self.df.select("chrom", "start", "end").toLocalIterator():
                yield Interval(*row)

    def get(self, i: int) -> Interval | None:
        return self[i] if 0 <= i < len(self) else None

    def chromosomes(self) -> list[str]:
        return sorted(r[0] for r in self.df.select("chrom").distinct().collect())  # a row for each chromosome

    def _overlapping(self, query: Interval, df: DataFrame) -> DataFrame:
        return df.where((F.col("chrom") == query.chrom) & (F.col("start") < query.end) & (F.col("end") > query.start))

    def find_overlaps(self, query: Interval) -> list[Interval]:
        return [Interval(*r) for r in self._overlapping(query, self.df).select("chrom", "start", "end").collect()]

    def find_overlap_indices(self, query: Interval) -> list[int]:
        """Places, as in ``self[i]``, of the intervals that overlap ``query``."""
        counted = self.df.select("chrom", "start", "end").rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
        placed = session().createDataFrame(counted, "chrom string, start bigint, end bigint, i bigint")
        return sorted(r["i"] for r in self._overlapping(query, placed).select("i").collect())

    def count_overlaps(self, query: Interval) -> int:
        return self._overlapping(query, self.df).count()

    def has_overlap(self, query: Interval) -> bool:
        return not self._overlapping(query, self.df).isEmpty()

    def add(self, interval: Interval) -> None:
        self.df = self.df.unionByName(IntervalSet.from_intervals([interval]).df, allowMissingColumns=True)

    def to_list(self) -> list[Interval]:
        with plain_errors():
            return [Interval(*row) for row in self.df.select("chrom", "start", "end").collect()]

    def merge(self, distance: int = 0) -> IntervalSet:
        return IntervalSet(ops.merge(self.df, distance))

    def intersect(self, other: IntervalSet, fraction: float | None = None, reciprocal: bool = False) -> IntervalSet:
        """Intervals that overlap ``other``, once each."""
        return IntervalSet(ops.intersect(self.df, other.df, unique=True, fraction=fraction, reciprocal=reciprocal))

    def non_overlapping(self, other: IntervalSet) -> IntervalSet:
        return IntervalSet(ops.intersect(self.df, other.df, no_overlap=True))

    def sort(self) -> None:
        self.df = ops.sort(self.df)

    def to_numpy(self):
        return bed.to_numpy(self.df)


def _frame(source, mode: str = "FAILFAST", zero_length: bool = False) -> DataFrame:
    if isinstance(source, IntervalSet):
        return source.df
    if isinstance(source, DataFrame):
        return source
    if source == "-":
        return bed.parse_bed(session(), sys.stdin.read(), mode=mode, bedtools_compatible=zero_length)
    with plain_errors():
        return bed.read_bed(session(), source, mode, zero_length)


def _genome(source) -> DataFrame:
    with plain_errors():
        return source if isinstance(source, DataFrame) else genome.read_genome(session(), source)


def _checked(*frames: DataFrame, strict_sorted: bool, genome_order: DataFrame | None = None) -> None:
    with plain_errors():
        for df in frames if strict_sorted else ():
            validate.validate_sorted(df, genome_order)


def _out(df: DataFrame, output: str | None, columns: list[str] | None = None, header: str | None = None) -> DataFrame | None:
    if output is None:
        return df
    with plain_errors():
        if output == "-":
            if header is not None:
                print(header)
            for row in bed.format_bed(df, columns=columns).toLocalIterator():
                print(row[0])
        else:
            bed.write_bed(df, output, columns=columns, single=True, header=header)
    return None


def _used(df: DataFrame) -> list[str]:
    """Columns of a file source that hold something: BED3 stays BED3."""
    order = ["name", "score", "strand", "thick_start", "thick_end", "item_rgb", "block_count"]
    have = [c for c in order if c in df.columns]
    if not have:
        return ["chrom", "start", "end"]
    with plain_errors():
        row = df.agg(*[F.count(c).alias(c) for c in have]).first()
    n = max((i + 1 for i, c in enumerate(have) if row[c]), default=0)
    return ["chrom", "start", "end", *have[:n]]


def counted(df: DataFrame, into: dict[str, Observation], name: str) -> DataFrame:
    """``df``, whose rows are counted as they are read; ``into[name].get['rows']`` waits for the count."""
    into[name] = Observation()
    return df.observe(into[name], F.count(F.lit(1)).alias("rows"))


def _slim(source, **kw) -> DataFrame:
    df = _frame(source, **kw)
    return df.select(_used(df)) if not isinstance(source, (DataFrame, IntervalSet)) else df


def read_bed(path, mode: str = "FAILFAST", bedtools_compatible: bool = False) -> IntervalSet:
    with plain_errors():
        return IntervalSet(bed.read_bed(session(), path, mode, bedtools_compatible))


def parse_bed(content: str) -> IntervalSet:
    with plain_errors():
        return IntervalSet(bed.parse_bed(session(), content))


def from_numpy(chrom: str, array) -> IntervalSet:
    return IntervalSet(bed.from_numpy(session(), chrom, array))


def intersect(a, b, output: str | None = None, write_a: bool = False, write_b: bool = False, fraction: float | None = None, reciprocal: bool = False, count: bool = False, unique: bool = False, no_overlap: bool = False, fraction_b: float | None = None, strand: str | None = None, strict_sorted: bool = False):
    a, b = _slim(a), _slim(b)
    _checked(a, b, strict_sorted=strict_sorted)
    df = ops.intersect(a, b, write_a=write_a, write_b=write_b, fraction=fraction, reciprocal=reciprocal, count=count, unique=unique, no_overlap=no_overlap, fraction_b=fraction_b, strand=strand)
    return _out(df, output, df.columns)


def merge(source, output: str | None = None, distance: int = 0, strand: bool = False, count: bool = False, strict_sorted: bool = False, **options):
    df = _slim(source)
    _checked(df, strict_sorted=strict_sorted)
    out = ops.merge(df, distance, count=count, strand=strand, **options)
    return _out(out, output, out.columns)


def subtract(a, b, output: str | None = None, remove_entire: bool = False, fraction: float | None = None, reciprocal: bool = False, strict_sorted: bool = False, strand: str | None = None):
    a, b = _slim(a), _slim(b)
    _checked(a, b, strict_sorted=strict_sorted)
    out = ops.subtract(a, b, remove_entire, fraction, reciprocal, strand)
    return _out(out, output, out.columns)


def coverage(a, b, output: str | None = None, histogram: bool = False, mean: bool = False, per_base: bool = False, include_all: bool = False, strict_sorted: bool = False, strand: str | None = None):
    """Per base goes before histogram, and that before mean; ``include_all`` adds the rows of all of A together."""
    a, b = _slim(a), _slim(b)
    _checked(a, b, strict_sorted=strict_sorted)
    mode = "per_base" if per_base else "hist" if histogram else "mean" if mean else "basic"
    out = ops.coverage(a, b, mode, strand)
    if mode == "hist" and include_all:
        out = out.unionByName(ops.coverage(a, b, "all", strand), allowMissingColumns=True)
    if output is None:
        return out
    size = F.col("end") - F.col("start")
    if mode == "basic":
        out = out.withColumn("fraction", single7("bases_covered", "length"))
    elif mode == "mean":
        out = out.withColumn("mean_depth", single7(F.round(F.col("mean_depth") * size), size))
    elif mode == "hist":
        out = out.withColumn("fraction", F.when(F.col("length") > 0, single7("bases", "length")).otherwise("1.0000000"))
    return _out(out, output, out.columns)


def closest(a, b, output: str | None = None, distance: bool = False, tie: str = "all", ignore_overlapping: bool = False, ignore_upstream: bool = False, ignore_downstream: bool = False, max_distance: int | None = None, strict_sorted: bool = False, strand: str | None = None):
    a, b = _slim(a), _slim(b)
    _checked(a, b, strict_sorted=strict_sorted)
    out = ops.closest(a, b, tie, ignore_overlapping, ignore_upstream, ignore_downstream, max_distance, strand)
    if output is None:
        return out
    return _out(out, output, [c for c in out.columns if c != "signed_distance" and (distance or c != "distance")])


def window(a, b, output: str | None = None, window: int = 1000, left: int | None = None, right: int | None = None, count: bool = False, no_overlap: bool = False, strict_sorted: bool = False, strand: str | None = None, write_a: bool = True, write_b: bool = True):
    a, b = _slim(a), _slim(b)
    _checked(a, b, strict_sorted=strict_sorted)
    out = ops.window(a, b, window, left, right, count, no_overlap, strand, write_a=write_a, write_b=write_b)
    return _out(out, output, out.columns)


def sort(source, output: str | None = None, genome: str | DataFrame | None = None, mode: str = "default", reverse: bool = False):
    """Lines of a file keep every field; malformed ones are left out."""
    order = _genome(genome) if genome is not None else None
    if isinstance(source, (DataFrame, IntervalSet)):
        return _out(ops.sort(_frame(source), mode, order, reverse), output)
    df = bed.read_bed(session(), source, "DROPMALFORMED", keep_line=True)
    out = ops.sort(df, mode, order, reverse)
    return out.drop("_line") if output is None else _out(out.select("_line"), output, ["_line"])


def slop(source, genome, output: str | None = None, both: float = 0, left: float | None = None, right: float | None = None, strand: bool = False, pct: bool = False):
    return _out(ops.slop(_slim(source), _genome(genome), both, left, right, strand, pct), output)


def complement(source, genome, output: str | None = None):
    order = _genome(genome)
    out = ops.complement(_frame(source), order)
    return out if output is None else _out(ops.sort(out, genome=order), output)


def genomecov(source, genome, output: str | None = None, bg: bool = False, bga: bool = False, per_base: bool = False, scale: float = 1.0, strand: str | None = None):
    """Per base goes before bga, and that before bg."""
    order = _genome(genome)
    mode = "per_base" if per_base else "bga" if bga else "bg" if bg else "hist"
    out = ops.genomecov(_frame(source), order, mode, scale, strand=strand)
    if output is None:
        return out
    keys = {"hist": ["depth"], "per_base": ["pos"]}.get(mode, ["start"])
    out = out.join(genome_order(order), "chrom", "left").orderBy(F.coalesce("ord", F.lit(2**31 - 1)), *keys).drop("ord")
    if mode == "hist":
        out = out.withColumn("fraction", general6("fraction"))
    return _out(out, output, out.columns)


def genome_order(order: DataFrame) -> DataFrame:
    return genome.small_genome(order).select("chrom", "ord")


def jaccard(a, b, output: str | None = None, strand: str | None = None):
    out = ops.jaccard(_frame(a), _frame(b), strand=strand)
    return out if output is None else _out(out.withColumn("jaccard", plain6("jaccard")), output, out.columns)


def multiinter(sources, output: str | None = None, cluster: bool = False, header: bool = False):
    if len(sources) < 2:
        raise ValueError("multiinter needs at least two sets")
    out = ops.multiinter([_frame(s) for s in sources], cluster)
    names = ["chrom", "start", "end", "num", "list", *[s if isinstance(s, str) else str(i + 1) for i, s in enumerate(sources)]]
    return _out(out, output, out.columns, "\t".join(names) if header else None)


def generate(output_a: str | None = None, output_b: str | None = None, size_a: int | str = "1M", size_b: int | str | None = None, mode: str = "balanced", seed: int = 42, **options):
    """Two sets, written to the paths that are told. ``mode`` 'all' gives a pair for each mode, in a folder of its name beside the path."""
    if mode == "all":
        within = lambda path, name: None if path is None else f"{os.path.dirname(path)}/{name}/{os.path.basename(path)}"
        made = {m: generate(within(output_a, m), within(output_b, m), size_a, size_b, m, seed, **options) for m in ops.generate_modes()}
        return made if output_a is None else None
    a, b = ops.generate(session(), size_a, size_b, mode, seed, **options)
    if output_a is None:
        return a, b
    with plain_errors():
        bed.write_bed(a, output_a, 3, single=True)
        if output_b is not None:
            bed.write_bed(b, output_b, 3, single=True)
    return None


__all__ = [
    "Interval", "IntervalSet", "closest", "complement", "coverage", "from_numpy", "generate", "genomecov", "intersect", "jaccard", "merge", "multiinter", "parse_bed",
    "read_bed", "slop", "sort", "subtract", "window",
]
