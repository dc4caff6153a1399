"""Tab-separated interval text: BED3 to BED12 and wider, rows of mixed width."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.algebra import strand
from ..functions.text import number

MODES = ("FAILFAST", "DROPMALFORMED")
BED12_SCHEMA = (
    "chrom string, start bigint, end bigint, name string, score double, strand string, thick_start bigint, thick_end bigint, item_rgb string, "
    "block_count int, block_sizes array<bigint>, block_starts array<bigint>, extra array<string>"
)


def _numbers(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("bigint")), lambda x: x.isNotNull())


def parse_lines(lines: DataFrame, mode: str = "FAILFAST", bedtools_compatible: bool = False, keep_line: bool = False) -> DataFrame:
    """Rows of BED12_SCHEMA from a column ``value`` of lines.

    Blank lines and lines that begin with #, track or browser are left out. Lines of fewer than three
    fields, with bounds that are no whole numbers >= 0, or with start > end fail (FAILFAST) or go (DROPMALFORMED).
    ``bedtools_compatible`` makes empty rows one base long. ``keep_line`` adds the whole line as ``_line``.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    f = F.split("value", "\t")
    field = lambda i: F.get(f, F.lit(i))
    rows = lines.where("trim(value) <> '' AND NOT value RLIKE '^(#|track|browser)'")
    start, end = field(1).try_cast("bigint"), field(2).try_cast("bigint")
    good = (F.size(f) >= 3) & start.isNotNull() & end.isNotNull() & (start >= 0) & (end >= 0) & (start <= end)
    good = F.coalesce(good, F.lit(False))
    if mode == "DROPMALFORMED":
        rows = rows.where(good)
    else:
        why = F.when(F.size(f) < 3, "expected at least 3 fields").when(start.isNull() | (start < 0), "invalid start").when(end.isNull() | (end < 0), "invalid end").otherwise("start > end")
        rows = rows.withColumn("value", F.when(good, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("Malformed line ("), why, F.lit("): "), F.col("value")))))
    if bedtools_compatible:
        end = F.when(start == end, start + 1).otherwise(end)
    return rows.select(
        field(0).alias("chrom"), start.alias("start"), end.alias("end"), field(3).alias("name"), field(4).try_cast("double").alias("score"), strand(field(5)).alias("strand"),
        field(6).try_cast("bigint").alias("thick_start"), field(7).try_cast("bigint").alias("thick_end"), field(8).alias("item_rgb"), field(9).try_cast("int").alias("block_count"),
        _numbers(field(10)).alias("block_sizes"), _numbers(field(11)).alias("block_starts"), F.when(F.size(f) > 12, F.slice(f, 13, F.greatest(F.size(f) - 12, F.lit(0)))).alias("extra"),
        *([F.col("value").alias("_line")] if keep_line else []),
    )


def read_bed(spark: SparkSession, path: str | list[str], mode: str = "FAILFAST", bedtools_compatible: bool = False, keep_line: bool = False) -> DataFrame:
    """Rows of interval files (plain or compressed). Columns that aren't used are not parsed."""
    return parse_lines(spark.read.text(path), mode, bedtools_compatible, keep_line)


def parse_bed(spark: SparkSession, content: str, **options) -> DataFrame:
    """Rows of interval text."""
    return parse_lines(spark.createDataFrame([(x,) for x in content.splitlines()], "value string"), **options)


def from_numpy(spark: SparkSession, chrom: str, array) -> DataFrame:
    """``chrom, start, end`` from an (n, 2) array of whole numbers."""
    import pandas as pd

    if getattr(array, "ndim", 0) != 2 or array.shape[1] != 2:
        raise ValueError("the array must have shape (n, 2)")
    frame = pd.DataFrame({"start": array[:, 0].astype("int64"), "end": array[:, 1].astype("int64")})
    return spark.createDataFrame(frame, "start bigint, end bigint").select(F.lit(chrom).alias("chrom"), "start", "end")


def to_numpy(df: DataFrame):
    """(n, 2) array of start and end."""
    return df.select("start", "end").toPandas().to_numpy(dtype="int64").reshape(-1, 2)


def _score_text(score: Column, as_int: bool) -> Column:
    return F.format_string("%d", score.cast("bigint")) if as_int else number(score)


def _cell(df: DataFrame, name: str) -> Column:
    text = number(name) if df.schema[name].dataType.simpleString() in ("double", "float") else F.col(name).cast("string")
    return F.coalesce(text, F.lit("."))


def format_bed(df: DataFrame, width: int = 6, score_as_int: bool = False, columns: list[str] | None = None) -> DataFrame:
    """One column ``value`` of lines: chrom, start, end, and as far as there are any name, score and strand.

    A field is printed only if those before it are. ``columns`` prints those columns instead; nulls are '.'.
    """
    if columns is not None:
        return df.select(F.concat_ws("\t", *[_cell(df, c) for c in columns]).alias("value"))
    has = set(df.columns)
    get = lambda c, kind: F.col(c) if c in has else F.lit(None).cast(kind)
    name, score, sign = get("name", "string"), get("score", "double"), get("strand", "string")
    fields = [F.col("chrom"), F.col("start").cast("string"), F.col("end").cast("string")]
    if width >= 4:
        fields.append(name)
    if width >= 5:
        fields.append(F.when(name.isNotNull(), _score_text(score, score_as_int)))
    if width >= 6:
        fields.append(F.when(name.isNotNull() & score.isNotNull(), sign))
    return df.select(F.concat_ws("\t", *fields).alias("value"))


def write_bed(df: DataFrame, path: str, width: int = 6, score_as_int: bool = False, columns: list[str] | None = None, mode: str = "errorifexists", single: bool = False, header: str | None = None) -> None:
    """Writes a folder of text files in the order of ``df``. ``single`` then joins them to one file, below an optional ``header`` line."""
    lines = format_bed(df, width, score_as_int, columns)
    if not single:
        lines.write.mode(mode).text(path)
        return
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    try:
        lines.write.text(parts)
        _join(df.sparkSession, parts, path, header)
    finally:
        _system(df.sparkSession, parts)[0].delete(_system(df.sparkSession, parts)[1], True)


def _system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _join(spark: SparkSession, parts: str, path: str, header: str | None) -> None:
    """Streams part files into one, in the order of their names."""
    (system, folder), (target, where) = _system(spark, parts), _system(spark, path)
    copy = spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes
    names = sorted((s.getPath().toString() for s in system.listStatus(folder) if s.getPath().getName().startswith("part-")))
    out = target.create(where, True)
    try:
        if header is not None:
            out.write(bytearray((header + "\n").encode()))
        for name in names:
            source = system.open(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name))
            try:
                copy(source, out, 1 << 20, False)
            finally:
                source.close()
    finally:
        out.close()
