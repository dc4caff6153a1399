"""Synthetic interval sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_size
from ..sources.genome import genome_frame

# Chromosome sizes of the human assembly GRCh38, 1 to 22 and X.
HG38 = [
    ("chr1", 248956422), ("chr2", 242193529), ("chr3", 198295559), ("chr4", 190214555), ("chr5", 181538259), ("chr6", 170805979), ("chr7", 159345973), ("chr8", 145138636),
    ("chr9", 138394717), ("chr10", 133797422), ("chr11", 135086622), ("chr12", 133275309), ("chr13", 114364328), ("chr14", 107043718), ("chr15", 101991189), ("chr16", 90338345),
    ("chr17", 83257441), ("chr18", 80373285), ("chr19", 58617616), ("chr20", 64444167), ("chr21", 46709983), ("chr22", 50818468), ("chrX", 156040895),
]
MODES = ("balanced", "skewed-a-gt-b", "skewed-b-gt-a", "identical", "clustered")


def intervals(spark: SparkSession, n: int, seed: int = 42, len_min: int = 50, len_max: int = 1000, genome: DataFrame | None = None, clustered: bool = False, hotspot_frac: float = 0.05, hotspot_weight: float = 0.8) -> DataFrame:
    """``n`` rows ``chrom, start, end``: chromosomes by size, lengths uniform in [len_min, len_max].

    ``clustered`` puts ``hotspot_weight`` of the rows into hotspots that cover ``hotspot_frac`` of each chromosome.
    """
    if not 0 < len_min <= len_max:
        raise ValueError("lengths must satisfy 0 < len_min <= len_max")
    sizes = [(r["chrom"], r["size"]) for r in genome.orderBy("ord").collect()] if genome is not None else HG38  # chromosome sizes only
    total, at = sum(n for _, n in sizes), 0
    point = F.col("_c") * F.lit(float(total))
    chrom = size = None
    for name, length in sizes:
        at += length
        here = point < at
        chrom = F.when(here, name) if chrom is None else chrom.when(here, name)
        size = F.when(here, F.lit(length)) if size is None else size.when(here, F.lit(length))
    rows = spark.range(n).select(F.rand(seed).alias("_c"), F.rand(seed + 7919).alias("_p"), F.rand(seed + 15838).alias("_l"), F.rand(seed + 23757).alias("_h"), F.rand(seed + 31676).alias("_w"))
    rows = rows.select(chrom.otherwise(sizes[-1][0]).alias("chrom"), size.otherwise(F.lit(sizes[-1][1])).cast("long").alias("_size"), "_p", "_l", "_h", "_w")
    length = F.least(F.lit(len_min) + F.floor(F.col("_l") * (len_max - len_min + 1)), F.col("_size"))
    room = F.col("_size") - F.col("_len")
    start = F.floor(F.col("_p") * (room + 1))
    if clustered:
        spots = 100
        width = F.col("_size") * F.lit(hotspot_frac / spots)
        spot = (F.floor(F.col("_h") * spots) + 0.5) * F.col("_size") / spots + F.col("_p") * width
        start = F.when(F.col("_w") < hotspot_weight, F.least(F.floor(spot), room)).otherwise(start)
    return rows.withColumn("_len", length).select("chrom", start.cast("long").alias("start"), (start + F.col("_len")).cast("long").alias("end"))


def generate(spark: SparkSession, size_a: int | str = "1M", size_b: int | str | None = None, mode: str = "balanced", seed: int = 42, sorted: bool | str = "auto", **options) -> tuple[DataFrame, DataFrame]:
    """Two sets: A from ``seed``, B from ``seed + 1`` (identical: B is A).

    skewed-a-gt-b gives B a tenth of A's rows if ``size_b`` isn't told, skewed-b-gt-a ten times as many.
    ``sorted`` 'auto' sorts sets of a million rows or more.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    a = parse_size(size_a) if isinstance(size_a, str) else size_a
    b = a if size_b is None else parse_size(size_b) if isinstance(size_b, str) else size_b
    if size_b is None and mode.startswith("skewed"):
        b = max(1, a // 10) if mode == "skewed-a-gt-b" else a * 10
    options.setdefault("clustered", mode == "clustered")

    def one(n, seed):
        df = intervals(spark, n, seed, **options)
        return df.orderBy("chrom", "start", "end") if sorted is True or sorted == "yes" or (sorted == "auto" and n >= 1_000_000) else df

    first = one(a, seed)
    return first, first if mode == "identical" else one(b, seed + 1)


def generate_modes() -> tuple[str, ...]:
    return MODES


__all__ = ["HG38", "MODES", "generate", "generate_modes", "genome_frame", "intervals"]
