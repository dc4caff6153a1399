"""Genomes: chromosome sizes in file order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GENOME_SCHEMA = "chrom string, size bigint, ord int"
MOST_BROADCAST = 5_000_000


def read_genome(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, size, ord`` of a tab-separated file; a chromosome named twice keeps its first place and its last size."""
    lines = spark.read.text(path).withColumn("_pos", F.monotonically_increasing_id())
    parts = F.split("value", "\t")
    bad = F.raise_error(F.concat(F.lit("Invalid genome line: "), F.col("value")))
    rows = lines.where("trim(value) <> '' AND NOT value LIKE '#%'").select(
        F.when(F.size(parts) < 2, bad).otherwise(F.trim(parts[0])).alias("chrom"), F.coalesce(F.trim(F.get(parts, F.lit(1))).try_cast("bigint"), bad.cast("bigint")).alias("size"), "_pos"
    )
    one = rows.groupBy("chrom").agg(F.max_by("size", "_pos").alias("size"), F.min("_pos").alias("_pos"))
    return one.select("chrom", "size", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_pos")) - 1).alias("ord"))


def genome_frame(spark: SparkSession, sizes: Iterable[tuple[str, int]]) -> DataFrame:
    """The same from (chrom, size) pairs."""
    kept: dict[str, int] = {}
    for chrom, size in sizes:
        kept[chrom] = int(size)
    return spark.createDataFrame([(c, n, i) for i, (c, n) in enumerate(kept.items())], GENOME_SCHEMA)


def small_genome(genome: DataFrame) -> DataFrame:
    """``genome`` with a broadcast hint if its plan says that it is small; else the planner decides."""
    size = genome._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(genome) if int(str(size)) <= MOST_BROADCAST else genome


def chrom_size(genome: DataFrame, chrom: str) -> int | None:
    row = genome.where(F.col("chrom") == chrom).select("size").first()
    return None if row is None else row[0]


def has_chrom(genome: DataFrame, chrom: str) -> bool:
    return chrom_size(genome, chrom) is not None


def chromosomes(genome: DataFrame) -> list[str]:
    """Names in order."""
    return [r[0] for r in genome.orderBy("ord").select("chrom").collect()]  # a row for each chromosome


def insert(genome: DataFrame, chrom: str, size: int) -> DataFrame:
    """``genome`` with the chromosome last, or with another size where it stands if it has it."""
    held = genome.select("chrom", F.when(F.col("chrom") == chrom, F.lit(size).cast("long")).otherwise(F.col("size")).alias("size"), "ord")
    own = genome.agg(F.max(F.col("chrom") == chrom).alias("has"), F.coalesce(F.max("ord") + 1, F.lit(0)).alias("ord")).where("NOT coalesce(has, false)")
    return held.unionByName(own.select(F.lit(chrom).alias("chrom"), F.lit(size).cast("long").alias("size"), "ord"))
