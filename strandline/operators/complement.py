"""Gaps of a set in a genome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.sweep import resolve_tile, running
from ..sources.genome import small_genome


def complement(df: DataFrame, genome: DataFrame, tile: int | str | None = "auto") -> DataFrame:
    """``chrom, start, end`` of what ``df`` leaves of each chromosome of ``genome``.

    Chromosomes without rows are whole gaps, those not in the genome are left out.
    """
    sizes = small_genome(genome)
    clipped = df.select("chrom", "start", "end").join(sizes, "chrom").select("chrom", F.least("start", "size").alias("start"), F.least("end", "size").alias("end"))
    ends = genome.select("chrom", F.col("size").alias("start"), F.col("size").alias("end"))
    reach = running(clipped.unionByName(ends), ["chrom"], ["start", "end"], {"_reach": ("max", F.col("end"))}, resolve_tile(tile, df), before=True)
    before = F.coalesce("_reach", F.lit(0).cast("long"))
    return reach.where(before < F.col("start")).select("chrom", before.alias("start"), F.col("start").alias("end"))
