"""Depth over a genome."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.sweep import depth_segments, each_base, resolve_tile
from ..sources.genome import small_genome

MODES = ("hist", "bg", "bga", "per_base")


def genomecov(df: DataFrame, genome: DataFrame, mode: str = "hist", scale: float = 1.0, tile: int | str | None = "auto", strand: str | None = None) -> DataFrame:
    """Depth of ``df`` over ``genome``; positions beyond a chromosome's end are cut off.

    hist: chrom, depth, bases, size, fraction for each chromosome and 'genome'; bg: runs of equal depth above 0;
    bga: with depth 0 too; per_base: pos (from 1) and depth. ``scale`` multiplies depths (cut to
    whole numbers) in all but hist. Chromosomes of size 0 are left out.
    ``strand`` counts only rows of that strand.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    if strand is not None:
        df = df.where(F.col("strand") == strand)
    genome = genome.where("size > 0")
    inside = df.select("chrom", "start", "end").join(small_genome(genome), "chrom").select("chrom", F.least("start", "size").alias("start"), F.least("end", "size").alias("end"))
    ends = genome.select("chrom", F.explode(F.array(F.lit(0).cast("long"), "size")).alias("pos"))
    runs = depth_segments(inside, ["chrom"], ends, resolve_tile(tile, df))
    if mode == "hist":
        each = runs.groupBy("chrom", "depth").agg(F.sum(F.col("end") - F.col("start")).alias("bases"))  # few rows from here on
        sized = each.join(small_genome(genome), "chrom").select("chrom", "depth", "bases", "size")
        whole = sized.groupBy("depth").agg(F.sum("bases").alias("bases")).select(F.lit("genome").alias("chrom"), "depth", "bases", F.sum("bases").over(Window.partitionBy(F.lit(0))).alias("size"))
        return sized.unionByName(whole).withColumn("fraction", F.col("bases") / F.col("size"))
    scaled = F.floor(F.col("depth") * F.lit(float(scale))).cast("long") if scale != 1.0 else F.col("depth")
    if mode == "per_base":
        return each_base(runs.select("chrom", "start", "end", scaled.alias("depth")), "start", "end", "pos").select("chrom", "pos", "depth")
    kept = runs if mode == "bga" else runs.where("depth > 0")
    return kept.select("chrom", "start", "end", scaled.alias("depth"))
