"""Similarity of two sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import check_strand, strand as known_strand
from .multiinter import joint_segments


def _on_strand(df: DataFrame, flip: bool) -> DataFrame:
    """Rows with the strand in the chromosome's name; a missing one is '.'."""
    own = F.coalesce(known_strand("strand"), F.lit("."))
    own = F.translate(own, "+-", "-+") if flip else own
    return df.select(F.concat("chrom", F.lit("\t"), own).alias("chrom"), "start", "end")


def jaccard(a: DataFrame, b: DataFrame, tile: int | str | None = "auto", strand: str | None = None) -> DataFrame:
    """One row: bases in both, bases in either, their ratio (0 if none), and the number of maximal runs in both.

    ``strand`` compares the strands one by one: ``same``, or each with the ``opposite`` one.
    """
    check_strand(strand)
    if strand is not None:
        a, b = _on_strand(a, False), _on_strand(b, strand == "opposite")
    runs = joint_segments([a, b], tile, coalesce=True)
    size = F.col("end") - F.col("start")
    both, any_ = (F.col("c1") > 0) & (F.col("c2") > 0), (F.col("c1") > 0) | (F.col("c2") > 0)
    total = lambda test: F.coalesce(F.sum(F.when(test, size)), F.lit(0)).cast("long")
    one = runs.agg(total(both).alias("intersection"), total(any_).alias("union"), F.coalesce(F.sum(F.when(both, 1)), F.lit(0)).cast("long").alias("n_intersections"))
    return one.select("intersection", "union", F.when(F.col("union") > 0, F.col("intersection") / F.col("union")).otherwise(0.0).alias("jaccard"), "n_intersections")
