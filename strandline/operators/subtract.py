"""Removal of covered bases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.rangejoin import Bins, range_join, with_row_id
from ..plans.sweep import resolve_tile, running
from .intersect import intersect, pair_condition, segment


def _gaps(a: DataFrame, b: DataFrame, tile: int | None) -> DataFrame:
    """``chrom, start, end`` of what ``b`` leaves of each chromosome of ``a``, up to the last end of ``a``. An empty row of ``b`` in a gap cuts it."""
    reach = running(b.select("chrom", "start", "end"), ["chrom"], ["start", "end"], {"_reach": ("max", F.col("end"))}, tile, before=True)
    zero = F.lit(0).cast("long")
    between = reach.select("chrom", F.coalesce("_reach", zero).alias("s"), F.col("start").alias("e")).where("s < e")
    ends = a.groupBy("chrom").agg(F.max("end").alias("e")).join(b.groupBy("chrom").agg(F.max("end").alias("s")), "chrom", "left")  # a row for each chromosome
    return between.unionByName(ends.select("chrom", F.coalesce("s", zero).alias("s"), "e").where("s < e")).withColumnsRenamed({"s": "start", "e": "end"})


def subtract(a: DataFrame, b: DataFrame, remove_entire: bool = False, fraction: float | None = None, reciprocal: bool = False, strand: str | None = None, bins: Bins | None = None, tile: int | str | None = "auto") -> DataFrame:
    """What rows of ``b`` leave of each row of ``a``; only pairs that meet ``fraction`` subtract.

    An empty row of ``b`` strictly inside A splits it. ``remove_entire`` drops A on any such pair.
    """
    if remove_entire:
        return intersect(a, b, no_overlap=True, fraction=fraction, reciprocal=reciprocal, strand=strand, bins=bins)
    few = b.select("chrom", "start", "end", *(["strand"] if strand else []))
    if fraction is None and strand is None:
        # every pair subtracts, so A is cut to the gaps of B and no row of A gathers its partners
        left = range_join(a.where("start < end"), _gaps(a, few, resolve_tile(tile, b)), bins=bins).select(segment(a.columns))
        return left.unionByName(intersect(a.where("start >= end"), few, no_overlap=True, bins=bins))
    joined = range_join(with_row_id(a), few, "left", pair_condition(fraction, None, reciprocal, strand), bins=bins)
    s, e = F.greatest("start", "b_start"), F.least("end", "b_end")
    cut = joined.select("_aid", *a.columns, F.when(F.col("b_chrom").isNotNull(), s).alias("_cs"), F.when(F.col("b_chrom").isNotNull(), e).alias("_ce"))
    w = Window.partitionBy("_aid").orderBy(F.col("_cs").asc_nulls_first(), "_ce")
    before = F.max("_ce").over(w.rowsBetween(Window.unboundedPreceding, -1))
    to_end = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    swept = cut.select("*", F.coalesce(before, F.col("start")).alias("_from"), F.max("_ce").over(to_end).alias("_all"), F.row_number().over(w).alias("_n"), F.count("*").over(to_end).alias("_of"))
    piece = lambda x, y: F.struct(x.alias("s"), y.alias("e"))
    hit, last = F.col("_cs").isNotNull(), F.col("_n") == F.col("_of")
    gap = F.when(hit & (F.col("_from") < F.col("_cs")), piece(F.col("_from"), F.col("_cs")))
    tail = F.when(hit & last & (F.col("_all") < F.col("end")), piece(F.col("_all"), F.col("end")))
    whole = F.when(F.col("_all").isNull() & last, piece(F.col("start"), F.col("end")))
    cut_to = {"start": F.col("_p.s").alias("start"), "end": F.col("_p.e").alias("end")}
    return swept.select("*", F.explode(F.array_compact(F.array(gap, tail, whole))).alias("_p")).select(*[cut_to.get(c, F.col(c)) for c in a.columns])
