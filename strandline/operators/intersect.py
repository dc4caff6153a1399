"""Overlap join in its output modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import covers_fraction, length, overlap_length, strand_group, strand_groups, strand_matches
from ..plans.partners import first_partner, partner_key
from ..plans.rangejoin import Bins, by_row, range_join, with_row_id
from ..plans.sweep import resolve_tile



def pair_condition(fraction: float | None = None, fraction_b: float | None = None, reciprocal: bool = False, strand: str | None = None) -> Column | None:
    """What a pair must meet besides overlapping. ``reciprocal`` asks ``fraction`` of both sides and nothing without it."""
    shared, tests = overlap_length("start", "end", "b_start", "b_end"), []
    if fraction is not None:
        tests.append(covers_fraction(shared, length("start", "end"), fraction))
    if reciprocal and fraction is not None and fraction_b is None:
        fraction_b = fraction
    if fraction_b is not None:
        tests.append(covers_fraction(shared, length("b_start", "b_end"), fraction_b))
    if strand is not None:
        tests.append(strand_matches(F.col("strand"), F.col("b_strand"), strand))
    out = None
    for t in tests:
        out = t if out is None else out & t
    return out


def segment(columns: list[str]) -> list[Column]:
    """A's columns with start and end cut to the overlap."""
    cut = {"start": F.greatest("start", "b_start"), "end": F.least("end", "b_end")}
    return [cut[c].alias(c) if c in cut else F.col(c) for c in columns]


def intersect(
    a: DataFrame,
    b: DataFrame,
    write_a: bool = False,
    write_b: bool = False,
    unique: bool = False,
    no_overlap: bool = False,
    count: bool = False,
    fraction: float | None = None,
    fraction_b: float | None = None,
    reciprocal: bool = False,
    strand: str | None = None,
    report_once: bool = False,
    bins: Bins | None = None,
    tile: int | str | None = "auto",
) -> DataFrame:
    """Overlaps of ``a`` with ``b``.

    Of several modes the first of no_overlap (A without a partner), count (A with ``count``), unique (A with a
    partner, once), write_a with write_b (A and ``b_*``), write_a (A for each partner), write_b
    (overlap segment and ``b_*``) holds; without any, the overlap segment with A's other columns.
    ``report_once`` keeps one pair of each row of A, that of the smallest (b_start, b_end).
    """
    columns = a.columns
    test = pair_condition(fraction, fraction_b, reciprocal, strand)
    keyed = with_row_id(a)
    if no_overlap or count:
        few = b.select("chrom", "start", "end", *(["strand"] if strand else []))
        rows = by_row(range_join(keyed, few, "left", test, bins=bins), columns, F.count("b_chrom").alias("count"))
        return rows.where("count = 0").select(columns) if no_overlap else rows.select(*columns, "count")
    if unique:
        few = b.select("chrom", "start", "end", *(["strand"] if strand else []))
        return by_row(range_join(keyed, few, "left_semi", test, bins=bins), columns).select(columns)
    others = [f"b_{c}" for c in b.columns]
    if report_once and fraction is None and fraction_b is None:
        # one partner for each row, from a sweep
        by = ["chrom"] if strand is None else ["chrom", "_g"]
        rows = a if strand is None else a.withColumn("_g", strand_group("strand"))
        seen = b if strand is None else b.withColumn("_g", F.explode(strand_groups("strand", strand)))
        pairs = first_partner(rows, seen, by, partner_key(b), resolve_tile(tile, a, b)).where("_b IS NOT NULL").select(*columns, "_b.*")
    else:
        pairs = range_join(keyed, b, "inner", test, bins=bins)
        if report_once:  # a fraction is of a pair
            pairs = by_row(pairs, columns, F.min(F.struct("b_start", "b_end", *[c for c in others if c not in ("b_start", "b_end")])).alias("_b")).select(*columns, "_b.*")
    if write_a and write_b:
        return pairs.select(*columns, *others)
    if write_a:
        return pairs.select(columns)
    return pairs.select(*segment(columns), *(others if write_b else []))
