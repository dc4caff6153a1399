"""Pairs within a distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import strand_matches
from ..plans.rangejoin import Bins, by_row, range_join, with_row_id


def window(a: DataFrame, b: DataFrame, window: int = 1000, left: int | None = None, right: int | None = None, count: bool = False, no_overlap: bool = False, strand: str | None = None, bins: Bins | None = None, write_a: bool = True, write_b: bool = True) -> DataFrame:
    """Rows of ``b`` that overlap [max(start - left, 0), end + right) of a row of ``a``: A and ``b_*``.

    ``write_a`` and ``write_b`` choose the side to return (neither: ``b_*``). ``count`` gives A with ``count`` instead and goes before ``no_overlap``, A without a partner.
    """
    slop = {"left_slop": window if left is None else left, "right_slop": window if right is None else right}
    test = strand_matches(F.col("strand"), F.col("b_strand"), strand) if strand else None
    keyed = with_row_id(a)
    if count or no_overlap:
        few = b.select("chrom", "start", "end", *(["strand"] if strand else []))
        rows = by_row(range_join(keyed, few, "left", test, bins=bins, **slop), a.columns, F.count("b_chrom").alias("count"))
        return rows.select(*a.columns, "count") if count else rows.where("count = 0").select(a.columns)
    return range_join(keyed, b, "inner", test, bins=bins, **slop).select(*(a.columns if write_a else []), *([f"b_{c}" for c in b.columns] if write_b or not write_a else []))
