"""Binned range join: an equi-join on (chrom, level, bin) with the exact predicate as residual.

Every row goes to the bins that it touches at its own level, where bins are wide enough that it
touches ``SPAN`` at most; levels widen by that factor. Two rows meet at the level of the
longer one, so long intervals cost a few coarse bins rather than thousands of fine ones, and
short rows never meet each other in a coarse bin. A pair is kept only in its first shared bin, so no
``distinct`` follows. Bin keys are fine enough that a hot chromosome is many keys; what skew is
left is for AQE's skew join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = 64


@dataclass(frozen=True)
class Bins:
    """Width of the finest bins and the number of levels above it."""

    width: int
    levels: int = 0


def choose_bins(*sides: DataFrame, slop: int = 0) -> Bins:
    """Bins from one aggregation over the interval lengths of the sides."""
    size = F.greatest(F.col("end") - F.col("start"), F.lit(1).cast("long")) + slop
    lengths = None
    for side in sides:
        one = side.select(size.alias("n"))
        lengths = one if lengths is None else lengths.unionByName(one)
    mean, top = lengths.agg(F.avg("n"), F.max("n")).first()
    width = 1 << max(4, math.ceil(math.log2(2 * (mean or 8))))
    levels = 0
    while top and top > width * SPAN ** (levels + 1) // 2:
        levels += 1
    return Bins(width, levels)


def _binned(df: DataFrame, start: Column, end: Column, bins: Bins, left: bool) -> DataFrame:
    """``df`` by (_level, _tag, _bin). Tag 1: a left row at its own level with right rows up to it; tag 2: the other way round."""
    last = F.greatest(end - 1, start)
    span = F.greatest(last - start, F.lit(0).cast("long"))
    if bins.levels == 0:
        w = F.lit(bins.width).cast("long")
        return df.withColumn("_level", F.lit(0)).withColumn("_tag", F.lit(1)).withColumn("_bin", F.explode(F.sequence(F.floor(start / w), F.floor(last / w))))
    own = F.lit(0)
    for level in range(1, bins.levels + 1):
        own = F.when(span > bins.width * SPAN**level // 2, F.lit(level)).otherwise(own)
    places = []
    for level in range(bins.levels + 1):
        w = F.lit(bins.width * SPAN**level).cast("long")
        bin_range = F.sequence(F.floor(start / w), F.floor(last / w))
        at = lambda tag, level=level, bin_range=bin_range: F.transform(bin_range, lambda b: F.struct(F.lit(level).alias("l"), F.lit(tag).alias("t"), b.alias("b")))
        none = F.array().cast("array<struct<l:int,t:int,b:bigint>>")
        # pairs whose left row is the longer (or equal) meet under tag 1, the rest under tag 2
        if left:
            places.append(F.when(own == level, at(1)).when(own < level, at(2)).otherwise(none))
        else:
            places.append(F.when(own == level, F.concat(at(1), at(2))).when(own < level, at(1)).otherwise(none))
    x = F.explode(F.concat(*places))
    return df.withColumn("_x", x).withColumn("_level", F.col("_x.l")).withColumn("_tag", F.col("_x.t")).withColumn("_bin", F.col("_x.b")).drop("_x")


def _first_bin(start: Column, level: Column, bins: Bins) -> Column:
    scale = F.lit(bins.width).cast("long")
    for n in range(1, bins.levels + 1):
        scale = F.when(level == n, F.lit(bins.width * SPAN**n).cast("long")).otherwise(scale)
    return F.floor(start / scale)


def range_join(
    a: DataFrame,
    b: DataFrame,
    how: str = "inner",
    condition: Column | None = None,
    left_slop: int = 0,
    right_slop: int = 0,
    bins: Bins | None = None,
) -> DataFrame:
    """Pairs of overlapping rows of ``a`` and ``b``; the columns of ``b`` get the prefix ``b_``.

    ``how`` is inner, left (rows of ``a`` without a partner once, nulls for b) or left_semi (rows of ``a`` alone). A row of ``a`` reaches
    ``left_slop`` bases further left (not below 0) and ``right_slop`` further right.
    ``condition`` is a further condition on both sides' columns. With ``left`` a row has one such null row for
    every bin without a partner, and with ``left_semi`` it stands for every bin in which a partner begins, so aggregate by a row id (``by_row``).
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"how must be 'inner', 'left' or 'left_semi', not {how!r}")
    bins = bins or choose_bins(a, b, slop=left_slop + right_slop)
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    start = F.greatest(F.col("start") - left_slop, F.lit(0).cast("long")) if left_slop else F.col("start")
    end = F.col("end") + right_slop if right_slop else F.col("end")
    left = _binned(a.withColumn("_s", start).withColumn("_e", end), F.col("_s"), F.col("_e"), bins, True).withColumnsRenamed({"_level": "_al", "_tag": "_at", "_bin": "_ab"})
    right = _binned(right, F.col("b_start"), F.col("b_end"), bins, False)
    # the bins in which both sides begin, at the level where they meet, are worked out before the join: it looks at far more pairs than it keeps
    left = left.withColumn("_af", _first_bin(F.col("_s"), F.col("_al"), bins))
    right = right.withColumn("_bf", _first_bin(F.col("b_start"), F.col("_level"), bins))
    first = F.greatest("_af", "_bf") == F.col("_ab")
    on = (F.col("chrom") == F.col("b_chrom")) & (F.col("_ab") == F.col("_bin"))
    if bins.levels:
        on = on & (F.col("_al") == F.col("_level")) & (F.col("_at") == F.col("_tag"))
    on = on & (F.col("_s") < F.col("b_end")) & (F.col("b_start") < F.col("_e")) & first
    if condition is not None:
        on = on & condition
    joined = left.join(right, on, how)
    return joined.drop("_s", "_e", "_al", "_at", "_ab", "_af", "_level", "_tag", "_bin", "_bf")


def with_row_id(df: DataFrame, name: str = "_aid") -> DataFrame:
    """Rows stay distinct through joins, equal ones too."""
    return df.withColumn(name, F.monotonically_increasing_id())


def by_row(joined: DataFrame, columns: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates pairs to the rows of A that ``_aid`` tells apart; ``columns`` come along as keys, so sums and counts stay in hash aggregates."""
    grouped = joined.groupBy("_aid", *columns)
    return grouped.agg(*aggregates) if aggregates else grouped.agg(F.lit(1).alias("_one")).drop("_one")
