"""Interval algebra as Column expressions. Intervals are 0-based and half-open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def length(start: Column | str, end: Column | str) -> Column:
    return F.greatest(col(end) - col(start), F.lit(0).cast("long"))


def overlaps(a_start: Column | str, a_end: Column | str, b_start: Column | str, b_end: Column | str) -> Column:
    """The literal predicate, so an empty interval overlaps what it lies strictly inside."""
    return (col(a_start) < col(b_end)) & (col(b_start) < col(a_end))


def overlap_length(a_start: Column | str, a_end: Column | str, b_start: Column | str, b_end: Column | str) -> Column:
    return F.greatest(F.least(col(a_end), col(b_end)) - F.greatest(col(a_start), col(b_start)), F.lit(0).cast("long"))


def covers_fraction(shared: Column, size: Column, least: float) -> Column:
    """``shared / size >= least``; never for an empty interval."""
    return (size > 0) & (shared.cast("double") / size >= F.lit(float(least)))


def distance(a_chrom, a_start, a_end, b_chrom, b_start, b_end) -> Column:
    """Null on different chromosomes, 0 if overlapping, else the bases between."""
    a_chrom, a_start, a_end, b_chrom, b_start, b_end = map(col, (a_chrom, a_start, a_end, b_chrom, b_start, b_end))
    gap = F.when(overlaps(a_start, a_end, b_start, b_end), F.lit(0).cast("long")).when(b_end <= a_start, a_start - b_end).otherwise(b_start - a_end)
    return F.when(a_chrom == b_chrom, gap)


def closest_distance(a_start, a_end, b_start, b_end) -> Column:
    """0 if overlapping, else the gap plus one: negative upstream (B before A), positive downstream."""
    a_start, a_end, b_start, b_end = map(col, (a_start, a_end, b_start, b_end))
    return F.when(overlaps(a_start, a_end, b_start, b_end), F.lit(0).cast("long")).when(b_end <= a_start, -(a_start - b_end + 1)).otherwise(b_start - a_end + 1)


def strand(x: Column | str) -> Column:
    """+ and - stay, anything else is '.', null stays null."""
    x = col(x)
    return F.when(x.isNull(), x).when(x.isin("+", "-"), x).otherwise(F.lit("."))


def strand_matches(a: Column, b: Column, which: str) -> Column:
    """``same`` or ``opposite``; a missing strand passes, and what is neither + nor - counts as '.'."""
    check_strand(which)
    a, b = strand(a), strand(b)
    return a.isNull() | b.isNull() | ((a == b) if which == "same" else (a != b))


def check_strand(which: str | None) -> None:
    if which not in ("same", "opposite", None):
        raise ValueError(f"strand must be 'same' or 'opposite', not {which!r}")


STRANDS = ("+", "-", ".")
ANY_STRAND = "*"


def strand_group(x: Column | str) -> Column:
    """The group a row of A belongs to: its strand, or the one that sees every row of B."""
    return F.coalesce(strand(x), F.lit(ANY_STRAND))


def strand_groups(x: Column | str, which: str) -> Column:
    """The groups of A that see a row of B: an array for ``explode``."""
    check_strand(which)
    own, every = strand(x), [F.lit(s) for s in (*STRANDS, ANY_STRAND)]
    seen = F.array(own, F.lit(ANY_STRAND)) if which == "same" else F.filter(F.array(*every), lambda s: s != own)
    return F.when(own.isNull(), F.array(*every)).otherwise(seen)


def strand_bit(x: Column | str) -> Column:
    """A row of B as the bit of its strand; 8 without one."""
    own = strand(x)
    bit = F.lit(8)
    for i, s in enumerate(STRANDS):
        bit = F.when(own == s, F.lit(1 << i)).otherwise(bit)
    return bit


def strand_bits(x: Column | str, which: str) -> Column:
    """The bits of B that a row of A matches, so ``strand_matches`` of a pair is one bitwise AND."""
    check_strand(which)
    own = strand(x)
    bits = F.lit(15)
    for i, s in enumerate(STRANDS):
        bits = F.when(own == s, F.lit(8 | (1 << i if which == "same" else 7 & ~(1 << i)))).otherwise(bits)
    return bits


def natural_key(chrom: Column | str) -> list[Column]:
    """Sort keys under which chr2 comes before chr10: text before the number, number (none: last), rest, all."""
    c = col(chrom)
    digits = F.regexp_extract(c, r"^\D*(\d{1,18})", 1)
    number = F.when(digits != "", digits.cast("long")).otherwise(F.lit(2**63 - 1))
    return [F.regexp_extract(c, r"^(\D*)", 1), number, F.regexp_extract(c, r"^\D*\d{1,18}(.*)$", 1), c]
