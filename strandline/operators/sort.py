"""Orders of interval rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import length, natural_key
from ..sources.genome import small_genome

MODES = ("default", "size_asc", "size_desc", "chrom", "natural")


def sort_keys(mode: str = "default") -> list[Column]:
    """Keys that all ascend, but for the input order of ties."""
    size = length("start", "end")
    keys = {
        "default": ["chrom", "start", "end"], "size_asc": [size, "chrom", "start"], "size_desc": [-size, "chrom", "start"],
        "chrom": ["chrom"], "natural": [*natural_key("chrom"), "start", "end"],
    }
    if mode not in keys:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    return [F.col(k) if isinstance(k, str) else k for k in keys[mode]]


def sort(df: DataFrame, mode: str = "default", genome: DataFrame | None = None, reverse: bool = False, position: str | None = None) -> DataFrame:
    """``df`` in order (a range-partitioned sort).

    default: chrom, start, end; size_asc and size_desc: length, chrom, start; chrom: chromosome only; natural: chr2 before
    chr10. With ``genome`` chromosomes come in its order, unknown ones last by name. Ties keep
    input order, told by column ``position`` (default: the order in which rows are read). ``reverse`` is the exact opposite.
    """
    keyed = df if position else df.withColumn("_pos", F.monotonically_increasing_id())
    keys = sort_keys(mode)
    drop = [] if position else ["_pos"]
    if genome is not None:
        keyed = keyed.join(small_genome(genome).select("chrom", "ord"), "chrom", "left")
        keys = [F.coalesce("ord", F.lit(2**31 - 1)), *keys]
        drop.append("ord")
    keys.append(F.col(position or "_pos"))
    return keyed.orderBy(*[k.desc() if reverse else k.asc() for k in keys]).drop(*drop).select(df.columns)
