"""Common segments of several sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.sweep import following, resolve_tile, running


def joint_segments(sets: Sequence[DataFrame], tile: int | str | None = "auto", coalesce: bool = False) -> DataFrame:
    """``chrom, start, end, c1 .. cN``: rows of each set over each segment between positions where a row begins or ends.

    ``coalesce`` joins neighbours in which each set is present or absent alike (counts are then 0 or 1).
    """
    n, tile = len(sets), resolve_tile(tile, *sets)
    parts = None
    for i, df in enumerate(sets):
        one = df.where("start < end").select("chrom", F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).cast("long").alias("delta")), F.struct(F.col("end").alias("pos"), F.lit(-1).cast("long").alias("delta")))).alias("x")).select("chrom", "x.pos", F.lit(i).alias("set"), "x.delta")
        parts = one if parts is None else parts.unionByName(one)
    deltas = parts.groupBy("chrom", "pos").agg(*[F.sum(F.when(F.col("set") == i, F.col("delta")).otherwise(0)).cast("long").alias(f"d{i + 1}") for i in range(n)])
    counts = running(deltas, ["chrom"], ["pos"], {f"c{i + 1}": ("sum", F.col(f"d{i + 1}")) for i in range(n)}, tile)
    names = [f"c{i + 1}" for i in range(n)]
    if coalesce:
        before = {f"c{i + 1}": F.col(f"c{i + 1}") - F.col(f"d{i + 1}") for i in range(n)}
        changed = None
        for c in names:
            here = (F.col(c) > 0) != (before[c] > 0)
            changed = here if changed is None else changed | here
        counts = counts.where(changed).withColumns({c: F.least(F.col(c), F.lit(1).cast("long")) for c in names})
    return following(counts, ["chrom"], "pos", "_next", tile).where("_next IS NOT NULL").select("chrom", F.col("pos").alias("start"), F.col("_next").alias("end"), *names)


def multiinter(sets: Sequence[DataFrame], cluster: bool = False, tile: int | str | None = "auto") -> DataFrame:
    """``chrom, start, end, n, list, set1 .. setN``: segments that one set at least (``cluster``: every set) covers.

    Segments are cut wherever a row begins or ends; ``list`` has the numbers of the sets from 1, setI is 0 or 1.
    """
    if not sets:
        raise ValueError("multiinter needs a set")
    runs = joint_segments(sets, tile)
    flags = [F.when(F.col(f"c{i + 1}") > 0, 1).otherwise(0) for i in range(len(sets))]
    total = sum(flags[1:], flags[0])
    listed = F.concat_ws(",", *[F.when(F.col(f"c{i + 1}") > 0, F.lit(str(i + 1))) for i in range(len(sets))])
    out = runs.select("chrom", "start", "end", total.alias("n"), listed.alias("list"), *[f.alias(f"set{i + 1}") for i, f in enumerate(flags)])
    return out.where(F.col("n") == len(sets)) if cluster else out.where("n > 0")
