"""Extension of rows within a genome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import length
from ..sources.genome import small_genome


def slop(df: DataFrame, genome: DataFrame, both: float = 0, left: float | None = None, right: float | None = None, strand: bool = False, pct: bool = False) -> DataFrame:
    """Rows extended by ``both`` (``left`` and ``right`` go before it) bases, or with ``pct`` by that share of their length.

    ``strand`` swaps the sides of rows on '-'. Rows off the genome and rows left empty are dropped.
    """

    def amount(x: float):
        n = F.round(length("start", "end") * F.lit(float(x))) if pct else F.lit(int(x))
        return F.greatest(n.cast("long"), F.lit(0).cast("long"))

    l, r = amount(both if left is None else left), amount(both if right is None else right)  # noqa: E741
    if strand:
        minus = F.col("strand") == "-"
        l, r = F.when(minus, r).otherwise(l), F.when(minus, l).otherwise(r)  # noqa: E741
    met = df.join(small_genome(genome), "chrom")
    moved = met.withColumns({"start": F.greatest(F.col("start") - l, F.lit(0).cast("long")), "end": F.least(F.col("end") + r, F.col("size"))})
    return moved.where("start < end").select(df.columns)
