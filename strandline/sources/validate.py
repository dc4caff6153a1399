"""Checks of input order. No operator needs sorted input; these are for callers that do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .genome import small_genome


def order_faults(df: DataFrame, genome: DataFrame | None = None, position: str | None = None) -> DataFrame:
    """Rows that break the order: ``_pos, chrom, start, reason``.

    In order: chromosomes stand together (with ``genome``: in its order, and known to it) and starts
    don't fall. ``position`` is a column of input order (default: the order in which rows are read).
    Neighbours are compared by chromosome, so no window spans all rows. Rows of one ``position`` count as in order:
    by start, and the chromosomes that begin at one position in the genome's order, then by where they end and by name.
    """
    keyed = df.select("chrom", "start", (F.col(position) if position else F.monotonically_increasing_id()).alias("_pos"))
    w = Window.partitionBy("chrom").orderBy("_pos", "start")
    rows = keyed.withColumn("_before", F.lag("start").over(w))
    falls = rows.where("start < _before").select("_pos", "chrom", "start", F.lit("start position decreases").alias("reason"))
    spans = keyed.groupBy("chrom").agg(F.min("_pos").alias("lo"), F.max("_pos").alias("hi"), F.min(F.struct("_pos", "start"))["start"].alias("start"))  # a row for each chromosome
    order = ["lo", "hi", "chrom"]
    if genome is not None:
        spans = spans.join(small_genome(genome).select("chrom", "ord"), "chrom", "left")
        order.insert(1, F.col("ord").asc_nulls_last())
    along = Window.partitionBy(F.lit(0)).orderBy(*order)
    ended = F.max("hi").over(along.rowsBetween(Window.unboundedPreceding, -1))
    apart = spans.withColumn("_hi", ended).where("lo < _hi").select(F.col("lo").alias("_pos"), "chrom", "start", F.lit("chromosomes are not contiguous").alias("reason"))
    out = falls.unionByName(apart)
    if genome is not None:
        unknown = spans.where("ord IS NULL").select(F.col("lo").alias("_pos"), "chrom", "start", F.lit("chromosome is not in the genome").alias("reason"))
        wrong = spans.where("ord IS NOT NULL").withColumn("_o", F.lag("ord").over(along)).where("ord < _o").select(F.col("lo").alias("_pos"), "chrom", "start", F.lit("chromosomes are not in genome order").alias("reason"))
        out = out.unionByName(unknown).unionByName(wrong)
    return out


def validate_sorted(df: DataFrame, genome: DataFrame | None = None, position: str | None = None) -> None:
    """Raises ValueError with the first row that breaks the order."""
    first = order_faults(df, genome, position).orderBy("_pos").first()
    if first is not None:
        raise ValueError(f"Input is not sorted at {first['chrom']}:{first['start']}: {first['reason']}. Sort it first, or pass assume_sorted=True.")
