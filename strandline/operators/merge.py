"""Merging of overlapping, touching and near rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.sweep import islands, resolve_tile

OPERATIONS = {
    "sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "median": F.median, "count": F.count, "count_distinct": F.countDistinct,
}
ORDERED = ("collapse", "distinct", "first", "last")


def _operation(name: str, column: str, delimiter: str) -> Column:
    if name in OPERATIONS:
        return OPERATIONS[name](column)
    if name not in ORDERED:
        raise ValueError(f"unknown operation {name!r}")
    rows = F.array_sort(F.collect_list(F.when(F.col(column).isNotNull(), F.struct("start", "end", F.col(column).alias("v")))))
    values = F.transform(rows, lambda r: r["v"].cast("string"))
    if name == "collapse":
        return F.array_join(values, delimiter)
    if name == "distinct":
        return F.array_join(F.array_distinct(values), delimiter)
    return F.try_element_at(values, F.lit(1 if name == "first" else -1))


def merge(
    df: DataFrame,
    distance: int = 0,
    count: bool = False,
    strand: bool = False,
    strand_mode: str = "group",
    operations: dict[str, str | list[str]] | None = None,
    delimiter: str = ",",
    records: bool = False,
    tile: int | str | None = "auto",
) -> DataFrame:
    """Hulls of rows that follow within ``distance`` (0 merges touching rows).

    ``strand`` merges each strand by itself and returns it; with ``strand_mode='adjacent'`` a row of the other
    strand in between ends a run. ``count`` adds the number of rows, ``operations`` maps columns to
    operations (column ``<column>_<operation>``), ``records`` adds names, scores and mean_score.
    """
    by = ["chrom"]
    if strand and strand_mode == "group":
        by = ["chrom", "strand"]
    elif strand_mode not in ("group", "adjacent"):
        raise ValueError(f"strand_mode must be 'group' or 'adjacent', not {strand_mode!r}")
    if strand and strand_mode == "adjacent":
        from pyspark.sql import Window

        w = Window.partitionBy("chrom").orderBy("start", "end", "strand")
        turns = df.withColumn("_turn", F.when(F.col("strand").eqNullSafe(F.lag("strand").over(w)), 0).otherwise(1))
        df = turns.withColumn("_turn", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        by = ["chrom", "strand", "_turn"]
    marked = islands(df, by, distance, resolve_tile(tile, df))
    aggregates = [F.min("start").alias("start"), F.max("end").alias("end")]
    if count:
        aggregates.append(F.count("*").alias("count"))
    for column, names in (operations or {}).items():
        for name in [names] if isinstance(names, str) else names:
            aggregates.append(_operation(name, column, delimiter).alias(f"{column}_{name}"))
    if records:
        rows = F.array_sort(F.collect_list(F.struct("start", "end", "name", "score")))
        aggregates += [F.filter(F.transform(rows, lambda r: r["name"]), lambda x: x.isNotNull()).alias("names"), F.filter(F.transform(rows, lambda r: r["score"]), lambda x: x.isNotNull()).alias("scores"), F.avg("score").alias("mean_score")]
        if not count:
            aggregates.insert(2, F.count("*").alias("count"))
    out = marked.groupBy(*by, "_island").agg(*aggregates)
    return out.select("chrom", "start", "end", *(["strand"] if strand else []), *[c for c in out.columns if c not in (*by, "_island", "start", "end")])
