"""The first or the last overlapping row of B for each row of A, without making the pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sweep import running


def partner_key(b: DataFrame) -> Column:
    """A row of B as ``b_*``, in the order in which partners are ranked: start, end, other columns."""
    return F.struct(*[F.col(c).alias(f"b_{c}") for c in ("start", "end", *[c for c in b.columns if c not in ("start", "end")])])


def first_partner(a: DataFrame, b: DataFrame, by: Sequence[str], key: Column, tile: int | None) -> DataFrame:
    """``a`` with ``_b``, the smallest ``key`` of the rows of B that overlap it, or null.

    Of the rows that end after a row of A begins, that with the smallest start begins before it ends if any does.
    """
    a_rows = a.select(*by, F.col("start").alias("_p"), F.lit(1).alias("_k"), F.struct(*a.columns).alias("_row"))
    b_ends = b.where("chrom IS NOT NULL").select(*by, F.col("end").alias("_p"), F.lit(0).alias("_k"), key.alias("_v"))
    met = running(a_rows.unionByName(b_ends, allowMissingColumns=True), by, ["_p", "_k"], {"_b": ("min", F.col("_v"))}, tile, reverse=True).where("_row IS NOT NULL")
    return met.select("_row.*", F.when(F.col("_b.b_start") < F.col("_row.end"), F.col("_b")).alias("_b"))


def last_around(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """For each start ``_x`` of A ``_s``, the largest start of the rows of B that lie around it (start < _x < end).

    A row of B goes to the nodes of a binary tree over the positions that make up its inside, two of a level at most,
    which keep the largest start; a position looks up the nodes above it.
    """
    spans = b.where("chrom IS NOT NULL AND end - start > 1").groupBy(*by, "start").agg(F.max("end").alias("end"))
    top = b.agg(F.max(F.col("end") - F.col("start"))).first()[0]
    levels = f"sequence(0, {max(1, int(top or 1)).bit_length() - 1})"
    low, high = "shiftright(start + shiftleft(1L, j), j)", "shiftright(end, j)"
    taken = f"array(if({low} < {high} AND {low} & 1 = 1, struct(j AS j, {low} AS n), NULL), if({low} < {high} AND {high} & 1 = 1, struct(j AS j, {high} - 1 AS n), NULL))"
    nodes = spans.select(*by, "start", F.explode(F.expr(f"array_compact(flatten(transform({levels}, j -> {taken})))")).alias("_n"))
    nodes = nodes.select(*by, F.col("_n.j").alias("_j"), F.col("_n.n").alias("_node"), "start").groupBy(*by, "_j", "_node").agg(F.max("start").alias("_s"))
    places = a.select(*by, F.col("start").alias("_x")).distinct().withColumn("_j", F.explode(F.expr(levels))).withColumn("_node", F.expr("shiftright(_x, _j)"))
    return places.join(nodes, [*by, "_j", "_node"]).groupBy(*by, "_x").agg(F.max("_s").alias("_s"))
