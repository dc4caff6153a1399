"""Sweeps: running sums and maxima along a chromosome, by tile where there are many rows.

A window over a whole chromosome is one task for each chromosome. With ``tile`` set (operators set it by
themselves where the plan's size estimate is large), rows fall into tiles of positions; what each tile adds to a running value is summed up in a small table
(a row for each tile), accumulated there, and handed to the tile's rows as its start. Windows are
then over (chromosome, tile), so a genome of any size has as many tasks as tiles.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE_ROWS = 2_000_000
AUTO_BYTES = 1 << 30


def choose_tile(df: DataFrame, by: Sequence[str], at: str, tile_rows: int = TILE_ROWS) -> int | None:
    """Tile width that gives about ``tile_rows`` rows a tile; None if the fullest group is smaller than that."""
    top = df.groupBy(*by).agg(F.count("*").alias("n"), (F.max(at) - F.min(at)).alias("w")).agg(F.max(F.struct("n", "w"))).first()[0]
    if top is None or top["n"] <= tile_rows:
        return None
    return max(1, int(top["w"] / (top["n"] / tile_rows)))


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def resolve_tile(tile: int | str | None, *frames: DataFrame, by: Sequence[str] = ("chrom",)) -> int | None:
    """``tile``, or for 'auto' none below ``AUTO_BYTES`` of input and else the width that ``choose_tile`` finds."""
    if tile != "auto":
        return tile
    if sum(map(plan_bytes, frames)) < AUTO_BYTES:
        return None
    rows = None
    for df in frames:
        one = df.select(*by, "start")
        rows = one if rows is None else rows.unionByName(one)
    return choose_tile(rows, by, "start")


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], values: dict[str, tuple[str, Column]], tile: int | None = None, before: bool = False, reverse: bool = False) -> DataFrame:
    """``df`` with running values along ``order`` (its first column is the position).

    ``values`` maps a new column to (``sum`` | ``max`` | ``min``, expression). ``before`` leaves the row itself out.
    ``reverse`` runs from the end. Rows that tie in ``order`` come in any order.
    """
    fold = {"sum": F.sum, "max": F.max, "min": F.min}
    keys = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    frame = (Window.unboundedPreceding, -1 if before else 0)
    if tile is None:
        w = Window.partitionBy(*by).orderBy(*keys).rowsBetween(*frame)
        return df.withColumns({name: _zero(kind, fold[kind](x).over(w)) for name, (kind, x) in values.items()})
    tiled = df.withColumn("_tile", F.floor(F.col(order[0]) / tile))
    parts = tiled.groupBy(*by, "_tile").agg(*[fold[kind](x).alias(f"_t_{name}") for name, (kind, x) in values.items()])
    along = Window.partitionBy(*by).orderBy(F.col("_tile").desc() if reverse else F.col("_tile")).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(*by, "_tile", *[fold[kind](f"_t_{name}").over(along).alias(f"_c_{name}") for name, (kind, _) in values.items()])
    w = Window.partitionBy(*by, "_tile").orderBy(*keys).rowsBetween(*frame)
    # null keys are groups of their own, as in a window
    keyed = carried.withColumnsRenamed({c: f"_k_{c}" for c in (*by, "_tile")})
    on = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (*by, "_tile")])
    met = tiled.join(keyed, on).drop(*[f"_k_{c}" for c in (*by, "_tile")])
    out = {}
    for name, (kind, x) in values.items():
        inner, carry = fold[kind](x).over(w), F.col(f"_c_{name}")
        if kind == "sum":
            out[name] = F.coalesce(inner, F.lit(0).cast("long")) + F.coalesce(carry, F.lit(0).cast("long"))
        else:
            out[name] = (F.greatest if kind == "max" else F.least)(inner, carry)
    return met.withColumns(out).drop("_tile", *[f"_c_{name}" for name in values])


def _zero(kind: str, x: Column) -> Column:
    return F.coalesce(x, F.lit(0).cast("long")) if kind == "sum" else x


def following(df: DataFrame, by: Sequence[str], at: str, name: str, tile: int | None = None) -> DataFrame:
    """``df`` with the next position of its group, null for the last; positions are distinct."""
    return running(df, by, [at], {name: ("min", F.col(at))}, tile, before=True, reverse=True)


def events(df: DataFrame, by: Sequence[str], deltas: Sequence[str] = ("delta",)) -> DataFrame:
    """(+1 at start, -1 at end) of each row, summed up by position; empty rows give none."""
    e = df.where("start < end").select(*by, F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).cast("long").alias("delta")), F.struct(F.col("end").alias("pos"), F.lit(-1).cast("long").alias("delta")))).alias("x"))
    return e.select(*by, "x.pos", "x.delta").groupBy(*by, "pos").agg(F.sum("delta").alias("delta"))


def depth_segments(df: DataFrame, by: Sequence[str], ends: DataFrame | None = None, tile: int | None = None) -> DataFrame:
    """Maximal runs of equal depth: ``by, start, end, depth``.

    ``ends`` has positions (``by, pos``) at which a run begins or ends in any case (0 and the size).
    """
    e = events(df, by)
    if ends is not None:
        e = e.unionByName(ends.select(*by, "pos", F.lit(0).cast("long").alias("delta"), F.lit(True).alias("_keep")), allowMissingColumns=True)
        e = e.groupBy(*by, "pos").agg(F.sum("delta").alias("delta"), F.max("_keep").alias("_keep")).where("delta <> 0 OR _keep").drop("_keep")
    else:
        e = e.where("delta <> 0")
    summed = running(e, by, ["pos"], {"depth": ("sum", F.col("delta"))}, tile)
    return following(summed, by, "pos", "_next", tile).where("_next IS NOT NULL").select(*by, F.col("pos").alias("start"), F.col("_next").alias("end"), "depth")


def islands(df: DataFrame, by: Sequence[str], distance: int = 0, tile: int | None = None) -> DataFrame:
    """``df`` with ``_island``, which numbers the runs of rows that follow within ``distance``."""
    order = ["start", "end"]
    reach = running(df, by, order, {"_reach": ("max", F.col("end"))}, tile, before=True)
    opens = reach.withColumn("_opens", F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + distance), 1).otherwise(0).cast("long"))
    opens = opens.withColumn("_tie", -F.col("_opens"))  # of equal rows, the one that opens comes first
    return running(opens, by, [*order, "_tie"], {"_island": ("sum", F.col("_opens"))}, tile).drop("_reach", "_opens", "_tie")


PIECE = 10_000


def each_base(runs: DataFrame, start: str, end: str, name: str) -> DataFrame:
    """A row for each position of (start, end], in column ``name``; runs are cut into pieces first, so no array is longer than ``PIECE``."""
    piece = F.explode(F.sequence(F.col(start), F.col(end) - 1, F.lit(PIECE).cast("long")))
    pieces = runs.where(F.col(start) < F.col(end)).withColumn("_piece", piece)
    return pieces.withColumn(name, F.explode(F.sequence(F.col("_piece") + 1, F.least(F.col("_piece") + PIECE, F.col(end))))).drop("_piece")
