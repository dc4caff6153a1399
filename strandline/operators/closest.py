"""Nearest rows of B for each row of A, in both directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import check_strand, closest_distance, strand_bit, strand_bits, strand_group, strand_groups
from ..plans.partners import last_around, partner_key
from ..plans.rangejoin import Bins, range_join, with_row_id
from ..plans.sweep import resolve_tile, running

SEEN = "(_sees & b__bit) != 0"


def _with_neighbours(a: DataFrame, b: DataFrame, by: list[str], tile: int | None, overlap: str | None = None) -> DataFrame:
    """``a`` with ``_up``, the largest end of B at or before its start, ``_down``, the smallest start of B at or after its end, and ``_n``, the number of rows of B that are neither, so overlap it.

    ``overlap`` adds what tells the ``first`` (``_b``, the row) or the ``last`` (``_last``, its start) of the overlapping rows, if there are any.
    """
    row = F.struct(*a.columns)
    a_rows = a.select(*by, F.col("start").alias("_p"), F.lit(1).alias("_k"), row.alias("_row"))
    extra = [partner_key(b.drop("_g")).alias("_v1")] if overlap == "first" else []
    b_ends = b.select(*by, F.col("end").alias("_p"), F.lit(0).alias("_k"), F.col("end").alias("_v"), _one().alias("_c"), *extra)
    both = a_rows.unionByName(b_ends, allowMissingColumns=True)
    ups = {"_up": ("max", F.col("_v")), "_nu": ("sum", F.col("_c"))}
    kept = ["_row", "_up", "_nu"]
    if overlap == "last":
        both = both.unionByName(last_around(a, b, by).select(*by, F.col("_x").alias("_p"), F.lit(0).alias("_k"), F.struct("_x", "_s").alias("_around")), allowMissingColumns=True)
        ups["_around_"] = ("max", F.col("_around"))
        kept.append(F.when(F.col("_around_._x") == F.col("_row.start"), F.col("_around_._s")).alias("_around"))
    up = running(both, by, ["_p", "_k"], ups, tile)
    if overlap == "first":  # as in first_partner
        up = running(up, by, ["_p", "_k"], {"_b": ("min", F.col("_v1"))}, tile, reverse=True)
        kept.append("_b")
    up = up.where("_row IS NOT NULL")
    # an empty row of B where an empty row of A is counts as upstream only
    a_ends = up.select(*by, F.col("_row.end").alias("_p"), F.when(F.col("_row.start") == F.col("_row.end"), 2).otherwise(0).alias("_k"), *kept)
    solid = [F.when(F.col("start") < F.col("end"), F.col("start")).alias("_solid")] if overlap == "last" else []
    b_starts = b.select(*by, F.col("start").alias("_p"), F.when(F.col("start") == F.col("end"), 1).otherwise(3).alias("_k"), F.col("start").alias("_v"), _one().alias("_c"), *solid)
    both = a_ends.unionByName(b_starts, allowMissingColumns=True)
    down = running(both, by, ["_p", "_k"], {"_down": ("min", F.col("_v")), "_nd": ("sum", F.col("_c"))}, tile, reverse=True)
    if overlap == "last":
        # the last start before a row's end is that of an overlapping row if it lies after the row's start, or there with a row that is not empty
        down = running(down, by, ["_p", "_k"], {"_s1": ("max", F.col("_v")), "_s2": ("max", F.col("_solid"))}, tile)
        start, end = F.col("_row.start"), F.col("_row.end")
        last = F.when(F.col("_s1") > start, F.col("_s1")).when((F.col("_s2") == start) & (start < end), start).otherwise(F.col("_around"))
    found = {None: [], "first": ["_b"], "last": [last.alias("_last")] if overlap == "last" else []}[overlap]
    total = b.groupBy(*by).agg(F.count("*").alias("_total"))  # a row for each chromosome
    met = down.where("_row IS NOT NULL").join(total, by, "left")
    return met.select("_row.*", "_up", "_down", (F.coalesce("_total", F.lit(0)) - F.col("_nu") - F.col("_nd")).alias("_n"), *found)


def _one() -> Column:
    return F.lit(1).cast("long")


def _partners(best: DataFrame, b: DataFrame, strand: str | None, columns: list[str], others: list[str]) -> DataFrame:
    """Every row of B at the distance ``_best``. Rows of B are not copied for each strand group: a place has few that a row of A does not see."""
    side = lambda name, at: F.struct(F.lit(name).alias("s"), F.col(at).alias("p"))
    sides = F.array_compact(F.array(F.when(F.col("_du") == F.col("_best"), side("u", "_up")), F.when(F.col("_dd") == F.col("_best"), side("d", "_down"))))
    left, right = _strand_bits(best, b, strand)
    wanted = left.withColumn("_w", F.explode_outer(sides))
    ends = right.select(*[F.col(c).alias(f"b_{c}") for c in right.columns]).withColumn("_x", F.explode(F.array(F.struct(F.lit("u").alias("s"), F.col("b_end").alias("p")), F.struct(F.lit("d").alias("s"), F.col("b_start").alias("p")))))
    on = (F.col("chrom") == F.col("b_chrom")) & (F.col("_w.s") == F.col("_x.s")) & (F.col("_w.p") == F.col("_x.p"))
    if strand is not None:
        on = on & F.expr(SEEN)
    # an empty row of B where an empty row of A is would be met from both sides
    on = on & ~((F.col("_w.s") == "d") & (F.col("b_end") <= F.col("start")))
    return wanted.join(ends, on, "left").select(*columns, *others)


def _strand_bits(a: DataFrame, b: DataFrame, strand: str | None) -> tuple[DataFrame, DataFrame]:
    """Both sides with what ``SEEN`` tests."""
    if strand is None:
        return a, b
    return a.withColumn("_sees", strand_bits("strand", strand)), b.withColumn("_bit", strand_bit("strand"))


def _one_partner(best: DataFrame, seen: DataFrame, by: list[str], columns: list[str], others: list[str], tie: str, overlap: str | None) -> DataFrame:
    """The first or last of the nearest rows of B; of each place of an end (u) or a start (d, or s without empty rows) B has one, so no pairs are made."""
    key = partner_key(seen.drop("_g"))
    at = lambda name, p: F.struct(F.lit(name).alias("s"), p.alias("p"))
    sides = [at("u", F.col("end")), at("d", F.col("start"))]
    if tie == "first":
        sides.append(F.when(F.col("start") < F.col("end"), at("s", F.col("start"))))
    ends = seen.select(*by, F.explode(F.array_compact(F.array(*sides))).alias("_x"), key.alias("_v"))
    ends = ends.select(*by, F.col("_x.s").alias("_s"), F.col("_x.p").alias("_p"), "_v").groupBy(*by, "_s", "_p").agg((F.min if tie == "first" else F.max)("_v").alias("_v"))
    is_up, is_down = F.col("_du") == F.col("_best"), F.col("_dd") == F.col("_best")
    if tie == "first":
        # beside an empty row of A, empty rows of B at its place are upstream only
        down = F.when(F.col("_down") == F.col("start"), at("s", F.col("_down"))).otherwise(at("d", F.col("_down")))
        wanted = F.when(is_up, at("u", F.col("_up"))).when(is_down, down)
    else:
        wanted = F.when(is_down, at("d", F.col("_down"))).when(is_up, at("u", F.col("_up")))
    if overlap == "first":
        wanted = F.when(F.col("_n") == 0, wanted)
    elif overlap == "last":
        wanted = F.when(F.col("_n") == 0, wanted).otherwise(at("d", F.col("_last")))
    rows = best.withColumn("_w", wanted).withColumn("_s", F.col("_w.s")).withColumn("_p", F.col("_w.p"))
    met = rows.join(ends, [*by, "_s", "_p"], "left")
    found = F.when(F.col("_n") > 0, F.col("_b")).otherwise(F.col("_v")) if overlap == "first" else F.col("_v")
    return met.select(*columns, found.alias("_f")).select(*columns, *[F.col(f"_f.{c}").alias(c) for c in others])


def closest(
    a: DataFrame,
    b: DataFrame,
    tie: str = "all",
    ignore_overlapping: bool = False,
    ignore_upstream: bool = False,
    ignore_downstream: bool = False,
    max_distance: int | None = None,
    strand: str | None = None,
    bins: Bins | None = None,
    tile: int | str | None = "auto",
) -> DataFrame:
    """A, ``b_*``, ``distance`` and ``signed_distance`` (negative upstream) of the nearest rows of ``b``.

    Distance is 0 if overlapping, else the bases between plus one. Rows with none left have
    b_chrom '.', b_start, b_end and distance -1. ``tie`` keeps all nearest rows, the ``first`` or the
    ``last`` by (b_start, b_end, other columns). With ``strand`` only rows of B of the ``same`` or
    ``opposite`` strand count; rows without a strand see and are seen by all, and what is neither + nor - is '.'.
    """
    if tie not in ("all", "first", "last"):
        raise ValueError(f"tie must be all, first or last, not {tie!r}")
    check_strand(strand)
    columns, others = a.columns, [f"b_{c}" for c in b.columns]
    by = ["chrom"] if strand is None else ["chrom", "_g"]
    b = b.where("chrom IS NOT NULL")
    seen = b if strand is None else b.withColumn("_g", F.explode(strand_groups("strand", strand)))
    keyed = with_row_id(a) if strand is None else with_row_id(a).withColumn("_g", strand_group("strand"))
    overlap = None if tie == "all" or ignore_overlapping else tie
    alone = _with_neighbours(keyed, seen, by, resolve_tile(tile, a, b), overlap)
    hits = None
    if not ignore_overlapping and tie == "all":
        alone = alone.where("_n = 0")
        left, right = _strand_bits(a, b, strand)
        zero = F.lit(0).cast("long")
        hits = range_join(left, right, "inner", None if strand is None else F.expr(SEEN), bins=bins).select(*columns, *others, zero.alias("distance"), zero.alias("signed_distance"))
    up = F.lit(None).cast("long") if ignore_upstream else F.col("start") - F.col("_up") + 1
    down = F.lit(None).cast("long") if ignore_downstream else F.col("_down") - F.col("end") + 1
    best = alone.withColumn("_du", up).withColumn("_dd", down).withColumn("_best", F.least("_du", "_dd"))
    if max_distance is not None:
        best = best.withColumn("_best", F.when(F.col("_best") <= max_distance, F.col("_best")))
    near = _one_partner(best, seen, by, columns, others, tie, overlap) if tie != "all" else _partners(best, b, strand, columns, others)
    none = F.col("b_chrom").isNull()
    signed = closest_distance("start", "end", "b_start", "b_end")
    out = near.withColumn("signed_distance", signed).withColumn("distance", F.coalesce(F.abs("signed_distance"), F.lit(-1).cast("long")))
    filled = {"b_chrom": F.when(none, ".").otherwise(F.col("b_chrom")), "b_start": F.coalesce("b_start", F.lit(-1).cast("long")), "b_end": F.coalesce("b_end", F.lit(-1).cast("long"))}
    out = out.select(*columns, *[filled[c].alias(c) if c in filled else F.col(c) for c in others], "distance", "signed_distance")
    return out if hits is None else hits.unionByName(out)


def closest_lists(a: DataFrame, b: DataFrame, **options) -> DataFrame:
    """A with ``closest``, its nearest rows of ``b`` as structs that begin with ``signed_distance``, ``min_distance`` (of the first of them) and ``has_closest``."""
    found = closest(with_row_id(a, "_row_id"), b, **options)
    partner = F.struct("signed_distance", *[f"b_{c}" for c in b.columns])
    listed = found.groupBy("_row_id", *a.columns).agg(F.array_sort(F.collect_list(F.when(F.col("distance") >= 0, partner))).alias("closest"))
    return listed.select(*a.columns, "closest", F.try_element_at("closest", F.lit(1))["signed_distance"].alias("min_distance"), (F.size("closest") > 0).alias("has_closest"))
