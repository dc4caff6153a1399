"""Coverage of each row of A by rows of B."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.algebra import length, strand_group, strand_groups
from ..plans.sweep import depth_segments, each_base, events, following, islands, resolve_tile, running

MODES = ("basic", "mean", "hist", "all", "per_base")


def coverage(a: DataFrame, b: DataFrame, mode: str = "basic", strand: str | None = None, tile: int | str | None = "auto") -> DataFrame:
    """Coverage of ``a`` by ``b`` (rows of ``a`` stay apart, equal ones too).

    basic: n_overlaps, bases_covered, length, fraction; mean: mean_depth; hist: depth, bases, length, fraction for
    each depth; all: the same over every row of ``a`` together; per_base: offset (from 1), depth. Empty rows
    of ``a`` have no overlaps, no bases, and a histogram of depth 0 with fraction 1.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    if mode in ("basic", "mean"):
        return _totals(a, b, mode, strand, resolve_tile(tile, a, b))
    by = ["chrom"] if strand is None else ["chrom", "_g"]
    keyed = a if strand is None else a.withColumn("_g", strand_group("strand"))
    seen = (b if strand is None else b.withColumn("_g", F.explode(strand_groups("strand", strand)))).where("chrom IS NOT NULL").select(*by, "start", "end")
    how = {"hist": _histograms, "all": _histogram_of_all, "per_base": _bases}[mode]
    return how(keyed, seen, by, a.columns, resolve_tile(tile, a, b))


def _totals(a: DataFrame, b: DataFrame, mode: str, strand: str | None, tile: int | None) -> DataFrame:
    """Counts and bases as differences of running sums at the ends of each row of A: no pairs are made.

    Bases of B before x are the sum of x - start over the rows that began before, less that of x - end over those that
    ended; for covered bases the same over the merged rows.
    """
    by = ["chrom"] if strand is None else ["chrom", "_g"]
    keyed = a if strand is None else a.withColumn("_g", strand_group("strand"))
    seen = (b if strand is None else b.withColumn("_g", F.explode(strand_groups("strand", strand)))).select(*by, "start", "end")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def marks(rows: DataFrame, sign: str) -> DataFrame:
        """Starts (2) and ends (0) with what they add: n rows open, p the sum of their places with that sign."""
        both = F.explode(F.array(F.struct(F.col("start").alias("_p"), F.lit(2).alias("_k"), one.alias("n"), F.col("start").alias("p")), F.struct(F.col("end").alias("_p"), F.lit(0).alias("_k"), (-one).alias("n"), (-F.col("end")).alias("p"))))
        x = rows.select(*by, both.alias("x")).select(*by, "x._p", "x._k", F.col("x.n").alias(f"_{sign}n"), F.col("x.p").alias(f"_{sign}p"))
        return x.withColumn("_end", F.when(F.col("_k") == 0, one)).withColumn("_start", F.when(F.col("_k") == 2, one)) if sign == "r" else x

    events = marks(seen, "r")
    if mode == "basic":
        hulls = islands(seen.where("start < end"), by, 0, tile).groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        events = events.unionByName(marks(hulls, "m"), allowMissingColumns=True)
    sign = "m" if mode == "basic" else "r"
    row = F.struct(*a.columns)
    sums = {"_n": ("sum", F.col(f"_{sign}n")), "_q": ("sum", F.col(f"_{sign}p")), "_s": ("sum", F.col("_start")), "_e": ("sum", F.col("_end"))}
    bases = lambda at: F.col("_n") * F.col(at) - F.col("_q")
    at = lambda rows, place, *kept: rows.select(*by, F.col(place).alias("_p"), F.lit(1).alias("_k"), *kept)
    # rows of A come after the ends and before the starts at their place
    first = running(at(keyed, "start", row.alias("_row")).unionByName(events, allowMissingColumns=True), by, ["_p", "_k"], sums, tile).where("_row IS NOT NULL")
    first = first.select(*by, "_row", bases("_row.start").alias("_from"), F.col("_e").alias("_before"))
    last = running(at(first, "_row.end", "_row", "_from", "_before").unionByName(events, allowMissingColumns=True), by, ["_p", "_k"], sums, tile).where("_row IS NOT NULL")
    size = length("start", "end")
    rows = last.select("_row.*", (F.col("_s") - F.col("_before")).alias("_c"), (bases("_row.end") - F.col("_from")).alias("_b"))
    if mode == "mean":
        return rows.select(*a.columns, F.when(size > 0, F.col("_b") / size).otherwise(0.0).alias("mean_depth"))
    full = size > 0
    return rows.select(*a.columns, F.when(full, F.col("_c")).otherwise(zero).alias("n_overlaps"), F.when(full, F.col("_b")).otherwise(zero).alias("bases_covered"), size.alias("length"), F.when(full, F.col("_b") / size).otherwise(0.0).alias("fraction"))


SOLID = "start < end AND chrom IS NOT NULL"  # rows of A that can have a depth over 0


def _runs(rows: DataFrame, seen: DataFrame, by: list[str], tile: int | None) -> DataFrame:
    """``rows`` (all ``SOLID``) with the runs of B's depth in them: ``_s``, ``_e``, ``depth``; ``_level`` and ``_tile`` deal the rows out.

    A row's first run comes from a sweep; the others begin inside it. A row lies in one tile, of a width that is its length
    at least, and a run's beginning in that tile and in the one before, so all runs of a row are in one task and pairs are not shuffled.
    """
    bits = F.length(F.bin(F.col("end") - F.col("start")))
    sizes = {r["k"]: r["n"] for r in rows.groupBy(bits.alias("k")).agg(F.count("*").alias("n")).collect()}  # 63 rows at most
    least = round(sum(k * n for k, n in sizes.items()) / max(1, sum(sizes.values()))) + 1  # about twice the typical length, as a power of 2
    level = lambda k: F.greatest(F.lit(0), F.ceil((k - least) / 2)).cast("int")
    shifts = F.array(*[F.struct(F.lit(x).alias("l"), F.lit(least + 2 * x).alias("by")) for x in sorted({max(0, -((least - k) // 2)) for k in sizes})]).cast("array<struct<l:int,by:int>>")
    borders = rows.groupBy(*by).agg(F.array(F.min("start"), F.max("end")).alias("pos")).withColumn("pos", F.explode("pos"))
    segments = depth_segments(seen, by, borders, tile)
    run = F.struct("start", "end", "depth")
    marks = segments.select(*by, F.col("start").alias("_p"), F.lit(0).alias("_k"), run.alias("_v"))
    at_rows = rows.select(*by, F.col("start").alias("_p"), F.lit(1).alias("_k"), F.struct(*rows.columns).alias("_row"))
    first = running(at_rows.unionByName(marks, allowMissingColumns=True), by, ["_p", "_k"], {"_at": ("max", F.col("_v"))}, tile).where("_row IS NOT NULL")
    placed = first.select("_row.*", "_at").withColumn("_level", level(bits)).withColumn("_tile", F.expr(f"shiftright(start, {least} + 2 * _level)"))
    inner = segments.select(*by, run.alias("_run"), F.explode(shifts).alias("_x")).select(*by, F.col("_x.l").alias("_level"), F.expr("shiftright(_run.start, _x.by)").alias("_u"), "_run")
    inner = inner.select(*by, "_level", F.explode(F.array(F.col("_u"), F.col("_u") - 1)).alias("_tile"), "_run")
    # one row of a tile without a run stands for the first runs
    tiles = rows.select(*by, level(bits).alias("_level"), "start").select(*by, "_level", F.expr(f"shiftright(start, {least} + 2 * _level)").alias("_tile")).distinct()
    inner = inner.unionByName(tiles, allowMissingColumns=True).withColumnsRenamed({c: f"_r{c}" for c in (*by, "_level", "_tile")})
    on = (F.col("_level") == F.col("_r_level")) & (F.col("_tile") == F.col("_r_tile"))
    for c in by:
        on = on & (F.col(c) == F.col(f"_r{c}"))
    on = on & (F.col("_run").isNull() | (F.col("_run.start") > F.col("start")) & (F.col("_run.start") < F.col("end")))
    met = placed.join(inner, on)
    of = F.coalesce("_run", "_at")
    return met.select(*rows.columns, "_level", "_tile", F.greatest("start", of["start"]).alias("_s"), F.least("end", of["end"]).alias("_e"), of["depth"].alias("depth"))


def _histograms(a: DataFrame, seen: DataFrame, by: list[str], columns: list[str], tile: int | None) -> DataFrame:
    """Equal rows of A share their histogram, one array; its length is bounded by the depths that occur."""
    size, place = length("start", "end"), [*by, "start", "end"]
    runs = _runs(a.where(SOLID).select(*place).distinct(), seen, by, tile)
    of_depth = runs.groupBy(*by, "_level", "_tile", "start", "end", "depth").agg(F.sum(F.col("_e") - F.col("_s")).alias("bases"))
    hist = of_depth.groupBy(*by, "_level", "_tile", "start", "end").agg(F.collect_list(F.struct("depth", "bases")).alias("_hist")).select(*place, "_hist")
    zero = F.array(F.struct(F.lit(0).cast("long").alias("depth"), size.alias("bases")))
    out = a.join(hist, place, "left").select(*columns, F.explode(F.coalesce("_hist", zero)).alias("_h"))
    return out.select(*columns, "_h.depth", "_h.bases", size.alias("length"), F.when(size > 0, F.col("_h.bases") / size).otherwise(1.0).alias("fraction"))


def _histogram_of_all(a: DataFrame, seen: DataFrame, by: list[str], columns: list[str], tile: int | None) -> DataFrame:
    """Bases at each depth, counted once for each row of A there: one sweep over both sets."""
    zero = F.lit(0).cast("long")
    of_a, of_b = events(a.where(SOLID), by).withColumnRenamed("delta", "_a"), events(seen, by).withColumnRenamed("delta", "_b")
    both = of_a.unionByName(of_b, allowMissingColumns=True).groupBy(*by, "pos").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    swept = following(running(both, by, ["pos"], {"_rows": ("sum", F.col("_a")), "depth": ("sum", F.col("_b"))}, tile), by, "pos", "_next", tile)
    inside = swept.where("_rows > 0").select("depth", ((F.col("_next") - F.col("pos")) * F.col("_rows")).alias("bases"))
    bare = a.where(f"NOT ({SOLID})").select(zero.alias("depth"), length("start", "end").alias("bases"))
    total = inside.unionByName(bare).groupBy("depth").agg(F.sum("bases").alias("bases"))  # a row for each depth
    total = total.withColumn("length", F.sum("bases").over(Window.partitionBy(F.lit(0))))
    return total.select(F.lit("all").alias("chrom"), "depth", "bases", "length", F.when(F.col("length") > 0, F.col("bases") / F.col("length")).otherwise(1.0).alias("fraction"))


def _bases(a: DataFrame, seen: DataFrame, by: list[str], columns: list[str], tile: int | None) -> DataFrame:
    """A row for each base of each row of A."""
    rows = a.withColumn("_all", F.struct(*columns)).select(*by, "start", "end", "_all")
    runs = _runs(rows.where(SOLID), seen, by, tile).select("_all", "depth", (F.col("_s") - F.col("start")).alias("_s"), (F.col("_e") - F.col("start")).alias("_e"))
    zero = F.lit(0).cast("long")
    bare = rows.where("start < end AND chrom IS NULL").select("_all", zero.alias("depth"), zero.alias("_s"), length("start", "end").alias("_e"))
    return each_base(runs.unionByName(bare), "_s", "_e", "offset").select("_all.*", "offset", "depth")
