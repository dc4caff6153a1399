"""Overlap joins with streams.

Positions take the part of event time: a column ``at`` (a timestamp) says how far the stream has come, and
its watermark bounds the rows that a join keeps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.rangejoin import Bins, _binned


def _prefixed(b: DataFrame) -> DataFrame:
    return b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])


def _joined(a: DataFrame, b: DataFrame, bins: Bins, extra=None, left_slop: int = 0, right_slop: int = 0) -> DataFrame:
    if bins.levels:
        raise ValueError("a stream join takes bins of one level")
    start, end = F.greatest(F.col("start") - left_slop, F.lit(0).cast("long")), F.col("end") + right_slop
    left = _binned(a.withColumn("_s", start).withColumn("_e", end), F.col("_s"), F.col("_e"), bins, True).withColumnRenamed("_bin", "_ab").drop("_level", "_tag")
    right = _binned(_prefixed(b), F.col("b_start"), F.col("b_end"), bins, False).drop("_level", "_tag")
    w = F.lit(bins.width).cast("long")
    on = (F.col("chrom") == F.col("b_chrom")) & (F.col("_ab") == F.col("_bin")) & (F.col("_s") < F.col("b_end")) & (F.col("b_start") < F.col("_e"))
    on = on & (F.greatest(F.floor(F.col("_s") / w), F.floor(F.col("b_start") / w)) == F.col("_ab"))
    if extra is not None:
        on = on & extra
    return left.join(right, on).drop("_s", "_e", "_ab", "_bin")


def stream_static_intersect(stream: DataFrame, static: DataFrame, bins: Bins) -> DataFrame:
    """Pairs of a stream's rows with the overlapping rows of a table; keeps no state."""
    return _joined(stream, static, bins)


def stream_intersect(a: DataFrame, b: DataFrame, bins: Bins, at: str, delay: str, within: str) -> DataFrame:
    """Overlapping pairs of two streams whose ``at`` lie at most ``within`` apart; rows older than the watermark go."""
    a, b = a.withWatermark(at, delay), b.withWatermark(at, delay)
    near = (F.col(f"b_{at}") >= F.col(at) - F.expr(f"interval {within}")) & (F.col(f"b_{at}") <= F.col(at) + F.expr(f"interval {within}"))
    return _joined(a, b, bins, near)


def stream_window(stream: DataFrame, static: DataFrame, bins: Bins, window: int = 1000) -> DataFrame:
    """Pairs of a stream's rows with rows of a table within ``window`` bases."""
    return _joined(stream, static, bins, None, window, window)
