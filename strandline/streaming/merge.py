"""Merging of a stream of time intervals by session windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_merge(stream: DataFrame, at: str = "ts", seconds: str = "duration", by: tuple[str, ...] = ("chrom",), delay: str = "1 hour", distance: int = 0) -> DataFrame:
    """For each ``by`` (session windows need a key): hulls of intervals [at, at + seconds) that touch or follow within ``distance`` seconds, with ``count``.

    A hull comes out once the watermark has passed it; rows that are later than it are dropped. Empty intervals give none.
    """
    rows = stream.withWatermark(at, delay).where((F.col(seconds) + distance) > 0)
    gap = F.concat((F.col(seconds) + F.lit(distance)).cast("string"), F.lit(" seconds"))
    grouped = rows.groupBy(*by, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("count"))
    return grouped.select(*by, F.col("w.start").alias("start"), (F.col("w.end") - F.expr(f"interval {distance} seconds")).alias("end"), "count")
