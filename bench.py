"""Headline queries, timed end to end; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). BENCH_ROWS=N adds the
operators on N x N/2 synthetic intervals, the shape of the published numbers.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

HEADLINE = [
    "intersect_overlap", "intersect_count", "window_pairs", "closest_all", "subtract_frag", "coverage_basic", "merge_d0", "complement", "slop_both", "jaccard", "genomecov_bga",
    "multiinter3", "sort_default",
]


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(f) -> float:
    began = time.perf_counter()
    f()
    return round(time.perf_counter() - began, 3)


def synthetic(spark: SparkSession, n: int) -> dict[str, float]:
    import tempfile

    from strandline import operators as ops
    from strandline.operators.generate import HG38
    from strandline.sources import genome_frame

    folder = tempfile.mkdtemp(prefix="bench-")
    a, b = ops.generate(spark, n, n // 2, sorted=False)
    a.write.parquet(f"{folder}/a")
    b.write.parquet(f"{folder}/b")
    a, b, genome = spark.read.parquet(f"{folder}/a"), spark.read.parquet(f"{folder}/b"), genome_frame(spark, HG38)
    plans = {
        "intersect": lambda: ops.intersect(a, b), "merge": lambda: ops.merge(a), "subtract": lambda: ops.subtract(a, b), "closest": lambda: ops.closest(a, b), "window": lambda: ops.window(a, b),
        "coverage": lambda: ops.coverage(a, b), "sort": lambda: ops.sort(a), "complement": lambda: ops.complement(a, genome), "slop": lambda: ops.slop(a, genome, 100), "jaccard": lambda: ops.jaccard(a, b),
    }
    return {f"{name}_{n}": timed(lambda plan=plan: consume(plan())) for name, plan in plans.items()}


def main() -> None:
    cpus, sf_dir = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from strandline.plans.suite import QUERIES

    consume(QUERIES["intersect_overlap"](spark, sf_dir))  # starts the JVM's compilers
    times = {name: timed(lambda name=name: consume(QUERIES[name](spark, sf_dir))) for name in HEADLINE}
    if rows := int(os.environ.get("BENCH_ROWS", "0")):
        times |= synthetic(spark, rows)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
