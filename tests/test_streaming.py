from pyspark.sql import functions as F

from strandline.operators import intersect
from strandline.plans.rangejoin import Bins
from strandline.streaming import stream_intersect, stream_merge, stream_static_intersect, stream_window

SCHEMA = "id long, chrom string, start long, end long"


def drained(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name).collect()


def test_stream_joins(spark, tmp_path):
    a = [(i, "c", 10 * i, 10 * i + 25) for i in range(20)]
    b = [(i, "c", 15 * i, 15 * i + 4) for i in range(15)]
    left, right = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    left.withColumn("at", F.timestamp_seconds(F.col("start") + 100_000)).write.parquet(str(tmp_path / "a"))
    right.withColumn("at", F.timestamp_seconds(F.col("start") + 100_000)).write.parquet(str(tmp_path / "b"))
    stream = lambda x: spark.readStream.schema(f"{SCHEMA}, at timestamp").parquet(str(tmp_path / x))
    want = sorted((r.id, r.b_id) for r in intersect(left, right, write_b=True).collect())
    bins = Bins(16)
    assert sorted((r.id, r.b_id) for r in drained(stream_static_intersect(stream("a"), right, bins), "s1")) == want
    assert sorted((r.id, r.b_id) for r in drained(stream_intersect(stream("a"), stream("b"), bins, "at", "1 hour", "1 hour"), "s2")) == want
    assert len(drained(stream_window(stream("a"), right, bins, 30), "s3")) > len(want)


def test_stream_merge(spark, tmp_path):
    rows = [(0, 5), (3, 4), (7, 2), (20, 5), (25, 1), (4000, 1), (9000, 1)]
    df = spark.createDataFrame(rows, "s long, duration long").select(F.timestamp_seconds(F.col("s") + 100_000).alias("ts"), "duration", F.lit("c").alias("chrom"))
    for part in (df.where("ts < timestamp_seconds(104500)"), df.where("ts > timestamp_seconds(104500)")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "m"))
    stream = spark.readStream.schema("ts timestamp, duration long, chrom string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "m"))
    got = drained(stream_merge(stream, delay="10 minutes"), "m1")
    spans = sorted((r.start.timestamp(), r.end.timestamp(), r["count"]) for r in got)
    assert [(e - s, n) for s, e, n in spans][:2] == [(9.0, 3), (6.0, 2)]
