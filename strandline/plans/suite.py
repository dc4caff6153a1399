"""Queries over interval views of the ``events`` table, each with its SQL twin.

A user's events lie on chromosome ``chr<user_id mod 10>`` at the second they happened and last
100 seconds for each unit of value. Set a has views and clicks but for chr9, b purchases and
signups but for chr0, c errors. The genome has chr0 to chr9 and an empty chromosome. Set s, for orders, has the views and clicks on chr0 to
chr24; its genome lists some of them, backwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import operators as ops
from ..functions.algebra import distance, length, overlap_length
from ..functions.text import general6, plain6

from ..sources.bed import format_bed, parse_lines
from ..sources.genome import genome_frame
from ..sources.validate import order_faults
from .rangejoin import range_join

ORIGIN = 1704067200  # 2024-01-01T00:00:00Z
SIZES = [(f"chr{i}", 2_700_000) for i in range(10)] + [("chrEmpty", 1000)]
NAMES = {"a": ("view", "click"), "b": ("purchase", "signup"), "c": ("error",), "s": ("view", "click")}
LACKS = {"a": 9, "b": 0}  # so each of a and b has a chromosome that the other lacks
ORDER = [f"chr{i}" for i in range(22, 3, -1)]


def intervals(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_type").isin(*NAMES[which]))
    if which in LACKS:
        e = e.where(F.col("user_id") % 10 != LACKS[which])
    start = F.unix_seconds(F.col("ts").cast("timestamp")) - F.lit(ORIGIN).cast("long")
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("chr"), (F.col("user_id") % (25 if which == "s" else 10)).cast("string")).alias("chrom"), start.alias("start"),
        (start + F.floor(F.col("value") * 100)).alias("end"), F.col("event_type").alias("name"), F.col("value").alias("score"),
        F.when(F.col("event_id") % 2 == 0, "+").otherwise("-").alias("strand"),
    )


def genome(spark: SparkSession) -> DataFrame:
    return genome_frame(spark, SIZES)


def backwards(spark: SparkSession) -> DataFrame:
    return genome_frame(spark, [(c, 2_700_000) for c in ORDER])


VIEWS = """iv AS (
  SELECT event_id AS id, 'chr' || CAST(user_id % 10 AS VARCHAR) AS chrom, CAST(date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) AS BIGINT) AS "start",
    CAST(date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) AS BIGINT) + CAST(floor(value * 100) AS BIGINT) AS "end",
    event_type AS name, value AS score, CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand, user_id FROM events),
a AS (SELECT * EXCLUDE (user_id) FROM iv WHERE name IN ('view', 'click') AND user_id % 10 <> 9),
b AS (SELECT * EXCLUDE (user_id) FROM iv WHERE name IN ('purchase', 'signup') AND user_id % 10 <> 0),
s AS (SELECT * EXCLUDE (user_id) REPLACE ('chr' || CAST(user_id % 25 AS VARCHAR) AS chrom), CAST(user_id % 25 AS INTEGER) AS number FROM iv WHERE name IN ('view', 'click')),
c AS (SELECT * EXCLUDE (user_id) FROM iv WHERE name = 'error'),
genome AS (SELECT 'chr' || CAST(i AS VARCHAR) AS chrom, CAST(2700000 AS BIGINT) AS size, CAST(i AS INTEGER) AS ord FROM range(10) t(i) UNION ALL SELECT 'chrEmpty', 1000, 10)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, sql: str | None, build: Callable, *sets: str, recursive: bool = False) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(spark, *[intervals(spark, sf_dir, s) for s in sets])

    query.__name__ = name
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = f"WITH {VIEWS}{',' if sql.lstrip().startswith('+') else ''}\n{sql.lstrip().removeprefix('+')}"


def _pair(name: str, sql: str | None, build: Callable) -> None:
    _add(name, sql, lambda spark, a, b: build(a, b), "a", "b")


A = 'a.id, a.chrom, a."start", a."end", a.name, a.score, a.strand'
B = 'b.id AS b_id, b.chrom AS b_chrom, b."start" AS b_start, b."end" AS b_end, b.name AS b_name, b.score AS b_score, b.strand AS b_strand'
SEGMENT = 'a.id, a.chrom, greatest(a."start", b."start") AS "start", least(a."end", b."end") AS "end", a.name, a.score, a.strand'
HIT = 'a.chrom = b.chrom AND a."start" < b."end" AND b."start" < a."end"'
OV = '(least(a."end", b."end") - greatest(a."start", b."start"))'
FRAC_A = f'{HIT} AND a."end" > a."start" AND CAST({OV} AS DOUBLE) / (a."end" - a."start") >= 0.5'
FRAC_B = f'{HIT} AND b."end" > b."start" AND CAST({OV} AS DOUBLE) / (b."end" - b."start") >= 0.5'

_pair("intersect_overlap", f"SELECT {SEGMENT} FROM a JOIN b ON {HIT}", lambda a, b: ops.intersect(a, b))
_pair("intersect_wa", f"SELECT {A} FROM a JOIN b ON {HIT}", lambda a, b: ops.intersect(a, b, write_a=True))
_pair("intersect_wb", f"SELECT {SEGMENT}, {B} FROM a JOIN b ON {HIT}", lambda a, b: ops.intersect(a, b, write_b=True))
_pair("intersect_wa_wb", f"SELECT {A}, {B} FROM a JOIN b ON {HIT}", lambda a, b: ops.intersect(a, b, write_a=True, write_b=True))
_pair("intersect_unique", f"SELECT {A} FROM a WHERE EXISTS (SELECT 1 FROM b WHERE {HIT})", lambda a, b: ops.intersect(a, b, unique=True))
_pair("intersect_none", f"SELECT {A} FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {HIT})", lambda a, b: ops.intersect(a, b, no_overlap=True))
_pair("intersect_count", f"SELECT {A}, count(b.id) AS count FROM a LEFT JOIN b ON {HIT} GROUP BY ALL", lambda a, b: ops.intersect(a, b, count=True))
_pair("intersect_frac", f"SELECT {SEGMENT} FROM a JOIN b ON {FRAC_A}", lambda a, b: ops.intersect(a, b, fraction=0.5))
_pair("intersect_fracb", f"SELECT {SEGMENT} FROM a JOIN b ON {FRAC_B}", lambda a, b: ops.intersect(a, b, fraction_b=0.5))
_pair("intersect_recip", f"SELECT {SEGMENT} FROM a JOIN b ON ({FRAC_A}) AND ({FRAC_B})", lambda a, b: ops.intersect(a, b, fraction=0.5, reciprocal=True))
_pair("intersect_none_frac", f"SELECT {A} FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {FRAC_A})", lambda a, b: ops.intersect(a, b, no_overlap=True, fraction=0.5))
_pair("intersect_same_strand", f"SELECT {SEGMENT} FROM a JOIN b ON {HIT} AND a.strand = b.strand", lambda a, b: ops.intersect(a, b, strand="same"))
_pair("intersect_opp_strand", f"SELECT {SEGMENT} FROM a JOIN b ON {HIT} AND a.strand <> b.strand", lambda a, b: ops.intersect(a, b, strand="opposite"))
_pair(
    "intersect_report_once",
    f"""SELECT id, chrom, greatest("start", b_start) AS "start", least("end", b_end) AS "end", name, score, strand
FROM (SELECT {A}, {B}, row_number() OVER (PARTITION BY a.id ORDER BY b."start", b."end", b.id) AS rn FROM a JOIN b ON {HIT}) WHERE rn = 1""",
    lambda a, b: ops.intersect(a, b, report_once=True),
)

NEAR = 'a.chrom = b.chrom AND greatest(a."start" - {0}, 0) < b."end" AND b."start" < a."end" + {1}'
_pair("window_pairs", f"SELECT {A}, {B} FROM a JOIN b ON {NEAR.format(1000, 1000)}", lambda a, b: ops.window(a, b))
_pair("window_asym", f"SELECT {A}, {B} FROM a JOIN b ON {NEAR.format(5000, 0)}", lambda a, b: ops.window(a, b, left=5000, right=0))
_pair("window_count", f"SELECT {A}, count(b.id) AS count FROM a LEFT JOIN b ON {NEAR.format(1000, 1000)} GROUP BY ALL", lambda a, b: ops.window(a, b, count=True))
_pair("window_none", f"SELECT {A} FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {NEAR.format(1000, 1000)})", lambda a, b: ops.window(a, b, no_overlap=True))


def _closest_sql(keep: str = "true", pick: str = "rank() OVER (PARTITION BY id ORDER BY distance)") -> str:
    return f"""+ p AS (
  SELECT {A}, {B}, CASE WHEN {HIT} THEN 0 WHEN b."end" <= a."start" THEN -(a."start" - b."end" + 1) ELSE b."start" - a."end" + 1 END AS signed_distance
  FROM a JOIN b ON a.chrom = b.chrom),
k AS (SELECT *, abs(signed_distance) AS distance FROM p WHERE {keep}),
r AS (SELECT *, {pick} AS rk FROM k),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY 1) AS o FROM r WHERE rk = 1)
SELECT {A}, coalesce(n.b_id, NULL) AS b_id, coalesce(n.b_chrom, '.') AS b_chrom, coalesce(n.b_start, -1) AS b_start, coalesce(n.b_end, -1) AS b_end, n.b_name, n.b_score, n.b_strand,
  coalesce(n.distance, -1) AS distance, n.signed_distance
FROM a LEFT JOIN n ON n.id = a.id"""


_pair("closest_all", _closest_sql(), lambda a, b: ops.closest(a, b))
_pair("closest_first", _closest_sql(pick="row_number() OVER (PARTITION BY id ORDER BY distance, b_start, b_end, b_id)"), lambda a, b: ops.closest(a, b, tie="first"))
_pair("closest_last", _closest_sql(pick="row_number() OVER (PARTITION BY id ORDER BY distance, b_start DESC, b_end DESC, b_id DESC)"), lambda a, b: ops.closest(a, b, tie="last"))
_pair("closest_io", _closest_sql("signed_distance <> 0"), lambda a, b: ops.closest(a, b, ignore_overlapping=True))
_pair("closest_iu", _closest_sql("signed_distance >= 0"), lambda a, b: ops.closest(a, b, ignore_upstream=True))
_pair("closest_id", _closest_sql("signed_distance <= 0"), lambda a, b: ops.closest(a, b, ignore_downstream=True))
_pair("closest_io_iu_id", _closest_sql("false"), lambda a, b: ops.closest(a, b, ignore_overlapping=True, ignore_upstream=True, ignore_downstream=True))
_pair("closest_max", _closest_sql("abs(signed_distance) <= 500"), lambda a, b: ops.closest(a, b, max_distance=500))
_pair("closest_same_strand", _closest_sql("strand = b_strand"), lambda a, b: ops.closest(a, b, strand="same"))


def _subtract_sql(on: str) -> str:
    return f"""+ h AS (SELECT {A}, greatest(a."start", b."start") AS cs, least(a."end", b."end") AS ce FROM a JOIN b ON {on}),
g AS (SELECT *, max(ce) OVER (PARTITION BY id ORDER BY cs, ce ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM h),
f AS (
  SELECT id, chrom, coalesce(pm, "start") AS "start", cs AS "end", name, score, strand FROM g
  UNION ALL SELECT id, chrom, max(ce), any_value("end"), any_value(name), any_value(score), any_value(strand) FROM h GROUP BY id, chrom)
SELECT * FROM f WHERE "start" < "end" UNION ALL SELECT {A} FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {on})"""


_pair("subtract_frag", _subtract_sql(HIT), lambda a, b: ops.subtract(a, b))
_pair("subtract_frac", _subtract_sql(FRAC_A), lambda a, b: ops.subtract(a, b, fraction=0.5))
_pair("subtract_entire", f"SELECT {A} FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {HIT})", lambda a, b: ops.subtract(a, b, remove_entire=True))


def _islands_sql(d: int, by: str, columns: str, tail: str = "") -> str:
    return f"""+ m AS (SELECT *, max("end") OVER (PARTITION BY {by} ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM a),
o AS (SELECT *, CASE WHEN pm IS NULL OR "start" > pm + {d} THEN 1 ELSE 0 END AS opens FROM m),
i AS (SELECT *, sum(opens) OVER (PARTITION BY {by} ORDER BY "start", "end", opens DESC ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT chrom, min("start") AS "start", max("end") AS "end"{columns} FROM i GROUP BY {by}, island{tail}"""


def _one(name: str, sql: str | None, build: Callable) -> None:
    _add(name, sql, build, "a")


_one("merge_d0", _islands_sql(0, "chrom", ""), lambda s, a: ops.merge(a))
_one("merge_d1000", _islands_sql(1000, "chrom", ""), lambda s, a: ops.merge(a, distance=1000))
_one("merge_count", _islands_sql(0, "chrom", ", count(*) AS count"), lambda s, a: ops.merge(a, count=True))
_one("merge_strand", _islands_sql(0, "chrom, strand", ", strand, count(*) AS count"), lambda s, a: ops.merge(a, strand=True, count=True))
_one(
    "merge_colops",
    _islands_sql(0, "chrom", ", min(score) AS score_min, max(score) AS score_max, median(score) AS score_median, count(score) AS score_count, count(DISTINCT name) AS name_count_distinct, string_agg(name, ',' ORDER BY \"start\", \"end\", name) AS name_collapse, first(name ORDER BY \"start\", \"end\", name) AS name_first, last(name ORDER BY \"start\", \"end\", name) AS name_last"),
    lambda s, a: ops.merge(a, operations={"score": ["min", "max", "median", "count"], "name": ["count_distinct", "collapse", "first", "last"]}),
)
_one("merge_records", _islands_sql(0, "chrom", ", count(*) AS count, avg(score) AS mean_score, CAST(len(list(name)) AS INTEGER) AS n_names"), lambda s, a: ops.merge(a, records=True).select("chrom", "start", "end", "count", "mean_score", F.size("names").alias("n_names")))
_one("merge_tiled", _islands_sql(0, "chrom", ", count(*) AS count"), lambda s, a: ops.merge(a, count=True, tile=100_000))

COVER = f"""+ h AS (SELECT a.id AS aid, greatest(a."start", b."start") AS cs, least(a."end", b."end") AS ce FROM a JOIN b ON {HIT}),
g AS (SELECT *, greatest(0, ce - greatest(cs, coalesce(max(ce) OVER (PARTITION BY aid ORDER BY cs, ce ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), cs))) AS fresh FROM h),
t AS (SELECT aid, count(*) AS n, sum(fresh) AS cov, sum(ce - cs) AS dep FROM g GROUP BY aid),
v AS (SELECT aid, pos, sum(d) AS d FROM (SELECT id AS aid, "start" AS pos, 0 AS d FROM a UNION ALL SELECT id, "end", 0 FROM a UNION ALL SELECT aid, cs, 1 FROM h WHERE cs < ce UNION ALL SELECT aid, ce, -1 FROM h WHERE cs < ce) GROUP BY ALL),
r AS (SELECT aid, pos AS s, lead(pos) OVER w AS e, sum(d) OVER w AS depth FROM v WINDOW w AS (PARTITION BY aid ORDER BY pos)),
hist AS (SELECT aid, depth, sum(coalesce(e - s, 0)) AS bases FROM r JOIN a ON a.id = aid WHERE e IS NOT NULL OR a."start" >= a."end" GROUP BY ALL)
"""
SIZE = '(a."end" - a."start")'
BASIC = COVER + f"SELECT {A}, CASE WHEN {SIZE} > 0 THEN coalesce(n, 0) ELSE 0 END AS n_overlaps, CAST(CASE WHEN {SIZE} > 0 THEN coalesce(cov, 0) ELSE 0 END AS BIGINT) AS bases_covered, {SIZE} AS length, CASE WHEN {SIZE} > 0 THEN CAST(coalesce(cov, 0) AS DOUBLE) / {SIZE} ELSE 0 END AS fraction FROM a LEFT JOIN t ON aid = a.id"
_pair("coverage_basic", BASIC, lambda a, b: ops.coverage(a, b))
_pair("coverage_mean", COVER + f"SELECT {A}, CASE WHEN {SIZE} > 0 THEN CAST(coalesce(dep, 0) AS DOUBLE) / {SIZE} ELSE 0 END AS mean_depth FROM a LEFT JOIN t ON aid = a.id", lambda a, b: ops.coverage(a, b, "mean"))
_pair("coverage_hist", COVER + f"SELECT {A}, CAST(depth AS BIGINT) AS depth, CAST(bases AS BIGINT) AS bases, {SIZE} AS length, CASE WHEN {SIZE} > 0 THEN CAST(bases AS DOUBLE) / {SIZE} ELSE 1 END AS fraction FROM a JOIN hist ON aid = a.id", lambda a, b: ops.coverage(a, b, "hist"))
_pair("coverage_all", COVER + "SELECT 'all' AS chrom, CAST(depth AS BIGINT) AS depth, CAST(sum(bases) AS BIGINT) AS bases, CAST(sum(sum(bases)) OVER () AS BIGINT) AS length, CAST(sum(bases) AS DOUBLE) / CAST(sum(sum(bases)) OVER () AS DOUBLE) AS fraction FROM hist GROUP BY depth", lambda a, b: ops.coverage(a, b, "all"))
_pair(
    "coverage_perbase",
    COVER + 'SELECT aid AS id, CAST(sum(e - s) AS BIGINT) AS n_bases, CAST(sum(depth * (e - s)) AS BIGINT) AS sum_depth, CAST(max(depth) AS BIGINT) AS max_depth, max(e) - any_value(a."start") AS last_offset FROM r JOIN a ON a.id = aid WHERE e IS NOT NULL GROUP BY aid',
    lambda a, b: ops.coverage(a, b, "per_base").groupBy("id").agg(F.count("*").alias("n_bases"), F.sum("depth").alias("sum_depth"), F.max("depth").alias("max_depth"), F.max("offset").alias("last_offset")),
)


def _slop_sql(left: str, right: str) -> str:
    return f"""SELECT * FROM (SELECT a.id, a.chrom, greatest(a."start" - {left}, 0) AS "start", least(a."end" + {right}, size) AS "end", a.name, a.score, a.strand FROM a JOIN genome g ON g.chrom = a.chrom) WHERE "start" < "end" """


_one("slop_both", _slop_sql("500", "500"), lambda s, a: ops.slop(a, genome(s), 500))
_one("slop_lr_strand", _slop_sql("CASE WHEN strand = '-' THEN 20 ELSE 700 END", "CASE WHEN strand = '-' THEN 700 ELSE 20 END"), lambda s, a: ops.slop(a, genome(s), left=700, right=20, strand=True))
_one("slop_pct", _slop_sql('CAST(round(0.25 * (a."end" - a."start")) AS BIGINT)', 'CAST(round(0.25 * (a."end" - a."start")) AS BIGINT)'), lambda s, a: ops.slop(a, genome(s), 0.25, pct=True))
_one(
    "complement",
    """+ u AS (SELECT a.chrom, least("start", size) AS s, least("end", size) AS e FROM a JOIN genome g ON g.chrom = a.chrom UNION ALL SELECT chrom, size, size FROM genome),
p AS (SELECT *, coalesce(max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM u)
SELECT chrom, p AS "start", s AS "end" FROM p WHERE p < s""",
    lambda s, a: ops.complement(a, genome(s)),
)

DEPTH = """+ x AS (SELECT a.chrom, least("start", size) AS s, least("end", size) AS e FROM a JOIN genome g ON g.chrom = a.chrom),
d AS (SELECT chrom, pos, sum(d) AS d, max(k) AS k FROM (
  SELECT chrom, s AS pos, 1 AS d, 0 AS k FROM x WHERE s < e UNION ALL SELECT chrom, e, -1, 0 FROM x WHERE s < e
  UNION ALL SELECT chrom, 0, 0, 1 FROM genome UNION ALL SELECT chrom, size, 0, 1 FROM genome) GROUP BY ALL),
w AS (SELECT chrom, pos AS s, lead(pos) OVER o AS e, CAST(sum(d) OVER o AS BIGINT) AS depth FROM d WHERE d <> 0 OR k = 1 WINDOW o AS (PARTITION BY chrom ORDER BY pos)),
runs AS (SELECT * FROM w WHERE e IS NOT NULL)
"""
_one(
    "genomecov_hist",
    DEPTH + """, t AS (SELECT r.chrom, depth, CAST(sum(e - s) AS BIGINT) AS bases, any_value(size) AS size FROM runs r JOIN genome g ON g.chrom = r.chrom GROUP BY ALL
  UNION ALL SELECT 'genome', depth, CAST(sum(e - s) AS BIGINT), (SELECT CAST(sum(size) AS BIGINT) FROM genome) FROM runs GROUP BY depth)
SELECT chrom, depth, bases, size, CAST(bases AS DOUBLE) / size AS fraction FROM t""",
    lambda s, a: ops.genomecov(a, genome(s)),
)
_one("genomecov_bg", DEPTH + 'SELECT chrom, s AS "start", e AS "end", depth FROM runs WHERE depth > 0', lambda s, a: ops.genomecov(a, genome(s), "bg"))
_one("genomecov_bga", DEPTH + 'SELECT chrom, s AS "start", e AS "end", depth FROM runs', lambda s, a: ops.genomecov(a, genome(s), "bga"))
_one("genomecov_tiled", DEPTH + 'SELECT chrom, s AS "start", e AS "end", depth FROM runs', lambda s, a: ops.genomecov(a, genome(s), "bga", tile=50_000))
_one("genomecov_scale", DEPTH + 'SELECT chrom, s AS "start", e AS "end", CAST(floor(depth * 2.5) AS BIGINT) AS depth FROM runs WHERE depth > 0', lambda s, a: ops.genomecov(a, genome(s), "bg", scale=2.5))
_one(
    "genomecov_perbase",
    DEPTH + "SELECT chrom, depth, CAST(sum(e - s) AS BIGINT) AS n, min(s) + 1 AS first_pos, max(e) AS last_pos FROM runs GROUP BY chrom, depth",
    lambda s, a: ops.genomecov(a, genome(s), "per_base").groupBy("chrom", "depth").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")),
)


def _joint_sql(sets: str) -> str:
    ev = " UNION ALL ".join(f'SELECT chrom, "start" AS pos, {i + 1} AS f, 1 AS d FROM {s} WHERE "start" < "end" UNION ALL SELECT chrom, "end", {i + 1}, -1 FROM {s} WHERE "start" < "end"' for i, s in enumerate(sets))
    sums = ", ".join(f"sum(CASE WHEN f = {i + 1} THEN d ELSE 0 END) AS d{i + 1}" for i in range(len(sets)))
    runs = ", ".join(f"sum(d{i + 1}) OVER o AS c{i + 1}" for i in range(len(sets)))
    return f"+ ev AS (SELECT chrom, pos, {sums} FROM ({ev}) GROUP BY ALL), sw AS (SELECT chrom, pos AS s, lead(pos) OVER o AS e, {runs} FROM ev WINDOW o AS (PARTITION BY chrom ORDER BY pos)), seg AS (SELECT * FROM sw WHERE e IS NOT NULL)\n"


_pair(
    "jaccard",
    _joint_sql("ab") + """, t AS (SELECT *, c1 > 0 AND c2 > 0 AS both2, lag(c1 > 0 AND c2 > 0) OVER (PARTITION BY chrom ORDER BY s) AS was FROM seg),
j AS (SELECT CAST(coalesce(sum(e - s) FILTER (both2), 0) AS BIGINT) AS intersection, CAST(coalesce(sum(e - s) FILTER (c1 > 0 OR c2 > 0), 0) AS BIGINT) AS u, count(*) FILTER (both2 AND NOT coalesce(was, false)) AS n FROM t)
SELECT intersection, u AS "union", CASE WHEN u > 0 THEN CAST(intersection AS DOUBLE) / u ELSE 0 END AS jaccard, n AS n_intersections FROM j""",
    lambda a, b: ops.jaccard(a, b),
)


def _multi_sql(where: str) -> str:
    flags = ", ".join(f"CASE WHEN c{i} > 0 THEN 1 ELSE 0 END AS set{i}" for i in (1, 2, 3))
    return _joint_sql("abc") + f""", fl AS (SELECT chrom, s AS "start", e AS "end", {flags} FROM seg)
SELECT chrom, "start", "end", set1 + set2 + set3 AS n, concat_ws(',', CASE WHEN set1 = 1 THEN '1' END, CASE WHEN set2 = 1 THEN '2' END, CASE WHEN set3 = 1 THEN '3' END) AS list, set1, set2, set3 FROM fl WHERE {where}"""


_add("multiinter3", _multi_sql("set1 + set2 + set3 > 0"), lambda s, *sets: ops.multiinter(sets), "a", "b", "c")
_add("multiinter3_cluster", _multi_sql("set1 + set2 + set3 = 3"), lambda s, *sets: ops.multiinter(sets, cluster=True), "a", "b", "c")


def _order(name: str, order: str, mode: str, use_genome: bool = False, reverse: bool = False) -> None:
    """Sorts return the order as data: the place of each row in the whole output."""

    def build(spark, rows):
        out = ops.sort(rows, mode, genome=backwards(spark) if use_genome else None, reverse=reverse, position="id")
        # ids that rise along the output, counted up by one task; this shows the order, and is no part of sorting
        placed = out.withColumn("_at", F.monotonically_increasing_id())
        return placed.select("id", "chrom", "start", "end", F.row_number().over(Window.orderBy("_at")).alias("rn"))

    _add(name, f'SELECT id, chrom, "start", "end", CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rn FROM s', build, "s")


_order("sort_default", 'chrom, "start", "end", id', "default")
_order("sort_reverse", 'chrom DESC, "start" DESC, "end" DESC, id DESC', "default", reverse=True)
_order("sort_genome", 'CASE WHEN number BETWEEN 4 AND 22 THEN 22 - number ELSE 99 END, chrom, "start", "end", id', "default", use_genome=True)
_order("sort_size_asc", '"end" - "start", chrom, "start", id', "size_asc")
_order("sort_size_desc", '"end" - "start" DESC, chrom, "start", id', "size_desc")
_order("sort_chrom", "chrom, id", "chrom")
_order("sort_natural", 'number, "start", "end", id', "natural")

_pair(
    "interval_distance",
    f'SELECT a.id, b.id AS b_id, {OV} AS shared, CASE WHEN {HIT} THEN 0 WHEN b."end" <= a."start" THEN a."start" - b."end" ELSE b."start" - a."end" END AS distance, a."end" - a."start" AS length FROM a JOIN b ON {HIT}',
    lambda a, b: range_join(a, b).select("id", "b_id", overlap_length("start", "end", "b_start", "b_end").alias("shared"), distance("chrom", "start", "end", "b_chrom", "b_start", "b_end").alias("distance"), length("start", "end").alias("length")),
)
_one(
    "parse_bed",
    'SELECT chrom, "start", "end", name, CAST(floor(score) AS DOUBLE) AS score, strand FROM a',
    lambda s, a: parse_lines(format_bed(a.withColumn("score", F.floor("score").cast("double")))).select("chrom", "start", "end", "name", "score", "strand"),
)
_add(
    "validate_sorted",
    f"""+ p AS (SELECT *, (id * 7919) % 1000003 AS pos FROM s),
f AS (SELECT chrom, "start", pos, lag("start") OVER (PARTITION BY chrom ORDER BY pos) AS before FROM p),
sp AS (SELECT chrom, min(pos) AS lo, max(pos) AS hi FROM p GROUP BY chrom),
ap AS (SELECT *, max(hi) OVER (ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM sp),
g AS (SELECT unnest([{", ".join(f"'{c}'" for c in ORDER)}]) AS chrom, unnest(range({len(ORDER)})) AS o),
pl AS (SELECT *, lag(o) OVER (ORDER BY lo) AS was FROM sp JOIN g USING (chrom)),
r AS (SELECT chrom, pos, 'start position decreases' AS reason FROM f WHERE "start" < before
  UNION ALL SELECT chrom, lo, 'chromosomes are not contiguous' FROM ap WHERE lo < was
  UNION ALL SELECT chrom, lo, 'chromosome is not in the genome' FROM sp WHERE chrom NOT IN (SELECT chrom FROM g)
  UNION ALL SELECT chrom, lo, 'chromosomes are not in genome order' FROM pl WHERE o < was)
SELECT reason, chrom, count(*) AS n, min(pos) AS first_at FROM r GROUP BY ALL""",
    lambda spark, rows: order_faults(rows.withColumn("pos", F.col("id") * 7919 % 1000003), backwards(spark), "pos").groupBy("reason", "chrom").agg(F.count("*").alias("n"), F.min("_pos").alias("first_at")),
    "s",
)
_add("validate_good", "SELECT chrom FROM s WHERE false", lambda spark, rows: order_faults(rows.withColumn("pos", F.row_number().over(Window.orderBy("chrom", "start", "end"))), position="pos").select("chrom"), "s")
_pair(
    "format_fraction",
    COVER + f""", x AS (SELECT a.id, CASE WHEN {SIZE} > 0 THEN CAST(coalesce(cov, 0) AS DOUBLE) / {SIZE} ELSE 0 END AS x FROM a LEFT JOIN t ON aid = a.id)
SELECT id, printf('%.6g', x) AS general,
  CASE WHEN x = 0 THEN '0' WHEN x >= 1e-4 THEN printf('%.6g', x) WHEN x >= 1e-5 THEN rtrim(printf('%.10f', x), '0') ELSE rtrim(printf('%.11f', x), '0') END AS plain FROM x""",
    lambda a, b: ops.coverage(a, b).select("id", general6("fraction").alias("general"), plain6("fraction").alias("plain")),
)

# keys that are null, and strands that are neither + nor -
NULLS = """+ n AS (SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE chrom END AS chrom, "start", "end", name, score, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN 'x' ELSE strand END AS strand FROM a),
m AS (SELECT *, max("end") OVER (PARTITION BY chrom, strand ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM n),
o AS (SELECT *, CASE WHEN pm IS NULL OR "start" > pm THEN 1 ELSE 0 END AS opens FROM m),
i AS (SELECT *, sum(opens) OVER (PARTITION BY chrom, strand ORDER BY "start", "end", opens DESC ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT chrom, min("start") AS "start", max("end") AS "end", strand, count(*) AS count FROM i GROUP BY chrom, strand, island"""


def _odd(df: DataFrame, chrom: bool = False) -> DataFrame:
    out = df.withColumn("strand", F.expr("CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN 'x' ELSE strand END"))
    return out.withColumn("chrom", F.expr("if(id % 7 = 0, NULL, chrom)")) if chrom else out


_one("merge_strand_null", NULLS, lambda s, a: ops.merge(_odd(a, True), strand=True, count=True))
_one("merge_strand_null_tiled", NULLS, lambda s, a: ops.merge(_odd(a, True), strand=True, count=True, tile=100_000))
ODD = "a AS (SELECT * REPLACE (CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN 'x' ELSE strand END AS strand) FROM a0),\nb AS (SELECT * REPLACE (CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN 'x' ELSE strand END AS strand) FROM b0),\nc AS"
for _which, _sign in (("same", "="), ("opposite", "<>")):
    _pair(f"closest_strand_odd_{_which}", _closest_sql(f"strand IS NULL OR b_strand IS NULL OR strand {_sign} b_strand"), lambda a, b, which=_which: ops.closest(_odd(a), _odd(b), strand=which))
    ORACLES[f"closest_strand_odd_{_which}"] = ORACLES[f"closest_strand_odd_{_which}"].replace("\na AS (", "\na0 AS (").replace("\nb AS (", "\nb0 AS (").replace("\nc AS", "\n" + ODD, 1)
_pair("subtract_tiled", _subtract_sql(HIT), lambda a, b: ops.subtract(a, b, tile=50_000))
_pair("closest_tiled", _closest_sql(), lambda a, b: ops.closest(a, b, tile=50_000))
_pair("coverage_tiled", BASIC, lambda a, b: ops.coverage(a, b, tile=50_000))
