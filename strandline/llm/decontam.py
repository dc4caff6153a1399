"""Benchmark decontamination by template windows.

Words (runs of letters and digits; a comma or point between two digits is left out first) become
template tokens: those with a digit and number words ``<NUM>``, a unit after a number ``<UNIT>``, a
capitalised word inside a sentence ``<NAME>``, the rest themselves in lower case. A run of numbers or of names is one token,
so "900" and "1,250", or "Paris" and "New York", fill one slot each. Windows of five template tokens of
documents and benchmark items meet in a hash join; windows of fewer than two plain words tell nothing
and are left out, unless an item has no others. Windows of the plain lower-case words meet likewise. A document holds an item

- ``verbatim`` if lower-case windows that it shares with the item are at least ``percent`` percent
  of the item's, at whatever distance, or ``run`` of them at one distance between places;
- ``template`` if the same number of template windows at one distance agree and their slots are consistent: at that distance each
  value of the item's slots stands for one value of the document.

DataFrame functions only. Defined cases: null or empty texts hold nothing; items of fewer words than
a window have one window of all their words, met by documents' windows of that many words; repeated
rows of a document or item add nothing; of different texts under one item_id each is looked for, and the one with most
matches is told; extra columns are not read; an empty table gives no rows. Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, files_for

WINDOW, PERCENT, RUN, PLAIN = 5, 80, 9, 2
MOST_BROADCAST = 1_000_000

# Units of measure and number words.
UNITS = "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees mph kmh".split()
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()


SPACE = r"\x09-\x0D\x20"
NAME_MARK = "\x01"
NAME_AT = rf"([^.!?:{SPACE}])([{SPACE}]+[^\p{{L}}{SPACE}]*)(\p{{Lu}})"  # a capital inside a sentence
MARKS = ".,"  # left out between two digits, one kind after the other
BETWEEN = rf"[^\p{{L}}\p{{N}}{NAME_MARK}]+"


def _marked(text: Column) -> Column:
    """Lower case, with a mark before words that were capitalised inside a sentence."""
    return F.lower(F.regexp_replace(text, NAME_AT, f"$1$2{NAME_MARK}$3"))


def _words(marked: Column) -> Column:
    return F.array_remove(F.split(marked, BETWEEN), "")


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _kinds(words: str) -> Column:
    """Template tokens of the array ``words``, in which every digit is 0; runs are not folded yet."""
    number = lambda x: f"(contains({x}, '0') OR {x} IN ({_quoted(NUMBERS)}))"
    kind = f"""CASE WHEN {number("x")} THEN '<NUM>' WHEN i > 0 AND x IN ({_quoted(UNITS)}) AND {number(f"{words}[i - 1]")} THEN '<UNIT>'
      WHEN startswith(x, '{NAME_MARK}') THEN '<NAME>' ELSE x END"""
    return F.expr(f"transform({words}, (x, i) -> {kind})")


def _opens(kinds: str, x: str, i: str) -> str:
    """Whether the token ``x`` at ``i`` is the first of its run."""
    return f"({i} = 0 OR {x} NOT IN ('<NUM>', '<NAME>') OR {kinds}[{i} - 1] <> {x})"


def _zeroed(x: Column) -> Column:
    """Every digit 0, no mark inside a number."""
    x = F.translate(x, "123456789", "000000000")
    for mark in MARKS:
        x = F.replace(x, F.lit(f"0{mark}0"), F.lit("00"))
    return x


def _unmarked(x: Column) -> Column:
    """The same marks left out, digits kept."""
    for mark in MARKS:
        x = F.regexp_replace(x, rf"([0-9])\{mark}([0-9])", "$1$2")
    return x


def tokenised(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, raw, template``: arrays of equal length; a run's words are joined by spaces."""
    marked = df.select(*keys, _marked(F.col(text).cast("string")).alias("m"))
    words = marked.select(*keys, _words(_unmarked(F.col("m"))).alias("w"), _words(_zeroed(F.col("m"))).alias("z"))
    kinds = words.select(*keys, F.transform("w", lambda x: F.translate(x, NAME_MARK, "")).alias("w"), _kinds("z").alias("k"))
    opens = kinds.select(*keys, "w", "k", F.expr(f"filter(transform(k, (x, i) -> if({_opens('k', 'x', 'i')}, i, -1)), i -> i >= 0)").alias("s"))
    raw = F.expr("transform(s, (p, j) -> array_join(slice(w, p + 1, coalesce(get(s, j + 1), size(w)) - p), ' '))")
    return opens.select(*keys, raw.alias("raw"), F.expr("transform(s, p -> k[p])").alias("template"))


def _items(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """``item_id, v, text``: the different texts of each item, told apart by ``v``."""
    return benchmark.select(F.col(key).alias("item_id"), F.col(text).cast("string").alias("text")).where("item_id IS NOT NULL").withColumn("v", F.xxhash64("text")).dropDuplicates(["item_id", "v"])


def item_windows(benchmark: DataFrame, window: int, key: str, text: str) -> DataFrame:
    """Template windows of the benchmark with ``total``, the number of an item's windows that count."""
    tokens = tokenised(_items(benchmark, key, text), ["item_id", "v"], "text").where("size(raw) > 0").withColumn("n", F.expr(f"least({window}, size(raw))"))
    cut_out = """explode(transform(sequence(0, size(raw) - n), i -> named_struct('i_at', i, 'kinds', slice(template, i + 1, n), 'i_raw', slice(raw, i + 1, n),
      'good', size(filter(slice(template, i + 1, n), t -> NOT t LIKE '<%')) >= least({}, n))))""".format(PLAIN)
    w = tokens.select("item_id", "v", "n", F.expr(cut_out).alias("x")).select("item_id", "v", "n", "x.*")
    counts = w.groupBy("item_id", "v").agg(F.sum(F.col("good").cast("long")).alias("goods"), F.count("*").alias("every"))
    joined = w.join(counts, ["item_id", "v"]).where("good OR goods = 0")
    hashed = F.transform("kinds", lambda t: F.xxhash64(t))
    return joined.select("item_id", "v", "n", "i_at", "kinds", "i_raw", F.when(F.col("goods") > 0, F.col("goods")).otherwise(F.col("every")).alias("total"), hashed.alias("t"))


def _combined(array: str, n: int, at: str) -> str:
    """Hash of ``n`` token hashes from place ``at``."""
    return "xxhash64(" + ", ".join(f"{array}[{at} + {k}]" for k in range(n)) + ")"


def _meet(hashed: DataFrame, items: DataFrame, sizes: list[int], small: bool) -> DataFrame:
    """Windows of ``hashed`` (doc_id, t: hashes of tokens) that are windows of ``items`` (n, h and more), with ``at``, their place."""
    run = lambda n, x: f"CASE WHEN size(t) >= {n} THEN transform(sequence(0, size(t) - {n}), i -> {x.format(_combined('t', n, 'i'))})"
    own = F.broadcast(items) if small else items
    # no filter on the windows: it would move below them and hash every text twice
    if len(sizes) == 1:  # as a rule; bare hashes are cheaper than rows with their size
        windows = hashed.select("doc_id", F.expr(f"posexplode({run(sizes[0], '{}')} END)")).withColumnsRenamed({"pos": "at", "col": "h"})
        return windows.join(own, "h")
    runs = [run(n, f"named_struct('n', {n}, 'at', i, 'h', {{}})") + " ELSE array() END" for n in sizes]
    windows = hashed.select("doc_id", F.expr(f"explode_outer(concat({', '.join(runs)}))").alias("x")).select("doc_id", "x.*")
    return windows.join(own, ["n", "h"])


def _hash_of(n: str, sizes: list[int]) -> Column:
    """Hash of the first ``n`` hashes of the array ``t``."""
    return F.expr("CASE " + " ".join(f"WHEN {n} = {k} THEN {_combined('t', k, '0')}" for k in sizes) + " END")


def _sizes(items: DataFrame) -> tuple[list[int], bool]:
    """Window sizes of the items (``window`` at most), and whether the items are few enough for a broadcast (else the join is left to the planner)."""
    rows = items.groupBy("n").count().collect()
    return sorted(r["n"] for r in rows), sum(r["count"] for r in rows) <= MOST_BROADCAST


def _enough(n: str, percent: int, run: int | None = None) -> Column:
    return F.col(n) * 100 >= F.col("total") * percent if run is None else (F.col(n) * 100 >= F.col("total") * percent) | (F.col(n) >= run)


def _templates(documents: DataFrame, benchmark: DataFrame, window: int, percent: int, run: int) -> DataFrame:
    """``doc_id, item_id, v, matched, total`` by template windows; ``documents`` are doc_id, text."""
    items = cut(item_windows(benchmark, window, "item_id", "text"), files_for(benchmark))
    sizes, small = _sizes(items)
    none = documents.select("doc_id").where(F.lit(False))
    if not sizes:
        return none.select("doc_id", F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id"), *[F.lit(0).cast("long").alias(c) for c in ("v", "matched", "total")])
    kinds = documents.select("doc_id", _words(_zeroed(_marked(F.col("text")))).alias("z")).select("doc_id", _kinds("z").alias("k"))
    folded = kinds.select("doc_id", F.expr(f"filter(k, (x, i) -> {_opens('k', 'x', 'i')})").alias("k"))
    hashed = folded.select("doc_id", F.transform("k", lambda x: F.xxhash64(x)).alias("t"))
    met = cut(_meet(hashed, items.select("item_id", "v", "n", "i_at", _hash_of("n", sizes).alias("h")), sizes, small).select("doc_id", "at", "item_id", "v", "i_at"), files_for(documents))
    again = documents.join(met.select("doc_id").distinct(), "doc_id", "left_semi")
    places = met.join(F.broadcast(items.drop("t")) if small else items.drop("t"), ["item_id", "v", "i_at"])
    listed = places.groupBy("doc_id").agg(F.collect_set(F.struct("at", "item_id", "v", "i_at", "n", "total", "kinds", "i_raw")).alias("hits"))  # no more than a document has windows, for each item that shares them
    cut_out = F.expr("explode(transform(hits, x -> named_struct('x', x, 'raw', slice(raw, x.at + 1, x.n))))")
    hits = tokenised(again, ["doc_id"], "text").select("doc_id", "raw").join(listed, "doc_id").select("doc_id", cut_out.alias("y")).select("doc_id", "y.x.*", F.col("y.raw").alias("slots"))
    per_shift = hits.withColumn("shift", F.col("at") - F.col("i_at")).groupBy("doc_id", "item_id", "v", "total", "shift").agg(
        F.size(F.collect_set("i_at")).alias("matched"),
        F.array_distinct(F.flatten(F.collect_set(F.expr("filter(arrays_zip(kinds, i_raw, slots), x -> x.kinds LIKE '<%')")))).alias("pairs"),
    )
    consistent = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda x: F.struct(x["kinds"], x["i_raw"]))))
    best = per_shift.where(consistent).groupBy("doc_id", "item_id", "v", "total").agg(F.max("matched").cast("long").alias("matched"))
    return best.where(_enough("matched", percent, run)).select("doc_id", "item_id", "v", "matched", F.col("total").cast("long").alias("total"))


def _plain(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, t``: hashes of the lower-case words."""
    words = df.select(*keys, F.array_remove(F.split(F.lower(F.col("text")), r"[^\p{L}\p{N}]+"), "").alias("w"))
    return words.select(*keys, F.transform("w", lambda x: F.xxhash64(x)).alias("t"))


def _copies(documents: DataFrame, benchmark: DataFrame, window: int, percent: int, run: int) -> DataFrame:
    """``doc_id, item_id, v, matched, total`` by windows of lower-case words, whatever the capitals and what stands before them."""
    hashed = _plain(_items(benchmark, "item_id", "text"), ["item_id", "v"]).where("size(t) > 0").withColumn("n", F.expr(f"least({window}, size(t))"))
    places = hashed.select("item_id", "v", "n", (F.size("t") - F.col("n") + 1).alias("total"), F.expr("posexplode(transform(sequence(0, size(t) - n), i -> slice(t, i + 1, n)))")).withColumnsRenamed({"pos": "i_at", "col": "t"})
    places = cut(places, files_for(benchmark))
    sizes, small = _sizes(places)
    if not sizes:
        return documents.select("doc_id", F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id"), *[F.lit(0).cast("long").alias(c) for c in ("v", "matched", "total")]).where(F.lit(False))
    items = places.select("item_id", "v", "n", "total", "i_at", _hash_of("n", sizes).alias("h"))
    met = _meet(_plain(documents, ["doc_id"]), items, sizes, small)
    per_shift = met.groupBy("doc_id", "item_id", "v", "total", (F.col("at") - F.col("i_at")).alias("shift")).agg(F.collect_set("i_at").alias("own"))
    found = per_shift.groupBy("doc_id", "item_id", "v", "total").agg(F.max(F.size("own")).alias("best"), F.size(F.array_distinct(F.flatten(F.collect_set("own")))).cast("long").alias("matched"))
    return found.where(_enough("matched", percent) | (F.col("best") >= run)).select("doc_id", "item_id", "v", "matched", F.col("total").cast("long").alias("total"))


def contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = PERCENT, run: int = RUN, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, matched, total, kind`` of each document and each item that it holds; ``verbatim`` goes before ``template``."""
    known = documents.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id IS NOT NULL")
    items = benchmark.select(F.col(item_key).alias("item_id"), F.col(item_text).alias("text"))
    found = None
    for order, kind, of in ((1, "verbatim", _copies), (0, "template", _templates)):
        one = of(known, items, window, percent, run).select("doc_id", "item_id", F.struct(F.lit(order).alias("order"), "matched", "total", F.lit(kind).alias("kind")).alias("x"))
        found = one if found is None else found.unionByName(one)
    return found.groupBy("doc_id", "item_id").agg(F.max("x").alias("x")).select("doc_id", "item_id", "x.matched", "x.total", "x.kind")


def decontaminate(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """``documents`` without those that hold a benchmark item."""
    bad = contaminated(documents, benchmark, key=key, **options).select(F.col("doc_id").alias(key)).distinct()
    return documents.join(bad, key, "left_anti").select(documents.columns)


def oracle() -> str:
    """The same over DuckDB views."""
    listed = lambda words: ", ".join(f"'{w}'" for w in words)
    number = lambda x: f"(regexp_matches({x}, '[0-9]') OR {x} IN ({listed(NUMBERS)}))"
    kinds = f"""list_transform(range(1, len(w) + 1), lambda i: CASE WHEN {number("w[i]")} THEN '<NUM>'
      WHEN i > 1 AND w[i] IN ({listed(UNITS)}) AND {number("w[i - 1]")} THEN '<UNIT>' WHEN starts_with(w[i], chr(1)) THEN '<NAME>' ELSE w[i] END)"""
    ids = {"item": "item_id, v", "doc": "doc_id"}

    def tokens(name: str, source: str) -> str:
        key = ids[name]
        marked = f"lower(regexp_replace(text, '{NAME_AT}', '\\1\\2' || chr(1) || '\\3', 'g'))"
        for mark in MARKS:
            marked = f"regexp_replace({marked}, '([0-9])[{mark}]([0-9])', '\\1\\2', 'g')"
        return f"""{name}_w AS (SELECT {key}, list_filter(string_split_regex({marked}, '[^\\p{{L}}\\p{{N}}\\x01]+'), lambda x: x <> '') AS w FROM {source}),
{name}_k AS (SELECT {key}, list_transform(w, lambda x: replace(x, chr(1), '')) AS w, {kinds} AS k FROM {name}_w WHERE len(w) > 0),
{name}_s AS (SELECT *, list_filter(range(1, len(k) + 1), lambda i: i = 1 OR k[i] NOT IN ('<NUM>', '<NAME>') OR k[i - 1] <> k[i]) AS s FROM {name}_k),
{name} AS (SELECT {key}, list_transform(range(1, len(s) + 1), lambda j: array_to_string(w[s[j]:coalesce(s[j + 1] - 1, len(w))], ' ')) AS r, list_transform(s, lambda p: k[p]) AS t FROM {name}_s),
{name}_l AS (SELECT {key}, l FROM (SELECT {key}, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS l FROM {source}) WHERE len(l) > 0)"""

    return f"""
WITH bench AS (SELECT DISTINCT item_id, text, hash(text) AS v FROM benchmark WHERE item_id IS NOT NULL),
docs AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL),
{tokens("item", "bench")},
{tokens("doc", "docs")},
i1 AS (SELECT item_id, v, n, k AS i_at, t[k:k + n - 1] AS tw, r[k:k + n - 1] AS iw FROM (SELECT *, least({WINDOW}, len(r)) AS n, unnest(range(1, len(r) - least({WINDOW}, len(r)) + 2)) AS k FROM item)),
i2 AS (SELECT *, len(list_filter(tw, lambda x: x NOT LIKE '<%')) >= least({PLAIN}, n) AS good FROM i1),
i3 AS (SELECT *, count(*) FILTER (good) OVER (PARTITION BY item_id, v) AS goods, count(*) OVER (PARTITION BY item_id, v) AS every FROM i2),
items AS (SELECT *, CASE WHEN goods > 0 THEN goods ELSE every END AS total FROM i3 WHERE good OR goods = 0),
d AS (SELECT doc_id, n, k AS d_at, t[k:k + n - 1] AS tw, r[k:k + n - 1] AS dw FROM (SELECT *, unnest(range(1, len(r) - n + 2)) AS k FROM doc, (SELECT DISTINCT n FROM items) WHERE len(r) >= n)),
hits AS (SELECT d.doc_id, i.item_id, i.v, i.total, i.n, i_at, d_at - i_at AS shift, dw, iw, i.tw FROM d JOIN items i ON d.n = i.n AND d.tw = i.tw),
ps AS (SELECT doc_id, item_id, v, total, shift, count(DISTINCT i_at) AS n FROM hits GROUP BY ALL),
pairs AS (SELECT DISTINCT doc_id, item_id, v, shift, tw[k] AS kind, iw[k] AS iv, dw[k] AS dv FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM hits) WHERE tw[k] LIKE '<%'),
ok AS (SELECT doc_id, item_id, v, shift, count(*) = count(DISTINCT (kind, iv)) AS ok FROM pairs GROUP BY ALL),
best AS (SELECT doc_id, item_id, v, total, max(n) AS matched FROM ps LEFT JOIN ok USING (doc_id, item_id, v, shift) WHERE coalesce(ok, true) GROUP BY ALL),
li AS (SELECT item_id, v, n, len(l) - n + 1 AS total, k AS i_at, l[k:k + n - 1] AS lw FROM (SELECT *, least({WINDOW}, len(l)) AS n, unnest(range(1, len(l) - least({WINDOW}, len(l)) + 2)) AS k FROM item_l)),
ld AS (SELECT doc_id, n, k AS d_at, l[k:k + n - 1] AS lw FROM (SELECT *, unnest(range(1, len(l) - n + 2)) AS k FROM doc_l, (SELECT DISTINCT n FROM li) WHERE len(l) >= n)),
lh AS (SELECT d.doc_id, i.item_id, i.v, i.total, i_at, d_at - i_at AS shift FROM ld d JOIN li i ON d.n = i.n AND d.lw = i.lw),
ls AS (SELECT doc_id, item_id, v, total, max(n) AS best FROM (SELECT doc_id, item_id, v, total, shift, count(DISTINCT i_at) AS n FROM lh GROUP BY ALL) GROUP BY ALL),
lm AS (SELECT doc_id, item_id, v, total, count(DISTINCT i_at) AS matched FROM lh GROUP BY ALL),
found AS (
  SELECT doc_id, item_id, 1 AS o, matched, total, 'verbatim' AS kind FROM ls JOIN lm USING (doc_id, item_id, v, total) WHERE matched * 100 >= total * {PERCENT} OR best >= {RUN}
  UNION ALL SELECT doc_id, item_id, 0, matched, total, 'template' FROM best WHERE matched * 100 >= total * {PERCENT} OR matched >= {RUN})
SELECT doc_id, item_id, matched, total, kind FROM found QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY o DESC, matched DESC, total DESC) = 1"""
