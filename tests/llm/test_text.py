"""Near dedup, line dedup, pieces, licenses, decontamination, pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import decontam, license, linededup, neardup, pieces
from strandline.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = [("digest", "x"), ("sig", "y"), ("region", "z"), ("pieces", "p"), ("_drop_lines", "d")]


def frame(spark, texts, start=0):
    return spark.createDataFrame([(i + start, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def sets(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(texts, n, percent=80):
    s, root = [sets(t, n) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] and s[j] and 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def noisy(rng, words, share):
    return " ".join(rng.choice("uvwxyz") * 3 + str(rng.randrange(99)) if rng.random() < share else w for w in words)


@pytest.fixture(scope="module")
def near_texts():
    rng, out = random.Random(3), []
    for g in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 40, 150]))]
        out += [" ".join(base)] * rng.choice([1, 3]) + [noisy(rng, base, rng.choice([0.01, 0.03, 0.05])) for _ in range(rng.choice([0, 2, 12]))]
    out += ["", None, "  \n ", "one two", "One  TWO", "one", "É é", "é É", "a b c d", "A b c\nd"]
    rng.shuffle(out)
    return out


def test_near_duplicates(spark, near_texts, monkeypatch):
    df = frame(spark, near_texts)
    for k, v in EXTRA:
        df = df.withColumn(k, F.lit(v))
    for n in (4, 5):
        got = {r.doc_id: r for r in neardup.near_duplicates(df, n).collect()}
        assert [got[i].component_id for i in range(len(near_texts))] == brute_components(near_texts, n)
        assert all(got[i].n_shingles == len(sets(t, n)) and got[i].kept == (got[i].component_id == i) for i, t in enumerate(near_texts))
    kept = neardup.near_dedup(df)
    assert kept.columns == df.columns and kept.count() == len(set(brute_components(near_texts, 5)))


def test_near_duplicates_dense_regions(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base)] + [noisy(rng, base, 0.012) for _ in range(160)] + [noisy(rng, base, 0.8) for _ in range(10)]
    want = brute_components(texts, 4)
    monkeypatch.setattr(neardup, "REGION", 24)
    monkeypatch.setattr(neardup, "CLUSTER", 40)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, texts), 4).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_near_duplicates_hub_of_a_crowd(spark, monkeypatch):
    """Near copies that are linked only through one text, which is neither the smallest id nor the most copied."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(240)]
    texts = []
    for i in range(220):
        words = list(base)
        for k, at in enumerate(rng.sample(range(0, 236, 4), 6)):
            words[at + 3] = f"v{i}x{k}"
        texts.append(" ".join(words))
    texts.insert(150, " ".join(base))
    want = brute_components(texts, 4)
    assert len(set(want)) == 1 and len(set(brute_components(texts[:150] + texts[151:], 4))) > 200
    for size, weight in ((24, neardup.WEIGHT), (neardup.REGION, 6000)):
        monkeypatch.setattr(neardup, "REGION", size)
        monkeypatch.setattr(neardup, "CLUSTER", size)
        monkeypatch.setattr(neardup, "WEIGHT", weight)
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, texts), 4).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_near_duplicates_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, None), (3, "a b c d e")], "doc_id long, text string")
    got = sorted((tuple(r) for r in neardup.near_duplicates(df, 4).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (2, 0, 2, True), (3, 2, 1, False)], key=str)
    assert neardup.near_duplicates(df.where("false"), 4).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    root = {n: n for e in edges for n in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(n, n) == r for n, r in root.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    star = spark.range(1, 500).selectExpr("1000 AS a", "id AS b").unionAll(spark.range(0, 400).selectExpr("2000 AS a", "3000 + id AS b"))
    assert {(r.node < 2000, r.root) for r in components(star).collect()} == {(True, 1), (False, 2000)}
    with pytest.raises(RuntimeError, match="settle"):
        components(spark.range(40).selectExpr("id AS a", "id + 1 AS b"), max_rounds=1)


LONG = " ".join(f"passage{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))


def test_line_dedup(spark):
    texts = [
        f"alpha beta gamma delta one\n{LONG}\nown line of the first text", f"{LONG}\nanother line that stands here alone", None, "", "short line", "short line",
        "user 17 logged in from host 4", "user 99 logged in from host 123\n\nand a line of its own here", f"{LONG.replace('passageha', 'changed')}\nyet another line that is different",
        "wholly repeated text of some words", "wholly repeated text of some words", "in one text the same line\nin one text the same line",
    ]
    df = frame(spark, texts).withColumn("line", F.lit(1)).withColumn("_drop_lines", F.lit("x"))
    got = {r.doc_id: r.text for r in linededup.line_dedup(df).collect()}
    assert got[0] == texts[0] and got[1] == "another line that stands here alone" and got[2] is None and got[3] == ""
    assert got[4] == got[5] == "short line" and got[6] == texts[6]
    assert got[7] == "\nand a line of its own here" and got[8] == "yet another line that is different"
    assert got[9] == texts[9] and 10 not in got and got[11] == texts[11]
    out = linededup.line_dedup(df, keep_empty=True)
    assert out.columns == df.columns and {r.doc_id: r.text for r in out.collect()}[10] == ""
    assert {r.doc_id: r.lines for r in linededup.dropped(df).collect()} == {1: [0], 7: [0], 8: [0], 10: [0]}
    assert {r.doc_id for r in linededup.dropped(df, min_docs=3).collect()} == {1, 8}
    assert linededup.line_dedup(df.where("false")).count() == 0


def brute_recurring(texts, similar=80, least=5):
    """Lines to drop: links within a leaf, followed to the end, a template at a time."""
    rows = []
    for doc, text in enumerate(texts):
        for no, line in enumerate((text or "").lower().split("\n")):
            w = ["<*>" if any(c in "0123456789" for c in t) else t for t in line.split()]
            if len(w) >= least:
                rows.append((doc, no, w))
    root = list(range(len(rows)))
    for i, (_, _, x) in enumerate(rows):
        for j, (_, _, y) in enumerate(rows[:i]):
            if len(x) == len(y) and x[:3] == y[:3] and 100 * sum(a == b for a, b in zip(x, y, strict=True)) >= similar * len(x):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    first = {}
    for r, (doc, _, _) in zip(root, rows, strict=True):
        first[r] = min(first.get(r, doc), doc)
    return {(doc, no) for r, (doc, no, _) in zip(root, rows, strict=True) if doc != first[r]}


def test_line_dedup_matches_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: rng.choice("bcdfg") + rng.choice("aeiou") + rng.choice(["k", "l", "m", "4"])
    base = [word() for _ in range(9)]
    lines = [" ".join(["same", "first", "words", *[word() if rng.random() < 0.2 else w for w in base]]) for _ in range(120)]
    lines += [" ".join(["same", "first", "words", *[word() for _ in range(rng.choice([2, 9]))]]) for _ in range(80)]
    lines += [" ".join(["Same", "first", rng.choice(["w", "W", "v"]), rng.choice("ab"), rng.choice("ab")]) for _ in range(12)]
    texts = [f"{x}\nown{i} own{i}\n{rng.choice(lines)}" for i, x in enumerate(lines)]
    want = brute_recurring(texts)
    assert 100 < len(want) < 400
    df = frame(spark, texts)
    for size, weight in ((linededup.LEAF, linededup.WEIGHT), (30, linededup.WEIGHT), (6, linededup.WEIGHT), (linededup.LEAF, 300)):
        monkeypatch.setattr(linededup, "LEAF", size)
        monkeypatch.setattr(linededup, "WEIGHT", weight)
        assert {(r.doc_id, r.line_no) for r in linededup.recurring(df).collect()} == want


def test_bit_map_grows_with_the_leaves():
    assert [linededup.bits_for(n) for n in (0, 1 << 18, 1 << 20, 1 << 40)] == [23, 24, 26, 27]


def test_line_templates_have_variable_places(spark):
    users, hosts = ["ann", "bob", "eve", "joe"], ["oak", "elm", "fir"]
    texts = [f"login page shows user {u} on host {h} at port {22 + i} today" for i, (u, h) in enumerate((u, h) for u in users for h in hosts)]
    (row,) = linededup.template_texts(frame(spark, texts)).collect()
    assert row.tokens == "login page shows user <*> on host <*> at port <*> today".split() and row.n_lines == 11


TEXTS = ["Hello world\nfoo ▁bar  baz 日本語 ü🙂 \n\n end ", "", None, "a" * 200, " ", "\n", "▁", "\0 x", "naïve café ﬁ \t tab\r\n", "word " * 5000]


def test_pieces_round_trip(spark):
    df = frame(spark, TEXTS).withColumn("pieces", F.lit("old")).withColumn("decoded", F.lit("old"))
    rows = {r.doc_id: r for r in pieces.sentencepiece(df).collect()}
    again = {r.doc_id: r.pieces for r in pieces.encode(df.repartition(3)).collect()}
    other = {r.doc_id: r.pieces for r in pieces.encode(df, seed=5).collect()}
    for i, t in enumerate(TEXTS):
        assert rows[i].decoded == t and rows[i].text == t
        assert (rows[i].pieces is None) == (t is None) and again[i] == rows[i].pieces
    assert rows[1].pieces == [] and other[9] != rows[9].pieces
    assert pieces.sentencepiece(df.where("false")).count() == 0


def test_pieces_follow_the_lattice():
    v = pieces.Vocabulary(pieces._model_bytes(pieces.MODEL))
    lattices = pieces.Lattices(v)

    def paths(s):
        if not s:
            yield (), 0.0
            return
        for n in range(1, len(s) + 1):
            i = v.ids.get(s[:n].replace(" ", "▁"))
            if i is not None:
                for p, w in paths(s[n:]):
                    yield (i, *p), w - pieces.ALPHA * np.log(i + 2)
        for p, w in paths(s[1:]):
            yield (int(v.byte_id[ord(s[0])]), *p), w - pieces.ALPHA * np.log(v.size + 2)

    want = {}
    for p, w in paths(" hello"):
        want[p] = want.get(p, 0) + np.exp(w)
    n, total = 20_000, sum(want.values())
    codes, counts = lattices.sample([" hello"] * n, np.arange(n, dtype=np.uint64) * np.uint64(7919))
    at, seen = np.concatenate([[0], np.cumsum(counts)]), {}
    for i in range(n):
        key = tuple(codes[at[i] : at[i + 1]].tolist())
        seen[key] = seen.get(key, 0) + 1 / n
    assert set(seen) <= set(want)
    assert all(abs(seen.get(p, 0) - w / total) < 0.015 for p, w in want.items())


def test_license(spark):
    mit = next(t for i, t in license.KNOWN if i == "MIT" and len(t) > 500)
    texts = [mit.replace("<year> <copyright holders>", "2020 A. Person").upper(), "code\nReleased under the MIT licence\nmore", "nothing", None, "", "LICENSED under the Apache-License; version 2.0", "Released under the MIT License of old"]
    got = {(r.doc_id, r.license_id, r.unit): r.n_units for r in license.license_scan(frame(spark, texts).withColumn("digest", F.lit(1))).collect()}
    assert got == {(0, "MIT", "text"): 1, (0, "MIT", "line"): 1, (1, "MIT", "line"): 1, (5, "Apache-2.0", "text"): 1, (5, "Apache-2.0", "line"): 1}
    own = spark.createDataFrame([("X", "Own text."), ("Y", "own  TEXT")], "license_id string, text string")
    assert license.license_scan(frame(spark, ["own text"]), own).count() == 4
    assert license.license_scan(frame(spark, ["a"]).where("false")).count() == 0


def test_license_texts_wrapped_and_marked(spark):
    import textwrap

    by = {}
    for name, t in license.KNOWN:
        by.setdefault(name, []).append(t)
    bsd, header = by["BSD-3-Clause"][-1], by["GPL-3.0-or-later"][0]
    wrap = lambda t, mark="": "\n".join(textwrap.fill(p, 60, initial_indent=mark, subsequent_indent=mark) or mark for p in t.split("\n"))
    texts = [
        wrap(bsd).replace("<year>, <copyright holder>", "2019 Jane Doe").replace("copyright notice", "copyright  notice"), "Some code\n\n" + wrap(header, "# ") + "\n#\n# Copyright Jane Doe\n\nmore code",
        "while strings are read\nwhilst strings are read", "c major 7 is a chord", "# Copyright 2001 X\n" + wrap(by["Apache-2.0"][-2], "// "),
    ]
    got = {(r.doc_id, r.license_id, r.unit) for r in license.license_scan(frame(spark, texts)).collect()}
    assert (0, "BSD-3-Clause", "text") in got and (1, "GPL-3.0-or-later", "paragraph") in got and (4, "Apache-2.0", "text") in got
    assert not {d for d, *_ in got} & {2, 3}
    kept = frame(spark, texts).select(F.flatten(license.normal_paragraphs(F.col("text"))).alias("x")).collect()
    assert kept[2].x == ["while strings are read"] * 2 and kept[3].x == ["c major 7 is a chord"]


def test_license_digests_of_long_texts(spark):
    import os

    folder, names = "/usr/share/common-licenses", {"Apache-2.0": "Apache-2.0", "GPL-3.0": "GPL-3", "GPL-2.0": "GPL-2", "MPL-2.0": "MPL-2.0", "LGPL-2.1": "LGPL-2.1", "CC0-1.0": "CC0-1.0"}
    have = {i: f"{folder}/{n}" for i, n in names.items() if os.path.exists(f"{folder}/{n}")}
    if not have:
        pytest.skip("no licence texts here")
    docs = frame(spark, [open(p).read().upper() for p in have.values()])
    got = {r.license_id for r in license.license_scan(docs).collect() if r.unit == "text"}
    assert got == set(have)


ITEM = "A train with 12 wagons leaves Boston for Paris and needs 3 hours to travel 240 km before the driver called Tom stops the train with 12 wagons for good"


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, "Short item here"), (3, None), (4, ""), (1, ITEM)], "item_id long, text string")
    other = ITEM.replace("12", "77").replace("Boston", "Lima").replace("240 km", "9 miles").replace("Tom", "Ann")
    broken = other.replace("77", "78", 1)
    texts = [f"Before it. {ITEM}. After it.", f"xx yy {other} zz", f"xx yy {broken} zz", ITEM.lower(), " ".join(ITEM.split()[:10]), None, "", "we saw a short item here today", "The train is late and nobody knows why.", " ".join(ITEM.split()[8:])]
    df = frame(spark, texts).withColumn("h", F.lit(1)).withColumn("slots", F.lit("x"))
    got = {(r.doc_id, r.item_id): r.kind for r in decontam.contaminated(df, bench).collect()}
    assert got[0, 1] == "verbatim" and got[1, 1] == "template" and (2, 1) not in got and got[9, 1] == "verbatim"
    assert got[7, 2] == "verbatim" and got[3, 1] == "verbatim" and not {4, 5, 6, 8} & {d for d, _ in got}
    kept = decontam.decontaminate(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(range(10)) - {d for d, _ in got}
    assert decontam.contaminated(df, bench.where("false")).count() == 0 and decontam.contaminated(df.where("false"), bench).count() == 0


def test_decontamination_slots_of_other_lengths(spark):
    question = "So if Tom pays 900 dollars for lunch in Paris and then 30 dollars for a taxi, how much does Tom have left of 2000 dollars"
    bench = spark.createDataFrame([(1, question), (1, "An entirely different question with the same id")], "item_id long, text string")
    texts = [
        question.replace("900", "1,250.50").replace("Paris", "New York City").replace("Tom", "Ann Lee").replace("30", "two million").replace("2000", "one"), "so an entirely different question with the same id",
        question.replace("900", "7").replace("Tom", "Ann", 1).replace("Paris", "Rome").replace("30 ", "4 ").replace("2000", "55"), "So if nobody pays for lunch, how much is left",
    ]
    got = {(r.doc_id, r.item_id): r.kind for r in decontam.contaminated(frame(spark, texts), bench).collect()}
    assert got == {(0, 1): "template", (1, 1): "verbatim"}


def test_pipeline_drops_copies_in_other_capitals(spark, tmp_path):
    import corpus_pipeline

    short = "What is the capital of France today"
    spark.createDataFrame([(1, ITEM), (2, short), (3, "Blue Moon")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = [f"(a) {short}", f"Title\n{short}", ITEM.upper(), ITEM.title(), ITEM.lower(), short.lower(), "a blue\nmoon rose", "What is the capital of Spain", "blue and moon", None, ""]
    kept = corpus_pipeline.decontamination(spark, frame(spark, texts), str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {7, 8, 9, 10}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    clean = [" ".join(rng.choice(["sun", "moon", "star", "sky", "sea"]) + str(rng.randrange(10**6)).translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(40)) for _ in range(62)]
    clean, extra = clean[:60], clean[60:]
    texts = clean + [clean[0], noisy(rng, clean[1].split(), 0.02)] + [f"{LONG}\n{x}" for x in extra] + [f"{' '.join(clean[4].split()[:20])} {ITEM}"] + ["vile scum words " + x for x in clean[5:9]]
    toxic = set(range(len(texts) - 4, len(texts)))
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i in toxic)) for i in range(len(texts))], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(range(60)) <= set(rows) and 60 not in rows and 64 not in rows
    assert all(r.text == r.decoded for r in rows.values()) and LONG in rows[62].text and LONG not in rows[63].text
