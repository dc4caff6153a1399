"""Toxicity, language identification and language model."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import langid, lm, toxicity
from strandline.llm.common import below, sample_fraction

DOCS = "doc_id long, text string, lang string, score string, k string"  # the last two clash with inner names


def held(i, mod, rest):
    return zlib.crc32(str(i).encode()) % mod == rest


def corpus(n=400, seed=5):
    rng, out, labels = random.Random(seed), [], []
    base = {"xx": ["lorem", "ipsum", "dolor", "amet", "elit"], "yy": ["ñandu", "çedilla", "über", "straße", "éclair"]}
    for i in range(n):
        lang = "xx" if i % 2 else "yy"
        words = [rng.choice(base[lang]) + rng.choice(["", "a", "o", "is"]) + str(rng.randrange(50)) for _ in range(rng.randrange(5, 60))]
        toxic = int(i % 5 == 0)
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["vilest", "vileza", "vilemente", "scumbag"]))
        out.append((i, " ".join(words), lang, "s", "k"))
        labels.append((i, toxic))
    return out, labels


@pytest.fixture(scope="module")
def data(spark):
    docs, labels = corpus()
    docs += [(1000, None, None, None, None), (1001, "", "xx", None, None), (1002, "12 34 !!", "yy", None, None), (None, "lorem ipsum", "xx", None, None), (7, docs[7][1], "xx", None, None), (1003, "lorem " * 30_000, "xx", None, None)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int"), docs, dict(labels)


def test_toxicity(spark, data):
    docs, labels, rows, truth = data
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == held(r.doc_id, 4, 2) for r in got if r.doc_id is not None)
    test = [r for r in got if r.held_out and r.doc_id in truth]
    right = [r.predicted == truth[r.doc_id] for r in test]
    assert np.mean(right) > 0.9, np.mean(right)
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[1000] == by_id[1001]  # the bias alone
    # labels of held-out rows are not learnt from
    other = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {(r.doc_id, r.score) for r in toxicity.toxicity(docs, other).collect()} == {(r.doc_id, r.score) for r in got}
    kept = toxicity.keep_clean(docs, toxicity.fit(docs, labels))
    assert kept.columns == docs.columns and kept.count() < len(rows)


def test_toxicity_without_labels(spark, data):
    docs, labels, rows, _ = data
    assert {r.score for r in toxicity.toxicity(docs, labels.where("false")).collect()} == {0.0}
    assert {r.score for r in toxicity.toxicity(docs, labels.where("toxic = 1")).collect()} == {1.0}
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0


def test_ftrl_matches_a_plain_form():
    model, z, n = toxicity.Ftrl(4), np.zeros(17), np.zeros(17)
    rng = random.Random(1)
    for _ in range(50):
        at, y = np.array(sorted(rng.sample(range(16), 4)) + [16]), rng.randrange(2)
        model.learn(at, y)
        w = np.zeros(17)
        for i in at:
            l1 = 0 if i == 16 else toxicity.L1
            w[i] = 0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((toxicity.BETA + np.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)
        g = 1 / (1 + np.exp(-w[at].sum())) - y
        for i in at:
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / toxicity.ALPHA * w[i]
            n[i] += g * g
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


def test_language(spark, data):
    docs, _, rows, _ = data
    got = langid.language(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    lang = {r[0]: r[2] for r in rows}
    test = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in test]) > 0.97
    by_id = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by_id[1000] == by_id[1001] == by_id[1002] == ("und", 0.0) and by_id[1003][0] == "xx"
    assert {r.lang_pred for r in langid.language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.language(docs.where("false")).count() == 0


def test_rare_languages_are_learnt(spark):
    rows = [(i, f"der hund und die katze {i % 97} laufen über das feld", "de") for i in range(3000)] + [(10_000 + i, f"the dog and the cat {i} run over the field", "en") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, bias, matrix = langid.fit(docs, max_rows=300, least_rows=5)
    assert langs == ["de", "en"] and matrix.shape[1] == len(bias) == 2
    got = {r.lang: r.n for r in docs.join(langid.predict(docs, (langs, bias, matrix)), "doc_id").where("lang = lang_pred").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert got == {"de": 3000, "en": 6}


def test_samples_of_any_fraction(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "k")
    assert ids.where(sample_fraction("k", 1.0)).count() == 20_000
    assert 700 < ids.where(sample_fraction("k", 0.04)).count() < 900
    assert ids.where(sample_fraction("k", 1e-12)).count() == 0
    # of hashes spread over the whole range, a fraction far below one in a million is still told apart
    spread = spark.range(1000).select((F.col("id") * 2_000_000).alias("h"))
    assert spread.where(below(F.col("h"), 1e-10)).count() == 923  # (1 << 63) * 1e-10 is 922,337,203; half of h is compared


def test_packed_arrays_come_back():
    arrays = [np.arange(5, dtype=np.uint16), np.array([1 << 40], np.uint64), np.zeros(0, np.uint8), np.array([7, 255], np.uint8), np.arange(3, dtype=np.uint32)]
    back = lm._unpacked(lm._packed(arrays))
    assert [(a.dtype, a.tolist()) for a in back] == [(a.dtype, a.tolist()) for a in arrays]


def test_grams_and_kernel():
    texts = ["abcab", "ABC", "zzz", "ñandú ñ"]
    sets = [{t.lower()[i : i + n] for n in range(1, langid.MAX_N + 1) for i in range(len(t) - n + 1)} for t in texts]
    got = [langid.grams(t) for t in texts]
    assert [len(g) for g in got] == [len(s) for s in sets]
    want = [[len(x & y) / (len(x) * len(y)) ** 0.5 for y in sets] for x in sets]
    assert np.allclose(langid.kernel(got, got), want, atol=1e-6)


def brute_lm(train):
    """Bigram counts by dictionaries."""
    uni, bi = {}, {}
    for t in train:
        before = "<s>"
        for w in [*(t or "").encode().lower().split(), b"</s>"]:
            uni[w] = uni.get(w, 0) + 1
            bi[before, w] = bi.get((before, w), 0) + 1
            before = w
    return uni, bi


def discounts(counts):
    n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1] if n[1] else 1.0, 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
    return [0.0] + [min(max(x, 0.0), k) for k, x in zip((1, 2, 3), d, strict=True)]


def brute_prob(uni, bi):
    follows = {}
    for _, w in bi:
        follows[w] = follows.get(w, 0) + 1
    d2, d1, v, k = discounts(bi.values()), discounts(follows.values()), len(uni), len(bi)
    g1 = sum(d1[min(c, 3)] for c in follows.values()) / k
    p1 = lambda w: max(follows.get(w, 0) - d1[min(follows.get(w, 0), 3)], 0) / k + g1 / (v + 1)

    def p(h, w):
        own = {x: c for (a, x), c in bi.items() if a == h}
        if not own:
            return p1(w)
        total, c = sum(own.values()), own.get(w, 0)
        return max(c - d2[min(c, 3)], 0) / total + sum(d2[min(c, 3)] for c in own.values()) / total * p1(w)

    return p


@pytest.mark.parametrize("shard_tokens", [lm.SHARD_TOKENS, 40])
def test_language_model(spark, data, monkeypatch, shard_tokens):
    monkeypatch.setattr(lm, "FLUSH", 500)
    docs, _, rows, _ = data
    docs, rows = docs.where("doc_id IS NULL OR doc_id < 60 OR doc_id BETWEEN 1000 AND 1002"), [r for r in rows if r[0] is None or r[0] < 60 or 1000 <= r[0] <= 1002]
    train = docs.where(F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) != 2, F.lit(True)))
    state = lm.train(train, shard_tokens=shard_tokens)
    got = {(r.doc_id, r.n_tokens): r for r in lm.score(docs, state).collect()}
    learnt = [r[1] for r in rows if r[0] is None or not held(r[0], 7, 2)]
    uni, bi = brute_lm(learnt)
    p = brute_prob(uni, bi)
    n = sum(uni.values())
    assert state["N"] == n and state["V"] == len(uni)
    for doc, text, *_ in rows:
        tokens = [*(text or "").encode().lower().split(), b"</s>"]
        r = got[doc, len(tokens)]
        assert r.n_known == sum(w in uni for w in tokens)
        assert r.base_score == pytest.approx(sum(np.log10((uni.get(w, 0) + 1) / (n + len(uni) + 1)) for w in tokens))
        assert r.score == pytest.approx(sum(np.log10(p(h, w)) for h, w in zip(["<s>", *tokens], tokens, strict=False)))
    # the same from a store whose files can't be mapped
    monkeypatch.setattr(lm, "local_path", lambda uri: None)
    far = lm.Model(state)
    assert not far.mapped
    for doc, text, *_ in rows[:5]:
        tokens = lm.token_hashes(text)
        assert far.score([tokens])[2][0] == pytest.approx(got[doc, len(tokens)].score) and not far.open
    vocabulary = [*uni, b"<unk>"]
    for h in ("<s>", next(iter(uni)), b"never"):
        assert sum(p(h, w) for w in vocabulary) == pytest.approx(1)


def test_language_model_query(spark, data):
    docs, _, rows, _ = data
    got = lm.lm_scores(docs).collect()
    assert len(got) == len(rows) and len({r.train_tokens for r in got}) == 1
    none = lm.lm_scores(docs, F.lit(False)).collect()
    assert {(r.score, r.base_score, r.train_tokens) for r in none} == {(0.0, 0.0, 0)}
    assert lm.lm_scores(docs.where("false")).count() == 0
