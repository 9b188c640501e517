import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from costweave.llm import gbt, langid, quality, toxicity
from costweave.llm.common import fold

from .conftest import prose, row


def brute_segments(scores):
    """Maximal scoring segments by definition: recursively the best segment, then left and right of it."""
    if not len(scores):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    best = max(((total[j] - total[i], -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    if best[0] <= 1e-12:
        return []
    i = -int(best[2])
    j = i - int(best[1])
    left, right = brute_segments(scores[:i]), brute_segments(scores[j:])
    return left + [(i, j)] + [(a + j, b + j) for a, b in right]


def test_segments_match_the_definition():
    rng = np.random.default_rng(0)
    for _ in range(300):
        scores = rng.normal(-0.3, 1.5, int(rng.integers(0, 25)))
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(scores)] == brute_segments(scores)


def test_toxic_words_are_learned_and_found(spark, empty):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        text, toxic = prose("en", rng.randint(20, 80), rng), i % 4 == 0
        if toxic:
            words = text.split()
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vilest", "rotter", "scumbag"]))
            text = " ".join(words)
        rows.append((i, text, int(toxic)))
    rows += [(600, None, 0), (601, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.where(fold(F.col("doc_id")) != 0))
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    held = [r for r in df.where(fold(F.col("doc_id")) == 0).collect()]
    assert np.mean([(got[r.doc_id].score >= 0.5) == bool(r.toxic) for r in held]) > 0.97
    assert got[600].passages == [] and got[601].score < 0.5
    hit = next(r for r in held if r.toxic and got[r.doc_id].passages)
    span = got[hit.doc_id].passages[0]
    assert any(w in hit.text[span.start : span.end] for w in ("vilest", "rotter", "scumbag"))
    assert toxicity.score(empty, model).count() == 0
    nothing = toxicity.train(df.where("false"))
    assert 0 <= toxicity.score(df.limit(1), nothing).first().score <= 1


def test_trees_flatten_and_separate():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    trees = gbt.train(x[:2000], y[:2000], n_trees=60)
    assert ((trees.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95

    def walk(row, t):
        k = 0
        while trees.feature[t, k] >= 0:
            k = trees.left[t, k] + int(row[trees.feature[t, k]] > trees.threshold[t, k])
        return trees.value[t, k]

    some = x[2000:2020]
    assert np.allclose(trees.raw(some), [trees.bias + sum(walk(r, t) for t in range(60)) for r in some])
    assert np.allclose(gbt.train(x[:0], y[:0]).probability(x[:3]), 0.5) and gbt.train(x[:9], np.ones(9)).probability(x[:1])[0] > 0.8


def test_quality_learns_from_statistics(spark, empty):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(500):
        good = i % 3 != 0
        text = prose("en", rng.randint(20, 60), rng)
        rows.append(row(i, text if good else " ".join(w + rng.choice(["%%%", "***", "!!"]) for w in text.split())))
        labels.append((i, int(good)))
    rows += [row(900, None), row(901, ""), row(902, " \n")]
    df, marks = spark.createDataFrame(rows, empty.schema), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score(df, marks).collect()}
    held = [r.doc_id for r in df.where((fold(F.col("doc_id")) == 0) & (F.col("doc_id") < 900)).collect()]
    assert np.mean([(got[i] >= 0.3) == (i % 3 != 0) for i in held]) > 0.97
    assert got[900] == got[901] and quality.score(empty, marks).count() == 0
    assert (quality.text_statistics("a b") == quality.text_statistics("a b")).all() and not quality.text_statistics("  ").any()


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    k = 3
    for n in (1, 2, 5):
        s, start, moves = rng.normal(size=(n, k)), rng.normal(size=k), rng.normal(size=(k, k))
        want = np.zeros((n, k))
        for path in itertools.product(range(k), repeat=n):
            p = np.exp(start[path[0]] + sum(s[t, path[t]] for t in range(n)) + sum(moves[path[t], path[t + 1]] for t in range(n - 1)))
            for t in range(n):
                want[t, path[t]] += p
        want /= want.sum(axis=1, keepdims=True)
        assert np.allclose(langid.marginals(s, np.array([n]), start, moves), want)


def test_marginals_do_not_depend_on_blocks():
    rng = np.random.default_rng(1)
    k, lengths = 4, np.array([0, 64, 1, 200, 129, 0])
    s, start, moves = rng.normal(size=(lengths.sum(), k)), rng.normal(size=k), rng.normal(size=(k, k))
    got, at = langid.marginals(s, lengths, start, moves), 0
    for n in lengths:
        alone = langid.marginals(s[at : at + n], np.array([n]), start, moves)
        e, m = np.exp(s[at : at + n]), np.exp(moves)
        f, b = np.zeros((n, k)), np.ones((n, k))
        for t in range(n):
            f[t] = (np.exp(start) if t == 0 else f[t - 1] @ m) * e[t]
            f[t] /= f[t].sum()
        for t in range(n - 2, -1, -1):
            b[t] = m @ (e[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        want = f * b / np.maximum((f * b).sum(axis=1, keepdims=True), 1e-300)
        assert np.allclose(got[at : at + n], want) and np.allclose(alone, want)
        at += n


def test_languages_of_whole_and_mixed_texts(spark, docs, empty):
    model = langid.train(docs, docs_per_language=60)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    truth = {r.doc_id: r.lang for r in docs.where("doc_id < 240").collect()}
    assert np.mean([got[i].lang_pred == lang for i, lang in truth.items()]) > 0.97
    assert {got[i].lang_pred for i in (300, 301, 302, 303)} == {"und"} and got[300].score == 0.0
    rng = random.Random(9)
    mixed = spark.createDataFrame([row(1, prose("en", 40, rng) + " " + prose("de", 60, rng))], docs.schema)
    parts = {p.lang: p.words for p in langid.predict(mixed, model).first().languages}
    assert parts["en"] >= 30 and parts["de"] >= 50
    assert langid.predict(empty, model).count() == 0
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {300, 301, 302, 303}
    nothing = langid.train(empty)
    assert nothing.languages == [] and langid.predict(docs, nothing).first().lang_pred == "und"


@pytest.mark.parametrize("n", [0, 1])
def test_one_language_or_none(spark, docs, n):
    model = langid.train(docs.where("lang = 'en'").limit(40 * n))
    assert {r.lang_pred for r in langid.predict(docs.where("doc_id < 9"), model).collect()} == ({"en"} if n else {"und"})


def test_a_clean_text_in_three_languages_stays(spark, docs):
    model = langid.train(docs, docs_per_language=60)
    rng = random.Random(4)
    mixed = spark.createDataFrame([row(1, " ".join(prose(x, 40, rng) for x in ("en", "de", "fr")))], docs.schema)
    assert langid.predict(mixed, model).first().score < 0.4
    assert langid.keep_known(mixed, model).count() == 1


def test_every_language_has_words_and_a_label(spark):
    rows = [(70 * k + i, " ".join(f"{chr(97 + i // 26)}{chr(97 + i % 26)}{x}" for x in ("ong", "urm", "ike")), f"l`{i}.x") for i in range(70) for k in range(6)]
    languages, words = langid.lexicon(spark.createDataFrame(rows, "doc_id long, text string, lang string").select("text", "lang"))
    assert len(languages) == 70 and len(words) == 210
    assert {(w, languages[j]) for w, js in words.items() for j in js} == {(w, lang) for _, text, lang in rows for w in text.split()}
    index, _, first = langid.word_features(["aaong", "crike", "none"], words, 70)
    marked = [{int(v) - langid._BUCKETS for v in index[a:b] if v >= langid._BUCKETS} for a, b in itertools.pairwise(first)]
    assert marked == [set(words["aaong"]), set(words["crike"]), set()]


def test_scale_takes_all_calibration_rows(spark):
    import zlib

    ids = [i for i in range(20_000) if zlib.crc32(str(i).encode()) % 5 == 4][:1301]
    texts = ["the vile of in on at by so"] * 1000 + ["the of vile vile vile at by so in on no to"] * 300
    rows = [(i, t, 0) for i, t in zip(ids, texts, strict=False)] + [(ids[-1], "vile vile vile", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").coalesce(1)
    model = toxicity.train(df, seed_odds={"vile": 2.0})
    scores = np.array([1.5 if w == "vile" else -0.5 for t in texts for w in t.split()])
    assert abs(np.exp(model.scale * scores).mean() - 1) < 1e-6
