"""Rows that once broke an operator, and bounds that no longer cut anything."""

import random
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from costweave.llm import chat, common, copies, gbt, langid, mixing, packing, pii, simhash, tiff, toxicity

from .conftest import prose, row
from .test_pii import corpus


def test_long_words_are_read_to_their_end():
    stem = "abcdefghij" * 5
    index, strength, first = langid.word_features([stem + "ung", "kurz", stem + "tion"], {}, 0)
    ends = [set(index[a + 4 : a + 8]) for a, b in zip(first[:-1], first[1:], strict=True)]
    assert not ends[0] & ends[2] and np.diff(first).tolist() == [8 + 53, 8 + 4, 8 + 54]
    assert strength[first[0] + 8 : first[1]].sum() == pytest.approx(2.0)
    alone = langid.word_features(["kurz"], {}, 0)
    assert (index[first[1] : first[2]] == alone[0]).all()


def test_seventy_languages_of_any_name(spark):
    names = ["EN", "en", "word", "l`1.x", *(f"x{i}" for i in range(66))]
    rng = random.Random(2)
    words = {n: ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(6)) for _ in range(12)] for n in names}
    rows = [(100 * k + i, " ".join(rng.choice(words[n]) for _ in range(30)), n) for i, n in enumerate(names) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, docs_per_language=12)
    got = {r.doc_id: r.lang_pred for r in langid.predict(df, model).collect()}
    assert len(model.languages) == 70 and np.mean([got[i] == n for i, _, n in rows]) > 0.95
    held = [(i, n) for i, _, n in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i] == n for i, n in held]) > 0.9


def test_learning_does_not_depend_on_partitions(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        text = prose("en", rng.randint(10, 40), rng) + (" vilest rotter scumbag" if i % 4 == 0 else "") + f" w{i % 7}"
        rows.append((i, text, int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    models = [toxicity.train(df.repartition(n).orderBy(F.rand(n)), max_calibration_rows=50) for n in (1, 3, 7)]
    assert len({(m.scale, m.size, m.weights, tuple(sorted(m.odds.items()))) for m in models}) == 1


def test_samples_are_bounded_by_distinct_rows(spark):
    df = spark.range(20_000).select((F.col("id") % 4000).alias("doc_id"), F.lit("t").alias("text")).union(spark.range(5000).select(F.lit(None).cast("long"), F.lit("same")))
    assert common.hash_sample(df, 10_000).count() == 4001
    got = [common.hash_sample(df.repartition(n), 300) for n in (2, 5)]
    assert 200 < got[0].count() < 400 and got[0].count() == got[0].distinct().count()
    assert sorted(map(str, got[0].collect())) == sorted(map(str, got[1].collect()))
    assert common.hash_sample(df.limit(0), 5).count() == 0


def test_a_shared_folder_is_needed_on_a_cluster():
    class Context:
        master, applicationId = "spark://host:7077", "a"
        _jsc = type("J", (), {"sc": lambda s: type("S", (), {"getCheckpointDir": lambda s: type("O", (), {"isDefined": lambda s: False})()})()})()

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": lambda s, k, d: d})()

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())


def test_long_runs_take_no_time():
    for text in ("0" * 10**6 + "1.1.1.1", "a" * 10**6 + "@ x", "a@" + "b" * 10**6, "a@b." * 250_000, "1 " * 500_000, "+1(" * 300_000):
        began = time.time()
        pii.candidate_spans(text)
        assert time.time() - began < 8  # a square would take hours
    assert pii.base_spans("0" * 5000 + "1.1.1.1") == [(0, 1, 5007)]


def test_recall_of_added_spans_by_kind(spark, docs):
    rng = random.Random(8)
    model = pii.train(corpus(spark, docs.schema))
    digits = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))
    card = lambda: (c := "4" + digits(14)) + next(str(k) for k in range(10) if pii.luhn(c + str(k)))

    def dotted():
        c = card()
        return f"{c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]}"

    planted = {  # written in ways, and among words, that training texts do not have
        "email": [f"please answer {prose('en', 1, rng)}{i} (at) server{i}.org soon" for i in range(60)],
        "ip": ["seen from " + ":".join(f"{rng.randrange(1 << 16):x}" for _ in range(8)) + " at night" for _ in range(60)],
        "card": [f"paid with {dotted()} last week" for _ in range(60)],
        "phone": [f"reach me under 0{digits(3)}/{digits(7)} in the evening" for _ in range(60)],
    }
    for k, texts in planted.items():
        df = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], docs.schema)
        hit = sum(any(s.kind == k and not s.base for s in r.spans) for r in pii.find_pii(df, model).collect())
        assert hit >= 0.9 * len(texts), (k, hit)


def test_hostile_tiff_is_an_error_row(spark):
    good = tiff.write_tiff([np.zeros((4, 4), np.uint8)], description=b"d")

    def changed(tag, kind=None, count=None, value=None):
        data = bytearray(good)
        (at,) = struct.unpack_from("<I", data, 4)
        for i in range(struct.unpack_from("<H", data, at)[0]):
            place = at + 2 + 12 * i
            if struct.unpack_from("<H", data, place)[0] == tag:
                for offset, form, v in ((2, "<H", kind), (4, "<I", count), (8, "<I", value)):
                    if v is not None:
                        struct.pack_into(form, data, place + offset, v)
        return bytes(data)

    bombs = [changed(270, kind=3), changed(256, count=0), changed(256, value=400_000), changed(257, value=400_000_000), changed(277, value=60_000), changed(278, value=0), changed(279, count=0), changed(258, kind=11), changed(256, kind=2)]
    both = bytearray(changed(256, value=400_000))
    rows = [(i, b) for i, b in enumerate([*bombs, bytes(both), good * 2, good[:30] + good])]
    got = tiff.tiff_pages(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    assert {r.doc_id for r in got} == set(range(len(rows)))
    assert all(r.error is None or r.pixels is None for r in got) and sum(r.error is not None for r in got) >= 8


@pytest.mark.parametrize("kind,predictor,order,planar", [("bool", 2, "<", False), ("uint16", 2, ">", False), ("float32", 3, "<", False), ("float64", 3, ">", True), ("int32", 2, "<", True)])
def test_samples_of_other_kinds(spark, kind, predictor, order, planar):
    page = (np.random.default_rng(1).normal(size=(19, 23, 2)) * 40).astype(kind)
    media = tiff.write_tiff([page], tiff.LZW, predictor, rows_per_strip=5, planar=planar, order=order)
    r = tiff.tiff_pages(spark.createDataFrame([(1, media)], "doc_id long, media binary")).first()
    plain = page.astype(np.uint8) if kind == "bool" else page
    assert bytes(r.pixels) == plain.astype(plain.dtype.newbyteorder("<")).tobytes() and r.bits == (1 if kind == "bool" else 8 * page.dtype.itemsize) and r.error is None


def test_published_lzw_stream():
    # The example of the format's description, codes Clear 7 258 8 8 258 6 6 End in nine bits.
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    stream = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_unpack(stream, 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_null_conversations_and_very_long_turns(spark):
    schema = "conv_id long, turn long, role string, text string, msg_id string, score string"
    rows = [(None, 0, "user", "q", "x", "y"), (None, 1, "assistant", "a" * 300_000, "x", "y"), (1, 0, "user", None, "x", "y")]
    got = {r.conv_id: r for r in chat.read_back(chat.format_reply_trees(chat.turn_chain(spark.createDataFrame(rows, schema)))).collect()}
    assert set(got) == {None, 1} and got[None].loss_chars == 300_000 and got[None].n_turns == 2
    tree = spark.createDataFrame([(None, 1, None, "user", "a", 0.0), (None, 2, 1, "assistant", "b", 1.0), (None, None, None, "user", "c", 0.5)], "conv_id long, msg_id long, parent_id long, role string, text string, score double")
    assert sorted(r.formatted for r in chat.format_reply_trees(tree, n_branches=3).collect()) == ["<s>[INST] a [/INST] b</s>", "<s>[INST] c [/INST]"]


def test_clashing_columns_stay(spark, docs):
    extra = "mix_key known redacted copy_node copy_times sample_hash MIX_COPIES".split()
    df = docs.where("doc_id < 40").select("*", *(F.lit(f"own {c}").alias(c) for c in extra))
    model = langid.train(docs, docs_per_language=40)
    for out in (mixing.mixed_documents(df), langid.keep_known(df, model), pii.redact(df), copies.without_near_copies(df)):
        assert out.columns == df.columns and out.select(*extra).distinct().collect() == df.select(*extra).distinct().collect()


def test_a_budget_below_one_piece_is_refused(docs):
    with pytest.raises(ValueError, match="token_budget"):
        packing.pack(docs, max_length=500, token_budget=100)


def test_near_copies_with_null_and_repeated_ids(spark, docs):
    rng = random.Random(6)
    a, b, c = (prose("en", 60, rng) for _ in range(3))
    rows = [row(None, a), row(5, a), row(5, a), row(7, b), row(7, c), row(None, c), row(None, "alone but whole " + prose("de", 30, rng)), row(None, None), row(None, "")]
    kept = copies.without_near_copies(spark.createDataFrame(rows, docs.schema)).collect()
    texts = sorted(((r.doc_id is None, r.doc_id or 0, (r.text or "")[:5]) for r in kept), key=str)
    assert texts == sorted([(False, 5, a[:5]), (False, 7, b[:5]), (False, 7, c[:5]), (True, 0, "alone"), (True, 0, "")], key=str)


def test_a_passage_in_many_texts_makes_no_pairs_of_them(spark, docs):
    rng = random.Random(12)
    passage = prose("fr", 120, rng)
    rows = [row(i, passage + " " + " ".join(f"own{i}x{k}" for k in range(rng.randint(20, 60)))) for i in range(120)]
    near = [row(1000 + i, rows[i][1] + " end") for i in range(10)]
    df = spark.createDataFrame(rows + near, docs.schema)
    got = {r.doc_id: r.component_id for r in copies.near_groups(df, crowd=4).collect()}
    from .test_copies import brute

    assert got == brute({r[0]: r[1] for r in rows + near})


def test_hot_fingerprints_are_broadcast(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") < 25_000, 1).otherwise(F.col("id")).cast("long").alias("fp"), F.col("id").alias("doc_id"))
    groups = rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("component_id"))
    got = simhash.with_groups(rows, groups, "fp", 40_000)
    assert got.count() == 40_000 and got.where("component_id = 0").count() == 25_000


def test_first_tree_takes_the_best_cut():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, size=(300, 3)).astype(float)
    y = (x[:, 1] + rng.normal(0, 2, 300) > 6).astype(float)
    trees = gbt.train(x, y, n_trees=1, depth=1, rate=1.0)
    p = 1 / (1 + np.exp(-trees.bias))
    g, h = y - p, np.full(300, p * (1 - p))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1) + g[~m].sum() ** 2 / (h[~m].sum() + 1)
    best = max((gain(x[:, f] <= c), f, c) for f in range(3) for c in range(12) if 10 <= (x[:, f] <= c).sum() <= 290)
    assert gain(x[:, trees.feature[0, 0]] <= trees.threshold[0, 0]) == pytest.approx(best[0]) and trees.feature[0, 0] == best[1]
    left = x[:, best[1]] <= trees.threshold[0, 0]
    for node, m in ((trees.left[0, 0], left), (trees.left[0, 0] + 1, ~left)):
        assert trees.value[0, node] == pytest.approx(g[m].sum() / (h[m].sum() + 1))
