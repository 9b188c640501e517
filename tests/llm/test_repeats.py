"""Repeated texts, offsets in texts whose lower case is longer, and the prior of the log-odds."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from costweave.llm import langid, toxicity, trie

from .conftest import prose


def test_a_repeated_text_sends_its_blocks_once(spark):
    rng = random.Random(4)
    text = prose("en", 300, rng)
    rows = [(i, text, "en") for i in range(600)] + [(7, text, "en")] * 400 + [(2000 + i, prose("de", 80, rng), "de") for i in range(30)]
    keyed = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("text", "lang", F.xxhash64(F.lit("crf"), "lang", "text").alias("key"))
    blocks = langid._training_blocks(keyed, {"en": 1, "de": 30}, 400, 16)
    assert sum(lang == "en" for (lang, _, _), _ in blocks) == math.ceil(300 / 64)
    assert sum(lang == "de" for (lang, _, _), _ in blocks) == 30 * 2


def test_places_in_the_text_itself():
    text = "İİİİ vile Straße İx"
    lower = text.lower()
    place = toxicity._places(text, lower)
    for word in ("vile", "Straße"):
        at = lower.index(word.lower())
        assert text[place(at) : place(at + len(word) - 1) + 1] == word
    assert toxicity._places("abc", "abc")(2) == 2


def test_log_odds_by_hand(spark):
    """Rare words count in the totals, and the prior gives each known word, and the rest as one, its least mass."""
    rows = [("vile rotter thing", 1)] * 30 + [("nice thing", 0)] * 60 + [(f"nice rare{chr(97 + i)}xyzzy", 0) for i in range(20)]
    got = toxicity.log_odds(spark.createDataFrame(rows, "text string, toxic int"), min_z=0.0)
    n = (Counter(), Counter())
    for text, label in rows:
        n[label].update(set(re.findall(r"\w+", text)))
    t = [sum(c.values()) for c in n]
    known = {w for w in set(n[0]) | set(n[1]) if n[0][w] + n[1][w] >= 5}
    for w in known:
        prior = 10.0 * (n[0][w] + n[1][w]) / sum(t) + 0.5
        mass = 10.0 + 0.5 * (len(known) + 1)
        logit = [math.log((n[c][w] + prior) / (t[c] + mass - n[c][w] - prior)) for c in (0, 1)]
        assert math.isclose(got[w], logit[1] - logit[0], rel_tol=1e-9), w


def test_ends_over_several_stretches(spark, monkeypatch):
    monkeypatch.setattr(trie, "SEGMENT", 10)
    rows = [(c, 0, "user", "same") for c in range(-25, 60)] + [(None, 0, "user", "same")]
    import hashlib

    made = trie.prefix_trie(trie.sequences(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).where("depth = 1").collect()
    assert [r.ends_sha256 for r in made] == [hashlib.sha256(("," + ",".join(map(str, range(-25, 60)))).encode()).hexdigest()] and made[0].n_convs == 86
