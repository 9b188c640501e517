import hashlib

import numpy as np
import pytest

from costweave.llm import imatch


@pytest.mark.parametrize("n_ranges", [1, 3, 16])
def test_edits_follow_the_next_lower_id(docs, n_ranges):
    one = docs.dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text or "" for r in one.collect()}
    ids = sorted(texts, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    rows = imatch.compare_with_edits(one, n_ranges=n_ranges).collect()
    assert sorted(r.doc_id for r in rows) == sorted(ids)
    for r in rows:
        a, b = texts[r.doc_id], texts[after[r.doc_id]]
        new = a[: len(a) - len(a) // 3] + b[: len(a) // 3]
        assert (r.n_chars, r.edited_sha256) == (len(a), hashlib.sha256(new.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    prints = {}
    for r in rows:
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint


def test_repeated_and_null_ids_and_empty_tables(spark, docs, empty):
    assert imatch.compare_with_edits(empty).count() == 0 and imatch.fingerprints(empty).count() == 0
    assert imatch.fingerprints(docs).count() == docs.count()
    df = spark.createDataFrame([(1, "a b c"), (1, "d e f"), (None, "x y z"), (None, None)], "doc_id long, text string")
    rows = imatch.compare_with_edits(df, n_ranges=4).collect()
    assert len(rows) == 4
    assert imatch.compare_with_edits(df.limit(1), n_ranges=4).first().near_next == 1.0


def test_likeness_falls_with_the_edit():
    rng = np.random.default_rng(0)
    vocabulary = [f"word{i}" for i in range(3000)]
    lexicon = np.unique(np.concatenate([imatch.text_terms(w) for w in vocabulary]))
    near, far = [], []
    for _ in range(60):
        words = rng.choice(vocabulary, 150).tolist()
        light, other = words[:135] + rng.choice(vocabulary, 15).tolist(), rng.choice(vocabulary, 150).tolist()
        p = [imatch.fingerprint(t, imatch.text_terms(t), lexicon) for t in (" ".join(words), " ".join(light), " ".join(other))]
        near.append(imatch.likeness(p[0], p[1]))
        far.append(imatch.likeness(p[0], p[2]))
        assert imatch.likeness(p[0], p[0]) == 1.0
    assert np.mean(near) > 0.6 and np.mean(far) < 0.15


def test_lexicon_band_counts_documents(spark):
    rows = [(i, " ".join(["common"] + (["middle"] if i % 10 == 0 else []) + [f"rare{i}"] * 3)) for i in range(100)]
    got = imatch.lexicon_terms(spark.createDataFrame(rows, "doc_id long, text string"), min_share=0.05, max_share=0.5)
    assert got.tolist() == imatch.text_terms("middle").tolist()
