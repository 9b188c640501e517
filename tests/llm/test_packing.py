import itertools
from collections import Counter, defaultdict

import numpy as np

from costweave.llm import packing


def padded(lengths, counts, bounds):
    return sum(c * min(b for b in bounds if b >= n) for n, c in zip(lengths, counts, strict=True))


def test_bounds_are_optimal():
    rng = np.random.default_rng(2)
    for _ in range(60):
        lengths = sorted(set(rng.integers(0, 40, int(rng.integers(1, 9))).tolist()))
        counts = rng.integers(1, 50, len(lengths)).tolist()
        k = int(rng.integers(1, 5))
        best = min(padded(lengths, counts, [*c, lengths[-1]]) for m in range(k) for c in itertools.combinations(lengths[:-1], m)) if lengths else 0
        bounds = packing.bucket_bounds(lengths, counts, k)
        assert len(bounds) <= k and padded(lengths, counts, bounds) == best
    assert packing.bucket_bounds([], [], 4) == []


def test_batches_hold_every_word_within_the_budget(docs, empty):
    rows = packing.pack(docs, max_length=512, n_buckets=4, token_budget=1024, rows_per_slot=50).collect()
    words, batches = defaultdict(int), Counter()
    for r in rows:
        words[r.doc_id] += r.length
        batches[r.bucket_length, r.batch] += 1
        assert r.length <= r.bucket_length <= 512
    sizes = Counter()
    for d in docs.collect():
        sizes[d.doc_id] += len((d.text or "").split())
    assert words == sizes
    assert all(n * max(1, b) <= 1024 for (b, _), n in batches.items())
    places = Counter((r.bucket_length, r.batch, r.row_in_batch) for r in rows)
    assert max(places.values()) == 1
    for bucket in {r.bucket_length for r in rows}:  # only the last batch of a bucket is not full
        own = sorted((b, n) for (k, b), n in batches.items() if k == bucket)
        assert all(n == max(1, 1024 // max(1, bucket)) for _, n in own[:-1]) and [b for b, _ in own] == list(range(len(own)))
    assert sorted(r.start for r in rows if r.doc_id == 304) == list(range(0, 9000, 512))
    assert packing.pack(empty).count() == 0
