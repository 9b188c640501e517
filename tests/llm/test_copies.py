import itertools
import random

import pytest

import corpus_pipeline
from costweave.llm import simhash
from costweave.llm import copies as near

from .conftest import prose, row


def brute(texts, min_similarity=0.8):
    """Smallest id of every id's component by the similarity of all pairs."""
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {}
    for i, text in texts.items():
        words = (text or "").lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    for a, b in itertools.combinations(texts, 2):
        x, y = sets[a], sets[b]
        if (len(x & y) / len(x | y) if x or y else 1.0) >= min_similarity:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i: find(i) for i in texts}


def edited(text, n, rng):
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def copies(spark, docs):
    rng = random.Random(3)
    rows = [row(i, prose("en", rng.randint(30, 200), rng)) for i in range(40)]
    rows += [row(100 + 10 * i + k, edited(rows[i][1], k, rng)) for i in range(40) for k in range(1, 6)]
    hot = prose("de", 100, rng)
    rows += [row(1000 + i, edited(hot, i % 4, rng)) for i in range(60)]  # a crowd, partly not near its leader
    chain = prose("fr", 120, rng)
    for i in range(30):  # each near the one before, the ends far apart
        chain = edited(chain, 1, rng)
        rows.append(row(2000 + i, chain))
    return spark.createDataFrame([*rows, row(3000, None), row(3001, " "), row(3002, "a b"), row(3003, "A b")], docs.schema)


@pytest.mark.parametrize("crowd", [1, 16])
def test_groups_against_all_pairs(copies, empty, crowd):
    got = {r.doc_id: r.component_id for r in near.near_groups(copies, crowd=crowd).collect()}
    assert got == brute({r.doc_id: r.text for r in copies.collect()})
    assert near.near_groups(empty).count() == 0


def test_the_stage_drops_near_copies_beyond_two_bits(spark, copies):
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, copies, "").collect()}
    texts = {r.doc_id: r.text for r in copies.collect()}
    groups = brute(texts)
    assert kept == set(groups.values())
    far = [i for i, g in groups.items() if (simhash.text_fingerprint(texts[i]) ^ simhash.text_fingerprint(texts[g])).bit_count() > 2]
    assert len(far) > 20 and not kept & set(far)


def test_bands_and_rare_shingles_meet_by_shuffles_not_by_a_broadcast_of_exploded_rows(spark, tmp_path):
    spark.range(300).selectExpr("id AS node", "id % 7 AS key", "id + 5 AS size").write.parquet(str(tmp_path / "keyed"))
    keyed = spark.read.parquet(str(tmp_path / "keyed"))
    plan = near._sized_pairs(keyed, keyed, 0.8)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
