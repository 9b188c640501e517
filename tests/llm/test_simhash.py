import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from costweave.llm import graph, simhash


def groups_of(fps, max_bits):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= max_bits:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("crowd", [1, 16])
@pytest.mark.parametrize("max_bits", [1, 2])
def test_links_connect_exactly_the_near_fingerprints(spark, max_bits, crowd):
    rng = np.random.default_rng(3)
    fps = {int(x) for x in rng.integers(0, 1 << 62, 30)}
    center = int(rng.integers(0, 1 << 62))
    for _ in range(60):  # a crowded neighbourhood and chains that leave it
        bits = rng.choice(64, int(rng.integers(0, 5)), replace=False)
        fps.add(center ^ sum(1 << int(b) for b in bits))
    signed = {f - (1 << 64) if f >> 63 else f for f in fps}
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = simhash.near_links(df, max_bits, crowd)
    assert all((a ^ b).bit_count() <= max_bits or ((a ^ b) & ((1 << 64) - 1)).bit_count() <= max_bits for a, b in links.collect())
    got = dict(graph.components(links).collect())
    mask = (1 << 64) - 1
    want = groups_of([f & mask for f in signed], max_bits)
    for a, b in itertools.combinations(signed, 2):
        assert (got.get(a, a) == got.get(b, b)) == (want[a & mask] == want[b & mask])


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(10, 40)] + [(7, 7), (41, 42), (42, 41)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 5 for i in range(10, 40)) and got[42] == 41
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=80))
def test_fingerprint_against_a_plain_count(text):
    from xxhash import xxh64_intdigest

    words = [w.lower() if w.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
    pieces = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxh64_intdigest(p.encode(), 42) for p in pieces]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0
    assert simhash.text_fingerprint(text) == want


def test_edge_rows(docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[300].fingerprint == "0" * 16 and by_id[301].component_id == by_id[302].component_id == 300
    assert by_id[305].component_id == 4 and by_id[306].component_id == 6
    assert simhash.near_duplicates(empty).count() == 0


def test_components_of_more_edges_than_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(graph, "_CHUNK", 20)
    rng = np.random.default_rng(8)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 300, size=(180, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect())
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_variants_meet_by_shuffles_not_by_a_broadcast_of_exploded_rows(spark, tmp_path, monkeypatch):
    spark.range(3000).selectExpr("xxhash64(id) AS fp").write.parquet(str(tmp_path / "fps"))
    plans = []

    def staged(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(simhash, "staged", staged)
    links = simhash.near_links(spark.read.parquet(str(tmp_path / "fps")))
    plans.append(links._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 2 and not any("Broadcast" in p for p in plans)
