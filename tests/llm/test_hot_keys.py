"""Rows with a null id, or one id many times, are counted before they are dealt into slots."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from costweave.llm import mixing, packing


@pytest.fixture
def hot(spark):
    null_ids = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("four words of text").alias("text"), F.lit("a").alias("source"))
    one_id = spark.range(2000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("w "), F.repeat(F.lit("w "), (F.col("id") % 3).cast("int"))).alias("text"), F.lit("b").alias("source"))
    others = spark.range(100, 600).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x "), (F.col("id") % 11).cast("int")).alias("text"), F.lit(None).cast("string").alias("source"))
    return null_ids.union(one_id).union(others).repartition(5)


@pytest.mark.parametrize("run", [8, 4096])
def test_pack(hot, monkeypatch, run):
    monkeypatch.setattr(packing, "_RUN", run)
    rows = packing.pack(hot, max_length=64, n_buckets=3, token_budget=128, rows_per_slot=200).collect()
    sizes = hot.select("doc_id", F.size(F.filter(F.split(F.trim("text"), " "), lambda w: w != "")).alias("n")).collect()
    assert Counter((r.doc_id, r.length) for r in rows) == Counter((r.doc_id, r.n) for r in sizes)
    places = Counter((r.bucket_length, r.batch, r.row_in_batch) for r in rows)
    assert max(places.values()) == 1
    for bucket, per_batch in {(r.bucket_length, max(1, 128 // max(1, r.bucket_length))) for r in rows}:
        own = sorted(b * per_batch + i for k, b, i in places if k == bucket)
        assert own == list(range(len(own)))


@pytest.mark.parametrize("run", [8, 4096])
def test_mix(hot, monkeypatch, run):
    monkeypatch.setattr(mixing, "_RUN", run)
    rows = mixing.mix(hot, rows_per_slot=200).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in hot.collect())
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5 * max(r["size"] for r in own)
    again = mixing.mix(hot.repartition(3), rows_per_slot=200).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    got = mixing.mixed_documents(hot, rows_per_slot=200)
    assert Counter(r.doc_id for r in got.collect()) == Counter({k: n for k, n in _copies(rows).items() if n})


def _copies(rows):
    n = Counter()
    for r in rows:
        n[r.doc_id] += r.copies
    return n
