from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from costweave.llm import mixing


def plain_targets(sizes, cap=3):
    """The excess over the limit is shared again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        for s in list(free):
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(free):
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = float(cap * sizes[s])
                free.discard(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 500, None: 3}, {"a": 100}, {"a": 5, "b": 1, "c": 1000, "d": 40, "e": 0}, {"x": 0}])
def test_targets_are_shared_until_none_is_above(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_mix_meets_targets_and_is_stable(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    taken, target, biggest = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        biggest[r.source] = max(biggest[r.source], r["size"])
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 0.5 * biggest[s])
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mix(empty).count() == 0


def test_tilt_follows_base_rates(spark):
    df = spark.createDataFrame([(i, "w " * 10, "a", 1.0 if i % 2 else 0.25) for i in range(100)] + [(200, "w " * 1000, "b", 1.0)], "doc_id long, text string, source string, base double")
    rows = mixing.mix(df, base_col="base").where("source = 'a'").collect()
    rates = {r.doc_id % 2: r.rate for r in rows}
    assert rates[1] == pytest.approx(min(3.0, 4 * rates[0])) and sum(r.rate * 10 for r in rows) == pytest.approx(rows[0].target)


def test_documents_of_the_mix(docs):
    plan = mixing.mix(docs).groupBy("doc_id").agg(F.sum("copies").alias("n")).where("n > 0")
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    assert dict(got.groupBy("doc_id").count().collect()) == dict(plan.collect())
