import random

import pytest
from pyspark.sql import functions as F

from costweave.functions import columns as C
from costweave.operators import panel, quantiles


@pytest.mark.parametrize("n", [0, 1, 2, 7, 101, 30_000])
def test_percentiles_equal_the_built_in(spark, n):
    rng = random.Random(n)
    rows = [(("a", "b", None)[i % 3 if n > 3 else 0], rng.choice([rng.gauss(0, 1), 0.5, None, float(rng.randrange(5))])) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    wanted = {f"p{i}": (F.col("x"), p) for i, p in enumerate((0.0, 0.01, 0.25, 0.5, 0.95, 1.0))} | {"abs": (F.abs("x"), 0.5)}
    for by in ([], ["g"]):
        got = quantiles.percentiles(df, by, wanted).collect()
        want = df.groupBy(*by).agg(*(F.percentile(x, p).alias(k) for k, (x, p) in wanted.items())).collect()
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


def test_percentiles_of_one_column_share_a_summary(spark, monkeypatch):
    made, summary = [], F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", lambda *given: made.append(1) or summary(*given))
    df = spark.range(30_000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 30_011).cast("double").alias("x"))
    x, y = F.col("x"), F.sqrt("x")
    wanted = {"low": (x, 0.005), "root": (y, 0.3), "high": (x, 0.995), "top": (x, 1.0)}
    got = quantiles.percentiles(df, ["g"], wanted).collect()
    want = df.groupBy("g").agg(*(F.percentile(c, p).alias(k) for k, (c, p) in wanted.items())).collect()
    assert len(made) == 2 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_lines_meet_any_number_of_windows(spark):
    days = spark.sql("select date_add(date'2020-01-01', cast(id as int)) as po_date, cast(id as string) as part_key from range(100)")
    spans = spark.sql("select concat('w', id) as label, date_add(date'2020-01-01', cast(id % 90 as int)) as start, date_add(date'2020-01-01', cast(id % 90 + id % 7 as int)) as end from range(1500)")
    got = panel.in_windows(days, spans).groupBy("label").count().collect()
    assert len(got) == 1500 and sum(r["count"] for r in got) == sum(1 + i % 7 for i in range(1500))


def test_keys_in_compatibility_form(spark):
    rows = [("\uff21\uff22\uff0d\uff11\uff12",), ("o\ufb03ce\u00a0 9",), ("caf\u00e9",), ("ab-12",), ("\u3000",), ("\u2460x",)]
    got = [r.k for r in spark.createDataFrame(rows, "t string").select(C.part_key(F.col("t"), F.lit("str")).alias("k")).collect()]
    assert got == ["AB-12", "OFFICE 9", "CAF\u00c9", "AB-12", None, "1X"]


def test_rows_of_few_groups_are_not_dealt_by_group(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "30000b")
    try:
        rows = spark.range(30_000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 1000).cast("double").alias("x"))
        out = quantiles.beside(rows, quantiles.percentiles(rows, ["g"], {"middle": (F.col("x"), 0.5)}), ["g"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        assert out.count() == 30_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
