import math

import pytest
from pyspark.sql import functions as F

from costweave.config import Controls
from costweave.operators import backtest, quality
from costweave.operators.sampling import exponential_key, weighted_sample
from costweave.sources import files


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(6000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 < 2, F.lit("hot")).otherwise(F.when(F.col("id") % 2 == 0, F.lit("cold"))).alias("g"), ((F.col("id") % 7) + 0.5).alias("w"))
    odd = spark.createDataFrame([(6001, "cold", 0.0), (6002, "cold", -1.0), (6003, "cold", math.nan), (6004, "cold", math.inf), (6005, "cold", None), (6006, "tiny", 1.0)], "k long, g string, w double")
    return df.unionAll(odd).persist()


@pytest.mark.parametrize("n", [0, 1, 40, 900, 10_000])
def test_the_least_keys_of_each_stratum_are_drawn(rows, n):
    """Against sorting everything, with a null stratum, small strata and weights that cannot be drawn."""
    keyed = rows.select("k", "g", "w", exponential_key(F.col("w"), 7, ("k",)).alias("e")).collect()
    good = sorted((r for r in keyed if r.w is not None and 0 < r.w < math.inf), key=lambda r: (r.e, r.k))
    got = [r.k for r in weighted_sample(rows, F.col("w"), n, 7, ("k",)).collect()]
    assert sorted(got) == sorted(r.k for r in good[:n])
    by = [(r.g, r.k) for r in weighted_sample(rows, F.col("w"), n, 7, ("k",), ("g",)).collect()]
    assert sorted(by, key=str) == sorted(((r.g, r.k) for g in ("hot", "cold", "tiny", None) for r in [x for x in good if x.g == g][:n]), key=str)


def test_chances_follow_the_weights(spark):
    """Of two rows, one is drawn as often as its share of the weight says; seeds are the trials."""
    two = spark.range(2).select("id", (F.col("id") * 2 + 1.0).alias("w"))
    trials = spark.range(4000).select(F.col("id").alias("seed")).crossJoin(two).withColumn("key", F.concat_ws("-", "seed", "id"))
    drawn = weighted_sample(trials, F.col("w"), 1, 3, ("key",), ("seed",))
    share = drawn.where("id = 1").count() / 4000
    assert drawn.count() == 4000 and abs(share - 0.75) < 4 * math.sqrt(0.75 * 0.25 / 4000)


def test_repeated_rows_and_no_rows(spark):
    same = spark.createDataFrame([(1, 2.0)] * 50, "k long, w double")
    assert weighted_sample(same, F.col("w"), 20, key=("k",)).count() == 20
    assert weighted_sample(same.limit(0), F.col("w"), 20, key=("k",)).count() == 0
    assert weighted_sample(same.limit(0), F.col("w"), 20, key=("k",), by=("k",)).count() == 0


def test_no_plan_sorts_a_stratum_or_collects_it(rows):
    text = weighted_sample(rows, F.col("w"), 40, 7, ("k",), ("g",))._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" not in text and "Sort [drawn_key" not in text


def test_bounded_backtest_takes_that_many(spark):
    days = spark.range(0, 40).select(F.expr("date_add(date'2020-01-15', cast(id * 45 as int))").alias("po_date"))
    daily = days.crossJoin(spark.range(12).select(F.concat(F.lit("P"), "id").alias("part_key"), "id")).select(
        "part_key", "po_date", (10 + F.col("id") + F.datediff("po_date", F.lit("2020-01-15").cast("date")) / 400).alias("price"), F.lit(2.0).alias("qty"), F.lit(20.0).alias("spend"), F.lit("Inventory").alias("approved_category"),
    ).persist()
    c = Controls(fast_mode=True, forecast_horizons_months=(12,), part_backtest_max_observations=15)
    counts = backtest.part_backtest(daily, c).groupBy("cutoff", "horizon_months", "model").count().collect()
    assert counts and {r["count"] for r in counts} == {15}


def test_facts_of_files_from_the_listing(spark, tmp_path):
    for name, content in (("b +1.CSV", b"x" * 200_000), ("a.csv", b"ab"), ("edge.csv", b"y" * 100_000), ("~$a.csv", b"z"), ("n.txt", b"z"), ("none.xlsx", b"q"), ("empty.csv", b"")):
        (tmp_path / name).write_bytes(content)
    found = {r.file: r for r in files.listing(spark, str(tmp_path), fingerprints=True).collect()}
    assert set(found) == {"b +1.CSV", "a.csv", "edge.csv", "none.xlsx"} == {r.file for r in files.listing(spark, str(tmp_path)).collect()}
    for name, r in found.items():
        assert r.bytes == (tmp_path / name).stat().st_size and r.fingerprint == files.fingerprint(tmp_path / name), name
    lines = spark.sql("""SELECT * FROM VALUES ('a.csv', 'csv', date'2024-01-01'), ('a.csv', 'csv', date'2024-02-01'), ('b +1.CSV', 'csv', date'2024-02-01'), ('b +1.CSV', 'csv', null),
        ('w.xlsx', 'Z', date'2024-03-01'), ('w.xlsx', 'Z', date'2024-03-02') AS t(source_file, source_sheet, po_date)""")
    got = {r.source_file: r for r in quality.file_profile(lines, files.listing(spark, str(tmp_path), fingerprints=True)).collect()}
    assert {k: (r.row_count, r.bytes, r.warnings) for k, r in got.items()} == {
        "a.csv": (2, 2, ""), "b +1.CSV": (2, 200_000, "1 lines without an order date; dates overlap those of the file before, up to 2024-02-01"), "edge.csv": (0, 100_000, "no lines"),
        "none.xlsx": (0, 1, "no lines"), "w.xlsx": (2, None, "sheet 'Z' was taken; 28 days without lines before"),
    }
