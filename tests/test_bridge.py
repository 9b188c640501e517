import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from costweave.operators import bridge, pairs, regression

BASE = date(2023, 6, 30)


@pytest.fixture(scope="module")
def daily(spark):
    rows = [(f"P{p}", date(2022 + m // 12, m % 12 + 1, 15), 10.0 * (p + 1) * math.exp(0.01 * m), 2.0, 20.0 * (p + 1), "Inventory", "") for p in range(6) for m in range(17 - p)]
    return spark.createDataFrame(rows, "part_key string, po_date date, price double, qty double, spend double, approved_category string, description_1 string").persist()


def test_bridge_quantities_and_cost(spark, daily):
    model = regression.RepeatSales([date(2023, 5, 1), date(2023, 6, 1)], np.array([0.02, 0.04]), 0.0, 0.01, True, 9)
    residuals = spark.createDataFrame([("P0", "Inventory", "part", 0.1)], "part_key string, category string, source string, shrunk_residual double")
    manual = spark.createDataFrame([("P1", 99.0, None), ("P2", None, 7.0), ("P3", -1.0, 0.0)], "part_key string, manual_current_price double, manual_future_quantity double")
    b = bridge.bridged_prices(daily, residuals, model, BASE, manual)
    by = {r.part_key: r for r in b.collect()}
    assert len(by) == 6
    want = 10 * math.exp(0.16) * math.exp(0.02 * 16 / 31 + 0.04 + 0.1 * 46 / 365.25)
    assert by["P0"].estimated_base_price == pytest.approx(want) and by["P0"].price_staleness_days == 46 and by["P0"].source == "part"
    assert by["P1"].estimated_base_price == 99.0 and by["P1"].price_staleness_days == 0 and by["P1"].price_override_reason == "manual_current_price"
    assert by["P3"].price_override_reason == "" and by["P3"].source == "overall"
    lines = spark.createDataFrame([(f"P{p}", d, 100.0, True) for p in range(5) for d in (date(2022, 6, 30), date(2022, 7, 1))], "part_key string, po_date date, po_value double, model_eligible boolean")
    q = {r.part_key: r for r in bridge.basket_quantities(b, lines, BASE).collect()}
    assert q["P1"].q_star == pytest.approx(100 / 99) and q["P5"].q_star == 0 and q["P2"].q_future == 7 and q["P0"].q_future == q["P0"].q_star
    assert sum(r.composite_weight for r in q.values()) == pytest.approx(1) and q["P5"].composite_weight == 0
    planned = spark.createDataFrame([(" p0 ", 3.0), ("P0", 1.0), ("P1", None)], "part_key string, expected_quantity double")
    planned_rows = bridge.basket_quantities(b, lines, BASE, planned)
    p = {r.part_key: r for r in planned_rows.collect()}
    assert len(p) == 6 and p["P0"].q_star == 4 and p["P2"].q_star == 7 and p["P1"].q_star is None
    from pyspark.sql import functions as F

    cost = bridge.purchasing_cost(planned_rows.withColumn("multiplier", F.lit(1.1))).first()
    assert cost.purchasing_cost_change == pytest.approx(0.1) and cost.fixed_basket_change == pytest.approx(0.1)


def test_heaviest_equals_a_sort(spark):
    rng = np.random.default_rng(0)
    w = np.round(rng.pareto(1.0, 400) + 0.1, 1)
    frame = spark.createDataFrame([(f"K{i:03d}", float(x)) for i, x in enumerate(w)], "part_key string, weight double")
    got = {r.part_key: r.weight for r in bridge.heaviest(frame, 0.9, 100).collect()}
    order = sorted(range(400), key=lambda i: (-w[i], i))
    run = np.cumsum(w[order]) / w.sum()
    want = {f"K{i:03d}" for i, r in zip(order, run, strict=True) if r <= 0.9}
    assert set(got) == want and sum(got.values()) == pytest.approx(1)
    assert bridge.heaviest(frame, 0.9, 1000).count() == 400
    one = spark.createDataFrame([("A", 1000.0), ("B", 1.0), ("C", 1.0)], "part_key string, weight double")
    assert {r.part_key for r in bridge.heaviest(one, 0.5, 2).collect()} == {"A", "B"}


def test_index_tables(spark, daily):
    flagged = pairs.adjacent_pairs(daily, 0).selectExpr("part_key", "part_key = 'P5' as extreme_flag")
    both = {r.variant: r for r in bridge.extremes_sensitivity(daily, flagged).collect()}
    assert both["with_extremes"].latest_tornqvist == pytest.approx(both["without_extremes"].latest_tornqvist) and both["with_extremes"].extreme_pairs == 11
    assert both["with_extremes"].n_rows - both["without_extremes"].n_rows == 4
    rows = bridge.scope_sensitivity({"all": daily, "none": daily.limit(0)}).collect()
    assert [(r.scope, r.frequency, r.status) for r in rows if r.scope == "none"] == [("none", "M", "no_data")]
    assert {r.frequency: r for r in rows if r.scope == "all"}["M"].latest_matched_change == pytest.approx(math.expm1(0.01))
    rates = spark.createDataFrame([("Overall", date(2022, 2, 1), 0.01), ("Overall", date(2022, 3, 1), 0.01)], "series string, month date, rate double")
    index = {r.period_start: r for r in bridge.historical_index(daily, rates).where("frequency = 'M'").collect()}
    assert index[date(2022, 3, 1)].repeat_sales_index == pytest.approx(math.exp(0.02)) and index[date(2022, 3, 1)].fisher_index == pytest.approx(math.exp(0.02))
    changes = spark.createDataFrame([(date(2022, 1 + 3 * i, 1), x) for i, x in enumerate((None, 0.5, 0.01, 0.03))], "period_start date, c double")
    assert bridge.recent_change(changes, "c", 2).first().mean_change == pytest.approx(0.02)


def test_trace_takes_the_later_row(spark):
    rows = [("A", date(2022, 1, 1), "f", 1, "x"), ("A", date(2022, 1, 1), "f", 2, "y"), (None, date(2023, 1, 1), "f", 3, "z")]
    lines = spark.createDataFrame(rows, "part_key string, po_date date, source_file string, source_row_number long, description_1 string")
    assert [tuple(r) for r in bridge.source_trace(lines, ("source_row_number", "description_1")).collect()] == [("A", 2, "y")]


def test_prices_of_parts_move_by_category_and_widen_where_little_is_known(spark):
    bridged = spark.createDataFrame([("own", "a", "part", 0, 10.0, 1.0), ("old", "b", "overall", 365, 10.0, 2.0)], "part_key string, category string, source string, price_staleness_days int, estimated_base_price double, q_future double")
    bridged = bridged.withColumn("composite_weight", F.lit(0.5))
    bucket = spark.createDataFrame([("a", y, 1.1**y) for y in (1, 2, 3)], "direct_category string, forecast_year int, cumulative_multiplier double")
    composite = spark.createDataFrame([(y, 1.2**y, 0.9, 1.0, 1.1) for y in (1, 2, 3)], "forecast_year int, cumulative_multiplier double, lower double, median double, upper double")
    got = {(r.part_key, r.forecast_year): r for r in bridge.part_forecast(bridged, bucket, composite).collect()}
    assert len(got) == 6
    for year in (1, 2, 3):
        far = 1.25 if year == 3 else 1.0  # a third year lies twelve months beyond two years
        for part, rate, factor in (("own", 1.1, far), ("old", 1.2, 1.35 * 1.25 * far)):
            r, price = got[part, year], 10 * rate**year
            assert [r.price, r.price_p10, r.price_p90] == pytest.approx([price, price * (1 - 0.1 * factor), price * (1 + 0.1 * factor)])
    plain = bridge.part_forecast(bridged, bucket, composite.drop("lower", "median", "upper"))
    assert "price_p10" not in plain.columns and plain.count() == 6
    cost = bridge.purchasing_cost(plain.where("forecast_year = 1")).first()
    assert (cost.cost_base, cost.cost_target) == pytest.approx((30.0, 11.0 + 24.0))


def test_heaviest_parts_work_their_input_out_once(spark):
    from pyspark.sql import functions as F

    weights = spark.range(2000).select(F.concat(F.lit("P"), F.col("id")).alias("part_key"), (F.col("id") + 1).cast("double").alias("weight"))
    out = bridge.heaviest(weights, 0.9, 100)
    assert "Range" not in out._jdf.queryExecution().executedPlan().toString() and abs(sum(r.weight for r in out.collect()) - 1) < 1e-9
