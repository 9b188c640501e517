import math
import random
import unicodedata
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from costweave import config
from costweave.functions import columns as C
from costweave.operators import basket, classify, committed, forecast, indices, pairs, panel
from costweave.operators.clean import clean_lines, flag_duplicates
from costweave.schema import PO_LINE

D = date.fromisoformat


def line(day, part, cost, ordered, received, extension, value, bucket="1210AC", description="Inventory", row=1, kind="str", d1="x"):
    return (D(day) if day else None, None, part, kind, d1, None, float(cost), float(ordered), float(received), float(extension), float(value), bucket, description, "f", "s", row, True)


def lines(spark, *rows):
    return spark.createDataFrame(list(rows), PO_LINE)


def daily_frame(spark, rows):
    return spark.createDataFrame([(p, D(d), float(x), float(q), float(x * q), "Inventory") for p, d, x, q in rows], "part_key string, po_date date, price double, qty double, spend double, approved_category string")


def panel_frame(spark, rows):
    return spark.createDataFrame(rows, "part_key string, period_start date, period_end date, period_ordinal long, price double, qty double, spend double, approved_category string")


def test_open_and_received_lines(spark):
    raw = lines(spark, line("2024-01-01", "A1", 10, 5, 0, 0, 50), line("2024-02-01", "A1", 11, 5, 5, 55, 55, row=2))
    a, b = clean_lines(raw).orderBy("source_row_number").collect()
    assert a.is_open_order and not a.usable_price and a.committed_price == 10.0 and a.exclusion_reason == "invalid_price"
    assert b.realized_price == 11.0 and b.usable_price and not b.is_open_order
    kept = clean_lines(raw, config.resolve(cli_values={"include_open_orders_as_prices": "yes"}).controls).orderBy("source_row_number").first()
    assert kept.usable_price and kept.price == 10.0


def test_part_keys(spark):
    rows = [("  ab-12  ", "str", "AB-12", "ok"), ('a/b"c', "str", 'A/B"C', "ok"), ("12345.0", "float", "12345", "ok"), (None, None, None, "missing"), ("   ", "str", None, "empty_after_norm"), ("12.50", "float", "12.5", "ok"), ("1200", "int", "1200", "ok"), ("nan", "str", None, "empty_after_norm")]
    df = spark.createDataFrame([r[:2] for r in rows], "p string, k string")
    key = C.part_key(F.col("p"), F.col("k"))
    assert [(r.key, r.status) for r in df.select(key.alias("key"), C.part_key_status(F.col("p"), key).alias("status")).collect()] == [r[2:] for r in rows]


def test_basis_factor_and_numbers(spark):
    df = spark.createDataFrame([(0.0101,), (99.0,), (1.0,), (5.0,), (-1.0,), (0.0,), (None,), (1e7,)], "r double")
    assert [r[0] for r in df.select(C.basis_factor(F.col("r"))).collect()] == [0.01, 100.0, 1.0, None, None, None, None, None]
    texts = spark.createDataFrame([("$1,234.5",), ("x",), ("",), (None,)], "t string")
    assert [r[0] for r in texts.select(C.number(F.col("t"))).collect()] == [1234.5, None, None, None]


@pytest.mark.parametrize("bucket,description,decision,category", [("1210AC", "Inventory", "Include", "Inventory"), ("4100AC", "COST OF SALES - OUTSIDE SERVICES", "Include", "COS"), ("1131GC", "Unsure - Include", "Needs Review", "Unsure - Include"), ("9", "Freight in", "Exclude", "Freight In"), (None, None, "Needs Review", "Uncategorized")])
def test_scope_rules(spark, bucket, description, decision, category):
    df = spark.createDataFrame([(bucket, description)], "b string, d string")
    r = df.select(C.scope_decision(F.col("b"), F.col("d")).alias("x")).first().x
    assert (r.decision, r.category) == (decision, category)


def test_overrides_scale_and_exclude(spark):
    raw = lines(spark, line("2024-01-01", "a1", 10, 5, 5, 50, 50), line("2024-01-01", "B", 10, 5, 5, 50, 50, row=2))
    over = spark.createDataFrame([("A1 ", "", "", "", 1000.0, None, None), ("B", "exclude", "C9", "", None, 99.0, 42.0)], "part_key string, include_exclude string, replacement_part_key string, category string, uom_factor double, manual_current_price double, manual_future_quantity double")
    a, b = classify.classify_lines(clean_lines(raw), config.resolve(part_overrides=over)).orderBy("source_row_number").collect()
    assert (a.realized_price, a.qty_received, a.realized_spend) == (0.01, 5000.0, 50.0)
    assert (b.decision, b.part_key, b.manual_current_price, b.manual_future_quantity, b.price, b.match_tier) == ("Exclude", "C9", 99.0, 42.0, 10.0, "client_approved")
    with pytest.raises(ValueError, match="repeated"):
        classify.classify_lines(clean_lines(raw), config.resolve(part_overrides=over.union(over)))


def test_modal_category_at_a_cutoff(spark):
    df = spark.createDataFrame([("A", True, D("2024-01-01"), "Inventory"), ("A", True, D("2025-01-01"), "Production Supplies"), ("A", True, D("2025-02-01"), "Production Supplies")], "comparison_entity string, in_direct_costs boolean, effective_date date, direct_category string")
    assert {r.approved_category for r in classify.label_categories_at(df, D("2024-06-30")).collect()} == {"Inventory"}


def test_duplicates_flag_or_drop(spark):
    raw = clean_lines(lines(spark, line("2024-01-01", "A", 1, 1, 1, 1, 1, row=2), line("2024-01-01", "A", 1, 1, 1, 1, 1, row=1), line("2024-01-01", "B", 1, 1, 1, 1, 1, row=3)))
    assert flag_duplicates(raw).where("is_duplicate").count() == 2
    assert sorted(r.source_row_number for r in flag_duplicates(raw, "drop").collect()) == [1, 3]


def test_same_day_prices(spark):
    raw = lines(spark, line("2024-03-01", "P1", 10, 1, 1, 10, 10), line("2024-03-01", "P1", 20, 3, 3, 60, 60, row=2))
    c = classify.classify_lines(clean_lines(raw)).withColumn("approved_category", F.col("direct_category"))
    r = panel.realized_daily(c).first()
    assert (r.price, r.qty, r.line_count) == (17.5, 4.0, 2) and panel.realized_daily(c, mode="median").first().price == 15.0


def test_pairs_and_month_exposure(spark):
    d = daily_frame(spark, [("A", "2023-01-01", 10, 1), ("A", "2023-06-01", 11, 1), ("A", "2024-01-01", 12, 1), ("B", "2023-01-01", 5, 2), ("B", "2023-07-01", 6, 2)])
    assert pairs.adjacent_pairs(d).count() == 3
    p = spark.createDataFrame([("A", D("2023-12-31"), D("2024-02-01")), ("B", D("2024-01-10"), D("2024-01-20"))], "part_key string, date_a date, date_b date")
    got = {(r.part_key, r.month): r.exposure for r in pairs.month_exposure(p).collect()}
    assert got["A", D("2024-01-01")] == 1.0 and got["B", D("2024-01-01")] == pytest.approx(10 / 31) and got["A", D("2024-02-01")] == pytest.approx(1 / 29)


def test_extreme_pair_is_flagged(spark):
    d = daily_frame(spark, [("A", "2024-01-01", 10, 1), ("A", "2024-05-31", 11, 1), ("B", "2024-01-01", 10, 1), ("B", "2024-05-31", 50, 1)])
    assert {r.part_key: r.extreme_flag for r in pairs.flag_extremes(pairs.adjacent_pairs(d)).collect()}["B"]


def test_index_links(spark):
    q1, q2 = (D("2023-01-01"), D("2023-03-31"), 8093), (D("2023-04-01"), D("2023-06-30"), 8094)
    t = panel_frame(spark, [("A", *q1, 10.0, 2.0, 20.0, "x"), ("B", *q1, 20.0, 1.0, 20.0, "x"), ("A", *q2, 11.0, 2.0, 22.0, "x"), ("B", *q2, 22.0, 1.0, 22.0, "x")])
    assert indices.tornqvist(t).first().pct_change == pytest.approx(0.10)
    f = panel_frame(spark, [("A", *q1, 10.0, 1.0, 10.0, "x"), ("B", *q1, 20.0, 1.0, 20.0, "x"), ("A", *q2, 12.0, 1.0, 12.0, "x"), ("B", *q2, 20.0, 2.0, 40.0, "x")])
    assert indices.fisher(f).first().index_level == pytest.approx(math.sqrt(32 / 30 * 52 / 50))
    gap = panel.part_period(daily_frame(spark, [("A", "2024-01-15", 10, 1), ("A", "2024-03-15", 20, 1)]), "M")
    assert indices.tornqvist(gap).count() == 0 and indices.matched_changes(gap).count() == 0


def basket_lines(spark, rows):
    data = [(p, D(d), float(x), float(v), float(q), "INVENTORY", "INVENTORY", "d", "f", i) for i, (p, d, x, v, q) in enumerate(rows)]
    return spark.createDataFrame(data, "part_key string, po_date date, price double, po_value double, qty_ordered double, hist_category string, description_norm string, description_1 string, source_file string, source_row_number long")


def fiscal_windows(spark):
    w = spark.createDataFrame([("A", D("2022-10-01"), D("2023-09-30")), ("B", D("2023-10-01"), D("2024-09-30"))], "label string, start date, end date")
    return w, spark.createDataFrame([("A-B", "A", "B")], "comparison string, a string, b string")


def test_window_values(spark):
    w, _ = fiscal_windows(spark)
    r = panel.part_windows(basket_lines(spark, [("A", "2023-11-01", 10, 100, 1), ("A", "2023-12-01", 30, -5, 2), ("A", "2024-01-01", 20, 50, 3)]), w).first()
    assert (r.price, r.spend, r.qty) == (20.0, 150.0, 2.0)


def test_coverage_and_robust_index(spark):
    rows = [("A", "2023-01-01", 10, 100, 1), ("B", "2023-01-01", 20, 300, 1), ("C", "2023-01-01", 5, 600, 1), ("A", "2024-01-01", 11, 110, 1.2), ("B", "2024-01-01", 22, 330, 5), ("D", "2024-01-01", 9, 50, 1)]
    m = indices.matched_basket(basket_lines(spark, rows), *fiscal_windows(spark)).collect()
    assert {r.part_key for r in m} == {"A", "B"} and m[0].coverage_a == pytest.approx(0.4) and m[0].coverage_b == pytest.approx(440 / 490)
    assert {r.part_key: r.qty_comparable for r in m} == {"A": True, "B": False}
    even = basket_lines(spark, [("A", "2023-01-01", 10, 50, 1), ("B", "2023-01-01", 20, 50, 1), ("A", "2024-01-01", 11, 50, 1), ("B", "2024-01-01", 24, 50, 1)])
    v = indices.index_variants(indices.matched_basket(even, *fiscal_windows(spark), low=0.0, high=1.0, cap_at=0.5), low=0.0, high=1.0).first()
    assert v.raw_tornqvist == pytest.approx(math.expm1(0.5 * (math.log(1.1) + math.log(1.2)))) == pytest.approx(v.headline)
    skewed = basket_lines(spark, [("A", "2023-01-01", 10, 950, 1), ("B", "2023-01-01", 20, 50, 1), ("A", "2024-01-01", 11, 950, 1), ("B", "2024-01-01", 24, 50, 1)])
    v = indices.index_variants(indices.matched_basket(skewed, *fiscal_windows(spark), low=0.0, high=1.0, cap_at=0.5)).first()
    assert abs(v.raw_tornqvist - v.headline) > 1e-4


def test_chain(spark):
    df = spark.createDataFrame([("s", 0.0661), ("s", 0.0921)], "scope string, headline double")
    r = indices.chain(df, ["scope"]).first()
    assert r.cumulative == pytest.approx(1.0661 * 1.0921 - 1) and r.annualised == pytest.approx(math.sqrt(1.0661 * 1.0921) - 1)


def test_committed_signal(spark):
    raw = lines(spark, line("2024-01-01", "A1", 10, 5, 5, 50, 50), line("2025-01-01", "A1", 11, 5, 0, 0, 55, row=2), line("2025-01-01", "A1", 30, 5, 5, 150, 150, row=3))
    c = classify.classify_lines(clean_lines(raw))
    detail = committed.committed_detail(c, D("2025-06-30"))
    row = detail.first()
    assert row.prior_price == 10.0 and row.prior_date == D("2024-01-01")  # the same day is not before
    s = {r.category: r for r in committed.committed_signal(detail).collect()}
    assert s["Overall Direct Costs"].annual_rate_signal == pytest.approx(0.10, abs=0.002) and s["Inventory"].coverage == 1.0
    assert committed.committed_signal(detail.limit(0)).count() == 0


def test_holdout_rules(spark):
    d = daily_frame(spark, [("A", "2024-01-01", 100, 1), ("B", "2023-12-31", 100, 1), ("A", "2025-07-02", 121, 1), ("B", "2025-07-02", 121, 1)])
    (r,) = basket.holdout_basket(d, D("2024-07-02")).collect()
    assert r.part_key == "A" and r.gap_days == 548 and r.stale_excluded == 1 and r.actual_multiplier == pytest.approx(1.21 ** (365 / 548))
    e = daily_frame(spark, [("A", "2024-01-01", 10, 1), ("B", "2024-01-01", 10, 1), ("A", "2025-01-01", 10000, 1), ("B", "2025-01-01", 11, 1)])
    got = {r.part_key: r for r in basket.holdout_basket(e, D("2024-01-01")).collect()}
    assert got["A"].raw_multiplier == pytest.approx(1000, rel=0.02) and got["A"].actual_multiplier <= 4.0001 and got["A"].weight < 0.5


def test_planned_and_fiscal_weights(spark):
    raw = lines(spark, line("2024-01-01", "A", 2, 1, 1, 2, 2), line("2024-01-01", "B", 6, 1, 1, 6, 6, description="Small Tools", row=2))
    c = classify.classify_lines(clean_lines(raw))
    plan = spark.createDataFrame([("a", 10.0, None), ("B", 10.0, 0.0)], "part_key string, expected_quantity double, expected_spend double")
    assert {r.direct_category: r.weight for r in basket.planned_weights(c, plan, D("2024-12-31")).collect()} == {"Inventory": 0.25, "Small Tooling": 0.75}
    w = basket.fiscal_weights(c, D("2024-09-30")).collect()
    assert {r.basket_source for r in w} == {"FY2024_realized_spend_proxy"}
    assert {r.basket_source for r in basket.fiscal_weights(c, D("2024-05-01")).collect()} == {"trailing_12m_realized_spend_proxy"}
    assert [basket.latest_complete_fiscal_year(D(x)) for x in ("2024-09-30", "2024-10-01", "2024-09-29")] == [2024, 2024, 2023]


def naive(rates, h):
    mean = sum(rates[-12:]) / len(rates[-12:])
    level = rates[0]
    for x in rates[1:]:
        level = 0.3 * x + 0.7 * level
    lv, tr = rates[0], rates[1] - rates[0] if len(rates) > 1 else 0.0
    for x in rates[1:]:
        old = lv
        lv = 0.4 * x + 0.6 * (lv + 0.8 * tr)
        tr = 0.2 * (lv - old) + 0.8 * 0.8 * tr
    mu = sum(rates) / len(rates)
    return {"trailing_12m_mean": h * mean, "ewma": h * level, "damped_holt": sum(lv + sum(0.8**j for j in range(1, k + 1)) * tr for k in range(1, h + 1)), "mean_reversion": sum(mu + (mean - mu) * 0.85**k for k in range(1, h + 1))}


@pytest.mark.parametrize("n", [1, 2, 15, 30])
def test_forecast_methods(spark, n):
    rates = [0.01 * ((i * 7) % 5) - 0.01 for i in range(n)]
    months = [D(f"{2020 + i // 12}-{i % 12 + 1:02d}-01") for i in range(n)]
    arrays = forecast.series_arrays(spark.createDataFrame([("s", m, r) for m, r in zip(months, rates, strict=True)], "series string, month date, rate double"))
    for h in (1, 12):
        got = {r.method: r.cumulative_log for r in forecast.candidates(arrays, h).collect()}
        assert got == pytest.approx(naive(rates, h))
    errors = {r.method: (r.mae, r.n_evals) for r in forecast.method_errors(arrays, (12,)).collect()}
    if n < 30:
        assert forecast.select_method(arrays).first().method == "trailing_12m_mean"
    else:
        origins = range(12, n - 12)
        want = {m: sum(abs(naive(rates[: t + 1], 12)[m] - sum(rates[t + 1 : t + 13])) for t in origins) / len(origins) for m in forecast.METHODS}
        assert {m: e[0] for m, e in errors.items()} == pytest.approx(want) and errors["ewma"][1] == len(origins)
        assert forecast.select_method(arrays).first().method == min(forecast.METHODS, key=lambda m: want[m])


def test_annual_forecast(spark):
    months = [D(f"{2021 + i // 12}-{i % 12 + 1:02d}-01") for i in range(48)]
    rates = {"Inventory": math.log(1.10) / 12, "Small Tooling": math.log(1.20) / 12}
    rows = [(s, m, r) for s, r in rates.items() for m in months] + [("Overall", m, math.log(1.15) / 12) for m in months]
    history = spark.createDataFrame(rows, "series string, month date, rate double")
    weights = spark.createDataFrame([("Inventory", 0.25), ("Small Tooling", 0.75)], "direct_category string, weight double")
    counts = spark.createDataFrame([("Inventory", 100), ("Small Tooling", 100)], "category string, pairs long")
    bucket, composite = forecast.annual_forecast(history, weights, counts, D("2024-12-31"))
    first = {r.forecast_year: r.cumulative_multiplier for r in composite.collect()}
    assert first[1] == pytest.approx(0.25 * 1.10 + 0.75 * 1.20) and set(first) == {1, 2, 3}
    hot = spark.createDataFrame([("Overall", m, 0.20) for m in months[:24]], "series string, month date, rate double")
    b, _ = forecast.annual_forecast(hot, weights, counts, D("2022-12-31"))
    r = b.where("forecast_year = 1").first()
    assert r.cumulative_multiplier == pytest.approx(1.5) and r.at_guardrail


def test_config_precedence():
    r = config.resolve({"bootstrap_iterations": "50", "fast_mode": "TRUE"}, {"random_seed": 7})
    assert r.controls.bootstrap_iterations == 10 and r.sources["random_seed"] == "cli" and r.controls.random_seed == 7
    assert config.resolve({"fast_mode": True}, {"bootstrap_iterations": 50}).controls.bootstrap_iterations == 50
    for bad in ({"fast_mode": "maybe"}, {"unknown": 1}, {"scope_mode": "x"}, {"random_seed": "x"}):
        with pytest.raises(ValueError):
            config.resolve(bad)
    with pytest.raises(ValueError):
        config.resolve_dates(config.resolve({"target_date": "2020-01-01"}).controls, D("2024-01-01"))
    assert config.resolve_dates(config.Controls(), D("2024-01-01"))[1] == D("2024-12-31")


def test_open_lines_without_an_entity_stay_out_of_the_window(spark):
    opened = spark.createDataFrame([("A", D("2024-03-01"), 5.0, "f", 1), (None, D("2024-03-01"), 6.0, "f", 2), (None, D("2024-04-01"), 7.0, "f", 3)], "comparison_entity string, po_date date, committed_price double, source_file string, source_row_number int")
    realized = spark.createDataFrame([("A", D("2024-01-01"), 4.0, "f", 1), (None, D("2024-01-01"), 9.0, "f", 2), ("A", D("2024-03-01"), 8.0, "f", 3)], "comparison_entity string, effective_date date, realized_price double, source_file string, source_row_number int")
    got = {r.committed_price: (r.prior_price, r.prior_date) for r in committed.asof_prior(opened, realized).collect()}
    assert got == {5.0: (4.0, D("2024-01-01")), 6.0: (None, None), 7.0: (None, None)}


def test_fisher_says_why_a_period_has_no_index(spark):
    row = lambda part, m, price, qty: (part, date(2024, m, 1), date(2024, m, 28), m, price, qty, 1.0, "x")
    panel_ = panel_frame(spark, [row("A", 1, 10.0, 1.0), row("A", 2, 11.0, 2.0), row("A", 3, 12.0, None), row("A", 4, 12.0, 1.0), row("B", 6, 3.0, 1.0), row("B", 7, 6.0, 1.0)])
    got = [(r.period_start.month, r.match_count, r.status, r.reason, round(r.index_level, 9)) for r in indices.fisher(panel_).orderBy("period_start").collect()]
    short, alone = "insufficient valid quantities", "no part in this period and the one before"
    assert got == [(2, 1, "ok", None, 1.1), (3, 0, "unavailable", short, 1.1), (4, 0, "unavailable", short, 1.1), (6, 0, "unavailable", alone, 1.1), (7, 1, "ok", None, 2.2)]


def test_keys_are_composed_as_unicode_says(spark):
    r = random.Random(5)
    pools = (list("abcEOUanAIeo"), list(C._CLASSES), list(C._APART), list(C._PAIRS), [chr(c) for c in range(0xAC00, 0xD7A4)], [chr(c) for c in (*range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A8, 0x11C3))])
    texts = ["".join(r.choice(r.choice(pools)) for _ in range(r.randint(1, 10))) for _ in range(10_000)] + ["", "plain", "\U0001f600 é", "́"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", C.compatible(F.col("t")).alias("k")).collect()
    assert [(texts[x.i], x.k) for x in rows if x.k != unicodedata.normalize("NFKC", texts[x.i])] == []
    one = spark.createDataFrame([("café 1",), ("café 1",)], "t string").select(C.part_key(F.col("t"), F.lit("str"))).distinct()
    assert one.count() == 1


def test_prior_prices_equal_a_plain_search(spark):
    """One entity holds most lines, days repeat, and the last line of a day stands."""
    r = random.Random(3)
    entity = lambda: r.choice(["hot"] * 6 + ["b", "c", None])
    day = lambda: date(2024, 1, 1) + timedelta(days=r.randint(0, 60))
    bought = [(entity(), day(), float(r.randint(1, 90)), r.choice("fg"), n) for n in range(900)]
    asked = [(entity(), r.choice([day(), None]), "h", n) for n in range(500)]
    realized = spark.createDataFrame(bought, "comparison_entity string, effective_date date, realized_price double, source_file string, source_row_number long")
    opened = spark.createDataFrame(asked, "comparison_entity string, po_date date, source_file string, source_row_number long")
    got = {x.source_row_number: (x.prior_price, x.prior_date) for x in committed.asof_prior(opened, realized).collect()}
    assert len(got) == 500
    for e, d, _, n in asked:
        before = [(x[1], x[3], x[4], x[2]) for x in bought if e is not None and d is not None and x[0] == e and x[1] < d]
        assert got[n] == ((max(before)[3], max(before)[0]) if before else (None, None))


def test_gram_adds_weights_of_the_same_days_before_it_spreads_months(spark):
    from datetime import date

    from costweave.operators import pairs

    rows = [("A", date(2020, 1, 10), date(2020, 3, 5), 1.0), ("B", date(2020, 1, 10), date(2020, 3, 5), 2.5), ("C", date(2020, 2, 1), date(2020, 2, 11), 2.0)]
    gram = pairs.weighted_gram(spark.createDataFrame(rows, "part_key string, date_a date, date_b date, pair_weight double"))
    share = {1: 21 / 31, 2: 1.0, 3: 5 / 31}
    want = {(a, b): 3.5 * share[a] * share[b] + (2.0 * (10 / 29) ** 2 if a == b == 2 else 0.0) for a in share for b in share}
    got = {(r.month.month, r.month_2.month): r.gram for r in gram.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert "keys=[date_a" in gram._jdf.queryExecution().executedPlan().toString()


def test_baskets_need_no_texts_and_deal_no_rows_by_basket(spark):
    from pyspark.sql import functions as F

    from costweave.operators import indices
    from costweave.plans.stages import staged

    part = F.concat(F.lit("P"), F.col("id") % 3000).alias("part_key")
    price = (F.col("id") % 3000 % 50 + 1 + F.floor(F.col("id") / 3000)).cast("double")
    values = staged(spark.range(6000).select(F.lit("all").alias("scope"), F.when(F.col("id") < 3000, "Y1").otherwise("Y2").alias("label"), part, price.alias("price"), (price * 2).alias("spend"), F.lit(2.0).alias("qty"),
                                             F.lit(1).cast("long").alias("line_count"), (price * 2).alias("scope_spend")), "values")
    comparisons = spark.createDataFrame([("Y1-Y2", "Y1", "Y2")], "comparison string, a string, b string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000b")
    try:
        matched = indices.matched_parts(values, comparisons, ["scope"])
        assert "SortMergeJoin" not in matched._jdf.queryExecution().executedPlan().toString()
        matched = staged(matched, "matched-parts")
        out = indices.weighted_basket(matched, values, comparisons, ["scope"])
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == 3000 and "description_norm" not in out.columns
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
