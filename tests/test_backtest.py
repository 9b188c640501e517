import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from costweave.config import Controls
from costweave.operators import backtest, pairs, regression, resampling, robust


@pytest.fixture(scope="module")
def daily(spark):
    """Forty parts over thirty months at one per cent a month, two categories."""
    rng = np.random.default_rng(5)
    rows = [
        (f"P{p:02d}", date(2021 + m // 12, m % 12 + 1, 15), 10 * math.exp(0.01 * m + rng.normal(0, 0.003)), 2.0, 20.0, "Inventory" if p % 2 else "COS")
        for p in range(40) for m in range(30)
    ]
    return spark.createDataFrame(rows, "part_key string, po_date date, price double, qty double, spend double, approved_category string").persist()


@pytest.fixture(scope="module")
def uneven(spark):
    """Pairs of sixty parts of three categories with noise, jumps, quantities and months that not every part has."""
    rng = np.random.default_rng(8)
    rows = []
    for p in range(60):
        for m in sorted(rng.choice(30, rng.integers(3, 14), replace=False).tolist()):
            jump = 6.0 if rng.random() < 0.02 else 1.0
            q = float(rng.integers(1, 9))
            price = 10 * jump * math.exp(0.01 * m + 0.02 * (p % 3) * m / 12 + rng.normal(0, 0.05))
            rows.append((f"P{p:02d}", date(2021 + m // 12, m % 12 + 1, 3 + p % 20), price, q, price * q, ("Inventory", "COS", None)[p % 3] if p % 7 else "Inventory"))
    daily = spark.createDataFrame(rows, "part_key string, po_date date, price double, qty double, spend double, approved_category string")
    return pairs.flag_extremes(pairs.adjacent_pairs(daily, 0)).persist()


def test_quarter_ends():
    assert backtest.quarter_ends(date(2023, 3, 31), date(2023, 12, 30)) == [date(2023, 3, 31), date(2023, 6, 30), date(2023, 9, 30)]
    assert backtest._shift(date(2024, 1, 31), 1) == date(2024, 2, 29)


def test_runs_equal_single_fits(spark, daily):
    cutoffs = [date(2022, 6, 30), date(2022, 12, 31)]
    rows = backtest.pairs_by_cutoff(daily, cutoffs, 0)
    runs = regression.fit_runs(pairs.pair_weights(pairs.flag_extremes(rows, by=("run",)), by=("run",)))
    for cutoff in cutoffs:
        alone = regression.fit_repeat_sales(pairs.pair_weights(pairs.flag_extremes(pairs.adjacent_pairs(daily.where(F.col("po_date") <= F.lit(cutoff)), 0))))
        got = runs[cutoff.isoformat()]
        assert got.months == alone.months and got.n_pairs == alone.n_pairs and sorted(got.differences) == sorted(alone.differences)
        np.testing.assert_allclose(got.delta0, alone.delta0, atol=1e-9)
        for c in alone.differences:
            np.testing.assert_allclose(got.differences[c], alone.differences[c], atol=1e-9)


def test_composite_backtest_on_steady_growth(spark, daily):
    lines = daily.select("part_key", F.col("po_date").alias("effective_date"), F.col("approved_category").alias("direct_category"), F.lit(True).alias("in_direct_costs"), F.col("spend").alias("realized_spend"))
    detail = backtest.composite_backtest(daily, lines, date(2023, 6, 30), Controls(fast_mode=True), cutoffs=[date(2022, 6, 30)])
    rows = detail.collect()
    assert {r.method for r in rows} == {"trailing_12m_mean", "ewma", "damped_holt", "mean_reversion"}
    for r in rows:
        assert r.matched_parts == 40 and r.eligible_basket_weight == pytest.approx(1.0)
        assert r.actual_multiplier == pytest.approx(math.exp(0.12), rel=0.02)
        assert r.signed_error == pytest.approx(r.predicted_multiplier - r.actual_multiplier)
    summary = backtest.backtest_summary(detail).collect()
    assert [r.selected for r in sorted(summary, key=lambda r: (r.mean_absolute_log_error, r.mean_point_error, r.method))] == [True, False, False, False]
    assert backtest.composite_backtest(daily.limit(0), lines, date(2023, 6, 30)).count() == 0


def repeated(flagged, runs, seed):
    """The plain form: every row as often as its run draws it, with the run's name."""
    rows = resampling.with_times(flagged, runs, seed).select("*", F.posexplode("times").alias("run", "n")).where("n > 0")
    return rows.select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("times", "n", "col").withColumn("run", F.col("run").cast("string"))


def test_resampling_keeps_parts_whole_and_repeats(spark, daily):
    p = pairs.flag_extremes(pairs.adjacent_pairs(daily, 0))
    sample = repeated(p, 30, 1).groupBy("run", "part_key").count().collect()
    assert all(r["count"] % 29 == 0 for r in sample)
    assert sum(r["count"] for r in sample if r.run == "0") == 40 * 29
    mean = np.mean([sum(r["count"] for r in sample if r.run == str(i)) for i in range(1, 30)]) / (40 * 29)
    assert 0.85 < mean < 1.15


@pytest.mark.parametrize("method", ["capped_spend_sqrt_n", "equal_part"])
def test_resamples_equal_fits_of_repeated_rows(spark, uneven, method):
    c = Controls(bootstrap_iterations=6, pair_weight_method=method)
    fits = resampling.fit_resamples(uneven, c)
    plain = regression.fit_runs(pairs.pair_weights(repeated(uneven, 6, c.random_seed), method, by=("run",)).persist(), c)
    assert sorted(fits.models) == sorted(plain) == list("012345")
    for run, want in plain.items():
        got = fits.models[run]
        assert (got.months, got.n_pairs, sorted(got.differences)) == (want.months, want.n_pairs, sorted(want.differences))
        np.testing.assert_allclose(got.delta0, want.delta0, atol=2e-6)
        assert got.sigma == pytest.approx(want.sigma, rel=1e-4) and got.gamma0 == pytest.approx(want.gamma0, abs=2e-6)
        for k in want.differences:
            np.testing.assert_allclose(got.differences[k], want.differences[k], atol=4e-6)


def test_bands_equal_those_of_repeated_rows(spark, uneven):
    c, base, target = Controls(bootstrap_iterations=6, part_min_intervals=2, part_min_span_days=90), date(2023, 6, 30), date(2024, 3, 31)
    parts = uneven.groupBy("part_key").agg(F.max_by("approved_category", "date_b").alias("approved_category"), F.sum("spend_b").alias("weight"))
    parts = parts.unionByName(spark.createDataFrame([("new", "Other", 40.0), ("odd", None, 5.0), ("none", "COS", 0.0)], parts.schema)).persist()
    fits = resampling.fit_resamples(uneven, c)
    ahead = {run: [0.002 * int(run)] * 9 for run in fits.models}
    got = {(r.level, r.key): (r.lower, r.median, r.upper, r.runs) for r in resampling.part_bands(uneven, parts, base, target, fits, ahead, c).collect()}
    sample = repeated(uneven, 6, c.random_seed)
    spans = parts.where("weight > 0").select("*", F.lit(base).alias("date_a"), F.lit(target).alias("date_b"), F.explode(F.array(*map(F.lit, sorted(fits.models)))).alias("run"))
    rows = backtest._part_growth(sample.dropDuplicates(["run", "part_key", "date_a"]), spans, fits.models, ahead, c)
    rows = rows.withColumn("m", F.exp(F.col("log_category") + F.col("residual") * F.datediff("date_b", "date_a") / 365.25)).toPandas()
    assert rows.residual.abs().max() > 0
    rows["category"] = rows.category.where(rows.category.notna(), None)
    by_run = lambda g: g.assign(wm=g.weight * g.m).groupby("run")[["wm", "weight"]].sum().pipe(lambda t: t.wm / t.weight)
    want = {("part", k): g.m for k, g in rows.groupby("part_key")}
    want |= {("category", None if k == "-" else k): by_run(g) for k, g in rows.assign(category=rows.category.fillna("-")).groupby("category")}
    want["composite", "Overall"] = by_run(rows)
    assert set(got) == set(want)
    for key, values in want.items():
        assert got[key][:3] == pytest.approx(np.quantile(values, [c.confidence_lower_quantile, 0.5, c.confidence_upper_quantile]), rel=1e-9) and got[key][3] == len(values)


def test_bootstrap_bands_hold_the_forecast(spark, daily):
    p = pairs.flag_extremes(pairs.adjacent_pairs(daily, 0)).persist()
    weights = spark.createDataFrame([("Inventory", 0.5), ("COS", 0.5)], "direct_category string, weight double")
    bands, summary = backtest.bootstrap_forecasts(p, weights, date(2023, 6, 30), "trailing_12m_mean", controls=Controls(bootstrap_iterations=3, fast_mode=True))
    assert summary["attempts"] == 3 and summary["success_rate"] > 0
    rows = {r.forecast_year: r for r in bands.collect()}
    assert sorted(rows) == [1, 2, 3]
    assert all(r.lower <= r.median <= r.upper for r in rows.values())
    assert 1.05 < rows[1].median < 1.2


def test_bands_of_parts_categories_and_the_basket(spark, daily):
    p = pairs.flag_extremes(pairs.adjacent_pairs(daily, 0)).persist()
    parts = daily.groupBy("part_key").agg(F.first("approved_category").alias("approved_category"), F.sum("spend").alias("weight")).persist()
    bands = backtest.bootstrap_parts(p, parts, date(2023, 6, 30), date(2024, 6, 30), Controls(bootstrap_iterations=3, fast_mode=True))
    got = {(r.level, r.key): r for r in bands.collect()}
    assert sum(k[0] == "part" for k in got) == parts.count() and ("composite", "Overall") in got
    assert all(r.lower <= r.median <= r.upper and r.runs >= 2 for r in got.values()) and 1.0 < got["composite", "Overall"].median < 1.3


def test_penalty_search_and_part_backtest(spark, daily):
    c = Controls(fast_mode=True, forecast_horizons_months=(6, 9))
    grid = backtest.penalty_search(pairs.adjacent_pairs(daily, 0), c).collect()
    assert len(grid) == 3 and sum(r.selected for r in grid) == 1 and all(r.mean_wape < 0.05 and r.n_cutoffs == 1 for r in grid)
    detail = backtest.part_backtest(daily, c, cutoffs=[date(2022, 9, 30)]).persist()
    assert detail.count() == 7 * (40 * 6 + 40 * 9)
    summary = backtest.part_backtest_summary(detail)
    by = {(r.model, r.horizon_months): r for r in summary.collect()}
    assert by["hierarchical", 6].wape < by["last_price", 6].wape
    want = np.mean([1 - math.exp(-0.01 * k) for k in range(1, 7)])
    assert by["last_price", 6].wape == pytest.approx(want, rel=0.1)
    assert by["last_price", 6].interval_coverage is None and by["hierarchical", 6].interval_coverage is not None
    assert backtest.select_model(summary, c) != "last_price"
    assert backtest.select_model(summary, Controls(selected_model_mode="tornqvist")) == "tornqvist"


def test_penalty_search_repeats_no_pair_by_candidate(spark, uneven, monkeypatch):
    held, spread = [], robust.spread_out

    def spread_out(rows, *given):
        out = spread(rows, *given)
        held.append(out[0].count())
        return out

    monkeypatch.setattr(robust, "spread_out", spread_out)
    grid = backtest.penalty_search(uneven, Controls(part_min_intervals=2, part_min_span_days=90)).collect()
    low, high = uneven.agg(F.min("date_b"), F.max("date_b")).first()
    cutoffs = backtest.quarter_ends(backtest._shift(low, 12), backtest._shift(high, -3))[-4:]
    assert len(grid) == len(backtest.PENALTIES) and len(cutoffs) > 1 and {r.n_cutoffs for r in grid} == {len(cutoffs)}
    assert held == [sum(uneven.where(F.col("date_b") <= F.lit(d)).count() for d in cutoffs)]


def test_variants_side_by_side_equal_one_at_a_time(spark, uneven):
    own = [Controls(lambda_smooth=s, lambda_gamma=g, category_min_pairs=10, part_min_intervals=2, part_min_span_days=90) for s, g in backtest.PENALTIES[:3]]
    train = uneven.withColumn("run", F.explode(F.array(F.lit("2022-12-31"), F.lit("2023-03-31")))).where(F.col("date_b") <= F.col("run").cast("date"))
    train = pairs.pair_weights(train, by=("run",)).persist()
    fits = regression.fit_runs(train, own[0], variants=own)
    alone = [regression.fit_runs(train, c) for c in own]
    assert sorted(fits) == sorted(f"{run}|{i}" for i, a in enumerate(alone) for run in a)
    for i, models in enumerate(alone):
        for run, m in models.items():
            got = fits[f"{run}|{i}"]
            assert got.months == m.months and got.n_pairs == m.n_pairs and sorted(got.differences) == sorted(m.differences) and m.differences
            np.testing.assert_allclose([*got.delta0, got.gamma0, got.sigma], [*m.delta0, m.gamma0, m.sigma], atol=1e-9)
            for c in m.differences:
                np.testing.assert_allclose(got.differences[c], m.differences[c], atol=1e-9)
    spans = uneven.select("part_key", "approved_category", "date_a", "date_b", F.lit("2022-12-31").alias("run"))
    ahead = [{run: [0.002 * (i + 1)] * 3 for run in models} for i, models in enumerate(alone)]
    many = {(r.part_key, r.date_a): r for r in backtest._part_growths(train, spans, alone, ahead, own[0]).collect()}
    for i in range(len(own)):
        rows = backtest._part_growth(train, spans, alone[i], ahead[i], own[i]).collect()
        assert len(rows) == len(many) and any(r.residual for r in rows)
        for r in rows:
            got = many[r.part_key, r.date_a]
            assert (got[f"log_category_{i}"], got[f"residual_{i}"], got.source, got.category) == (pytest.approx(r.log_category), pytest.approx(r.residual), r.source, r.category)


def test_growth_by_ends_equals_months_one_by_one(spark):
    rng = np.random.default_rng(3)
    path, first = rng.normal(0, 0.02, 14), 2022 * 12 + 4
    paths = [("r", None, first, path.tolist(), 0.3), ("r", "A", first, (path + 0.01).tolist(), 0.4)]
    rows = []
    for k in range(300):
        a = date(2021, 11, 1) + timedelta(days=int(rng.integers(0, 900)))
        rows.append((k, "rq"[k % 10 == 0], "AB"[k % 2] if k % 7 else None, a, a + timedelta(days=int(rng.integers(0, 700)))))
    got = regression.log_growth(spark.createDataFrame(rows, "k int, run string, category string, date_a date, date_b date"), paths).collect()
    own = {"A": path + 0.01}
    for r in got:
        want = 0.0 if r.run == "q" or r.date_b <= r.date_a else resampling._growth(first, own.get(r.category, path), r.date_a, r.date_b)
        assert r.log_growth == pytest.approx(want, abs=1e-12) and r.gamma == (0.0 if r.run == "q" else 0.4 if r.category == "A" else 0.3)


def test_log_growth_by_hand(spark):
    paths = [("r", None, 2023 * 12, [0.01, 0.02], 0.0), ("r", "A", 2023 * 12, [0.03, 0.05], 0.0)]
    rows = [("A", date(2023, 1, 31), date(2023, 2, 28)), ("B", date(2022, 12, 31), date(2023, 1, 31)), ("B", date(2023, 2, 28), date(2023, 4, 30)), ("A", date(2023, 1, 5), date(2023, 1, 5))]
    got = regression.log_growth(spark.createDataFrame([("r", *x) for x in rows], "run string, category string, date_a date, date_b date"), paths)
    by = {(r.category, r.date_b): r.log_growth for r in got.collect()}
    assert [by[c, b] for c, _, b in rows] == pytest.approx([0.05, 0.01, 0.04, 0.0])


@pytest.mark.parametrize("name, function", [("composite_backtest", "composite_backtest"), ("bootstrap_bands", "bootstrap_forecasts"), ("penalty_search", "penalty_search"), ("part_backtest", "part_backtest")])
def test_registered_queries_take_the_whole_job(spark, monkeypatch, name, function):
    from unittest.mock import MagicMock

    from costweave.plans import registry

    class Reached(Exception):
        pass

    def reached(*given):
        raise Reached(*given)

    for part in ("_flagged", "_daily", "_classified", "_committed"):
        monkeypatch.setattr(registry, part, MagicMock())
    for module, part in ((registry.panel, "realized_daily"), (registry.basket, "fiscal_weights"), (registry.committed, "committed_signal")):
        monkeypatch.setattr(module, part, MagicMock())
    if name == "bootstrap_bands":
        monkeypatch.setattr(registry, "_backtest", MagicMock())
        summary = MagicMock()
        summary.return_value.where.return_value.first.return_value.method = "ewma"
        monkeypatch.setattr(registry.backtest, "backtest_summary", summary)
    monkeypatch.setattr(registry.backtest, function, reached)
    with pytest.raises(Reached) as got:
        registry.queries()[name](spark, "")
    assert Controls() in got.value.args and (name != "bootstrap_bands" or "ewma" in got.value.args)
