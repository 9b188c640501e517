import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from costweave.config import Controls
from costweave.operators import backtest, pairs, regression, resampling, robust

CUTOFFS = [date(2022, 3, 31), date(2022, 9, 30), date(2023, 3, 31)]


@pytest.fixture(scope="module")
def days(spark):
    """Days of fifty parts of three categories with noise, jumps, quantities, gaps and short gaps."""
    rng = np.random.default_rng(11)
    rows = []
    for p in range(50):
        for m in sorted(rng.choice(30, rng.integers(4, 16), replace=False).tolist()):
            for day in (3, 17)[: 1 + (m % 5 == 0)]:
                jump = 6.0 if rng.random() < 0.03 else 1.0
                q = float(rng.integers(0, 9)) or None
                price = 10 * jump * math.exp(0.01 * m + 0.02 * (p % 3) * m / 12 + rng.normal(0, 0.05))
                rows.append((f"P{p:02d}", date(2021 + m // 12, m % 12 + 1, day), price, q, price * (q or 1.0), ("Inventory", "COS", None)[p % 3]))
    return spark.createDataFrame(rows, "part_key string, po_date date, price double, qty double, spend double, approved_category string").persist()


@pytest.mark.parametrize("method, extremes", [("capped_spend_sqrt_n", True), ("capped_spend_sqrt_n", False), ("equal_part", True)])
def test_fits_of_cutoffs_equal_those_of_repeated_pairs(spark, days, method, extremes):
    c = Controls(pair_weight_method=method, category_min_pairs=10)
    plain = backtest.pairs_by_cutoff(days, CUTOFFS, 30)
    plain = pairs.flag_extremes(plain, by=("run",)) if extremes else plain.withColumn("extreme_flag", F.lit(False))
    want = regression.fit_runs(pairs.pair_weights(plain, method, by=("run",)).persist(), c)
    got = resampling.fit_known(backtest.known_pairs(days, CUTOFFS, 30).persist(), [d.isoformat() for d in CUTOFFS], c, extremes)
    assert sorted(got) == sorted(want) == [d.isoformat() for d in CUTOFFS]
    for run, m in want.items():
        assert (got[run].months, got[run].n_pairs, sorted(got[run].differences), got[run].converged) == (m.months, m.n_pairs, sorted(m.differences), m.converged) and m.differences
        np.testing.assert_allclose([*got[run].delta0, got[run].gamma0, got[run].sigma], [*m.delta0, m.gamma0, m.sigma], atol=1e-9)
        for k in m.differences:
            np.testing.assert_allclose(got[run].differences[k], m.differences[k], atol=1e-9)


def test_composite_backtest_repeats_no_pair_by_cutoff(spark, days, monkeypatch):
    held, spread = [], robust.spread_out

    def spread_out(rows, *given):
        out = spread(rows, *given)
        held.append(out[0].count())
        return out

    monkeypatch.setattr(robust, "spread_out", spread_out)
    lines = days.select("part_key", F.col("po_date").alias("effective_date"), F.col("approved_category").alias("direct_category"), F.lit(True).alias("in_direct_costs"), F.col("spend").alias("realized_spend"))
    detail = backtest.composite_backtest(days, lines, date(2023, 6, 30), Controls(), CUTOFFS[::-1], min_pairs=20)
    assert {r.cutoff for r in detail.collect()} <= set(CUTOFFS) and detail.count() > 0
    once = pairs.adjacent_pairs(days, 30).where(F.col("date_b") <= F.lit(CUTOFFS[-1])).count()
    assert held == [once]


def test_sums_are_the_same_added_up_by_spark_and_by_the_driver(spark, days):
    rows, _ = robust.spread_out(regression.span_rows(pairs.adjacent_pairs(days), 2021 * 12).select("first", "last", "head", "tail", "x_q", "y", F.lit("a\tb").alias("unit"), F.lit(1.0).alias("w")).repartition(5))
    state = {"a\tb": (np.zeros(32), 0.1), "a\tOverall": (np.full(32, 0.01), 0.2)}
    one, two = (robust.equations(rows, robust.plain_groups, state, 32, 1.5, direct) for direct in (True, False))
    assert sorted(one) == sorted(two) == sorted(state) and all((one[u] == two[u]).all() and one[u].shape == (32, 33) for u in one)


def test_a_table_for_fits_has_a_bounded_number_of_tasks(spark, days):
    many = days.repartition(90).withColumn("first", F.lit(1))
    rows, tasks = robust.spread_out(many.repartition(90))
    assert tasks <= max(robust.DIRECT, 2 * spark.sparkContext.defaultParallelism) and rows.count() == days.count()
    rows.unpersist()


def test_counting_by_zones_side_by_side_equals_bins_one_unit_at_a_time():
    rng = np.random.default_rng(2)
    values, times = rng.normal(size=(4000, 6)), rng.poisson(1.0, (4000, 6)).astype(float)
    known = robust.Target(4000.0, 400)
    apart = robust.around(known, (-0.01, 0.01), (0.67, 0.68), 0.01, None, True)
    sent = robust.around(known, (-0.001, 0.001), (0.674, 0.675), 0.001, (np.array([-9.0]), np.array([9.0]), np.array([10.0])), True)
    crossed = robust.around(known, (-0.5, 0.5), (0.1, 0.8), 0.5, None, True)
    targets = {"a": apart, "b": sent, "c": crossed, "d": robust.Target(4000.0, 400), "e": robust.begun(50.0, 400), "f": apart}
    assert sent.ship and robust._zone_ends(crossed) is None and len(robust._zone_ends(apart)) == 6
    counter = robust._Counter(list(targets), targets)
    for a in range(0, 4000, 700):
        counter.add(values[a : a + 700], times[a : a + 700])
        if a % 1400:
            counter.flush()
    counter.flush()
    for k, (unit, counts, near, n) in enumerate(counter.found()):
        whole, v, m = robust._bins(values[:, k], times[:, k], targets[unit])
        assert counts.tolist() == whole.tolist()
        if len(v) <= targets[unit].limit:
            assert (near.tolist(), n.tolist()) == (v.tolist(), m.tolist())
    assert counts.sum() == times[:, 5].sum()


def test_draws_stop_at_the_first_step_that_holds_them(spark):
    rows = resampling.with_times(spark.range(200).withColumn("part_key", F.col("id").cast("string")), 40, 7)
    got = [x for r in rows.collect() for x in r.times[1:]]
    assert all(r.times[0] == 1 for r in rows.collect()) and abs(np.mean(got) - 1) < 0.05 and abs(np.mean([x == 0 for x in got]) - math.exp(-1)) < 0.02
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert ">= 0.36787944" not in plan  # no sum over all steps for every draw


def test_part_backtest_side_by_side_equals_a_row_a_model(spark, days):
    c = Controls(forecast_horizons_months=(3, 6), part_min_intervals=2, part_min_span_days=90, category_min_pairs=10)
    wide = backtest.part_backtest(days, c, CUTOFFS[1:], wide=True).persist()
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan  # rows come from written rows of parts, nothing is dealt by cutoff or horizon
    detail = backtest.part_backtest(days, c, CUTOFFS[1:]).persist()
    assert detail.count() == 7 * wide.count() > 0
    rows = {(r.cutoff, r.horizon_months, r.part_key, r.actual_date): r for r in wide.collect()}
    last = {}
    for r in rows.values():
        last[r.cutoff, r.horizon_months, r.part_key] = max(r.actual_date, last.get((r.cutoff, r.horizon_months, r.part_key), r.actual_date))
    assert all(r.is_last == (r.actual_date == last[r.cutoff, r.horizon_months, r.part_key]) for r in rows.values())
    # The plain form: pairs repeated by cutoff, residuals and growths joined by cutoff and part.
    known = backtest.pairs_by_cutoff(days, CUTOFFS[1:]).withColumn("extreme_flag", F.lit(False))
    train = pairs.pair_weights(known, c.pair_weight_method, by=("run",)).persist()
    models = regression.fit_runs(train, c)
    ahead = backtest.future_rates(spark, models, {run: backtest._shift(date.fromisoformat(run), 6) for run in models}, (3, 6, 12))
    spans = wide.select(F.col("cutoff").cast("string").alias("run"), "horizon_months", "part_key", F.col("base_date").alias("date_a"), F.col("actual_date").alias("date_b"), F.col("category").alias("approved_category"))
    plain = backtest._part_growth(train, spans, models, ahead, c).collect()
    assert len(plain) == len(rows) and any(r.residual for r in plain) and {r.source for r in plain} >= {"part"}
    for r in plain:
        got = rows[date.fromisoformat(r.run), r.horizon_months, r.part_key, r.date_b]
        years = (r.date_b - r.date_a).days / 365.25
        assert got.source == r.source and got.predicted_category_benchmark == pytest.approx(got.base_price * math.exp(r.log_category), rel=1e-9)
        assert got.predicted_hierarchical == pytest.approx(got.base_price * math.exp(r.log_category + r.residual * years), rel=1e-8)
    one, two = ({(r.model, r.horizon_months): r for r in backtest.part_backtest_summary(x).collect()} for x in (wide, detail))
    assert set(one) == set(two) and len(one) == 14
    for key, want in two.items():
        assert list(one[key].asDict()) == list(want.asDict()) and all(a == (None if b is None else pytest.approx(b, rel=1e-9)) for a, b in zip(one[key][2:], want[2:], strict=True))
