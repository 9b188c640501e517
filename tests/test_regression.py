import calendar
import math
from datetime import date, timedelta

import numpy as np
import pytest

from costweave.config import Controls
from costweave.operators import pairs, regression, robust


def observed(spark, rows):
    return spark.createDataFrame([(p, d, float(x), float(q), float(x * q), "Inventory") for p, d, x, q in rows], "part_key string, po_date date, price double, qty double, spend double, approved_category string")


def weighted(spark, rows, gap=0):
    return pairs.pair_weights(pairs.flag_extremes(pairs.adjacent_pairs(observed(spark, rows), gap)))


@pytest.fixture(scope="module")
def steady(spark):
    """Thirty parts over twelve months at one per cent a month, with noise."""
    rng = np.random.default_rng(3)
    rows = [(f"P{p}", date(2023 + m // 12, m % 12 + 1, 1), 10 * math.exp(0.01 * m + rng.normal(0, 0.005)), 1) for p in range(30) for m in range(12)]
    return weighted(spark, rows).persist()


def dense_fit(frame, months, c):
    x = np.zeros((len(frame), len(months) + 1))
    for i, (a, b) in enumerate(zip(frame.date_a, frame.date_b, strict=True)):
        for j, m in enumerate(months):
            last = date(m.year, m.month, calendar.monthrange(m.year, m.month)[1])
            x[i, j] = max(0, (min(b, last) - max(a, m - timedelta(1))).days / last.day)
    x[:, -1] = frame.x_q
    y, w = frame.y.to_numpy(), frame.pair_weight.to_numpy()
    n = len(months)
    d2 = np.diff(np.eye(n), n=2, axis=0)
    penalty = np.zeros((n + 1, n + 1))
    penalty[:n, :n] = c.lambda_smooth * d2.T @ d2 + c.lambda_ridge * np.eye(n)
    penalty[-1, -1] = c.lambda_gamma
    theta = np.zeros(n + 1)
    for _ in range(60):
        r = y - x @ theta
        sigma = max(1e-6, np.median(np.abs(r - np.median(r))) / 0.6745)
        v = w * np.minimum(1.0, c.huber_delta / np.maximum(np.abs(r / sigma), 1e-300))
        new = np.linalg.solve(x.T @ (x * v[:, None]) + penalty, x.T @ (v * y))
        change, theta = np.linalg.norm(new - theta) / (1 + np.linalg.norm(theta)), new
        if change < 1e-6:
            break
    return theta


def test_repeat_sales_equals_a_dense_fit_and_recovers_the_rate(spark, steady):
    c = Controls(lambda_ridge=0.01, lambda_smooth=1.0)
    model = regression.fit_repeat_sales(steady, c)
    theta = dense_fit(steady.toPandas(), model.months, c)
    assert model.converged and np.abs(model.delta0 - theta[:-1]).max() < 1e-9
    assert float(np.mean(model.delta0)) == pytest.approx(0.01, abs=0.002)
    assert set(model.differences) == {"Inventory"}
    residuals = regression.part_residuals(regression.predict_pairs(steady, model))
    rows = residuals.collect()
    assert len(rows) == 30 and all(abs(r.residual_rate) < 0.1 for r in rows) and {r.source for r in rows} == {"category"}


def test_no_pairs(spark, steady):
    model = regression.fit_repeat_sales(steady.limit(0))
    assert not model.converged and model.warnings and model.months == []


def test_joint_huber_recovers_rate_and_elasticity(spark):
    rng = np.random.default_rng(0)
    rows = []
    for p in range(40):
        price, qty = 10.0, 5.0
        for k in range(8):
            rows.append((f"P{p}", date(2015 + k // 3, 1 + 4 * (k % 3), 1), price, qty))
            step = float(rng.normal(0, 0.25))
            qty, price = qty * math.exp(step), price * math.exp(math.log(1.08) / 3 - 0.07 * step + float(rng.normal(0, 0.005)))
    got = regression.joint_huber(pairs.adjacent_pairs(observed(spark, rows)), trims=(0.0, 0.01)).collect()
    assert len(got) == 4
    for r in got:
        assert r.converged and r.annual_rate == pytest.approx(0.08, abs=0.02) and r.gamma == pytest.approx(-0.07, abs=0.03)


def test_joint_huber_holds_a_pair_once_and_equals_dense_rounds(spark, monkeypatch):
    held, spread = [], robust.spread_out

    def spread_out(rows, *given):
        out = spread(rows, *given)
        held.append(out[0].count())
        return out

    monkeypatch.setattr(robust, "spread_out", spread_out)
    rng = np.random.default_rng(1)
    n = 400
    rows = [(f"P{i % 37}", float(y), float(t), float(x), float(q), 2.0, float(s), 5.0, 1 + i % 9) for i, (y, t, x, q, s) in enumerate(zip(rng.standard_t(2, n) * 0.1, rng.uniform(0.1, 2, n), rng.normal(0, 0.3, n), rng.integers(0, 5, n), rng.choice([0.0, 3.0, 50.0], n)))]
    table = spark.createDataFrame(rows, "part_key string, y double, delta_years double, x_q double, qty_a double, qty_b double, spend_a double, spend_b double, n_pairs_part long")
    assert tuple(table.columns) == regression.HUBER_COLUMNS
    trims = (0.0, 0.05)
    got = {(r.trim, r.weighting): r for r in regression.joint_huber(table, trims).collect()}
    whole = [r for r in rows if r[4] > 0]
    assert held == [len(whole)] and len(got) == 4
    for trim in trims:
        rate = np.array([r[1] / r[2] for r in whole])
        low, high = np.quantile(rate, [trim, 1 - trim])
        some = [r for r, a in zip(whole, rate) if low <= a <= high]
        y, t, x, b, k = (np.array(v) for v in zip(*((r[1], r[2], r[3], math.sqrt(r[6] * r[7]), r[8]) for r in some)))
        w = np.minimum(b, np.quantile(b, 0.95)) / np.sqrt(k)
        for kind, u in (("unweighted", np.ones(len(y))), ("spend_weighted", w / w.mean())):
            theta, s, m = np.zeros(2), y.std(), np.column_stack([t, x])
            for _ in range(200):
                r = np.abs(y - m @ theta)
                near = r <= 1.35 * s
                v = u * np.where(near, 1, 1.35 * s / r)
                new = np.linalg.solve(m.T @ (v[:, None] * m) + 0.1 * s * np.eye(2), m.T @ (v * y))
                scale = math.sqrt((u * near * r * r).sum() / (u * np.where(near, 1, 1 - 1.35**2)).sum())
                stop = np.abs(new - theta).sum() + abs(scale - s) < 1e-6 * (1 + s)
                theta, s = new, scale
                if stop:
                    break
            found = got[trim, kind]
            assert (found.n_pairs, found.n_parts) == (len(some), len({r[0] for r in some})) and found.converged
            assert [found.beta_t, found.gamma] == pytest.approx(theta.tolist(), abs=1e-9)


@pytest.mark.parametrize("units", [1, 3])
def test_equations_by_ends_equal_dense_products_of_month_shares(units):
    rng, months, n = np.random.default_rng(0), 40, 500
    a = rng.integers(0, months * 30 - 2, n)  # months of 30 days; a row covers the days a + 1 to b
    b = np.minimum(a + rng.integers(1, 400, n), months * 30 - 1)
    x = np.zeros((n, months + 1))
    for m in range(months):
        x[:, m] = np.clip(np.minimum(b, m * 30 + 29) - np.maximum(a, m * 30 - 1), 0, None) / 30
    x[:, -1] = rng.normal(size=n)
    first, last = (a + 1) // 30, b // 30
    head, tail = np.where(first == last, 1.0, (30 - (a + 1) % 30) / 30), np.where(first == last, (b - a) / 30, (b % 30 + 1) / 30)
    spans, at = robust.Spans(first, last, head, tail, x[:, -1]), np.flatnonzero(rng.random(n) < 0.7)
    theta, weights, y = rng.normal(size=(months + 1, units)), rng.random((len(at), units)), rng.normal(size=n)
    assert (first == last).any() and np.abs(spans.predicted(at, theta) - x[at] @ theta).max() < 1e-12
    total = np.zeros((months + 2, months + 3, units))
    robust._add_products(total, spans, at, weights, y)
    for k in range(units):
        dense = np.column_stack([x[at].T @ (x[at] * weights[:, [k]]), x[at].T @ (weights[:, k] * y[at])])
        assert np.abs(robust._by_months(total[:, :, k]) - dense).max() < 1e-10


def test_indices_and_backtests_read_small_written_tables_instead_of_lines(spark):
    from costweave.operators import indices
    from costweave.plans import registry

    index = registry._link_index(spark, "/root/testdata/sf0.001")
    assert index.inputFiles() and not any("lineitem" in f for f in index.inputFiles())
    daily = registry._written_daily(spark, "/root/testdata/sf0.001")
    assert daily.columns == ["part_key", "po_date", "price", "qty", "spend", "approved_category"]
    found = indices.all_benchmarks(daily)
    assert not any("lag(" in found[f"{k}_FY"]._jdf.queryExecution().optimizedPlan().toString() for k in ("matched", "tornqvist", "fisher"))


def test_predicted_growth_follows_the_ends_of_a_pair(spark):
    months = [date(2020 + m // 12, m % 12 + 1, 1) for m in range(30)]
    rng = np.random.default_rng(4)
    model = regression.RepeatSales(months, rng.normal(0, 0.02, 30), 0.1, 0.01, True, 9, {"own": rng.normal(0, 0.02, 30)}, {"own": 0.05})
    ends = [(date(2020, 1, 1), date(2020, 1, 20)), (date(2020, 1, 31), date(2020, 2, 29)), (date(2020, 3, 10), date(2022, 6, 30)), (date(2021, 5, 5), date(2021, 6, 6))]
    frame = spark.createDataFrame([(a, b, c, x) for a, b in ends for c in ("own", "other", None) for x in (0.0, 0.3)], "date_a date, date_b date, approved_category string, x_q double")
    made = regression.predict_pairs(frame, model)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert made.columns == [*frame.columns, "predicted"] and "sequence(" not in plan  # no months a pair
    for r in made.collect():
        rates, gamma = (model.delta0 + model.differences["own"], 0.15) if r.approved_category == "own" else (model.delta0, 0.1)
        days = [(r.date_a.toordinal() + 1 + i) for i in range((r.date_b - r.date_a).days)]
        want = sum(rates[(d.year - 2020) * 12 + d.month - 1] / calendar.monthrange(d.year, d.month)[1] for d in map(date.fromordinal, days)) + gamma * r.x_q
        assert r.predicted == pytest.approx(want, abs=1e-12)
