"""Robust regressions whose sums are made by Spark: repeat sales, joint Huber, residual shrinkage."""

from __future__ import annotations

import calendar
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import date
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costweave.config import Controls
from costweave.functions import columns as C
from costweave.operators import robust
from costweave.operators.quantiles import percentiles

#: Name of the unit that holds all pairs.
OVERALL = "Overall"


@dataclass
class RepeatSales:
    """Monthly rates of the overall path, and of each category as its shrunk difference from it."""

    months: list[date]
    delta0: np.ndarray
    gamma0: float
    sigma: float
    converged: bool
    n_pairs: int
    differences: dict[str, np.ndarray] = field(default_factory=dict)
    kappa: dict[str, float] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def rates(self, spark) -> DataFrame:
        """``series, month, rate`` of the overall path and of every category with one of its own."""
        rows = [(OVERALL, m, float(r)) for m, r in zip(self.months, self.delta0, strict=True)]
        for c, u in self.differences.items():
            rows += [(c, m, float(a + b)) for m, a, b in zip(self.months, self.delta0, u, strict=True)]
        return spark.createDataFrame(rows, "series string, month date, rate double")


def _month_number(d) -> F.Column:
    return F.year(d) * 12 + F.month(d) - 1


def exposure_rows(pairs: DataFrame, first_month: int) -> DataFrame:
    """Pairs with their month shares as one short array from month ``first`` on."""
    months = F.sequence(F.trunc(F.date_add("date_a", 1), "month"), F.trunc("date_b", "month"), F.expr("interval 1 month"))

    def share(m):
        days = F.datediff(F.least(F.col("date_b"), F.last_day(m)), F.greatest(F.col("date_a"), F.date_sub(m, 1)))
        return F.greatest(days, F.lit(0)) / F.day(F.last_day(m))

    return pairs.withColumns({"first": (_month_number(F.date_add("date_a", 1)) - first_month).cast("int"), "shares": F.transform(months, share)})


def span_rows(pairs: DataFrame, first_month: int) -> DataFrame:
    """Pairs with the months of their first and last day, the part of the first from that day on and of the last up to it (:class:`costweave.operators.robust.Spans`)."""
    start, end = F.date_add("date_a", 1), F.col("date_b")
    first, last = _month_number(start), _month_number(end)
    length = lambda d: F.day(F.last_day(d))
    return pairs.withColumns({
        "first": (first - first_month).cast("int"), "last": (last - first_month).cast("int"), "head": F.when(first == last, 1.0).otherwise((length(start) - F.day(start) + 1) / length(start)),
        "tail": F.when(first == last, F.datediff("date_b", "date_a") / length(end)).otherwise(F.day(end) / length(end)),
    })


def penalty_matrix(n_months: int, c: Controls) -> np.ndarray:
    """Smoothness of the monthly rates, a small ridge on each, and one on the elasticity."""
    penalty = np.zeros((n_months + 1, n_months + 1))
    if n_months >= 3:
        d2 = np.diff(np.eye(n_months), n=2, axis=0)
        penalty[:n_months, :n_months] += c.lambda_smooth * (d2.T @ d2)
    penalty[np.arange(n_months), np.arange(n_months)] += c.lambda_ridge
    penalty[-1, -1] += c.lambda_gamma
    return penalty


def fit_runs(weighted_pairs: DataFrame, controls: Controls | None = None, run: str = "run", variants: list[Controls] | None = None, max_rounds: int | None = None) -> dict[str, RepeatSales]:
    """Repeat-sales fits of many runs (cutoffs, resamples) in the jobs of one: ``run -> model``.

    ``weighted_pairs`` carries ``pair_weight`` and a run name in every row. A run's months go from its own first to its own last.
    Each category is fitted on its own pairs with the run's weights and months, then shrunk to the overall path by
    n / (n + category_min_pairs). Categories with too few pairs or without convergence fall back
    to the overall path, with a warning. Runs without pairs are absent.

    With ``variants`` each run is fitted under each of these controls (penalties), and models are named ``run|number``. No row
    is repeated for that: a task adds up the equations of all variants from the same rows.
    """
    c = controls or Controls()
    ends = weighted_pairs.groupBy(F.col(run).alias("run")).agg(F.min(_month_number(F.date_add("date_a", 1))).alias("low"), F.max(_month_number(F.col("date_b"))).alias("high")).collect()
    if not ends:
        return {}
    first, last = min(r.low for r in ends), max(r.high for r in ends)
    span = {r.run: (r.low - first, r.high - first + 1) for r in ends}
    size = last - first + 2
    category = F.coalesce("approved_category", F.lit("Uncategorized"))
    unit = F.concat_ws("\t", run, category).alias("unit")
    rows = span_rows(weighted_pairs, first).select(unit, "first", "last", "head", "tail", "x_q", "y", F.col("pair_weight").alias("w"))
    rows, tasks = robust.spread_out(rows, ("unit", "first", "last") if variants else ())
    try:
        counts: dict[str, int] = {}
        for r in rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).collect():
            for name in {r.unit, f"{r.unit.split(chr(9), 1)[0]}\t{OVERALL}"}:
                counts[name] = counts.get(name, 0) + r.n
        if variants:
            each = range(len(variants))
            span = {f"{name}|{i}": ends for name, ends in span.items() for i in each}
            counts = {f"{name}|{i}\t{cat}": n for (name, cat), n in ((u.split("\t", 1), n) for u, n in counts.items()) for i in each}
        groups = partial(robust.variant_groups, len(variants)) if variants else robust.plain_groups
        fits = fitted(rows, groups, counts, span, size, c, tasks, (lambda name: variants[int(name.rsplit("|", 1)[1])]) if variants else None, max_rounds)
    finally:
        rows.unpersist()
    return models_of(fits, span, first, c)


def fitted(rows: DataFrame, groups_of: Callable, counts: dict, span: dict, size: int, c: Controls, tasks: int, controls_of: Callable | None = None, max_rounds: int | None = None, start: dict | None = None) -> dict:
    """Fits of units named ``run, tab, category``; a run's months limit its coefficients."""
    places = lambda u: np.array([*range(*span[u.split("\t", 1)[0]]), size - 1])
    penalty = lambda u, n: penalty_matrix(n, controls_of(u.split("\t", 1)[0]) if controls_of else c)
    return robust.fit(rows, groups_of, counts, size, places, penalty, c.huber_delta, max_rounds or (30 if c.fast_mode else 60), tasks, start)


def models_of(fits: dict, span: dict, first: int, c: Controls) -> dict[str, RepeatSales]:
    """The fits as one model a run, categories shrunk to their overall path."""
    out = {}
    for name, (low, high) in span.items():
        theta, sigma, converged, n = fits[f"{name}\t{OVERALL}"]
        months = [date(m // 12, m % 12 + 1, 1) for m in range(first + low, first + high)]
        model = RepeatSales(months, theta[low:high], float(theta[-1]), sigma, converged, n)
        if not converged:
            model.warnings.append("the overall fit did not converge")
        out[name] = model
    for unit_name in sorted(fits):
        name, category_name = unit_name.split("\t", 1)
        if category_name == OVERALL:
            continue
        model, (low, high), (own, _, ok, n_own) = out[name], span[name], fits[unit_name]
        if n_own < max(8, min(25, c.category_min_pairs)) or not ok:
            model.warnings.append(f"{category_name}: {n_own} pairs, {'no convergence' if n_own >= 8 else 'too few'}; overall path used")
            continue
        b = n_own / (n_own + max(float(c.category_min_pairs), 1.0))
        model.differences[category_name], model.kappa[category_name] = b * (own[low:high] - model.delta0), float(b * (own[-1] - model.gamma0))
    return out


def fit_repeat_sales(weighted_pairs: DataFrame, controls: Controls | None = None) -> RepeatSales:
    """Monthly log rates from repeat purchases, overall and by category: one run of ``fit_runs``."""
    fits = fit_runs(weighted_pairs.withColumn("run", F.lit("all")), controls)
    return fits.get("all") or RepeatSales([], np.zeros(0), 0.0, float("nan"), False, 0, warnings=["no repeat-purchase pairs"])


def growth_paths(models: dict[str, RepeatSales], future: dict[str, list[float]] | None = None) -> list[tuple]:
    """``run, category, first month number, monthly rates, elasticity`` of every fitted path; the overall one has a null category.

    Rates after the last fitted month are those of ``future`` plus the category's mean difference over its last year.
    """
    out = []
    for run, m in models.items():
        if not m.months:
            continue
        first, ahead = m.months[0].year * 12 + m.months[0].month - 1, np.array((future or {}).get(run, []), float)
        out.append((run, None, first, [*m.delta0.tolist(), *ahead.tolist()], m.gamma0))
        for c, u in m.differences.items():
            out.append((run, c, first, [*(m.delta0 + u).tolist(), *(ahead + u[-12:].mean()).tolist()], m.gamma0 + m.kappa[c]))
    return out


def log_growth(spans: DataFrame, paths: list[tuple], category: str = "category", out: str = "log_growth") -> DataFrame:
    """Adds the log price change over (date_a, date_b] and the elasticity ``gamma`` of each row's run and category (:func:`log_growths`)."""
    return log_growths(spans, [paths], category).withColumnsRenamed({"growth_0": out, "gamma_0": "gamma"})


def log_growths(spans: DataFrame, variants: list[list[tuple]], category: str = "category") -> DataFrame:
    """Adds for each set of paths ``growth_<number>``, the log price change over (date_a, date_b], and ``gamma_<number>``, by each row's run and category.

    A category without a path of its own takes the overall one; months outside a path take its last rate; a run
    without a path grows by nothing. A row's growth is the difference of two points on the running sum of the rates, however
    many months it spans (as in :class:`costweave.operators.robust.Spans`). Paths come from fits, which the driver holds: runs
    by categories by months numbers, broadcast.
    """
    found: dict[tuple, dict[int, tuple]] = {}
    for i, paths in enumerate(variants):
        for run, c, first, path, gamma in paths:
            found.setdefault((run, c), {})[i] = (first, [0.0, *np.cumsum(path).tolist()], float(path[-1]), float(gamma))
    rows = [(run, c, *(own.get(i) or found.get((run, None), {}).get(i) for i in range(len(variants)))) for (run, c), own in found.items()]
    kind = "struct<first: int, level: array<double>, beyond: double, gamma: double>"
    table = spans.sparkSession.createDataFrame(rows, "run string, c string, " + ", ".join(f"p{i} {kind}" for i in range(len(variants))))
    own = table.where("c is not null").select("run", F.col("c").alias(category), *(F.col(f"p{i}").alias(f"_own_{i}") for i in range(len(variants))))
    base = table.where("c is null").select("run", *(F.col(f"p{i}").alias(f"_base_{i}") for i in range(len(variants))))
    joined = span_rows(spans, 0).join(F.broadcast(base), "run", "left").join(F.broadcast(own), ["run", category], "left")
    f, l, h, t = (F.col(x) for x in ("first", "last", "head", "tail"))  # noqa: E741

    def growth(p):
        def point(m):
            at = m - p["first"]
            inside = F.greatest(F.lit(0), F.least(at, F.size(p["level"]) - 1))
            return F.get(p["level"], inside) + (at - inside) * p["beyond"]

        return F.when(F.col("date_b") > F.col("date_a"), point(l + 1) * t + point(l) * (1 - t) + point(f + 1) * (h - 1) - point(f) * h)

    columns = {}
    for i in range(len(variants)):
        p = F.coalesce(f"_own_{i}", f"_base_{i}")
        columns |= {f"growth_{i}": F.coalesce(growth(p), F.lit(0.0)), f"gamma_{i}": F.coalesce(p["gamma"], F.lit(0.0))}
    return joined.withColumns(columns).drop("first", "last", "head", "tail", *(f"_{which}_{i}" for which in ("own", "base") for i in range(len(variants))))


def daily_levels(paths: list[tuple], runs: list[str], categories: list[str], days: list[date]) -> np.ndarray:
    """Running sums of the daily rates up to the end of each day: runs by days by the overall path and ``categories``.

    The growth over (date_a, date_b] of :func:`log_growth` is the difference of two of them. A category without a path of its own takes the overall one.
    """
    found = {(run, c): (first, np.concatenate([[0.0], np.cumsum(path)]), float(path[-1])) for run, c, first, path, _ in paths}
    month = np.array([d.year * 12 + d.month - 1 for d in days])
    part = np.array([d.day / calendar.monthrange(d.year, d.month)[1] for d in days])
    out = np.zeros((len(runs), len(days), 1 + len(categories)))
    for i, run in enumerate(runs):
        for k, c in enumerate([None, *categories]):
            path = found.get((run, c)) or found.get((run, None))
            if path:
                first, level, beyond = path

                def point(m):
                    inside = np.clip(m - first, 0, len(level) - 1)  # noqa: B023
                    return level[inside] + (m - first - inside) * beyond  # noqa: B023

                out[i, :, k] = point(month) * (1 - part) + point(month + 1) * part
    return out


def predict_pairs(pairs: DataFrame, model: RepeatSales) -> DataFrame:
    """``predicted``: the model's log change of every pair; its category's path where it has one.

    A pair's growth is the difference of two points on the running sum of the rates, however many months it spans (as in
    :class:`costweave.operators.robust.Spans`); months outside the path count nothing.
    """
    spark = pairs.sparkSession
    if not model.months:
        return pairs.withColumn("predicted", F.lit(0.0))
    first = model.months[0].year * 12 + model.months[0].month - 1
    level = lambda rates: [0.0, *np.cumsum(rates).tolist()]
    paths = [(c, level(model.delta0 + u), model.gamma0 + model.kappa[c]) for c, u in model.differences.items()]
    own = spark.createDataFrame(paths, "c string, path array<double>, gamma double")
    p = span_rows(pairs, first).join(F.broadcast(own), F.col("approved_category") == F.col("c"), "left")
    base = F.array(*map(F.lit, level(model.delta0)))
    path, gamma = F.coalesce("path", base), F.coalesce("gamma", F.lit(model.gamma0))
    point = lambda m: F.get(path, F.greatest(F.lit(0), F.least(m, F.lit(len(model.months)))))
    f, l, h, t = (F.col(x) for x in ("first", "last", "head", "tail"))  # noqa: E741
    inside = point(l + 1) * t + point(l) * (1 - t) + point(f + 1) * (h - 1) - point(f) * h
    return p.withColumn("predicted", inside + gamma * F.col("x_q")).drop("first", "last", "head", "tail", "c", "path", "gamma")


def part_residuals(predicted: DataFrame, controls: Controls | None = None, by: tuple[str, ...] = (), variants: tuple[str, ...] = ("",), category: str | None = None) -> DataFrame:
    """Each part's yearly residual rate, shrunk by effective pairs, span and quality. One aggregation a part.

    ``category`` names a column that has the category of the part's first pair in all its rows; else it is looked for.
    For each of ``variants``, endings of names, from ``predicted<ending>``: ``residual_rate<ending>`` and ``shrunk_residual<ending>``.
    """
    c = controls or Controls()
    a = F.when(F.col("extreme_flag"), 0.25).otherwise(1.0) * F.when(F.col("qty_comparable"), 1.0).otherwise(0.7) * C.clip(F.col("delta_years") / (30 / 365.25), F.lit(0.1), F.lit(1.0))
    rows = predicted.withColumn("a", a)
    rate = lambda v: F.sum(F.col("a") * (F.col("y") - F.col(f"predicted{v}")) / F.greatest("delta_years", F.lit(1e-6))) / F.sum("a")
    first = [] if category else [F.min_by("approved_category", "date_a").alias("category")]
    g = rows.groupBy(*by, "part_key", *([F.col(category).alias("category")] if category else [])).agg(
        *first, F.count(F.lit(1)).alias("n_pairs"), F.datediff(F.max("date_b"), F.min("date_a")).cast("long").alias("span_days"), F.sum("a").alias("n_eff"),
        *(rate(v).alias(f"residual_rate{v}") for v in variants), F.avg(F.col("extreme_flag").cast("double")).alias("xs"), F.avg(F.col("qty_comparable").cast("double")).alias("qs"),
    )
    quality = C.clip((1 - F.col("xs")) * (0.5 + 0.5 * F.col("qs")), F.lit(0.0), F.lit(1.0))
    enough = (F.col("n_pairs") >= c.part_min_intervals) & (F.col("span_days") >= c.part_min_span_days)
    lam = F.when(enough, F.col("n_eff") / (F.col("n_eff") + c.part_shrinkage_k) * F.least(F.col("span_days") / 730.0, F.lit(1.0)) * F.col("quality")).otherwise(0.0)
    return g.withColumn("quality", quality).withColumn("shrinkage", lam).withColumns({**{f"shrunk_residual{v}": F.col("shrinkage") * F.col(f"residual_rate{v}") for v in variants}, "source": F.when(enough, "part").otherwise("category")}).drop("xs", "qs")


def monthly_index(rates: DataFrame, weights: DataFrame, base: date) -> DataFrame:
    """Index levels (first month 100) of every weighted category, of the arithmetic composite and overall.

    ``rates`` has ``series, month, rate``; a weighted category without a series uses the overall one.
    """
    from pyspark.sql import Window

    overall = rates.where(F.col("series") == OVERALL)
    own = rates.where(F.col("series") != OVERALL).select(F.col("series").alias("s"), F.col("month").alias("m"), F.col("rate").alias("r"))
    cats = weights.select("direct_category", "weight")
    full = overall.select("month", "rate").join(F.broadcast(cats)).join(own, (F.col("direct_category") == F.col("s")) & (F.col("month") == F.col("m")), "left")
    series = full.select(F.col("direct_category").alias("series"), "month", F.coalesce("r", "rate").alias("rate"), "weight").unionByName(overall.select(F.lit("Overall Direct Fit").alias("series"), "month", "rate", F.lit(None).cast("double").alias("weight")))
    w = Window.partitionBy("series").orderBy("month")
    level = 100 * F.exp(F.sum("rate").over(w) - F.first("rate").over(w))
    levels = series.withColumn("index_level", level)
    composite = levels.where("weight is not null").groupBy("month").agg((F.sum(F.col("weight") * F.col("index_level")) / F.sum("weight")).alias("index_level"))
    out = levels.drop("weight").unionByName(composite.select(F.lit("Combined Direct Costs").alias("series"), "month", F.lit(None).cast("double").alias("rate"), "index_level"))
    complete = F.last_day("month") <= C.last_complete_month_end(F.lit(base))
    return out.withColumn("status", F.when(complete, "complete").otherwise("partial"))


def fiscal_and_trailing_rates(index: DataFrame, base: date, start_month: int = 10) -> DataFrame:
    """Change over each fiscal year with both end months, and over the twelve months to the last complete month."""
    before = index.select("series", F.add_months("month", 12).alias("month"), F.col("index_level").alias("level_0"))
    both = index.join(before, ["series", "month"])
    end_month = start_month - 1 or 12
    change = (F.col("index_level") / F.col("level_0") - 1).alias("inflation_rate")
    fiscal = both.where(F.month("month") == end_month).select("series", C.fiscal_label(F.col("month"), start_month).alias("period"), F.lit("complete_fiscal_year").alias("period_type"), F.last_day("month").alias("end_date"), change)
    trailing = both.where(F.last_day("month") == C.last_complete_month_end(F.lit(base))).select("series", F.concat(F.lit("TTM through "), F.last_day("month").cast("string")).alias("period"), F.lit("trailing_12_months").alias("period_type"), F.last_day("month").alias("end_date"), change)
    return fiscal.unionByName(trailing)


#: What the joint Huber regression reads of pairs; a written table holds no more, so the rest is not worked out.
HUBER_COLUMNS = ("part_key", "y", "delta_years", "x_q", "qty_a", "qty_b", "spend_a", "spend_b", "n_pairs_part")


def _huber_moments(state: dict[tuple, tuple], epsilon: float, batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    """Sums of a round of :func:`joint_huber` for every fit (number of its trim, kind) in ``state``; weights are null outside a trim."""
    column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    whole = [column(c) for c in ("y", "t", "x_q")]
    for i in sorted({i for i, _ in state}):
        w = column(f"w_{i}")
        inside = ~np.isnan(w)
        (y, t, x), w = (whole, w) if inside.all() else ([v[inside] for v in whole], w[inside])
        for kind in ("unweighted", "spend_weighted"):
            if (i, kind) in state:
                bt, bq, s = state[i, kind]
                u = np.ones(len(w)) if kind == "unweighted" else w
                r = np.abs(y - bt * t - bq * x)
                near = r <= epsilon * s
                v = u * np.where(near, 1.0, epsilon * s / np.maximum(r, 1e-300))
                vt, vx = v * t, v * x
                yield f"{i}\t{kind}", np.array([vt @ t, vt @ x, vx @ x, vt @ y, vx @ y, (u * near) @ (r * r), u @ np.where(near, 1.0, 1 - epsilon**2)])


def joint_huber(pairs: DataFrame, trims: tuple[float, ...] = (0.0, 0.005, 0.01, 0.025), epsilon: float = 1.35, alpha: float = 0.1, cap_at: float = 0.95, max_rounds: int = 200) -> DataFrame:
    """Yearly rate and quantity elasticity by Huber regression with a joint scale, for every trim, weighted and not.

    ``pairs`` has positive quantities on both sides. Minimises sum w (s + H(r / s) s) + alpha |b|^2 over
    b = (rate, elasticity) and the scale s. All fits share the jobs and the rows: a pair has one row with its weight under every trim,
    a round sums a few moments a fit in one pass and the driver solves two-by-two systems. ``pairs`` should be a written table.
    """
    spark = pairs.sparkSession
    base = pairs.where((F.col("qty_a") > 0) & (F.col("qty_b") > 0)).select(
        "part_key", "y", F.col("delta_years").alias("t"), "x_q", (F.col("y") / F.greatest("delta_years", F.lit(1e-12))).alias("a"), F.sqrt(F.greatest(F.col("n_pairs_part").cast("double"), F.lit(1.0))).alias("root"),
        F.sqrt(F.greatest(F.coalesce("spend_a", F.lit(0.0)), F.lit(0.0)) * F.greatest(F.coalesce("spend_b", F.lit(0.0)), F.lit(0.0))).alias("b"),
    )
    rate = F.col("a")
    ends = {f"q{i}_{end}": (rate, p) for i, x in enumerate(trims) if x > 0 for end, p in (("low", x), ("high", 1 - x))}
    limits = percentiles(base, [], ends).first() if ends else None
    each = range(len(trims))
    kept = [F.col("a").between(limits[f"q{i}_low"], limits[f"q{i}_high"]) if x > 0 else F.lit(True) for i, x in enumerate(trims)]
    caps = percentiles(base, [], {f"cap_{i}": (F.when(kept[i], F.col("b")), cap_at) for i in each}).first()
    weight = [F.when(kept[i], F.least(F.col("b"), F.lit(caps[f"cap_{i}"]).cast("double")) / F.col("root")) for i in each]
    figures = lambda i: (F.avg(weight[i]).alias(f"mw_{i}"), F.count(F.when(kept[i], 1)).alias(f"n_{i}"), F.stddev_pop(F.when(kept[i], F.col("y"))).alias(f"s_{i}"))
    known = base.agg(*(x for i in each for x in figures(i))).first()
    has = base.where("part_key is not null").groupBy("part_key").agg(*(F.max(F.when(kept[i], 1).otherwise(0)).alias(f"has_{i}") for i in each))
    parts = has.agg(*(F.sum(f"has_{i}").alias(f"has_{i}") for i in each)).first()
    info = {(i, kind): (known[f"n_{i}"], int(parts[f"has_{i}"] or 0), known[f"s_{i}"]) for i in each if known[f"n_{i}"] for kind in ("unweighted", "spend_weighted")}
    state = {k: (0.0, 0.0, max(v[2] or 0.0, 1e-6)) for k, v in info.items()}
    relative = [F.when(kept[i], weight[i] / known[f"mw_{i}"] if (known[f"mw_{i}"] or 0) > 0 else F.lit(1.0)).alias(f"w_{i}") for i in each]
    rows, _ = robust.spread_out(base.select("y", "t", "x_q", *relative))
    done: dict[tuple, int] = {}
    try:
        for turn in range(1, max_rounds + 1):
            if len(done) == len(state):
                break
            sums = robust.sum_pass(rows, partial(_huber_moments, {k: v for k, v in state.items() if k not in done}, epsilon), direct=True)  # seven numbers a task and fit
            for k in [k for k in state if k not in done]:
                bt, bq, s = state[k]
                tt, tq, qq, ty, qy, rr, ww = sums[f"{k[0]}\t{k[1]}"].tolist()
                scale = float(np.sqrt(max(rr, 1e-18) / ww)) if ww > 0 else 1.5 * s
                b = np.linalg.solve(np.array([[tt, tq], [tq, qq]]) + alpha * s * np.eye(2), np.array([ty, qy]))
                state[k] = (float(b[0]), float(b[1]), max(scale, 1e-9))
                if abs(b[0] - bt) + abs(b[1] - bq) + abs(scale - s) < 1e-6 * (1 + abs(s)):
                    done[k] = turn
    finally:
        rows.unpersist()
    out = [(trims[k[0]], k[1], *info[k][:2], float(np.expm1(v[0])), v[0], v[1], float(2 ** v[1] - 1), k in done) for k, v in state.items()]
    return spark.createDataFrame(out, "trim double, weighting string, n_pairs long, n_parts long, annual_rate double, beta_t double, gamma double, qty_doubling_effect double, converged boolean")
