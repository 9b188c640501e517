"""Rolling-origin backtests, penalty search and resampled forecasts; all refits share the jobs of one."""

from __future__ import annotations

import calendar
import math
from dataclasses import replace
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costweave.config import Controls
from costweave.functions import columns as C
from costweave.operators import basket, forecast, indices, panel, regression, resampling
from costweave.operators.pairs import adjacent_pairs, pair_weights
from costweave.operators.quantiles import percentiles
from costweave.operators.sampling import weighted_sample
from costweave.plans.stages import staged

#: Models of the part-level backtest, the simplest first.
MODELS = ("last_price", "overall_cagr", "matched_part", "tornqvist", "category_benchmark", "hierarchical", "blended")

#: Smoothing and elasticity penalties tried by the penalty search, the first ones in fast mode.
PENALTIES = ((10.0, 2.0), (5.0, 1.0), (20.0, 4.0), (5.0, 2.0), (20.0, 2.0), (10.0, 1.0), (10.0, 4.0))


#: What fits read of pairs.
_FITTED = ("date_a", "date_b", "price_a", "price_b", "qty_a", "qty_b", "spend_a", "spend_b", "y", "x_q", "approved_category")


def _shift(day: date, months: int) -> date:
    m = day.year * 12 + day.month - 1 + months
    return date(m // 12, m % 12 + 1, min(day.day, calendar.monthrange(m // 12, m % 12 + 1)[1]))


def quarter_ends(first: date, last: date) -> list[date]:
    """Ends of calendar quarters from ``first`` to ``last``, both included."""
    ends = (date(y, m, calendar.monthrange(y, m)[1]) for y in range(first.year, last.year + 1) for m in (3, 6, 9, 12))
    return [d for d in ends if first <= d <= last]


def pairs_by_cutoff(daily: DataFrame, cutoffs: list[date], min_gap_days: int = 0) -> DataFrame:
    """Pairs known at each cutoff with a ``run`` column, the cutoff as text.

    Pairs are built once: those of a cutoff are the ones that end by it. Their number a part is counted anew for each cutoff.
    """
    known = F.filter(F.array(*map(F.lit, cutoffs)), lambda c: c >= F.col("date_b"))
    rows = adjacent_pairs(daily).withColumn("run", F.explode(known)).withColumn("run", F.col("run").cast("string"))
    return rows.withColumn("n_pairs_part", F.count(F.lit(1)).over(Window.partitionBy("part_key", "run"))).where(F.col("delta_days") >= min_gap_days)


def known_pairs(daily: DataFrame, cutoffs: list[date], min_gap_days: int = 0) -> DataFrame:
    """Pairs with ``known``, for each cutoff the number of the part's pairs that end by it, 0 where this pair does not; no pair is repeated by cutoff."""
    part = Window.partitionBy("part_key")
    at = [F.col("date_b") <= F.lit(d) for d in cutoffs]
    known = F.array(*(F.when(a, F.count(F.when(a, 1)).over(part)).otherwise(F.lit(0)).cast("int") for a in at))
    return adjacent_pairs(daily).withColumn("known", known).where((F.col("delta_days") >= min_gap_days) & at[-1])


def _history(spark, models: dict[str, regression.RepeatSales]) -> DataFrame:
    rows = []
    for run, m in models.items():
        rows += [(run, regression.OVERALL, month, float(r)) for month, r in zip(m.months, m.delta0, strict=True)]
        for c, u in m.differences.items():
            rows += [(run, c, month, float(a + b)) for month, a, b in zip(m.months, m.delta0, u, strict=True)]
    return spark.createDataFrame(rows, "run string, series string, month date, rate double")


def composite_backtest(daily: DataFrame, classified: DataFrame, base: date, controls: Controls | None = None, cutoffs: list[date] | None = None, min_pairs: int = 50) -> DataFrame:
    """One error of the composite a cutoff and method, twelve months ahead.

    Cutoffs are the last eight (two in fast mode) quarter ends from 18 months after the first day to 12 months
    before the base date. A cutoff with fewer than ``min_pairs`` pairs, without convergence or without a matched
    basket gives no row. Rates, basket weights and actual prices of a cutoff use only what was known at it.
    All cutoffs share the passes over both tables, which should be written tables, and a pair is one row for all of them.
    """
    c, spark = controls or Controls(), daily.sparkSession
    if cutoffs is None:
        first = daily.agg(F.min("po_date")).first()[0]
        cutoffs = quarter_ends(_shift(first, 18), _shift(base, -12))[-2 if c.fast_mode else -8 :] if first else []
    empty = "cutoff date, horizon_months int, method string, matched_parts long, eligible_basket_weight double, actual_gap_days double, stale_parts_excluded long, extreme_weight_share double, unscaled_multiplier double, actual_multiplier double, predicted_multiplier double, absolute_log_error double, point_error double, signed_error double"
    if not cutoffs:
        return spark.createDataFrame([], empty)
    cutoffs = sorted(cutoffs)
    known = known_pairs(daily, cutoffs, c.historical_min_pair_gap_days).select(*_FITTED, "delta_days", "delta_years", "price_ratio", "known")
    fits = resampling.fit_known(staged(known, "cutoff-pairs"), [d.isoformat() for d in cutoffs], c)
    models = {run: m for run, m in fits.items() if m.n_pairs >= min_pairs and m.converged}
    if not models:
        return spark.createDataFrame([], empty)
    history = _history(spark, models).where(F.last_day("month") <= C.last_complete_month_end(F.col("run").cast("date")))
    arrays = forecast.series_arrays(history, by=["run", "series"])
    methods = F.array(*(F.struct(F.lit(k).alias("method"), v.alias("log_1")) for k, v in forecast.method_sums(F.col("rates"), 12).items()))
    sums = arrays.select("run", "series", F.inline(methods))
    overall = sums.where(F.col("series") == regression.OVERALL).select("run", "method", F.col("log_1").alias("overall_log"))
    own = sums.where(F.col("series") != regression.OVERALL).withColumnRenamed("series", "direct_category")
    dates = {run: date.fromisoformat(run) for run in sorted(models)}
    held = basket.holdout_baskets(daily, dates, 12, c)
    weights = basket.fiscal_weights_of(classified, dates, c.fiscal_year_start_month).select("run", "direct_category", F.col("weight").alias("bucket"))
    mean = lambda x: F.try_divide(F.sum(F.col("weight") * x), F.sum("weight"))
    by = held.groupBy("run", F.col("approved_category").alias("direct_category")).agg(
        mean(F.col("actual_multiplier")).alias("actual"), mean(F.col("unscaled_multiplier")).alias("unscaled"), mean(F.col("gap_days")).alias("gap"), mean(F.col("extreme").cast("double")).alias("extreme"),
        F.count(F.lit(1)).alias("parts"), F.max("stale_excluded").alias("stale"),
    )
    actual = by.withColumn("all_parts", F.sum("parts").over(Window.partitionBy("run"))).join(weights, ["run", "direct_category"])
    clip = lambda x: C.clip(x, F.lit(c.forecast_annual_log_floor), F.lit(c.forecast_annual_log_cap))
    rows = actual.where("bucket > 0").join(overall, "run").join(own, ["run", "direct_category", "method"], "left").withColumn("predicted", F.exp(clip(F.coalesce("log_1", "overall_log"))))
    whole = lambda x: F.sum(F.col("bucket") * F.col(x)) / F.sum("bucket")
    out = rows.groupBy("run", "method").agg(
        F.max("all_parts").alias("matched_parts"), F.sum("bucket").alias("eligible_basket_weight"), whole("gap").alias("actual_gap_days"), F.max("stale").alias("stale_parts_excluded"),
        whole("extreme").alias("extreme_weight_share"), whole("unscaled").alias("unscaled_multiplier"), whole("actual").alias("actual_multiplier"), whole("predicted").alias("predicted_multiplier"),
    )
    p, a = F.col("predicted_multiplier"), F.col("actual_multiplier")
    return out.select(F.col("run").cast("date").alias("cutoff"), F.lit(12).alias("horizon_months"), *out.columns[1:], F.abs(F.ln(p) - F.ln(a)).alias("absolute_log_error"), F.abs(p - a).alias("point_error"), (p - a).alias("signed_error"))


def backtest_summary(detail: DataFrame) -> DataFrame:
    """Mean errors of each method; the least mean log error is selected (ties: point error, then name)."""
    by = detail.groupBy("method").agg(
        F.avg("absolute_log_error").alias("mean_absolute_log_error"), F.avg("point_error").alias("mean_point_error"), F.avg("signed_error").alias("bias"), F.count_distinct("cutoff").alias("cutoffs"), F.avg("matched_parts").alias("mean_matched_parts")
    )
    place = F.row_number().over(Window.orderBy("mean_absolute_log_error", "mean_point_error", "method"))
    return by.withColumn("selected", place == 1)


def bootstrap_forecasts(flagged: DataFrame, weights: DataFrame, base: date, method: str, signal: DataFrame | None = None, controls: Controls | None = None) -> tuple[DataFrame, dict]:
    """Quantiles of the composite multiplier of each forecast year over refits on resampled parts, and the share that converged.

    Pair weights are made anew in every resample. ``flagged`` should be a written table.
    """
    c, spark = controls or Controls(), flagged.sparkSession
    fits = resampling.fit_resamples(flagged, c)
    models = {run: m for run, m in fits.models.items() if m.converged}
    empty = "forecast_year int, lower double, median double, upper double"
    summary = {"attempts": fits.runs, "successful_fits": len(models), "success_rate": len(models) / fits.runs, "method": "part_cluster_refit"}
    if not models:
        return spark.createDataFrame([], empty), summary
    drawn = [(run, k, int(v[int(run)])) for k, v in fits.draws.items() if k != regression.OVERALL for run in models]
    counts = spark.createDataFrame([x for x in drawn if x[2]], "run string, category string, pairs long")
    _, composite = forecast.annual_forecast(_history(spark, models), weights, counts, base, signal, forced_method=method, controls=c, run="run")
    q = F.percentile("cumulative_multiplier", F.array(*map(F.lit, (c.confidence_lower_quantile, 0.5, c.confidence_upper_quantile))))
    return composite.groupBy("forecast_year").agg(q.alias("q")).select("forecast_year", F.col("q")[0].alias("lower"), F.col("q")[1].alias("median"), F.col("q")[2].alias("upper")), summary


def with_bands(composite: DataFrame, bands: DataFrame) -> DataFrame:
    """The composite forecast with its bands; null where a year has none."""
    return composite.join(bands, "forecast_year", "left")


def future_rates(spark, models: dict[str, regression.RepeatSales], until: dict[str, date], horizons: tuple[int, ...]) -> dict[str, list[float]]:
    """Monthly overall rates after the last fitted month of each run, by its best method over the horizons."""
    known = {run: m for run, m in models.items() if m.months}
    if not known:
        return {}
    rows = [(run, m.delta0.tolist(), (until[run].year - m.months[-1].year) * 12 + until[run].month - m.months[-1].month + 2) for run, m in known.items()]
    series = spark.createDataFrame(rows, "series string, rates array<double>, n int")
    best = forecast.select_method(series, horizons)
    return {r.series: r.path for r in series.join(best, "series").select("series", forecast.method_path(F.col("rates"), F.col("method"), F.col("n")).alias("path")).collect()}


def _part_growth(train: DataFrame, spans: DataFrame, models: dict[str, regression.RepeatSales], future: dict[str, list[float]], c: Controls) -> DataFrame:
    """Spans (``run, part_key, date_a, date_b, approved_category``) with ``log_category`` and the shrunk ``residual`` of the part at the run."""
    return _part_growths(train, spans, [models], [future], c).withColumnsRenamed({"log_category_0": "log_category", "residual_0": "residual"})


def _part_growths(train: DataFrame, spans: DataFrame, models: list[dict[str, regression.RepeatSales]], future: list[dict[str, list[float]]], c: Controls) -> DataFrame:
    """:func:`_part_growth` under several sets of models side by side, ``log_category_<number>`` and ``residual_<number>`` of each; no row is repeated."""
    each = range(len(models))
    back = regression.log_growths(train, [regression.growth_paths(m) for m in models], "approved_category")
    back = back.withColumns({f"predicted_{i}": F.col(f"growth_{i}") + F.col(f"gamma_{i}") * F.col("x_q") for i in each})
    parts = regression.part_residuals(back, c, by=("run",), variants=tuple(f"_{i}" for i in each))
    parts = parts.select("run", "part_key", F.col("category").alias("_category"), *(f"shrunk_residual_{i}" for i in each), F.col("source"))
    rows = spans.join(parts, ["run", "part_key"], "left").withColumn("category", F.when(F.col("source").isNotNull(), F.col("_category")).otherwise(F.col("approved_category")))
    rows = regression.log_growths(rows, [regression.growth_paths(*x) for x in zip(models, future, strict=True)], "category")
    rows = rows.withColumnsRenamed({f"growth_{i}": f"log_category_{i}" for i in each}).drop("_category", *(f"gamma_{i}" for i in each))
    return rows.withColumns({**{f"residual_{i}": F.coalesce(f"shrunk_residual_{i}", F.lit(0.0)) for i in each}, "source": F.coalesce("source", F.lit("overall"))}).drop(*(f"shrunk_residual_{i}" for i in each))


def bootstrap_parts(flagged: DataFrame, parts: DataFrame, base: date, target: date, controls: Controls | None = None, noise: float = 0.15) -> DataFrame:
    """Quantiles of the multiplier from base to target of every part, every category and the whole basket, over refits on resampled parts.

    ``parts`` has ``part_key, approved_category, weight``. Each resample refits the paths (at most 15 rounds, 8 in fast mode), the
    parts' residual rates and the future rates; these take normal noise of ``noise`` times the first fit's scale, which stands
    for the forecast's own error. Run 0 is the original without noise. Returns ``level`` (part, category, composite), ``key,
    lower, median, upper, runs``. ``flagged`` should be a written table.
    """
    c, spark = controls or Controls(), flagged.sparkSession
    fits = resampling.fit_resamples(flagged, c, max_rounds=8 if c.fast_mode else 15)
    models = {run: m for run, m in fits.models.items() if m.months}
    if not models:
        return spark.createDataFrame([], "level string, key string, lower double, median double, upper double, runs long")
    ahead = future_rates(spark, models, dict.fromkeys(models, target), (3, 6, 12))
    first = models.get("0", next(iter(models.values())))
    scale = noise * max(first.sigma, 1e-4)
    noisy = {run: (np.asarray(path) + (run != "0") * np.random.default_rng([c.random_seed, int(run)]).normal(0, scale, len(path))).tolist() for run, path in ahead.items()}
    return resampling.part_bands(flagged, parts, base, target, fits, noisy, c)


def penalty_search(pairs: DataFrame, controls: Controls | None = None) -> DataFrame:
    """Mean weighted error over the six months after each inner cutoff for every pair of penalties; the least one is selected.

    Cutoffs are the last four (one in fast mode) quarter ends from a year after the first pair to three months before the last.
    All candidates and cutoffs are fitted in the same jobs, on all pairs; errors take all later pairs. A pair has one row a cutoff, in
    which all candidates stand side by side.
    ``pairs`` should be persisted. Fewer than 50 pairs give no row. Where ``penalty_search_max_pairs`` is set (it is 0, no bound), more
    pairs than that are sampled by the later price times quantity, once for the whole search.
    """
    c, spark = controls or Controls(), pairs.sparkSession
    if c.penalty_search_max_pairs:
        value = F.col("price_b") * F.coalesce(F.nullif(F.col("qty_b"), F.lit(0.0)), F.lit(1.0))
        pairs = staged(weighted_sample(pairs, value, c.penalty_search_max_pairs, c.random_seed, ("part_key", "date_a", "date_b")), "sampled-pairs")
    schema = "candidate int, lambda_smooth double, lambda_gamma double, mean_wape double, n_cutoffs int"
    n, low, high = pairs.agg(F.count(F.lit(1)), F.min("date_b"), F.max("date_b")).first()
    if n < 50:
        return spark.createDataFrame([], schema + ", selected boolean")
    cutoffs = quarter_ends(_shift(low, 12), _shift(high, -3))[-1 if c.fast_mode else -4 :] or [_shift(low, 12)]
    grid = PENALTIES[: 3 if c.fast_mode else None]
    known = F.filter(F.array(*map(F.lit, cutoffs)), lambda d: d >= F.col("date_b"))
    flag = F.col("extreme_flag") if "extreme_flag" in pairs.columns else F.lit(False).alias("extreme_flag")
    read = ("part_key", "date_a", "date_b", "price_a", "price_b", "qty_a", "qty_b", "spend_a", "spend_b", "y", "x_q", "delta_years", "qty_comparable", "approved_category", "n_pairs_part")
    train = pairs.select(*read, flag, F.explode(known).alias("run")).withColumn("run", F.col("run").cast("string"))
    enough = [r.run for r in train.groupBy("run").count().where("count >= 30").collect()]
    train = staged(train.where(F.col("run").isin(enough)), "cutoff-pairs")
    train = staged(pair_weights(train, c.pair_weight_method, by=("run",)), "cutoff-weighted")
    fits = regression.fit_runs(train, c, variants=[replace(c, lambda_smooth=s, lambda_gamma=g) for s, g in grid])
    ahead = future_rates(spark, fits, {run: _shift(date.fromisoformat(run.split("|")[0]), 6) for run in fits}, (3, 6))
    of = lambda named, i: {run.split("|")[0]: x for run, x in named.items() if run.endswith(f"|{i}")}
    each = range(len(grid))
    later = F.filter(F.array(*map(F.lit, cutoffs)), lambda d: (d < F.col("date_b")) & (F.add_months(d, 6) >= F.col("date_b")))
    spans = pairs.select("part_key", "approved_category", "date_a", "date_b", "price_a", "price_b", "qty_b", F.explode(later).alias("run")).withColumn("run", F.col("run").cast("string")).where(F.col("run").isin(enough))
    rows = _part_growths(train, spans, [of(fits, i) for i in each], [of(ahead, i) for i in each], c)
    q = F.coalesce(F.nullif(F.col("qty_b"), F.lit(0.0)), F.lit(1.0))
    predicted = lambda i: F.col("price_a") * F.exp(F.col(f"log_category_{i}") + F.col(f"residual_{i}") * F.datediff("date_b", "date_a") / 365.25)
    errors = rows.groupBy("run").agg(*((F.sum(q * F.abs(predicted(i) - F.col("price_b"))) / F.sum(q * F.col("price_b"))).alias(f"wape_{i}") for i in each))
    whole = errors.agg(*(f(f"wape_{i}").alias(f"{name}_{i}") for name, f in (("wape", F.avg), ("n", F.count)) for i in each)).first()
    out = [(i, s, g, whole[f"wape_{i}"], int(whole[f"n_{i}"])) for i, (s, g) in enumerate(grid)]
    best = min((r for r in out if r[3] is not None), key=lambda r: (r[3], r[0]), default=None)
    return spark.createDataFrame([(*r, r is best) for r in out], schema + ", selected boolean")


def _recent(by_quarter: list, cutoff: date) -> float:
    """Yearly log rate at the mean of the last four quarterly changes known at the cutoff."""
    known = [x for start, x in by_quarter if start <= cutoff and x is not None][-4:]
    return math.log1p(sum(known) / len(known)) * 4 if known else 0.0


def _part_states(daily: DataFrame, train: DataFrame, cutoffs: list[date], models: dict[str, regression.RepeatSales], c: Controls) -> DataFrame:
    """One row a part: its days in order, each with the day after it, the last day known at each cutoff, and by the number of the cutoff its shrunk residual.

    A part has one price a day, so its days are bounded by the calendar.
    """
    known = train.select("*", F.posexplode("known").alias("i", "n")).where("n > 0").withColumns({"run": F.element_at(F.array(*(F.lit(d.isoformat()) for d in cutoffs)), F.col("i") + 1), "extreme_flag": F.lit(False)})
    back = regression.log_growth(known, regression.growth_paths(models), "approved_category").withColumn("predicted", F.col("log_growth") + F.col("gamma") * F.col("x_q"))
    own = regression.part_residuals(back, c, by=("i",), category="part_category")
    residuals = own.groupBy("part_key").agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("category", "shrunk_residual", "source")))).alias("residuals"))
    days = daily.groupBy("part_key").agg(F.array_sort(F.collect_list(F.struct("po_date", "price", "qty", "approved_category"))).alias("days"))
    last = F.transform(F.array(*map(F.lit, cutoffs)), lambda d: F.try_element_at(F.filter("days", lambda x: x["po_date"] <= d), F.lit(-1)))
    after = F.transform("days", lambda x, k: F.struct(x["po_date"].alias("date_b"), x["price"].alias("price"), x["qty"].alias("qty"), x["approved_category"].alias("approved_category"), F.get("days", k + 1)["po_date"].alias("next_date")))
    # A day up to the first cutoff is in no window.
    rows = days.select("part_key", F.filter(after, lambda x: x["date_b"] > F.lit(cutoffs[0])).alias("later_days"), last.alias("bases")).where(F.size("later_days") > 0)
    spark = daily.sparkSession  # a part becomes hundreds of rows, so a small table is spread over all cores too
    return rows.join(residuals, "part_key", "left").repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "part_key")


def _level_table(spark, models: dict[str, regression.RepeatSales], ahead: dict[str, list[float]], cutoffs: list[date], names: list[str], low: date, high: date) -> DataFrame:
    """``i, day, levels``: running sums of the daily rates at each cutoff, overall and of the named categories; cutoffs by days rows, whatever the number of parts."""
    days = [date.fromordinal(k) for k in range(low.toordinal(), high.toordinal() + 1)]
    found = regression.daily_levels(regression.growth_paths(models, ahead), [d.isoformat() for d in cutoffs], names, days)
    width = found.shape[2]
    held = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, width), pa.int32()), pa.array(found.ravel()))
    table = pa.table({"i": pa.array(np.repeat(np.arange(len(cutoffs)), len(days)), pa.int32()), "day": pa.array(days * len(cutoffs)), "levels": held})
    return staged(spark.createDataFrame(table), "levels")


def part_backtest(daily: DataFrame, controls: Controls | None = None, cutoffs: list[date] | None = None, wide: bool = False) -> DataFrame:
    """Prices of every later observation predicted by seven models at each cutoff and horizon.

    One row an observation, cutoff, horizon and model: ``predicted_price`` beside the actual and the base price, quantities at the
    cutoff and later, and a band of the hierarchical model. All later observations of parts known at the
    cutoff count. Cutoffs are quarter ends from 18 months after the first day (12 where that is too late),
    the last two in fast mode. ``daily`` should be persisted. Where ``part_backtest_max_observations`` is set (it is 0, no bound), a cutoff and horizon
    tests at most that many later observations, sampled by the value bought; fits take all rows all the same.

    With ``wide`` an observation, cutoff and horizon is one row with the prices of all models side by side, ``predicted_<model>``, and ``is_last`` for the part's
    last observation there. Rows are made of one row a part, which is written: nothing is dealt by cutoff, horizon or model.
    """
    c, spark = controls or Controls(), daily.sparkSession
    horizons = sorted(c.forecast_horizons_months)
    low, high = daily.agg(F.min("po_date"), F.max("po_date")).first()
    if low is None:
        cutoffs = []
    elif cutoffs is None:
        start, end = _shift(low, 18), _shift(high, -horizons[0])
        start = _shift(low, 12) if start >= end else start
        cutoffs = quarter_ends(start, end)[-2 if c.fast_mode else 0 :] or [start]
    if not cutoffs:
        return spark.createDataFrame([], "cutoff date, horizon_months int, part_key string, base_date date, actual_date date, base_price double, actual_price double, qty_cutoff double, qty_actual double, category string, source string, model string, predicted_price double, pred_p10 double, pred_p90 double")
    cutoffs = sorted(cutoffs)
    part_category = F.first("approved_category").over(Window.partitionBy("part_key").orderBy("date_a")).alias("part_category")
    train = known_pairs(daily, cutoffs).select("part_key", part_category, *_FITTED, "delta_days", "delta_years", "price_ratio", "qty_comparable", "known")
    train = staged(train, "cutoff-pairs")
    models = resampling.fit_known(train, [d.isoformat() for d in cutoffs], c, extremes=False)
    ahead = future_rates(spark, models, {run: _shift(date.fromisoformat(run), horizons[-1]) for run in models}, (3, 6, 12))
    quarters = panel.part_period(daily.where(F.col("po_date") <= F.lit(max(cutoffs))), "Q", c.fiscal_year_start_month)
    matched = [(r[0], r[1]) for r in indices.matched_changes(quarters, c.benchmark_winsor_lower, c.benchmark_winsor_upper).orderBy("period_start").select("period_start", "capped_spend_change").collect()]
    index = indices.tornqvist(quarters).orderBy("period_start").select("period_start", "pct_change", "index_level", "status").collect()
    rates = []
    for i, cutoff in enumerate(cutoffs):
        levels = [r.index_level for r in index if r.status == "ok" and r.period_start <= cutoff]
        years = max((cutoff - low).days / 365.25, 1 / 12)
        growth = math.log(levels[-1] / levels[0]) / years if len(levels) > 1 and levels[0] and levels[-1] > 0 else 0.0
        sigma = models[cutoff.isoformat()].sigma if cutoff.isoformat() in models else 0.05
        figures = (growth, _recent(matched, cutoff), _recent([(r.period_start, r.pct_change) for r in index], cutoff), max(sigma, 1e-4))
        rates += [(i, cutoff.isoformat(), cutoff, h, _shift(cutoff, h), *figures) for h in horizons]
    windows = spark.createDataFrame(rates, "i int, run string, cutoff date, horizon_months int, target date, cagr double, matched double, torn double, sigma double")
    windows = windows.select("*", F.explode(F.sequence(F.date_add("cutoff", 1), F.col("target"))).alias("date_b"))  # days meet their windows by equality
    names = sorted({k for m in models.values() for k in m.differences})
    levels = _level_table(spark, models, ahead, cutoffs, names, low, _shift(cutoffs[-1], horizons[-1]))
    windows = staged(windows.join(F.broadcast(levels.select("i", F.col("day").alias("date_b"), F.col("levels").alias("levels_b"))), ["i", "date_b"]), "windows")
    states = staged(_part_states(daily, train, cutoffs, models, c), "part-states")
    place = lambda x: F.coalesce(F.array_position(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>"), x), F.lit(0)).cast("int")
    fut = states.select("part_key", "bases", "residuals", F.inline("later_days")).join(F.broadcast(windows), "date_b")
    fut = fut.select(
        "i", "run", "cutoff", "horizon_months", "target", "cagr", "matched", "torn", "sigma", "levels_b", "part_key", "date_b", "price", "approved_category", F.get("bases", F.col("i")).alias("a"), F.try_element_at("residuals", F.col("i")).alias("r"),
        F.greatest(F.coalesce("qty", F.lit(1.0)), F.lit(1e-9)).alias("qty_actual"), F.coalesce(F.col("next_date") > F.col("target"), F.lit(True)).alias("is_last"),
    ).where(F.col("a").isNotNull())
    fut = fut.withColumns({
        "date_a": F.col("a.po_date"), "base_price": F.col("a.price"), "qty_cutoff": F.greatest(F.coalesce("a.qty", F.lit(1.0)), F.lit(1e-9)), "k": place(F.when(F.col("r").isNotNull(), F.col("r.category")).otherwise(F.col("approved_category"))),
        "residual": F.coalesce("r.shrunk_residual", F.lit(0.0)), "source": F.coalesce("r.source", F.lit("overall")),
    }).drop("a", "r")
    if c.part_backtest_max_observations:
        value = F.col("price") * F.col("qty_actual")
        fut = staged(weighted_sample(staged(fut, "later"), value, c.part_backtest_max_observations, c.random_seed, ("part_key", "date_b"), by=("run", "horizon_months")), "sampled-later")
        fut = fut.withColumn("is_last", F.col("date_b") == F.max("date_b").over(Window.partitionBy("run", "horizon_months", "part_key")))
    before = levels.select("i", F.col("day").alias("date_a"), F.col("levels").alias("levels_a"))
    rows = fut.join(F.broadcast(before), ["i", "date_a"]).withColumn("log_category", F.get("levels_b", F.col("k")) - F.get("levels_a", F.col("k")))
    years = F.datediff("date_b", "date_a") / 365.25
    logs = {
        "last_price": F.lit(0.0), "overall_cagr": F.col("cagr") * F.greatest(F.datediff("target", "cutoff") / 365.25, F.lit(0.0)), "matched_part": F.col("matched") * F.greatest(years, F.lit(1e-6)),
        "tornqvist": F.col("torn") * F.greatest(years, F.lit(1e-6)), "category_benchmark": F.col("log_category"), "hierarchical": F.col("log_category") + F.col("residual") * years,
    }
    price = {k: F.col("base_price") * F.exp(v) for k, v in logs.items()}
    price["blended"] = (price["hierarchical"] + price["matched_part"]) / 2
    band = F.exp(1.2816 * F.col("sigma") * F.sqrt(F.greatest(years, F.lit(1e-3))))
    once = F.inline(F.array(F.struct(*(price[m].alias(f"predicted_{m}") for m in MODELS), band.alias("band"))))  # a generator's row is worked out once, however often it is read
    rows = rows.select(
        "cutoff", "horizon_months", "part_key", F.col("date_a").alias("base_date"), F.col("date_b").alias("actual_date"), "base_price", F.col("price").alias("actual_price"), "qty_cutoff", "qty_actual",
        F.col("approved_category").alias("category"), "source", "is_last", once,
    )
    rows = rows.withColumns({"pred_p10": F.col("predicted_hierarchical") / F.col("band"), "pred_p90": F.col("predicted_hierarchical") * F.col("band")}).drop("band")
    if wide:
        return rows
    only = lambda m, x: F.when(F.lit(m == "hierarchical"), F.col(x)).alias(x)
    each = F.array(*(F.struct(F.lit(m).alias("model"), F.col(f"predicted_{m}").alias("predicted_price"), only(m, "pred_p10"), only(m, "pred_p90")) for m in MODELS))
    return rows.select(*rows.columns[:11], F.inline(each))


def _wide_summary(rows: DataFrame) -> DataFrame:
    """:func:`part_backtest_summary` of observations with all models side by side: sums by horizon and cutoff, and exact medians, from three readings."""
    y, b, q, qa = F.col("actual_price"), F.col("base_price"), F.col("qty_cutoff"), F.col("qty_actual")
    p = {m: F.col(f"predicted_{m}") for m in MODELS}
    logs = F.inline(F.array(F.struct(F.ln(y).alias("log_y"), *(F.ln(p[m]).alias(f"log_{m}") for m in MODELS))))
    rows_ = rows.select("horizon_months", "cutoff", "actual_price", "base_price", "qty_cutoff", "qty_actual", "is_last", "pred_p10", "pred_p90", *p.values(), logs)
    last, sums = F.col("is_last") & (b > 0), []
    for m in MODELS:
        good = (y > 0) & (p[m] > 0)
        hit = F.when(good & (b > 0), (F.signum(y - b) == F.signum(p[m] - b)).cast("double"))
        inside = y.between(F.col("pred_p10"), F.col("pred_p90")).cast("double") if m == "hierarchical" else F.lit(None).cast("double")
        figures = {
            "e": F.sum(q * F.abs(p[m] - y)), "ea": F.sum(qa * F.abs(p[m] - y)), "l": F.sum(F.when(good, q * y * F.abs(F.col(f"log_{m}") - F.col("log_y")))), "lw": F.sum(F.when(good, q * y)), "h": F.sum(hit), "hn": F.count(hit),
            "c": F.sum(inside), "cn": F.count(inside), "m_hat": F.sum(F.when(last, q * p[m])), "m_act": F.sum(F.when(last, q * y)), "n": F.count(F.lit(1)), "w": F.sum(q * y), "wa": F.sum(qa * y),
        }
        sums.append(F.struct(F.lit(m).alias("model"), *(v.alias(k) for k, v in figures.items())))
    by = staged(rows_.groupBy("horizon_months", "cutoff").agg(F.array(*sums).alias("x")).select("horizon_months", "cutoff", F.inline("x")), "backtest-sums")
    share = lambda a, b: F.try_divide(F.sum(a), F.nullif(F.sum(b), F.lit(0.0)))
    error = F.when(F.col("m_act") > 0, F.abs(F.col("m_hat") - F.col("m_act")) / F.col("m_act"))
    main = by.groupBy("model", "horizon_months").agg(
        F.sum("n").alias("n"), share("e", "w").alias("wape"), share("ea", "wa").alias("wape_quantity_conditional"), share("l", "lw").alias("wale"), F.try_divide(F.sum("h"), F.sum("hn")).alias("directional_accuracy"),
        F.try_divide(F.sum("c"), F.sum("cn")).alias("interval_coverage"), F.avg(error).alias("composite_error"),
    )
    middle = percentiles(rows, ["horizon_months"], {m: (F.when(y > 0, F.abs((p[m] - y) / y)), 0.5) for m in MODELS})
    middle = middle.select("horizon_months", F.inline(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("mdape")) for m in MODELS))))
    return main.join(F.broadcast(middle), ["model", "horizon_months"]).select("model", "horizon_months", "n", "wape", "wape_quantity_conditional", "wale", "mdape", "directional_accuracy", "interval_coverage", "composite_error")


def part_backtest_summary(detail: DataFrame) -> DataFrame:
    """Errors by model and horizon: weighted errors, median error, direction, band coverage and the fixed basket's error.

    The basket takes the last observation of a part in the window and weighs parts by spend at the cutoff. ``detail`` may have a row a
    model or, ``wide``, a row for all of them.
    """
    if "model" not in detail.columns:
        return _wide_summary(detail)
    y, p, b, q = F.col("actual_price"), F.col("predicted_price"), F.col("base_price"), F.col("qty_cutoff")
    wape = lambda w: F.try_divide(F.sum(w * F.abs(p - y)), F.nullif(F.sum(w * y), F.lit(0.0)))
    good = (y > 0) & (p > 0)
    keys = ["model", "horizon_months"]
    main = detail.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), wape(q).alias("wape"), wape(F.col("qty_actual")).alias("wape_quantity_conditional"),
        F.try_divide(F.sum(F.when(good, q * y * F.abs(F.ln(p) - F.ln(y)))), F.nullif(F.sum(F.when(good, q * y)), F.lit(0.0))).alias("wale"), F.median(F.when(y > 0, F.abs((p - y) / y))).alias("mdape"),
        F.avg(F.when(good & (b > 0), (F.signum(y - b) == F.signum(p - b)).cast("double"))).alias("directional_accuracy"), F.avg(y.between(F.col("pred_p10"), F.col("pred_p90")).cast("double")).alias("interval_coverage"),
    )
    last = detail.groupBy(*keys, "cutoff", "part_key").agg(F.max_by(F.struct("qty_cutoff", "base_price", "actual_price", "predicted_price"), "actual_date").alias("x")).select(*keys, "cutoff", "x.*").where(b > 0)
    basket_ = last.groupBy(*keys, "cutoff").agg(F.sum(q * p).alias("m_hat"), F.sum(q * y).alias("m_act"))
    error = basket_.where("m_act > 0").groupBy(*keys).agg(F.avg(F.abs(F.col("m_hat") - F.col("m_act")) / F.col("m_act")).alias("composite_error"))
    return main.join(error, keys, "left")


def select_model(summary: DataFrame, controls: Controls | None = None) -> str:
    """The simplest model unless a later one lowers the mean error by the material share and the basket error grows by 5 % at most."""
    c = controls or Controls()
    means = {r.model: (r.wape, r.basket) for r in summary.groupBy("model").agg(F.avg("wape").alias("wape"), F.avg("composite_error").alias("basket")).collect()}
    if c.selected_model_mode in MODELS:
        return c.selected_model_mode
    pick = MODELS[0]
    for model in MODELS[1:]:
        if model not in means or pick not in means:
            pick = model if pick not in means and model in means else pick
            continue
        (wape, error), (old_wape, old_error) = means[model], means[pick]
        better = wape is not None and (old_wape is None or wape <= old_wape * (1 - c.material_wape_improvement))
        if better and not (error is not None and old_error is not None and error > old_error * 1.05):
            pick = model
    return pick
