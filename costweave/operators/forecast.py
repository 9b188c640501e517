"""Monthly rate forecasters and annual forecasts as column arithmetic over small series."""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costweave.config import Controls
from costweave.functions import columns as C

METHODS = ("trailing_12m_mean", "ewma", "damped_holt", "mean_reversion")


def series_arrays(monthly: DataFrame, by: str | list[str] = "series", month: str = "month", rate: str = "rate") -> DataFrame:
    """One row a series with its rates in month order; a series has one rate a month, so rows stay short."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(month).alias("m"), F.col(rate).alias("r"))))
    keys = [by] if isinstance(by, str) else by
    return monthly.groupBy(*keys).agg(ordered.alias("x")).select(*keys, F.transform("x", lambda s: s["r"]).alias("rates"), F.element_at("x", -1)["m"].alias("last_month"))


def _mean(a: Column) -> Column:
    return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a).cast("double"))


def _tail(a: Column, n: int) -> Column:
    return F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), F.lit(n))


def _rest(a: Column) -> Column:
    return F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))


def method_sums(rates: Column, horizon: Column | int) -> dict[str, Column]:
    """Sum of the next ``horizon`` monthly rates by each method; 0 without history."""
    h = F.lit(horizon).cast("double") if isinstance(horizon, int) else horizon.cast("double")
    first = F.element_at(rates, 1)
    ewma = F.aggregate(_rest(rates), first, lambda s, x: 0.3 * x + 0.7 * s)
    trend = F.when(F.size(rates) > 1, F.try_element_at(rates, F.lit(2)) - first).otherwise(0.0)
    start = F.struct(first.alias("l"), trend.alias("t"))

    def holt(s: Column, x: Column) -> Column:
        level = 0.4 * x + 0.6 * (s["l"] + 0.8 * s["t"])
        return F.struct(level.alias("l"), (0.2 * (level - s["l"]) + 0.8 * 0.8 * s["t"]).alias("t"))

    end = F.aggregate(_rest(rates), start, holt)
    # Sum over k of (phi + ... + phi^k), and of phi^k, in closed form.
    phi = 0.8
    damp = (h * phi - phi * phi * (1 - F.pow(F.lit(phi), h)) / (1 - phi)) / (1 - phi)
    mu, recent = _mean(rates), _mean(_tail(rates, 12))
    fade = 0.85 * (1 - F.pow(F.lit(0.85), h)) / (1 - 0.85)
    out = {"trailing_12m_mean": h * recent, "ewma": h * ewma, "damped_holt": h * end["l"] + damp * end["t"], "mean_reversion": h * mu + (recent - mu) * fade}
    return {k: F.when(F.size(rates) == 0, 0.0).otherwise(v) for k, v in out.items()}


def method_path(rates: Column, method: Column, months: Column) -> Column:
    """Array of the next monthly rates by the named method, at least one."""
    one = lambda k: F.coalesce(*(F.when(method == name, v - w) for (name, v), w in zip(method_sums(rates, k).items(), method_sums(rates, k - 1).values(), strict=True)))
    return F.transform(F.sequence(F.lit(1), F.greatest(months, F.lit(1))), one)


def candidates(series: DataFrame, horizon: int = 12) -> DataFrame:
    """Cumulative log change of the next months by series and method."""
    sums = method_sums(F.col("rates"), horizon)
    rows = F.array(*(F.struct(F.lit(k).alias("method"), v.alias("cumulative_log")) for k, v in sums.items()))
    return series.select("series", F.inline(rows))


def method_errors(series: DataFrame, horizons: tuple[int, ...] = (12,)) -> DataFrame:
    """Mean absolute error of every method over rolling origins; at least 18 months, 13 of them before the first origin."""
    longest = max(horizons)
    origins = series.where(F.size("rates") >= 18).select("series", "rates", F.explode(F.sequence(F.lit(12), F.size("rates") - 1 - longest)).alias("t")).where(F.col("t") < F.size("rates") - longest)
    rows = origins.select("series", "t", F.slice("rates", 1, F.col("t") + 1).alias("rates"), F.col("rates").alias("full"), F.explode(F.array(*map(F.lit, horizons))).alias("h"))
    actual = F.aggregate(F.slice("full", F.col("t") + 2, F.col("h")), F.lit(0.0), lambda s, x: s + x)
    sums = method_sums(F.col("rates"), F.col("h"))
    pairs = F.array(*(F.struct(F.lit(k).alias("method"), F.abs(v - actual).alias("error")) for k, v in sums.items()))
    return rows.select("series", F.inline(pairs)).groupBy("series", "method").agg(F.avg("error").alias("mae"), F.count(F.lit(1)).alias("n_evals"))


def select_method(series: DataFrame, horizons: tuple[int, ...] = (12,)) -> DataFrame:
    """Best method of each series (ties by name of the method order); the trailing mean without enough history."""
    place = F.array_position(F.array(*map(F.lit, METHODS)), F.col("method"))
    best = method_errors(series, horizons).groupBy("series").agg(F.min_by("method", F.struct("mae", place)).alias("method"))
    return series.select("series").join(best, "series", "left").withColumn("method", F.coalesce("method", F.lit(METHODS[0])))


def annual_forecast(history: DataFrame, weights: DataFrame, pairs_by_category: DataFrame, base: date, committed: DataFrame | None = None, forced_method: str | None = None, controls: Controls | None = None, run: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Bucket and composite forecasts of three years.

    With ``run`` the history and the pairs carry a run column and every run has its own forecast; the method must then be forced.

    ``history`` has ``series, month, rate`` of complete months with the series ``Overall``; ``weights`` has
    ``direct_category, weight``; ``pairs_by_category`` has ``category, pairs``; ``committed`` is the signal table.
    Year 1 mixes the method's sum with the committed signal by its coverage, later years revert
    to a long-run rate that shrinks to the overall one; all yearly log rates are clipped.
    A category without a series of its own uses the overall one.
    """
    c = controls or Controls()
    keys = [run] if run else []
    complete = history.where(F.last_day("month") <= C.last_complete_month_end(F.lit(base)))
    arrays = series_arrays(complete, [*keys, "series"])
    chosen = arrays.withColumn("method", F.lit(forced_method)) if forced_method else arrays.join(select_method(arrays), "series")
    year = F.coalesce(*(F.when(F.col("method") == k, v) for k, v in method_sums(F.col("rates"), 12).items()))
    per = chosen.select(*keys, "series", "method", year.alias("cumulative_log"), (12 * _mean(_tail(F.col("rates"), 36))).alias("long_rate"))
    overall = per.where("series = 'Overall'").select(*keys, F.col("method").alias("o_method"), F.col("cumulative_log").alias("o_sum"), F.col("long_rate").alias("o_long"))
    n = pairs_by_category.select(*keys, F.col("category").alias("direct_category"), "pairs")
    on = [*keys, "direct_category"]
    b = F.broadcast(weights.select("direct_category", "weight")).join(overall).join(per.withColumnRenamed("series", "direct_category"), on, "left").join(n, on, "left")
    clip = lambda x: C.clip(x, F.lit(c.forecast_annual_log_floor), F.lit(c.forecast_annual_log_cap))
    shrink = F.coalesce("pairs", F.lit(0)) / (F.coalesce("pairs", F.lit(0)) + F.lit(float(max(c.category_min_pairs, 1))))
    b = b.withColumns(
        {
            "method": F.coalesce("method", "o_method"), "unclipped_1": F.coalesce("cumulative_log", "o_sum"),
            "long_run": clip(shrink * F.coalesce("long_rate", "o_long") + (1 - shrink) * F.col("o_long")),
        }
    )
    if committed is not None:
        b = b.join(committed.select(F.col("category").alias("direct_category"), F.col("annual_log_signal").alias("signal"), F.col("coverage").alias("signal_coverage")), "direct_category", "left")
    else:
        b = b.withColumns({"signal": F.lit(None).cast("double"), "signal_coverage": F.lit(None).cast("double")})
    omega = F.when(
        F.col("signal").isNotNull() & (F.col("signal_coverage") > 0),
        F.least(F.lit(c.committed_overlay_max_weight), c.committed_overlay_max_weight * F.col("signal_coverage") / max(c.committed_full_weight_coverage, 1e-9)),
    ).otherwise(0.0)
    b = b.withColumn("committed_weight", omega).withColumn("y1", clip(F.col("committed_weight") * F.coalesce(clip(F.col("signal")), F.lit(0.0)) + (1 - F.col("committed_weight")) * clip(F.col("unclipped_1"))))
    rho = c.forecast_mean_reversion_rho
    years = F.array(*(F.struct(F.lit(k).alias("forecast_year"), clip(F.col("long_run") + (rho ** (k - 1)) * (F.col("y1") - F.col("long_run"))).alias("annual_log")) for k in (1, 2, 3)))
    bucket = b.select(*on, "weight", "method", "committed_weight", "long_run", "unclipped_1", F.inline(years))
    running = F.sum("annual_log").over(Window.partitionBy(*on).orderBy("forecast_year").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    floor, cap = c.forecast_annual_log_floor, c.forecast_annual_log_cap
    bucket = bucket.withColumns({"cumulative_multiplier": F.exp(running), "annual_rate": F.expm1("annual_log"), "at_guardrail": F.col("annual_log").isin(floor, cap)})
    composite = bucket.groupBy(*keys, "forecast_year").agg((F.sum(F.col("weight") * F.col("cumulative_multiplier")) / F.sum("weight")).alias("cumulative_multiplier"))
    before = F.coalesce(F.lag("cumulative_multiplier").over(Window.partitionBy(*keys).orderBy("forecast_year")), F.lit(1.0))
    return bucket, composite.withColumn("annual_rate", F.col("cumulative_multiplier") / before - 1)


def widen_interval(p10: Column, p50: Column, p90: Column, source: Column, stale_days: Column, horizon_months: Column) -> Column:
    """struct(p10, p50, p90) widened for fallback sources, stale prices and long horizons."""
    factor = F.when(source == "overall", 1.35).when(source == "category", 1.15).otherwise(1.0)
    factor = factor * F.when(stale_days > 180, 1 + F.least(stale_days / 365.0, F.lit(1.5)) * 0.25).otherwise(1.0)
    factor = factor * F.when(horizon_months > 24, 1 + (horizon_months - 24) / 24.0 * 0.5).otherwise(1.0)
    half = 0.5 * F.greatest(p90 - p10, F.lit(1e-9)) * factor
    return F.struct((p50 - half).alias("p10"), p50.alias("p50"), (p50 + half).alias("p90"))


def cagr_multiplier(index_levels: DataFrame, first_day: date, cutoff: date, target: date) -> float:
    """Growth to the target at the yearly rate of a chained quarterly index up to the cutoff; 1 with under two links."""
    row = index_levels.where("status = 'ok'").agg(F.count(F.lit(1)), F.min_by("index_level", "period_start"), F.max_by("index_level", "period_start")).first()
    if row[0] < 2 or not row[1] or row[2] / row[1] <= 0:
        return 1.0
    years = max((cutoff - first_day).days / 365.25, 1 / 12)
    return math.exp(math.log(row[2] / row[1]) / years * max((target - cutoff).days / 365.25, 0.0))
