"""Fixed basket weights and the matched holdout basket."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costweave.config import Controls
from costweave.functions import columns as C
from costweave.operators.quantiles import beside, percentiles
from costweave.plans.stages import staged


def latest_complete_fiscal_year(base: date, start_month: int = 10) -> int:
    """The fiscal year that ends on the base date, else the one before the current."""
    after = base + timedelta(days=1)
    fy = lambda d: d.year + (d.month >= start_month)
    return fy(base) if fy(after) != fy(base) else fy(base) - 1


def _normalised(values: DataFrame, source: Column) -> DataFrame:
    w = values.where(F.col("direct_category").isNotNull()).groupBy("direct_category").agg(F.sum("basket_value").alias("basket_value"), F.count(F.lit(1)).alias("basket_rows")).where("basket_value > 0")
    return w.withColumn("weight", F.col("basket_value") / F.sum("basket_value").over(Window.partitionBy())).withColumn("basket_source", source)


def fiscal_weights(classified: DataFrame, base: date, start_month: int = 10) -> DataFrame:
    """Bucket weights by realized spend of the latest complete fiscal year; of the trailing year where that has none.

    Both windows are summed in one pass and the choice is made inside the plan.
    """
    fy = latest_complete_fiscal_year(base, start_month)
    rows = classified.where(F.col("in_direct_costs") & C.positive(F.col("realized_spend")) & (F.col("effective_date") <= F.lit(base)))
    in_fy = C.fiscal_year(F.col("effective_date"), start_month) == fy
    in_year = F.col("effective_date") > F.lit(base - timedelta(days=365))
    both = rows.groupBy("direct_category").agg(
        F.sum(F.when(in_fy, F.col("realized_spend"))).alias("fy_value"), F.count_if(in_fy).alias("fy_rows"), F.sum(F.when(in_year, F.col("realized_spend"))).alias("ttm_value"), F.count_if(in_year).alias("ttm_rows")
    )
    has_fy = F.sum("fy_rows").over(Window.partitionBy()) > 0
    chosen = both.withColumn("has_fy", has_fy).select(
        "direct_category", F.when(F.col("has_fy"), F.col("fy_value")).otherwise(F.col("ttm_value")).alias("basket_value"), F.when(F.col("has_fy"), F.col("fy_rows")).otherwise(F.col("ttm_rows")).alias("basket_rows"),
        F.when(F.col("has_fy"), F.lit(f"FY{fy}_realized_spend_proxy")).otherwise("trailing_12m_realized_spend_proxy").alias("basket_source"),
    ).where("basket_value > 0")
    return chosen.withColumn("weight", F.col("basket_value") / F.sum("basket_value").over(Window.partitionBy()))


def planned_weights(classified: DataFrame, planned: DataFrame, base: date) -> DataFrame:
    """Bucket weights of a planned basket: expected spend, else expected quantity at the part's latest realized price."""
    line = F.struct("effective_date", "source_file", "source_row_number")
    rows = classified.where(F.col("in_direct_costs") & F.col("part_key").isNotNull() & (F.col("effective_date") <= F.lit(base)))
    latest = rows.groupBy("part_key").agg(F.max_by("direct_category", line).alias("direct_category"), F.max_by("realized_price", line).alias("latest_price"))
    own = planned.withColumn("part_key", F.upper(F.trim("part_key"))).join(latest, "part_key", "left")
    value = F.when(F.col("expected_spend") > 0, F.col("expected_spend")).otherwise(F.col("expected_quantity") * F.col("latest_price"))
    return _normalised(own.withColumn("basket_value", value), F.lit("planned_basket"))


def fiscal_weights_of(classified: DataFrame, bases: dict[str, date], start_month: int = 10) -> DataFrame:
    """:func:`fiscal_weights` at several base dates, each with its name in the column ``run``: one aggregation for all of them."""
    day, value = F.col("effective_date"), F.col("realized_spend")
    sums = []
    for run, base in bases.items():
        in_fy = (C.fiscal_year(day, start_month) == latest_complete_fiscal_year(base, start_month)) & (day <= F.lit(base))
        in_year = (day > F.lit(base - timedelta(days=365))) & (day <= F.lit(base))
        sums.append(F.struct(F.lit(run).alias("run"), F.sum(F.when(in_fy, value)).alias("fy_value"), F.count_if(in_fy).alias("fy_rows"), F.sum(F.when(in_year, value)).alias("ttm_value")))
    rows = classified.where(F.col("in_direct_costs") & C.positive(value))
    both = rows.groupBy("direct_category").agg(F.array(*sums).alias("runs")).select("direct_category", F.inline("runs"))
    run = Window.partitionBy("run")
    chosen = both.withColumn("has_fy", F.sum("fy_rows").over(run) > 0).select("run", "direct_category", F.when(F.col("has_fy"), F.col("fy_value")).otherwise(F.col("ttm_value")).alias("basket_value")).where("basket_value > 0")
    return chosen.withColumn("weight", F.col("basket_value") / F.sum("basket_value").over(run))


def holdout_basket(daily: DataFrame, cutoff: date, horizon_months: int = 12, controls: Controls | None = None) -> DataFrame:
    """Last price up to the cutoff against the price nearest the target date, within 90 days (ties: the earlier).

    Relatives are scaled to the horizon, clipped to the basket's quantiles and the absolute bounds, and
    weighted by capped spend with extremes damped.
    """
    return holdout_baskets(daily, {"one": cutoff}, horizon_months, controls).drop("run")


def holdout_baskets(daily: DataFrame, cutoffs: dict[str, date], horizon_months: int = 12, controls: Controls | None = None) -> DataFrame:
    """:func:`holdout_basket` of several cutoffs, each with its name in the column ``run``.

    One aggregation finds both prices of a part at all cutoffs. They are written once, as the quantiles and sums of a
    basket read them again; quantiles, counts and sums are then small tables of one row a run.
    """
    c = controls or Controls()
    day = F.col("po_date")
    obs = F.struct(day.alias("day"), "price", "spend", "approved_category")
    found, used = [], F.lit(False)
    for run, cutoff in cutoffs.items():
        target = F.add_months(F.lit(cutoff), horizon_months)
        near, before = day.between(F.date_sub(target, 90), F.date_add(target, 90)), day <= F.lit(cutoff)
        used = used | near | before
        last, then = F.max_by(obs, F.when(before, day)), F.min_by(obs, F.when(near, F.struct(F.abs(F.datediff(day, target)), day)))
        found.append(F.struct(F.lit(run).alias("run"), F.datediff(target, F.lit(cutoff)).alias("horizon"), last.alias("b"), then.alias("a")))
    both = daily.where(used).groupBy("part_key").agg(F.array(*found).alias("runs")).select("part_key", F.inline("runs"))
    m = both.where((F.col("b.price") > 0) & (F.col("a.price") > 0)).select(
        "run", "part_key", F.col("b.day").alias("base_date"), F.col("a.day").alias("actual_date"), F.col("b.price").alias("price_base"), F.col("a.price").alias("price_actual"), F.col("b.spend").alias("spend"),
        F.col("b.approved_category").alias("approved_category"), F.datediff("a.day", "b.day").cast("long").alias("gap_days"), "horizon",
    )
    m = m.withColumn("raw_log", F.ln(F.col("price_actual") / F.col("price_base"))).withColumns({"log_h": F.col("raw_log") * F.col("horizon") / F.nullif(F.col("gap_days"), F.lit(0)), "w0": F.greatest(F.coalesce("spend", "price_base"), F.lit(0.0))})
    every = staged(m.drop("horizon"), "holdout-prices")
    stale = every.groupBy("run").agg(F.count_if(F.col("gap_days") > c.backtest_max_actual_gap_days).alias("stale_excluded"))
    m = every.where((F.col("gap_days") > 0) & (F.col("gap_days") <= c.backtest_max_actual_gap_days))
    q = {"low": c.benchmark_winsor_lower, "high": c.benchmark_winsor_upper}
    wanted = {f"{name}_{end}": (F.col(of), p) for name, of in (("q", "log_h"), ("rq", "raw_log")) for end, p in q.items()}
    stats = percentiles(m, ["run"], wanted | {"cap": (F.col("w0"), 0.95)})
    low, high = F.ln(F.lit(c.extreme_ratio_low)), F.ln(F.lit(c.extreme_ratio_high))
    m = beside(m, staged(beside(stats, stale, ["run"]), "basket-quantiles"), ["run"])
    bound = lambda x, q: F.exp(F.greatest(F.least(x, F.least(F.col(f"{q}_high"), high)), F.greatest(F.col(f"{q}_low"), low)))
    extreme = (F.col("log_h") < low) | (F.col("log_h") > high)
    w1 = F.least("w0", "cap")
    damped = w1 * F.when(extreme, 0.25).otherwise(1.0)
    m = m.withColumns({"actual_multiplier": bound(F.col("log_h"), "q"), "unscaled_multiplier": bound(F.col("raw_log"), "rq"), "raw_multiplier": F.exp("log_h"), "extreme": extreme, "w1": w1, "w2": damped})
    m = beside(m, staged(m.groupBy("run").agg(F.sum("w1").alias("s1"), F.sum("w2").alias("s2")), "basket-sums"), ["run"])
    return m.withColumns({"pre_robust_weight": C.ratio(F.col("w1"), F.col("s1")), "weight": C.ratio(F.col("w2"), F.col("s2"))}).drop(*wanted, "cap", "w0", "w1", "w2", "s1", "s2", "log_h", "raw_log")


def category_actuals(holdout: DataFrame, weights: DataFrame) -> DataFrame:
    """Within-category weighted actual multipliers and their basket weights, renormalised over categories present."""
    g = holdout.groupBy(F.col("approved_category").alias("direct_category")).agg(
        (F.sum(F.col("weight") * F.col("actual_multiplier")) / F.sum("weight")).alias("actual_multiplier"), F.count(F.lit(1)).alias("parts"), F.sum("weight").alias("holdout_weight")
    )
    joined = g.join(weights.select("direct_category", "weight"), "direct_category")
    return joined.withColumn("basket_weight", F.col("weight") / F.sum("weight").over(Window.partitionBy())).drop("weight")


def forecast_metrics(df: DataFrame, by: list[str], actual: str = "actual", predicted: str = "predicted", base: str = "base", weight: str = "weight", low: str | None = None, high: str | None = None) -> DataFrame:
    """Weighted absolute percentage and log errors, median error, direction hits and interval coverage."""
    y, p, b, w = F.col(actual), F.col(predicted), F.col(base), F.col(weight)
    good = (y > 0) & (p > 0)
    aggs = [
        F.try_divide(F.sum(w * F.abs(p - y)), F.nullif(F.sum(w * y), F.lit(0.0))).alias("wape"),
        F.try_divide(F.sum(F.when(good, w * F.abs(F.ln(p) - F.ln(y)))), F.nullif(F.sum(F.when(good, w)), F.lit(0.0))).alias("wale"),
        F.avg(F.when(good & (b > 0), (F.signum(y - b) == F.signum(p - b)).cast("double"))).alias("directional_accuracy"),
    ]
    if low and high:
        aggs.append(F.avg(F.when(F.col(low).isNotNull() & F.col(high).isNotNull() & y.isNotNull(), y.between(F.col(low), F.col(high)).cast("double"))).alias("interval_coverage"))
    middle = percentiles(df, by, {"mdape": (F.when(y > 0, F.abs((p - y) / y)), 0.5)})
    return beside(df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *aggs), middle, by)
