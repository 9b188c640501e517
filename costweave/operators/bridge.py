"""From the last price of each part to its cost at the target: bridging, quantities, basket weights and sensitivity tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costweave.functions import columns as C
from costweave.operators import forecast, indices, panel, regression
from costweave.plans.stages import staged


def source_trace(lines: DataFrame, columns: tuple[str, ...] = ("source_file", "source_row_number", "description_1", "description_2", "part_number")) -> DataFrame:
    """The latest line of each part (ties: the later file and row), lines without a part left out."""
    latest = F.max_by(F.struct(*columns), F.struct("po_date", "source_file", "source_row_number"))
    return lines.where(F.col("part_key").isNotNull()).groupBy("part_key").agg(latest.alias("x")).select("part_key", "x.*")


def manual_values(classified: DataFrame) -> DataFrame:
    """Largest manual price and quantity of each part."""
    both = ("manual_current_price", "manual_future_quantity")
    return classified.where(F.col("part_key").isNotNull()).groupBy("part_key").agg(*((F.max(c) if c in classified.columns else F.lit(None).cast("double")).alias(c) for c in both))


def bridged_prices(daily: DataFrame, residuals: DataFrame, model: regression.RepeatSales, base: date, manual: DataFrame | None = None) -> DataFrame:
    """Each part's last price up to the base date, moved to it by its category's path and its own residual rate.

    A positive manual price stands for an observation on the base date. Parts without residual rows
    take the category of their last observation and no residual.
    """
    last = daily.where(F.col("po_date") <= F.lit(base)).groupBy("part_key").agg(F.max_by(F.struct("po_date", "price", "qty", "approved_category"), "po_date").alias("x"))
    last = last.select("part_key", F.col("x.po_date").alias("latest_date"), F.col("x.price").alias("latest_price"), F.col("x.qty").alias("qty"), F.col("x.approved_category").alias("approved_category"))
    own = residuals.select("part_key", "category", "source", F.col("shrunk_residual").alias("_r"))
    rows = last.join(own, "part_key", "left")
    given = manual if manual is not None else rows.sparkSession.createDataFrame([], "part_key string, manual_current_price double, manual_future_quantity double")
    rows = rows.join(given.select("part_key", "manual_current_price", "manual_future_quantity"), "part_key", "left")
    by_hand = F.coalesce(F.col("manual_current_price") > 0, F.lit(False))
    rows = rows.withColumns(
        {
            "price_override_reason": F.when(by_hand, "manual_current_price").otherwise(""), "latest_price": F.when(by_hand, F.col("manual_current_price")).otherwise(F.col("latest_price")),
            "latest_date": F.when(by_hand, F.lit(base)).otherwise(F.col("latest_date")), "category": F.coalesce("category", "approved_category"), "source": F.coalesce("source", F.lit("overall")),
            "shrunk_residual": F.coalesce("_r", F.lit(0.0)), "run": F.lit("base"), "date_b": F.lit(base),
        }
    ).drop("_r", "manual_current_price").withColumn("date_a", F.col("latest_date"))
    rows = regression.log_growth(rows, regression.growth_paths({"base": model}))
    days = F.datediff("date_b", "date_a")
    moved = F.col("latest_price") * F.exp(F.col("log_growth") + F.col("shrunk_residual") * days / 365.25)
    return rows.withColumns({"estimated_base_price": F.when(days > 0, moved).otherwise(F.col("latest_price")), "price_staleness_days": F.greatest(days, F.lit(0))}).drop("run", "date_a", "date_b", "log_growth", "gamma")


def basket_quantities(bridged: DataFrame, classified: DataFrame, base: date, planned: DataFrame | None = None) -> DataFrame:
    """Fixed quantities, future quantities and basket weights of bridged parts.

    Quantities are the planned ones, else the value ordered in the last twelve months over the bridged price. A
    positive manual quantity is the future one and fills a missing fixed one.
    """
    if planned is not None:
        # A part planned on several lines is their sum: a join would otherwise multiply it.
        expected = planned.where(F.col("expected_quantity").isNotNull()).groupBy(F.upper(F.trim("part_key")).alias("part_key")).agg(F.sum("expected_quantity").alias("q_star"))
        rows = bridged.join(expected, "part_key", "left")
    else:
        recent = classified.where(F.col("model_eligible") & (F.col("po_date") > F.add_months(F.lit(base), -12)) & (F.col("po_date") <= F.lit(base)))
        spend = recent.groupBy("part_key").agg(F.sum("po_value").alias("_spend"))
        price = F.col("estimated_base_price")
        rows = bridged.join(spend, "part_key", "left").withColumn("q_star", F.when(price > 0, F.coalesce("_spend", F.lit(0.0)) / price).otherwise(F.coalesce("qty", F.lit(0.0)))).drop("_spend")
    manual = F.when(F.col("manual_future_quantity") > 0, F.col("manual_future_quantity"))
    rows = rows.withColumn("q_future", F.coalesce(manual, "q_star")).withColumn("q_star", F.when(F.coalesce(F.col("q_star") > 0, F.lit(False)), F.col("q_star")).otherwise(F.coalesce(manual, "q_star")))
    value = F.coalesce("q_star", F.lit(0.0)) * F.coalesce("estimated_base_price", F.lit(0.0))
    rows = rows.withColumn("basket_value", value)
    total = rows.agg(F.sum("basket_value").alias("_total"))
    return rows.join(F.broadcast(total)).withColumn("composite_weight", F.coalesce(C.ratio(F.col("basket_value"), F.col("_total")), F.lit(0.0))).drop("_total")


def part_forecast(bridged: DataFrame, bucket: DataFrame, composite: DataFrame) -> DataFrame:
    """Price of each part in each forecast year: its bridged price moved by the forecast of its category, else by the composite one.

    ``bucket`` and ``composite`` have one row a category and year, or a year. Where ``composite`` has bands, the part's price has them
    relative to its own: wider where the part has no rate of its own, its price is old or the year is far.
    """
    own = bucket.select(F.col("direct_category").alias("category"), "forecast_year", F.col("cumulative_multiplier").alias("own"))
    bands = ["lower", "median", "upper"] if "lower" in composite.columns else []
    years = composite.select("forecast_year", F.col("cumulative_multiplier").alias("overall"), *bands)
    rows = bridged.join(F.broadcast(years)).join(own, ["category", "forecast_year"], "left").withColumn("multiplier", F.coalesce("own", "overall"))
    price = F.col("estimated_base_price") * F.col("multiplier")
    rows = rows.withColumn("price", price)
    if bands:
        side = lambda c: F.col("price") * C.ratio(F.col(c), F.col("median"))
        wide = forecast.widen_interval(side("lower"), F.col("price"), side("upper"), F.col("source"), F.col("price_staleness_days"), F.col("forecast_year") * 12)
        rows = rows.withColumns({"price_p10": F.greatest(wide["p10"], F.lit(0.0)), "price_p90": wide["p90"]})
    return rows.drop("own", "overall", *bands)


def purchasing_cost(priced: DataFrame, multiplier: str = "multiplier") -> DataFrame:
    """Cost of the future quantities at the base and at the target, their change, and that of the fixed basket."""
    q, p, m = F.coalesce("q_future", F.lit(0.0)), F.coalesce("estimated_base_price", F.lit(0.0)), F.col(multiplier)
    costs = priced.agg(F.sum(q * p).alias("cost_base"), F.sum(q * p * m).alias("cost_target"), F.sum(F.col("composite_weight") * m).alias("fixed"))
    return costs.select("cost_base", "cost_target", F.when(F.col("cost_base") > 0, F.col("cost_target") / F.col("cost_base") - 1).alias("purchasing_cost_change"), (F.col("fixed") - 1).alias("fixed_basket_change"))


def heaviest(weights: DataFrame, share: float = 0.995, above_rows: int = 5000, key: str = "part_key", weight: str = "weight") -> DataFrame:
    """Parts, heaviest first, up to the share of all weight, rescaled to sum 1; all of them where they are few.

    Running sums are made inside narrow weight classes whose totals are added before, so no task sorts all parts.
    Equal weights follow the key. If already the heaviest part passes the share, the first ``above_rows`` of the same order stay.
    """
    rows = staged(weights.where(F.col(weight) > 0).select(key, F.col(weight).alias("weight")), "weights").withColumn("_k", F.floor(F.log2("weight") * 64))
    n = rows.count()
    if n > above_rows:
        down = Window.orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, -1)
        classes = rows.groupBy("_k").agg(F.sum("weight").alias("_w")).withColumn("_before", F.coalesce(F.sum("_w").over(down), F.lit(0.0)))
        total = classes.agg(F.sum("_w").alias("_all"))
        inside = Window.partitionBy("_k").orderBy(F.desc("weight"), key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        run = rows.join(F.broadcast(classes.drop("_w")), "_k").join(F.broadcast(total)).withColumn("_run", (F.col("_before") + F.sum("weight").over(inside)) / F.col("_all"))
        kept = run.where(F.col("_run") <= share)
        rows = kept if kept.limit(1).count() else rows.orderBy(F.desc("weight"), key).limit(above_rows)
    rows = rows.select(key, "weight")
    return rows.join(F.broadcast(rows.agg(F.sum("weight").alias("_all")))).select(key, (F.col("weight") / F.col("_all")).alias("weight"))


def recent_change(changes: DataFrame, change: str, n: int = 4) -> DataFrame:
    """Mean of the last ``n`` known changes of a series and its yearly log rate; one row a period passes the window."""
    place = F.row_number().over(Window.orderBy(F.desc("period_start")))
    last = changes.where(F.col(change).isNotNull()).select(F.col(change).alias("c"), place.alias("k")).where(F.col("k") <= n)
    return last.agg(F.avg("c").alias("mean_change"), F.count("c").alias("n")).withColumn("annual_log", F.log1p("mean_change") * 4)


def historical_index(daily: DataFrame, rates: DataFrame | None = None, start_month: int = 10) -> DataFrame:
    """Törnqvist, matched changes and Fisher side by side for each frequency; months also carry the repeat-sales index.

    Periods of the Törnqvist or the matched changes are kept; the others join where they have the period.
    """
    found, out = indices.all_benchmarks(daily, start_month), None
    if rates is not None:
        up = F.sum("rate").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        own = rates.where(F.col("series") == regression.OVERALL).select(F.col("month").alias("period_start"), F.exp(up).alias("repeat_sales_index"), F.col("rate").alias("repeat_sales_log_change"))
    for freq in ("M", "Q", "FY"):
        t = found[f"tornqvist_{freq}"].select("period_start", F.col("index_level").alias("tornqvist_index"), F.col("pct_change").alias("tornqvist_change"), "status")
        m = found[f"matched_{freq}"].select("period_start", "match_count", "matched_spend", "median_change", "equal_change", "capped_spend_change")
        f = found[f"fisher_{freq}"].where("status = 'ok'").select("period_start", F.col("index_level").alias("fisher_index"))
        frame = t.join(m, "period_start", "full").join(f, "period_start", "left").withColumn("frequency", F.lit(freq))
        frame = frame.join(own, "period_start", "left") if rates is not None and freq == "M" else frame
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    return out


def _latest(frame: DataFrame, change: str) -> DataFrame:
    return frame.where(F.col(change).isNotNull()).agg(F.max_by(change, "period_start").alias(change))


def scope_sensitivity(daily_by_scope: dict[str, DataFrame], start_month: int = 10) -> DataFrame:
    """The latest matched and Törnqvist changes of every scope and frequency, beside the scope's size.

    A scope without prices has one row with status ``no_data``.
    """
    out = None
    for scope, daily in daily_by_scope.items():
        size = daily.agg(F.count(F.lit(1)).alias("part_days"), F.count_distinct("part_key").alias("distinct_parts"), F.sum(F.coalesce("spend", F.lit(0.0))).alias("total_spend"))
        for freq in ("M", "Q", "FY"):
            prices = staged(panel.part_period(daily, freq, start_month), "prices")
            linked = staged(indices.links(prices), "links")
            last = indices.matched_changes(prices, linked=linked).agg(F.max_by(F.struct("capped_spend_change", "match_count", "matched_spend"), "period_start").alias("x"))
            row = size.join(F.broadcast(last)).join(F.broadcast(_latest(indices.tornqvist(prices, linked), "pct_change"))).select(
                F.lit(scope).alias("scope"), F.lit(freq).alias("frequency"), F.when(F.col("part_days") > 0, "ok").otherwise("no_data").alias("status"), "part_days", "distinct_parts",
                F.col("x.capped_spend_change").alias("latest_matched_change"), F.col("pct_change").alias("latest_tornqvist"), F.coalesce("x.match_count", F.lit(0)).alias("match_count"), F.col("x.matched_spend").alias("matched_spend"), "total_spend",
            )
            row = row.where("status = 'ok'") if freq != "M" else row
            out = row if out is None else out.unionByName(row)
    return out


def extremes_sensitivity(daily: DataFrame, flagged: DataFrame) -> DataFrame:
    """Latest quarterly changes with all parts and without those that ever had an extreme pair."""
    prices = staged(panel.part_period(daily, "Q"), "prices")
    extreme = flagged.where("extreme_flag").select("part_key").distinct()
    count = flagged.agg(F.count_if("extreme_flag").alias("extreme_pairs"))
    out = None
    for variant, rows in (("with_extremes", prices), ("without_extremes", prices.join(extreme, "part_key", "left_anti"))):
        linked = staged(indices.links(rows), "links")
        size = rows.agg(F.count(F.lit(1)).alias("n_rows"))
        row = size.join(F.broadcast(_latest(indices.matched_changes(rows, linked=linked), "capped_spend_change"))).join(F.broadcast(_latest(indices.tornqvist(rows, linked), "pct_change"))).join(F.broadcast(count))
        row = row.select(F.lit(variant).alias("variant"), F.when(F.col("n_rows") > 0, "ok").otherwise("no_data").alias("status"), "n_rows", F.col("capped_spend_change").alias("latest_matched_change"), F.col("pct_change").alias("latest_tornqvist"), "extreme_pairs")
        out = row if out is None else out.unionByName(row)
    return out
