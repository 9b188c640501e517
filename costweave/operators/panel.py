"""Panels: one row a part and day, period or date window."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costweave.functions import columns as C
from costweave.plans.stages import staged



def _line() -> Column:
    """Source order of lines."""
    return F.struct("source_file", "source_row_number")


def same_day(rows: DataFrame, mode: str = "quantity_weighted_mean", day: str = "po_date", price: str = "price", qty: str = "qty", value: str = "realized_spend") -> DataFrame:
    """One row a part and day: quantity-weighted price (or the median), quantity, spend and spread.

    ``spend`` is the line's value where positive, else price times quantity. Days without a
    positive price go; a quantity that is not positive is null. First values follow source order.
    """
    p, q, v = F.col(price), F.col(qty), F.col(value)
    both = C.positive(q) & C.positive(p)
    g = rows.groupBy("part_key", F.col(day).alias("po_date")).agg(
        F.sum(F.when(both, q).otherwise(0.0)).alias("_q"),
        F.sum(F.when(both, p * q).otherwise(0.0)).alias("_pq"),
        F.sum(F.when(C.positive(v), v).otherwise(F.coalesce(p * q, F.lit(0.0)))).alias("spend"),
        F.count(F.lit(1)).alias("line_count"),
        F.min(p).alias("price_min"), F.max(p).alias("price_max"), F.avg(p).alias("price_mean"), F.stddev_samp(p).alias("price_std"), F.median(p).alias("price_median"),
        F.bool_or("is_open_order").alias("is_open_order_any"),
        *(F.min_by(c, F.when(F.col(c).isNotNull(), _line())).alias(c) for c in ("approved_category", "match_tier", "description_1", "description_2")),
    )
    chosen = F.col("price_median") if mode == "median" else F.when(F.col("_q") > 0, F.col("_pq") / F.col("_q")).otherwise(F.col("price_median"))
    cv = F.when((F.col("price_mean") > 0) & F.col("price_std").isNotNull(), F.col("price_std") / F.col("price_mean")).otherwise(0.0)
    out = g.withColumns({"price": chosen, "qty": F.when(F.col("_q") > 0, F.col("_q")), "price_cv": cv}).drop("_q", "_pq")
    return out.where(F.col("price") > 0)


def realized_rows(classified: DataFrame, cutoff: date | None = None) -> DataFrame:
    """Direct lines with a realized price and a received quantity, up to the cutoff."""
    rows = classified.where(F.col("in_direct_costs") & C.positive(F.col("realized_price")) & C.positive(F.col("qty_received")) & F.col("effective_date").isNotNull() & F.col("part_key").isNotNull())
    return rows.where(F.col("effective_date") <= F.lit(cutoff)) if cutoff else rows


def realized_daily(classified: DataFrame, cutoff: date | None = None, mode: str = "quantity_weighted_mean") -> DataFrame:
    """The realized price panel by effective date."""
    return same_day(realized_rows(classified, cutoff), mode, "effective_date", "realized_price", "qty_received", "realized_spend")


def physical_daily(scoped: DataFrame) -> DataFrame:
    """One row a part and day of the physical scope: median price, median positive ordered quantity, value, modal description.

    Of descriptions that are equally frequent the first by name stands. Lines without part, date or positive price are left out.
    """
    rows = scoped.where(F.col("in_physical_inputs") & F.col("part_key").isNotNull() & F.col("po_date").isNotNull() & C.positive(F.col("price")))
    return rows.groupBy("part_key", "po_date").agg(
        F.median("price").alias("price"),
        F.median(F.when(F.col("qty_ordered") > 0, F.col("qty_ordered"))).alias("qty"),
        F.sum(F.greatest(F.coalesce("po_value", F.lit(0.0)), F.lit(0.0))).alias("spend"),
        F.mode("description_norm", True).alias("approved_category"),
    )


def part_period(daily: DataFrame, freq: str, start_month: int = 10) -> DataFrame:
    """One row a part and month (M), quarter (Q) or fiscal year (FY)."""
    p, q = F.col("price"), F.col("qty")
    both = C.positive(q) & C.positive(p)
    day = F.col("po_date")
    g = daily.groupBy("part_key", C.period_start(day, freq, start_month).alias("period_start")).agg(
        F.sum(F.when(both, p * q).otherwise(0.0)).alias("_pq"),
        F.sum(F.when(both, q).otherwise(0.0)).alias("qty"),
        F.sum(F.coalesce("spend", p * F.coalesce(q, F.lit(0.0)))).alias("spend"),
        F.median(p).alias("_median"),
        F.min_by("approved_category", F.when(F.col("approved_category").isNotNull(), day)).alias("approved_category"),
    )
    start = F.col("period_start")
    return g.select(
        "part_key", "period_start", C.period_end(start, freq, start_month).alias("period_end"), C.period_ordinal(start, freq, start_month).cast("long").alias("period_ordinal"),
        F.when(F.col("qty") > 0, F.col("_pq") / F.col("qty")).otherwise(F.col("_median")).alias("price"), "qty", "spend", "approved_category",
    )


def in_windows(lines: DataFrame, windows: DataFrame, day: str = "po_date") -> DataFrame:
    """Each line once for every window (``label, start, end``, both days inclusive) that holds its day.

    Windows are spread over the days they cover, so that lines meet them by equality on the day,
    however many windows there are; a window of a year is 365 rows. They are written first, so that their size is known and lines need not move.
    """
    days = windows.where(F.col("start") <= F.col("end")).select("label", "start", "end", F.explode(F.sequence("start", "end")).alias("window_day"))
    return lines.join(staged(days, "window-days"), F.col(day) == F.col("window_day")).drop("window_day")


def window_values(scoped: DataFrame, windows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Representative values of each part in each inclusive date window, and what all its lines there add up to.

    Median price, summed non-negative value, median positive quantity, counts, spread and modal texts come from
    the ``line_count`` lines with a part and a price; ``scope_spend`` from all, so a null part or one without a price
    has a row too. Both come from one reading of the lines.
    """
    priced = C.positive(F.col("price")) & F.col("part_key").isNotNull()
    own = lambda c: F.when(priced, F.col(c) if isinstance(c, str) else c)
    value = F.greatest(F.coalesce("po_value", F.lit(0.0)), F.lit(0.0))
    return in_windows(scoped, windows).groupBy(*(by or []), "label", "part_key").agg(
        F.median(own("price")).alias("price"),
        F.sum(own(value)).alias("spend"),
        F.median(F.when(priced & (F.col("qty_ordered") > 0), F.col("qty_ordered"))).alias("qty"),
        F.count_if(priced).alias("line_count"),
        F.size(F.collect_set(own("price"))).cast("long").alias("unique_price_count"),
        F.min(own("po_date")).alias("first_date"), F.max(own("po_date")).alias("last_date"), F.min(own("price")).alias("price_min"), F.max(own("price")).alias("price_max"),
        F.stddev_pop(own("price")).alias("price_dispersion"),
        F.mode(own("hist_category"), True).alias("hist_category"), F.mode(own("description_1"), True).alias("description_1"),
        F.min_by("description_norm", own(_line())).alias("description_norm"),
        F.sum(value).alias("scope_spend"),
    )


def part_windows(scoped: DataFrame, windows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """:func:`window_values` of parts with a price."""
    return window_values(scoped, windows, by).where("line_count > 0").drop("scope_spend")


def window_spend(scoped: DataFrame, windows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Total non-negative value of each window, the denominator of coverage."""
    rows = in_windows(scoped, windows)
    return rows.groupBy(*(by or []), "label").agg(F.sum(F.greatest(F.coalesce("po_value", F.lit(0.0)), F.lit(0.0))).alias("scope_spend"))
