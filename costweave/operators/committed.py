"""Committed-cost signal: open lines against the latest earlier realized price (a strict as-of join)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costweave.functions import columns as C
from costweave.operators.panel import realized_rows
from costweave.operators.quantiles import beside, percentiles


def asof_prior(open_rows: DataFrame, realized: DataFrame) -> DataFrame:
    """``open_rows`` with the last realized price and date of their entity strictly before the order date.

    ``realized`` has ``comparison_entity, effective_date, realized_price`` and line numbers. Lines are first brought to
    one row an entity and day (the last realized line of the day by source order, the highest price of lines with one place),
    on the way to the shuffle; the window that carries prices forward sees days of an entity only, so the calendar bounds it, however many lines
    an entity has. Open rows then meet their own day by equality. Rows without an entity or a date have no prior price.
    """
    place = F.struct("source_file", "source_row_number", "realized_price")
    days = realized.where(F.col("comparison_entity").isNotNull() & F.col("effective_date").isNotNull()).groupBy(
        "comparison_entity", F.col("effective_date").alias("_day")
    ).agg(F.max_by(F.struct(F.col("realized_price").alias("price"), F.col("effective_date").alias("day")), place).alias("_last"))
    asked = open_rows.where(F.col("comparison_entity").isNotNull() & F.col("po_date").isNotNull()).select("comparison_entity", F.col("po_date").alias("_day")).distinct()
    both = days.withColumn("_asked", F.lit(False)).unionByName(asked.withColumns({"_last": F.lit(None).cast(days.schema["_last"].dataType), "_asked": F.lit(True)}))
    # An asked day comes before the prices of that day, which keeps the comparison strict.
    order = Window.partitionBy("comparison_entity").orderBy("_day", F.desc("_asked")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_prior", F.last("_last", ignorenulls=True).over(order)).where("_asked").select(
        F.col("comparison_entity").alias("_entity"), "_day", F.col("_prior.price").alias("prior_price"), F.col("_prior.day").alias("prior_date")
    )
    same = (F.col("comparison_entity") == F.col("_entity")) & (F.col("po_date") == F.col("_day"))
    return open_rows.join(found, same, "left").drop("_entity", "_day")


def open_commitments(classified: DataFrame, base: date) -> DataFrame:
    return classified.where(F.col("in_direct_costs") & F.col("has_open_commitment") & C.positive(F.col("committed_price")) & (F.col("po_date") <= F.lit(base)))


def committed_detail(classified: DataFrame, base: date, min_gap_days: int = 30) -> DataFrame:
    """Open direct lines with prior price, gap, log change and its annual rate (gaps of 30 days or more)."""
    keep = ("comparison_entity", "part_key", "direct_category", "po_date", "committed_price", "remaining_open_qty", "remaining_open_spend", "match_tier", "source_file", "source_sheet", "source_row_number")
    rows = asof_prior(open_commitments(classified, base).select(*keep), realized_rows(classified, base))
    matched = C.positive(F.col("prior_price"))
    gap = F.datediff("po_date", "prior_date")
    d = rows.withColumns({"matched": matched, "gap_days": gap.cast("long"), "log_change": F.when(matched, F.ln(F.col("committed_price") / F.col("prior_price")))})
    annual = F.when(F.col("matched") & (F.col("gap_days") >= min_gap_days), F.col("log_change") / (F.col("gap_days") / 365.25))
    return d.withColumns({"annual_log_change": annual, "open_weight": F.greatest("remaining_open_spend", F.lit(0.0))})


def committed_signal(detail: DataFrame, low: float = 0.01, high: float = 0.99, cap_at: float = 0.95) -> DataFrame:
    """Signal of every category and of all lines, each from its own order statistics.

    Rows count twice, once for their category and once for the whole, so that one plan gives both.
    """
    both = detail.withColumn("category", F.explode(F.array("direct_category", F.lit("Overall Direct Costs"))))
    ok = F.col("annual_log_change").isNotNull() & (F.col("open_weight") > 0)
    change, weight = F.when(ok, F.col("annual_log_change")), F.when(ok, F.col("open_weight"))
    stats = percentiles(both, ["category"], {"q_low": (change, low), "q_high": (change, high), "cap": (weight, cap_at)})
    joined = beside(both, stats, ["category"])
    w = F.when(ok, F.least("open_weight", "cap"))
    g = joined.groupBy("category").agg(
        F.count(F.lit(1)).alias("open_rows"), F.count_if(ok).alias("matched_rows"), F.sum("open_weight").alias("open_value"), F.sum(F.when(ok, F.col("open_weight")).otherwise(0.0)).alias("matched_open_value"),
        F.try_divide(F.sum(w * C.clip(F.col("annual_log_change"), F.col("q_low"), F.col("q_high"))), F.sum(w)).alias("annual_log_signal"),
    )
    total = detail.agg(F.sum("open_weight").alias("all_open"))
    return g.join(F.broadcast(total)).select(
        "category", "open_rows", "matched_rows", "open_value", "matched_open_value", C.ratio(F.col("matched_open_value"), F.col("open_value")).alias("coverage"), "annual_log_signal",
        F.expm1("annual_log_signal").alias("annual_rate_signal"), C.ratio(F.col("open_value"), F.col("all_open")).alias("share_of_open_value"), F.when(F.col("matched_rows") > 0, "ok").otherwise("insufficient_matches").alias("status"),
    )
