"""Data-quality, exclusion, profile, coverage and reconciliation tables."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costweave.functions import columns as C


#: Line columns that :func:`data_quality` and the daily panel read, where lines carry ``alike`` (:func:`costweave.operators.clean.with_fingerprint`); a written table holds no more.
COLUMNS = (
    "source_file", "source_row_number", "part_key", "effective_date", "po_value", "in_direct_costs", "realized_price", "realized_spend", "realized_price_source", "qty_received", "extension_received",
    "received_ratio", "has_open_commitment", "remaining_open_spend", "po_value_matches_ordered", "approved_category", "alike",
)
#: Pair columns that extreme flags and their counts read.
PAIR_COLUMNS = ("y", "delta_days", "delta_years", "price_ratio", "spend_b")


def data_quality(classified: DataFrame, daily: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """``issue, row_count, value``: all line conditions in one aggregation, then unpivoted.

    ``classified`` carries ``is_duplicate``, or ``alike``, by which lines alike are then counted on their own; ``pairs`` carries ``extreme_flag``.
    """
    by_line = "is_duplicate" in classified.columns
    col = F.col
    bad_receipt = col("extension_received").isNotNull() & ~C.close(col("received_ratio"), F.lit(1.0), 1e-4, 1e-4)
    checks = {
        "raw_rows": (F.lit(True), "po_value"),
        "approved_direct_cost_rows": (col("in_direct_costs"), "po_value"),
        "realized_direct_cost_rows": (col("in_direct_costs") & C.positive(col("realized_spend")), "realized_spend"),
        "open_direct_cost_rows": (col("in_direct_costs") & col("has_open_commitment"), "remaining_open_spend"),
        "missing_part_key": (col("part_key").isNull(), "po_value"),
        "invalid_or_missing_date": (col("effective_date").isNull(), "po_value"),
        **({"duplicate_looking_rows": (col("is_duplicate"), "po_value")} if by_line else {}),
        "po_value_reconciliation_failure": (col("po_value").isNotNull() & ~col("po_value_matches_ordered"), "po_value"),
        "received_extension_reconciliation_failure": (bad_receipt, "po_value"),
        "historical_cost_fallback": (col("realized_price_source") == "cost_fallback", "realized_spend"),
    }
    aggs = []
    for name, (mask, value) in checks.items():
        aggs += [F.count_if(mask).alias(f"{name}|n"), F.coalesce(F.sum(F.when(mask, col(value))), F.lit(0.0)).alias(f"{name}|v")]
    wide = classified.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(n).alias("issue"), F.col(f"`{n}|n`").alias("row_count"), F.col(f"`{n}|v`").alias("value")) for n in checks))
    out = wide.select(F.inline(rows))
    if not by_line:
        groups = classified.groupBy("alike").agg(F.count(F.lit(1)).alias("n"), F.sum("po_value").alias("v")).where("n > 1")
        out = out.unionByName(groups.agg(F.lit("duplicate_looking_rows").alias("issue"), F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("value")))
    if daily is not None:
        out = out.unionByName(daily.agg(F.lit("realized_part_days").alias("issue"), F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum("spend"), F.lit(0.0)).alias("value")))
    if pairs is not None:
        both = pairs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("spend_b"), F.lit(0.0)).alias("v"), F.count_if("extreme_flag").alias("xn"), F.coalesce(F.sum(F.when(col("extreme_flag"), col("spend_b"))), F.lit(0.0)).alias("xv"))
        each = F.array(*(F.struct(F.lit(issue).alias("issue"), col(n).alias("row_count"), col(v).alias("value")) for issue, n, v in (("repeat_pairs", "n", "v"), ("extreme_pairs", "xn", "xv"))))
        out = out.unionByName(both.select(F.inline(each)))
    return out


def basis_histogram(cleaned: DataFrame) -> DataFrame:
    """Lines by likely basis factor; lines without one are a group."""
    return cleaned.groupBy("po_basis_factor").agg(F.count(F.lit(1)).alias("row_count"))


def exclusion_reason(classified: DataFrame) -> DataFrame:
    reason = (
        F.when(~F.col("in_direct_costs"), "outside_approved_direct_cost_scope")
        .when(F.col("part_key").isNull(), "missing_part_key")
        .when(F.col("effective_date").isNull(), "invalid_or_missing_date")
        .when(~C.positive(F.col("qty_received")), "no_received_quantity")
        .when(~C.positive(F.col("realized_price")), "invalid_realized_price")
        .otherwise("included_in_realized_pool")
    )
    return classified.withColumn("pool_reason", reason)


def exclusion_log(classified: DataFrame) -> DataFrame:
    """Lines and value by the reason that keeps them out of the realized pool."""
    value = F.when(F.col("pool_reason") == "no_received_quantity", F.coalesce("remaining_open_spend", F.lit(0.0))).otherwise(F.coalesce("realized_spend", "po_value", F.lit(0.0)))
    return exclusion_reason(classified).groupBy("pool_reason").agg(F.count(F.lit(1)).alias("row_count"), F.sum(value).alias("value"))


def profile(cleaned: DataFrame) -> DataFrame:
    """Rows, parts, and parts seen in two, three and four or more sources."""
    by_part = cleaned.where(F.col("part_key").isNotNull()).groupBy("part_key").agg(F.count_distinct("source_file").alias("n"))
    parts = by_part.agg(F.count(F.lit(1)).alias("parts"), *(F.count_if(F.col("n") >= k).alias(f"parts_in_{k}_sources") for k in (2, 3, 4)))
    return cleaned.agg(F.count(F.lit(1)).alias("rows")).join(F.broadcast(parts))


def compare_profile(actual: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Expected against actual profile figures."""
    rows = F.array(*(F.struct(F.lit(k).alias("metric"), F.lit(v).cast("long").alias("expected"), F.col(k).cast("long").alias("actual")) for k, v in expected.items()))
    return actual.select(F.inline(rows)).withColumn("matches", F.col("expected") == F.col("actual"))


def source_ranges(lines: DataFrame, max_gap_days: int = 7) -> DataFrame:
    """Date range of each source against the one before it: overlap, or a gap over a week. One row a source."""
    by = lines.where(F.col("po_date").isNotNull()).groupBy("source_file").agg(F.count(F.lit(1)).alias("row_count"), F.min("po_date").alias("first_date"), F.max("po_date").alias("last_date"))
    before = F.lag("last_date").over(Window.orderBy("first_date", "source_file"))
    missing = F.datediff("first_date", "previous_last") - 1
    return by.withColumn("previous_last", before).withColumns(
        {"overlaps": F.coalesce(F.col("first_date") <= F.col("previous_last"), F.lit(False)), "gap_days": F.when(missing > 0, missing).otherwise(0).cast("long")}
    ).withColumn("has_gap", F.coalesce(F.col("gap_days") > max_gap_days, F.lit(False)))


def file_profile(lines: DataFrame, listing: DataFrame, first_sheet: str = "Sheet2", max_gap_days: int = 7) -> DataFrame:
    """Each file with its rows, sheet, dates, size, time and fingerprint, and its warnings in one text.

    ``lines`` is aggregated by file and sheet, then joined to :func:`costweave.sources.files.listing`: a listed file without lines has 0 rows, lines
    of a file that is not listed have no size. Warned of: no lines, a sheet other than ``first_sheet`` in a workbook, lines without an order date, dates that
    overlap those of the file before or leave a gap of over ``max_gap_days`` after them.
    """
    by = lines.groupBy("source_file").agg(
        F.max("source_sheet").alias("sheet"), F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("po_date").isNull()).alias("undated"), F.min("po_date").alias("first_date"), F.max("po_date").alias("last_date")
    )
    ranges = source_ranges(lines, max_gap_days).select("source_file", "previous_last", "overlaps", "gap_days", "has_gap")
    rows = by.join(ranges, "source_file", "left").join(listing.withColumnRenamed("file", "source_file"), "source_file", "full")
    n = F.coalesce("row_count", F.lit(0))
    workbook = F.lower("source_file").rlike(r"\.xls[xm]$")
    warnings = (
        F.when(n == 0, F.lit("no lines")),
        F.when(workbook & (F.col("sheet") != first_sheet), F.format_string("sheet '%s' was taken", "sheet")),
        F.when(F.col("undated") > 0, F.format_string("%d lines without an order date", "undated")),
        F.when(F.col("overlaps"), F.format_string("dates overlap those of the file before, up to %s", F.col("previous_last").cast("string"))),
        F.when(F.col("has_gap"), F.format_string("%d days without lines before", "gap_days")),
    )
    facts = [c for c in ("bytes", "modified", "fingerprint") if c in listing.columns]
    return rows.select("source_file", "sheet", n.alias("row_count"), "first_date", "last_date", *facts, F.concat_ws("; ", *warnings).alias("warnings"))


def pair_coverage(pairs: DataFrame) -> DataFrame:
    """Pairs, parts and later spend of each category, and its share."""
    g = pairs.groupBy(F.coalesce("approved_category", F.lit("Uncategorized")).alias("category")).agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("part_key").alias("parts"), F.sum("spend_b").alias("pair_spend"))
    return g.withColumn("pair_spend_share", F.col("pair_spend") / F.sum("pair_spend").over(Window.partitionBy()))


def current_coverage(classified: DataFrame, pairs: DataFrame, base: date) -> DataFrame:
    """Realized spend of the trailing year by category, and how much of it is on parts with pairs."""
    start = base - timedelta(days=365)
    rows = classified.where(F.col("in_direct_costs") & C.positive(F.col("realized_spend")) & (F.col("effective_date") > F.lit(start)) & (F.col("effective_date") <= F.lit(base)))
    paired = pairs.select("part_key").distinct().withColumn("_paired", F.lit(True))
    g = rows.join(paired, "part_key", "left").groupBy(F.col("direct_category").alias("category")).agg(
        F.sum("realized_spend").alias("current_spend"), F.sum(F.when(F.col("_paired"), F.col("realized_spend")).otherwise(0.0)).alias("matched_spend")
    )
    return g.withColumn("matched_coverage", C.ratio(F.col("matched_spend"), F.col("current_spend")))


def coverage_table(pairs: DataFrame, classified: DataFrame, base: date) -> DataFrame:
    """Pair coverage and current coverage of every category that has either."""
    return pair_coverage(pairs).join(current_coverage(classified, pairs, base), "category", "full_outer")


def scope_disclosure(scoped: DataFrame) -> DataFrame:
    """Lines and value by normalised description, and its role in the physical scope."""
    use = scoped.where("included_for_pricing").groupBy("description_norm").agg(F.count(F.lit(1)).alias("row_count"), F.sum(F.greatest(F.coalesce("po_value", F.lit(0.0)), F.lit(0.0))).alias("po_value"))
    physical = F.coalesce(F.col("description_norm").isin(*C.PHYSICAL_DESCRIPTIONS), F.lit(False))
    return use.withColumn("scope_role", F.when(physical, "included_physical_inputs").otherwise("excluded_from_physical_inputs"))


def spend_reconciliation(scoped: DataFrame) -> DataFrame:
    """Order value against price times ordered quantity by fiscal year, and lines that differ tenfold."""
    product = F.col("price") * F.col("qty_ordered")
    r = C.ratio(product, F.col("po_value"))
    large = F.coalesce((r > 10) | (r < 0.1), F.lit(False))
    g = scoped.where(F.col("in_physical_inputs") & F.col("fiscal_year").isNotNull()).groupBy("fiscal_year").agg(
        F.sum(F.coalesce("po_value", F.lit(0.0))).alias("sum_po_value"), F.sum(F.coalesce(product, F.lit(0.0))).alias("sum_price_x_qty"), F.count(F.lit(1)).alias("row_count"), F.count_if(large).alias("large_ratio_rows")
    )
    return g.withColumns({"ratio": C.ratio(F.col("sum_price_x_qty"), F.col("sum_po_value")), "large_ratio_share": F.col("large_ratio_rows") / F.col("row_count")})
