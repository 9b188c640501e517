"""Cleaning of purchase lines: keys, dates, prices, reconciliation, open orders, exclusions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costweave.config import Controls
from costweave.functions import columns as C

FINGERPRINT = ("po_date", "part_key", "cost", "qty_ordered", "qty_received", "po_value", "bucket", "description", "description_1", "description_2")
SERVICE_WORDS = r"\bLABOR\b|\bSERVICE\b|\bFREIGHT\b|\bSHIPPING\b"


def clean_lines(lines: DataFrame, controls: Controls | None = None) -> DataFrame:
    """The lines with derived keys, prices and flags; one narrow pass, no shuffle.

    Realized prices are received extension over received quantity, the cost where that fails;
    committed prices are order value over ordered quantity, else the cost. Flags are never
    null. Rows stay, whatever is wrong with them; ``exclusion_reason`` says what is.
    """
    c = controls or Controls()
    col, none = F.col, F.lit(None).cast("double")
    d = lines.withColumn("part_key", C.part_key(col("part_number"), col("part_number_type"))).withColumns(
        {
            "part_numeric_origin": F.coalesce(col("part_number_type").isin("int", "float"), F.lit(False)),
            "part_key_status": C.part_key_status(col("part_number"), col("part_key")),
            "effective_date": F.coalesce("receipt_date", "po_date"),
            "date_is_proxy": col("receipt_date").isNull(),
            "invalid_date": col("po_date").isNull() & F.coalesce(col("date_was_given"), F.lit(False)),
            "missing_date": ~F.coalesce(col("date_was_given"), F.lit(False)),
            "ordered_price": C.ratio(col("po_value"), col("qty_ordered")),
            "received_price": C.ratio(col("extension_received"), col("qty_received")),
            "has_received": C.positive(col("qty_received")),
        }
    )
    by_receipt = col("has_received") & C.positive(col("received_price"))
    by_order = C.positive(col("qty_ordered")) & C.positive(col("ordered_price"))
    by_cost = C.positive(col("cost"))
    d = d.withColumns(
        {
            "realized_price": F.when(by_receipt, col("received_price")).when(col("has_received") & by_cost, col("cost")),
            "realized_price_source": F.when(by_receipt, "received_extension_div_qty").when(col("has_received") & by_cost, "cost_fallback").otherwise("unavailable"),
            "committed_price": F.when(by_order, col("ordered_price")).when(by_cost, col("cost")),
            "committed_price_source": F.when(by_order, "po_value_div_qty").when(by_cost, "cost_fallback").otherwise("unavailable"),
            "qty": F.when(col("has_received"), col("qty_received")).otherwise(col("qty_ordered")),
            "ordered_value_at_cost": col("cost") * col("qty_ordered"),
            "received_value_at_cost": col("cost") * col("qty_received"),
        }
    )
    remaining = F.greatest(F.coalesce("qty_ordered", F.lit(0.0)) - F.coalesce("qty_received", F.lit(0.0)), F.lit(0.0))
    d = d.withColumns(
        {
            "po_ratio": C.ratio(col("po_value"), col("ordered_value_at_cost")),
            "received_ratio": C.ratio(col("extension_received"), col("received_value_at_cost")),
            "po_value_matches_ordered": C.close(col("po_value"), col("ordered_value_at_cost")),
            "po_value_matches_received": C.close(col("po_value"), col("received_value_at_cost")),
            "is_open_order": ~col("has_received") & C.positive(col("qty_ordered")) & C.positive(col("committed_price")),
            "is_partially_received": col("has_received") & (F.coalesce("qty_ordered", F.lit(0.0)) > col("qty_received")),
            "remaining_open_qty": remaining,
            "has_open_commitment": (remaining > 0) & C.positive(col("committed_price")),
            "realized_spend": F.when(by_receipt, F.greatest(col("extension_received"), F.lit(0.0))).when(col("has_received"), col("realized_price") * col("qty_received")).otherwise(0.0),
            "remaining_open_spend": remaining * col("committed_price"),
        }
    )
    fallback = col("committed_price") if c.include_open_orders_as_prices else none
    d = d.withColumns(
        {
            "po_basis_factor": C.basis_factor(col("po_ratio")),
            "received_basis_factor": C.basis_factor(col("received_ratio")),
            "price": F.coalesce(col("realized_price"), F.when(col("is_open_order"), fallback)),
        }
    ).withColumns({"valid_price": C.positive(col("price")), "valid_qty": C.positive(col("qty"))})
    allowed = F.lit(True) if c.include_open_orders_as_prices else ~col("is_open_order")
    service = F.upper(F.concat(F.coalesce("description_1", F.lit("")), F.lit(" "), F.coalesce("description_2", F.lit("")))).rlike(SERVICE_WORDS)
    reason = (
        F.when(col("part_key").isNull(), "missing_part_key")
        .when(col("po_date").isNull(), "invalid_or_missing_date")
        .when(~col("valid_price"), "invalid_price")
        .when(~allowed, "open_order_excluded")
        .otherwise("")
    )
    d = d.withColumns(
        {
            "usable_price": col("valid_price") & col("part_key").isNotNull() & col("po_date").isNotNull() & allowed,
            "service_like": service,
            "exclusion_reason": reason,
        }
    ).withColumn("included_for_pricing", col("usable_price") & (col("exclusion_reason") == ""))
    weights = col("included_for_pricing") & C.positive(col("realized_spend"))
    return d.withColumn("included_for_weights", weights if c.include_open_orders_in_weights else weights & ~col("is_open_order"))


def flag_duplicates(cleaned: DataFrame, mode: str = "flag_only") -> DataFrame:
    """``duplicate_count`` of lines alike in the fingerprint columns (nulls alike) and ``is_duplicate``.

    Mode ``drop`` keeps the first line in source order. Only this step shuffles lines on all
    fingerprint columns, whose groups are copies of one line.
    """
    alike = Window.partitionBy(*FINGERPRINT)
    flagged = cleaned.withColumn("duplicate_count", F.count(F.lit(1)).over(alike)).withColumn("is_duplicate", F.col("duplicate_count") > 1)
    if mode != "drop":
        return flagged
    place = F.row_number().over(alike.orderBy("source_file", "source_row_number"))
    return flagged.withColumn("_place", place).where("_place = 1").drop("_place")


def with_fingerprint(cleaned: DataFrame) -> DataFrame:
    """``alike``: 128 bits of the fingerprint columns, the same for lines alike in all of them (nulls alike), so that lines can be counted without dealing their texts."""
    kinds = dict(cleaned.dtypes)
    parts = [F.col(c) + F.lit(0.0) if kinds[c] == "double" else F.col(c) for c in FINGERPRINT]  # -0.0 is 0.0
    null = F.concat(*(F.col(c).isNull().cast("int").cast("string") for c in FINGERPRINT))  # a hash passes over nulls
    return cleaned.withColumn("alike", F.struct(F.xxhash64(F.lit(1), null, *parts).alias("one"), F.xxhash64(F.lit(2), *parts[::-1], null).alias("two")))
