"""Scope, categories, part overrides and modal category labels."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costweave.config import Controls, Resolved, assert_unique
from costweave.functions import columns as C


def complete_mapping(cleaned: DataFrame, mapping: DataFrame | None = None, categories: DataFrame | None = None) -> DataFrame:
    """Scope mapping with one row for every (bucket, description) of the lines, nulls alike.

    ``mapping`` has ``bucket, description, default_decision, category, reason, manual_override``; pairs it
    lacks are classified by rule. ``categories`` (``bucket, description, category``) replaces
    categories where it is not blank. ``decision`` is the manual override where there is one.
    """
    pairs = cleaned.groupBy("bucket", "description").agg(F.count(F.lit(1)).alias("row_count"))
    rule = C.scope_decision(F.col("bucket"), F.col("description"))
    if mapping is None:
        full = pairs.select("bucket", "description", rule["decision"].alias("default_decision"), rule["category"].alias("category"), rule["reason"].alias("reason"), F.lit("").alias("manual_override"))
    else:
        assert_unique(mapping, "bucket", "description")
        known = mapping.select(F.col("bucket").alias("b"), F.col("description").alias("d"))
        lacking = pairs.join(known, F.col("bucket").eqNullSafe(F.col("b")) & F.col("description").eqNullSafe(F.col("d")), "left_anti")
        added = lacking.select("bucket", "description", rule["decision"].alias("default_decision"), rule["category"].alias("category"), rule["reason"].alias("reason"), F.lit("").alias("manual_override"))
        full = mapping.select("bucket", "description", "default_decision", "category", "reason", F.coalesce("manual_override", F.lit("")).alias("manual_override")).unionByName(added)
    if categories is not None:
        assert_unique(categories, "bucket", "description")
        own = categories.select(F.col("bucket").alias("b"), F.col("description").alias("d"), F.nullif(F.trim("category"), F.lit("")).alias("replacement"))
        full = full.join(own, F.col("bucket").eqNullSafe(F.col("b")) & F.col("description").eqNullSafe(F.col("d")), "left").withColumn("category", F.coalesce("replacement", "category")).drop("b", "d", "replacement")
    chosen = F.when(F.trim("manual_override") != "", F.trim("manual_override")).otherwise(F.coalesce("default_decision", F.lit("Needs Review")))
    return full.withColumn("decision", chosen)


def classify_lines(cleaned: DataFrame, resolved: Resolved | None = None) -> DataFrame:
    """Lines with scope decision, direct category, overrides and eligibility.

    The mapping is tiny and joins by broadcast when its measured size allows. Part overrides
    replace keys and categories, scale prices and quantities, and may include or exclude.
    """
    r = resolved or Resolved()
    col = F.col
    if r.scope_mapping is None and r.category_mapping is None:
        rule = C.scope_decision(col("bucket"), col("description"))
        d = cleaned.withColumns({"decision": rule["decision"], "scope_category": rule["category"], "manual_override": F.lit("")})
    else:
        m = complete_mapping(cleaned, r.scope_mapping, r.category_mapping)
        m = m.select(col("bucket").alias("_b"), col("description").alias("_d"), "decision", col("category").alias("scope_category"), "manual_override")
        d = cleaned.join(m, col("bucket").eqNullSafe(col("_b")) & col("description").eqNullSafe(col("_d")), "left").drop("_b", "_d")
        d = d.withColumns({"decision": F.coalesce("decision", F.lit("Needs Review")), "scope_category": F.coalesce("scope_category", F.lit("Uncategorized"))})
    d = d.withColumn("direct_category", C.direct_category(col("description")))
    d = _overridden(d, r.part_overrides).withColumn("in_direct_costs", col("direct_category").isNotNull())
    service = col("service_like") & (col("decision") == "Include")
    demote = service & (F.trim(F.coalesce("manual_override", F.lit(""))) == "") & ~col("in_direct_costs")
    d = d.withColumn("scope_warning", F.when(service, "service_like_description")).withColumn("decision", F.when(demote, "Needs Review").otherwise(col("decision")))
    mode = r.controls.scope_mode
    if mode == "all_po_lines":
        selected = col("decision") != "Exclude"
    elif mode == "inventory_only":
        selected = F.coalesce(F.lower(F.trim("direct_category")) == "inventory", F.lit(False))
    else:
        selected = col("in_direct_costs")
    priced = col("manual_current_price").isNotNull()
    d = d.withColumns({"scope_uncertain": col("decision") == "Needs Review", "in_selected_scope": selected})
    forced = priced & col("in_selected_scope")
    d = d.withColumns({k: col(k) | forced for k in ("included_for_pricing", "usable_price", "valid_price")})
    return d.withColumns(
        {
            "model_eligible": col("included_for_pricing") & col("in_selected_scope"),
            "in_inventory_only": col("included_for_pricing") & F.coalesce(col("direct_category") == "Inventory", F.lit(False)),
            "in_physical_inputs": col("included_for_pricing") & col("in_direct_costs"),
            "in_all_po_lines": col("included_for_pricing"),
            "in_physical_plus_review": col("included_for_pricing") & col("decision").isin("Include", "Needs Review"),
        }
    )


def _overridden(d: DataFrame, overrides: DataFrame | None) -> DataFrame:
    col = F.col
    if overrides is None:
        return d.withColumns(
            {
                "comparison_entity": col("part_key"), "match_tier": F.lit("exact"), "uom_adjusted": F.lit(False),
                "manual_current_price": F.lit(None).cast("double"), "manual_future_quantity": F.lit(None).cast("double"),
            }
        )
    blank = lambda c: F.nullif(F.trim(col(c)), F.lit(""))
    own = overrides.select(
        F.upper(F.trim("part_key")).alias("_key"), F.upper(blank("include_exclude")).alias("_in"), F.upper(blank("replacement_part_key")).alias("_new_key"),
        blank("category").alias("_category"), F.when(col("uom_factor") > 0, col("uom_factor")).alias("_factor"),
        F.when(col("manual_current_price") > 0, col("manual_current_price")).alias("manual_current_price"),
        F.when(col("manual_future_quantity") > 0, col("manual_future_quantity")).alias("manual_future_quantity"),
    )
    assert_unique(own, "_key")
    factor = F.coalesce("_factor", F.lit(1.0))
    joined = d.join(own, col("part_key") == col("_key"), "left").withColumns(
        {
            "decision": F.when(col("_in") == "EXCLUDE", "Exclude").when(col("_in") == "INCLUDE", "Include").otherwise(col("decision")),
            "scope_category": F.coalesce("_category", "scope_category"),
            "direct_category": F.coalesce(C.direct_category(col("_category")), col("direct_category")),
            "part_key": F.coalesce("_new_key", "part_key"),
            "match_tier": F.when(col("_new_key").isNotNull(), "client_approved").otherwise("exact"),
            "uom_adjusted": col("_factor").isNotNull(),
            **{p: col(p) / factor for p in ("price", "realized_price", "committed_price")},
            **{q: col(q) * factor for q in ("qty", "qty_ordered", "qty_received", "remaining_open_qty")},
        }
    )
    return joined.withColumn("comparison_entity", col("part_key")).drop("_key", "_in", "_new_key", "_category", "_factor")


def modal_categories(rows: DataFrame, entity: str) -> DataFrame:
    """Most frequent direct category of each entity (ties: the first by name) and whether it has several."""
    counts = rows.groupBy(entity, "direct_category").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(entity).agg(F.min_by("direct_category", F.struct(-F.col("n"), "direct_category")).alias("modal_category"), (F.count(F.lit(1)) > 1).alias("several_categories"))


def label_categories(classified: DataFrame) -> DataFrame:
    """``approved_category``: the part's modal category over all eligible direct lines, else the line's own."""
    rows = classified.where(F.col("part_key").isNotNull() & F.col("in_direct_costs") & F.col("included_for_pricing"))
    labels = modal_categories(rows, "part_key")
    joined = classified.join(labels, "part_key", "left")
    return joined.withColumns({"approved_category": F.coalesce("modal_category", "direct_category"), "several_categories": F.coalesce("several_categories", F.lit(False))})


def label_categories_at(classified: DataFrame, cutoff: date) -> DataFrame:
    """``approved_category`` by comparison entity from what is known at the cutoff only."""
    known = classified.where(F.col("comparison_entity").isNotNull() & F.col("in_direct_costs") & (F.col("effective_date") <= F.lit(cutoff)))
    labels = modal_categories(known, "comparison_entity").drop("several_categories")
    return classified.join(labels, "comparison_entity", "left").withColumn("approved_category", F.coalesce("modal_category", "direct_category")).drop("modal_category")


def historical_scopes(cleaned: DataFrame, mapping: DataFrame | None = None, controls: Controls | None = None) -> DataFrame:
    """Scope flags by exact description; a manual Exclude removes, a manual Include never widens the sets."""
    start = (controls or Controls()).fiscal_year_start_month
    d = cleaned.withColumn("description_norm", C.description_norm(F.col("description")))
    excluded, category = F.lit(False), F.col("description_norm")
    if mapping is not None:
        assert_unique(mapping, "bucket", "description")
        m = mapping.select(F.col("bucket").alias("_b"), F.col("description").alias("_d"), F.lower(F.trim("manual_override")).alias("_o"), F.nullif(F.trim("category"), F.lit("")).alias("_c"))
        d = d.join(m, F.col("bucket").eqNullSafe(F.col("_b")) & F.col("description").eqNullSafe(F.col("_d")), "left")
        excluded, category = F.coalesce(F.col("_o") == "exclude", F.lit(False)), F.coalesce("_c", "description_norm")
    physical = F.coalesce(F.col("description_norm").isin(*C.PHYSICAL_DESCRIPTIONS), F.lit(False)) & ~excluded
    inventory = F.coalesce(F.col("description_norm") == "INVENTORY", F.lit(False)) & ~excluded
    d = d.withColumns(
        {
            "hist_category": category, "in_inventory_only": F.col("included_for_pricing") & inventory, "in_physical_inputs": F.col("included_for_pricing") & physical,
            "in_all_po_lines": F.col("included_for_pricing"), "fiscal_year": C.fiscal_label(F.col("po_date"), start),
        }
    )
    return d.drop("_b", "_d", "_o", "_c")


def last_rows(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key in a total order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")
