"""The registered price queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costweave.config import Controls
from costweave.functions import columns as C
from costweave.operators import backtest, basket, bridge, classify, committed, forecast, indices, matching, pairs, panel, quality, regression, windows
from costweave.operators.clean import clean_lines, flag_duplicates, with_fingerprint
from costweave.plans import sql as S
from costweave.plans.stages import staged, tuned
from costweave.sources.star_schema import po_lines

BASE = date.fromisoformat(S.BASE)
Query = Callable[[SparkSession, str], DataFrame]


def _cleaned(spark, d):
    return clean_lines(po_lines(spark, d))


def _classified(spark, d):
    c = classify.classify_lines(_cleaned(spark, d))
    return c.withColumn("approved_category", F.col("direct_category"))


def _daily(spark, d, mode="quantity_weighted_mean"):
    return panel.realized_daily(_classified(spark, d), mode=mode)


#: What pairs, panels, baskets and backtests read of a daily panel; a written one holds no more, so the rest is not worked out.
_DAY = ("part_key", "po_date", "price", "qty", "spend", "approved_category")


def _written_daily(spark, d):
    return staged(_daily(spark, d).select(*_DAY), "daily")


def _written_weights(spark, d):
    """Bucket weights, a row a category, written: forecasts and indices read them several times."""
    return staged(basket.fiscal_weights(_classified(spark, d), BASE), "weights")


def _written_signal(spark, d):
    return staged(committed.committed_signal(_committed(spark, d)), "signal")


def _flagged(daily):
    return staged(pairs.flag_extremes(staged(pairs.adjacent_pairs(daily, 30), "pairs")), "flagged")


def _pairs(spark, d):
    return _flagged(_daily(spark, d))


def _panel(spark, d, freq):
    return staged(panel.part_period(_daily(spark, d), freq), "panel")


def _windows(spark):
    """Fiscal years 1998 to 2000, and 2001 to date against 2000 to date at the end of June."""
    return windows.as_tables(spark, *windows.comparisons(1998, date(2001, 6, 30)))


def _scoped(spark, d):
    h = classify.historical_scopes(_cleaned(spark, d))
    flags = F.array(*(F.when(F.col(f"in_{s}"), F.lit(s)) for s in ("inventory_only", "physical_inputs", "all_po_lines")))
    return h.withColumn("scope", F.explode(F.array_compact(flags)))


#: What baskets read of the values of a window; texts, spreads and counts are not worked out.
_WINDOW = ("label", "part_key", "price", "spend", "qty", "line_count", "scope_spend")


def _basket(spark, scoped, by):
    w, c = _windows(spark)
    values = staged(panel.window_values(scoped, w, [by]).select(by, *_WINDOW), "window-values")
    matched = staged(indices.matched_parts(values, c, [by]), "matched-parts")
    return indices.weighted_basket(matched, values, c, [by])


def _matched(spark, d):
    return _basket(spark, _scoped(spark, d), "scope")


def _variants(spark, d):
    return indices.index_variants(staged(_matched(spark, d), "matched"), ["scope"])


def _committed(spark, d):
    return staged(committed.committed_detail(_classified(spark, d), BASE), "committed")


def pick(df: DataFrame, spec: str) -> DataFrame:
    """``a b:6 c``: those columns, the ones with digits rounded; whole numbers as long."""
    out = []
    for item in spec.split():
        name, _, digits = item.partition(":")
        kind = dict(df.dtypes)[name]
        out.append(F.round(F.col(name) + float(S.nudge(int(digits))), int(digits)).alias(name) if digits else F.col(name).cast("long").alias(name) if kind in ("int", "smallint", "bigint") else F.col(name))
    return df.select(*out)


_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _register(name: str, build: Query, spec: str, table: str | None = None, tail: str = "", sql: str | None = None) -> None:
    _QUERIES[name] = lambda spark, d: pick(build(tuned(spark), d), spec)
    if sql or table:
        _SQL[name] = S.statement(sql) if sql else S.rounded(spec, table, tail)


_LINE = "source_file source_row_number"
_register("po_lines", po_lines, f"{_LINE} po_date part_number description_1 description_2 cost:6 qty_ordered qty_received extension_received:6 po_value:6 bucket description", "po_lines")
_register("clean_prices", _cleaned, f"{_LINE} part_key realized_price:6 realized_price_source committed_price:6 committed_price_source realized_spend:4 qty", "clean")
_register("clean_reconciliation", _cleaned, f"{_LINE} po_ratio:6 received_ratio:6 po_basis_factor:3 po_value_matches_ordered po_value_matches_received", "clean")
_register("clean_open_orders", _cleaned, f"{_LINE} is_open_order is_partially_received remaining_open_qty has_open_commitment remaining_open_spend:4", "clean")
_register("clean_exclusion_reasons", lambda s, d: _cleaned(s, d).groupBy("exclusion_reason", "included_for_pricing").agg(F.count(F.lit(1)).alias("n")), "exclusion_reason included_for_pricing n",
          sql="SELECT exclusion_reason, included_for_pricing, count(*) AS n FROM clean GROUP BY 1, 2")
_register("clean_duplicates", lambda s, d: flag_duplicates(_cleaned(s, d)), f"{_LINE} duplicate_count", "clean")


def _keys(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    key = C.part_key(F.concat(F.lit("  "), F.col("p_name"), F.lit("   "), F.col("p_brand")), F.lit("str"))
    return p.select("p_partkey", key.alias("part_key"), C.words_only(F.col("p_brand")).alias("words"), C.family_prefix(F.col("p_name")).alias("prefix"), C.tokens(F.col("p_name")).alias("t")).withColumn("tokens", F.array_join(F.array_sort("t"), " "))


_register("part_key_normalized", _keys, "p_partkey part_key words prefix tokens", sql=r"""
  SELECT p_partkey, upper(trim(regexp_replace('  ' || p_name || '   ' || p_brand, '\s+', ' ', 'g'))) AS part_key, trim(regexp_replace(upper(p_brand), '[^A-Z0-9]+', ' ', 'g')) AS words,
    substr(regexp_extract(split_part(regexp_replace(upper(trim(p_name)), '[\s/_.-]+', ' '), ' ', 1), '^[A-Z]{2,}[A-Z0-9]*'), 1, 12) AS prefix,
    array_to_string(list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(upper(p_name), '[^A-Z0-9]+', ' ', 'g')), ' '),
      lambda t: length(t) >= 2 AND t NOT IN ('A', 'AN', 'AND', 'FOR', 'OF', 'THE', 'TO', 'WITH', 'ASSY', 'ASSEMBLY')))), ' ') AS tokens FROM part""")  # fmt: skip
_register("scope_classified", lambda s, d: _classified(s, d).groupBy("bucket", "description", "decision", "direct_category", "in_direct_costs").agg(F.count(F.lit(1)).alias("n"), F.sum("po_value").alias("value")),
          "bucket description decision direct_category in_direct_costs n value:2", sql="SELECT bucket, description, decision, direct_category, in_direct_costs, count(*) AS n, round(sum(po_value), 2) AS value FROM classified GROUP BY 1, 2, 3, 4, 5")
_register("scope_mapping_completed", lambda s, d: classify.complete_mapping(_cleaned(s, d), s.createDataFrame([("PROMO", "Office Supplies", "Exclude", "Office", "sheet", "")], "bucket string, description string, default_decision string, category string, reason string, manual_override string")),
          "bucket description decision category", sql="""
  SELECT bucket, description, CASE WHEN bucket = 'PROMO' THEN 'Exclude' WHEN direct_category IS NOT NULL THEN 'Include' ELSE 'Needs Review' END AS decision,
    CASE WHEN bucket = 'PROMO' THEN 'Office' ELSE direct_category END AS category FROM (SELECT DISTINCT bucket, description, direct_category FROM classified) t""")  # fmt: skip


def _overrides(spark, d):
    """One override a part of sizes 1 to 3: left out, measured in thousands, or priced by hand."""
    p = spark.read.parquet(f"{d}/part.parquet").where("p_size <= 3")
    text = lambda size, value: F.when(F.col("p_size") == size, value)
    number = lambda size, value: F.when(F.col("p_size") == size, float(value))
    return p.select(
        F.col("p_partkey").cast("string").alias("part_key"), text(1, "Exclude").alias("include_exclude"), F.lit(None).cast("string").alias("replacement_part_key"), F.lit("").alias("category"),
        number(2, 1000).alias("uom_factor"), number(3, 99).alias("manual_current_price"), F.lit(None).cast("double").alias("manual_future_quantity"),
    )


def _overridden(spark, d):
    from costweave.config import resolve

    c = classify.classify_lines(_cleaned(spark, d), resolve(part_overrides=_overrides(spark, d)))
    return c.groupBy("decision", "uom_adjusted", "model_eligible", (F.col("manual_current_price").isNotNull()).alias("priced_by_hand")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("qty_received").alias("received"), F.sum("realized_spend").alias("spend"), F.sum("realized_price").alias("prices"))


_register("part_override_uom", _overridden, "decision uom_adjusted model_eligible priced_by_hand n received:2 spend:2 prices:4", sql="""
  SELECT CASE WHEN p_size = 1 THEN 'Exclude' ELSE decision END AS decision, coalesce(p_size = 2, false) AS uom_adjusted, (included_for_pricing OR coalesce(p_size = 3, false)) AND in_direct_costs AS model_eligible,
    coalesce(p_size = 3, false) AS priced_by_hand, count(*) AS n, round(sum(qty_received * CASE WHEN p_size = 2 THEN 1000 ELSE 1 END), 2) AS received, round(sum(realized_spend), 2) AS spend,
    round(sum(realized_price / CASE WHEN p_size = 2 THEN 1000 ELSE 1 END), 4) AS prices
  FROM classified JOIN part ON part_key = CAST(p_partkey AS VARCHAR) GROUP BY 1, 2, 3, 4""")  # fmt: skip
_MODAL = """SELECT part_key, direct_category AS modal_category, several_categories FROM (SELECT part_key, direct_category, count(*) OVER (PARTITION BY part_key) > 1 AS several_categories,
  row_number() OVER (PARTITION BY part_key ORDER BY n DESC, direct_category) AS k FROM (SELECT part_key, direct_category, count(*) AS n FROM mixed WHERE {} GROUP BY 1, 2) a) b WHERE k = 1"""


def _mixed(spark, d):
    """Classified lines in which every third one is Inventory, so that parts have several categories."""
    third = F.col("in_direct_costs") & (F.floor(F.col("source_row_number") / 100) % 3 == 0)
    return _classified(spark, d).withColumn("direct_category", F.when(third, "Inventory").otherwise(F.col("direct_category"))).drop("approved_category")


def _labelled_at(spark, d):
    rows = classify.label_categories_at(_mixed(spark, d), BASE).where("in_direct_costs")
    return rows.select("part_key", "direct_category", "approved_category").distinct()


def _labelled(spark, d):
    rows = classify.label_categories(_mixed(spark, d)).where("in_direct_costs")
    return rows.select("part_key", "approved_category", "several_categories").distinct()


_register("modal_category", lambda s, d: classify.modal_categories(_mixed(s, d).where("in_direct_costs and included_for_pricing"), "part_key"), "part_key modal_category several_categories",
          sql=_MODAL.format("in_direct_costs AND included_for_pricing"))
_register("cutoff_modal_category", _labelled_at, "part_key direct_category approved_category", sql=f"""
  SELECT DISTINCT c.part_key, direct_category, coalesce(modal_category, direct_category) AS approved_category FROM mixed c
  LEFT JOIN ({_MODAL.format(f"in_direct_costs AND effective_date <= DATE '{S.BASE}'")}) m ON m.part_key = c.part_key WHERE in_direct_costs""")
_register("label_categories", _labelled, "part_key approved_category several_categories", sql=f"""
  SELECT DISTINCT c.part_key, coalesce(modal_category, direct_category) AS approved_category, coalesce(several_categories, false) AS several_categories FROM mixed c
  LEFT JOIN ({_MODAL.format("in_direct_costs AND included_for_pricing")}) m ON m.part_key = c.part_key WHERE in_direct_costs""")
_register("hist_scope_flags", lambda s, d: classify.historical_scopes(_cleaned(s, d)).groupBy("description_norm", "in_inventory_only", "in_physical_inputs", "in_all_po_lines").agg(F.count(F.lit(1)).alias("n")),
          "description_norm in_inventory_only in_physical_inputs in_all_po_lines n", sql="SELECT description_norm, in_inventory_only, in_physical_inputs, in_all_po_lines, count(*) AS n FROM hist GROUP BY 1, 2, 3, 4")
_register("scope_disclosure", lambda s, d: quality.scope_disclosure(classify.historical_scopes(_cleaned(s, d))), "description_norm row_count po_value:2 scope_role", sql="""
  SELECT description_norm, count(*) AS row_count, round(sum(greatest(po_value, 0)), 2) AS po_value,
    CASE WHEN description_norm IN ('INVENTORY', 'PRODUCTION SUPPLIES', 'OPERATING SUPPLIES', 'PRODUCTION AIDS', 'SMALL TOOLS') THEN 'included_physical_inputs' ELSE 'excluded_from_physical_inputs' END AS scope_role
  FROM hist WHERE included_for_pricing GROUP BY 1""")  # fmt: skip
_DAILY = "part_key po_date price:6 qty:4 spend:4 line_count price_min:6 price_max:6 price_mean:6 price_std:6 price_median:6 price_cv:6 is_open_order_any approved_category"
_register("same_day_panel", _daily, _DAILY, "daily")
_register("same_day_median", lambda s, d: _daily(s, d, "median"), "part_key po_date price:6 qty:4", sql="SELECT part_key, po_date, round(price_median, 6) AS price, round(CASE WHEN q0 > 0 THEN q0 END, 4) AS qty FROM daily_0 WHERE price_median > 0")
for _f in ("m", "q", "fy"):
    _F = _f.upper()
    _register(f"part_period_{_f}", partial(_panel, freq=_F), "part_key period_start period_end period_ordinal price:6 qty:4 spend:4 approved_category", f"panel_{_f}")
    _register(f"matched_part_changes_{_f}", lambda s, d, f=_F: indices.matched_changes(_panel(s, d, f)),
              "period_start period_end match_count matched_spend:2 current_matched_spend:2 total_spend:2 coverage:6 median_change:6 equal_change:6 winsor_equal_change:6 capped_spend_change:6 winsor_low:6 winsor_high:6",
              f"mchg_{_f}")
    _register(f"tornqvist_{_f}", lambda s, d, f=_F: indices.tornqvist(_panel(s, d, f)), "period_start period_end match_count log_change:6 pct_change:6 index_level:5 coverage:6 status", sql=f"""
  SELECT t.period_start, period_end, match_count, round(g, 6) AS log_change, round(exp(g) - 1, 6) AS pct_change, round(exp(sum(g) OVER (ORDER BY t.period_start)), 5) AS index_level,
    round(tv / total, 6) AS coverage, CASE WHEN g IS NULL THEN 'unavailable' ELSE 'ok' END AS status
  FROM torn_{_f} t JOIN (SELECT period_start, sum(spend) AS total FROM panel_{_f} GROUP BY 1) p ON p.period_start = t.period_start""")  # fmt: skip
    _register(f"fisher_{_f}", lambda s, d, f=_F: indices.fisher(_panel(s, d, f)), "period_start period_end match_count laspeyres:6 paasche:6 log_change:6 pct_change:6 index_level:5", sql=f"""
  SELECT period_start, period_end, match_count, round(l, 6) AS laspeyres, round(p, 6) AS paasche, round(ln(l * p) / 2, 6) AS log_change, round(exp(ln(l * p) / 2) - 1, 6) AS pct_change,
    round(exp(sum(ln(l * p) / 2) OVER (ORDER BY period_start)), 5) AS index_level
  FROM (SELECT period_start, max(period_end) AS period_end, count(*) AS match_count, sum(price * qty_0) / sum(price_0 * qty_0) AS l, sum(price * qty) / sum(price_0 * qty) AS p FROM links_{_f} WHERE qty > 0 AND qty_0 > 0 GROUP BY 1) t""")  # fmt: skip
_register("part_window_values", lambda s, d: panel.part_windows(_scoped(s, d), _windows(s)[0], ["scope"]),
          "scope label part_key price:6 spend:4 qty:4 line_count unique_price_count first_date last_date price_min:6 price_max:6 price_dispersion:4", "wparts")
_register("adjacent_pairs", lambda s, d: pairs.adjacent_pairs(_daily(s, d)), "part_key date_a date_b price_a:6 price_b:6 y:6 x_q:6 delta_days delta_years:6 price_ratio:6 qty_comparable n_pairs_part approved_category", "pairs_all")
_register("extreme_pairs", _pairs, "part_key date_a date_b mad_z:5 extreme_ratio extreme_mad extreme_flag", "flagged")
_register("pair_weights", lambda s, d: pairs.pair_weights(_pairs(s, d)), "part_key date_a date_b pair_weight:6", "weighted")
_register("month_exposure", lambda s, d: pairs.month_exposure(_pairs(s, d)), "part_key date_a date_b month exposure:6", "exposure", "WHERE exposure > 0")
_register("wls_gram", lambda s, d: pairs.weighted_gram(pairs.pair_weights(_pairs(s, d))), "month month_2 gram:4",
          sql="SELECT a.month, b.month AS month_2, round(sum(a.pair_weight * a.exposure * b.exposure), 4) AS gram FROM exposure a JOIN exposure b ON a.part_key = b.part_key AND a.date_a = b.date_a WHERE a.exposure > 0 AND b.exposure > 0 GROUP BY 1, 2")
_register("matched_basket_detail", _matched, "scope comparison part_key r:6 r_w:6 s_bar:8 s_tilde:8 h_tilde:8 qty_comparable no_price_change coverage_a:6 coverage_b:6", "matched")
_VARIANT = "median_change:6 p25_change:6 p75_change:6 share_unchanged:6 matched_spend_a:2 matched_spend_b:2 coverage_a:6 coverage_b:6 winsor_low:6 winsor_high:6 weight_cap:8 raw_tornqvist:6 winsor_tornqvist:6 headline:6 capped_geometric_spend:6 equal_winsor:6 equal_raw:6 similar_quantity:6 similar_parts"
_register("index_variants", _variants, f"scope comparison matched_parts {_VARIANT}", "variants")
_register("robust_capped_tornqvist", lambda s, d: indices.reliability(_variants(s, d)), "scope comparison matched_parts headline:6 low_reliability", sql="""
  SELECT scope, comparison, matched_parts, round(headline, 6) AS headline, matched_parts < 100 OR coalesce(coverage_a, 0) < 0.2 OR coalesce(coverage_b, 0) < 0.2 AS low_reliability FROM variants""")  # fmt: skip
_register("method_sensitivity", lambda s, d: indices.method_sensitivity(_variants(s, d), ["scope"]), "scope comparison method change:6",
          sql=" UNION ALL ".join(f"SELECT scope, comparison, '{m}' AS method, round({m}, 6) AS change FROM variants" for m in indices.METHODS))


def _by_category(spark, d):
    physical = classify.historical_scopes(_cleaned(spark, d)).where("in_physical_inputs").withColumn("category", F.col("description_norm"))
    return indices.reliability(indices.index_variants(staged(_basket(spark, physical, "category"), "matched"), ["category"]))


_register("category_comparisons", _by_category, "category comparison matched_parts headline:6 equal_winsor:6 capped_geometric_spend:6 coverage_a:6 coverage_b:6 low_reliability")
_SQL["category_comparisons"] = S.statement("""
  SELECT scope AS category, comparison, matched_parts, round(headline, 6) AS headline, round(equal_winsor, 6) AS equal_winsor, round(capped_geometric_spend, 6) AS capped_geometric_spend, round(coverage_a, 6) AS coverage_a,
    round(coverage_b, 6) AS coverage_b, matched_parts < 100 OR coalesce(coverage_a, 0) < 0.2 OR coalesce(coverage_b, 0) < 0.2 AS low_reliability FROM variants""").replace(S._PARTS["scoped"], " SELECT description_norm AS scope, * FROM hist WHERE in_physical_inputs")
_register("chain_annualized", lambda s, d: indices.chain(_variants(s, d).where(~F.col("comparison").contains("YTD")), ["scope"]), "scope n_links cumulative:6 annualised:6", sql="""
  SELECT scope, count(headline) AS n_links, round(exp(sum(ln(1 + headline))) - 1, 6) AS cumulative, round(exp(sum(ln(1 + headline)) / count(headline)) - 1, 6) AS annualised FROM variants WHERE comparison NOT LIKE '%YTD%' GROUP BY 1""")  # fmt: skip
_register("spend_reconciliation", lambda s, d: quality.spend_reconciliation(classify.historical_scopes(_cleaned(s, d))), "fiscal_year sum_po_value:2 sum_price_x_qty:2 row_count large_ratio_rows ratio:6 large_ratio_share:6", sql="""
  SELECT fiscal_year, round(sum(po_value), 2) AS sum_po_value, round(sum(price * qty_ordered), 2) AS sum_price_x_qty, count(*) AS row_count,
    count(*) FILTER (WHERE price * qty_ordered / po_value > 10 OR price * qty_ordered / po_value < 0.1) AS large_ratio_rows, round(sum(price * qty_ordered) / sum(po_value), 6) AS ratio,
    round(count(*) FILTER (WHERE price * qty_ordered / po_value > 10 OR price * qty_ordered / po_value < 0.1) / count(*), 6) AS large_ratio_share FROM hist WHERE in_physical_inputs GROUP BY 1""")  # fmt: skip


def _quality(spark, d):
    c = staged(with_fingerprint(_classified(spark, d)).select(*quality.COLUMNS), "quality-lines")
    unread = {k: F.lit(None).cast("string") for k in ("match_tier", "description_1", "description_2")}
    daily = staged(panel.realized_daily(c.withColumns({**unread, "is_open_order": F.lit(None).cast("boolean")})).select(*_DAY), "daily")
    found = staged(pairs.adjacent_pairs(daily, 30).select(*quality.PAIR_COLUMNS), "pairs")
    return quality.data_quality(c, daily, pairs.flag_extremes(found))


_DQ = {
    "raw_rows": ("true", "po_value"), "approved_direct_cost_rows": ("in_direct_costs", "po_value"), "realized_direct_cost_rows": ("in_direct_costs AND realized_spend > 0", "realized_spend"),
    "open_direct_cost_rows": ("in_direct_costs AND has_open_commitment", "remaining_open_spend"), "missing_part_key": ("part_key IS NULL", "po_value"), "invalid_or_missing_date": ("effective_date IS NULL", "po_value"),
    "duplicate_looking_rows": ("duplicate_count > 1", "po_value"), "po_value_reconciliation_failure": ("NOT po_value_matches_ordered", "po_value"),
    "received_extension_reconciliation_failure": ("NOT coalesce(abs(received_ratio - 1) <= 2e-4, false)", "po_value"), "historical_cost_fallback": ("realized_price_source = 'cost_fallback'", "realized_spend"),
}
_register("data_quality", _quality, "issue row_count value:2", sql=" UNION ALL ".join(
    [f"SELECT '{k}' AS issue, count(*) AS row_count, round(coalesce(sum({v}), 0), 2) AS value FROM classified WHERE {m}" for k, (m, v) in _DQ.items()]
    + ["SELECT 'realized_part_days', count(*), round(sum(spend), 2) FROM daily", "SELECT 'repeat_pairs', count(*), round(sum(spend_b), 2) FROM flagged", "SELECT 'extreme_pairs', count(*), round(sum(spend_b), 2) FROM flagged WHERE extreme_flag"]))
_register("basis_histogram", lambda s, d: quality.basis_histogram(_cleaned(s, d)), "po_basis_factor:3 row_count", sql="SELECT round(po_basis_factor, 3) AS po_basis_factor, count(*) AS row_count FROM clean GROUP BY 1")
_register("exclusion_log", lambda s, d: quality.exclusion_log(_classified(s, d)), "pool_reason row_count value:2", sql="""
  SELECT pool_reason, count(*) AS row_count, round(sum(CASE WHEN pool_reason = 'no_received_quantity' THEN coalesce(remaining_open_spend, 0) ELSE coalesce(realized_spend, po_value, 0) END), 2) AS value
  FROM (SELECT *, CASE WHEN NOT in_direct_costs THEN 'outside_approved_direct_cost_scope' WHEN part_key IS NULL THEN 'missing_part_key' WHEN effective_date IS NULL THEN 'invalid_or_missing_date'
    WHEN NOT coalesce(qty_received, 0) > 0 THEN 'no_received_quantity' WHEN NOT coalesce(realized_price, 0) > 0 THEN 'invalid_realized_price' ELSE 'included_in_realized_pool' END AS pool_reason FROM classified) t GROUP BY 1""")  # fmt: skip
_register("profile_summary", lambda s, d: quality.profile(_cleaned(s, d)), "rows parts parts_in_2_sources parts_in_3_sources parts_in_4_sources", sql="""
  SELECT (SELECT count(*) FROM clean) AS rows, count(*) AS parts, count(*) FILTER (WHERE n >= 2) AS parts_in_2_sources, count(*) FILTER (WHERE n >= 3) AS parts_in_3_sources, count(*) FILTER (WHERE n >= 4) AS parts_in_4_sources
  FROM (SELECT part_key, count(DISTINCT source_file) AS n FROM clean WHERE part_key IS NOT NULL GROUP BY 1) t""")  # fmt: skip
_register("source_gaps", lambda s, d: quality.source_ranges(po_lines(s, d)), "source_file row_count first_date last_date previous_last overlaps gap_days has_gap", sql="""
  SELECT source_file, row_count, first_date, last_date, previous_last, coalesce(first_date <= previous_last, false) AS overlaps, CAST(coalesce(greatest(first_date - previous_last - 1, 0), 0) AS BIGINT) AS gap_days,
    coalesce(first_date - previous_last - 1 > 7, false) AS has_gap
  FROM (SELECT *, lag(last_date) OVER (ORDER BY first_date, source_file) AS previous_last FROM (SELECT source_file, count(*) AS row_count, min(po_date) AS first_date, max(po_date) AS last_date FROM po_lines GROUP BY 1) a) b""")  # fmt: skip
_register("committed_asof_detail", _committed, f"{_LINE} part_key po_date committed_price:6 remaining_open_spend:4 prior_price:6 prior_date gap_days:0 log_change:6 annual_log_change:6 matched", "committed")
_register("committed_signal", lambda s, d: committed.committed_signal(_committed(s, d)), "category open_rows matched_rows open_value:2 matched_open_value:2 coverage:6 annual_log_signal:6 annual_rate_signal:5 share_of_open_value:6 status", sql="""
  SELECT category, open_rows, matched_rows, round(ov, 2) AS open_value, round(mv, 2) AS matched_open_value, round(mv / nullif(ov, 0), 6) AS coverage, round(sig, 6) AS annual_log_signal, round(exp(sig) - 1, 5) AS annual_rate_signal,
    round(ov / (SELECT sum(open_weight) FROM committed), 6) AS share_of_open_value, CASE WHEN matched_rows > 0 THEN 'ok' ELSE 'insufficient_matches' END AS status
  FROM (SELECT b.category, count(*) AS open_rows, count(*) FILTER (WHERE annual_log_change IS NOT NULL AND open_weight > 0) AS matched_rows, sum(open_weight) AS ov,
      coalesce(sum(open_weight) FILTER (WHERE annual_log_change IS NOT NULL AND open_weight > 0), 0) AS mv,
      sum(least(open_weight, cap) * least(greatest(annual_log_change, lo), hi)) FILTER (WHERE annual_log_change IS NOT NULL AND open_weight > 0) / sum(least(open_weight, cap)) FILTER (WHERE annual_log_change IS NOT NULL AND open_weight > 0) AS sig
    FROM committed_both b LEFT JOIN committed_stats s ON s.category = b.category GROUP BY 1) t""")  # fmt: skip
_register("bucket_weights_fy", lambda s, d: basket.fiscal_weights(_classified(s, d), BASE), "direct_category basket_value:2 basket_rows weight:6 basket_source", sql="""
  SELECT direct_category, round(sum(realized_spend), 2) AS basket_value, count(*) AS basket_rows, round(sum(realized_spend) / sum(sum(realized_spend)) OVER (), 6) AS weight, 'FY2000_realized_spend_proxy' AS basket_source
  FROM fy_spend WHERE source_file = 'FY2000' GROUP BY 1""")  # fmt: skip


def _planned(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("string").alias("part_key"), F.col("p_size").cast("double").alias("expected_quantity"), F.when(F.col("p_size") < 10, F.col("p_retailprice")).alias("expected_spend"))
    return basket.planned_weights(_classified(spark, d), p, BASE)


_register("bucket_weights_planned", _planned, "direct_category basket_value:2 basket_rows weight:6 basket_source", sql=f"""
  SELECT direct_category, round(sum(v), 2) AS basket_value, count(*) AS basket_rows, round(sum(v) / sum(sum(v)) OVER (), 6) AS weight, 'planned_basket' AS basket_source
  FROM (SELECT direct_category, CASE WHEN p_size < 10 THEN p_retailprice ELSE p_size * realized_price END AS v FROM part JOIN (SELECT part_key, direct_category, realized_price,
    row_number() OVER (PARTITION BY part_key ORDER BY effective_date DESC, source_file DESC, source_row_number DESC) AS k FROM classified WHERE in_direct_costs AND effective_date <= DATE '{S.BASE}') l
    ON k = 1 AND part_key = CAST(p_partkey AS VARCHAR)) t GROUP BY 1""")  # fmt: skip
_register("pair_coverage", lambda s, d: quality.pair_coverage(_pairs(s, d)), "category pairs parts pair_spend:2 pair_spend_share:6",
          sql="SELECT approved_category AS category, count(*) AS pairs, count(DISTINCT part_key) AS parts, round(sum(spend_b), 2) AS pair_spend, round(sum(spend_b) / sum(sum(spend_b)) OVER (), 6) AS pair_spend_share FROM flagged GROUP BY 1")
_register("coverage_current", lambda s, d: quality.current_coverage(_classified(s, d), _pairs(s, d), BASE), "category current_spend:2 matched_spend:2 matched_coverage:6", sql="""
  SELECT direct_category AS category, round(sum(realized_spend), 2) AS current_spend, round(sum(CASE WHEN part_key IN (SELECT part_key FROM flagged) THEN realized_spend ELSE 0 END), 2) AS matched_spend,
    round(sum(CASE WHEN part_key IN (SELECT part_key FROM flagged) THEN realized_spend ELSE 0 END) / sum(realized_spend), 6) AS matched_coverage
  FROM fy_spend WHERE effective_date > DATE '""" + S.BASE + "' - 365 GROUP BY 1")  # fmt: skip


def _families(spark, d):
    parts = staged(matching.part_stats(_classified(spark, d), C.family_prefix(F.col("description_1"))), "parts")
    return matching.family_candidates(parts, 0.10, 2.0)


_register("family_candidates", _families, "candidate_family direct_category prefix part_key words observations first_fy last_fy median_price:6 similarity:6 dispersion:6 activated", sql=r"""
  SELECT p.direct_category || '-' || p.prefix AS candidate_family, p.direct_category, p.prefix, part_key, words, observations, first_fy, last_fy, round(median_price, 6) AS median_price, round(similarity, 6) AS similarity, round(dispersion, 6) AS dispersion, false AS activated
  FROM fparts p JOIN (SELECT a.direct_category, a.prefix, avg(len(list_intersect(a.tokens, b.tokens)) / greatest(len(list_distinct(list_concat(a.tokens, b.tokens))), 1)) AS similarity
      FROM fparts a JOIN fparts b ON a.direct_category = b.direct_category AND a.prefix = b.prefix AND a.part_key < b.part_key GROUP BY 1, 2) s ON s.direct_category = p.direct_category AND s.prefix = p.prefix
  JOIN (SELECT direct_category, prefix, count(*) AS n, stddev_pop(ln(median_price)) AS dispersion FROM fparts GROUP BY 1, 2) g ON g.direct_category = p.direct_category AND g.prefix = p.prefix
  WHERE n BETWEEN 2 AND 100 AND similarity >= 0.10 AND dispersion <= 2.0""")  # fmt: skip


def _monthly_rates(spark, d):
    t = indices.tornqvist(_panel(spark, d, "M"))
    return t.select(F.lit("Overall").alias("series"), F.col("period_start").alias("month"), F.col("log_change").alias("rate"))


_register("forecast_candidates", lambda s, d: forecast.candidates(forecast.series_arrays(_monthly_rates(s, d))), "series method cumulative_log:5",
          sql="SELECT 'Overall' AS series, method, round(cumulative_log, 5) AS cumulative_log FROM sums WHERE i = n")
_register("method_selection", lambda s, d: forecast.method_errors(forecast.series_arrays(_monthly_rates(s, d))), "series method mae:5 n_evals", sql="""
  SELECT 'Overall' AS series, method, round(avg(abs(cumulative_log - actual)), 5) AS mae, count(*) AS n_evals
  FROM sums JOIN (SELECT a.i, sum(b.x) AS actual FROM ser a JOIN ser b ON b.i BETWEEN a.i + 1 AND a.i + 12 GROUP BY 1) f ON f.i = sums.i WHERE sums.i BETWEEN 13 AND n - 12 AND n >= 18 GROUP BY 1, 2""")  # fmt: skip
_register("holdout_basket", lambda s, d: basket.holdout_basket(_written_daily(s, d), date(1999, 9, 30)), "part_key base_date actual_date gap_days actual_multiplier:6 unscaled_multiplier:6 extreme pre_robust_weight:8 weight:8 stale_excluded", sql="""
  SELECT part_key, base_date, actual_date, gap AS gap_days, round(exp(greatest(least(lh, least(qh, ln(4.0))), greatest(ql, ln(0.25)))), 6) AS actual_multiplier,
    round(exp(greatest(least(raw, least(rh, ln(4.0))), greatest(rl, ln(0.25)))), 6) AS unscaled_multiplier, (lh < ln(0.25) OR lh > ln(4.0)) AS extreme, round(w1 / sum(w1) OVER (), 8) AS pre_robust_weight,
    round(w1 * CASE WHEN lh < ln(0.25) OR lh > ln(4.0) THEN 0.25 ELSE 1 END / sum(w1 * CASE WHEN lh < ln(0.25) OR lh > ln(4.0) THEN 0.25 ELSE 1 END) OVER (), 8) AS weight, stale_excluded
  FROM (SELECT h.*, ql, qh, rl, rh, least(w0, cap) AS w1, (SELECT count(*) FROM hold_0 WHERE gap > 548) AS stale_excluded
    FROM hold_1 h, (SELECT quantile_cont(lh, 0.01) AS ql, quantile_cont(lh, 0.99) AS qh, quantile_cont(raw, 0.01) AS rl, quantile_cont(raw, 0.99) AS rh, quantile_cont(w0, 0.95) AS cap FROM hold_1) s) t""")  # fmt: skip


def _metrics(spark, d):
    """Errors of prices forecast a year ahead: the last price moved by the mean of the twelve monthly changes known then."""
    daily, cutoff = _written_daily(spark, d), date(1999, 9, 30)
    monthly = indices.tornqvist(staged(panel.part_period(daily.where(F.col("po_date") <= F.lit(cutoff)), "M"), "panel"))
    series = forecast.series_arrays(monthly.select(F.lit("Overall").alias("series"), F.col("period_start").alias("month"), F.col("log_change").alias("rate")))
    change = forecast.candidates(series).where(F.col("method") == forecast.METHODS[0]).select("cumulative_log")
    held = staged(basket.holdout_basket(daily, cutoff), "holdout").join(F.broadcast(change))
    predicted = F.col("price_base") * F.exp("cumulative_log")
    rows = held.select("approved_category", F.col("price_actual").alias("actual"), predicted.alias("predicted"), F.col("price_base").alias("base"), "weight")
    return basket.forecast_metrics(rows, ["approved_category"])


_register("forecast_metrics", _metrics, "approved_category n wape:6 wale:6 mdape:6 directional_accuracy:6", sql="""
  SELECT approved_category, count(*) AS n, round(sum(weight * abs(p - pa)) / sum(weight * pa), 6) AS wape, round(sum(weight * abs(ln(p) - ln(pa))) / sum(weight), 6) AS wale,
    round(median(abs((p - pa) / pa)), 6) AS mdape, round(avg(CASE WHEN sign(pa - pb) = sign(p - pb) THEN 1.0 ELSE 0.0 END), 6) AS directional_accuracy
  FROM (SELECT *, pb * exp((SELECT 12 * avg(x) FROM (SELECT x FROM ser WHERE month <= DATE '1999-09-01' ORDER BY i DESC LIMIT 12) r)) AS p FROM hold_2) t GROUP BY 1""")  # fmt: skip
_register("last_price", lambda s, d: classify.last_rows(_daily(s, d).where(F.col("po_date") <= F.lit(BASE)), "part_key", ["po_date"]), "part_key po_date price:6",
          sql=f"SELECT part_key, po_date, round(price, 6) AS price FROM (SELECT *, row_number() OVER (PARTITION BY part_key ORDER BY po_date DESC) AS k FROM daily WHERE po_date <= DATE '{S.BASE}') t WHERE k = 1")
_register("top_weighted_parts", lambda s, d: _daily(s, d).groupBy("part_key").agg(F.sum("spend").alias("spend")).orderBy(F.desc("spend"), "part_key").limit(100), "part_key spend:2",
          sql="SELECT part_key, round(sum(spend), 2) AS spend FROM daily GROUP BY 1 ORDER BY sum(spend) DESC, part_key LIMIT 100")


def _with_pairs(spark, d, how, which):
    daily = _written_daily(spark, d)
    return daily.join(_flagged(daily).where(which).select("part_key").distinct(), "part_key", how)


_register("paired_semi", lambda s, d: _with_pairs(s, d, "left_semi", "true"), "part_key po_date price:6", sql="SELECT part_key, po_date, round(price, 6) AS price FROM daily WHERE part_key IN (SELECT part_key FROM flagged)")
_register("extreme_anti", lambda s, d: _with_pairs(s, d, "left_anti", "extreme_flag"), "part_key po_date price:6",
          sql="SELECT part_key, po_date, round(price, 6) AS price FROM daily WHERE part_key NOT IN (SELECT part_key FROM flagged WHERE extreme_flag)")


def _model(spark, d, daily=None):
    weighted = staged(pairs.pair_weights(_pairs(spark, d) if daily is None else _flagged(daily)), "weighted")
    return weighted, regression.fit_repeat_sales(weighted)


def _index(spark, d):
    return regression.monthly_index(_model(spark, d)[1].rates(spark), _written_weights(spark, d), BASE)


def _forecast(spark, d, fitted=None):
    weighted, model = fitted or _model(spark, d)
    n = quality.pair_coverage(weighted).select("category", "pairs")
    return forecast.annual_forecast(model.rates(spark), _written_weights(spark, d), staged(n, "pair-counts"), BASE, _written_signal(spark, d))


def _physical_daily(spark, d):
    return panel.physical_daily(classify.historical_scopes(_cleaned(spark, d)))


_register("physical_daily", _physical_daily, "part_key po_date price:6 qty:4 spend:2 approved_category", sql="""
  SELECT part_key, po_date, round(median(price), 6) AS price, round(median(qty_ordered) FILTER (WHERE qty_ordered > 0), 4) AS qty, round(sum(greatest(coalesce(po_value, 0), 0)), 2) AS spend, max(modal) AS approved_category
  FROM (SELECT *, first(description_norm) OVER (PARTITION BY part_key, po_date ORDER BY n DESC, description_norm) AS modal
        FROM (SELECT *, count(*) OVER (PARTITION BY part_key, po_date, description_norm) AS n FROM hist WHERE in_physical_inputs AND part_key IS NOT NULL AND po_date IS NOT NULL AND price > 0) a) b GROUP BY 1, 2""")
_register("monthly_rates", lambda s, d: _model(s, d)[1].rates(s), "series month rate:6")
_register("monthly_index", _index, "series month rate:6 index_level:4 status")
_register("fy_ttm_rates", lambda s, d: regression.fiscal_and_trailing_rates(_index(s, d), BASE), "series period period_type end_date inflation_rate:5")
_register("bucket_forecast", lambda s, d: _forecast(s, d)[0], "direct_category forecast_year method committed_weight:6 annual_rate:5 cumulative_multiplier:5 at_guardrail")
_register("composite_forecast", lambda s, d: _forecast(s, d)[1], "forecast_year annual_rate:5 cumulative_multiplier:5")
_register("part_residuals", lambda s, d: regression.part_residuals(regression.predict_pairs(*_model(s, d))), "part_key category n_pairs span_days residual_rate:5 shrinkage:6 shrunk_residual:6 quality:6 source")
_register("huber_trim_grid", lambda s, d: regression.joint_huber(staged(pairs.adjacent_pairs(_physical_daily(s, d), 30).select(*regression.HUBER_COLUMNS), "pairs")), "trim weighting n_pairs n_parts annual_rate:4 gamma:4 converged")

_register("source_trace", lambda s, d: bridge.source_trace(_cleaned(s, d), ("source_file", "source_row_number", "description_1")), "part_key source_file source_row_number description_1",
          sql="SELECT part_key, source_file, source_row_number, description_1 FROM (SELECT *, row_number() OVER (PARTITION BY part_key ORDER BY po_date DESC, source_file DESC, source_row_number DESC) AS k FROM clean WHERE part_key IS NOT NULL) t WHERE k = 1")


def _backtest(spark, d, cutoffs=None):
    spend = _classified(spark, d).select("in_direct_costs", "effective_date", "realized_spend", "direct_category")
    return backtest.composite_backtest(_written_daily(spark, d), spend, BASE, Controls(), cutoffs)


def _bands(spark, d):
    best = backtest.backtest_summary(_backtest(spark, d)).where("selected").first()
    method = best.method if best else forecast.METHODS[0]
    return backtest.bootstrap_forecasts(_pairs(spark, d), _written_weights(spark, d), BASE, method, _written_signal(spark, d), Controls())[0]


def _bridged(spark, d, daily=None, fitted=None):
    daily = _written_daily(spark, d) if daily is None else daily
    weighted, model = fitted or _model(spark, d, daily)
    residuals = regression.part_residuals(regression.predict_pairs(weighted, model))
    lines = _cleaned(spark, d).withColumn("model_eligible", F.col("included_for_pricing"))
    return bridge.basket_quantities(bridge.bridged_prices(daily, residuals, model, BASE), lines, BASE)


def _purchasing(spark, d):
    """Cost of the basket a year ahead: each part moves by the forecast of its category, else by the composite one."""
    daily = _written_daily(spark, d)
    fitted = _model(spark, d, daily)
    bucket, composite = (staged(table, "forecast") for table in _forecast(spark, d, fitted))
    first = "forecast_year = 1"
    own = bucket.where(first).select(F.col("direct_category").alias("category"), F.col("cumulative_multiplier").alias("own"))
    rows = staged(_bridged(spark, d, daily, fitted), "bridged").join(own, "category", "left").join(F.broadcast(composite.where(first).select(F.col("cumulative_multiplier").alias("overall"))))
    return bridge.purchasing_cost(rows.withColumn("multiplier", F.coalesce("own", "overall")))


def _stationary(spark, d):
    """How far the overall fit is from solving each of its equations, X'W (y - X theta) = P theta, summed anew in plain columns; a part of the size of its terms."""
    weighted, model = _model(spark, d)
    controls, months = Controls(), len(model.months)
    pairs_ = regression.predict_pairs(weighted, regression.RepeatSales(model.months, model.delta0, model.gamma0, model.sigma, True, model.n_pairs))
    r = F.col("y") - F.col("predicted")
    damped = F.when(F.abs(r) > controls.huber_delta * model.sigma, controls.huber_delta * model.sigma / F.abs(r)).otherwise(1.0)
    pull = pairs_.withColumn("pull", F.col("pair_weight") * damped * r)
    by_month = pairs.month_exposure(pull.select("part_key", "date_a", "date_b", "pull"), ("part_key", "date_a", "date_b", "pull"))
    sums = {x.month: (x.g, x.s) for x in by_month.groupBy("month").agg(F.sum(F.col("pull") * F.col("exposure")).alias("g"), F.sum(F.abs("pull") * F.col("exposure")).alias("s")).collect()}
    own = pull.agg(F.sum(F.col("pull") * F.col("x_q")), F.sum(F.abs(F.col("pull") * F.col("x_q"))), F.count(F.lit(1))).first()
    theta = [*model.delta0.tolist(), model.gamma0]
    held = regression.penalty_matrix(months, controls) @ theta
    gaps = [(m.isoformat(), own[2], float(abs(sums.get(m, (0.0, 0.0))[0] - held[i]) / (1.0 + sums.get(m, (0.0, 0.0))[1]))) for i, m in enumerate(model.months)]
    gaps.append(("quantity", own[2], float(abs((own[0] or 0.0) - held[-1]) / (1.0 + (own[1] or 0.0)))))
    return spark.createDataFrame(gaps, "part string, n_pairs long, gap double")


_register("repeat_sales_equations", _stationary, "part n_pairs gap:3", sql="""
  SELECT part, n_pairs, CAST(0 AS DOUBLE) AS gap FROM (SELECT CAST(month AS VARCHAR) AS part FROM exposure WHERE exposure > 0 GROUP BY 1 UNION ALL SELECT 'quantity') p, (SELECT count(*) AS n_pairs FROM weighted) w""")


def _link_index(spark, d):
    """The monthly index along Törnqvist links in place of fitted rates: the same steps with an input that a second engine has."""
    return regression.monthly_index(_monthly_rates(spark, d), _written_weights(spark, d), BASE)


def _link_forecast(spark, d):
    """Three years along Törnqvist links by the trailing mean, without a committed signal."""
    weights = _written_weights(spark, d)
    none = spark.createDataFrame([], "category string, pairs long")
    return forecast.annual_forecast(_monthly_rates(spark, d), weights, none, BASE, forced_method=forecast.METHODS[0])


_LINK_SERIES = "(SELECT direct_category AS series FROM fy_spend WHERE source_file = 'FY2000' GROUP BY 1 UNION ALL SELECT 'Overall Direct Fit' UNION ALL SELECT 'Combined Direct Costs') s"
_register("index_of_links", _link_index, "series month rate:6 index_level:4 status", sql=f"""
  SELECT series, month, CASE WHEN series <> 'Combined Direct Costs' THEN round(x, 6) END AS rate,
    round(100 * exp(sum(x) OVER (PARTITION BY series ORDER BY month) - first(x) OVER (PARTITION BY series ORDER BY month)), 4) AS index_level,
    CASE WHEN month <= DATE '2000-12-01' THEN 'complete' ELSE 'partial' END AS status FROM ser, {_LINK_SERIES}""")  # fmt: skip
_register("rates_of_links", lambda s, d: regression.fiscal_and_trailing_rates(_link_index(s, d), BASE), "series period period_type end_date inflation_rate:5", sql=f"""
  SELECT series, CASE WHEN month(month) = 9 THEN 'FY' || year(month) ELSE 'TTM through 2000-12-31' END AS period, CASE WHEN month(month) = 9 THEN 'complete_fiscal_year' ELSE 'trailing_12_months' END AS period_type,
    last_day(month) AS end_date, round(exp(g) - 1, 5) AS inflation_rate
  FROM (SELECT *, sum(x) OVER (ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS g FROM ser) t, {_LINK_SERIES} WHERE i > 12 AND (month(month) = 9 OR month = DATE '2000-12-01')""")  # fmt: skip
_LINK_YEARS = """(SELECT forecast_year, least(greatest(lr + power({rho}, forecast_year - 1) * (y1 - lr), {floor}), {cap}) AS g
    FROM (SELECT least(greatest(12 * avg(x) FILTER (WHERE k <= 12), {floor}), {cap}) AS y1, least(greatest(12 * avg(x) FILTER (WHERE k <= 36), {floor}), {cap}) AS lr
          FROM (SELECT x, row_number() OVER (ORDER BY month DESC) AS k FROM ser WHERE month <= DATE '2000-12-01') last) c, (VALUES (1), (2), (3)) y(forecast_year)) g""".format(
    rho=Controls().forecast_mean_reversion_rho, floor=Controls().forecast_annual_log_floor, cap=Controls().forecast_annual_log_cap
)
_register("forecast_of_links", lambda s, d: _link_forecast(s, d)[0], "direct_category forecast_year annual_rate:5 cumulative_multiplier:5", sql=f"""
  SELECT direct_category, forecast_year, round(exp(g) - 1, 5) AS annual_rate, round(exp(sum(g) OVER (PARTITION BY direct_category ORDER BY forecast_year)), 5) AS cumulative_multiplier
  FROM {_LINK_YEARS}, (SELECT direct_category FROM fy_spend WHERE source_file = 'FY2000' GROUP BY 1) b""")  # fmt: skip
_register("composite_of_links", lambda s, d: _link_forecast(s, d)[1], "forecast_year annual_rate:5 cumulative_multiplier:5", sql=f"""
  SELECT forecast_year, round(exp(g) - 1, 5) AS annual_rate, round(exp(sum(g) OVER (ORDER BY forecast_year)), 5) AS cumulative_multiplier FROM {_LINK_YEARS}""")  # fmt: skip
_register("composite_backtest", _backtest, "cutoff method matched_parts eligible_basket_weight:6 actual_gap_days:4 stale_parts_excluded extreme_weight_share:6 actual_multiplier:5 predicted_multiplier:4 absolute_log_error:4")
_register("bootstrap_bands", _bands, "forecast_year lower:4 median:4 upper:4")


def _part_bands(spark, d):
    """Bands of every part a year ahead, parts weighted by all they cost."""
    daily = _written_daily(spark, d)
    weights = daily.groupBy("part_key").agg(F.max_by("approved_category", "po_date").alias("approved_category"), F.sum("spend").alias("weight"))
    return backtest.bootstrap_parts(_flagged(daily), weights, BASE, date(BASE.year + 1, 12, 31), Controls())


_register("part_bands", _part_bands, "level key lower:4 median:4 upper:4 runs")
_register("penalty_search", lambda s, d: backtest.penalty_search(_pairs(s, d), Controls()), "candidate lambda_smooth lambda_gamma mean_wape:4 n_cutoffs selected")
_register("part_backtest", lambda s, d: backtest.part_backtest_summary(backtest.part_backtest(_written_daily(s, d), Controls(), None, True)),
          "model horizon_months n wape:4 wape_quantity_conditional:4 wale:4 mdape:4 directional_accuracy:4 interval_coverage:4 composite_error:4")
_register("bridged_prices", _bridged, "part_key latest_date latest_price:4 estimated_base_price:4 price_staleness_days q_star:4 q_future:4 composite_weight:6 source")
_register("purchasing_cost", _purchasing, "cost_base:2 cost_target:2 purchasing_cost_change:6 fixed_basket_change:6")
_register("heaviest_parts", lambda s, d: bridge.heaviest(_daily(s, d).groupBy("part_key").agg(F.sum("spend").alias("weight")), 0.995, 50), "part_key weight:8",
          sql="SELECT part_key, round(w / sum(w) OVER (), 8) AS weight FROM (SELECT part_key, w, sum(w) OVER (ORDER BY w DESC, part_key ROWS UNBOUNDED PRECEDING) / sum(w) OVER () AS run FROM (SELECT part_key, sum(spend) AS w FROM daily GROUP BY 1)) t WHERE run <= 0.995")
_register("recent_quarter_change", lambda s, d: bridge.recent_change(indices.tornqvist(_panel(s, d, "Q")), "pct_change"), "mean_change:6 n annual_log:6",
          sql="SELECT round(avg(c), 6) AS mean_change, count(*) AS n, round(ln(1 + avg(c)) * 4, 6) AS annual_log FROM (SELECT exp(g) - 1 AS c FROM torn_q WHERE g IS NOT NULL ORDER BY period_start DESC LIMIT 4) t")


def _gaps(spark, d):
    """The quarterly panel without the quantities of each first quarter of a calendar year."""
    return indices.fisher(_panel(spark, d, "Q").withColumn("qty", F.when(F.month("period_start") != 1, F.col("qty"))))


_register("fisher_gaps", _gaps, "period_start period_end match_count laspeyres:6 paasche:6 log_change:6 index_level:5 status reason")
_GAPS_SQL = """
  SELECT s.period_start, s.period_end, coalesce(n, 0) AS match_count, round(l, 6) AS laspeyres, round(p, 6) AS paasche, round(ln(l * p) / 2, 6) AS log_change,
    round(exp(sum(coalesce(ln(l * p) / 2, 0)) OVER (ORDER BY s.period_start)), 5) AS index_level, CASE WHEN l > 0 THEN 'ok' ELSE 'unavailable' END AS status,
    CASE WHEN l > 0 THEN NULL WHEN coalesce(linked, 0) = 0 THEN 'no part in this period and the one before' ELSE 'insufficient valid quantities' END AS reason
  FROM (SELECT DISTINCT period_start, period_end FROM panel_q WHERE period_ordinal > (SELECT min(period_ordinal) FROM panel_q)) s
  LEFT JOIN (SELECT period_start, count(*) AS linked FROM links_q GROUP BY 1) k ON k.period_start = s.period_start
  LEFT JOIN (SELECT period_start, count(*) AS n, sum(price * qty_0) / sum(price_0 * qty_0) AS l, sum(price * qty) / sum(price_0 * qty) AS p
    FROM links_q WHERE qty > 0 AND qty_0 > 0 GROUP BY 1) t ON t.period_start = s.period_start"""
_SQL["fisher_gaps"] = S.changed(S.statement(_GAPS_SQL), panel_q=f"SELECT * REPLACE (CASE WHEN month(period_start) <> 1 THEN qty END AS qty) FROM ({S.part('panel_q')}) whole")
_register("historical_index", lambda s, d: bridge.historical_index(_written_daily(s, d)), "period_start frequency tornqvist_index:5 tornqvist_change:6 status match_count matched_spend:2 capped_spend_change:6 fisher_index:5",
          sql=" UNION ALL ".join(f"""
  SELECT t.period_start, '{f.upper()}' AS frequency, round(exp(sum(g) OVER (ORDER BY t.period_start)), 5) AS tornqvist_index, round(exp(g) - 1, 6) AS tornqvist_change, 'ok' AS status, m.match_count,
    round(matched_spend, 2) AS matched_spend, round(capped_spend_change, 6) AS capped_spend_change, round(fisher_index, 5) AS fisher_index
  FROM torn_{f} t JOIN mchg_{f} m ON m.period_start = t.period_start LEFT JOIN fish_{f} i ON i.period_start = t.period_start""" for f in ("m", "q", "fy")))  # fmt: skip
#: Scopes of the sensitivity grid: the lines that count, as a column and as SQL.
_SCOPES = {
    "direct_costs": ("in_direct_costs", "in_direct_costs"),
    "inventory_only": ("included_for_pricing and direct_category = 'Inventory'", "included_for_pricing AND direct_category = 'Inventory'"),
    "physical_plus_review": ("included_for_pricing and decision in ('Include', 'Needs Review')", "included_for_pricing AND decision IN ('Include', 'Needs Review')"),
    "all_po_lines": ("included_for_pricing", "included_for_pricing"),
}


def _scope_sensitivity(spark, d):
    wanted = F.array_compact(F.array(*(F.when(F.expr(f"coalesce({on}, false)"), F.lit(k)) for k, (on, _) in _SCOPES.items())))
    rows = _classified(spark, d).withColumn("scope", F.explode(wanted)).withColumn("in_direct_costs", F.lit(True))
    daily = staged(panel.realized_daily(rows.withColumn("part_key", F.struct("scope", "part_key"))).select(*_DAY), "scope-days")
    one = lambda k: daily.where(F.col("part_key.scope") == k).withColumn("part_key", F.col("part_key.part_key"))
    return bridge.scope_sensitivity({k: one(k) for k in _SCOPES})


def _scope_sql(scope: str, rows: str) -> str:
    grid = " UNION ALL ".join(f"""
  SELECT '{scope}' AS scope, '{f.upper()}' AS frequency, 'ok' AS status, count(*) AS part_days, count(DISTINCT part_key) AS distinct_parts,
    (SELECT round(capped_spend_change, 6) FROM mchg_{f} ORDER BY period_start DESC LIMIT 1) AS latest_matched_change, (SELECT round(exp(g) - 1, 6) FROM torn_{f} WHERE g IS NOT NULL ORDER BY period_start DESC LIMIT 1) AS latest_tornqvist,
    (SELECT match_count FROM mchg_{f} ORDER BY period_start DESC LIMIT 1) AS match_count, (SELECT round(matched_spend, 2) FROM mchg_{f} ORDER BY period_start DESC LIMIT 1) AS matched_spend, round(sum(spend), 2) AS total_spend FROM daily""" for f in ("m", "q", "fy"))
    realized = f"SELECT * FROM classified WHERE {rows} AND realized_price > 0 AND qty_received > 0 AND part_key IS NOT NULL AND effective_date IS NOT NULL"
    return S.changed(S.statement(grid), realized=realized)


_register("scope_sensitivity", _scope_sensitivity, "scope frequency status part_days distinct_parts latest_matched_change:6 latest_tornqvist:6 match_count matched_spend:2 total_spend:2")
_SQL["scope_sensitivity"] = " UNION ALL ".join(f"SELECT * FROM ({_scope_sql(k, on)}) s_{k}" for k, (_, on) in _SCOPES.items())
_register("extremes_sensitivity", lambda s, d: _extremes(s, d), "variant status n_rows latest_matched_change:6 latest_tornqvist:6 extreme_pairs")
_VARIANT_SQL = """
  SELECT '{}' AS variant, 'ok' AS status, count(*) AS n_rows, (SELECT round(capped_spend_change, 6) FROM mchg_q ORDER BY period_start DESC LIMIT 1) AS latest_matched_change,
    (SELECT round(exp(g) - 1, 6) FROM torn_q WHERE g IS NOT NULL ORDER BY period_start DESC LIMIT 1) AS latest_tornqvist, (SELECT count(*) FROM flagged WHERE extreme_flag) AS extreme_pairs FROM panel_q"""
_SQL["extremes_sensitivity"] = (
    f"SELECT * FROM ({S.statement(_VARIANT_SQL.format('with_extremes'))}) a UNION ALL SELECT * FROM ("
    + S.changed(S.statement(_VARIANT_SQL.format("without_extremes")), panel_q=S.part("panel_q") + " WHERE part_key NOT IN (SELECT part_key FROM flagged WHERE extreme_flag)")
    + ") b"
)


def _extremes(spark, d):
    daily = _written_daily(spark, d)
    return bridge.extremes_sensitivity(daily, _flagged(daily))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
