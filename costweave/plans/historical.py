"""The historical workflow: window comparisons of every scope, sensitivities, chains and the joint Huber grid."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costweave.config import Controls
from costweave.operators import classify, indices, pairs, panel, quality, regression, windows
from costweave.operators.clean import clean_lines, flag_duplicates
from costweave.plans.stages import staged

SCOPES = ("inventory_only", "physical_inputs", "all_po_lines")


def _compared(lines: DataFrame, window_table: DataFrame, comparison_table: DataFrame, by: str, c: Controls) -> DataFrame:
    """The weighted baskets of all comparisons and values of ``by``, written in steps."""
    values = staged(panel.window_values(lines, window_table, [by]), "window-values")
    matched = staged(indices.matched_parts(values, comparison_table, [by]), "matched-parts")
    limits = (c.historical_winsor_lower, c.historical_winsor_upper, c.historical_weight_cap_quantile)
    return staged(indices.weighted_basket(matched, values, comparison_table, [by], *limits), "matched")


def historical_tables(lines: DataFrame, controls: Controls | None = None, until: date | None = None, first_fy: int | None = None, mapping: DataFrame | None = None) -> tuple[dict[str, DataFrame], dict]:
    """All tables of the historical workflow and its summary.

    ``until`` (the last order date by default) ends the years to date; complete fiscal years are compared from
    ``first_fy`` (that of the first order date by default) on.
    """
    c = controls or Controls()
    spark, start = lines.sparkSession, c.fiscal_year_start_month
    cleaned = flag_duplicates(clean_lines(lines, c), c.deduplication_mode)
    h = staged(classify.historical_scopes(cleaned, mapping, c), "historical-lines")
    ends = h.where(F.col("po_date").isNotNull()).agg(F.min("po_date"), F.max("po_date")).first()
    if ends[0] is None and (until is None or first_fy is None):
        raise ValueError("no line has an order date")
    until = until or ends[1]
    first_fy = first_fy or ends[0].year + (start > 1 and ends[0].month >= start)
    window_rows, comparison_rows = windows.comparisons(first_fy, until, start)
    w, p = windows.as_tables(spark, window_rows, comparison_rows)
    flags = F.array(*(F.when(F.col(f"in_{s}"), F.lit(s)) for s in SCOPES))
    matched = _compared(h.withColumn("scope", F.explode(F.array_compact(flags))), w, p, "scope", c)
    variants = staged(indices.reliability(indices.index_variants(matched, ["scope"], c.historical_winsor_lower, c.historical_winsor_upper)), "variants")
    by_category = _compared(h.where("in_physical_inputs").withColumn("category", F.col("hist_category")), w, p, "category", c)
    grid = regression.joint_huber(staged(pairs.adjacent_pairs(panel.physical_daily(h), c.historical_min_pair_gap_days), "pairs"))
    tables = {
        "comparisons": variants, "matched_parts": matched, "method_sensitivity": indices.method_sensitivity(variants, ["scope"]),
        "chained": indices.chain(variants.where(~F.col("comparison").contains("YTD")), ["scope"]),
        "category_comparisons": indices.reliability(indices.index_variants(by_category, ["category"], c.historical_winsor_lower, c.historical_winsor_upper)),
        "scope_disclosure": quality.scope_disclosure(h), "spend_reconciliation": quality.spend_reconciliation(h), "basis_histogram": quality.basis_histogram(h), "huber_grid": grid,
    }
    return tables, {"until": until, "windows": window_rows, "comparisons": comparison_rows, "scopes": SCOPES, "controls": vars(c)}


def _percent(value: float | None) -> str:
    return "n/a" if value is None else f"{100 * value:+.2f} %"


def markdown(tables: dict[str, DataFrame], summary: dict) -> str:
    """The findings as Markdown: windows, changes of every scope by comparison, spread of the methods, chains. One row a scope and comparison is read."""

    def section(title: str, name: str, keys: list[str]) -> list[str]:
        df = tables[name]
        by = [k for k in keys if k in df.columns]
        numbers = [f.name for f in df.schema.fields if f.name not in by and f.dataType.typeName() in ("double", "long", "integer", "boolean", "string")]
        lines = ["", f"## {title}", "", "| " + " | ".join([*by, *numbers]) + " |", "|" + "---|" * (len(by) + len(numbers))]
        for r in df.select(*by, *numbers).orderBy(*by).toLocalIterator():
            shown = [_percent(r[c]) if isinstance(r[c], float) and ("change" in c or "rate" in c or "share" in c) else "" if r[c] is None else f"{r[c]:,.4g}" if isinstance(r[c], float) else str(r[c]) for c in numbers]
            lines.append("| " + " | ".join(v.replace("|", "\\|") for v in [*(str(r[c]) for c in by), *shown]) + " |")
        return lines

    out = ["# Prices of past purchases", "", f"Orders up to {summary['until']}.", "", "| window | from | to |", "|---|---|---|", *(f"| {n} | {a} | {b} |" for n, a, b in summary["windows"])]
    keys = ["scope", "category", "comparison"]
    for title, name in (("Comparisons", "comparisons"), ("Methods", "method_sensitivity"), ("Chained", "chained"), ("Categories", "category_comparisons"), ("Scopes by description", "scope_disclosure"), ("Value against price times quantity", "spend_reconciliation")):
        out += section(title, name, ["description_norm", "fiscal_year"] if name in ("scope_disclosure", "spend_reconciliation") else keys)
    return "\n".join(out) + "\n"
