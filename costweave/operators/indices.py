"""Price indices: chained period links and matched-basket comparisons of date windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costweave.functions import columns as C
from costweave.operators.panel import window_values
from costweave.operators.quantiles import percentiles
from costweave.plans.stages import staged


def links(panel: DataFrame) -> DataFrame:
    """Each part's price and quantity with those of the period just before; skipped periods make no link."""
    before = F.lag(F.struct("period_ordinal", "price", "qty", "spend")).over(Window.partitionBy("part_key").orderBy("period_ordinal"))
    rows = panel.withColumn("p", before)
    near = rows.where((F.col("period_ordinal") - F.col("p.period_ordinal") == 1) & (F.col("price") > 0) & (F.col("p.price") > 0))
    return near.select(
        "part_key", "period_start", "period_end", "price", "qty", "spend", F.col("p.price").alias("price_0"), F.col("p.qty").alias("qty_0"), F.col("p.spend").alias("spend_0"),
        F.ln(F.col("price") / F.col("p.price")).alias("r"),
    )


def matched_changes(panel: DataFrame, low: float = 0.01, high: float = 0.99, cap_at: float = 0.95, linked: DataFrame | None = None) -> DataFrame:
    """Matched-part changes of each period: plain, winsorised and capped-spend-weighted means, coverage.

    ``linked`` is :func:`links` of the panel where that is a written table already; it is read four times.
    """
    nn = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0))
    rows = (links(panel) if linked is None else linked).withColumn("w0", F.sqrt(nn("spend") * nn("spend_0")))
    r, w0 = F.col("r"), F.col("w0")
    order = percentiles(rows, ["period_start"], {"q_low": (r, low), "q_high": (r, high), "m": (r, 0.5), "cap0": (w0, cap_at)})
    by = rows.groupBy("period_start").agg(F.sum("w0").alias("w_sum")).join(order, "period_start")
    rows = rows.join(staged(by, "period-sums"), "period_start")
    plain = F.col("w_sum") <= 0
    rows = rows.withColumn("w", F.when(plain, 1.0).otherwise(F.least("w0", "cap0"))).withColumn("rw", C.clip(r, F.col("q_low"), F.col("q_high")))
    total = panel.groupBy("period_start").agg(F.sum("spend").alias("total_spend"))
    out = rows.groupBy("period_start").agg(
        F.first("period_end").alias("period_end"), F.count(F.lit(1)).alias("match_count"), F.sum("w0").alias("matched_spend"), F.sum(F.coalesce("spend", F.lit(0.0))).alias("current_matched_spend"),
        F.first("m").alias("m"), F.avg("r").alias("a"), F.avg("rw").alias("aw"), (F.sum(F.col("w") * F.col("rw")) / F.sum("w")).alias("sw"),
        F.first("q_low").alias("winsor_low"), F.first("q_high").alias("winsor_high"),
    ).join(total, "period_start")
    return out.select(
        "period_start", "period_end", "match_count", "matched_spend", "current_matched_spend", "total_spend",
        F.when(F.col("total_spend") > 0, F.col("current_matched_spend") / F.col("total_spend")).alias("coverage"), F.expm1("m").alias("median_change"), F.expm1("a").alias("equal_change"),
        F.expm1("aw").alias("winsor_equal_change"), F.expm1("sw").alias("capped_spend_change"), "winsor_low", "winsor_high",
    )


def _chained(by_period: DataFrame, change: Column) -> DataFrame:
    """Running product of the links; a period without one keeps the level. One row a period passes the window."""
    upto = Window.orderBy("period_start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return by_period.withColumn("log_change", change).withColumn("index_level", F.exp(F.sum(F.coalesce("log_change", F.lit(0.0))).over(upto))).withColumn("pct_change", F.expm1("log_change"))


def tornqvist(panel: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """Chained Törnqvist index: mean shares of the two periods, by price times quantity or by spend where that is 0."""
    rows = (links(panel) if linked is None else linked).withColumns({"v": F.col("price") * F.col("qty"), "v_0": F.col("price_0") * F.col("qty_0")})
    sums = rows.groupBy("period_start").agg(F.sum("v").alias("v_all"), F.sum("v_0").alias("v_0_all"), F.sum("spend").alias("spend_all"), F.sum("spend_0").alias("spend_0_all"))
    rows = rows.join(staged(sums, "period-sums"), "period_start")
    share = lambda v, s: F.when(F.col(f"{v}_all") > 0, F.col(v) / F.col(f"{v}_all")).when(F.col(f"{s}_all") > 0, F.col(s) / F.col(f"{s}_all"))
    mean = (share("v", "spend") + share("v_0", "spend_0")) / 2
    total = panel.groupBy("period_start").agg(F.sum("spend").alias("total_spend"))
    by = rows.groupBy("period_start").agg(F.first("period_end").alias("period_end"), F.count(F.lit(1)).alias("match_count"), F.sum(mean * F.col("r")).alias("g"), F.first("v_all").alias("matched_value"))
    by = by.join(total, "period_start").withColumn("coverage", F.when(F.col("total_spend") > 0, F.col("matched_value") / F.col("total_spend")))
    out = _chained(by, F.col("g")).withColumn("status", F.when(F.col("g").isNull(), "unavailable").otherwise("ok"))
    return out.select("period_start", "period_end", "match_count", "log_change", "pct_change", "index_level", "coverage", "status")


def fisher(panel: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """Chained Fisher index over parts with quantities in both periods.

    Every period of the panel but its first has a row. One without such parts is ``unavailable``, says why, and keeps the
    level of the chain; counts, links and the spine of periods come from one aggregation each, so no period gets lost in a join.
    """
    with_qty = (F.col("qty") > 0) & (F.col("qty_0") > 0)
    cross = lambda p, q: F.sum(F.when(with_qty, F.col(p) * F.col(q)))
    by = (links(panel) if linked is None else linked).groupBy("period_start").agg(
        F.count(F.lit(1)).alias("linked"), F.count_if(with_qty).alias("match_count"),
        F.try_divide(cross("price", "qty_0"), cross("price_0", "qty_0")).alias("laspeyres"), F.try_divide(cross("price", "qty"), cross("price_0", "qty")).alias("paasche"),
    )
    spine = panel.groupBy("period_start").agg(F.first("period_end").alias("period_end"), F.min("period_ordinal").alias("ordinal"))
    first = panel.agg(F.min("period_ordinal").alias("first_ordinal"))
    rows = spine.join(F.broadcast(first)).where("ordinal > first_ordinal").join(by, "period_start", "left").withColumn("match_count", F.coalesce("match_count", F.lit(0)))
    usable = (F.col("laspeyres") > 0) & (F.col("paasche") > 0)
    out = _chained(rows, F.when(usable, F.ln(F.col("laspeyres") * F.col("paasche")) / 2))
    reason = F.when(usable, None).when(F.coalesce("linked", F.lit(0)) == 0, "no part in this period and the one before").when(F.col("match_count") == 0, "insufficient valid quantities").otherwise("nonpositive index")
    out = out.withColumns({"status": F.when(usable, "ok").otherwise("unavailable"), "reason": reason.cast("string")})
    return out.select("period_start", "period_end", "match_count", "laspeyres", "paasche", "log_change", "pct_change", "index_level", "status", "reason")


def all_benchmarks(daily: DataFrame, start_month: int = 10) -> dict[str, DataFrame]:
    """Prices, matched changes, Törnqvist and Fisher by month, quarter and fiscal year. A frequency's prices and links are written once."""
    from costweave.operators.panel import part_period

    out = {}
    for freq in ("M", "Q", "FY"):
        panel = staged(part_period(daily, freq, start_month), "prices")
        linked = staged(links(panel), "links")
        out |= {f"prices_{freq}": panel, f"matched_{freq}": matched_changes(panel, linked=linked), f"tornqvist_{freq}": tornqvist(panel, linked), f"fisher_{freq}": fisher(panel, linked)}
    return out


#: Modal texts of a part in a window, which only lists of parts show.
_TEXTS = ("description_norm", "hist_category", "description_1")


def matched_parts(values: DataFrame, comparisons: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Parts bought in both windows of each comparison: values of both sides, log relative, spends and their root product.

    ``values`` is :func:`window_values`, ``comparisons`` has ``comparison, a, b`` (window labels). A part's windows
    are paired by one aggregation over its comparisons. Dispersion and texts may be missing from ``values``.
    """
    keys = [*(by or []), "comparison"]
    ends = F.array(*(F.struct(F.col(s).alias("label"), F.lit(s).alias("side")) for s in ("a", "b")))
    sides = staged(comparisons.select("comparison", F.inline(ends)), "sides")
    rows = values.where("line_count > 0").join(sides, "label")
    a, b = F.col("side") == "a", F.col("side") == "b"
    pick = lambda c, on: F.max(F.when(on, F.col(c)))
    m = rows.groupBy(*keys, "part_key").agg(
        *(pick(c, on).alias(f"{c}_{s}") for s, on in (("a", a), ("b", b)) for c in ("price", "spend", "qty", "line_count", "price_dispersion") if c in values.columns),
        *(pick(c, b).alias(c) for c in _TEXTS if c in values.columns),
    )
    m = m.where(F.col("price_a").isNotNull() & F.col("price_b").isNotNull()).withColumn("r", F.ln(F.col("price_b") / F.col("price_a")))
    m = m.withColumns({"va": F.greatest("spend_a", F.lit(0.0)), "vb": F.greatest("spend_b", F.lit(0.0))}).withColumn("h", F.sqrt(F.col("va") * F.col("vb")))
    similar = F.try_divide(F.col("qty_b"), F.nullif(F.col("qty_a"), F.lit(0.0)))
    comparable = (F.col("qty_a") > 0) & (F.col("qty_b") > 0) & similar.between(0.5, 2.0)
    return m.withColumns({"qty_comparable": F.coalesce(comparable, F.lit(False)), "no_price_change": F.abs("r") < 1e-12})


def weighted_basket(
    matched: DataFrame, values: DataFrame, comparisons: DataFrame, by: list[str] | None = None, low: float = 0.01, high: float = 0.99, cap_at: float = 0.95
) -> DataFrame:
    """:func:`matched_parts` of ``values`` with shares, capped weights, winsorised relatives and coverage.

    Both are read several times and should be written tables; ``matched`` has one row a part and comparison.
    """
    scope_spend = values.groupBy(*(by or []), "label").agg(F.sum("scope_spend").alias("scope_spend"))
    keys = [*(by or []), "comparison"]
    r = F.col("r")
    order = percentiles(matched, keys, {"winsor_low": (r, low), "winsor_high": (r, high), "h_cap": (F.col("h"), cap_at)})
    sums = matched.groupBy(*keys).agg(F.sum("va").alias("sa"), F.sum("vb").alias("sb"))
    m = matched.join(staged(order.join(sums, keys), "basket-quantiles"), keys)
    m = m.withColumns(
        {
            "r_w": C.clip(r, F.col("winsor_low"), F.col("winsor_high")), "is_outlier": (r < F.col("winsor_low")) | (r > F.col("winsor_high")),
            "s_bar": (C.ratio(F.col("va"), F.col("sa")) + C.ratio(F.col("vb"), F.col("sb"))) / 2, "h_capped": F.least("h", "h_cap"),
        }
    )
    m = m.join(percentiles(m, keys, {"weight_cap": (F.col("s_bar"), cap_at)}), keys).withColumn("s_capped", F.least("s_bar", "weight_cap"))
    capped = m.groupBy(*keys).agg(F.sum("s_capped").alias("s_sum"), F.sum("h_capped").alias("h_sum"))  # a row a basket, as the scopes' spends
    scope = lambda s: scope_spend.join(comparisons, F.col("label") == F.col(s)).select(*keys, F.col("scope_spend").alias(f"scope_{s}"))
    m = m.join(staged(capped.join(scope("a"), keys, "left").join(scope("b"), keys, "left"), "basket-sums"), keys)
    return m.select(
        *keys, "part_key", *(c for c in _TEXTS if c in m.columns), "price_a", "price_b", "spend_a", "spend_b", "qty_a", "qty_b", "line_count_a", "line_count_b", "r", "r_w", "is_outlier",
        "winsor_low", "winsor_high", "s_bar", "weight_cap", C.ratio(F.col("s_capped"), F.col("s_sum")).alias("s_tilde"), C.ratio(F.col("h_capped"), F.col("h_sum")).alias("h_tilde"),
        "qty_comparable", "no_price_change", C.ratio(F.col("sa"), F.col("scope_a")).alias("coverage_a"), C.ratio(F.col("sb"), F.col("scope_b")).alias("coverage_b"),
    )


def matched_basket(
    scoped: DataFrame, windows: DataFrame, comparisons: DataFrame, by: list[str] | None = None, low: float = 0.01, high: float = 0.99, cap_at: float = 0.95
) -> DataFrame:
    """All steps in one plan, for small inputs; larger ones write ``values`` and the matched parts in between."""
    values = window_values(scoped, windows, by)
    return weighted_basket(matched_parts(values, comparisons, by), values, comparisons, by, low, high, cap_at)


def index_variants(matched: DataFrame, by: list[str] | None = None, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """The headline (winsorised, capped Törnqvist) and six other means of each matched basket.

    ``matched`` comes from :func:`weighted_basket`; it is read four times and should be a written table.
    """
    keys = [*(by or []), "comparison"]
    r = F.col("r")
    alike = F.when(F.col("qty_comparable"), r)
    order = percentiles(matched, keys, {"m": (r, 0.5), "p25": (r, 0.25), "p75": (r, 0.75), "like_low": (alike, low), "like_high": (alike, high)})
    rows = matched.join(order, keys)
    dot = lambda w, x: F.expm1(F.sum(F.coalesce(F.col(w) * F.col(x), F.lit(0.0))))
    first = lambda c: F.first(c).alias(c)
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("matched_parts"), F.expm1(F.first("m")).alias("median_change"), F.expm1(F.first("p25")).alias("p25_change"), F.expm1(F.first("p75")).alias("p75_change"),
        F.avg(F.col("no_price_change").cast("double")).alias("share_unchanged"), F.sum(F.greatest("spend_a", F.lit(0.0))).alias("matched_spend_a"), F.sum(F.greatest("spend_b", F.lit(0.0))).alias("matched_spend_b"),
        *(first(c) for c in ("coverage_a", "coverage_b", "winsor_low", "winsor_high", "weight_cap")),
        dot("s_bar", "r").alias("raw_tornqvist"), dot("s_bar", "r_w").alias("winsor_tornqvist"), dot("s_tilde", "r_w").alias("headline"), dot("h_tilde", "r_w").alias("capped_geometric_spend"),
        F.expm1(F.avg("r_w")).alias("equal_winsor"), F.expm1(F.avg("r")).alias("equal_raw"),
        F.avg(C.clip(alike, F.col("like_low"), F.col("like_high"))).alias("similar"), F.count_if("qty_comparable").alias("similar_parts"),
    )
    return out.withColumn("similar_quantity", F.when(F.col("similar_parts") >= 2, F.expm1("similar"))).drop("similar")


METHODS = ("headline", "raw_tornqvist", "winsor_tornqvist", "capped_geometric_spend", "equal_winsor", "equal_raw", "similar_quantity")


def method_sensitivity(variants: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row a comparison and method."""
    return variants.unpivot([*(by or []), "comparison"], list(METHODS), "method", "change")


def chain(changes: DataFrame, by: list[str], change: str = "headline") -> DataFrame:
    """Product of consecutive changes less one, and its yearly geometric mean."""
    log_sum = F.sum(F.ln(1 + F.col(change)))
    return changes.groupBy(*by).agg(F.count(change).alias("n_links"), F.expm1(log_sum).alias("cumulative"), F.expm1(log_sum / F.count(change)).alias("annualised"))


def reliability(variants: DataFrame, min_matches: int = 100, min_coverage: float = 0.20) -> DataFrame:
    """Low reliability: few matches or little of the spend covered."""
    low = (F.col("matched_parts") < min_matches) | (F.coalesce("coverage_a", F.lit(0.0)) < min_coverage) | (F.coalesce("coverage_b", F.lit(0.0)) < min_coverage)
    return variants.withColumn("low_reliability", low)
