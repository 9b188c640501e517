"""ANSI SQL of the registered price queries, for a second engine on the same tables."""

from __future__ import annotations

BASE = "2000-12-31"
#: Date windows and comparisons of the historical queries.
WINDOWS = {
    "FY1998": ("1997-10-01", "1998-09-30"),
    "FY1999": ("1998-10-01", "1999-09-30"),
    "FY2000": ("1999-10-01", "2000-09-30"),
    "FY2000 YTD": ("1999-10-01", "2000-06-30"),
    "FY2001 YTD": ("2000-10-01", "2001-06-30"),
}
COMPARISONS = {"FY1998-FY1999": ("FY1998", "FY1999"), "FY1999-FY2000": ("FY1999", "FY2000"), "FY2000YTD-FY2001YTD": ("FY2000 YTD", "FY2001 YTD")}

_PARTS: dict[str, str] = {}

_PARTS["po_lines"] = """
  SELECT CAST(o_orderdate AS DATE) AS po_date, CAST(l_partkey AS VARCHAR) AS part_number, p_name AS description_1, p_brand AS description_2,
    (l_extendedprice / l_quantity) * CASE WHEN l_linenumber = 7 THEN 100.0 ELSE 1.0 END AS cost, l_quantity AS qty_ordered, qr AS qty_received,
    l_extendedprice * qr / l_quantity AS extension_received, l_extendedprice AS po_value, p_type AS bucket,
    CASE p_type WHEN 'ECONOMY' THEN 'Inventory' WHEN 'LARGE' THEN 'COST OF SALES - OUTSIDE SERVICES' WHEN 'MEDIUM' THEN 'Production Supplies'
      WHEN 'SMALL' THEN 'Small Tools' WHEN 'STANDARD' THEN 'Operating Supplies' WHEN 'PROMO' THEN 'Office Supplies' END AS description,
    'FY' || CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE 0 END AS VARCHAR) AS source_file,
    CAST(l_orderkey * 10000 + l_linenumber * 100 + nth AS BIGINT) AS source_row_number
  FROM (SELECT *, CASE WHEN l_linestatus = 'F' THEN l_quantity WHEN l_returnflag = 'A' THEN floor(l_quantity / 2) ELSE 0.0 END AS qr,
          row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS nth
        FROM lineitem) l JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey"""

_PARTS["clean_0"] = """
  SELECT *, upper(trim(part_number)) AS part_key, po_date AS effective_date, po_value / nullif(qty_ordered, 0) AS ordered_price,
    extension_received / nullif(qty_received, 0) AS received_price, coalesce(qty_received, 0) > 0 AS has_received
  FROM po_lines"""
_PARTS["clean_1"] = """
  SELECT *,
    CASE WHEN has_received AND received_price > 0 THEN received_price WHEN has_received AND cost > 0 THEN cost END AS realized_price,
    CASE WHEN has_received AND received_price > 0 THEN 'received_extension_div_qty' WHEN has_received AND cost > 0 THEN 'cost_fallback' ELSE 'unavailable' END AS realized_price_source,
    CASE WHEN qty_ordered > 0 AND ordered_price > 0 THEN ordered_price WHEN cost > 0 THEN cost END AS committed_price,
    CASE WHEN qty_ordered > 0 AND ordered_price > 0 THEN 'po_value_div_qty' WHEN cost > 0 THEN 'cost_fallback' ELSE 'unavailable' END AS committed_price_source,
    CASE WHEN has_received THEN qty_received ELSE qty_ordered END AS qty, cost * qty_ordered AS ordered_value_at_cost, cost * qty_received AS received_value_at_cost,
    greatest(coalesce(qty_ordered, 0) - coalesce(qty_received, 0), 0) AS remaining_open_qty
  FROM clean_0"""
_PARTS["clean_2"] = """
  SELECT *, po_value / nullif(ordered_value_at_cost, 0) AS po_ratio, extension_received / nullif(received_value_at_cost, 0) AS received_ratio,
    coalesce(abs(po_value - ordered_value_at_cost) <= 0.01 + 1e-4 * abs(ordered_value_at_cost), false) AS po_value_matches_ordered,
    coalesce(abs(po_value - received_value_at_cost) <= 0.01 + 1e-4 * abs(received_value_at_cost), false) AS po_value_matches_received,
    NOT has_received AND qty_ordered > 0 AND coalesce(committed_price, 0) > 0 AS is_open_order, has_received AND qty_ordered > qty_received AS is_partially_received,
    remaining_open_qty > 0 AND coalesce(committed_price, 0) > 0 AS has_open_commitment,
    CASE WHEN has_received AND received_price > 0 THEN greatest(extension_received, 0) WHEN has_received THEN realized_price * qty_received ELSE 0.0 END AS realized_spend,
    remaining_open_qty * committed_price AS remaining_open_spend, realized_price AS price,
    upper(coalesce(description, '')) AS dn,
    count(*) OVER (PARTITION BY po_date, part_key, cost, qty_ordered, qty_received, po_value, bucket, description, description_1, description_2) AS duplicate_count
  FROM clean_1"""
_PARTS["clean"] = """
  SELECT *,
    CASE WHEN po_ratio > 0 AND abs(po_ratio / pow(10.0, greatest(-3, least(3, round(log10(po_ratio))))) - 1) <= 0.03 THEN pow(10.0, greatest(-3, least(3, round(log10(po_ratio))))) END AS po_basis_factor,
    CASE WHEN part_key IS NULL THEN 'missing_part_key' WHEN po_date IS NULL THEN 'invalid_or_missing_date' WHEN NOT coalesce(price > 0, false) THEN 'invalid_price'
      WHEN is_open_order THEN 'open_order_excluded' ELSE '' END AS exclusion_reason,
    coalesce(price > 0, false) AND part_key IS NOT NULL AND po_date IS NOT NULL AND NOT is_open_order AS included_for_pricing
  FROM clean_2"""
_PARTS["classified"] = """
  SELECT *, direct_category IS NOT NULL AS in_direct_costs,
    CASE WHEN direct_category IS NOT NULL THEN 'Include' ELSE 'Needs Review' END AS decision
  FROM (SELECT *, CASE WHEN dn LIKE 'COST OF SALES%' THEN 'COS' WHEN dn = 'INVENTORY' THEN 'Inventory' WHEN dn = 'OPERATING SUPPLIES' THEN 'Operating Supplies'
      WHEN dn = 'PRODUCTION SUPPLIES' THEN 'Production Supplies' WHEN dn = 'PRODUCTION AIDS' THEN 'Production Aids' WHEN dn IN ('SMALL TOOLS', 'SMALL TOOLING') THEN 'Small Tooling' END AS direct_category
    FROM clean) t"""
_PARTS["realized"] = "SELECT * FROM classified WHERE in_direct_costs AND realized_price > 0 AND qty_received > 0 AND part_key IS NOT NULL AND effective_date IS NOT NULL"
_PARTS["daily_0"] = """
  SELECT part_key, effective_date AS po_date, sum(CASE WHEN qty_received > 0 AND realized_price > 0 THEN qty_received ELSE 0 END) AS q0,
    sum(CASE WHEN qty_received > 0 AND realized_price > 0 THEN realized_price * qty_received ELSE 0 END) AS pq,
    sum(CASE WHEN realized_spend > 0 THEN realized_spend ELSE realized_price * qty_received END) AS spend, count(*) AS line_count, min(realized_price) AS price_min,
    max(realized_price) AS price_max, avg(realized_price) AS price_mean, stddev_samp(realized_price) AS price_std, median(realized_price) AS price_median,
    bool_or(is_open_order) AS is_open_order_any, first(direct_category ORDER BY source_file, source_row_number) AS approved_category
  FROM realized GROUP BY 1, 2"""
_PARTS["daily"] = """
  SELECT *, CASE WHEN q0 > 0 THEN pq / q0 ELSE price_median END AS price, CASE WHEN q0 > 0 THEN q0 END AS qty,
    CASE WHEN price_mean > 0 AND price_std IS NOT NULL THEN price_std / price_mean ELSE 0 END AS price_cv
  FROM daily_0 WHERE (CASE WHEN q0 > 0 THEN pq / q0 ELSE price_median END) > 0"""
_PARTS["pairs_0"] = """
  SELECT part_key, approved_category, po_date AS date_b, price AS price_b, qty AS qty_b, spend AS spend_b, lag(po_date) OVER w AS date_a, lag(price) OVER w AS price_a,
    lag(qty) OVER w AS qty_a, lag(spend) OVER w AS spend_a FROM daily WINDOW w AS (PARTITION BY part_key ORDER BY po_date)"""
_PARTS["pairs_all"] = """
  SELECT *, ln(price_b / price_a) AS y, coalesce(qty_a > 0 AND qty_b > 0, false) AS qty_comparable, CASE WHEN qty_a > 0 AND qty_b > 0 THEN ln(qty_b / qty_a) ELSE 0 END AS x_q,
    CAST(date_diff('day', date_a, date_b) AS BIGINT) AS delta_days, date_diff('day', date_a, date_b) / 365.25 AS delta_years, price_b / price_a AS price_ratio,
    count(*) OVER (PARTITION BY part_key) AS n_pairs_part FROM pairs_0 WHERE date_a IS NOT NULL AND price_a > 0 AND price_b > 0"""
_PARTS["pairs"] = "SELECT *, y / greatest(delta_years, 1 / 365.25) AS annual FROM pairs_all WHERE delta_days >= 30"
_PARTS["spread"] = "SELECT m.med, (SELECT median(abs(annual - m.med)) FROM pairs) AS mad FROM (SELECT median(annual) AS med FROM pairs) m"
_PARTS["flagged"] = """
  SELECT p.*, 0.6745 * (annual - med) / (mad + 1e-12) AS mad_z, delta_days <= 548 AND (price_ratio < 0.25 OR price_ratio > 4.0) AS extreme_ratio,
    abs(0.6745 * (annual - med) / (mad + 1e-12)) > 8 AS extreme_mad,
    (delta_days <= 548 AND (price_ratio < 0.25 OR price_ratio > 4.0)) OR abs(0.6745 * (annual - med) / (mad + 1e-12)) > 8 AS extreme_flag
  FROM pairs p, spread"""
_PARTS["weights_0"] = """
  SELECT *, sqrt(greatest(coalesce(spend_a, price_a * coalesce(qty_a, 0)), 0) * greatest(coalesce(spend_b, price_b * coalesce(qty_b, 0)), 0)) AS g FROM flagged"""
_PARTS["weights_1"] = """
  SELECT *, CASE WHEN least(g, cap) / sqrt(greatest(n_pairs_part, 1)) > 0 THEN least(g, cap) / sqrt(greatest(n_pairs_part, 1)) ELSE 1 END * CASE WHEN extreme_flag THEN 0.25 ELSE 1 END AS w
  FROM weights_0, (SELECT coalesce(quantile_cont(g, 0.95) FILTER (WHERE g > 0), 1.0) AS cap FROM weights_0) c"""
_PARTS["weighted"] = "SELECT *, w / avg(w) OVER () AS pair_weight FROM weights_1"
_PARTS["exposure"] = """
  SELECT part_key, date_a, date_b, pair_weight, CAST(m AS DATE) AS month, greatest(date_diff('day', greatest(date_a, CAST(m AS DATE) - 1), least(date_b, last_day(CAST(m AS DATE)))), 0) / day(last_day(CAST(m AS DATE))) AS exposure
  FROM (SELECT part_key, date_a, date_b, pair_weight, unnest(generate_series(CAST(date_trunc('month', date_a + 1) AS TIMESTAMP), CAST(date_trunc('month', date_b) AS TIMESTAMP), INTERVAL 1 MONTH)) AS m FROM weighted) t"""
_PERIOD = {
    "m": ("CAST(date_trunc('month', po_date) AS DATE)", "year(period_start) * 12 + month(period_start)", "INTERVAL 1 MONTH"),
    "q": ("CAST(date_trunc('quarter', po_date) AS DATE)", "year(period_start) * 4 + quarter(period_start)", "INTERVAL 3 MONTH"),
    "fy": ("make_date(year(po_date) + CASE WHEN month(po_date) >= 10 THEN 0 ELSE -1 END, 10, 1)", "year(period_start) + 1", "INTERVAL 12 MONTH"),
}
for _f, (_start, _ordinal, _step) in _PERIOD.items():
    _PARTS[f"panel0_{_f}"] = f"""
  SELECT part_key, {_start} AS period_start, sum(CASE WHEN qty > 0 AND price > 0 THEN price * qty ELSE 0 END) AS pq, sum(CASE WHEN qty > 0 AND price > 0 THEN qty ELSE 0 END) AS qty,
    sum(coalesce(spend, price * coalesce(qty, 0))) AS spend, median(price) AS pm, first(approved_category ORDER BY po_date) AS approved_category FROM daily GROUP BY 1, 2"""
    _PARTS[f"panel_{_f}"] = f"""
  SELECT part_key, period_start, CAST(period_start + {_step} AS DATE) - 1 AS period_end, CAST({_ordinal} AS BIGINT) AS period_ordinal, CASE WHEN qty > 0 THEN pq / qty ELSE pm END AS price, qty, spend, approved_category
  FROM panel0_{_f}"""
    _PARTS[f"links_{_f}"] = f"""
  SELECT *, ln(price / price_0) AS r FROM (SELECT *, lag(price) OVER w AS price_0, lag(qty) OVER w AS qty_0, lag(spend) OVER w AS spend_0, lag(period_ordinal) OVER w AS ord_0
    FROM panel_{_f} WINDOW w AS (PARTITION BY part_key ORDER BY period_ordinal)) t WHERE period_ordinal - ord_0 = 1 AND price > 0 AND price_0 > 0"""
    _PARTS[f"torn_{_f}"] = f"""
  SELECT l.period_start, max(period_end) AS period_end, count(*) AS match_count, max(tv) AS tv,
    sum((CASE WHEN tv > 0 THEN price * qty / tv WHEN ts > 0 THEN spend / ts END + CASE WHEN tv0 > 0 THEN price_0 * qty_0 / tv0 WHEN ts0 > 0 THEN spend_0 / ts0 END) / 2 * r) AS g
  FROM links_{_f} l JOIN (SELECT period_start, sum(price * qty) AS tv, sum(price_0 * qty_0) AS tv0, sum(spend) AS ts, sum(spend_0) AS ts0 FROM links_{_f} GROUP BY 1) s ON s.period_start = l.period_start GROUP BY 1"""
    _PARTS[f"mchg_{_f}"] = f"""
  SELECT l.period_start, max(period_end) AS period_end, count(*) AS match_count, sum(w0) AS matched_spend, sum(spend) AS current_matched_spend, max(total) AS total_spend,
    sum(spend) / max(total) AS coverage, exp(median(r)) - 1 AS median_change, exp(avg(r)) - 1 AS equal_change, exp(avg(rw)) - 1 AS winsor_equal_change,
    exp(sum(w * rw) / sum(w)) - 1 AS capped_spend_change, max(ql) AS winsor_low, max(qu) AS winsor_high
  FROM (SELECT a.*, ql, qu, least(greatest(r, ql), qu) AS rw, CASE WHEN ws <= 0 THEN 1 ELSE least(w0, cap) END AS w
        FROM (SELECT *, sqrt(greatest(spend, 0) * greatest(spend_0, 0)) AS w0 FROM links_{_f}) a
        JOIN (SELECT period_start, quantile_cont(r, 0.01) AS ql, quantile_cont(r, 0.99) AS qu, sum(w0) AS ws, quantile_cont(w0, 0.95) AS cap
              FROM (SELECT *, sqrt(greatest(spend, 0) * greatest(spend_0, 0)) AS w0 FROM links_{_f}) b GROUP BY 1) q ON q.period_start = a.period_start) l
  JOIN (SELECT period_start, sum(spend) AS total FROM panel_{_f} GROUP BY 1) t ON t.period_start = l.period_start GROUP BY 1"""
    _PARTS[f"fish_{_f}"] = f"""
  SELECT *, exp(sum(ln(l * p) / 2) OVER (ORDER BY period_start)) AS fisher_index
  FROM (SELECT period_start, max(period_end) AS period_end, count(*) AS match_count, sum(price * qty_0) / sum(price_0 * qty_0) AS l, sum(price * qty) / sum(price_0 * qty) AS p
    FROM links_{_f} WHERE qty > 0 AND qty_0 > 0 GROUP BY 1) t"""
_PARTS["hist"] = """
  SELECT *, CASE WHEN dn = '' THEN NULL ELSE dn END AS description_norm, included_for_pricing AND dn IN ('INVENTORY', 'PRODUCTION SUPPLIES', 'OPERATING SUPPLIES', 'PRODUCTION AIDS', 'SMALL TOOLS') AS in_physical_inputs,
    included_for_pricing AND dn = 'INVENTORY' AS in_inventory_only, included_for_pricing AS in_all_po_lines, source_file AS fiscal_year FROM clean"""
_PARTS["windows"] = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', DATE '{a}', DATE '{b}')" for k, (a, b) in WINDOWS.items()) + ") v(label, ws, we)"
_PARTS["comparisons"] = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in COMPARISONS.items()) + ") v(comparison, la, lb)"
_PARTS["scoped"] = """
  SELECT 'inventory_only' AS scope, * FROM hist WHERE in_inventory_only UNION ALL SELECT 'physical_inputs', * FROM hist WHERE in_physical_inputs UNION ALL SELECT 'all_po_lines', * FROM hist WHERE in_all_po_lines"""
_PARTS["wparts"] = """
  SELECT scope, label, part_key, median(price) AS price, sum(greatest(coalesce(po_value, 0), 0)) AS spend, median(qty_ordered) FILTER (WHERE qty_ordered > 0) AS qty, count(*) AS line_count, count(DISTINCT price) AS unique_price_count,
    min(po_date) AS first_date, max(po_date) AS last_date, min(price) AS price_min, max(price) AS price_max, stddev_pop(price) AS price_dispersion
  FROM scoped JOIN windows ON po_date BETWEEN ws AND we WHERE price > 0 GROUP BY 1, 2, 3"""
_PARTS["wtotal"] = "SELECT scope, label, sum(greatest(coalesce(po_value, 0), 0)) AS total FROM scoped JOIN windows ON po_date BETWEEN ws AND we GROUP BY 1, 2"
_PARTS["mb0"] = """
  SELECT a.scope, comparison, a.part_key, a.price AS price_a, b.price AS price_b, a.spend AS spend_a, b.spend AS spend_b, a.qty AS qty_a, b.qty AS qty_b, ln(b.price / a.price) AS r,
    sqrt(greatest(a.spend, 0) * greatest(b.spend, 0)) AS h
  FROM comparisons JOIN wparts a ON a.label = la JOIN wparts b ON b.label = lb AND b.part_key = a.part_key AND b.scope = a.scope"""
_PARTS["mb1"] = """
  SELECT m.*, ql, qu, least(greatest(r, ql), qu) AS r_w, (spend_a / nullif(sa, 0) + spend_b / nullif(sb, 0)) / 2 AS s_bar, least(h, hc) AS h_capped, sa, sb
  FROM mb0 m JOIN (SELECT scope, comparison, quantile_cont(r, 0.01) AS ql, quantile_cont(r, 0.99) AS qu, sum(spend_a) AS sa, sum(spend_b) AS sb, quantile_cont(h, 0.95) AS hc FROM mb0 GROUP BY 1, 2) q
    ON q.scope = m.scope AND q.comparison = m.comparison"""
_PARTS["mb2"] = """
  SELECT m.*, cap AS weight_cap, least(s_bar, cap) AS s_capped, hs FROM mb1 m JOIN (SELECT scope, comparison, quantile_cont(s_bar, 0.95) AS cap, sum(h_capped) AS hs FROM mb1 GROUP BY 1, 2) q
    ON q.scope = m.scope AND q.comparison = m.comparison"""
_PARTS["matched"] = """
  SELECT m.*, s_capped / nullif(sum(s_capped) OVER w, 0) AS s_tilde, h_capped / nullif(hs, 0) AS h_tilde, coalesce(qty_a > 0 AND qty_b > 0 AND qty_b / qty_a BETWEEN 0.5 AND 2.0, false) AS qty_comparable,
    abs(r) < 1e-12 AS no_price_change, sa / nullif(ta.total, 0) AS coverage_a, sb / nullif(tb.total, 0) AS coverage_b
  FROM mb2 m JOIN comparisons c ON c.comparison = m.comparison LEFT JOIN wtotal ta ON ta.scope = m.scope AND ta.label = la LEFT JOIN wtotal tb ON tb.scope = m.scope AND tb.label = lb
  WINDOW w AS (PARTITION BY m.scope, m.comparison)"""
_PARTS["alike"] = """
  SELECT m.scope, m.comparison, max(n) AS n, avg(least(greatest(r, lo), hi)) AS v FROM matched m
  JOIN (SELECT scope, comparison, count(*) AS n, quantile_cont(r, 0.01) AS lo, quantile_cont(r, 0.99) AS hi FROM matched WHERE qty_comparable GROUP BY 1, 2) q ON q.scope = m.scope AND q.comparison = m.comparison
  WHERE qty_comparable GROUP BY 1, 2"""
_PARTS["variants"] = """
  SELECT m.scope, m.comparison, count(*) AS matched_parts, exp(median(r)) - 1 AS median_change, exp(quantile_cont(r, 0.25)) - 1 AS p25_change, exp(quantile_cont(r, 0.75)) - 1 AS p75_change,
    avg(CASE WHEN no_price_change THEN 1.0 ELSE 0.0 END) AS share_unchanged, sum(spend_a) AS matched_spend_a, sum(spend_b) AS matched_spend_b, max(coverage_a) AS coverage_a, max(coverage_b) AS coverage_b,
    max(ql) AS winsor_low, max(qu) AS winsor_high, max(weight_cap) AS weight_cap, exp(sum(s_bar * r)) - 1 AS raw_tornqvist, exp(sum(s_bar * r_w)) - 1 AS winsor_tornqvist, exp(sum(s_tilde * r_w)) - 1 AS headline,
    exp(sum(h_tilde * r_w)) - 1 AS capped_geometric_spend, exp(avg(r_w)) - 1 AS equal_winsor, exp(avg(r)) - 1 AS equal_raw, CASE WHEN max(s.n) >= 2 THEN exp(max(s.v)) - 1 END AS similar_quantity, coalesce(max(s.n), 0) AS similar_parts
  FROM matched m LEFT JOIN alike s ON s.scope = m.scope AND s.comparison = m.comparison GROUP BY 1, 2"""
_PARTS["opened"] = f"SELECT * FROM classified WHERE in_direct_costs AND has_open_commitment AND committed_price > 0 AND po_date <= DATE '{BASE}'"
_PARTS["last_realized"] = f"""
  SELECT part_key, effective_date, last(realized_price ORDER BY source_file, source_row_number) AS prior_price FROM realized WHERE effective_date <= DATE '{BASE}' GROUP BY 1, 2"""
_PARTS["committed_0"] = """
  SELECT o.*, r.prior_price, r.effective_date AS prior_date FROM opened o ASOF LEFT JOIN last_realized r ON o.part_key = r.part_key AND o.po_date > r.effective_date"""
_PARTS["committed"] = """
  SELECT *, coalesce(prior_price > 0, false) AS matched, CAST(date_diff('day', prior_date, po_date) AS BIGINT) AS gap_days, CASE WHEN prior_price > 0 THEN ln(committed_price / prior_price) END AS log_change,
    CASE WHEN prior_price > 0 AND date_diff('day', prior_date, po_date) >= 30 THEN ln(committed_price / prior_price) / (date_diff('day', prior_date, po_date) / 365.25) END AS annual_log_change, greatest(remaining_open_spend, 0) AS open_weight
  FROM committed_0"""
_PARTS["committed_both"] = "SELECT direct_category AS category, * FROM committed UNION ALL SELECT 'Overall Direct Costs', * FROM committed"
_PARTS["committed_stats"] = """
  SELECT category, quantile_cont(annual_log_change, 0.01) AS lo, quantile_cont(annual_log_change, 0.99) AS hi, quantile_cont(open_weight, 0.95) AS cap FROM committed_both
  WHERE annual_log_change IS NOT NULL AND open_weight > 0 GROUP BY 1"""
_PARTS["hold_0"] = """
  SELECT b.part_key, b.approved_category, b.po_date AS base_date, a.po_date AS actual_date, b.price AS pb, a.price AS pa, b.spend, CAST(date_diff('day', b.po_date, a.po_date) AS BIGINT) AS gap
  FROM (SELECT *, row_number() OVER (PARTITION BY part_key ORDER BY po_date DESC) AS k FROM daily WHERE po_date <= DATE '1999-09-30') b
  JOIN (SELECT *, row_number() OVER (PARTITION BY part_key ORDER BY abs(date_diff('day', po_date, DATE '2000-09-30')), po_date) AS k FROM daily WHERE po_date BETWEEN DATE '2000-09-30' - 90 AND DATE '2000-09-30' + 90) a
    ON a.part_key = b.part_key AND a.k = 1 AND b.k = 1"""
_PARTS["hold_1"] = "SELECT *, ln(pa / pb) AS raw, ln(pa / pb) * 366 / gap AS lh, greatest(coalesce(spend, pb), 0) AS w0 FROM hold_0 WHERE gap > 0 AND gap <= 548"
_PARTS["hold_2"] = """
  SELECT *, w1 * damp / sum(w1 * damp) OVER () AS weight
  FROM (SELECT h.*, CASE WHEN lh < ln(0.25) OR lh > ln(4.0) THEN 0.25 ELSE 1 END AS damp, least(w0, cap) AS w1 FROM hold_1 h, (SELECT quantile_cont(w0, 0.95) AS cap FROM hold_1) s) t"""
# Monthly rates in order, and the state of the recursive forecasters after each month.
_PARTS["ser"] = "SELECT row_number() OVER (ORDER BY period_start) AS i, period_start AS month, g AS x FROM torn_m"
_PARTS["st"] = """
  SELECT CAST(1 AS BIGINT) AS i, x AS e, x AS l, coalesce((SELECT x FROM ser WHERE i = 2) - x, 0) AS t FROM ser WHERE i = 1
  UNION ALL SELECT s.i, 0.3 * s.x + 0.7 * p.e, 0.4 * s.x + 0.6 * (p.l + 0.8 * p.t), 0.2 * (0.4 * s.x + 0.6 * (p.l + 0.8 * p.t) - p.l) + 0.64 * p.t FROM st p JOIN ser s ON s.i = p.i + 1"""
_PARTS["sums"] = """
  SELECT s.i, n, method, CASE method WHEN 'trailing_12m_mean' THEN 12 * recent WHEN 'ewma' THEN 12 * e
    WHEN 'damped_holt' THEN 12 * l + (12 * 0.8 - 0.64 * (1 - pow(0.8, 12)) / 0.2) / 0.2 * t ELSE 12 * mu + (recent - mu) * 0.85 * (1 - pow(0.85, 12)) / 0.15 END AS cumulative_log
  FROM (SELECT i, avg(x) OVER (ORDER BY i) AS mu, avg(x) OVER (ORDER BY i ROWS 11 PRECEDING) AS recent, count(*) OVER () AS n FROM ser) s JOIN st ON st.i = s.i,
    (VALUES ('trailing_12m_mean'), ('ewma'), ('damped_holt'), ('mean_reversion')) m(method)"""
_PARTS["mixed"] = """
  SELECT * REPLACE (CASE WHEN in_direct_costs AND (source_row_number // 100) % 3 = 0 THEN 'Inventory' ELSE direct_category END AS direct_category) FROM classified"""
_PARTS["fparts"] = """
  SELECT direct_category, prefix, part_key, first(words ORDER BY source_file, source_row_number) AS words, median(realized_price) AS median_price, count(*) AS observations, min(fy) AS first_fy, max(fy) AS last_fy,
    list_distinct(list_filter(string_split(first(words ORDER BY source_file, source_row_number), ' '), lambda t: length(t) >= 2 AND t NOT IN ('A', 'AN', 'AND', 'FOR', 'OF', 'THE', 'TO', 'WITH', 'ASSY', 'ASSEMBLY'))) AS tokens
  FROM (SELECT *, substr(regexp_extract(upper(description_1), '^[A-Z]{2,}[A-Z0-9]*'), 1, 12) AS prefix, trim(regexp_replace(upper(description_1 || ' ' || description_2), '[^A-Z0-9]+', ' ', 'g')) AS words,
          CAST(substr(source_file, 3) AS BIGINT) AS fy FROM realized) t WHERE prefix <> '' GROUP BY 1, 2, 3"""
_PARTS["fy_spend"] = f"SELECT * FROM classified WHERE in_direct_costs AND realized_spend > 0 AND effective_date <= DATE '{BASE}'"


def _needed(text: str) -> list[str]:
    """Named parts that a statement uses, in the order of definition."""
    import re

    found: set[str] = set()
    todo = [text]
    while todo:
        words = set(re.findall(r"[a-z_0-9]+", todo.pop()))
        fresh = (words & _PARTS.keys()) - found
        found |= fresh
        todo += [_PARTS[x] for x in fresh]
    return [k for k in _PARTS if k in found]


def nudge(digits: int) -> str:
    """A value added before rounding, so that exact halves (prices over 16 or 32 units) round alike in both engines."""
    return f"{3 * 10.0 ** -(digits + 3):.{digits + 3}f}"


def _nudged(text: str) -> str:
    """``round(x, n)`` of a statement with the nudge."""
    out, at = "", 0
    while (start := text.find("round(", at)) >= 0:
        depth, i = 1, start + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(text[i], 0)
            i += 1
        inner, _, digits = text[start + 6 : i - 1].rpartition(", ")
        out += text[at:start] + (f"round(({inner}) + {nudge(int(digits))}, {digits})" if digits.isdigit() and inner else text[start:i])
        at = i
    return out + text[at:]


def statement(select: str) -> str:
    """A query with the named parts it needs in front of it."""
    parts = _needed(select)  # a part that names itself is recursive
    head = f"WITH {'RECURSIVE ' if 'st' in parts else ''}" + ",\n".join(f"{k} AS ({_PARTS[k]})" for k in parts) + "\n" if parts else ""
    return head + _nudged(select)


def changed(sql: str, **parts: str) -> str:
    """A statement in which named parts have another text."""
    for name, text in parts.items():
        sql = sql.replace(f"{name} AS ({_PARTS[name]})", f"{name} AS ({text})")
    return sql


def part(name: str) -> str:
    return _PARTS[name]


def rounded(spec: str, table: str, tail: str = "") -> str:
    """``a b:6 c`` as columns of a table, those with digits rounded."""
    columns = [c if ":" not in c else f"round({c.split(':')[0]}, {c.split(':')[1]}) AS {c.split(':')[0]}" for c in spec.split()]
    return statement(f"SELECT {', '.join(columns)} FROM {table} {tail}")
