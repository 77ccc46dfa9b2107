"""SQL twins of the registered queries, for an independent engine.

Written from the definitions, not from the Spark plans: an as-of join where
Spark uses a range residual, a self join where Spark uses a running maximum,
plain windows where Spark splits hot keys. Local time is UTC plus four hours
(the reporting zone has no daylight saving).
"""

from __future__ import annotations

from orderlens.registry.queries import (
    CURVE_MAX,
    FILL_TARGET,
    LATE_MONTHS,
    LOOKBACK_DAYS,
    SWEEP,
    TRUE_EFFECTS,
    TRUE_REPAIR,
    P,
)


def _draw(key: str, factor: int, modulus: int) -> str:
    return f"((({key} * {factor}) % 10007) % {modulus})"


def _accepts(o: str) -> str:
    kind = _draw(o, 271, 100)
    return (
        f"({_draw(o, 947, 100)} < CASE WHEN {kind} < 34 THEN 78 WHEN {kind} < 75 THEN 55 "
        "ELSE 29 END)"
    )


def _swap(o: str) -> str:
    kind = _draw(o, 271, 100)
    return (
        f"CASE WHEN {kind} < 34 THEN 'same_brand_diff_size' "
        f"WHEN {kind} < 75 THEN 'diff_brand_same_product' ELSE 'diff_product_same_cat' END"
    )


def _offers(o: str) -> str:
    return f"({_draw(o, 613, 100)} < 62)"


def _gap(n1: str, k1: str, n0: str, k0: str, digits: int = 8) -> str:
    """Rates, difference in pp and 95% interval from counts."""
    p1, p0 = f"({k1} * 1.0 / nullif({n1}, 0))", f"({k0} * 1.0 / nullif({n0}, 0))"
    v1, v0 = f"{p1} * (1 - {p1}) / nullif({n1}, 0)", f"{p0} * (1 - {p0}) / nullif({n0}, 0)"
    half = f"(196 * sqrt({v1} + {v0}))"
    gap = f"(({p1} - {p0}) * 100)"
    return (
        f"round({p1}, {digits}) AS rate_treated, round({p0}, {digits}) AS rate_control, "
        f"round({gap}, {digits}) + 0.0 AS effect_pp, round({gap} - {half}, {digits}) AS ci_lo, "
        f"round({gap} + {half}, {digits}) AS ci_hi"
    )


def _yates(n1: str, k1: str, n0: str, k0: str) -> str:
    """Continuity-corrected chi-square, cell by cell."""
    total, hits = f"({n1} + {n0})", f"({k1} + {k0})"
    cells = []
    for n, k in ((n1, k1), (n0, k0)):
        for seen, margin in ((f"{k}", hits), (f"({n} - {k})", f"({total} - {hits})")):
            want = f"({n} * 1.0 * {margin} / nullif({total}, 0))"
            cells.append(f"power(greatest(abs({seen} - {want}) - 0.5, 0), 2) / nullif({want}, 0)")
    return " + ".join(cells)


_FILL = """count(*) AS orders, CAST(sum(n_items) AS BIGINT) AS items,
  round(avg(n_items), 8) AS mean_basket, round(avg(item_fill_rate), 8) AS item_fill_macro,
  round(1 - sum(n_stocked_out) * 1.0 / sum(n_items), 8) AS item_fill_micro,
  round(avg(CAST(is_clean_order AS INT)), 8) AS order_fill"""
_FILL_GAP = (
    _FILL
    + """, round(1 - avg(item_fill_rate), 8) AS item_miss_rate,
  round(100 * (avg(item_fill_rate) - avg(CAST(is_clean_order AS INT))), 8) AS gap_pp"""
)
_BAND = """CASE WHEN n_items <= 3 THEN '1-3' WHEN n_items <= 6 THEN '4-6'
  WHEN n_items <= 10 THEN '7-10' WHEN n_items <= 15 THEN '11-15' ELSE '16+' END"""
_ARMS = """count(*) FILTER (had_stockout) AS n_treated,
  count(*) FILTER (had_stockout AND repeated) AS k_treated,
  count(*) FILTER (NOT had_stockout) AS n_control,
  count(*) FILTER (NOT had_stockout AND repeated) AS k_control"""
_W = P.retention_window_days
_CATS = ", ".join(f"'{c}'" for c in P.high_intent_categories)

# Shared named queries: raw tables, staging, marts and populations.
_SHARED = f"""
placed_orders AS (
  SELECT o_orderkey AS k, o_custkey AS customer_id, CAST(c_nationkey AS BIGINT) AS darkstore_id,
    o_orderdate + to_seconds(o_orderkey * 7919 % 86400) AS t
  FROM orders JOIN customer ON o_custkey = c_custkey),
log_once AS (
  SELECT k, customer_id, darkstore_id, 'order_placed' AS event_type, t AS moment FROM placed_orders
  UNION ALL
  SELECT k, customer_id, darkstore_id, 'order_cancelled', t + to_minutes(2 + k % 23)
  FROM placed_orders WHERE k % 41 = 0),
raw_order_events AS (
  SELECT k AS order_id, customer_id, darkstore_id, event_type, moment AS event_at_utc FROM log_once
  UNION ALL
  SELECT k, customer_id, darkstore_id, event_type, moment + to_milliseconds(200 + k % 700)
  FROM log_once WHERE k % 83 = 0),
raw_order_items AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS INT) AS quantity,
    short AS was_stocked_out,
    short AND {_offers("l_orderkey")} AND {_accepts("l_orderkey")} AS was_substituted,
    CASE WHEN short AND {_offers("l_orderkey")} THEN {_swap("l_orderkey")} END
      AS substitution_type
  FROM (SELECT *, (l_orderkey * 31 + l_linenumber * 17 + l_partkey * 7) % 17 = 0 AS short
        FROM lineitem)),
order_shorts AS (
  SELECT order_id, bool_or(was_stocked_out) AS short, count(*) AS n_lines
  FROM raw_order_items GROUP BY ALL),
raw_fulfilment AS (
  SELECT k AS order_id, f AS fulfilled_at_utc, f + to_minutes(lag) AS ingested_at_utc, had
      AS had_stockout, had AND {_offers("k")} AS substitute_offered,
    had AND {_offers("k")} AND {_accepts("k")} AS substitute_accepted,
    CASE WHEN had AND {_offers("k")} THEN {_swap("k")} END AS substitution_type
  FROM (SELECT k, t + to_minutes(8 + {_draw("k", 89, 26)}) AS f, coalesce(short, false) AS had,
          CASE WHEN {_draw("k", 557, 100)} < 8 THEN 60 + {_draw("k", 733, 300)}
               ELSE 1 + {_draw("k", 733, 3)} END AS lag
        FROM placed_orders LEFT JOIN order_shorts ON order_id = k)),
product_changes AS (
  SELECT p_partkey AS product_id, CASE WHEN p_partkey % 33 <> 0 THEN p_type END AS category,
    DATE '1995-01-01' AS moment, p_retailprice AS base_price_aed FROM part
  UNION ALL
  SELECT p_partkey, CASE WHEN p_partkey % 33 <> 0 THEN p_type END, DATE '1998-04-01',
    p_retailprice * 1.1 FROM part WHERE p_partkey % 16 = 0),
stg_products AS (
  SELECT product_id, coalesce(category, 'Unmapped') AS category,
    category IS NULL AS is_category_unmapped, base_price_aed, moment AS valid_from,
    CASE WHEN product_id % 16 = 0 AND moment < DATE '1998-04-01' THEN DATE '1998-04-01'
         ELSE DATE '2999-12-31' END AS valid_to,
    NOT (product_id % 16 = 0 AND moment < DATE '1998-04-01') AS is_current
  FROM product_changes),
dim_product AS (
  SELECT md5(product_id || '|' || valid_from) AS product_key, * FROM stg_products),
store_base AS (
  SELECT CAST(n_nationkey AS BIGINT) AS darkstore_id, n_name AS darkstore_name, r_name AS area,
    1 + n_nationkey * 0.25 AS affluence_index,
    CAST(DATE '1994-01-01' + n_nationkey AS DATE) AS opened_on
  FROM nation JOIN region ON n_regionkey = r_regionkey),
stg_darkstores AS (
  SELECT darkstore_id, darkstore_name, area, CAST(affluence_index AS DOUBLE) AS affluence_index,
    opened_on, CAST(2.5 AS DOUBLE) AS catchment_radius_km, opened_on AS valid_from,
    CASE WHEN darkstore_id % 3 = 0 THEN DATE '1998-06-01' ELSE DATE '2999-12-31' END AS valid_to,
    darkstore_id % 3 <> 0 AS is_current FROM store_base
  UNION ALL
  SELECT darkstore_id, darkstore_name, area, CAST(affluence_index AS DOUBLE), opened_on,
    CAST(3.4 AS DOUBLE), DATE '1998-06-01', DATE '2999-12-31', true
  FROM store_base WHERE darkstore_id % 3 = 0),
dim_darkstore AS (
  SELECT md5(darkstore_id || '|' || valid_from) AS darkstore_key, * FROM stg_darkstores),
visits AS (
  SELECT k, customer_id, t - INTERVAL 10 MINUTE AS moment,
    CASE WHEN {_draw("k", 3361, 1000)} < 500 THEN 'control' ELSE 'treatment' END AS variant,
    {_draw("k", 4973, 1000)} < 10 + 22 * n_lines AS leaves
  FROM placed_orders JOIN order_shorts ON order_id = k),
raw_sessions AS (
  SELECT k * 2 AS session_id, customer_id, NOT (variant = 'treatment' AND leaves) AS converted,
    CASE WHEN NOT (variant = 'treatment' AND leaves) THEN k END AS order_id,
    moment AS started_at_utc FROM visits
  UNION ALL
  SELECT k * 2 + 1, customer_id, false, NULL, moment - INTERVAL 6 HOUR FROM visits),
first_placed AS (
  SELECT order_id, min(customer_id) AS customer_id, min(darkstore_id) AS darkstore_id,
    min(event_at_utc) AS ordered_at_utc
  FROM raw_order_events WHERE event_type = 'order_placed' GROUP BY order_id),
stg_orders AS (
  SELECT order_id, customer_id, darkstore_id, ordered_at_utc,
    ordered_at_utc + INTERVAL 4 HOUR AS ordered_at_gst,
    CAST(ordered_at_utc + INTERVAL 4 HOUR AS DATE) AS order_date_gst,
    CAST(hour(ordered_at_utc + INTERVAL 4 HOUR) AS BIGINT) AS order_hour_gst,
    order_id IN (SELECT order_id FROM raw_order_events WHERE event_type = 'order_cancelled')
      AS is_cancelled
  FROM first_placed),
stg_fulfilment AS (
  SELECT order_id, fulfilled_at_utc, ingested_at_utc,
    fulfilled_at_utc + INTERVAL 4 HOUR AS fulfilled_at_gst,
    date_diff('minute', fulfilled_at_utc, ingested_at_utc) AS ingestion_lag_minutes,
    date_diff('minute', fulfilled_at_utc, ingested_at_utc) > {P.late_threshold_minutes}
      AS is_late_arriving,
    had_stockout, substitute_offered, substitute_accepted, substitution_type
  FROM raw_fulfilment),
fct_order_items AS (
  SELECT i.order_id, i.product_id, p.product_key, o.customer_id, o.darkstore_id,
    o.order_date_gst, i.quantity, p.category, p.is_category_unmapped, p.base_price_aed,
    i.quantity * p.base_price_aed AS line_value_aed, i.was_stocked_out, i.was_substituted,
    i.substitution_type, p.category IN ({_CATS}) AS is_high_intent_category
  FROM raw_order_items i JOIN stg_orders o ON o.order_id = i.order_id
  ASOF LEFT JOIN dim_product p
    ON p.product_id = i.product_id AND o.order_date_gst >= p.valid_from),
order_lines AS (
  SELECT order_id, count(*) AS n_items, CAST(sum(quantity) AS BIGINT) AS n_units,
    sum(line_value_aed) AS gross_value_aed, count(*) FILTER (was_stocked_out) AS n_stocked_out,
    count(*) FILTER (was_stocked_out AND is_high_intent_category) AS n_urgent,
    count(*) FILTER (was_substituted) AS n_substituted,
    list_distinct(list(substitution_type)) AS swaps
  FROM fct_order_items GROUP BY order_id),
fct_orders AS (
  SELECT o.order_id, o.customer_id, d.darkstore_key, o.darkstore_id, o.order_date_gst,
    o.order_hour_gst, o.ordered_at_gst, o.is_cancelled, n_items, n_units, gross_value_aed,
    n_stocked_out, 1 - n_stocked_out * 1.0 / n_items AS item_fill_rate,
    n_stocked_out = 0 AS is_clean_order, n_stocked_out > 0 AS had_stockout,
    n_urgent > 0 AS had_high_intent_stockout, n_substituted, f.substitute_offered,
    f.substitute_accepted,
    CASE WHEN list_contains(swaps, 'diff_product_same_cat') THEN 'diff_product_same_cat'
         WHEN list_contains(swaps, 'diff_brand_same_product') THEN 'diff_brand_same_product'
         WHEN list_contains(swaps, 'same_brand_diff_size') THEN 'same_brand_diff_size'
    END AS substitution_type, f.ingestion_lag_minutes, f.is_late_arriving,
    date_diff('day', d.opened_on, o.order_date_gst) AS store_age_days_at_order
  FROM stg_orders o JOIN order_lines USING (order_id)
  LEFT JOIN stg_fulfilment f ON f.order_id = o.order_id
  ASOF LEFT JOIN dim_darkstore d
    ON d.darkstore_id = o.darkstore_id AND o.order_date_gst >= d.valid_from),
clean_orders AS (SELECT * FROM fct_orders WHERE NOT is_cancelled),
activity AS (
  SELECT customer_id, count(*) AS order_count, count(DISTINCT order_date_gst) AS active_days,
    count(*) * 1.0 / count(DISTINCT order_date_gst) AS orders_per_active_day
  FROM stg_orders WHERE NOT is_cancelled GROUP BY customer_id),
center AS (SELECT median(order_count) AS med FROM activity),
robust AS (
  SELECT med, (SELECT median(abs(order_count - med)) FROM activity) AS mad FROM center),
accounts AS (
  SELECT activity.*, med, mad, med + {P.mad_k} * 1.4826 * nullif(mad, 0) AS threshold,
    order_count > med + {P.mad_k} * 1.4826 * nullif(mad, 0) AS is_test_account
  FROM activity, robust),
dim_customer AS (
  SELECT c_custkey AS customer_key, c_custkey AS customer_id, c_mktsegment AS segment,
    CAST(DATE '1994-06-01' + CAST(c_custkey % 200 AS INT) AS DATE) AS acquired_on,
    CAST(c_nationkey AS BIGINT) AS home_darkstore_id, false AS is_test_account_source_flag,
    coalesce(is_test_account, false) AS is_test_account,
    coalesce(order_count, 0) AS lifetime_orders
  FROM customer LEFT JOIN accounts ON customer_id = c_custkey),
order_sequence AS (
  SELECT order_id, customer_id, darkstore_id, ordered_at_gst, order_date_gst, order_hour_gst,
    is_cancelled, row_number() OVER s AS order_seq, row_number() OVER s - 1 AS prior_order_count,
    lead(ordered_at_gst) OVER s AS next_ordered_at_gst,
    lag(ordered_at_gst) OVER s AS prev_ordered_at_gst,
    date_diff('day', ordered_at_gst, lead(ordered_at_gst) OVER s) AS days_to_next_order,
    count(*) OVER (PARTITION BY customer_id) AS customer_lifetime_orders
  FROM stg_orders WHERE NOT is_cancelled
  WINDOW s AS (PARTITION BY customer_id ORDER BY ordered_at_gst, order_id)),
fct_customer_orders AS (
  SELECT q.order_id, q.customer_id, c.segment, c.is_test_account, q.darkstore_id,
    q.order_date_gst, q.order_hour_gst, q.order_seq, q.prior_order_count,
    CASE WHEN q.order_seq <= {P.tenure_new_max_prior_orders + 1} THEN 'new'
         ELSE 'established' END AS tenure,
    o.n_items, o.gross_value_aed, o.item_fill_rate, o.is_clean_order, o.had_stockout,
    o.had_high_intent_stockout, o.substitute_offered, o.substitute_accepted,
    o.substitution_type, o.store_age_days_at_order, q.days_to_next_order,
    q.days_to_next_order <= {_W} AS repeat_within_30d,
    q.order_date_gst <= (SELECT max(order_date_gst) FROM stg_orders) - {_W}
      AS is_observable_30d
  FROM order_sequence q JOIN fct_orders o ON o.order_id = q.order_id
  LEFT JOIN dim_customer c ON c.customer_id = q.customer_id),
focal AS (
  SELECT *, coalesce(repeat_within_30d, false) AS repeated FROM fct_customer_orders
  WHERE is_observable_30d AND NOT is_test_account),
exposed AS (
  SELECT *, CASE WHEN substitute_accepted THEN 'accepted' WHEN substitute_offered THEN 'declined'
                 ELSE 'not_offered' END AS offer_arm
  FROM focal WHERE had_stockout),
fct_sessions AS (
  SELECT s.session_id, s.customer_id, c.segment, c.is_test_account,
    CAST(s.started_at_utc + INTERVAL 4 HOUR AS DATE) AS session_date_gst,
    s.started_at_utc + INTERVAL 4 HOUR AS started_at_gst, v.variant,
    v.variant IS NOT NULL AS is_in_experiment, s.converted, s.order_id, o.had_stockout,
    o.substitute_offered, o.substitute_accepted, o.substitution_type, o.gross_value_aed
  FROM raw_sessions s LEFT JOIN visits v ON v.k * 2 = s.session_id
  LEFT JOIN fct_orders o ON o.order_id = s.order_id
  LEFT JOIN dim_customer c ON c.customer_id = s.customer_id),
frame AS (
  SELECT s.*, o.n_items, coalesce(q.repeat_within_30d, false) AS repeated,
    coalesce(q.is_observable_30d, false) AND s.converted AS seen
  FROM fct_sessions s LEFT JOIN fct_orders o ON o.order_id = s.order_id
  LEFT JOIN fct_customer_orders q ON q.order_id = s.order_id
  WHERE s.is_in_experiment AND NOT s.is_test_account),
arms AS (
  SELECT count(*) FILTER (variant = 'control') AS nc,
    count(*) FILTER (variant = 'treatment') AS nt,
    count(*) FILTER (variant = 'control' AND converted) AS cc,
    count(*) FILTER (variant = 'treatment' AND converted) AS ct,
    count(*) FILTER (variant = 'control' AND repeated) AS rc,
    count(*) FILTER (variant = 'treatment' AND repeated) AS rt,
    count(*) FILTER (variant = 'control' AND seen) AS sc,
    count(*) FILTER (variant = 'treatment' AND seen) AS st,
    count(*) FILTER (variant = 'control' AND seen AND repeated) AS src,
    count(*) FILTER (variant = 'treatment' AND seen AND repeated) AS srt,
    avg(n_items) FILTER (variant = 'control' AND converted) AS mc,
    avg(n_items) FILTER (variant = 'treatment' AND converted) AS mt,
    var_samp(n_items) FILTER (variant = 'control' AND converted) AS vc,
    var_samp(n_items) FILTER (variant = 'treatment' AND converted) AS vt
  FROM frame),
event_frame AS (
  SELECT event_id, user_id, CAST(date_trunc('week', ts) AS DATE) AS week, value,
    CASE WHEN {_draw("event_id", 3361, 2)} = 0 THEN 'control' ELSE 'treatment' END AS variant,
    event_type = 'purchase' AND ({_draw("event_id", 3361, 2)} = 0
      OR {_draw("event_id", 613, 100)} >= 19) AS converted
  FROM events),
event_arms AS (
  SELECT week, count(*) FILTER (variant = 'control') AS nc,
    count(*) FILTER (variant = 'treatment') AS nt,
    count(*) FILTER (variant = 'control' AND converted) AS cc,
    count(*) FILTER (variant = 'treatment' AND converted) AS ct
  FROM event_frame GROUP BY week),
order_counts AS (SELECT o_custkey AS customer_id, count(*) AS n FROM orders GROUP BY ALL),
truth AS (
  SELECT customer_id, n > (SELECT quantile_cont(n, 0.98) FROM order_counts) AS is_heavy
  FROM order_counts),
cut_points AS (
  SELECT list_sort(list_distinct(quantile_cont(n_items, [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e
  FROM focal),
strata AS (
  SELECT focal.*, CAST(len(list_filter(e[2:-2], lambda x: x < n_items)) AS INT) AS basket_q
  FROM focal, cut_points),
tenure_effects AS (
  SELECT tenure, {_ARMS}, count(*) AS n FROM focal GROUP BY tenure),
tenure_points AS (
  SELECT *, n_treated * 1.0 / n AS treated_share,
    abs(100.0 * k_treated / n_treated - 100.0 * k_control / n_control) AS size_pp
  FROM tenure_effects),
swap_controls AS (
  SELECT CASE offer_arm WHEN 'declined' THEN 'A_vs_declined' ELSE 'B_vs_not_offered' END
      AS control, count(*) AS n_control, count(*) FILTER (repeated) AS k_control
  FROM exposed WHERE offer_arm <> 'accepted' GROUP BY ALL),
swap_groups AS (
  SELECT substitution_type, count(*) AS n_treated, count(*) FILTER (repeated) AS k_treated
  FROM exposed WHERE offer_arm = 'accepted' AND substitution_type IS NOT NULL GROUP BY ALL
  HAVING count(*) >= {P.min_cell}),
swap_effects AS (
  SELECT control, substitution_type, n_treated, k_treated, n_control, k_control,
    100.0 * k_treated / n_treated - 100.0 * k_control / n_control AS pp
  FROM swap_groups, swap_controls),
proxies AS (
  SELECT CASE control WHEN 'A_vs_declined' THEN 'A' ELSE 'B' END AS proxy,
    CAST(NULL AS VARCHAR) AS substitution_type,
    (SELECT count(*) FROM exposed WHERE offer_arm = 'accepted') AS n_treated,
    (SELECT count(*) FROM exposed WHERE offer_arm = 'accepted' AND repeated) AS k_treated,
    n_control, k_control
  FROM swap_controls
  UNION ALL
  SELECT 'C', substitution_type, n_treated, k_treated, n_control, k_control
  FROM swap_effects WHERE control = 'B_vs_not_offered'),
rankings AS (
  SELECT control, string_agg(substitution_type, ' > ' ORDER BY pp DESC, substitution_type)
    AS ranking FROM swap_effects GROUP BY control)
"""

_COUNTS = ("n_treated", "k_treated", "n_control", "k_control")
_ROWS = "n_treated, k_treated, n_control, k_control"


def _srm(stage: str, c: str, t: str, source: str, extra: str = "") -> str:
    half = f"(({c} + {t}) * 0.5)"
    return f"""SELECT {extra}{stage}{c} AS n_control, {t} AS n_treatment,
      round({c} * 1.0 / ({c} + {t}), 8) AS observed_share, 0.5::DOUBLE AS expected_share,
      round(power({c} - {half}, 2) / {half} + power({t} - {half}, 2) / {half}, 8) AS chi2,
      power({c} - {half}, 2) / {half} + power({t} - {half}, 2) / {half} > 10.827566170662733
        AS srm_detected
    FROM {source}"""


def _effect_sets(sets: str, cols: str) -> str:
    return f"""SELECT {cols}, {_ROWS}, n, round(n_treated * 1.0 / n, 8) AS treated_share,
      {_gap(*_COUNTS)}
    FROM (SELECT {cols}, {_ARMS}, count(*) AS n FROM focal GROUP BY GROUPING SETS ({sets}))"""


def _metric(name: str, source: str, num: str, den: str, by: str = "") -> str:
    group = f" GROUP BY {by}" if by else ""
    head = f"{by}, " if by else ""
    return f"""SELECT {head}'{name}' AS metric, round({num} * 1.0 / {den}, 8) AS value,
      CAST({num} AS BIGINT) AS numerator, CAST({den} AS BIGINT) AS denominator
    FROM {source}{group}"""


_RETAINED = "fct_customer_orders WHERE is_observable_30d AND NOT is_test_account"
_METRICS = {
    "item_fill_rate": ("fct_order_items", "count(*) FILTER (NOT was_stocked_out)", "count(*)"),
    "order_fill_rate": ("clean_orders", "count(*) FILTER (is_clean_order)", "count(*)"),
    "repeat_rate_30d": (
        f"(SELECT * FROM {_RETAINED})", "count(*) FILTER (repeat_within_30d)", "count(*)"),
    "conversion_rate": ("fct_sessions", "count(*) FILTER (converted)", "count(*)"),
    "substitution_rate": (
        "(SELECT * FROM clean_orders WHERE had_stockout)",
        "count(*) FILTER (substitute_offered)", "count(*)"),
    "high_intent_stockout_rate": (
        "clean_orders", "count(*) FILTER (had_high_intent_stockout)", "count(*)"),
    "ingestion_lag_minutes": (
        "fct_orders", "sum(ingestion_lag_minutes)", "count(ingestion_lag_minutes)"),
    "late_share": ("fct_orders", "count(*) FILTER (is_late_arriving)", "count(*)"),
}


def _check(check: str, table: str, column: str, violations: str) -> str:
    return (
        f"SELECT '{check}' AS \"check\", '{table}' AS table_name, '{column}' AS column_name, "
        f"count(*) AS n_violations, count(*) = 0 AS passed FROM ({violations})"
    )


# The declared checks, stated here once more so that a lost one shows.
_UNIQUE = (
    ("fct_orders", "order_id"),
    ("dim_product", "product_key"),
    ("dim_darkstore", "darkstore_key"),
    ("dim_customer", "customer_key"),
    ("fct_customer_orders", "order_id"),
    ("fct_sessions", "session_id"),
)
_PRESENT = (
    *_UNIQUE,
    ("fct_orders", "customer_id"),
    ("fct_orders", "darkstore_key"),
    ("fct_orders", "n_items"),
    ("fct_order_items", "product_key"),
    ("fct_order_items", "category"),
)


def _quality(of: str = "") -> str:
    """All checks over the tables whose names start with ``of``."""
    parts = [
        _check("unique", t, c, f"SELECT {c} FROM {of}{t} GROUP BY {c} HAVING count(*) > 1")
        for t, c in _UNIQUE
    ]
    parts += [
        _check("not_null", t, c, f"SELECT 1 FROM {of}{t} WHERE {c} IS NULL") for t, c in _PRESENT
    ]
    parts += [
        _check("accepted_values", "fct_customer_orders", "tenure",
               f"SELECT 1 FROM {of}fct_customer_orders WHERE tenure NOT IN ('new', 'established')"),
        _check("accepted_values", "fct_sessions", "variant",
               f"SELECT 1 FROM {of}fct_sessions WHERE variant NOT IN ('control', 'treatment')"),
        _check("relationship", "fct_orders", "customer_id",
               f"SELECT DISTINCT customer_id FROM {of}fct_orders WHERE customer_id NOT IN "
               f"(SELECT customer_id FROM {of}dim_customer)"),
        _check("range", "fct_orders", "item_fill_rate",
               f"SELECT 1 FROM {of}fct_orders WHERE item_fill_rate NOT BETWEEN 0 AND 1"),
        _check("any_flagged", "dim_customer", "is_test_account",
               f"SELECT 1 WHERE NOT EXISTS (FROM {of}dim_customer WHERE is_test_account)"),
        _check("fill_order", "fct_orders", "order_date_gst",
               f"SELECT order_date_gst FROM {of}fct_orders GROUP BY order_date_gst HAVING "
               "avg(CAST(is_clean_order AS INT)) > avg(item_fill_rate) + 1e-9"),
        _check("not_censored", "fct_customer_orders", "is_observable_30d",
               f"SELECT 1 FROM {of}fct_customer_orders WHERE is_observable_30d AND "
               f"order_date_gst > (SELECT max(order_date_gst) FROM {of}fct_orders) - {_W}"),
        _check("no_overlap", "dim_product", "product_id",
               "SELECT 1 FROM (SELECT valid_from, max(valid_to) OVER (PARTITION BY product_id "
               "ORDER BY valid_from, valid_to ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) "
               f"AS covered FROM {of}dim_product WHERE valid_from < valid_to) "
               "WHERE valid_from < covered"),
        _check("version_found", "fct_order_items", "product_key",
               f"SELECT 1 FROM {of}fct_order_items WHERE product_key IS NULL"),
    ]
    return " UNION ALL ".join(parts)


def _spoil(table: str, number: str, change: str, repeat: int, key: str, lose: int) -> str:
    changed = f"SELECT * REPLACE ({change}) FROM {table}" if change else f"SELECT * FROM {table}"
    return f"""bad_{table} AS ({changed}
      UNION ALL SELECT * FROM {table} WHERE {number} % {repeat} = 0
      UNION ALL SELECT * REPLACE (NULL AS {key}) FROM {table} WHERE {number} % {lose} = 0)"""


def _broken() -> str:
    tables = [
        _spoil("fct_orders", "order_id", """CASE WHEN order_id % 11 = 0 THEN NULL
            WHEN order_id % 13 = 0 THEN -1 - customer_id % 5 ELSE customer_id END AS customer_id,
          CASE WHEN order_id % 17 <> 0 THEN darkstore_key END AS darkstore_key,
          CASE WHEN order_id % 19 <> 0 THEN n_items END AS n_items,
          CASE WHEN order_id % 23 = 0 THEN 2.0 ELSE item_fill_rate END AS item_fill_rate,
          is_clean_order OR day(order_date_gst) = 3 AS is_clean_order""", 7, "order_id", 29),
        _spoil("fct_customer_orders", "order_id", """CASE WHEN order_id % 3 = 0 THEN 'old'
            ELSE tenure END AS tenure, true AS is_observable_30d""", 7, "order_id", 29),
        _spoil("fct_sessions", "session_id", """CASE WHEN session_id % 3 = 0 THEN 'x'
            ELSE variant END AS variant""", 7, "session_id", 29),
        _spoil("dim_product", "product_id", "", 5, "product_key", 31),
        _spoil("dim_darkstore", "darkstore_id", "", 5, "darkstore_key", 7),
        _spoil("(SELECT * REPLACE (false AS is_test_account) FROM dim_customer)", "customer_id",
               "", 9, "customer_key", 10).replace(
            "bad_(SELECT * REPLACE (false AS is_test_account) FROM dim_customer)",
            "bad_dim_customer"),
        """bad_fct_order_items AS (SELECT * REPLACE (
          CASE WHEN order_id % 11 <> 0 THEN product_key END AS product_key,
          CASE WHEN order_id % 13 <> 0 THEN category END AS category) FROM fct_order_items)""",
    ]
    return f"WITH {', '.join(tables)} {_quality('bad_')}"


_STORE_FILL = """(SELECT darkstore_id, count(*) AS orders,
    round(avg(CAST(is_clean_order AS INT)), 8) AS order_fill FROM {} GROUP BY darkstore_id)"""
_UNFLAGGED = """(SELECT * FROM clean_orders WHERE customer_id IN
    (SELECT customer_id FROM dim_customer WHERE NOT is_test_account))"""


def _store_metrics(source: str) -> str:
    inner = _STORE_FILL.format(source)
    return f"""(SELECT CAST(darkstore_id AS VARCHAR) AS group_by, 'orders' AS metric,
        CAST(orders AS DOUBLE) AS v FROM {inner}
      UNION ALL SELECT CAST(darkstore_id AS VARCHAR), 'order_fill', order_fill FROM {inner})"""


_SEQUENCE = "SELECT * FROM order_sequence"
_CALENDAR = """SELECT d AS date_gst, year(d) AS year, month(d) AS month, day(d)
        AS day_of_month, dayofweek(d) AS day_of_week, dayname(d) AS day_name,
        CAST(date_trunc('week', d) AS DATE) AS week_start,
        CAST(date_trunc('month', d) AS DATE) AS month_start,
        dayname(d) IN ('Saturday', 'Sunday') AS is_weekend,
        day(d) >= 25 OR day(d) <= 2 AS is_payday_window
      FROM (SELECT CAST(unnest(generate_series(min(order_date_gst), max(order_date_gst),
              INTERVAL 1 DAY)) AS DATE) AS d FROM stg_orders)"""
_TRUE_TENURE = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in TRUE_EFFECTS.items())
_TRUE_SWAP = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in TRUE_REPAIR.items())
_NEAR = f"""SELECT tenure, effect_pp, ci_lo, ci_hi, true_pp,
    true_pp BETWEEN ci_lo - 4 AND ci_hi + 4 AS within_tolerance
  FROM (SELECT tenure, {_gap(*_COUNTS)} FROM tenure_effects)
  JOIN (VALUES {_TRUE_TENURE}) t(tenure, true_pp) USING (tenure)"""
_EXPOSED_GAP = f"SELECT {_gap('st', 'srt', 'sc', 'src')} FROM arms"
_ITT_READOUT = f"""SELECT 'assigned' AS population, nc AS n_control, nt AS n_treatment,
        {_gap("nt", "rt", "nc", "rc")}, round({_yates("nt", "rt", "nc", "rc")}, 4) AS chi2
      FROM arms"""
_CHI = "power(n - want, 2) / want"
_WELCH = "(vc / cc + vt / ct)"

_BODIES = {
    # --- sources and sinks
    "landing_counts": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS n_rows FROM {source}"
        for name, source in {
            "raw_customers": "customer",
            "raw_products": "product_changes",
            "raw_darkstores": "stg_darkstores",
            "raw_order_events": "raw_order_events",
            "raw_order_items": "lineitem",
            "raw_fulfilment_events": "raw_fulfilment",
            "raw_sessions": "raw_sessions",
            "raw_experiment_assignments": "visits",
        }.items()
    ),
    "source_catalog": """SELECT * FROM (VALUES
        ('raw_customers', 'one row per customer', 'daily', 'CRM',
          (SELECT count(*) FROM customer)),
        ('raw_products', 'product_id + valid_from', 'daily', 'catalogue',
          (SELECT count(*) FROM product_changes)),
        ('raw_darkstores', 'darkstore_id + valid_from', 'ad hoc', 'ops',
          (SELECT count(*) FROM stg_darkstores)),
        ('raw_order_events', 'one row per event', 'real-time', 'order service',
          (SELECT count(*) FROM raw_order_events)),
        ('raw_order_items', 'order_id + product_id', 'real-time', 'order service',
          (SELECT count(*) FROM lineitem)),
        ('raw_fulfilment_events', 'one row per order', 'up to 6h', 'warehouse ops',
          (SELECT count(*) FROM raw_fulfilment)),
        ('raw_sessions', 'one row per session', 'real-time', 'app analytics',
          (SELECT count(*) FROM raw_sessions)),
        ('raw_experiment_assignments', 'one row per session', 'real-time', 'experimentation',
          (SELECT count(*) FROM visits))) t(table_name, grain, latency, owner, n_rows)""",
    "fact_layout": """SELECT CAST(date_trunc('month', order_date_gst) AS DATE) AS order_month,
        count(*) AS orders, CAST(sum(n_items) AS BIGINT) AS items,
        round(sum(gross_value_aed), 3) AS gross_value_aed FROM fct_orders GROUP BY ALL""",
    "lookback_overwrite": f"""SELECT m AS order_month, count(*) AS orders,
        count(*) FILTER (is_late_arriving) AS late_orders
      FROM (SELECT CAST(date_trunc('month', order_date_gst) AS DATE) AS m, is_late_arriving
            FROM fct_orders)
      WHERE NOT is_late_arriving OR m > (SELECT CAST(date_trunc('month', max(order_date_gst))
        AS DATE) FROM fct_orders) - {LOOKBACK_DAYS}
      GROUP BY m""",
    "lookback_lost_day": """SELECT m AS order_month, count(*) AS orders
      FROM (SELECT CAST(date_trunc('month', order_date_gst) AS DATE) AS m FROM fct_orders)
      WHERE m <> (SELECT CAST(date_trunc('month', max(order_date_gst)) AS DATE)
        FROM fct_orders) - INTERVAL 1 MONTH
      GROUP BY m""",
    "lookback_late_run": f"""SELECT m AS order_month, count(*) AS orders,
        count(*) FILTER (is_late_arriving) AS late_orders
      FROM (SELECT CAST(date_trunc('month', order_date_gst) AS DATE) AS m, is_late_arriving,
              CAST(date_trunc('month', max(order_date_gst) OVER ()) - INTERVAL {LATE_MONTHS} MONTH AS DATE) AS last
            FROM fct_orders)
      WHERE NOT is_late_arriving OR m > last OR m <= last - {LOOKBACK_DAYS}
      GROUP BY m""",
    "metric_table": f"""
      WITH b AS (SELECT {_BAND} AS band, {_FILL} FROM clean_orders GROUP BY band),
      t AS (SELECT coalesce(tenure, 'all') AS band, n, effect_pp, ci_lo, ci_hi
            FROM (SELECT tenure, n, {_gap(*_COUNTS)} FROM
              (SELECT tenure, {_ARMS}, count(*) AS n FROM focal
               GROUP BY GROUPING SETS ((), (tenure)))))
      SELECT 'grain_by_band' AS section, metric, band AS group_by, value,
        CAST(NULL AS DOUBLE) AS ci_lo, CAST(NULL AS DOUBLE) AS ci_hi, orders AS n
      FROM (UNPIVOT (SELECT band, orders, order_fill, item_fill_macro, item_fill_micro,
              mean_basket FROM b)
            ON order_fill, item_fill_macro, item_fill_micro, mean_basket
            INTO NAME metric VALUE value)
      UNION ALL SELECT 'stockout', 'effect_pp', band, effect_pp, ci_lo, ci_hi, n FROM t""",
    # --- staging and dimensions
    "stage_customers": """SELECT customer_id, segment, acquired_on, home_darkstore_id,
        is_test_account_source_flag FROM dim_customer""",
    "stage_products": """SELECT * REPLACE (round(base_price_aed, 8) AS base_price_aed)
      FROM stg_products""",
    "stage_darkstores": "SELECT * FROM stg_darkstores",
    "stage_orders": "SELECT * FROM stg_orders",
    "stage_order_items": "SELECT * FROM raw_order_items",
    "ingest_lag": "SELECT * FROM stg_fulfilment",
    "stage_sessions": """SELECT session_id, customer_id, started_at_utc,
        started_at_utc + INTERVAL 4 HOUR AS started_at_gst,
        CAST(started_at_utc + INTERVAL 4 HOUR AS DATE) AS session_date_gst, converted, order_id
      FROM raw_sessions""",
    "stage_assignments": """SELECT k * 2 AS session_id, customer_id, variant,
        moment AS assigned_at_utc, moment + INTERVAL 4 HOUR AS assigned_at_gst FROM visits""",
    "dedup_events": """SELECT order_id, any_value(customer_id) AS customer_id,
        any_value(darkstore_id) AS darkstore_id, event_type, min(event_at_utc) AS event_at_utc
      FROM raw_order_events GROUP BY order_id, event_type""",
    "dim_product": """SELECT * REPLACE (round(base_price_aed, 8) AS base_price_aed)
      FROM dim_product""",
    "dim_darkstore": "SELECT * FROM dim_darkstore",
    "dim_customer": "SELECT * FROM dim_customer",
    "calendar": _CALENDAR,
    "dim_date": _CALENDAR,
    "scd2_products": """SELECT product_id, category, moment AS valid_from,
        round(base_price_aed, 8) AS base_price_aed,
        lead(moment) OVER (PARTITION BY product_id ORDER BY moment) AS valid_to,
        lead(moment) OVER (PARTITION BY product_id ORDER BY moment) IS NULL AS is_current
      FROM product_changes""",
    "scd2_price_asof": """SELECT p.category, p.is_current, count(*) AS lines,
        round(sum(i.quantity * p.base_price_aed), 3) AS value_aed
      FROM raw_order_items i JOIN stg_orders o USING (order_id)
      ASOF JOIN stg_products p
        ON p.product_id = i.product_id AND o.order_date_gst >= p.valid_from
      GROUP BY ALL""",
    "scd2_overlaps": """WITH v AS (SELECT * REPLACE (CASE WHEN is_current THEN valid_to
          ELSE CAST(valid_to + 30 AS DATE) END AS valid_to) FROM dim_product)
      SELECT b.product_id, b.valid_from, b.valid_to, max(a.valid_to) AS covered_until
      FROM v a JOIN v b ON a.product_id = b.product_id AND a.product_key <> b.product_key
        AND a.valid_from < b.valid_from AND b.valid_from < a.valid_to
      GROUP BY ALL""",
    "scd2_overlap_pairs": """WITH v AS (SELECT * REPLACE (CASE WHEN is_current THEN valid_to
          ELSE CAST(valid_to + 30 AS DATE) END AS valid_to) FROM dim_product)
      SELECT a.product_id, a.valid_from AS valid_from_a, a.valid_to AS valid_to_a,
        b.valid_from AS valid_from_b, b.valid_to AS valid_to_b
      FROM v a JOIN v b ON a.product_id = b.product_id AND a.valid_from < b.valid_from
        AND b.valid_from < a.valid_to""",
    "scd2_asof_many_versions": """
      WITH l AS (SELECT product_id % 3 AS key, CAST(order_date_gst + (product_id % 5)::INT AS DATE) AS day,
          order_date_gst AS since, quantity FROM fct_order_items),
      v AS (SELECT key, since, units, lead(since) OVER (PARTITION BY key ORDER BY since) AS until
        FROM (SELECT key, since, sum(quantity) AS units FROM l GROUP BY ALL)),
      p AS (SELECT l.key, l.day,
          CASE WHEN l.day < least(v.until, CAST(v.since + 2 AS DATE)) THEN v.units END AS units
        FROM l ASOF LEFT JOIN v ON l.key = v.key AND l.day >= v.since)
      SELECT key, CAST(date_trunc('month', day) AS DATE) AS month, count(*) AS lines,
        count(units) AS dated, CAST(sum(units) AS BIGINT) AS units
      FROM p GROUP BY ALL""",
    # --- facts
    "order_items_fact": """SELECT * REPLACE (round(base_price_aed, 8) AS base_price_aed,
        round(line_value_aed, 8) AS line_value_aed) FROM fct_order_items""",
    "orders_fact": """SELECT * REPLACE (round(gross_value_aed, 8) AS gross_value_aed,
        round(item_fill_rate, 8) AS item_fill_rate) FROM fct_orders""",
    "customer_sequence": _SEQUENCE,
    "customer_sequence_split": _SEQUENCE,
    "customer_sequence_batch": """WITH moved AS (SELECT order_id,
          CASE WHEN customer_id % 3 = 0 THEN -1 ELSE customer_id END AS customer_id,
          CASE WHEN customer_id % 3 = 0 AND order_id % 2 = 0
               THEN TIMESTAMP '2026-02-01 12:00:00' ELSE ordered_at_gst END AS ordered_at_gst
        FROM stg_orders WHERE NOT is_cancelled)
      SELECT order_id, customer_id, row_number() OVER s AS order_seq,
        count(*) OVER (PARTITION BY customer_id) AS customer_lifetime_orders,
        lead(ordered_at_gst) OVER s AS next_ordered_at_gst,
        lag(ordered_at_gst) OVER s AS prev_ordered_at_gst,
        date_diff('day', ordered_at_gst, lead(ordered_at_gst) OVER s) AS days_to_next_order
      FROM moved WINDOW s AS (PARTITION BY customer_id ORDER BY ordered_at_gst, order_id)""",
    "customer_sequence_lookback": f"""WITH kept AS (
        SELECT order_id, customer_id, ordered_at_gst, order_date_gst, is_late_arriving FROM fct_orders
        WHERE NOT is_cancelled AND (NOT is_late_arriving OR order_date_gst >
          (SELECT max(order_date_gst) FROM fct_orders WHERE NOT is_cancelled) - {LOOKBACK_DAYS}))
      SELECT *, row_number() OVER s AS order_seq,
        count(*) OVER (PARTITION BY customer_id) AS customer_lifetime_orders,
        lead(ordered_at_gst) OVER s AS next_ordered_at_gst,
        lag(ordered_at_gst) OVER s AS prev_ordered_at_gst,
        row_number() OVER s - 1 AS prior_order_count,
        date_diff('day', ordered_at_gst, lead(ordered_at_gst) OVER s) AS days_to_next_order
      FROM kept WINDOW s AS (PARTITION BY customer_id ORDER BY ordered_at_gst, order_id)""",
    "customer_orders_fact": """SELECT * REPLACE (round(gross_value_aed, 8) AS gross_value_aed,
        round(item_fill_rate, 8) AS item_fill_rate) FROM fct_customer_orders""",
    "sessions_fact": """SELECT * REPLACE (round(gross_value_aed, 8) AS gross_value_aed)
      FROM fct_sessions""",
    "flagged_account_orders": """SELECT CASE WHEN is_test_account THEN 'flagged' ELSE 'others'
        END AS accounts, count(*) AS orders, CAST(sum(n_items) AS BIGINT) AS items
      FROM fct_orders JOIN dim_customer USING (customer_id) GROUP BY ALL""",
    "densified_daily_orders": """WITH d AS (SELECT CAST(unnest(generate_series(
          min(order_date_gst), max(order_date_gst), INTERVAL 1 DAY)) AS DATE) AS day
        FROM stg_orders),
      n AS (SELECT darkstore_id, order_date_gst, count(*) AS orders, sum(n_items) AS items
        FROM fct_orders GROUP BY ALL)
      SELECT s.darkstore_id, day AS order_date_gst, coalesce(orders, 0) AS orders,
        CAST(coalesce(items, 0) AS BIGINT) AS items
      FROM (SELECT DISTINCT darkstore_id FROM fct_orders) s CROSS JOIN d
      LEFT JOIN n ON n.darkstore_id = s.darkstore_id AND n.order_date_gst = day""",
    # --- outliers and profiles
    "mad_outliers": """SELECT customer_id, order_count, active_days,
        round(orders_per_active_day, 8) AS orders_per_active_day, med AS med_orders,
        mad AS mad_orders, round(threshold, 8) AS threshold, is_test_account FROM accounts""",
    "threshold_sweep": f"""SELECT k, round(t, 8) AS threshold,
        CAST(sum(CAST(order_count > t AS INT)) AS BIGINT) AS flagged,
        round(count(*) FILTER (order_count > t AND is_heavy) * 1.0
          / nullif(count(*) FILTER (order_count > t), 0), 8) AS precision,
        round(count(*) FILTER (order_count > t AND is_heavy) * 1.0
          / nullif(count(*) FILTER (is_heavy), 0), 8) AS recall
      FROM (SELECT k, med + k * 1.4826 * nullif(mad, 0) AS t, order_count, is_heavy
            FROM robust, (SELECT CAST(unnest({list(SWEEP)}) AS DOUBLE) AS k),
            activity LEFT JOIN truth USING (customer_id))
      GROUP BY k, t""",
    "quantile_profiles": " UNION ALL ".join(
        f"""SELECT coalesce(is_heavy, false) AS is_heavy, '{col}' AS feature, count(*) AS n,
          round(CAST(min({col}) AS DOUBLE), 8) AS lowest,
          round(CAST(median({col}) AS DOUBLE), 8) AS median,
          round(CAST(quantile_cont({col}, 0.99) AS DOUBLE), 8) AS p99,
          round(CAST(max({col}) AS DOUBLE), 8) AS highest
        FROM activity LEFT JOIN truth USING (customer_id) GROUP BY 1"""
        for col in ("order_count", "orders_per_active_day")
    ),
    "score_flag": """SELECT tp AS true_positive, fp AS false_positive, fn AS false_negative,
        tn AS true_negative, round(tp * 1.0 / nullif(tp + fp, 0), 8) AS precision,
        round(tp * 1.0 / nullif(tp + fn, 0), 8) AS recall
      FROM (SELECT count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp,
          count(*) FILTER (NOT p AND t) AS fn, count(*) FILTER (NOT p AND NOT t) AS tn
        FROM (SELECT coalesce(is_test_account, false) AS p, coalesce(is_heavy, false) AS t
              FROM dim_customer FULL JOIN truth USING (customer_id)))""",
    "duplicate_share": """SELECT n_rows, n_keys,
        round((n_rows - n_keys) * 1.0 / n_rows, 8) AS duplicate_share
      FROM (SELECT count(*) AS n_rows, count(DISTINCT (order_id, event_type)) AS n_keys
            FROM raw_order_events)""",
    "day_shift_share": """SELECT count(*) AS n_rows, count(*) FILTER (moved) AS n_moved,
        round(avg(CAST(moved AS INT)), 8) AS moved_share
      FROM (SELECT hour(ordered_at_utc) >= 20 AS moved FROM stg_orders)""",
    # --- grain
    "grain_summary": f"SELECT {_FILL_GAP} FROM clean_orders",
    "grain_summary_unflagged": f"SELECT {_FILL_GAP} FROM {_UNFLAGGED}",
    "grain_by_store": f"SELECT darkstore_id, {_FILL_GAP} FROM clean_orders GROUP BY ALL",
    "grain_by_band": f"""SELECT {_BAND} AS basket_band,
        CAST(1 + CAST(n_items > 3 AS INT) + CAST(n_items > 6 AS INT)
          + CAST(n_items > 10 AS INT) + CAST(n_items > 15 AS INT) AS INT) AS ord, {_FILL}
      FROM clean_orders GROUP BY basket_band, ord""",
    "fill_by_day": f"SELECT order_date_gst, {_FILL} FROM fct_orders GROUP BY order_date_gst",
    "identity_gap": """SELECT round(1 - f, 8) AS item_miss_rate, round(b, 8) AS mean_basket,
        round(o, 8) AS order_fill, round(power(f, b), 8) AS identity_at_mean,
        round(100 * (o - power(f, b)), 8) AS gap_pp
      FROM (SELECT avg(item_fill_rate) AS f, avg(n_items) AS b,
              avg(CAST(is_clean_order AS INT)) AS o FROM clean_orders)""",
    "fill_curve": f"""SELECT darkstore_id, round(1 - f, 8) AS item_miss_rate,
        CAST(n AS INT) AS n_items, round(power(f, n), 8) AS order_fill
      FROM (SELECT darkstore_id, avg(item_fill_rate) AS f FROM clean_orders GROUP BY ALL),
        range(1, {CURVE_MAX + 1}) r(n)""",
    "required_miss": f"""SELECT n_items, count(*) AS orders,
        round(1 - power({FILL_TARGET}, 1.0 / n_items), 8) AS required_miss,
        round(power({FILL_TARGET}, 1.0 / n_items), 8) AS required_item_fill,
        1 - power({FILL_TARGET}, 1.0 / n_items) < 0.005 AS is_infeasible
      FROM clean_orders GROUP BY n_items""",
    # --- effects
    "effect_pooled": f"""SELECT {_ROWS}, n, round(n_treated * 1.0 / n, 8) AS treated_share,
        {_gap(*_COUNTS)} FROM (SELECT {_ARMS}, count(*) AS n FROM focal)""",
    "effect_by_tenure": _effect_sets("(), (tenure)", "tenure"),
    "effect_by_segment": _effect_sets(
        "(), (segment), (tenure), (segment, tenure)", "segment, tenure"
    ),
    "repeat_rates": """SELECT segment, had_stockout, count(*) AS n,
        round(avg(CAST(repeated AS INT)), 8) AS rate FROM focal GROUP BY ALL""",
    "quantile_buckets": """SELECT basket_q, count(*) AS orders, min(n_items) AS smallest,
        max(n_items) AS largest FROM strata GROUP BY basket_q""",
    "quantile_buckets_by_segment": """
      WITH e AS (SELECT segment, list_sort(list_distinct(
          quantile_cont(n_items, [0, 0.25, 0.5, 0.75, 1.0]))) AS e FROM focal GROUP BY segment),
      b AS (SELECT focal.segment, n_items,
          CAST(len(list_filter(e[2:-2], lambda x: x < n_items)) AS INT) AS bucket
        FROM focal JOIN e ON e.segment = focal.segment)
      SELECT segment, bucket, count(*) AS orders, min(n_items) AS smallest,
        max(n_items) AS largest FROM b GROUP BY ALL""",
    "value_buckets": """
      WITH v AS (SELECT round(gross_value_aed, 2) AS v FROM clean_orders),
      e AS (SELECT list_sort(list_distinct(quantile_cont(v, [i / 10.0 for i in range(11)]))) AS e FROM v),
      b AS (SELECT v, CAST(len(list_filter(e[2:-2], lambda x: x < v)) AS INT) AS bucket FROM v, e)
      SELECT bucket, count(*) AS orders, min(v) AS smallest, max(v) AS largest FROM b GROUP BY bucket""",
    "value_profile_by_store": """SELECT darkstore_id, count(v) AS n, min(v) AS lowest,
        round(median(v), 8) AS median, round(quantile_cont(v, 0.99), 8) AS p99, max(v) AS highest
      FROM (SELECT darkstore_id, round(gross_value_aed, 2) AS v FROM clean_orders) GROUP BY 1""",
    "value_outliers": """
      WITH v AS (SELECT round(gross_value_aed, 2) AS v FROM clean_orders),
      m AS (SELECT median(v) AS med FROM v),
      s AS (SELECT med, median(abs(v - med)) AS mad FROM v, m GROUP BY med)
      SELECT round(med, 8) AS med, round(mad, 8) AS mad, count(*) AS orders,
        count(*) FILTER (v > med + 3 * 1.4826 * nullif(mad, 0)) AS outliers
      FROM v, s GROUP BY med, mad""",
    "stratified_effect": f"""WITH s AS (SELECT basket_q, {_ARMS}, count(*) AS n FROM strata
          GROUP BY basket_q),
      a AS (SELECT count(*) AS n_strata,
          100.0 * sum(k_treated) / sum(n_treated) - 100.0 * sum(k_control) / sum(n_control) AS d,
          sum(n * (100.0 * k_treated / n_treated - 100.0 * k_control / n_control)) / sum(n) AS w
        FROM s)
      SELECT n_strata, round(d, 8) AS naive_pp, round(w, 8) AS stratified_pp,
        round(w - d, 8) AS shift_pp FROM a""",
    "exposure_gradient": """SELECT basket_q, count(*) AS n, round(avg(n_items), 8) AS mean_size,
        round(avg(CAST(had_stockout AS INT)), 8) AS exposure_rate,
        round(avg(CAST(repeated AS INT)) FILTER (NOT had_stockout), 8) AS baseline_rate
      FROM strata GROUP BY basket_q""",
    "high_intent_effect": f"""SELECT {_ROWS}, n, round(n_treated * 1.0 / n, 8) AS treated_share,
        {_gap(*_COUNTS)}
      FROM (SELECT {_ARMS.replace("had_stockout", "had_high_intent_stockout")}, count(*) AS n
            FROM exposed)""",
    "offer_arms": """SELECT offer_arm, count(*) AS n, round(avg(CAST(repeated AS INT)), 8) AS rate
      FROM exposed GROUP BY offer_arm""",
    "arm_contrast_by_segment": f"""SELECT segment, {_ROWS}, {_gap(*_COUNTS)}
      FROM (SELECT segment, count(*) FILTER (offer_arm = 'accepted') AS n_treated,
          count(*) FILTER (offer_arm = 'accepted' AND repeated) AS k_treated,
          count(*) FILTER (offer_arm = 'declined') AS n_control,
          count(*) FILTER (offer_arm = 'declined' AND repeated) AS k_control
        FROM exposed WHERE offer_arm <> 'not_offered' GROUP BY segment)""",
    "proxy_contrasts": f"SELECT proxy, substitution_type, {_ROWS}, {_gap(*_COUNTS)} FROM proxies",
    "proxy_spread": """SELECT round(max(p), 8) AS best_pp, round(min(p), 8) AS worst_pp,
        round(max(p) - min(p), 8) AS spread_pp
      FROM (SELECT 100.0 * k_treated / n_treated - 100.0 * k_control / n_control AS p
            FROM proxies)""",
    "contrast_by_type": f"""SELECT *, CASE WHEN ci_lo < 0 AND ci_hi > 0 THEN 'indistinguishable'
        ELSE 'distinct' END AS verdict
      FROM (SELECT control, substitution_type, {_ROWS}, {_gap(*_COUNTS)} FROM swap_effects)""",
    "rank_effects": """SELECT control, substitution_type, round(pp, 8) AS effect_pp,
        CAST(row_number() OVER (PARTITION BY control ORDER BY pp DESC) AS INT) AS rank
      FROM swap_effects""",
    "ranking_stability": """SELECT control, ranking,
        (SELECT count(DISTINCT ranking) = 1 AND count(*) > 1 FROM rankings) AS is_stable
      FROM rankings""",
    "break_even": """SELECT tenure, round(lost, 4) AS lost_per_month,
        round(lost * 400, 4) AS value_month, round(lost * 4800, 4) AS value_year,
        round(lost * 2400, 4) AS value_year_realistic,
        round(round_even(lost * 400 / um, 0) * um, 4) AS value_month_2sig,
        round(round_even(lost * 4800 / uy, 0) * uy, 4) AS value_year_2sig,
        round(round_even(lost * 2400 / ur, 0) * ur, 4) AS value_year_realistic_2sig
      FROM (SELECT tenure, lost, power(10, ceil(log10(lost * 400)) - 2) AS um,
          power(10, ceil(log10(lost * 4800)) - 2) AS uy,
          power(10, ceil(log10(lost * 2400)) - 2) AS ur
        FROM (SELECT tenure, 5000 * treated_share * size_pp / 100 AS lost
              FROM tenure_points))""",
    "effect_ratio": """SELECT round(a.size_pp / b.size_pp, 8) AS effect_ratio,
        round(a.n * 1.0 / (a.n + b.n), 8) AS focal_share
      FROM tenure_points a, tenure_points b
      WHERE a.tenure = 'new' AND b.tenure = 'established'""",
    "orders_lost": """SELECT tenure, round(f, 4) AS order_fill,
        round(1000 * (1 - f), 4) AS broken_orders,
        round(1000 * (1 - f) * size_pp / 100, 4) AS orders_lost
      FROM tenure_points, (SELECT avg(CAST(is_clean_order AS INT)) AS f FROM clean_orders)""",
    # --- statistics and the experiment
    "srm_counts_chi2": _srm("", "nc", "nt", "arms", "'assigned' AS stage, ")
    + " UNION ALL "
    + _srm("", "cc", "ct", "arms", "'checkout' AS stage, "),
    "srm_by_week": _srm("", "nc", "nt", "event_arms", "week, "),
    "crosstab2": """SELECT week, variant, count(*) FILTER (NOT converted) AS n_without,
        count(*) FILTER (converted) AS n_with FROM event_frame GROUP BY ALL""",
    "chi2_2x2": f"""SELECT week, CAST(round({_yates("nt", "ct", "nc", "cc")}, 4) AS DOUBLE)
        AS chi2, 1 AS df FROM event_arms""",
    "welch_t_stat": f"""SELECT round(mc, 8) AS mean_control, round(mt, 8) AS mean_treatment,
        round((mc - mt) / sqrt({_WELCH}), 4) AS welch_t,
        round(power({_WELCH}, 2) / (power(vc / cc, 2) / (cc - 1) + power(vt / ct, 2) / (ct - 1)),
          4) AS df FROM arms""",
    "welch_t_events": """SELECT week, round(a, 8) AS mean_first, round(b, 8) AS mean_second,
        round((a - b) / sqrt(va / na + vb / nb), 4) AS welch_t,
        round(power(va / na + vb / nb, 2)
          / (power(va / na, 2) / (na - 1) + power(vb / nb, 2) / (nb - 1)), 4) AS df
      FROM (SELECT week, avg(value) FILTER (variant = 'control') AS a,
          avg(value) FILTER (variant = 'treatment') AS b,
          var_samp(value) FILTER (variant = 'control') AS va,
          var_samp(value) FILTER (variant = 'treatment') AS vb,
          count(*) FILTER (variant = 'control') AS na,
          count(*) FILTER (variant = 'treatment') AS nb
        FROM event_frame GROUP BY week)""",
    "spearman_rho": f"""WITH b AS (SELECT {_BAND} AS band, min(n_items) AS o,
          avg(item_fill_rate) AS f, avg(CAST(is_clean_order AS INT)) AS c
        FROM clean_orders GROUP BY band),
      r AS (SELECT rank() OVER (ORDER BY o) AS ro,
          rank() OVER (ORDER BY f) + (count(*) OVER (PARTITION BY f) - 1) / 2.0 AS rf,
          rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0 AS rc FROM b)
      SELECT count(*) AS n_groups, round(corr(ro, rf), 8) AS rho, 'item_fill_macro' AS rate FROM r
      UNION ALL SELECT count(*), round(corr(ro, rc), 8), 'order_fill' FROM r""",
    "spearman_customers": """WITH r AS (
        SELECT rank() OVER (ORDER BY order_count) + (count(*) OVER (PARTITION BY order_count) - 1) / 2.0 AS x,
          rank() OVER (ORDER BY orders_per_active_day)
            + (count(*) OVER (PARTITION BY orders_per_active_day) - 1) / 2.0 AS y
        FROM activity)
      SELECT count(*) AS n_groups, round(corr(x, y), 8) AS rho FROM r""",
    "mde": """SELECT least(nc, nt) AS n_per_arm, round(rc * 1.0 / nc, 8) AS baseline_rate,
        round((1.959963984540054 + 0.8416212335729143)
          * sqrt(2.0 * rc / nc * (1 - rc * 1.0 / nc) / least(nc, nt)) * 100, 8) AS mde_pp
      FROM arms""",
    "conversion_effect": f"""SELECT nc AS n_control, nt AS n_treatment,
        {_gap("nt", "ct", "nc", "cc")},
        round((ct * 1.0 / nt) / (cc * 1.0 / nc) - 1, 8) AS relative_loss,
        round({_yates("nt", "ct", "nc", "cc")}, 4) AS chi2 FROM arms""",
    "conversion_by_week": f"""SELECT week, nc AS n_control, nt AS n_treatment,
        {_gap("nt", "ct", "nc", "cc")},
        round((ct * 1.0 / nt) / (cc * 1.0 / nc) - 1, 8) AS relative_loss,
        round({_yates("nt", "ct", "nc", "cc")}, 4) AS chi2 FROM event_arms""",
    "itt_readout": _ITT_READOUT,
    "itt_readout_bucketed": _ITT_READOUT,
    "exposed_readout": f"""SELECT 'exposed' AS population, sc AS n_control, st AS n_treatment,
        {_gap("st", "srt", "sc", "src")}, round({_yates("st", "srt", "sc", "src")}, 4) AS chi2
      FROM arms""",
    # --- contracted metrics
    "business_metrics": " UNION ALL ".join(_metric(n, *spec) for n, spec in _METRICS.items()),
    "business_metrics_by_store": " UNION ALL ".join(
        _metric(n, *spec, by="darkstore_id")
        for n, spec in _METRICS.items()
        if n != "conversion_rate"
    ),
    "substitution_by_type": """SELECT CASE WHEN substitute_offered THEN substitution_type END
        AS substitution_type, count(*) AS n, round(count(*) * 1.0
          / (SELECT count(*) FROM clean_orders WHERE had_stockout), 8) AS value
      FROM clean_orders WHERE had_stockout GROUP BY 1""",
    "provisional_days": """SELECT order_date_gst,
        round(avg(ingestion_lag_minutes), 8) AS mean_lag_minutes,
        max(ingestion_lag_minutes) AS max_lag_minutes,
        round(avg(CAST(is_late_arriving AS INT)), 8) AS late_share,
        order_date_gst > (SELECT max(order_date_gst) FROM fct_orders) - 2 AS is_provisional
      FROM fct_orders GROUP BY order_date_gst""",
    "store_age": f"""SELECT CAST(floor(store_age_days_at_order / 365) AS BIGINT) AS store_years,
        {_FILL_GAP} FROM clean_orders GROUP BY store_years""",
    # --- checks and scoring
    "quality_checks": _quality(),
    "quality_checks_broken": _broken(),
    "within_tolerance": _NEAR,
    "rank_matches": f"""WITH r AS (SELECT substitution_type, round(pp, 8) AS effect_pp, repair,
          CAST(row_number() OVER (ORDER BY pp DESC) AS INT) AS estimated_rank,
          CAST(row_number() OVER (ORDER BY repair DESC) AS INT) AS true_rank
        FROM swap_effects JOIN (VALUES {_TRUE_SWAP}) t(substitution_type, repair)
          USING (substitution_type)
        WHERE control = 'B_vs_not_offered')
      SELECT *, (SELECT bool_and(estimated_rank = true_rank) FROM r) AS order_recovered
      FROM r""",
    "rank_matches_customers": """WITH r AS (
        SELECT customer_id, round(orders_per_active_day, 8) AS orders_per_active_day, order_count,
          CAST(row_number() OVER (ORDER BY orders_per_active_day DESC, customer_id) AS INT) AS estimated_rank,
          CAST(row_number() OVER (ORDER BY order_count DESC, customer_id) AS INT) AS true_rank
        FROM activity)
      SELECT *, (SELECT bool_and(estimated_rank = true_rank) FROM r) AS order_recovered FROM r""",
    "covers_zero": f"""SELECT 'exposed' AS population, effect_pp, ci_lo, ci_hi,
        0 BETWEEN ci_lo AND ci_hi AS covers FROM ({_EXPOSED_GAP})""",
    "srm_consistency": """SELECT a AS detected_at_assignment, e AS detected_at_exposure,
        NOT a AND e AS srm_consistent
      FROM (SELECT power(nc - nt, 2) * 1.0 / (nc + nt) > 10.827566170662733 AS a,
              power(cc - ct, 2) * 1.0 / (cc + ct) > 10.827566170662733 AS e FROM arms)""",
    "scorecard": f"""WITH s AS (
        SELECT 'effects_near_truth' AS "check", bool_and(within_tolerance) AS passed
        FROM ({_NEAR})
        UNION ALL SELECT 'tenure_order', bool_and(a = b) FROM (SELECT
          row_number() OVER (ORDER BY effect_pp DESC) AS a,
          row_number() OVER (ORDER BY true_pp DESC) AS b FROM ({_NEAR}))
        UNION ALL SELECT 'swap_order', bool_and(a = b) FROM (SELECT
          row_number() OVER (ORDER BY pp DESC) AS a,
          row_number() OVER (ORDER BY repair DESC) AS b
          FROM swap_effects JOIN (VALUES {_TRUE_SWAP}) t(substitution_type, repair)
            USING (substitution_type) WHERE control = 'B_vs_not_offered')
        UNION ALL SELECT 'ranking_stable', count(DISTINCT ranking) = 1 AND count(*) > 1
        FROM rankings
        UNION ALL SELECT 'zero_covered', 0 BETWEEN ci_lo AND ci_hi FROM ({_EXPOSED_GAP})
        UNION ALL SELECT 'srm_behaved', power(nc - nt, 2) * 1.0 / (nc + nt) <= 10.827566170662733
          AND power(cc - ct, 2) * 1.0 / (cc + ct) > 10.827566170662733 FROM arms)
      SELECT * FROM s UNION ALL SELECT 'overall', bool_and(passed) FROM s""",
    "metrics_drift": f"""SELECT 'grain' AS section, metric, group_by, a.v AS old_value,
        b.v AS new_value, CASE WHEN b.v IS NULL THEN 'removed' WHEN a.v IS NULL THEN 'added'
          ELSE 'changed' END AS status
      FROM {_store_metrics("clean_orders")} a
      FULL JOIN {_store_metrics(_UNFLAGGED)} b USING (group_by, metric)
      WHERE a.v IS DISTINCT FROM b.v""",
}



def _long(
    section: str,
    body: str,
    shown: dict[str, str],
    by: str = "'all'",
    n: str = "NULL",
    interval: bool = False,
) -> str:
    """One row per metric of a read-out that another twin states; see the metric table."""
    rows = []
    for i, (metric, column) in enumerate(shown.items()):
        lo, hi = ("ci_lo", "ci_hi") if interval and not i else ("NULL", "NULL")
        rows.append(
            f"""SELECT {section} AS section, {metric} AS metric, CAST({by} AS VARCHAR) AS group_by,
              round(CAST({column} AS DOUBLE), 4) AS value, round(CAST({lo} AS DOUBLE), 4) AS ci_lo,
              round(CAST({hi} AS DOUBLE), 4) AS ci_hi, CAST({n} AS BIGINT) AS n FROM ({body})"""
        )
    return " UNION ALL ".join(rows)


def _shown(*names: str, **renamed: str) -> dict[str, str]:
    return {f"'{n}'": n for n in names} | {f"'{k}'": v for k, v in renamed.items()}


def _experiment_twin(b: dict[str, str]) -> str:
    gap = _shown("effect_pp", "n_control", "n_treatment", control="rate_control",
                 treatment="rate_treated")
    split = _shown("chi2", "n_control", "n_treatment", "expected_share",
                   control_share="observed_share", detected="CAST(srm_detected AS INT)")
    readouts = [
        _long(f"'readout_{who}'", b[name], gap, interval=True)
        for who, name in (("assigned", "itt_readout"), ("exposed", "exposed_readout"))
    ]
    return " UNION ALL ".join([
        _long("'power'", b["mde"], _shown("mde_pp", "n_per_arm", "baseline_rate"), n="n_per_arm"),
        _long("'conversion'", b["conversion_effect"], gap | _shown("relative_loss"),
              interval=True),
        _long("'selection'", b["welch_t_stat"],
              _shown("welch_t", "df", "mean_control", "mean_treatment")),
        _long("'srm_' || stage", b["srm_counts_chi2"], split),
        *readouts,
    ])


def _analysis_twin(b: dict[str, str]) -> str:
    rates = ("orders", "mean_basket", "item_fill_macro", "item_fill_micro", "order_fill")
    stockout = _shown("effect_pp", stockout_share="treated_share", stockout_repeat="rate_treated",
                      clean_repeat="rate_control", population_at_risk="n_treated")
    swaps = _shown("effect_pp", "n_control", repeat_rate="rate_treated")
    effects = f"({b['effect_by_tenure']})"
    pooled = f"SELECT 'all' AS tenure, * FROM ({b['effect_pooled']})"
    groups = f"SELECT * FROM {effects} WHERE tenure IS NOT NULL UNION ALL {pooled}"
    return " UNION ALL ".join([
        _long("'grain'", b["grain_summary"], _shown(*rates, "items", "item_miss_rate", "gap_pp"),
              n="orders"),
        _long("'grain_by_band'", b["grain_by_band"], _shown(*rates), "basket_band", "orders"),
        _long("'grain'", b["spearman_rho"], {"rate || '_vs_basket_rho'": "rho"}),
        _long("'stockout'", groups, stockout, "tenure", "n", True),
        _long("'stockout_by_basket'", b["stratified_effect"],
              _shown("stratified_pp", "naive_pp", "shift_pp")),
        _long("'exposure_gradient'", b["exposure_gradient"],
              _shown("mean_size", "exposure_rate", "baseline_rate"), "basket_q + 1", "n"),
        _long("'high_intent'", b["high_intent_effect"],
              _shown("effect_pp", n_high_intent="n_treated", n_other="n_control"), n="n",
              interval=True),
        _long("'proxy'", b["proxy_contrasts"], swaps,
              "concat_ws(':', proxy, substitution_type)", "n_treated", True),
        _long("'swap_contrast'", b["contrast_by_type"], swaps,
              "concat_ws(':', control, substitution_type)", "n_treated", True),
        _long("'proxy_spread'", b["proxy_spread"], _shown("spread_pp", "best_pp", "worst_pp")),
        _long("'ranking'", b["ranking_stability"], _shown(is_stable="CAST(is_stable AS INT)"),
              "concat_ws('=', control, ranking)"),
        _experiment_twin(b),
    ])


_BODIES["experiment_report"] = _experiment_twin(_BODIES)
_BODIES["analysis_report"] = _analysis_twin(_BODIES)


def _statement(body: str) -> str:
    """Shared names first; a body with names of its own continues the list."""
    text = body.strip()
    rest = ", " + text[5:] if text.startswith("WITH ") else "\n" + text
    return f"WITH {_SHARED.strip()}{rest}"


TWINS = {name: _statement(body) for name, body in _BODIES.items()}
