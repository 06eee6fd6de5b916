"""The same questions in plain SQL, for a second engine to check the answers.

Each text stands alone: the views it names are added in front as common table
expressions.
"""

from __future__ import annotations

import re

SPACES = r"E' \t\n\r'"
MARKERS = "('', 'NA', 'N/A', 'NULL', 'None', 'nan', 'NaN', 'na', 'n/a', '#N/A')"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
FEED = ["transaction_id", "ts", "store_id", "sku", "qty", "unit_price", "amount", "currency"]
FORMATS = [
    "%Y-%m-%d %H:%M:%S",
    "%Y-%m-%dT%H:%M:%S",
    "%Y-%m-%d %H:%M",
    "%m/%d/%Y %H:%M:%S",
    "%m/%d/%Y",
    "%Y-%m-%d",
    "%d-%b-%Y %H:%M:%S",
    "%d-%b-%Y",
]
MORE_FORMATS = ["%m/%d/%Y %H:%M", "%d-%b-%Y %H:%M", "%Y/%m/%d %H:%M:%S"]


def _any_format(c: str) -> str:
    return "COALESCE(" + ", ".join(f"try_strptime({c}, '{f}')" for f in FORMATS + MORE_FORMATS) + ")"


def _stripped(c: str) -> str:
    return f"translate({c}, E'$,€£¥ \\t\\n\\r', '')"


def _number(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '{NUMBER}') THEN TRY_CAST({c} AS DOUBLE) END"


def _tidy(c: str) -> str:
    return f"CASE WHEN regexp_matches({_stripped(c)}, '{NUMBER}') THEN {_stripped(c)} ELSE {c} END"


def _each(expr: str, names) -> str:
    return ", ".join(f"{expr.format(c=c)} AS {c}" for c in names)


FEED_LIST = ", ".join(FEED)
RULES = {"qty": "positive_numeric", "unit_price": "numeric", "amount": "numeric"}


def _broken(c: str, rule: str) -> str:
    limit = f" OR ({_number(c)}) <= 0" if rule == "positive_numeric" else ""
    return f"COALESCE({c} IS NOT NULL AND (({_number(c)}) IS NULL{limit}), FALSE)"


FAILED = "concat_ws(' ', " + ", ".join(
    f"CASE WHEN {_broken(c, r)} THEN '{c}({r})' END" for c, r in RULES.items()
) + ")"

HOLIDAY = """CASE
 WHEN month(d)=1 AND day(d)=1 THEN 'New Year''s Day'
 WHEN month(d)=1 AND dayofweek(d)=1 AND ceil(day(d)/7.0)=3 THEN 'MLK Day'
 WHEN month(d)=2 AND dayofweek(d)=1 AND ceil(day(d)/7.0)=3 THEN 'Presidents'' Day'
 WHEN month(d)=5 AND dayofweek(d)=1 AND month(d + 7)=6 THEN 'Memorial Day'
 WHEN month(d)=7 AND day(d)=4 THEN 'Independence Day'
 WHEN month(d)=9 AND dayofweek(d)=1 AND ceil(day(d)/7.0)=1 THEN 'Labor Day'
 WHEN month(d)=10 AND dayofweek(d)=1 AND ceil(day(d)/7.0)=2 THEN 'Columbus Day'
 WHEN month(d)=11 AND day(d)=11 THEN 'Veterans Day'
 WHEN month(d)=11 AND dayofweek(d)=4 AND ceil(day(d)/7.0)=4 THEN 'Thanksgiving'
 WHEN month(d)=12 AND day(d)=25 THEN 'Christmas' END"""

MONEY = "'$' || format('{{:,.2f}}', CAST({c} AS DOUBLE))"
PCT = "CAST(CAST(({c}) * 100 AS DECIMAL(18,1)) AS VARCHAR) || '%'"


def _money(c: str) -> str:
    return MONEY.format(c=c)


def _pct(c: str) -> str:
    return PCT.format(c=c)


VIEWS: dict[str, str] = {
    "v_lines": "SELECT *, row_number() OVER () - 1 AS _row_idx FROM lineitem",
    "v_sales": """SELECT l_orderkey || '-' || l_linenumber AS transaction_id,
        CASE WHEN l_orderkey % 211 <> 0 THEN l_shipdate END AS transaction_ts,
        CASE WHEN l_orderkey % 199 = 1 THEN 'STORE999' ELSE CAST(l_suppkey AS VARCHAR) END AS store_id,
        CASE WHEN l_orderkey % 197 = 2 THEN 'SKU999' ELSE CAST(l_partkey AS VARCHAR) END AS sku,
        CAST(l_quantity AS DECIMAL(12,4)) AS quantity,
        CASE WHEN l_orderkey % 51 <> 3 THEN CAST(l_extendedprice AS DECIMAL(12,4)) END AS unit_price,
        CASE WHEN l_linestatus = 'F' AND l_orderkey % 49 <> 4 THEN
          CAST(CAST(l_quantity AS DECIMAL(12,4)) * CAST(l_extendedprice AS DECIMAL(12,4))
               * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(14,4)) END AS revenue,
        CASE WHEN l_orderkey % 67 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
        CASE WHEN l_linestatus = 'F' THEN 'POS' ELSE 'ONLINE' END AS source_system,
        'lineitem.parquet' AS source_file, _row_idx FROM v_lines""",
    "v_products": """SELECT CAST(p_partkey AS VARCHAR) AS sku, p_type AS category, p_brand AS brand,
        CAST(p_size AS VARCHAR) AS package_size, CAST(p_retailprice AS DECIMAL(12,4)) AS list_price,
        DATE '1994-01-01' AS launch_date, row_number() OVER () - 1 AS _row_idx FROM part""",
    "v_geo": "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "v_stores": """SELECT CAST(s_suppkey AS VARCHAR) AS store_id, r_name AS region, n_name AS city
        FROM supplier JOIN v_geo ON s_nationkey = n_nationkey""",
    "v_usable": """SELECT * REPLACE (CAST(COALESCE(revenue, unit_price * quantity) AS DECIMAL(18,4)) AS revenue),
        CAST(transaction_ts AS DATE) AS ds FROM v_sales WHERE transaction_ts IS NOT NULL
        AND (revenue IS NOT NULL OR (unit_price IS NOT NULL AND quantity IS NOT NULL))""",
    "v_enriched": """SELECT u.*, p.category, p.brand, s.region FROM v_usable u
        LEFT JOIN v_products p ON p.sku = u.sku LEFT JOIN v_stores s ON s.store_id = u.store_id""",
    "v_placed": "SELECT * FROM v_enriched WHERE category IS NOT NULL AND region IS NOT NULL",
    "v_series": """SELECT ds, category, region, CAST(SUM(revenue) AS DECIMAL(18,2)) AS y
        FROM v_placed GROUP BY ALL""",
    "v_profile": """SELECT category, region, COUNT(DISTINCT ds) AS n_days, MIN(ds) AS first_date,
        MAX(ds) AS last_date FROM v_series GROUP BY ALL""",
    "v_spine": """SELECT category, region,
        CAST(unnest(generate_series(CAST(first_date AS TIMESTAMP), CAST(last_date + 90 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS ds
        FROM v_profile""",
    "v_promos": """SELECT lower(CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE trim(' ' || p_type || '  ') END) AS category,
        lower(r_name) AS region,
        CASE WHEN p_partkey % 41 <> 0 THEN DATE '1995-01-01' + CAST(p_partkey * 37 % 2400 AS INTEGER) END AS start_date,
        CASE WHEN p_partkey % 43 <> 0 THEN DATE '1995-01-01' + CAST(p_partkey * 37 % 2400 AS INTEGER) + p_size END AS end_date,
        CASE WHEN p_partkey % 29 <> 0 THEN CAST(p_partkey % 35 - 2 AS DECIMAL(8,4)) END AS discount_pct
        FROM part JOIN region ON p_partkey % 5 = r_regionkey""",
    "v_promo_hits": """SELECT s.category, s.region, s.ds, CAST(MAX(COALESCE(discount_pct, 0)) / 100 AS DECIMAL(10,6)) AS intensity
        FROM v_spine s JOIN v_promos p ON p.category = lower(s.category) AND p.region = lower(s.region)
        AND s.ds BETWEEN p.start_date AND p.end_date GROUP BY ALL""",
    "v_promo_days": """SELECT s.category, s.region, s.ds, CAST(GREATEST(COALESCE(intensity, 0), 0) AS DECIMAL(10,6)) AS promo_active
        FROM v_spine s LEFT JOIN v_promo_hits USING (category, region, ds)""",
    "v_calendar": f"""SELECT d AS calendar_date, CASE WHEN month(d) IN (12, 1, 2) THEN 'WINTER'
        WHEN month(d) <= 5 THEN 'SPRING' WHEN month(d) <= 8 THEN 'SUMMER' ELSE 'FALL' END AS season,
        CASE WHEN {HOLIDAY} IS NULL THEN 'False' ELSE 'True' END AS is_holiday, {HOLIDAY} AS holiday_name
        FROM (SELECT CAST(unnest(generate_series(MIN(l_shipdate), MAX(l_shipdate), INTERVAL 1 DAY)) AS DATE) AS d FROM lineitem)""",
    "v_effects": """SELECT ds, string_agg(label, '|' ORDER BY label) AS holidays FROM (
        SELECT calendar_date AS ds, holiday_name AS label FROM v_calendar WHERE is_holiday = 'True'
        UNION ALL SELECT calendar_date + 1, holiday_name || '+1' FROM v_calendar WHERE is_holiday = 'True')
        GROUP BY ds""",
    "v_forecasts": """SELECT CAST(date_trunc('year', ds) AS DATE) - 1 AS run_date, category, region, ds AS target_date,
        CAST(y AS DECIMAL(14,4)) AS predicted_revenue,
        CAST(CAST(y AS DECIMAL(14,4)) * (1 - CAST(CAST(1 + day(ds) AS DECIMAL(4,2)) * 0.01 AS DECIMAL(6,4))) AS DECIMAL(14,4)) AS yhat_lower,
        CAST(CAST(y AS DECIMAL(14,4)) * (1 + CAST(CAST(1 + day(ds) AS DECIMAL(4,2)) * 0.01 AS DECIMAL(6,4))) AS DECIMAL(14,4)) AS yhat_upper,
        'piecewise-v1' AS model_version FROM v_series""",
    "v_points": """SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY category, region ORDER BY target_date) AS k
        FROM v_forecasts WHERE run_date = (SELECT MAX(run_date) FROM v_forecasts)) WHERE k <= 90""",
    "v_feed": """SELECT * EXCLUDE (again) FROM (
        SELECT 'lineitem.parquet' AS file, 'Sales' AS sheet, _row_idx * 2 + copy AS row_idx,
          CASE WHEN l_orderkey % 1009 = 7 THEN 'NA' ELSE l_orderkey || '-' || l_linenumber END AS transaction_id,
          CASE l_orderkey % 60 WHEN 1 THEN strftime(l_shipdate, '%m/%d/%Y %H:%M')
            WHEN 2 THEN strftime(l_shipdate, '%d-%b-%Y %H:%M') WHEN 3 THEN strftime(l_shipdate, '%Y/%m/%d %H:%M:%S')
            WHEN 4 THEN strftime(l_shipdate, '%m/%d/%Y') WHEN 5 THEN 'NULL' WHEN 6 THEN 'not a date'
            ELSE strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') END AS ts,
          CASE WHEN l_orderkey % 199 = 1 THEN 'STORE999' ELSE CAST(l_suppkey AS VARCHAR) END AS store_id,
          CASE WHEN l_orderkey % 50 = 9 THEN E'\\t ' || l_partkey || ' ' WHEN l_orderkey % 197 = 2 THEN 'SKU999'
            ELSE CAST(l_partkey AS VARCHAR) END AS sku,
          CASE l_orderkey % 120 WHEN 1 THEN '0' WHEN 2 THEN '-3' WHEN 3 THEN 'three' WHEN 4 THEN ' N/A ' WHEN 5 THEN 'N/A'
            ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS qty,
          CASE l_orderkey % 70 WHEN 1 THEN '$' || format('{:,.2f}', l_extendedprice) WHEN 2 THEN 'None' WHEN 3 THEN 'n.a.'
            ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) END AS unit_price,
          CASE l_orderkey % 80 WHEN 1 THEN '€' || format('{:,.2f}', CAST(total AS DOUBLE)) WHEN 2 THEN '' WHEN 3 THEN 'free'
            ELSE CAST(total AS VARCHAR) END AS amount,
          CASE WHEN l_orderkey % 67 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
          l_orderkey % 101 = 5 AS again, copy
        FROM (SELECT *, CAST(CAST(l_quantity AS DECIMAL(12,2)) * CAST(l_extendedprice AS DECIMAL(12,2)) AS DECIMAL(18,2)) AS total
              FROM v_lines), (VALUES (0), (1)) AS c(copy)
        WHERE copy = 0 OR l_orderkey % 101 = 5)""",
    "v_marked": "SELECT file, sheet, row_idx, "
    + _each("CASE WHEN {c} NOT IN " + MARKERS + " THEN {c} END", FEED)
    + " FROM v_feed",
    "v_clean": "SELECT file, sheet, row_idx, "
    + _each(f"trim({{c}}, {SPACES})", FEED)
    + f" FROM v_marked WHERE COALESCE({FEED_LIST}) IS NOT NULL",
    "v_tidy": "SELECT file, sheet, row_idx, transaction_id, ts, store_id, sku, "
    + ", ".join(f"{_tidy(c)} AS {c}" for c in RULES)
    + ", currency FROM v_clean",
    "v_gate": f"""SELECT *, CASE WHEN rn > 1 THEN 'DUPLICATE_ROW' WHEN kn > 1 THEN 'PK_DUPLICATE'
          WHEN failed <> '' THEN 'DATATYPE_VIOLATION' END AS issue,
        CASE WHEN rn > 1 THEN 'exact copy of an earlier row in this batch'
          WHEN kn > 1 THEN 'duplicate value in ''transaction_id'': ' || COALESCE(transaction_id, '<NA>')
          WHEN failed <> '' THEN failed END AS detail
        FROM (SELECT *, CASE WHEN rn = 1 THEN row_number() OVER (PARTITION BY transaction_id, rn = 1 ORDER BY row_idx) END AS kn
          FROM (SELECT *, {FAILED} AS failed, row_number() OVER (PARTITION BY {FEED_LIST} ORDER BY row_idx) AS rn FROM v_tidy))""",
    "v_verdicts": """SELECT row_idx, transaction_id, issue, detail, CASE WHEN issue IS NOT NULL THEN 'REMOVED' END AS action,
        file AS source_file, sheet FROM v_gate""",
    "v_rejected": """SELECT *, '2024070' || (row_idx % 3 + 1) || '_060000_lineitem_Sales_dq_report.csv' AS report
        FROM v_verdicts WHERE issue IS NOT NULL""",
    "v_dates": "SELECT row_idx, ts FROM v_clean",
    "v_date_votes": "SELECT COUNT(ts) AS n, "
    + ", ".join(f"COUNT(try_strptime(ts, '{f}')) AS n{i}" for i, f in enumerate(FORMATS))
    + " FROM v_dates",
    "v_log": """SELECT CAST(length(store_id) + 100 AS INTEGER) AS load_batch_id, file AS source_file,
        transaction_id AS record_identifier, issue_type, field_name, raw_value, action_taken FROM (
        SELECT *, issue AS issue_type, CAST(NULL AS VARCHAR) AS field_name, CAST(NULL AS VARCHAR) AS raw_value, 'REJECTED' AS action_taken
          FROM v_gate WHERE issue IS NOT NULL
        UNION ALL SELECT *, 'NULL_UNIT_PRICE', 'unit_price', NULL, 'REPAIRED' FROM v_gate
          WHERE issue IS NULL AND unit_price IS NULL AND amount IS NOT NULL
        UNION ALL SELECT *, 'NULL_AMOUNT', 'amount', NULL, 'REPAIRED' FROM v_gate
          WHERE issue IS NULL AND amount IS NULL AND unit_price IS NOT NULL
        UNION ALL SELECT *, 'UNKNOWN_STORE_ID', 'store_id', store_id, 'FLAGGED' FROM v_gate WHERE issue IS NULL
          AND store_id IS NOT NULL AND store_id NOT IN (SELECT store_id FROM v_stores)
        UNION ALL SELECT *, 'UNKNOWN_SKU', 'sku', sku, 'FLAGGED' FROM v_gate WHERE issue IS NULL
          AND sku IS NOT NULL AND sku NOT IN (SELECT sku FROM v_products)
        UNION ALL SELECT *, 'EUR_CURRENCY', 'currency', currency, 'FLAGGED' FROM v_gate WHERE issue IS NULL AND currency = 'EUR')""",
    "v_known": """SELECT DISTINCT l_orderkey || '-' || l_linenumber AS transaction_id FROM lineitem
        WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
    "v_batches": """SELECT CAST(length(store_id) + 100 AS INTEGER) AS load_batch_id, 'INCREMENTAL' AS load_type,
        COUNT(*) AS rows_in, COUNT(*) FILTER (issue IS NULL) AS attempted,
        COUNT(*) FILTER (issue IS NULL AND k.transaction_id IS NULL) AS inserted,
        COUNT(*) FILTER (issue IN ('DUPLICATE_ROW', 'PK_DUPLICATE')) AS deduped,
        COUNT(*) FILTER (issue IS NOT NULL) AS rejected,
        COUNT(*) FILTER (issue IS NULL AND (unit_price IS NULL) <> (amount IS NULL)) AS repaired,
        COUNT(*) FILTER (issue IS NULL AND (store_id NOT IN (SELECT store_id FROM v_stores)
          OR sku NOT IN (SELECT sku FROM v_products))) AS flagged,
        COUNT(*) FILTER (issue IS NULL AND """
    + _any_format("ts")
    + """ < TIMESTAMP '1996-01-01') AS late_arriving
        FROM v_gate g LEFT JOIN v_known k USING (transaction_id) GROUP BY 1""",
    "v_online": """SELECT _row_idx AS row_idx, 'W-' || l_orderkey || '-' || l_linenumber AS order_id,
        strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS order_datetime, CAST(l_suppkey AS VARCHAR) AS location_id,
        CAST(l_partkey AS VARCHAR) AS product_sku, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS units,
        CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) AS price_per_unit, 'USD' AS currency FROM v_lines""",
    "v_mapped": """SELECT order_id AS transaction_id, order_datetime AS transaction_ts, location_id AS store_id,
        product_sku AS sku, units AS quantity, price_per_unit AS unit_price, currency FROM v_online""",
    "v_orders": """SELECT *, 'orders_' || year(o_orderdate) || '.xlsx' AS file, o_orderpriority AS sheet,
        row_number() OVER () + 2 AS row_idx FROM orders""",
    "v_tabs": "SELECT DISTINCT file, sheet FROM v_orders",
    "v_sheets": """SELECT CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'weekly_POS.xlsx' WHEN 'MACHINERY' THEN 'online_week27.xlsx'
          WHEN 'FURNITURE' THEN 'promo_windows.xlsx' WHEN 'AUTOMOBILE' THEN 'Spring_Campaign.xlsx' ELSE 'misc_2024.xlsx' END AS file,
        CASE c_nationkey WHEN 0 THEN 'Sales' WHEN 1 THEN 'orders' WHEN 2 THEN 'product_updates' WHEN 3 THEN 'Competitor prices'
          WHEN 4 THEN 'promo plan' WHEN 5 THEN 'campaigns' ELSE 'Sheet' || c_nationkey END AS sheet,
        COUNT(*) AS n_rows FROM customer GROUP BY 1, 2""",
    "v_kpis": """SELECT 'total' AS section, 'ALL' AS name, CAST(SUM(revenue) AS DECIMAL(18,2)) AS revenue, COUNT(*) AS n FROM v_enriched
        UNION ALL SELECT 'category', category, CAST(SUM(revenue) AS DECIMAL(18,2)), COUNT(*) FROM v_enriched WHERE category IS NOT NULL GROUP BY category
        UNION ALL SELECT 'region', region, CAST(SUM(revenue) AS DECIMAL(18,2)), COUNT(*) FROM v_enriched WHERE region IS NOT NULL GROUP BY region""",
    "v_shares": """SELECT section, name, revenue, CAST(revenue AS DOUBLE) / CAST((SELECT revenue FROM v_kpis WHERE section = 'total') AS DOUBLE) AS share,
        row_number() OVER (PARTITION BY section ORDER BY revenue DESC, name) AS line_no FROM v_kpis WHERE section <> 'total'""",
    "v_months": """SELECT CAST(date_trunc('month', ds) AS DATE) AS month, CAST(SUM(revenue) AS DECIMAL(18,2)) AS revenue
        FROM v_usable GROUP BY 1 ORDER BY 1 DESC LIMIT 12""",
    "v_cat_months": """SELECT CAST(date_trunc('month', ds) AS DATE) AS month, category, CAST(SUM(revenue) AS DECIMAL(18,2)) AS revenue
        FROM v_enriched WHERE category IS NOT NULL GROUP BY 1, 2""",
    "v_two_months": "SELECT DISTINCT month FROM v_cat_months ORDER BY month DESC LIMIT 2",
    "v_pairs": """SELECT c.category, c.revenue AS revenue_cur, p.revenue AS revenue_prev FROM v_cat_months c
        JOIN v_cat_months p ON c.category = p.category
        WHERE c.month = (SELECT MAX(month) FROM v_two_months) AND p.month = (SELECT MIN(month) FROM v_two_months)
        AND c.month <> p.month""",
    "v_growth": """SELECT *, CAST(revenue_cur - revenue_prev AS DOUBLE) / CAST(revenue_prev AS DOUBLE) AS growth
        FROM v_pairs WHERE revenue_prev <> 0""",
    "v_updates": """SELECT CAST(l_partkey AS VARCHAR) AS sku,
        CASE WHEN l_linenumber <= 2 THEN 'list_price' WHEN l_linenumber <= 4 THEN 'package_size' ELSE 'brand' END AS attribute,
        CASE WHEN l_linenumber <= 2 THEN CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR)
          WHEN l_linenumber <= 4 THEN CAST(l_quantity AS INTEGER) || ' pack' ELSE 'Brand#' || l_suppkey END AS new_value,
        CAST(l_shipdate AS DATE) AS effective_date, _row_idx FROM v_lines""",
    "v_changes": """SELECT sku, effective_date AS valid_from, NULL AS category,
        arg_max(new_value, _row_idx) FILTER (attribute = 'brand') AS brand,
        arg_max(new_value, _row_idx) FILTER (attribute = 'package_size') AS package_size,
        arg_max(new_value, _row_idx) FILTER (attribute = 'list_price') AS list_price
        FROM v_updates GROUP BY 1, 2
        UNION ALL SELECT sku, launch_date, category, brand, package_size, CAST(list_price AS VARCHAR) FROM v_products""",
    "v_versions": """SELECT sku, valid_from,
        last_value(category IGNORE NULLS) OVER w AS category, last_value(brand IGNORE NULLS) OVER w AS brand,
        last_value(package_size IGNORE NULLS) OVER w AS package_size, last_value(list_price IGNORE NULLS) OVER w AS list_price,
        lead(valid_from) OVER (PARTITION BY sku ORDER BY valid_from) - 1 AS valid_to,
        lead(valid_from) OVER (PARTITION BY sku ORDER BY valid_from) IS NULL AS is_current
        FROM v_changes WINDOW w AS (PARTITION BY sku ORDER BY valid_from ROWS UNBOUNDED PRECEDING)""",
}


def _full(body: str) -> str:
    """The text with the views it needs in front, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    kept = {"v_dates", "v_date_votes"}  # read more than once
    parts = (f"{n} AS {'MATERIALIZED ' if n in kept else ''}({VIEWS[n]})" for n in needed)
    return "WITH " + ",\n".join(parts) + "\n" + body


SALES_COLS = (
    "transaction_id, transaction_ts, store_id, sku, quantity, unit_price, revenue, currency, "
    "source_system, source_file"
)
SPAN = "transaction_ts >= TIMESTAMP '1996-03-01' AND transaction_ts < TIMESTAMP '1998-12-01'"
REV = "CAST(SUM(revenue) AS DECIMAL(18,2)) AS revenue"
TOP = """SELECT b.sku, revenue, transactions, brand, category FROM (
    SELECT sku, {rev}, COUNT(revenue) AS transactions FROM v_usable {where} GROUP BY sku
    ORDER BY revenue DESC, sku LIMIT {n}) b LEFT JOIN v_products p ON p.sku = b.sku"""
EVENT_ROWS = "SELECT event_id, event_type AS category, user_id % 5 AS region, CAST(value AS DECIMAL(12,2)) AS value, ts FROM events"

BODIES: dict[str, str] = {
    "scan_workbooks": """SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer,
        o_orderstatus AS status, o_orderpriority AS priority, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ts FROM orders""",
    "discover_files": """SELECT 'facts' AS feed, 'lineitem.parquet' AS file_name, COUNT(*) AS n_rows FROM lineitem
        UNION ALL SELECT 'facts', 'orders.parquet', COUNT(*) FROM orders
        UNION ALL SELECT 'dims', 'part.parquet', COUNT(*) FROM part
        UNION ALL SELECT 'dims', 'supplier.parquet', COUNT(*) FROM supplier""",
    "drop_ghost_sheets": "SELECT file, sheet, COUNT(*) + 3 AS n_rows FROM v_orders GROUP BY ALL",
    "detect_header": """SELECT file, sheet, 2 AS header_row, 4 AS n_cells FROM v_tabs
        UNION ALL SELECT DISTINCT file, 'Notes', 0, 0 FROM v_tabs UNION ALL SELECT DISTINCT file, 'Template', 0, 4 FROM v_tabs""",
    "grid_to_table": """SELECT file, sheet, row_idx, CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer,
        CASE WHEN o_orderkey % 4 = 0 THEN '  ' END AS col2, o_orderstatus AS status,
        strftime(o_orderdate, '%Y-%m-%d') AS order_date FROM v_orders""",
    "source_system_tag": """SELECT file, sheet, n_rows, CASE WHEN file LIKE '%POS%' OR lower(sheet) = 'sales' THEN 'POS'
        WHEN file LIKE 'online%' OR lower(sheet) = 'orders' THEN 'ONLINE'
        WHEN file LIKE 'promo%' OR sheet LIKE 'promo%' THEN 'PROMO'
        WHEN file LIKE '%Campaign%' OR sheet LIKE 'campaign%' THEN 'MARKETING'
        WHEN sheet LIKE 'Competitor%' THEN 'COMPETITOR' ELSE 'UNKNOWN' END AS source_system FROM v_sheets""",
    "route_sheet": """SELECT file, sheet, CASE lower(sheet) WHEN 'sales' THEN 'pos_batch' WHEN 'orders' THEN 'online_batch'
        WHEN 'product_updates' THEN 'product_updates' END AS feed FROM v_sheets""",
    "scan_curated": """SELECT 'sales' AS table_name, transaction_id, sku, store_id, quantity, unit_price, revenue,
        CAST(NULL AS VARCHAR) AS category, CAST(NULL AS VARCHAR) AS brand, CAST(NULL AS VARCHAR) AS region FROM v_sales
        UNION ALL SELECT 'products', NULL, sku, NULL, NULL, NULL, NULL, category, brand, NULL FROM v_products
        UNION ALL SELECT 'stores', NULL, NULL, store_id, NULL, NULL, NULL, NULL, NULL, region FROM v_stores""",
    "sink_raw": """SELECT 'lineitem.parquet' AS source_file, 'Orders' AS sheet_name, row_idx, order_id, units,
        CAST(NULL AS VARCHAR) AS note, 7 AS load_batch_id FROM v_online""",
    "sink_error": """SELECT file AS source_file, sheet AS sheet_name, 7 AS load_batch_id, issue AS dq_issue, detail AS dq_detail,
        'REMOVED' AS dq_action, CAST(json_object("""
    + ", ".join(f"'{c}', {c}" for c in FEED)
    + ") AS VARCHAR) AS row_data FROM v_gate WHERE issue IS NOT NULL",
    "sink_curated_overwrite": f"""SELECT {SALES_COLS} FROM v_sales WHERE source_system = 'ONLINE' UNION ALL
        SELECT {SALES_COLS.replace('unit_price', 'CAST(1 AS DECIMAL(12,4))')} FROM v_sales WHERE source_system = 'POS'""",
    "sink_curated_insert_ignore": f"""SELECT {SALES_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id
        ORDER BY CASE source_system WHEN 'POS' THEN 0 ELSE 1 END, _row_idx) AS k FROM v_sales) WHERE k = 1""",
    "sink_csv": """SELECT sku, brand, category FROM v_products UNION ALL SELECT sku, brand, '' FROM v_products""",
    "sink_forecast_replace": """SELECT * REPLACE (CASE WHEN run_date = (SELECT MAX(run_date) FROM v_forecasts)
        AND category <> 'PROMO' THEN 'v2' ELSE model_version END AS model_version) FROM v_forecasts""",
    "dq_report_sink": """SELECT transaction_id, ts, qty, issue, '20240708_060000' AS report_ts, file AS source_file, sheet
        FROM v_gate WHERE issue IS NOT NULL""",
    "normalize_headers": "SELECT * EXCLUDE (row_idx) FROM v_online",
    "null_markers": "SELECT row_idx, transaction_id, ts, qty, unit_price, amount FROM v_marked",
    "drop_all_null_rows": "SELECT row_idx, unit_price, amount FROM v_marked WHERE unit_price IS NOT NULL OR amount IS NOT NULL",
    "trim_strings": f"SELECT row_idx, trim(sku, {SPACES}) AS sku, trim(qty, {SPACES}) AS qty FROM v_feed",
    "parse_dates_vote": "SELECT row_idx, CASE "
    + " ".join(f"WHEN v.n{i} >= 0.5 * v.n THEN try_strptime(ts, '{f}')" for i, f in enumerate(FORMATS))
    + f" ELSE {_any_format('ts')} END AS ts FROM v_dates, v_date_votes v",
    "parse_dates_coalesce": f"SELECT row_idx, {_any_format('ts')} AS ts FROM v_clean",
    "coerce_numeric_vote": "SELECT row_idx, "
    + ", ".join(f"{_number(_stripped(c))} AS {c}" for c in RULES)
    + ", currency FROM v_clean",
    "map_columns": "SELECT * FROM v_mapped",
    "inject_columns": "SELECT transaction_id, sku, 'ONLINE' AS source_system, 'lineitem.parquet' AS source_file FROM v_mapped",
    "dedup_on_column": f"""SELECT {SALES_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY _row_idx) AS k
        FROM v_sales) WHERE k = 1""",
    "align_to_schema": """SELECT transaction_id, CAST(transaction_ts AS TIMESTAMP) AS transaction_ts, store_id, sku,
        CAST(quantity AS DECIMAL(12,4)) AS quantity, CAST(unit_price AS DECIMAL(12,4)) AS unit_price,
        CAST(NULL AS DECIMAL(14,4)) AS revenue, currency, CAST(NULL AS VARCHAR) AS source_system,
        CAST(NULL AS VARCHAR) AS source_file FROM v_mapped""",
    "derive_revenue": """SELECT _row_idx AS row_idx, quantity, unit_price,
        CAST(COALESCE(revenue, unit_price * quantity) AS DECIMAL(18,4)) AS revenue FROM v_sales""",
    "usable_sales_filter": """SELECT _row_idx AS row_idx, transaction_id, transaction_ts, unit_price, revenue FROM v_sales
        WHERE transaction_ts IS NOT NULL AND (revenue IS NOT NULL OR (unit_price IS NOT NULL AND quantity IS NOT NULL))""",
    "date_range_filter": """SELECT _row_idx AS row_idx, transaction_id, transaction_ts FROM v_sales
        WHERE CAST(transaction_ts AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1998-11-30'""",
    "forecast_filter": "SELECT * FROM v_forecasts WHERE category = 'ECONOMY' AND region = 'ASIA'",
    "issue_filter": "SELECT row_idx, issue FROM v_gate WHERE issue IN ('PK_DUPLICATE', 'DATATYPE_VIOLATION')",
    "page_rows": """SELECT transaction_id, _row_idx AS row_idx, sku, store_id, (SELECT COUNT(*) FROM v_sales) AS total
        FROM v_sales ORDER BY transaction_id, row_idx LIMIT 100 OFFSET 250""",
    "dq_duplicate_rows": "SELECT * FROM v_verdicts WHERE issue = 'DUPLICATE_ROW'",
    "dq_pk_duplicates": "SELECT * FROM v_verdicts WHERE issue = 'PK_DUPLICATE'",
    "dq_rule_numeric": f"SELECT row_idx, unit_price, {_broken('unit_price', 'numeric')} AS bad FROM v_tidy",
    "dq_rule_positive_numeric": f"SELECT row_idx, qty, {_broken('qty', 'positive_numeric')} AS bad FROM v_tidy",
    "dq_rule_datetime": f"SELECT row_idx, ts, ts IS NOT NULL AND {_any_format('ts')} IS NULL AS bad FROM v_tidy",
    "dq_datatype_gate": f"""SELECT row_idx, transaction_id, 'DATATYPE_VIOLATION' AS issue, {FAILED} AS detail, 'REMOVED' AS action,
        file AS source_file, sheet FROM v_tidy WHERE {FAILED} <> ''""",
    "dq_gate": "SELECT * FROM v_verdicts",
    "dq_counts": "SELECT issue, COUNT(*) AS n FROM v_gate WHERE issue IS NOT NULL GROUP BY issue",
    "dq_report_index": """SELECT report, COUNT(*) AS total_rejected, COUNT(*) FILTER (issue = 'DUPLICATE_ROW') AS duplicate_row,
        COUNT(*) FILTER (issue = 'PK_DUPLICATE') AS pk_duplicate, COUNT(*) FILTER (issue = 'DATATYPE_VIOLATION') AS datatype_violation,
        MIN(source_file) AS source_file, MIN(sheet) AS sheet, strptime(report[1:15], '%Y%m%d_%H%M%S') AS report_ts
        FROM v_rejected GROUP BY report""",
    "dq_report_detail": "SELECT * EXCLUDE (report) FROM v_rejected WHERE report LIKE '20240702%'",
    "dq_issue_rollup": """SELECT issue, COUNT(*) AS n, CAST(NULL AS VARCHAR) AS dominant FROM v_rejected GROUP BY issue
        UNION ALL SELECT 'ALL', COUNT(*), (SELECT issue FROM v_rejected GROUP BY issue ORDER BY COUNT(*) DESC, issue DESC LIMIT 1)
        FROM v_rejected""",
    "dq_newest_first": "SELECT report, COUNT(*) AS total_rejected FROM v_rejected GROUP BY report ORDER BY report DESC",
    "union_rejected": "SELECT * FROM v_verdicts WHERE issue IS NOT NULL",
    "sales_enriched": """SELECT store_id, sku, transaction_ts, ds, quantity, unit_price, revenue, category, brand, region
        FROM v_enriched""",
    "series_join": "SELECT ds, sku, store_id, revenue, category, region FROM v_placed",
    "sku_attr_join": f"""SELECT b.sku, revenue, brand, category FROM (SELECT sku, {REV} FROM v_usable GROUP BY sku) b
        LEFT JOIN v_products p ON p.sku = b.sku""",
    "promo_interval_join": "SELECT category, region, ds, intensity FROM v_promo_hits",
    "insert_ignore_antijoin": """SELECT transaction_id, MIN(_row_idx) AS row_idx FROM v_sales
        WHERE transaction_id NOT IN (SELECT transaction_id FROM v_known) GROUP BY transaction_id""",
    "regressor_lookup": "SELECT category, region, ds, y, promo_active FROM v_series JOIN v_promo_days USING (category, region, ds)",
    "month_pair_join": "SELECT category, revenue_cur, revenue_prev FROM v_pairs",
    "revenue_kpis": f"""SELECT 'total' AS section, 'ALL' AS name, {REV}, COUNT(*) AS n FROM v_enriched WHERE {SPAN}
        UNION ALL SELECT 'category', category, {REV}, COUNT(*) FROM v_enriched WHERE {SPAN} AND category IS NOT NULL GROUP BY category
        UNION ALL SELECT 'region', region, {REV}, COUNT(*) FROM v_enriched WHERE {SPAN} AND region IS NOT NULL GROUP BY region""",
    "kpi_headline": """SELECT (SELECT revenue FROM v_kpis WHERE section = 'total') AS total_revenue,
        (SELECT n FROM v_kpis WHERE section = 'total') AS transaction_count,
        (SELECT name FROM v_shares WHERE section = 'category' AND line_no = 1) AS top_category,
        (SELECT name FROM v_shares WHERE section = 'region' AND line_no = 1) AS top_region""",
    "revenue_by_category": f"SELECT category, {REV} FROM v_enriched WHERE category IS NOT NULL GROUP BY category",
    "revenue_by_region": f"SELECT region, {REV} FROM v_enriched WHERE region IS NOT NULL GROUP BY region",
    "insights_aggregates": "SELECT section, name, revenue FROM v_kpis",
    "revenue_share": "SELECT section AS dim, name, revenue, share FROM v_shares",
    "monthly_revenue_12": "SELECT month, revenue FROM v_months",
    "category_month_revenue": "SELECT month, category, revenue FROM v_cat_months",
    "category_mom_growth": "SELECT category, revenue_cur, revenue_prev, growth FROM v_growth",
    "data_span": """SELECT MIN(ds) AS first_day, MAX(ds) AS last_day, COUNT(*) AS transactions,
        CAST(SUM(revenue) AS DECIMAL(18,2)) AS total_revenue FROM v_usable""",
    "product_performance": TOP.format(rev=REV, where=f"WHERE {SPAN}", n=100),
    "top_products": TOP.format(rev=REV, where="", n=20),
    "daily_series": "SELECT ds, category, region, y FROM v_series",
    "series_profile": "SELECT category, region, n_days, first_date, last_date FROM v_profile",
    "quality_by_issue": "SELECT issue_type, COUNT(*) AS n FROM v_log GROUP BY issue_type",
    "quality_by_action": "SELECT action_taken, COUNT(*) AS n FROM v_log GROUP BY action_taken",
    "quality_summary": """SELECT 'total_issues' AS section, 'ALL' AS name, COUNT(*) AS n FROM v_log
        UNION ALL SELECT 'issue_type', issue_type, COUNT(*) FROM v_log GROUP BY issue_type
        UNION ALL SELECT 'action_taken', action_taken, COUNT(*) FROM v_log GROUP BY action_taken
        UNION ALL SELECT 'total_batches', 'ALL', COUNT(*) FROM v_batches
        UNION ALL SELECT 'latest_batch', name, n FROM (UNPIVOT (SELECT rows_in, attempted, inserted, deduped, rejected, repaired,
          flagged, late_arriving FROM v_batches ORDER BY load_batch_id DESC LIMIT 1) ON COLUMNS(*) INTO NAME name VALUE n)""",
    "forecast_inventory": "SELECT COUNT(*) AS forecast_rows, MAX(target_date) AS latest_target FROM v_forecasts",
    "forecast_kpis": """SELECT category, region, CAST(SUM(predicted_revenue) AS DECIMAL(18,2)) AS total_revenue,
        CAST(SUM(predicted_revenue) AS DOUBLE) / COUNT(*) AS avg_daily,
        arg_max(target_date, (predicted_revenue, -CAST(date_diff('day', DATE '1970-01-01', target_date) AS BIGINT))) AS peak_day,
        MAX(predicted_revenue) AS peak_value FROM v_points GROUP BY category, region""",
    "forecast_band_pct": """SELECT category, region, band_pct, CASE WHEN band_pct < 20 THEN 'high' WHEN band_pct < 40 THEN 'moderate'
        ELSE 'wide' END AS confidence FROM (SELECT category, region, COALESCE(CAST(SUM(yhat_upper - yhat_lower) AS DOUBLE)
        / NULLIF(CAST(SUM(predicted_revenue) AS DOUBLE), 0) * 100, 0) AS band_pct FROM v_points GROUP BY category, region)""",
    "forecast_weekly": """SELECT category, region, CAST(SUM(predicted_revenue) AS DECIMAL(18,2)) AS total,
        CAST(SUM(predicted_revenue) AS DOUBLE) / COUNT(*) AS avg, MAX(predicted_revenue) AS peak,
        CAST(CAST(date_trunc('week', target_date) AS DATE) AS VARCHAR) || '/' || CAST(CAST(date_trunc('week', target_date) AS DATE) + 6 AS VARCHAR) AS week
        FROM v_points GROUP BY category, region, date_trunc('week', target_date)""",
    "first_per_key": f"""SELECT {SALES_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY sku, store_id ORDER BY _row_idx) AS k
        FROM v_sales) WHERE k = 1""",
    "latest_run": """SELECT * FROM v_forecasts WHERE region = 'EUROPE'
        AND run_date = (SELECT MAX(run_date) FROM v_forecasts WHERE region = 'EUROPE')""",
    "latest_batch": "SELECT * FROM v_batches ORDER BY load_batch_id DESC LIMIT 1",
    "forecast_growth": """SELECT *, CASE WHEN growth_pct > 5 THEN 'upward' WHEN growth_pct < -5 THEN 'decline' ELSE 'stable' END AS trend
        FROM (SELECT *, COALESCE((avg_end - avg_start) / NULLIF(avg_start, 0) * 100, 0) AS growth_pct FROM (
          SELECT category, region, CAST(SUM(predicted_revenue) FILTER (up <= 7) AS DOUBLE) / COUNT(*) FILTER (up <= 7) AS avg_start,
            CAST(SUM(predicted_revenue) FILTER (down <= 7) AS DOUBLE) / COUNT(*) FILTER (down <= 7) AS avg_end
          FROM (SELECT *, row_number() OVER (PARTITION BY category, region ORDER BY target_date) AS up,
            row_number() OVER (PARTITION BY category, region ORDER BY target_date DESC) AS down FROM v_points)
          GROUP BY category, region))""",
    "promo_overlap_max": "SELECT category, region, ds, CAST(GREATEST(intensity, 0) AS DECIMAL(10,6)) AS intensity FROM v_promo_hits",
    "top_category": f"""SELECT category, {REV} FROM v_enriched WHERE category IS NOT NULL GROUP BY category
        ORDER BY revenue DESC, category LIMIT 1""",
    "top_region": f"""SELECT region, {REV} FROM v_enriched WHERE region IS NOT NULL GROUP BY region
        ORDER BY revenue DESC, region LIMIT 1""",
    "forecast_points": """SELECT * FROM v_forecasts WHERE run_date = (SELECT MAX(run_date) FROM v_forecasts)
        ORDER BY target_date, category, region LIMIT 90""",
    "forecast_points_per_pair": "SELECT * FROM v_points",
    "unify_channels": """SELECT transaction_id, CAST(CAST(quantity AS INTEGER) AS VARCHAR) AS quantity, CAST(revenue AS VARCHAR) AS revenue, sku,
        CAST(NULL AS VARCHAR) AS currency FROM v_sales WHERE source_system = 'POS'
        UNION ALL SELECT transaction_id, quantity, NULL, sku, currency FROM v_mapped""",
    "bounded_context": f"""SELECT 1 AS section, 1 AS line_no, 'Date range : ' || MIN(ds) || ' to ' || MAX(ds) AS text FROM v_enriched
        UNION ALL SELECT 1, 2, 'Total revenue : ' || {_money('revenue')} FROM v_kpis WHERE section = 'total'
        UNION ALL SELECT 1, 3, 'Total transactions : ' || format('{{:,}}', n) FROM v_kpis WHERE section = 'total'
        UNION ALL SELECT CASE section WHEN 'category' THEN 2 ELSE 3 END, line_no,
          name || ': ' || {_money('revenue')} || ' (' || {_pct('share')} || ')' FROM v_shares
        UNION ALL SELECT 4, row_number() OVER (ORDER BY month), strftime(month, '%Y-%m') || ': ' || {_money('revenue')} FROM v_months
        UNION ALL SELECT 5, row_number() OVER (ORDER BY growth, category),
          category || ': ' || CASE WHEN CAST(growth * 100 AS DECIMAL(18,1)) >= 0 THEN '+' ELSE '' END || {_pct('growth')} FROM v_growth
        UNION ALL SELECT 5, 1, 'N/A' WHERE NOT EXISTS (SELECT 1 FROM v_growth)
        UNION ALL SELECT 6, 1, 'Total quality issues logged: ' || COUNT(*) FROM v_log
        UNION ALL SELECT 6, 2, 'Total ingestion batches: ' || COUNT(*) FROM v_batches
        UNION ALL SELECT 7, 1, 'Forecast rows: ' || COUNT(*) || ' (latest target: ' || MAX(target_date) || ')' FROM v_forecasts""",
    "insights_summary": f"""SELECT 1 AS section, 1 AS line_no, 'Total revenue: ' || {_money('revenue')} AS text FROM v_kpis WHERE section = 'total'
        UNION ALL SELECT CASE section WHEN 'category' THEN 2 ELSE 3 END, line_no,
          name || ': ' || {_money('revenue')} || '  (' || {_pct('share')} || ')' FROM v_shares
        UNION ALL SELECT 4, 1, 'Leading category ''' || name || ''' accounts for ' || {_pct('share')} || ' of total revenue.'
          FROM v_shares WHERE section = 'category' AND line_no = 1""",
    "date_spine": "SELECT category, region, ds FROM v_spine",
    "promo_calendar": "SELECT category, region, ds, promo_active FROM v_promo_days",
    "holiday_calendar": """SELECT holiday_name AS holiday, calendar_date AS ds, 0 AS lower_window, 1 AS upper_window
        FROM v_calendar WHERE is_holiday = 'True'""",
    "holiday_effects": "SELECT ds, holidays FROM v_effects",
    "history_gate": """SELECT category, region, n_days, first_date, last_date, n_days >= 1200 AS eligible FROM v_profile""",
    "training_frame": """SELECT s.category, s.region, s.ds, y, promo_active, COALESCE(holidays, '') AS holidays
        FROM v_promo_days s JOIN v_profile p ON s.category = p.category AND s.region = p.region AND n_days >= 60
        LEFT JOIN v_series d ON d.category = s.category AND d.region = s.region AND d.ds = s.ds
        LEFT JOIN v_effects e ON e.ds = s.ds WHERE y IS NOT NULL OR s.ds > last_date""",
    "forecast_rows": """SELECT DATE '1998-11-30' AS run_date, category, region, ds AS target_date, CAST(y AS DECIMAL(14,4)) AS predicted_revenue,
        CAST(CAST(y AS DOUBLE) / 2 AS DECIMAL(14,4)) AS yhat_lower, CAST(y * 2 AS DECIMAL(14,4)) AS yhat_upper,
        'piecewise-v1' AS model_version FROM v_series WHERE y >= 50000""",
    "calendar_dimension": "SELECT calendar_date, season, is_holiday, holiday_name FROM v_calendar",
    "promo_day_set": """SELECT DISTINCT ds, p.category, p.region FROM v_promos p JOIN
        (SELECT CAST(unnest(generate_series(CAST(MIN(ds) AS TIMESTAMP), CAST(MAX(ds) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS ds FROM v_series) d
        ON ds BETWEEN start_date AND end_date""",
    "competitor_gap": """SELECT month, t.category, region, own_price, competitor_price, own_price - competitor_price AS gap FROM (
        SELECT CAST(date_trunc('month', transaction_ts) AS DATE) AS month, category, region,
          CAST(SUM(unit_price) AS DOUBLE) / COUNT(unit_price) AS competitor_price
        FROM v_sales s JOIN v_products p ON p.sku = s.sku JOIN v_stores r ON r.store_id = s.store_id
        WHERE transaction_ts IS NOT NULL AND unit_price IS NOT NULL GROUP BY 1, 2, 3) t
        JOIN (SELECT category, CAST(SUM(list_price) AS DOUBLE) / COUNT(list_price) AS own_price FROM v_products GROUP BY 1) o
        ON o.category = t.category""",
    "campaign_calendar": """SELECT s.category, s.region, s.ds, CAST(COALESCE(SUM(exposure), 0) AS BIGINT) AS exposure FROM v_spine s LEFT JOIN (
        SELECT p_type AS category, r_name AS region, DATE '1995-02-01' + CAST(c_custkey * 53 % 2300 AS INTEGER) AS start_date,
          DATE '1995-02-01' + CAST(c_custkey * 53 % 2300 AS INTEGER) + CAST(c_custkey % 60 AS INTEGER) AS end_date,
          CASE WHEN c_custkey % 31 <> 0 THEN 1000 + c_custkey % 977 END AS exposure
        FROM customer JOIN v_geo ON c_nationkey = n_nationkey JOIN part ON p_partkey = c_custkey) c
        ON c.category = s.category AND c.region = s.region AND s.ds BETWEEN start_date AND end_date GROUP BY ALL""",
    "scd2_apply": "SELECT sku, valid_from, category, brand, package_size, list_price, valid_to, is_current FROM v_versions",
    "ingest_curated": f"""SELECT transaction_id, {_any_format('ts')} AS transaction_ts, store_id, sku, TRY_CAST(qty AS DECIMAL(12,4)) AS quantity,
        TRY_CAST(unit_price AS DECIMAL(12,4)) AS unit_price, TRY_CAST(amount AS DECIMAL(14,4)) AS revenue, currency,
        'POS' AS source_system, 'lineitem.parquet' AS source_file, 1 AS load_batch_id FROM v_gate WHERE issue IS NULL""",
    "ingest_layers": """SELECT layer, CAST(b AS INTEGER) AS load_batch_id, n FROM (VALUES (1), (2)) t(b), (
        SELECT 'raw' AS layer, COUNT(*) AS n FROM v_feed UNION ALL SELECT 'csv', COUNT(*) FROM v_gate WHERE issue IS NULL
        UNION ALL SELECT 'error ' || issue, COUNT(*) FROM v_gate WHERE issue IS NOT NULL GROUP BY 1)""",
    "ingest_audit": f"""SELECT CAST(b AS INTEGER) AS load_batch_id, 'INCREMENTAL' AS load_type, COUNT(*) AS rows_in,
        COUNT(*) FILTER (issue IS NULL) AS attempted, COUNT(*) FILTER (issue IS NULL AND b = 1) AS inserted,
        COUNT(*) FILTER (issue IN ('DUPLICATE_ROW', 'PK_DUPLICATE')) AS deduped, COUNT(*) FILTER (issue IS NOT NULL) AS rejected,
        COUNT(*) FILTER (issue IS NULL AND (unit_price IS NULL) <> (amount IS NULL)) AS repaired,
        COUNT(*) FILTER (issue IS NULL AND (currency <> 'USD' OR sku NOT IN (SELECT sku FROM v_products)
            OR store_id NOT IN (SELECT store_id FROM v_stores))) AS flagged,
        COUNT(*) FILTER (issue IS NULL AND ts < newest - INTERVAL 7 DAY) AS late_arriving, 'pos_batch' AS feed
        FROM (SELECT * REPLACE ({_any_format('ts')} AS ts), MAX({_any_format('ts')}) OVER () AS newest FROM v_gate), (VALUES (1), (2)) t(b)
        GROUP BY b""",
    "scd2_merge": "SELECT sku, valid_from, category, brand, package_size, list_price, valid_to, is_current FROM v_versions",
    "scd2_asof_lookup": """SELECT transaction_id, transaction_ts, s.sku, s._row_idx AS row_idx, valid_from, brand, list_price
        FROM v_sales s LEFT JOIN v_versions v ON v.sku = s.sku AND CAST(transaction_ts AS DATE) >= valid_from
        AND (valid_to IS NULL OR CAST(transaction_ts AS DATE) <= valid_to)""",
    "late_arriving_flag": """SELECT _row_idx AS row_idx, transaction_id, COALESCE(transaction_ts < date_trunc('week', transaction_ts
        + CASE WHEN transaction_id LIKE '%-5' THEN INTERVAL 9 DAY ELSE INTERVAL 0 DAY END), FALSE) AS is_late_arriving FROM v_sales""",
    "repair_price": """SELECT _row_idx AS row_idx, COALESCE(unit_price, CAST(CAST(revenue AS DOUBLE) / CAST(quantity AS DOUBLE) AS DECIMAL(12,4))) AS unit_price,
        CASE WHEN unit_price IS NULL AND revenue IS NOT NULL THEN 'REPAIRED' END AS price_action FROM v_sales""",
    "repair_amount": """SELECT _row_idx AS row_idx, COALESCE(revenue, CAST(unit_price * quantity AS DECIMAL(14,4))) AS revenue,
        CASE WHEN revenue IS NULL AND unit_price IS NOT NULL THEN 'REPAIRED' END AS amount_action FROM v_sales""",
    "unknown_key_flag": """SELECT 'sku' AS key_name, sku AS key_value, _row_idx AS row_idx, 'FLAGGED' AS action FROM v_sales
        WHERE sku NOT IN (SELECT sku FROM v_products)
        UNION ALL SELECT 'store_id', store_id, _row_idx, 'FLAGGED' FROM v_sales WHERE store_id NOT IN (SELECT store_id FROM v_stores)""",
    "currency_normalize": """SELECT _row_idx AS row_idx, currency, revenue,
        CAST(revenue * CASE currency WHEN 'EUR' THEN 1.0800 WHEN 'USD' THEN 1 END AS DECIMAL(18,4)) AS revenue_usd,
        CASE WHEN currency IS NULL OR currency NOT IN ('EUR', 'USD') THEN 'FLAGGED' END AS currency_action FROM v_sales""",
    "quality_log_build": "SELECT * FROM v_log",
    "load_batch_audit": "SELECT * FROM v_batches",
    "stream_incremental_ingest": """SELECT CAST(event_id AS VARCHAR) AS transaction_id, date_trunc('second', ts) AS transaction_ts,
        CAST(user_id AS VARCHAR) AS store_id, event_type AS sku, CAST(CAST(value AS DECIMAL(12,2)) AS DECIMAL(14,4)) AS revenue,
        'EVENTS' AS source_system FROM events WHERE CAST(value AS DECIMAL(12,2)) > 0""",
    "stream_dedup": f"SELECT event_id, category, region, value FROM ({EVENT_ROWS})",
    "stream_late_flag": """SELECT event_id, arrived, coalesce(ts < newest - INTERVAL 2 DAY, false) AS is_late_arriving FROM (
        SELECT event_id, ts, CAST(ts AS DATE) + CASE WHEN event_id % 7 = 0 THEN 3 ELSE 0 END AS arrived,
          date_diff('day', DATE '2024-01-01', arrived) // 11 AS part FROM events) LEFT JOIN (
        SELECT k AS part, max(ts) AS newest FROM events, range(1, 3) AS r(k)
        WHERE date_diff('day', DATE '2024-01-01', CAST(ts AS DATE) + CASE WHEN event_id % 7 = 0 THEN 3 ELSE 0 END) // 11 < k GROUP BY k) USING (part)""",
    "stream_daily_revenue": f"""SELECT CAST(ts AS DATE) AS ds, category, region, CAST(SUM(value) AS DECIMAL(18,2)) AS revenue, COUNT(*) AS n
        FROM ({EVENT_ROWS}) GROUP BY 1, 2, 3""",
}


def _inventory() -> dict[str, str]:
    layers = {
        "raw": ["lineitem", "orders", "events"],
        "curated": ["customer", "nation", "part", "region", "supplier"],
        "public": ["benchmark", "conversations", "documents", "embeddings", "labels", "pages"],
    }
    parts = [
        f"SELECT '{s}' AS schema_name, '{n}' AS table_name, COUNT(*) AS row_count FROM {n}"
        for s, names in layers.items()
        for n in names
    ]
    listed = " UNION ALL ".join(parts)
    rolled = f"SELECT schema_name, table_name, CAST(SUM(row_count) AS BIGINT) AS row_count FROM ({listed}) GROUP BY ROLLUP (schema_name, table_name)"
    return {"catalog_join": listed, "table_inventory": rolled}


ORACLES = {name: _full(body) for name, body in {**BODIES, **_inventory()}.items()}
