"""Each query again as plain SQL, written from the definitions.

Here every order's discount is spread over its lines with a window, costs are joined
line by line and everything is summed from lines, whatever shortcut the Spark job
takes. The engine is DuckDB; the driver's tables are registered as views.
"""

from __future__ import annotations


def money(x: str) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(38,6)), 2) AS DOUBLE)"


def dbl(x: str) -> str:
    return f"CAST(CAST({x} AS DECIMAL(38,6)) AS DOUBLE)"


def ratio(num: str, den: str, scale: str = "1.0") -> str:
    """Guarded ratio, six decimals."""
    return dbl(raw_ratio(num, den, scale))


def raw_ratio(num: str, den: str, scale: str = "1.0") -> str:
    scale = f"CAST({scale} AS DOUBLE)"
    return f"CASE WHEN {dbl(den)} > 0 THEN {dbl(num)} / {dbl(den)} * {scale} ELSE CAST(0 AS DOUBLE) END"


def margin(profit: str, revenue: str) -> str:
    return (
        f"round_even({dbl(profit)} / NULLIF({dbl(revenue)}, 0) * CAST(100 AS DOUBLE), 1)"
    )


_PRODUCTS = """
products AS (
  SELECT p_partkey, p_brand, p_retailprice, p_name AS product_title,
         CASE WHEN p_partkey % 9 <> 0 THEN p_brand END AS variant_title,
         CASE WHEN p_partkey % 9 <> 0 THEN p_name || ' ' || p_brand ELSE p_name END AS product_key
  FROM part)"""

# Some products are listed twice, at another cost or at none.
_COSTS = """
listed_once AS (
  SELECT product_key,
         CAST(CAST(max(p_retailprice) AS DECIMAL(10,2)) * 0.55 AS DECIMAL(18,4)) AS cost_price
  FROM products WHERE p_brand <> 'Brand#5' GROUP BY product_key),
costs AS (
  SELECT * FROM listed_once
  UNION ALL
  SELECT product_key, CAST(cost_price + 1.5 AS DECIMAL(18,4)) FROM listed_once
  WHERE length(product_key) % 4 = 1
  UNION ALL
  SELECT product_key, NULL FROM listed_once WHERE length(product_key) % 4 = 2)"""

_HEADERS = """
headers AS (
  SELECT o_orderkey AS order_number, o_orderkey + 1000000 AS order_id,
         CAST(o_orderdate AS DATE) AS order_date,
         CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || 'T'
           || lpad(CAST(o_orderkey * 7 % 24 AS VARCHAR), 2, '0') || ':30:00'
           || CASE WHEN month(o_orderdate) BETWEEN 4 AND 10 THEN '+02:00' ELSE '+01:00' END
           AS order_created_at,
         'NOK' AS currency,
         CASE WHEN o_orderstatus = 'P' THEN 'refunded'
              WHEN o_orderkey % 50 = 7 THEN 'partially_refunded' ELSE 'paid' END AS financial_status,
         CASE WHEN o_orderstatus = 'O' OR (o_orderstatus = 'P' AND o_orderkey % 2 = 1)
              THEN 'unfulfilled' ELSE 'fulfilled' END AS fulfillment_status,
         CASE WHEN o_custkey % 10 = 3 THEN '' WHEN o_custkey % 10 = 4 THEN NULL
              ELSE c_name || '@example.org' END AS customer_email,
         CASE WHEN o_orderkey % 20 = 0 THEN 'Ukjent'
              WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Vipps/MobilePay Payments'
              ELSE 'shopify_payments' END AS payment_method,
         CASE WHEN o_orderkey = 1019 THEN 'KIRA30'
              WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Ingen rabatt'
              ELSE coalesce(c_mktsegment, 'Ingen rabatt') END AS discount_code,
         CASE WHEN o_orderkey % 70 = 0 THEN 'Ukjent' ELSE coalesce(n_name, 'Ukjent') END AS city,
         CAST(CASE WHEN o_orderkey % 3 <> 0 THEN 79 ELSE 0 END AS DECIMAL(18,4)) AS order_shipping,
         CAST(CASE WHEN o_orderkey % 4 = 1 THEN 50 ELSE 0 END AS DECIMAL(18,4))
           AS undistributed_discount,
         o_orderstatus
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey)"""

_LINES = (
    _PRODUCTS
    + ","
    + _COSTS
    + ","
    + _HEADERS
    + """,
raw_lines AS (
  SELECT l_orderkey AS order_number, l_partkey AS product_id, l_suppkey AS variant_id,
         row_number() OVER (PARTITION BY l_orderkey
                            ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS line_pos,
         product_key, product_title, variant_title,
         CAST(l_quantity AS INTEGER) AS quantity,
         CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS DECIMAL(18,4)) AS unit_price,
         CAST(CAST(p_retailprice AS DECIMAL(10,2)) * CAST(l_quantity AS INTEGER)
              AS DECIMAL(18,4)) AS item_value,
         CAST(CAST(p_retailprice AS DECIMAL(10,2)) * CAST(l_quantity AS INTEGER)
              * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS item_discount
  FROM lineitem JOIN products ON l_partkey = p_partkey),
valued AS (
  SELECT *, sum(item_value) OVER (PARTITION BY order_number) AS items_value FROM raw_lines),
allocated AS (
  SELECT v.*, h.* EXCLUDE (order_number),
         CASE WHEN undistributed_discount > 0 AND items_value > 0
              THEN CAST(round(CAST(undistributed_discount AS DOUBLE)
                   * (CAST(item_value AS DOUBLE) / CAST(items_value AS DOUBLE)), 9) AS DECIMAL(18,9))
              ELSE CAST(0 AS DECIMAL(18,9)) END AS order_discount_share,
         CASE WHEN line_pos = 0 THEN order_shipping ELSE CAST(0 AS DECIMAL(18,4)) END
           AS shipping_revenue
  FROM valued v JOIN headers h USING (order_number)),
priced AS (
  SELECT *, item_discount + order_discount_share AS total_discount,
         CAST(item_value - item_discount - order_discount_share AS DECIMAL(26,10)) AS item_revenue,
         CAST(item_value - item_discount - order_discount_share + shipping_revenue
              AS DECIMAL(26,10)) AS revenue
  FROM allocated),
net AS (
  SELECT *, CAST(CAST(revenue AS DECIMAL(24,9)) * 0.8 AS DECIMAL(26,10)) AS revenue_excl_mva,
         CAST(shipping_revenue * 0.8 AS DECIMAL(26,10)) AS shipping_revenue_excl_mva
  FROM priced),
sold AS (SELECT * FROM net WHERE financial_status <> 'refunded'),
lines AS (
  SELECT n.*, revenue - revenue_excl_mva AS mva_collected, cost_price,
         CAST(cost_price * quantity AS DECIMAL(26,10)) AS total_cost,
         revenue_excl_mva - CAST(cost_price * quantity AS DECIMAL(26,10)) AS profit,
         financial_status = 'refunded' AS is_refunded
  FROM net n LEFT JOIN costs USING (product_key)),
active AS (SELECT * FROM lines WHERE NOT is_refunded)"""
)

_ORDER_GRAIN = """
all_orders AS (
  SELECT order_number, any_value(order_id) AS order_id, any_value(order_date) AS order_date,
         any_value(order_created_at) AS order_created_at,
         any_value(financial_status) AS financial_status,
         any_value(fulfillment_status) AS fulfillment_status,
         any_value(customer_email) AS customer_email,
         any_value(payment_method) AS payment_method, any_value(city) AS city,
         any_value(discount_code) AS discount_code, bool_or(is_refunded) AS is_refunded,
         count(*) AS n_lines, count(*) - count(cost_price) AS unpriced_lines,
         sum(item_value) AS gross_sales, sum(total_discount) AS total_discount,
         sum(shipping_revenue) AS shipping_revenue, sum(revenue) AS revenue,
         sum(revenue_excl_mva) AS revenue_excl_mva, sum(mva_collected) AS mva_collected,
         coalesce(sum(total_cost), 0) AS total_cost, coalesce(sum(profit), 0) AS profit,
         coalesce(sum(revenue_excl_mva) FILTER (WHERE cost_price IS NOT NULL), 0)
           AS priced_revenue,
         any_value(total_discount) FILTER (WHERE line_pos = 0) AS first_line_discount
  FROM lines GROUP BY order_number),
placed AS (SELECT * FROM all_orders WHERE NOT is_refunded)"""

_CARD_FEES = """
card_fees AS (
  SELECT order_id, sum(fee) AS actual_fee FROM (
    SELECT o_orderkey + 1000000 AS order_id,
           CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 0.02 AS DECIMAL(18,4)) AS fee
    FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AND o_orderkey % 5 <> 0
    UNION ALL
    SELECT o_orderkey + 1000000, CAST(1.5 AS DECIMAL(18,4))
    FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AND o_orderkey % 25 = 1)
  GROUP BY order_id)"""

_WALLET = """
wallet AS (
  SELECT *, CASE WHEN total_captured > 0 THEN total_fees / total_captured
                 ELSE CAST(0 AS DOUBLE) END AS avg_rate
  FROM (SELECT CAST(sum(abs(CAST(-round(CAST(value AS DECIMAL(18,2)) * 2.66, 0) AS BIGINT)))
                    AS DOUBLE) / 100 AS total_fees,
               CAST(sum(CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT)) AS DOUBLE) / 100
                 AS total_captured,
               count(*) AS num_transactions
        FROM events WHERE event_type = 'purchase'
          AND CAST(ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-03-31')),
wallet_rate AS (
  SELECT CASE WHEN avg_rate > 0 THEN avg_rate ELSE CAST(0.02 AS DOUBLE) END AS rate FROM wallet)"""

# The two cost sheets as text, then parsed again.
_SHEETS = r"""
fixed_text AS (
  SELECT s_suppkey AS row_pos,
         CASE WHEN s_suppkey % 10 = 4 THEN 'Sum'
              WHEN s_suppkey % 10 = 8
                THEN 'Supplier#' || lpad(CAST(s_suppkey - 2 AS VARCHAR), 9, '0')
              ELSE s_name END AS name,
         format('{:,.2f}', s_acctbal) AS us,
         CASE WHEN s_suppkey % 10 = 7 THEN ''
              WHEN s_suppkey % 10 = 3 THEN replace(translate(us, ',.', '_,'), '_', '.')
              WHEN s_suppkey % 2 = 0
                THEN replace(translate(us, ',.', '_,'), '_', chr(160)) || chr(160) || 'kr'
              ELSE replace(translate(us, ',.', '_,'), '_', ' ') || ' kr' END AS text
  FROM supplier),
fixed_cells AS (
  SELECT row_pos, name, text,
         coalesce(TRY_CAST(replace(regexp_replace(text, 'kr|\x{00A0}| ', '', 'g'), ',', '.')
                           AS DECIMAL(18,4)), 0) AS amount
  FROM fixed_text),
fixed AS (
  SELECT name, arg_max(amount, row_pos) AS amount FROM fixed_cells
  WHERE text <> '' AND lower(name) <> 'sum' GROUP BY name),
order_text AS (
  SELECT s_suppkey AS row_pos,
         CASE s_suppkey % 10 WHEN 0 THEN 'Transaksjonsgebyr Vipps'
              WHEN 5 THEN 'Transaksjonsgebyr kort' WHEN 9 THEN 'Ca fraktkostnad'
              ELSE s_name END AS name,
         CASE s_suppkey % 10
              WHEN 0 THEN CAST(s_suppkey % 3 + 2 AS VARCHAR) || ',5% av ordrepris'
              WHEN 5 THEN '5% av ordrepris + 2 kr' WHEN 3 THEN '25 kr' WHEN 6 THEN ''
              WHEN 9 THEN CAST(s_suppkey % 7 + 40 AS VARCHAR) || ',50'
              ELSE replace(CAST(CAST(CAST(floor(abs(s_acctbal)) AS DECIMAL(12,0)) * 0.0001
                                     AS DECIMAL(12,4)) AS VARCHAR), '.', ',') END AS text
  FROM supplier),
order_cells AS (
  SELECT row_pos, name, text, TRY_CAST(replace(text, ',', '.') AS DECIMAL(18,4)) AS amount
  FROM order_text),
per_order AS (
  SELECT name, arg_max(amount, row_pos) AS amount FROM order_cells
  WHERE name NOT LIKE 'Transaksjonsgebyr%' AND amount IS NOT NULL GROUP BY name),
rule_cells AS (
  SELECT row_pos, CASE WHEN name LIKE '%Vipps' THEN 'vipps' ELSE 'kort' END AS method,
         CAST(CAST(replace(split_part(text, '%', 1), ',', '.') AS DECIMAL(12,8)) / 100
              AS DECIMAL(12,8)) AS rate,
         coalesce(TRY_CAST(trim(replace(split_part(text, '+', 2), 'kr', ''))
                           AS DECIMAL(18,4)), 0) AS fixed
  FROM order_text WHERE name LIKE 'Transaksjonsgebyr%'),
rules AS (
  SELECT method, arg_max(rate, row_pos) AS rate, arg_max(fixed, row_pos) AS fixed
  FROM rule_cells GROUP BY method),
sheet_totals AS (
  SELECT CAST((SELECT coalesce(sum(amount), 0) FROM fixed) AS DOUBLE) AS monthly,
         CAST((SELECT coalesce(sum(amount), 0) FROM per_order) AS DOUBLE) AS cost_per_order)"""

_FEES = """
fee_orders AS (
  SELECT o.*, f.actual_fee,
         CAST(coalesce(CAST(f.actual_fee AS DECIMAL(24,9)), CAST(
           CASE WHEN contains(lower(o.payment_method), 'vipps')
                THEN CAST(o.revenue_excl_mva AS DOUBLE) * w.rate
                ELSE CAST(o.revenue_excl_mva AS DOUBLE)
                     * coalesce((SELECT CAST(rate AS DOUBLE) FROM rules WHERE method = 'kort'), 0)
                     + coalesce((SELECT CAST(fixed AS DOUBLE) FROM rules WHERE method = 'kort'), 0)
           END AS DECIMAL(24,9))) AS DECIMAL(26,10)) AS txn_fee
  FROM all_orders o CROSS JOIN wallet_rate w LEFT JOIN card_fees f USING (order_id))"""

_PNL = f"""
totals AS (
  SELECT count(*) AS num_orders, sum(gross_sales) AS gross_sales,
         sum(total_discount) AS total_discount, sum(shipping_revenue) AS shipping_revenue,
         sum(revenue) AS revenue, sum(mva_collected) AS mva_collected,
         sum(revenue_excl_mva) AS revenue_excl_mva, sum(total_cost) AS total_cost,
         sum(txn_fee) AS txn_fee, min(order_date) AS first_day, max(order_date) AS last_day
  FROM fee_orders WHERE NOT is_refunded),
based AS (
  SELECT t.*, s.*, greatest(CAST(datediff('day', first_day, last_day) AS DOUBLE) / 30, 1.0)
           AS months,
         {dbl("revenue_excl_mva - total_cost")} AS gross_profit, {dbl("txn_fee")} AS fees,
         {dbl("revenue_excl_mva")} AS net_sales
  FROM totals t CROSS JOIN sheet_totals s),
pnl AS (
  SELECT *, cost_per_order * num_orders AS order_costs, monthly * months AS overhead,
         gross_profit - (fees + cost_per_order * num_orders) - monthly * months AS net_profit
  FROM based)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(p.strip("\n") for p in parts) + "\n"


LINES = _with(_LINES)
ORDERS = _with(_LINES, _ORDER_GRAIN)
FEES = _with(_LINES, _ORDER_GRAIN, _CARD_FEES, _WALLET, _SHEETS, _FEES)
PNL = _with(_LINES, _ORDER_GRAIN, _CARD_FEES, _WALLET, _SHEETS, _FEES, _PNL)
SHEETS = _with(_SHEETS)
ORDERS_SHEETS = _with(_LINES, _ORDER_GRAIN, _SHEETS)

_WEEK = "CAST(date_trunc('week', order_date) AS DATE)"
_KEY = "order_number, product_id, variant_id, product_key"
_TITLES = """,
titles AS (
  SELECT product_title, sum(revenue_excl_mva) AS sales, sum(quantity) AS units,
         sum(revenue_excl_mva) FILTER (WHERE cost_price IS NOT NULL) AS priced_sales,
         sum(quantity) FILTER (WHERE cost_price IS NOT NULL) AS priced_units,
         sum(total_cost) AS cost, coalesce(sum(profit), 0) AS profit
  FROM active WHERE product_title IS NOT NULL GROUP BY product_title)
"""
_LINE_FIELDS = f"""
SELECT order_number, order_id, order_date, order_created_at, product_key, product_title,
       variant_title, quantity, discount_code, currency, financial_status, fulfillment_status,
       product_id, variant_id, payment_method, city, customer_email,
       {dbl("unit_price")} AS unit_price, {dbl("item_discount")} AS item_discount,
       {dbl("total_discount")} AS total_discount, {dbl("shipping_revenue")} AS shipping_revenue,
       {dbl("order_discount_share")} AS order_discount_share
FROM net"""
_WEEKLY_PROFIT = f"""
SELECT {_WEEK} AS week, {money("sum(revenue_excl_mva)")} AS revenue_excl_mva,
       {money("coalesce(sum(total_cost), 0)")} AS total_cost,
       {money("coalesce(sum(profit), 0)")} AS profit
FROM active GROUP BY 1"""


def _line_amounts(table: str, *names: str) -> str:
    return f"SELECT {_KEY}, " + ", ".join(f"{money(n)} AS {n}" for n in names) + f" FROM {table}"


def _statement(rows: list[tuple[str, str]], table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT CAST({no} AS BIGINT) AS line_no, '{name}' AS post, {money(expr)} AS amount FROM {table}"
        for no, (name, expr) in enumerate(rows, start=1)
    )


def _sources() -> dict[str, str]:
    return {
        "orders_source": _with(_PRODUCTS, _HEADERS)
        + """
SELECT order_number, any_value(order_id) AS order_id,
       any_value(order_created_at) AS created_at,
       any_value(financial_status) AS financial_status,
       CAST(coalesce(sum(CAST(p_retailprice AS DECIMAL(10,2)) * CAST(l_quantity AS INTEGER)
                         * CAST(l_discount AS DECIMAL(4,2))), 0)
            + any_value(undistributed_discount) AS DOUBLE) AS total_discounts,
       count(l_orderkey) AS n_lines
FROM headers LEFT JOIN (lineitem JOIN products ON l_partkey = p_partkey)
  ON l_orderkey = order_number
GROUP BY order_number""",
        "card_fees_by_order": _with(_CARD_FEES)
        + f"SELECT order_id, {money('actual_fee')} AS actual_fee FROM card_fees",
        "wallet_fee_summary": _with(_WALLET)
        + f"SELECT total_fees, total_captured, {dbl('avg_rate')} AS avg_rate, num_transactions FROM wallet",
        "wallet_fee_default_window": _with(
            _WALLET.replace("DATE '2024-01-01' AND DATE '2024-03-31'", "DATE '2023-10-17' AND DATE '2024-01-15'")
        )
        + f"SELECT total_fees, total_captured, {dbl('avg_rate')} AS avg_rate, num_transactions FROM wallet",
        "product_costs": _with(_PRODUCTS, _COSTS)
        + f"""
SELECT product_key, {dbl("cost_price")} AS cost_price FROM costs
UNION ALL
SELECT DISTINCT product_key, CAST(NULL AS DOUBLE) FROM products
WHERE p_brand = 'Brand#5' AND variant_title IS NOT NULL AND length(product_key) % 2 = 0""",
        "fixed_monthly_costs": SHEETS + f"SELECT name, {dbl('amount')} AS amount FROM fixed",
        "fixed_monthly_total": SHEETS + f"SELECT {money('sum(amount)')} AS total FROM fixed",
        "parse_currency": SHEETS + f"SELECT row_pos, {dbl('amount')} AS amount FROM fixed_cells",
        "per_order_costs": SHEETS + f"SELECT name, {dbl('amount')} AS amount FROM per_order",
        "per_order_total": SHEETS + f"SELECT {money('sum(amount)')} AS total FROM per_order",
        "parse_fee_rule": SHEETS
        + f"SELECT method, {dbl('rate')} AS rate, {dbl('fixed')} AS fixed FROM rules",
        "parse_fixed_amount": SHEETS + f"SELECT row_pos, {dbl('amount')} AS amount FROM order_cells",
        "sink_tables": LINES
        + f"""
SELECT {_WEEK} AS week, {money("sum(revenue_excl_mva)")} AS revenue_excl_mva,
       {money("coalesce(sum(total_cost), 0)")} AS total_cost,
       {money("coalesce(sum(profit), 0)")} AS profit, count(*) AS n_lines
FROM active GROUP BY 1""",
    }


def _lines() -> dict[str, str]:
    return {
        "line_items": LINES + _LINE_FIELDS,
        "line_items_nested": LINES + _LINE_FIELDS,
        "line_items_aligned": LINES + _LINE_FIELDS,
        "order_fields": LINES
        + f"""
SELECT h.order_number, order_id, order_date, order_created_at, currency, financial_status,
       fulfillment_status, customer_email, payment_method, city, discount_code,
       {dbl("order_shipping")} AS order_shipping,
       {dbl("undistributed_discount")} AS undistributed_discount,
       {dbl("coalesce(items_value, 0)")} AS items_value
FROM headers h LEFT JOIN (SELECT order_number, sum(item_value) AS items_value
                          FROM raw_lines GROUP BY 1) v USING (order_number)""",
        "line_revenue": LINES + _line_amounts("net", "item_revenue", "revenue"),
        "vat_split": LINES
        + _line_amounts(
            "(SELECT *, revenue - revenue_excl_mva AS mva_collected FROM net)",
            "revenue_excl_mva",
            "mva_collected",
            "shipping_revenue_excl_mva",
        ),
        "cost_join": LINES + f"SELECT {_KEY}, {dbl('cost_price')} AS cost_price FROM lines",
        "line_profit": LINES
        + f"""
SELECT {_KEY}, {money("total_cost")} AS total_cost, {money("profit")} AS profit,
       {margin("profit", "revenue_excl_mva")} AS margin_pct FROM lines""",
        "refund_flag": LINES
        + "SELECT DISTINCT order_number, financial_status, is_refunded FROM lines",
        "active_lines": LINES + _line_amounts("sold", "revenue_excl_mva"),
    }


def _orders() -> dict[str, str]:
    totals = ["revenue_excl_mva", "total_cost", "total_discount", "shipping_revenue"]
    total_cols = ", ".join(f"{money(c)} AS {c}" for c in totals)
    return {
        "order_level": ORDERS
        + f"""
SELECT order_number, order_id, payment_method, {money("revenue")} AS revenue,
       {money("revenue_excl_mva")} AS revenue_excl_mva FROM placed""",
        "actual_fee_lookup": _with(_LINES, _ORDER_GRAIN, _CARD_FEES)
        + f"""
SELECT order_number, order_id, {money("actual_fee")} AS actual_fee
FROM placed LEFT JOIN card_fees USING (order_id)""",
        "txn_fee": FEES
        + f"""
SELECT order_number, payment_method, {money("txn_fee")} AS txn_fee
FROM fee_orders WHERE NOT is_refunded""",
        "txn_fee_aligned": FEES
        + f"""
SELECT order_number, payment_method, {money("txn_fee")} AS txn_fee
FROM fee_orders WHERE NOT is_refunded""",
        "order_totals": ORDERS
        + f"SELECT order_number, order_date, discount_code, customer_email, {total_cols} FROM placed",
        "order_table": ORDERS
        + f"""
SELECT order_number, order_date, is_refunded, discount_code, customer_email, n_lines,
       unpriced_lines, {total_cols}, {money("profit")} AS profit,
       {money("first_line_discount")} AS first_line_discount FROM all_orders""",
    }


def _profit_and_loss() -> dict[str, str]:
    pnl_rows = [
        ("Brutto varesalg (inkl. MVA)", "gross_sales"),
        ("Rabatter gitt", "-total_discount"),
        ("Fraktinntekter", "shipping_revenue"),
        ("Total omsetning (inkl. MVA)", "revenue"),
        ("MVA til staten (25%)", "-mva_collected"),
        ("Omsetning (eksl. MVA)", "revenue_excl_mva"),
        ("Varekostnad (COGS)", "-total_cost"),
        ("Bruttofortjeneste", "gross_profit"),
        ("Transaksjonsgebyrer", "-fees"),
        ("Ordrekostnader", "-order_costs"),
        ("Faste kostnader", "-overhead"),
        ("Netto resultat", "net_profit"),
    ]
    forecast_rows = [
        ("Projisert omsetning (eksl. MVA)", "revenue"),
        ("Projisert varekostnad", "-cost"),
        ("Projisert transaksjonsgebyrer", "-fees"),
        ("Projisert ordrekostnader", "-order_costs"),
        ("Faste kostnader (12 mnd)", "-overhead"),
        ("Projisert netto resultat", "revenue - cost - fees - order_costs - overhead"),
    ]
    forecast = (
        PNL.rstrip()
        + f""",
in_year AS (
  SELECT min(order_date) AS first_order_date, max(order_date) AS last_order_date,
         datediff('day', min(order_date), max(order_date)) + 1 AS days_with_data,
         {dbl("sum(revenue_excl_mva)")} AS sales, {dbl("sum(total_cost)")} AS cost,
         count(*) AS orders
  FROM fee_orders WHERE NOT is_refunded AND year(order_date) = 2000),
daily AS (
  SELECT *, sales / CAST(days_with_data AS DOUBLE) AS daily_revenue,
         cost / CAST(days_with_data AS DOUBLE) AS daily_cost,
         orders / CAST(days_with_data AS DOUBLE) AS daily_orders
  FROM in_year WHERE orders > 0),
forecast AS (
  SELECT first_order_date, last_order_date, days_with_data, daily_orders, daily_revenue,
         daily_revenue * 366.0::DOUBLE AS revenue, daily_cost * 366.0::DOUBLE AS cost,
         daily_revenue * 366.0::DOUBLE * (CASE WHEN p.net_sales > 0
           THEN p.fees / p.net_sales ELSE 0 END) AS fees,
         p.cost_per_order * (daily_orders * 366.0::DOUBLE) AS order_costs,
         p.monthly * 12 AS overhead
  FROM daily CROSS JOIN pnl p)
"""
    )
    net = "revenue - cost - fees - order_costs - overhead"
    contribution = raw_ratio("gross_profit - (fees + order_costs)", "num_orders")
    return {
        "headline_totals": ORDERS
        + f"""
SELECT count(*) FILTER (WHERE NOT is_refunded) AS num_orders,
       count(*) FILTER (WHERE is_refunded) AS num_refunded,
       CAST(sum(n_lines) FILTER (WHERE NOT is_refunded) AS BIGINT) AS n_lines,
       {money("sum(revenue) FILTER (WHERE NOT is_refunded)")} AS revenue,
       {money("sum(revenue_excl_mva) FILTER (WHERE NOT is_refunded)")} AS revenue_excl_mva,
       {money("sum(mva_collected) FILTER (WHERE NOT is_refunded)")} AS mva_collected,
       {money("sum(total_cost) FILTER (WHERE NOT is_refunded)")} AS total_cost,
       {money("sum(total_discount) FILTER (WHERE NOT is_refunded)")} AS total_discount,
       {money("sum(shipping_revenue) FILTER (WHERE NOT is_refunded)")} AS shipping_revenue,
       {money("sum(revenue_excl_mva - total_cost) FILTER (WHERE NOT is_refunded)")}
         AS gross_profit
FROM all_orders""",
        "overhead_for_period": PNL
        + f"""
SELECT {dbl("months")} AS months_covered, {money("monthly")} AS monthly_overhead,
       {money("monthly * months")} AS total_overhead FROM pnl""",
        "net_result": PNL
        + f"""
SELECT {money("gross_profit")} AS gross_profit, {money("fees")} AS total_txn_fees,
       {money("order_costs")} AS total_per_order_fixed,
       {money("fees + order_costs")} AS total_per_order_costs,
       {money("overhead")} AS total_fixed_overhead, {money("net_profit")} AS net_profit,
       {ratio("net_profit", "net_sales", "100")} AS net_margin_pct FROM pnl""",
        "fee_breakdown": FEES
        + f"""
, by_source AS (
  SELECT CASE WHEN actual_fee IS NOT NULL THEN 'actual' ELSE 'estimated' END AS fee_source,
         count(*) AS orders, sum(txn_fee) AS fees, sum(revenue_excl_mva) AS sales
  FROM fee_orders WHERE NOT is_refunded GROUP BY 1),
both_sources AS (
  SELECT fee_source, coalesce(orders, 0) AS orders, coalesce(fees, 0) AS fees,
         coalesce(sales, 0) AS sales
  FROM (VALUES ('actual'), ('estimated')) AS k(fee_source) LEFT JOIN by_source USING (fee_source))
SELECT fee_source, orders, {money("fees")} AS fees, {money("sales")} AS revenue_excl_mva,
       {ratio("fees", "sales", "100")} AS measured_rate_pct,
       CASE WHEN fee_source = 'actual' THEN {ratio("fees", "sales", "100")}
            ELSE {dbl("(SELECT rate FROM wallet_rate) * 100")} END AS shown_rate_pct
FROM both_sources""",
        "overall_fee_rate": PNL
        + f"""
SELECT {money("txn_fee")} AS total_txn_fees,
       {ratio("txn_fee", "revenue_excl_mva", "100")} AS avg_fee_rate_pct FROM pnl""",
        "pnl_statement": PNL + _statement(pnl_rows, "pnl"),
        "fixed_cost_table": SHEETS
        + f"""
SELECT name AS cost_name, {money("amount")} AS amount, 0 AS is_total FROM fixed
UNION ALL
SELECT 'Totalt (månedlig)', {money("coalesce(sum(amount), 0)")}, 1 FROM fixed""",
        "order_cost_table": ORDERS_SHEETS
        + f"""
, listed AS (
  SELECT name AS cost_name, {money("amount")} AS amount, 0 AS is_total FROM per_order
  UNION ALL
  SELECT 'Sum pr. bestilling', {money("coalesce(sum(amount), 0)")}, 1 FROM per_order)
SELECT *, {money("amount * (SELECT count(*) FROM placed)")} AS amount_all_orders FROM listed""",
        "unmatched_products": LINES
        + f"""
SELECT product_key, CAST(sum(quantity) AS BIGINT) AS quantity,
       {money("sum(revenue_excl_mva)")} AS revenue_excl_mva
FROM active WHERE cost_price IS NULL GROUP BY 1""",
        "unmatched_headline": LINES
        + """
SELECT count(DISTINCT product_key) AS products, count(*) AS n_lines
FROM active WHERE cost_price IS NULL""",
        "year_forecast": forecast
        + f"""
SELECT first_order_date, last_order_date, CAST(days_with_data AS BIGINT) AS days_with_data,
       {dbl("daily_orders")} AS daily_orders, {money("daily_revenue")} AS daily_revenue,
       {money("revenue")} AS projected_revenue, {money(net)} AS projected_net,
       {ratio(net, "revenue", "100")} AS projected_margin_pct FROM forecast""",
        "forecast_by_day": FEES
        + f"""
, day_sums AS (
  SELECT order_date, count(*) AS orders, sum(revenue_excl_mva) AS sales, sum(total_cost) AS cost,
         sum(txn_fee) AS fees
  FROM fee_orders WHERE NOT is_refunded GROUP BY order_date),
known AS (
  SELECT a.order_date AS as_of, year(a.order_date) = year(b.order_date) AS in_year, b.*
  FROM day_sums a JOIN day_sums b ON b.order_date <= a.order_date),
sums AS (
  SELECT as_of, min(order_date) FILTER (WHERE in_year) AS first_order_date,
         max(order_date) FILTER (WHERE in_year) AS last_order_date,
         sum(orders) FILTER (WHERE in_year) AS orders, {dbl("sum(sales) FILTER (WHERE in_year)")} AS sales,
         {dbl("sum(cost) FILTER (WHERE in_year)")} AS cost, {dbl("sum(fees)")} AS all_fees,
         {dbl("sum(sales)")} AS all_sales
  FROM known GROUP BY as_of),
daily AS (
  SELECT *, datediff('day', first_order_date, last_order_date) + 1 AS days_with_data,
         sales / CAST(days_with_data AS DOUBLE) AS daily_revenue,
         cost / CAST(days_with_data AS DOUBLE) AS daily_cost,
         CAST(orders AS DOUBLE) / CAST(days_with_data AS DOUBLE) AS daily_orders,
         CAST(dayofyear(make_date(year(as_of), 12, 31)) AS DOUBLE) AS days
  FROM sums),
forecast AS (
  SELECT d.* EXCLUDE (cost), daily_revenue * days AS revenue, daily_cost * days AS cost,
         daily_revenue * days * (CASE WHEN all_sales > 0 THEN all_fees / all_sales ELSE 0 END) AS fees,
         cost_per_order * (daily_orders * days) AS order_costs, monthly * 12 AS overhead
  FROM daily d CROSS JOIN sheet_totals)
SELECT as_of, first_order_date, last_order_date, CAST(days_with_data AS BIGINT) AS days_with_data,
       {dbl("daily_orders")} AS daily_orders, {money("daily_revenue")} AS daily_revenue,
       {money("revenue")} AS projected_revenue, {money(net)} AS projected_net,
       {ratio(net, "revenue", "100")} AS projected_margin_pct FROM forecast""",
        "forecast_statement": forecast + _statement(forecast_rows, "forecast"),
        "break_even": PNL
        + f"""
, per_order_result AS (SELECT *, {contribution} AS contribution FROM pnl)
SELECT {money("contribution")} AS contribution_per_order,
       {dbl("CASE WHEN contribution > 0 THEN monthly / contribution ELSE 0 END")}
         AS break_even_orders,
       {dbl("num_orders / months")} AS orders_per_month
FROM per_order_result""",
        "price_scenario": _with(_PRODUCTS)
        + f"""
, price_list AS (
  SELECT product_key, CAST(CAST(max(p_retailprice) AS DECIMAL(10,2)) AS DECIMAL(18,4)) AS price
  FROM products GROUP BY 1),
opened AS (
  SELECT product_key, {dbl("CAST(price * 0.55 AS DECIMAL(18,4))")} AS cost, factor,
         CAST(price * factor AS DECIMAL(18,4)) AS gross
  FROM price_list, (VALUES (0.8), (1.0), (1.25)) AS f(factor)),
priced AS (
  SELECT *, {dbl("gross * 0.8")} AS net, {dbl("gross - gross * 0.8")} AS mva,
         {dbl("gross * 0.8")} - cost AS earned
  FROM opened WHERE gross > 0)
SELECT product_key, CAST(factor AS DOUBLE) AS price_factor, {money("gross")} AS sell_price,
       {money("net")} AS sell_price_excl_mva, {money("mva")} AS mva,
       {money("earned")} AS gross_profit, {ratio("earned", "net", "100")} AS margin_pct,
       {money("net * CAST(0.02 AS DOUBLE)")} AS wallet_fee,
       {money("earned - net * CAST(0.02 AS DOUBLE)")} AS net_after_wallet_fee,
       {money("net * CAST(0.05 AS DOUBLE) + 2")} AS card_fee,
       {money("earned - (net * CAST(0.05 AS DOUBLE) + 2)")} AS net_after_card_fee
FROM priced""",
    }


def _time() -> dict[str, str]:
    weekday = "(isodow(CAST(substr(order_created_at, 1, 10) AS DATE)) - 1)"
    hour = "CAST(substr(order_created_at, 12, 2) AS INTEGER)"
    names = "['Mandag','Tirsdag','Onsdag','Torsdag','Fredag','Lørdag','Søndag']"
    shipping_cost = "coalesce((SELECT amount FROM per_order WHERE name = 'Ca fraktkostnad'), 0)"
    return {
        "one_pass_reports": ORDERS
        + " UNION ALL ".join(
            f"""
SELECT '{name}' AS report, CAST({key} AS VARCHAR) AS key, count(*) AS orders,
       {", ".join(f"{money(f'sum({c})')} AS {c}" for c in ("revenue_excl_mva", "total_cost", "profit", "total_discount"))}
FROM placed GROUP BY 2"""
            for name, key in (("week", _WEEK), ("order_date", "order_date"), ("payment_method", "payment_method"),
                              ("city", "city"), ("discount_code", "discount_code"))
        ),
        "weekly_profit": LINES + _WEEKLY_PROFIT,
        "overall_aov": ORDERS
        + f"SELECT {money(raw_ratio('sum(revenue_excl_mva)', 'count(*)'))} AS aov FROM placed",
        "weekly_aov": ORDERS
        + f"""
SELECT {_WEEK} AS week, {money("sum(revenue_excl_mva)")} AS revenue_excl_mva,
       count(*) AS orders, {money(f"{dbl('sum(revenue_excl_mva)')} / count(*)")} AS aov
FROM placed GROUP BY 1""",
        "daily_orders": LINES
        + "SELECT order_date, count(DISTINCT order_number) AS orders FROM active GROUP BY 1",
        "orders_per_day": ORDERS
        + f"""
SELECT count(*) AS orders,
       datediff('day', min(order_date), max(order_date)) + 1 AS calendar_days,
       {money("count(*) / CAST(datediff('day', min(order_date), max(order_date)) + 1 AS DOUBLE)")}
         AS orders_per_day
FROM placed""",
        "weekday_pattern": ORDERS
        + f"""
SELECT CAST({weekday} AS INTEGER) AS weekday, {names}[{weekday} + 1] AS weekday_name,
       count(*) AS orders FROM placed GROUP BY 1, 2""",
        "hour_pattern": ORDERS
        + f"""
SELECT CAST(h AS INTEGER) AS hour, lpad(CAST(h AS VARCHAR), 2, '0') || ':00' AS hour_label,
       count(order_number) AS orders
FROM range(24) AS r(h) LEFT JOIN placed ON {hour} = h GROUP BY h""",
        "peak_times": ORDERS
        + f"""
SELECT (SELECT {names}[d + 1] FROM (SELECT {weekday} AS d, count(*) AS n FROM placed GROUP BY 1)
        ORDER BY n DESC, d LIMIT 1) AS peak_weekday,
       (SELECT h FROM (SELECT {hour} AS h, count(*) AS n FROM placed GROUP BY 1)
        ORDER BY n DESC, h LIMIT 1) AS peak_hour""",
        "weekly_shipping": ORDERS_SHEETS
        + f"""
, weeks AS (
  SELECT {_WEEK} AS week, sum(shipping_revenue) AS income, count(*) AS orders
  FROM placed GROUP BY 1)
SELECT week, 'Fraktinntekter' AS kind, {money("income")} AS amount FROM weeks
UNION ALL
SELECT week, 'Estimert fraktkostnad', {money(f"orders * {shipping_cost}")} FROM weeks""",
        "shipping_result": ORDERS_SHEETS
        + f"""
SELECT {money("sum(shipping_revenue)")} AS shipping_revenue,
       {money(f"{shipping_cost} * count(*)")} AS estimated_shipping_cost,
       {money(f"sum(shipping_revenue) - {shipping_cost} * count(*)")} AS shipping_result
FROM placed""",
    }


def _products() -> dict[str, str]:
    titles = LINES.rstrip() + _TITLES
    return {
        "top_products_profit": titles
        + f"""
SELECT product_title, {money("profit")} AS profit, {money("sales")} AS revenue_excl_mva,
       CAST(units AS BIGINT) AS quantity
FROM titles ORDER BY titles.profit DESC, product_title LIMIT 15""",
        "product_margin": titles
        + f"""
SELECT product_title, {money("priced_sales")} AS revenue_excl_mva, {money("cost")} AS total_cost,
       {money("profit")} AS profit, CAST(priced_units AS BIGINT) AS quantity,
       {margin("profit", "priced_sales")} AS margin_pct
FROM titles WHERE priced_units IS NOT NULL""",
        "best_sellers": titles
        + f"""
SELECT product_title, CAST(units AS BIGINT) AS quantity, {money("sales")} AS revenue_excl_mva
FROM titles ORDER BY units DESC, product_title LIMIT 15""",
        "contribution_margin": titles
        + f"""
SELECT product_title, {money("profit")} AS contribution,
       {money("priced_sales")} AS revenue_excl_mva, CAST(priced_units AS BIGINT) AS quantity
FROM titles WHERE priced_units IS NOT NULL
ORDER BY titles.profit DESC, product_title LIMIT 15""",
        "best_product": titles
        + f"""
SELECT * FROM
  (SELECT product_title AS revenue_product, {money("sales")} AS revenue_excl_mva
   FROM titles ORDER BY sales DESC, product_title LIMIT 1),
  (SELECT product_title AS profit_product, {money("profit")} AS profit
   FROM titles ORDER BY titles.profit DESC, product_title LIMIT 1),
  (SELECT product_title AS quantity_product, CAST(units AS BIGINT) AS quantity
   FROM titles ORDER BY units DESC, product_title LIMIT 1)""",
    }


def _customers() -> dict[str, str]:
    known = "coalesce(customer_email, '') <> ''"
    counts = (
        ORDERS
        + f", counts AS (SELECT customer_email, count(*) AS n FROM placed WHERE {known} GROUP BY 1)\n"
    )
    return {
        "repeat_customers": counts
        + f"""
SELECT count(*) AS unique_customers, count(*) FILTER (WHERE n >= 2) AS repeat_customers,
       {ratio("count(*) FILTER (WHERE n >= 2)", "count(*)", "100")} AS repeat_rate_pct
FROM counts""",
        "order_frequency": counts
        + """
SELECT '1 bestilling' AS order_frequency, count(*) FILTER (WHERE n = 1) AS customers FROM counts
UNION ALL SELECT '2 bestillinger', count(*) FILTER (WHERE n = 2) FROM counts
UNION ALL SELECT '3+ bestillinger', count(*) FILTER (WHERE n >= 3) FROM counts""",
        "payment_summary": LINES
        + f"""
SELECT CASE payment_method WHEN 'shopify_payments' THEN 'Kort (Shopify Payments)'
            WHEN 'Vipps/MobilePay Payments' THEN 'Vipps' ELSE payment_method END
         AS payment_method,
       count(DISTINCT order_number) AS orders, {money("sum(revenue_excl_mva)")} AS revenue_excl_mva
FROM active GROUP BY active.payment_method""",
        "city_top": LINES
        + f"""
SELECT city, count(DISTINCT order_number) AS orders,
       {money("sum(revenue_excl_mva)")} AS revenue_excl_mva
FROM active GROUP BY city ORDER BY orders DESC, city LIMIT 15""",
        "best_customer": ORDERS
        + f"""
SELECT customer_email, count(*) AS orders, {money("sum(revenue_excl_mva)")} AS revenue_excl_mva
FROM placed WHERE {known} GROUP BY 1 ORDER BY orders DESC, customer_email LIMIT 1""",
    }


def _discounts() -> dict[str, str]:
    plain = "(discount_code = 'Ingen rabatt' OR total_discount <= 0)"
    baseline = f"""
, baseline AS (
  SELECT coalesce({dbl("sum(revenue_excl_mva)")} / CAST(NULLIF(count(*), 0) AS DOUBLE), 0) AS mean
  FROM placed WHERE {plain})
"""
    return {
        "discount_usage": ORDERS
        + f"""
SELECT discount_code, count(*) AS orders,
       {money("sum(first_line_discount)")} AS first_line_discount,
       {money("sum(total_discount)")} AS all_line_discount,
       {money("sum(revenue_excl_mva)")} AS revenue_excl_mva,
       {money("coalesce(sum(profit), 0)")} AS profit
FROM placed GROUP BY 1""",
        "discount_baseline": ORDERS
        + baseline
        + f"SELECT {money('mean')} AS baseline_aov FROM baseline",
        "discount_profitability": ORDERS
        + baseline
        + f"""
SELECT discount_code, orders, {money("own")} AS mean_order_value,
       {money("mean")} AS baseline_aov, {money("discount")} AS total_discount,
       {money("sales")} AS revenue_excl_mva,
       CASE WHEN own > mean THEN 'Høyere ordreverdi' ELSE 'Lavere ordreverdi' END AS verdict
FROM (SELECT discount_code, count(*) AS orders, sum(total_discount) AS discount,
             sum(revenue_excl_mva) AS sales,
             {dbl("sum(revenue_excl_mva)")} / CAST(count(*) AS DOUBLE) AS own
      FROM placed WHERE NOT {plain} GROUP BY 1) CROSS JOIN baseline""",
    }


def _records() -> dict[str, str]:
    def top(table: str, key: str, metric: str, key_as: str, metric_as: str, out: str) -> str:
        return (
            f"(SELECT {key} AS {key_as}, {out} AS {metric_as} FROM {table} "
            f"ORDER BY {table}.{metric} DESC, {key} LIMIT 1)"
        )

    def periods(name: str, expr: str) -> str:
        return f""", {name} AS (
  SELECT {expr} AS period, sum(revenue_excl_mva) AS sales, sum(profit) AS earned,
         count(*) AS n FROM placed GROUP BY 1)
"""

    return {
        "best_day": ORDERS
        + periods("days", "order_date")
        + "SELECT * FROM "
        + top("days", "period", "sales", "revenue_day", "revenue_excl_mva", money("sales"))
        + ", "
        + top("days", "period", "n", "orders_day", "orders", "n"),
        "best_week": ORDERS
        + periods("weeks", _WEEK)
        + "SELECT * FROM "
        + top("weeks", "period", "sales", "revenue_week", "revenue_excl_mva", money("sales"))
        + ", "
        + top("weeks", "period", "earned", "profit_week", "profit", money("earned"))
        + ", "
        + top("weeks", "period", "n", "orders_week", "orders", "n"),
        "biggest_order": ORDERS
        + f"""
SELECT order_number, order_date, {money("revenue_excl_mva")} AS revenue_excl_mva
FROM placed ORDER BY placed.revenue_excl_mva DESC, order_number LIMIT 1""",
    }


def _lists() -> dict[str, str]:
    return {
        "unfulfilled_count": LINES
        + """
SELECT count(DISTINCT order_number) AS open_orders
FROM active WHERE fulfillment_status = 'unfulfilled'""",
        "unfulfilled_orders": LINES
        + f"""
SELECT order_number, order_date, city, {money("sum(revenue_excl_mva)")} AS revenue_excl_mva,
       string_agg(product_key, ', ' ORDER BY line_pos) AS products
FROM active WHERE fulfillment_status = 'unfulfilled'
GROUP BY order_number, order_date, city""",
        "orders_summary": ORDERS
        + f"""
SELECT order_number, order_date, financial_status,
       {money("revenue_excl_mva")} AS revenue_excl_mva, {money("total_cost")} AS total_cost,
       {money("profit")} AS profit, {margin("profit", "revenue_excl_mva")} AS margin_pct
FROM placed""",
        "line_detail": LINES
        + f"""
SELECT order_number, order_date, product_key, quantity, {dbl("unit_price")} AS unit_price,
       {money("revenue_excl_mva")} AS revenue_excl_mva, {dbl("cost_price")} AS cost_price,
       {money("total_cost")} AS total_cost, {money("profit")} AS profit,
       {margin("profit", "revenue_excl_mva")} AS margin_pct
FROM active""",
    }


def _checks() -> dict[str, str]:
    sales = "sum(item_value) - sum(total_discount) + sum(shipping_revenue)"
    vat = "sum(revenue_excl_mva) + sum(mva_collected)"
    return {
        "cost_coverage": ORDERS
        + f"""
SELECT CAST(sum(n_lines) AS BIGINT) AS n_lines,
       CAST(sum(n_lines - unpriced_lines) AS BIGINT) AS priced_lines,
       {ratio("sum(n_lines - unpriced_lines)", "sum(n_lines)", "100")} AS lines_pct,
       {money("sum(revenue_excl_mva)")} AS revenue_excl_mva,
       {money("sum(priced_revenue)")} AS priced_revenue_excl_mva,
       {ratio("sum(priced_revenue)", "sum(revenue_excl_mva)", "100")} AS revenue_pct
FROM placed""",
        "duplicate_cost_keys": _with(_PRODUCTS, _COSTS)
        + """
SELECT product_key, count(*) AS listings FROM costs GROUP BY 1 HAVING count(*) > 1""",
        "reconciliation": LINES
        + " UNION ALL ".join(
            f"""
SELECT '{name}' AS identity, {money(left)} AS left_side, {money("sum(revenue)")} AS right_side,
       {money(f"{left} - sum(revenue)")} AS difference FROM active"""
            for name, left in (("sales", sales), ("vat", vat))
        ),
        "allocation_check": LINES
        + """
, per_order AS (
  SELECT order_number, sum(order_discount_share) AS share, sum(shipping_revenue) AS shipping,
         any_value(undistributed_discount) AS due, any_value(order_shipping) AS ship_due,
         sum(item_value) AS value, count(*) AS n
  FROM net GROUP BY 1)
SELECT count(*) AS orders,
       count(*) FILTER (WHERE abs(share - CASE WHEN value > 0 THEN due ELSE 0 END) > n * 0.00001)
         AS orders_with_share_gap,
       count(*) FILTER (WHERE abs(shipping - ship_due) > 0) AS orders_with_shipping_gap
FROM per_order""",
    }


def _streaming() -> dict[str, str]:
    def best(record: str, table: str, key: str, metric: str) -> str:
        return f"(SELECT '{record}' AS record, {key} AS key, {money(metric)} AS value FROM {table} ORDER BY {metric} DESC, key LIMIT 1)"

    def per(key: str) -> str:
        return f"(SELECT {key} AS k, count(*) AS n, sum(sales) AS sales FROM o GROUP BY 1)"

    day, week = per("CAST(order_date AS VARCHAR)"), per(f"CAST({_WEEK} AS VARCHAR)")
    customers = "(SELECT customer_email AS k, count(*) AS n FROM o WHERE coalesce(customer_email, '') <> '' GROUP BY 1)"
    records = [
        best("day_revenue_excl_mva", day, "k", "sales"),
        best("day_orders", day, "k", "n"),
        best("week_revenue_excl_mva", week, "k", "sales"),
        best("week_orders", week, "k", "n"),
        best("order_revenue_excl_mva", "o", "lpad(CAST(order_number AS VARCHAR), 20, '0')", "sales"),
        best("customer_orders", customers, "k", "n"),
        best("weekday_orders", per("CAST(isodow(order_date) - 1 AS VARCHAR)"), "k", "n"),
        best("hour_orders", per("substr(order_created_at, 12, 2)"), "k", "n"),
        f"SELECT 'customers', CAST(least(n, 3) AS VARCHAR), {money('count(*)')} FROM {customers} GROUP BY 2",
    ]

    def sales(period: str) -> str:
        return (
            LINES
            + f"""
SELECT {period} AS period_start, count(DISTINCT order_number) AS orders,
       {money("sum(revenue)")} AS revenue, {money("sum(revenue_excl_mva)")} AS revenue_excl_mva
FROM sold GROUP BY 1"""
        )

    # Refunded orders land in two states. The first damage that fits an order is done to its documents.
    quarantine = """
WITH d AS (
  SELECT CASE WHEN o_orderkey % 97 = 0 THEN 'not an order document' WHEN o_orderkey % 89 = 1 THEN 'amount'
              WHEN o_orderkey % 83 = 2 THEN 'no order day' WHEN o_orderkey % 79 = 3 THEN 'loyalty_tier' END AS damage,
         CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END * greatest(1, ceil(coalesce(n, 0) / 1000)) AS documents
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
), known AS (
  -- Fields of the landed documents that the schema doesn't list: none but the planted one.
  SELECT 'unknown field' AS kind, damage AS name, documents FROM d WHERE damage = 'loyalty_tier'
  UNION ALL SELECT 'problem', damage, documents FROM d WHERE damage <> 'loyalty_tier'
  UNION ALL SELECT CASE WHEN damage <> 'loyalty_tier' THEN 'rejected' ELSE 'good' END, '', documents FROM d
)
SELECT kind, name, CAST(sum(documents) AS BIGINT) AS documents FROM known GROUP BY 1, 2"""

    return {
        "order_differences": """
SELECT order_number, CASE WHEN order_number % 997 = 5 THEN 'missing right' ELSE 'changed' END AS difference
FROM (SELECT DISTINCT l_orderkey AS order_number FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
WHERE order_number % 997 = 5 OR order_number % 499 = 3""",
        "orders_quarantine": quarantine,
        "incremental_orders": LINES + _WEEKLY_PROFIT,
        "streaming_daily_sales": sales("order_date"),
        "streaming_weekly_sales": sales(_WEEK),
        "streaming_records": LINES
        + """
, o AS (
  SELECT order_number, any_value(order_date) AS order_date, any_value(order_created_at) AS order_created_at,
         any_value(customer_email) AS customer_email, sum(revenue_excl_mva) AS sales FROM sold GROUP BY 1)
"""
        + " UNION ALL ".join(records),
        # A week is closed once its end lies two weeks before the newest order's week.
        "streaming_final_sales": f"""
SELECT period_start, period_start + 7 <= last - 14 AS is_final, orders, revenue, revenue_excl_mva
FROM ({sales(_WEEK)}), (SELECT max({_WEEK}) AS last FROM (SELECT CAST(o_orderdate AS DATE) AS order_date FROM orders))""",
    }


def all_sql() -> dict[str, str]:
    parts = [
        _sources(),
        _lines(),
        _orders(),
        _profit_and_loss(),
        _time(),
        _products(),
        _customers(),
        _discounts(),
        _records(),
        _lists(),
        _checks(),
        _streaming(),
    ]
    return {name: sql for part in parts for name, sql in part.items()}
