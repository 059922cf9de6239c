"""The same queries in plain SQL, written apart from the Spark code.

Each text runs on the given tables alone. The SQL takes the direct way, with
whole-group windows and medians over raw rows, and knows no roll-up.
"""

from __future__ import annotations

TABLES = {
    "snap": """
SELECT ts AS timestamp, cast(ts AS date) AS date,
  user_id AS product_id,
  user_id * 10 + event_id % 2 AS sku_id,
  concat('P', cast(user_id AS varchar)) AS title,
  cast(3 + (user_id % 20) / 10.0 AS decimal(9,2)) AS rating,
  cast(CASE WHEN user_id % 50 = 49 THEN 124 ELSE 1000 + user_id % 50 END AS bigint) AS latest_category_id,
  cast(floor(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) / 3.0) AS bigint) AS reviews_amount,
  cast(sum(cast(floor(value / 20) AS bigint)) OVER (PARTITION BY user_id ORDER BY ts, event_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
       + 10 - CASE WHEN event_type = 'error' THEN 8 ELSE 0 END AS bigint) AS total_orders_amount,
  cast(500 - (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) % 53) * 7 AS bigint) AS total_available_amount,
  cast(200 - (row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) % 41) * 5 AS bigint) AS available_amount,
  concat('ph', cast(event_id % 4 AS varchar)) AS photo_key,
  user_id % 20 AS seller_id,
  500 + (user_id % 20) % 7 AS seller_account_id,
  concat('Shop ', cast(user_id % 20 AS varchar)) AS seller_title,
  concat('shop-', cast(user_id % 20 AS varchar)) AS seller_link,
  cast(DATE '2020-01-01' + cast(user_id % 20 AS integer) AS timestamp) AS seller_registration_date,
  user_id % 3 = 0 AS is_eco,
  user_id % 11 = 0 AS is_adult,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE cast(105000 + (user_id % 17) * 1000 AS bigint) END AS full_price,
  cast(100000 + (user_id % 17) * 1000 + (event_id % 7) * 100 AS bigint) AS purchase_price,
  CASE WHEN user_id % 10 = 0 THEN 5 ELSE 0 END AS restriction
FROM events""",
    "edges": """
SELECT cast(r_regionkey + 1 AS bigint) AS category_id, cast(0 AS bigint) AS parent_category_id, r_name AS title FROM region
UNION ALL SELECT cast(100 + n_nationkey AS bigint), cast(n_regionkey + 1 AS bigint), n_name FROM nation
UNION ALL SELECT cast(1000 + n_nationkey AS bigint), cast(100 + n_nationkey AS bigint), concat(n_name, '-A') FROM nation
UNION ALL SELECT cast(1025 + n_nationkey AS bigint), cast(100 + n_nationkey AS bigint), concat(n_name, '-B')
  FROM nation WHERE n_nationkey < 24""",
    "closure": """
SELECT parent_category_id AS root_id, category_id, 1 AS level FROM edges
UNION ALL
SELECT e.parent_category_id, c.category_id, c.level + 1 FROM closure c JOIN edges e ON c.root_id = e.category_id""",
    "subtree": """
SELECT root_id, category_id FROM closure WHERE root_id <> 0
UNION ALL
SELECT category_id, category_id FROM edges
WHERE category_id NOT IN (SELECT parent_category_id FROM edges)""",
    "tops": "SELECT category_id AS root_id FROM edges WHERE parent_category_id = 0",
    "pos": """
SELECT ts AS timestamp, user_id AS product_id, user_id * 10 + event_id % 2 AS sku_id,
  cast(CASE WHEN user_id % 50 = 49 THEN 124 ELSE 1000 + user_id % 50 END AS bigint) AS category_id,
  1 + event_id % 100 AS position
FROM events WHERE event_type = 'view'""",
    "payments": """
SELECT o_orderkey AS payment_id, o_custkey AS user_id, o_orderdate AS created_at,
  CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status,
  cast(o_orderkey % 3 + 1 AS int) AS subscription_type, cast(o_orderkey % 4 AS int) AS multiply,
  cast(o_totalprice AS decimal(18,2)) AS amount
FROM orders""",
    "requests": """
SELECT o_orderkey AS job_id, o_custkey % 50 AS user_id, o_orderdate AS created_at,
  CASE WHEN o_orderkey % 2 = 0 THEN 'seller' ELSE 'category' END AS report_type,
  cast(o_orderdate AS date) - cast(o_orderkey % 5 AS integer) AS to_date,
  cast(o_orderdate AS date) - cast(o_orderkey % 5 AS integer) - cast(o_orderkey % 130 AS integer) AS from_date
FROM orders""",
    "plans": """
SELECT c_custkey AS user_id,
  CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'demo' WHEN 2 THEN 'default' WHEN 3 THEN 'advanced' ELSE 'pro' END AS subscription_type,
  CASE WHEN c_custkey % 7 = 0 THEN TIMESTAMP '1999-01-01' ELSE TIMESTAMP '2030-01-01' END AS subscription_end_at
FROM customer""",
    "access": """
SELECT ts, user_id % 5 AS api_key, concat('10.0.0.', cast(event_id % 8 AS varchar)) AS ip, event_type AS browser
FROM events""",
    "skuday": """
SELECT date, product_id, sku_id,
  arg_max(title, (timestamp, title)) AS title,
  arg_max(photo_key, (timestamp, photo_key)) AS photo_key,
  arg_max(reviews_amount, (timestamp, reviews_amount)) AS reviews_amount,
  max(latest_category_id) AS category_id,
  min(total_orders_amount) AS low, max(total_orders_amount) AS high,
  min(available_amount) AS stock_low, max(available_amount) AS stock_high,
  quantile_cont(full_price, 0.5) AS median_full_price,
  quantile_cont(purchase_price, 0.5) AS median_price,
  max(seller_id) AS seller_id, max(seller_account_id) AS seller_account_id,
  max(seller_title) AS seller_title, max(seller_link) AS seller_link,
  max(seller_registration_date) AS seller_registration_date,
  max(rating) AS rating, bool_or(is_eco) AS is_eco, bool_or(is_adult) AS is_adult,
  max(timestamp) AS last_seen
FROM snap GROUP BY date, product_id, sku_id""",
    "raw": """
SELECT s.*, k.category_id AS cat, k.seller_link AS klink, k.seller_id AS kseller
FROM snap s JOIN skuday k ON s.product_id = k.product_id AND s.sku_id = k.sku_id AND s.date = k.date""",
}

DAY = """
  min(total_orders_amount) AS low, max(total_orders_amount) AS high,
  min(available_amount) AS stock, quantile_cont(purchase_price, 0.5) AS median,
  quantile_cont(full_price, 0.5) AS median_full,
  max(seller_title) AS seller_title, max(rating) AS rating,
  arg_max(title, (timestamp, sku_id, title)) AS title,
  arg_max(photo_key, (timestamp, sku_id, photo_key)) AS photo_key,
  arg_max(reviews_amount, (timestamp, sku_id, reviews_amount)) AS reviews_amount,
  arg_max(cat, (timestamp, sku_id, cat)) AS category_id,
  arg_max(kseller, (timestamp, sku_id, kseller)) AS seller_id,
  arg_max(klink, (timestamp, sku_id, klink)) AS seller_link"""


def orders_of(scope: str, clamp: bool = True) -> str:
    """Orders from low, high and the previous row's high within ``scope``."""
    before = f"lag(high, 1, 0) OVER (PARTITION BY {scope} ORDER BY date)"
    change = f"CASE WHEN {before} > 0 THEN high - {before} ELSE high - low END"
    return f"greatest({change}, 0)" if clamp else change


def big(value: str) -> str:
    return f"cast({value} AS bigint)"


def text(value: str, kind: str = "bigint", order: str = "date") -> str:
    return f"string_agg(cast(cast({value} AS {kind}) AS varchar), ',' ORDER BY {order})"


TABLES["catday"] = f"""
SELECT s.root_id, r.product_id, r.date, {DAY}
FROM raw r JOIN subtree s ON r.cat = s.category_id
GROUP BY s.root_id, r.product_id, r.date"""
TABLES["catorders"] = f"SELECT *, {orders_of('root_id, product_id')} AS orders FROM catday"
TABLES["sellday"] = f"""
SELECT klink, product_id, date, {DAY} FROM raw GROUP BY klink, product_id, date"""
TABLES["sellorders"] = f"SELECT *, {orders_of('klink, product_id')} AS orders FROM sellday"
TABLES["prodday"] = f"SELECT product_id, date, {DAY} FROM raw GROUP BY product_id, date"
TABLES["prodorders"] = f"SELECT *, {orders_of('product_id')} AS orders FROM prodday"
TABLES["prodraw"] = f"SELECT *, {orders_of('product_id', clamp=False)} AS orders FROM prodday"
TABLES["counts"] = """
SELECT s.root_id, count(DISTINCT k.seller_id) AS seller_count, count(DISTINCT k.product_id) AS product_count
FROM skuday k JOIN subtree s USING (category_id) GROUP BY s.root_id"""

NEEDS = {
    "closure": ["edges"],
    "subtree": ["closure"],
    "tops": ["edges"],
    "skuday": ["snap"],
    "raw": ["skuday"],
    "catday": ["raw", "subtree"],
    "catorders": ["catday"],
    "sellday": ["raw"],
    "sellorders": ["sellday"],
    "prodday": ["raw"],
    "prodorders": ["prodday"],
    "prodraw": ["prodday"],
    "counts": ["skuday", "subtree"],
}


def query(needs: str, body: str, **extra: str) -> str:
    """``body`` behind the CTEs it names, in dependency order."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    parts = [f"{name} AS ({TABLES[name]})" for name in order]
    parts += [f"{name} AS ({sql})" for name, sql in extra.items()]
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body


FROM, TO = "DATE '2024-01-01'", "DATE '2024-01-31'"
MIDNIGHT = "TIMESTAMP '2024-01-31'"


def ratio(top: str, bottom: str) -> str:
    return f"({top}) / nullif(cast({bottom} AS double), 0)"


def ratio_if(sold: str, top: str, bottom: str) -> str:
    return f"CASE WHEN {sold} THEN {ratio(top, bottom)} ELSE 0.0 END"


def half_up(value: str, digits: int) -> str:
    """Round a double half up as written in decimal."""
    return f"cast(round(cast({value} AS decimal(38,10)), {digits}) AS double)"


def cut(value: str, digits: int = 2) -> str:
    """Cut a double toward zero."""
    step = 10**digits
    return f"cast(trunc(round({value} * {step}, 8)) / {step} AS decimal(18,{digits}))"


def pct(previous: str, current: str) -> str:
    share = f"round((({current}) - ({previous})) / nullif(abs(cast({previous} AS double)), 0), 10)"
    return (
        f"CASE WHEN ({previous}) = 0 THEN cast(0 AS decimal(30,1)) ELSE "
        f"cast(trunc(round({share} * 1000, 4)) / 10 AS decimal(30,1)) END"
    )


def pct_count(previous: str, current: str) -> str:
    share = f"(cast(({current}) - ({previous}) AS double) / nullif(({previous}), 0)) * 100.0"
    return (
        f"CASE WHEN ({previous}) = 0 THEN cast(0 AS decimal(30,1)) ELSE "
        f"cast(trunc(cast(({share}) AS decimal(38,18)) * 10) / 10 AS decimal(30,1)) END"
    )


ORACLES: dict[str, str] = {}

ORACLES["category_descendants"] = query("closure", "SELECT root_id, category_id, level FROM closure")
ORACLES["category_subtree"] = query("subtree", "SELECT root_id, category_id FROM subtree")
ORACLES["category_hierarchy"] = query(
    "edges",
    """SELECT e.category_id, e.title AS name, e.parent_category_id AS parent_id,
coalesce((SELECT string_agg(cast(c.category_id AS varchar), ',' ORDER BY c.category_id)
  FROM edges c WHERE c.parent_category_id = e.category_id), '') AS children_ids FROM edges e""",
)
ORACLES["category_title"] = query(
    "snap edges",
    """SELECT DISTINCT s.product_id, s.latest_category_id AS category_id,
coalesce(e.title, 'unknown') AS category_title
FROM snap s LEFT JOIN edges e ON e.category_id = s.latest_category_id""",
)
ORACLES["category_daily_analytics"] = query(
    "catorders",
    f"""SELECT root_id AS category_id, date, order_amount,
{half_up(ratio_if('order_amount > 0', 'minor / 100', 'order_amount'), 2)} AS average_bill,
available_amount, {half_up('minor / 100', 2)} AS revenue
FROM (SELECT root_id, date, {big('sum(orders)')} AS order_amount, {big('sum(stock)')} AS available_amount,
  greatest(sum(orders * median), 0.0) AS minor FROM catorders GROUP BY root_id, date)""",
)
ADHOC = f"""order_amount, available_amount, revenue,
CASE WHEN order_amount > 0 THEN median_price ELSE 0.0 END AS median_price,
{ratio_if('order_amount > 0', 'revenue', 'order_amount')} AS avg_bill,
seller_count, product_count,
{ratio('order_amount', 'product_count')} AS order_per_product,
{ratio('order_amount', 'seller_count')} AS order_per_seller,
{ratio_if('order_amount > 0', 'revenue', 'product_count')} AS revenue_per_product"""
ORACLES["category_analytics_adhoc"] = query(
    "catorders counts edges",
    f"""SELECT category_id, {ADHOC} FROM (
SELECT e.category_id, coalesce(a.order_amount, 0) AS order_amount,
  coalesce(a.available_amount, 0) AS available_amount, coalesce(a.revenue, 0.0) AS revenue, a.median_price,
  coalesce(c.seller_count, 0) AS seller_count, coalesce(c.product_count, 0) AS product_count
FROM edges e LEFT JOIN (
  SELECT root_id, {big('sum(orders)')} AS order_amount, {big('sum(stock)')} AS available_amount,
    sum(orders * median) AS revenue, quantile_cont(median, 0.5) AS median_price
  FROM catorders GROUP BY root_id) a ON a.root_id = e.category_id
LEFT JOIN counts c ON c.root_id = e.category_id)""",
)

PERIODS = "SELECT unnest([7, 14, 30, 60]) AS period"
HALVES = """
SELECT period, 'current' AS which, DATE '2024-01-31' - period AS a, DATE '2024-01-31' AS b FROM periods
UNION ALL
SELECT period, 'previous', DATE '2024-01-31' - 2 * period, DATE '2024-01-31' - period FROM periods"""
FIGURES = [
    ("order_amount", "bigint"),
    ("available_amount", "bigint"),
    ("revenue", "bigint"),
    ("median_price", "cut"),
    ("avg_bill", "cut"),
    ("seller_count", "bigint"),
    ("product_count", "bigint"),
    ("order_per_product", "cut"),
    ("order_per_seller", "cut"),
    ("revenue_per_product", "cut"),
]


def _stored(column: str, kind: str) -> str:
    return cut(column) if kind == "cut" else f"cast(trunc({column}) AS bigint)"


STATS = {
    "periods": PERIODS,
    "halves": HALVES,
    "halfcounts": """
SELECT h.period, h.which, s.root_id, count(DISTINCT k.seller_id) AS seller_count,
  count(DISTINCT k.product_id) AS product_count
FROM halves h JOIN skuday k ON k.date BETWEEN h.a AND h.b JOIN subtree s USING (category_id)
GROUP BY h.period, h.which, s.root_id""",
    "halfday": """
SELECT h.period, h.which, s.root_id, p.product_id, p.date,
  arg_max(p.latest_category_id, (p.timestamp, p.latest_category_id)) AS category_id,
  min(p.total_orders_amount) AS low, max(p.total_orders_amount) AS high,
  min(p.total_available_amount) AS stock, quantile_cont(p.purchase_price, 0.5) AS median
FROM halves h JOIN snap p ON p.timestamp BETWEEN cast(h.a AS timestamp) AND cast(h.b AS timestamp)
JOIN subtree s ON s.category_id = p.latest_category_id JOIN tops t ON t.root_id = s.root_id
GROUP BY h.period, h.which, s.root_id, p.product_id, p.date""",
    "halforders": f"SELECT *, {orders_of('period, which, root_id, product_id')} AS orders FROM halfday",
    "half": f"""
SELECT period, which, root_id, category_id, {ADHOC} FROM (
  SELECT o.period, o.which, o.root_id, o.category_id, {big('sum(orders)')} AS order_amount,
    {big('sum(stock)')} AS available_amount, sum(orders * median) AS revenue,
    quantile_cont(median, 0.5) AS median_price, any_value(c.seller_count) AS seller_count,
    any_value(c.product_count) AS product_count
  FROM halforders o JOIN halfcounts c USING (period, which, root_id)
  GROUP BY o.period, o.which, o.root_id, o.category_id)""",
    "stats": "SELECT c.period, c.root_id, c.category_id, "
    + ", ".join(f"{_stored('c.' + c, k)} AS {c}" for c, k in FIGURES)
    + ", "
    + ", ".join(f"{_stored('p.' + c, k)} AS prev_{c}" for c, k in FIGURES)
    + """, DATE '2024-01-31' AS snapshot_date
FROM half c JOIN half p USING (period, root_id, category_id)
WHERE c.which = 'current' AND p.which = 'previous'""",
}
STATS_NEED = "snap subtree tops skuday"
ORACLES["category_period_stats"] = query(STATS_NEED, "SELECT * FROM stats", **STATS)
ORACLES["snapshot_idempotent"] = ORACLES["category_period_stats"]


def _prev_columns() -> str:
    out = []
    for p in ("", "prev_"):
        sold = f"{p}order_amount > 0"
        out += [
            f"{ratio_if(sold, p + 'revenue', p + 'order_amount')} AS {p}avg_bill",
            f"{ratio_if(sold, p + 'order_amount', p + 'product_count')} AS {p}order_per_product",
            f"{ratio_if(sold, p + 'order_amount', p + 'seller_count')} AS {p}order_per_seller",
            f"{ratio_if(sold, p + 'revenue', p + 'product_count')} AS {p}revenue_per_product",
        ]
    return ", ".join(out)


BASIC = ["order_amount", "available_amount", "revenue", "seller_count", "product_count"]
RATIOS = ["avg_bill", "order_per_product", "order_per_seller", "revenue_per_product"]
WITH_PREV = {
    **STATS,
    "sums": f"""
SELECT t.period, s.root_id AS category_id, {big('sum(order_amount)')} AS order_amount,
  {big('sum(available_amount)')} AS available_amount, sum(revenue) / 100.0 AS revenue,
  {big('sum(prev_order_amount)')} AS prev_order_amount,
  {big('sum(prev_available_amount)')} AS prev_available_amount, sum(prev_revenue) / 100.0 AS prev_revenue
FROM stats t JOIN subtree s USING (category_id) GROUP BY t.period, s.root_id""",
    "based": """
SELECT p.period, e.category_id, coalesce(a.order_amount, 0) AS order_amount,
  coalesce(a.available_amount, 0) AS available_amount, coalesce(a.revenue, 0.0) AS revenue,
  coalesce(c.seller_count, 0) AS seller_count, coalesce(c.product_count, 0) AS product_count,
  coalesce(a.prev_order_amount, 0) AS prev_order_amount,
  coalesce(a.prev_available_amount, 0) AS prev_available_amount, coalesce(a.prev_revenue, 0.0) AS prev_revenue,
  coalesce(v.seller_count, 0) AS prev_seller_count, coalesce(v.product_count, 0) AS prev_product_count
FROM edges e CROSS JOIN periods p
LEFT JOIN sums a ON a.category_id = e.category_id AND a.period = p.period
LEFT JOIN halfcounts c ON c.root_id = e.category_id AND c.period = p.period AND c.which = 'current'
LEFT JOIN halfcounts v ON v.root_id = e.category_id AND v.period = p.period AND v.which = 'previous'""",
    "sided": f"SELECT *, {_prev_columns()} FROM based",
    "compared": "SELECT period, category_id, "
    + ", ".join([*BASIC, *(f"prev_{c}" for c in BASIC)])
    + ", "
    + ", ".join(f"{half_up(p + c, 2)} AS {p}{c}" for p in ("", "prev_") for c in RATIOS)
    + ", "
    + ", ".join(
        f"{pct('prev_' + c, c)} AS {c}_pct" for c in ["revenue", *RATIOS]
    )
    + ", "
    + ", ".join(
        f"{pct_count('prev_' + c, c)} AS {c}_pct"
        for c in ("order_amount", "product_count", "seller_count")
    )
    + " FROM sided",
}
ORACLES["category_analytics_with_prev"] = query(STATS_NEED, "SELECT * FROM compared", **WITH_PREV)
ORACLES["category_children_ranking"] = query(
    STATS_NEED,
    """SELECT c.period, e.parent_category_id AS parent_id, c.category_id, e.title AS name,
c.revenue, c.order_amount, c.revenue_pct FROM compared c JOIN edges e USING (category_id)""",
    **WITH_PREV,
)

PRODUCT_STATS = {
    "periods": PERIODS,
    "topsku": """
SELECT t.root_id, k.*, sum(k.stock_low) OVER (PARTITION BY t.root_id, k.product_id, k.date) AS stock
FROM skuday k JOIN subtree s USING (category_id) JOIN tops t ON t.root_id = s.root_id""",
    "pstats": f"""
SELECT p.period, k.root_id, k.category_id, k.product_id,
  arg_max(title, (last_seen, sku_id, title)) AS title,
  max(high) AS max_total_order_amount, min(high) AS min_total_order_amount,
  {big('arg_max(stock, (last_seen, sku_id, stock))')} AS available_amount,
  arg_max(reviews_amount, (last_seen, sku_id, reviews_amount)) AS reviews_amount,
  arg_max(photo_key, (last_seen, sku_id, photo_key)) AS photo_key,
  arg_max(rating, (last_seen, sku_id, rating)) AS rating,
  quantile_cont(cast(trunc(median_price) AS bigint), 0.5) AS median_price,
  DATE '2024-01-31' AS snapshot_date
FROM topsku k JOIN periods p ON k.date >= DATE '2024-01-31' - p.period
GROUP BY p.period, k.root_id, k.category_id, k.product_id""",
}
ORACLES["category_product_period_stats"] = query(
    "skuday subtree tops", "SELECT * FROM pstats", **PRODUCT_STATS
)
CHART = f"""
SELECT product_id, {text('high - low')} AS order_amount_chart
FROM (SELECT product_id, date, min(low) AS low, max(high) AS high FROM skuday GROUP BY product_id, date)
GROUP BY product_id"""
def _category_products(low: int, roots: str = "") -> dict[str, str]:
    """CTEs of the category products table: members of the month, merged per top and product."""
    return {
        **PRODUCT_STATS,
        "chart": CHART,
        "members": f"""
SELECT s.root_id AS top, k.* FROM topsku k JOIN subtree s USING (category_id)
WHERE k.date >= DATE '2024-01-31' - 30{roots}""",
        "merged": f"""
SELECT *, price * order_amount AS revenue FROM (
SELECT top AS category_id, product_id, arg_max(title, (last_seen, sku_id, title)) AS title,
  max(high) - min(high) AS order_amount,
  quantile_cont(cast(trunc(median_price) AS bigint), 0.5) / 100 AS price,
  {big('arg_max(stock, (last_seen, sku_id, stock))')} AS available_amount,
  arg_max(reviews_amount, (last_seen, sku_id, reviews_amount)) AS reviews_amount,
  arg_max(photo_key, (last_seen, sku_id, photo_key)) AS photo_key,
  arg_max(rating, (last_seen, sku_id, rating)) AS rating
FROM members GROUP BY top, product_id) WHERE order_amount BETWEEN {low} AND 1000000000""",
    }


_PRODUCT_COLUMNS = """SELECT category_id, m.product_id, title, order_amount, price, revenue, available_amount,
reviews_amount, photo_key, cast(round(rating, 1) AS decimal(9,1)) AS rating,
count(*) OVER (PARTITION BY category_id) AS total_row_count, c.order_amount_chart"""
ORACLES["category_products_analytics"] = query(
    "skuday subtree tops",
    f"""{_PRODUCT_COLUMNS}
FROM merged m LEFT JOIN chart c ON c.product_id = m.product_id""",
    **_category_products(1),
)
ORACLES["category_products_page"] = query(
    "skuday subtree tops",
    f"""SELECT * FROM (
{_PRODUCT_COLUMNS},
row_number() OVER (ORDER BY revenue DESC NULLS LAST, title ASC NULLS FIRST, category_id, m.product_id) - 1 AS position
FROM merged m LEFT JOIN chart c ON c.product_id = m.product_id) WHERE position >= 10 AND position < 30""",
    **_category_products(10, " AND s.root_id IN (1, 2, 100, 1000)"),
)
ORACLES["products_order_chart"] = query("skuday", CHART)
SPINE = {"spine": f"SELECT cast(unnest(generate_series({FROM}, {TO} - 1, INTERVAL 1 DAY)) AS date) AS date"}
ORACLES["products_order_chart_filled"] = query(
    "skuday",
    f"""SELECT p.product_id, {text('coalesce(d.high - d.low, 0)', order='p.date')} AS order_amount_chart
FROM (SELECT DISTINCT k.product_id, s.date FROM skuday k CROSS JOIN spine s) p
LEFT JOIN (SELECT product_id, date, min(low) AS low, max(high) AS high FROM skuday GROUP BY product_id, date) d
USING (product_id, date) GROUP BY p.product_id""",
    **SPINE,
)
ORACLES["category_overall_info"] = query(
    "snap subtree",
    f"""SELECT a.root_id AS category_id, {half_up('price_sum / 100 / nullif(sold, 0)', 2)} AS avg_price,
coalesce(minor / 100, 0.0) AS revenue, coalesce(order_count, 0) AS order_count, s.seller_counts, product_counts,
{half_up(ratio('coalesce(order_count, 0)', 's.seller_counts'), 3)} AS sales_per_seller,
z.seller_with_zero_sales_count, product_zero_sales_count
FROM (SELECT root_id, count(*) FILTER (orders > 0) AS sold, sum(price) FILTER (orders > 0) AS price_sum,
    sum(orders * price) FILTER (orders > 0) AS minor, {big('sum(orders) FILTER (orders > 0)')} AS order_count,
    count(*) AS product_counts, count(*) FILTER (orders <= 0) AS product_zero_sales_count
  FROM prods GROUP BY root_id) a
JOIN (SELECT root_id, count(*) FILTER (orders <= 0) AS seller_with_zero_sales_count
  FROM (SELECT root_id, seller, sum(orders) AS orders FROM prods GROUP BY root_id, seller) GROUP BY root_id) z
  USING (root_id)
JOIN (SELECT root_id, count(DISTINCT seller_id) AS seller_counts FROM members GROUP BY root_id) s USING (root_id)""",
    members=f"""SELECT s.root_id, p.* FROM snap p JOIN subtree s ON s.category_id = p.latest_category_id
WHERE p.timestamp BETWEEN {FROM} AND {MIDNIGHT}""",
    prods="""SELECT root_id, product_id, max(total_orders_amount) - min(total_orders_amount) AS orders,
quantile_cont(purchase_price, 0.5) AS price, max(seller_id) AS seller FROM members GROUP BY root_id, product_id""",
)


def sales_report(source: str, scope: str, out: str) -> str:
    return f"""
SELECT {scope} AS {out}, o.product_id, arg_max(seller_title, date) AS seller_title,
  arg_max(seller_id, date) AS seller_id, arg_max(o.category_id, date) AS latest_category_id,
  {text('orders')} AS order_graph, {text('stock')} AS available_amount_graph,
  {text('median / 100', 'decimal(20,3)')} AS price_graph,
  arg_max(stock, date) AS available_amounts, arg_max(median / 100, date) AS purchase_price,
  sum(orders * median) / 100 AS sales, arg_max(o.title, date) AS name,
  {big('sum(orders)')} AS _orders, count(*) FILTER (stock > 0) AS _days
FROM {source} o GROUP BY {scope}, o.product_id"""


REPORT = """SELECT r.* EXCLUDE (_orders, _days), coalesce(e.title, '') AS category_name,
count(*) OVER (PARTITION BY {scope}) AS total
FROM report r LEFT JOIN edges e ON e.category_id = r.latest_category_id"""
BY_CATEGORY = sales_report("catorders", "root_id", "category_id")
BY_SELLER = sales_report("sellorders", "klink", "seller_link")
ORACLES["category_sales_report"] = query(
    "catorders edges", REPORT.format(scope="r.category_id"), report=BY_CATEGORY
)
ORACLES["seller_sales_report"] = query(
    "sellorders edges", REPORT.format(scope="r.seller_link"), report=BY_SELLER
)


def abc_class(value: str, scope: str) -> str:
    above = f"(SELECT coalesce(sum(g.{value}), 0) FROM v g WHERE g.{scope} = v.{scope} AND g.{value} > v.{value})"
    total = f"(SELECT sum(g.{value}) FROM v g WHERE g.{scope} = v.{scope})"
    return f"""CASE WHEN {total} = 0 THEN NULL
WHEN {above} + v.{value} < 0.81 * {total} THEN 'A'
WHEN {above} + v.{value} < 0.96 * {total} THEN 'B' ELSE 'C' END"""


def abc_sql(scope: str) -> str:
    return f"""SELECT v.{scope}, seller_title, product_id, name, category_name, available_amounts, days_in_stock,
purchase_price, order_amount, revenue, {abc_class('order_amount', scope)} AS abc_orders,
{abc_class('revenue', scope)} AS abc_revenue FROM v"""


VALUES = """SELECT r.{scope}, seller_title, product_id, name, coalesce(e.title, '') AS category_name,
available_amounts, _days AS days_in_stock, purchase_price, _orders AS order_amount,
cast(round(cast(sales AS decimal(38,10)), 2) AS decimal(20,2)) AS revenue
FROM report r LEFT JOIN edges e ON e.category_id = r.latest_category_id"""
ORACLES["abc_report"] = query(
    "sellorders edges",
    abc_sql("seller_link"),
    report=BY_SELLER,
    v=VALUES.format(scope="seller_link"),
)
ORACLES["abc_report_category"] = query(
    "catorders edges",
    abc_sql("category_id"),
    report=BY_CATEGORY,
    v=VALUES.format(scope="category_id"),
)
ORACLES["days_in_stock"] = query(
    "sellorders", "SELECT seller_link, product_id, _days AS days_in_stock FROM report", report=BY_SELLER
)
ORACLES["abc_classify"] = f"""WITH v AS (SELECT l_returnflag, l_partkey, {big('sum(cast(l_quantity AS bigint))')} AS quantity
FROM lineitem GROUP BY l_returnflag, l_partkey),
g AS (SELECT l_returnflag, quantity, sum(sum(quantity)) OVER (PARTITION BY l_returnflag ORDER BY quantity DESC) - sum(quantity) AS above,
  sum(sum(quantity)) OVER (PARTITION BY l_returnflag) AS total FROM v GROUP BY l_returnflag, quantity)
SELECT v.l_returnflag, v.l_partkey, v.quantity,
CASE WHEN total = 0 THEN NULL WHEN above + v.quantity < 0.81 * total THEN 'A'
WHEN above + v.quantity < 0.96 * total THEN 'B' ELSE 'C' END AS abc
FROM v JOIN g ON g.l_returnflag = v.l_returnflag AND g.quantity = v.quantity"""

ORACLES["seller_order_dynamic"] = query(
    "sellorders",
    f"""SELECT klink AS seller_link, date, {big('sum(orders)')} AS order_amount
FROM sellorders GROUP BY klink, date""",
)
ORACLES["seller_overall_info"] = query(
    "sellorders",
    f"""SELECT seller_link, {big('sum(orders)')} AS order_amount, sum(minor) / 100 AS revenue,
count(*) AS product_count, count(*) FILTER (orders > 0) AS product_with_sales,
round(sum(avg_price) / nullif(count(*) FILTER (orders > 0), 0)) AS avg_price,
count(*) FILTER (orders <= 0) AS product_without_sales
FROM (SELECT klink AS seller_link, product_id, sum(orders) AS orders, sum(orders * median) AS minor,
  avg(median / 100) AS avg_price FROM sellorders GROUP BY klink, product_id) GROUP BY seller_link""",
)
ORACLES["seller_shops"] = query(
    "snap",
    """SELECT seller_id, account_id, link, title, count(*) OVER (PARTITION BY account_id) AS shops
FROM (SELECT DISTINCT seller_id, seller_account_id AS account_id, seller_link AS link, seller_title AS title FROM snap)""",
)

ORACLES["product_first_discovered"] = query(
    "snap",
    "SELECT product_id, sku_id, min(timestamp) AS first_discovered FROM snap GROUP BY product_id, sku_id",
)
ORACLES["product_sku_history"] = query(
    "snap",
    f"""SELECT product_id, sku_id, date, title, order_amount, review_amount, full_price / 100 AS full_price,
median / 100 AS purchase_price, photo_key, order_amount * median / 100 AS sales_amount,
stock_last AS available_amount, total_available_amount
FROM (SELECT *, CASE WHEN restriction > 0 THEN counter_span ELSE greatest(CASE
    WHEN stock_high > before THEN 0
    WHEN stock_high = stock_low AND before > stock_high THEN before - stock_high
    ELSE stock_high - stock_low END, 0) END AS order_amount
  FROM (SELECT *, lag(stock_last, 1, 0) OVER (PARTITION BY product_id, sku_id ORDER BY date) AS before
    FROM (SELECT product_id, sku_id, date, arg_min(title, (timestamp, title)) AS title,
      arg_min(full_price, (timestamp, full_price)) AS full_price,
      arg_min(photo_key, (timestamp, photo_key)) AS photo_key,
      arg_max(available_amount, (timestamp, available_amount)) AS stock_last,
      min(available_amount) AS stock_low, max(available_amount) AS stock_high,
      max(total_orders_amount) - min(total_orders_amount) AS counter_span,
      max(total_available_amount) AS total_available_amount,
      max(reviews_amount) - min(reviews_amount) AS review_amount,
      quantile_cont(purchase_price, 0.5) AS median, min(restriction) AS restriction
    FROM snap WHERE timestamp BETWEEN {FROM} AND {MIDNIGHT} GROUP BY product_id, sku_id, date)))""",
)
SALES = f"""
SELECT product_id, arg_min(title, date) AS title, {big('sum(orders)')} AS order_amount,
  sum(orders * median) / 100 AS sales_amount, arg_min(seller_title, date) AS seller_title,
  arg_min(seller_link, date) AS seller_link, arg_min(seller_account_id, date) AS seller_account_id,
  sum(orders) / 30.0 AS daily_order_amount
FROM (SELECT *, {orders_of('product_id')} AS orders FROM (
  SELECT product_id, date, arg_min(title, (timestamp, sku_id, title)) AS title,
    min(total_orders_amount) AS low, max(total_orders_amount) AS high,
    quantile_cont(purchase_price, 0.5) AS median, max(seller_title) AS seller_title,
    max(seller_link) AS seller_link, max(seller_account_id) AS seller_account_id
  FROM snap WHERE timestamp BETWEEN {FROM} AND {MIDNIGHT} GROUP BY product_id, date))
GROUP BY product_id"""
ORACLES["products_sales"] = query("snap", SALES)
ORACLES["page"] = query(
    "snap",
    f"""SELECT product_id, order_amount, sales_amount FROM ({SALES})
ORDER BY order_amount DESC, product_id LIMIT 50 OFFSET 25""",
)
ORACLES["product_daily_analytics"] = query(
    "prodorders edges",
    f"""SELECT p.product_id, p.title, p.category_id, p.seller_link, p.seller_title,
{half_up('coalesce(l.median, 0)', 2)} AS price, {half_up('p.full_price', 2)} AS full_price,
coalesce(l.reviews_amount, 0) AS review_amount, {half_up('p.minor / 100', 2)} AS revenue_sum,
coalesce(l.photo_key, '') AS photo_key, coalesce(l.rating, 0) AS rating,
c.price_chart, c.revenue_chart, c.order_chart, a.available_chart, coalesce(e.title, 'unknown') AS category_name,
p.first_day AS first_discovered
FROM (SELECT product_id, arg_max(title, date) AS title, arg_max(category_id, date) AS category_id,
    arg_max(seller_link, date) AS seller_link, arg_max(seller_title, date) AS seller_title,
    arg_max(median_full, date) AS full_price, sum(orders * median) AS minor, min(date) AS first_day
  FROM prodorders GROUP BY product_id) p
LEFT JOIN prodorders l ON l.product_id = p.product_id AND l.date = {TO} - 1
JOIN (SELECT d.product_id, {text('coalesce(o.median / 100, 0)', 'decimal(20,3)', 'd.date')} AS price_chart,
    {text('coalesce(o.orders * o.median / 100, 0)', 'decimal(20,3)', 'd.date')} AS revenue_chart,
    {text('coalesce(o.orders, 0)', order='d.date')} AS order_chart
  FROM (SELECT f.product_id, s.date FROM (SELECT product_id, min(date) AS first_day FROM prodorders GROUP BY product_id) f
    JOIN spine s ON s.date >= f.first_day) d
  LEFT JOIN prodorders o USING (product_id, date) GROUP BY d.product_id) c ON c.product_id = p.product_id
JOIN (SELECT product_id, {text('stock')} AS available_chart FROM (
    SELECT product_id, date, sum(stock_low) AS stock FROM skuday GROUP BY product_id, date) GROUP BY product_id) a
  ON a.product_id = p.product_id
LEFT JOIN edges e ON e.category_id = p.category_id""",
    **SPINE,
)
ORACLES["product_position_history"] = query(
    "pos",
    f"""SELECT k.category_id, k.product_id, k.sku_id, s.date, coalesce(d.position, 0) AS position
FROM (SELECT DISTINCT category_id, product_id, sku_id FROM pos WHERE timestamp BETWEEN {FROM} AND {MIDNIGHT}) k
CROSS JOIN spine s LEFT JOIN (
  SELECT category_id, product_id, sku_id, cast(timestamp AS date) AS date, arg_max(position, (timestamp, position)) AS position
  FROM pos WHERE timestamp BETWEEN {FROM} AND {MIDNIGHT} GROUP BY ALL) d USING (category_id, product_id, sku_id, date)""",
    **SPINE,
)

DAILY = """SELECT date, product_id, sku_id, title, photo_key, category_id, low AS min_total_order_amount,
high AS max_total_order_amount, stock_low AS min_available_amount, stock_high AS max_available_amount,
median_full_price, median_price, seller_id, seller_account_id, seller_title, seller_link,
seller_registration_date, rating, is_eco, is_adult, reviews_amount FROM skuday"""
ORACLES["daily_sales"] = query("skuday", DAILY)
ORACLES["daily_sales_merge"] = ORACLES["daily_sales"]
ORACLES["daily_sales_partials"] = query(
    "snap",
    """SELECT date, product_id, sku_id, title, photo_key, reviews_amount, seller_title, seller_link, full_price,
purchase_price, count(*) AS seen, max(timestamp) AS last_seen, min(total_orders_amount) AS low,
max(total_orders_amount) AS high, min(available_amount) AS stock_low, max(available_amount) AS stock_high,
max(latest_category_id) AS category_id, max(seller_id) AS seller_id, max(seller_account_id) AS seller_account_id,
max(seller_registration_date) AS seller_registration_date, max(rating) AS rating, bool_or(is_eco) AS is_eco,
bool_or(is_adult) AS is_adult
FROM snap GROUP BY date, product_id, sku_id, title, photo_key, reviews_amount, seller_title, seller_link,
full_price, purchase_price""",
)
CATEGORY_DAILY = query(
    "prodraw",
    f"""SELECT category_id, date, {big('sum(orders)')} AS orders, {big('sum(stock)')} AS available_amount,
quantile_cont(median, 0.5) AS median_price_all, quantile_cont(median, 0.5) FILTER (orders > 0) AS median_price_with_sales,
sum(orders * median) AS revenue, count(DISTINCT seller_id) AS seller_count, count(DISTINCT product_id) AS product_count,
count(DISTINCT seller_id) FILTER (orders > 0) AS seller_with_sales,
count(DISTINCT product_id) FILTER (orders > 0) AS product_with_sales
FROM prodraw GROUP BY category_id, date""",
)
ORACLES["category_daily_stats"] = CATEGORY_DAILY
ORACLES["distinct_with_sales"] = (
    f"SELECT category_id, date, seller_with_sales, product_with_sales FROM ({CATEGORY_DAILY})"
)
ORACLES["median_with_sales"] = (
    f"SELECT category_id, date, median_price_with_sales FROM ({CATEGORY_DAILY})"
)
ORACLES["latest_snapshot"] = query(
    "pos",
    """SELECT *, cast(timestamp AS date) AS snapshot_date FROM pos
WHERE cast(timestamp AS date) = (SELECT max(cast(timestamp AS date)) FROM pos)""",
)
ORACLES["latest_per_period"] = query(
    "pos",
    """SELECT kept.* FROM kept JOIN (SELECT period, max(snapshot_date) AS snapshot_date FROM kept GROUP BY period)
USING (period, snapshot_date)""",
    kept="""SELECT * FROM (SELECT *, cast(timestamp AS date) AS snapshot_date,
CASE WHEN product_id % 2 = 0 THEN 7 ELSE 14 END AS period FROM pos)
WHERE NOT (period = 14 AND snapshot_date > DATE '2024-01-20')""",
)
ORACLES["retention"] = query(
    "pos", "SELECT * FROM pos WHERE timestamp + INTERVAL 1 MONTH > TIMESTAMP '2024-02-15'"
)
ORACLES["upsert_categories"] = query(
    "edges",
    """SELECT category_id, parent_category_id,
CASE WHEN category_id % 2 = 0 THEN concat(title, ' v2') ELSE title END AS title FROM edges
UNION ALL SELECT category_id + 5000, category_id, concat(title, '-new') FROM edges WHERE category_id >= 1000""",
)
ORACLES["upsert_sellers"] = query(
    "snap",
    """SELECT DISTINCT seller_id, seller_account_id AS account_id, seller_link AS link, seller_title AS title FROM snap""",
)
ORACLES["payments_dedup"] = query("payments", "SELECT * FROM payments WHERE status <> 'failed'")
ORACLES["report_quota_usage"] = query(
    "requests plans",
    """SELECT user_id, day, report_type, reports, daily_limit, reports > daily_limit AS over_quota FROM (
SELECT r.*, CASE WHEN subscription_type IS NULL OR subscription_end_at < latest THEN 0
  WHEN report_type = 'seller' THEN CASE subscription_type WHEN 'demo' THEN 10 ELSE 100 END
  ELSE CASE subscription_type WHEN 'demo' THEN 10 WHEN 'default' THEN 0 ELSE 100 END END AS daily_limit
FROM (SELECT user_id, cast(created_at AS date) AS day, report_type, count(*) AS reports, max(created_at) AS latest
  FROM requests GROUP BY ALL) r LEFT JOIN plans USING (user_id))""",
)
ORACLES["request_entitlement_audit"] = query(
    "requests plans",
    """SELECT job_id, user_id, days, CASE WHEN days <= 0 THEN 'PERMIT'
WHEN subscription_type IS NULL OR subscription_end_at < created_at THEN 'PROHIBIT'
WHEN days > longest THEN 'PROHIBIT'
WHEN subscription_type <> 'pro' AND from_date < cast(created_at AS date) - (longest + 1) THEN 'PROHIBIT'
ELSE 'PERMIT' END AS verdict
FROM (SELECT r.*, cast(to_date - from_date AS integer) AS days, subscription_type, subscription_end_at,
  CASE subscription_type WHEN 'advanced' THEN 90 WHEN 'pro' THEN 120 ELSE 30 END AS longest
FROM requests r LEFT JOIN plans USING (user_id))""",
)

ORACLES["order_delta"] = query("prodorders", "SELECT product_id, date, orders FROM prodorders")
ORACLES["order_delta_unclamped"] = query("prodraw", "SELECT product_id, date, orders FROM prodraw")
ORACLES["sku_stock_sum"] = query(
    "skuday",
    f"SELECT product_id, date, {big('sum(stock_low)')} AS stock_sum FROM skuday GROUP BY product_id, date",
)
ORACLES["median_price"] = query(
    "snap",
    """SELECT latest_category_id, quantile_cont(purchase_price, 0.5) AS median_price FROM snap
GROUP BY latest_category_id""",
)
ORACLES["median_merge"] = query(
    "snap",
    "SELECT product_id, date, quantile_cont(purchase_price, 0.5) AS median_price FROM snap GROUP BY product_id, date",
)
ORACLES["distinct_sellers_products"] = query(
    "counts", "SELECT root_id, seller_count, product_count FROM counts"
)
ORACLES["first_last_value"] = query(
    "snap",
    """SELECT product_id, arg_min(purchase_price, (timestamp, sku_id, purchase_price)) AS first_price,
arg_max(purchase_price, (timestamp, sku_id, purchase_price)) AS last_price,
arg_min(full_price, (timestamp, sku_id, full_price)) FILTER (full_price IS NOT NULL) AS first_full_price,
arg_max(photo_key, (timestamp, sku_id, photo_key)) AS last_photo_key FROM snap GROUP BY product_id""",
)
ORACLES["ordered_array_agg"] = query(
    "prodday", f"SELECT product_id, {text('high')} AS counter_chart FROM prodday GROUP BY product_id"
)
ORACLES["gap_fill"] = query(
    "prodorders",
    """SELECT k.product_id, s.date, coalesce(o.orders, 0) AS orders
FROM (SELECT DISTINCT product_id FROM prodorders) k CROSS JOIN spine s
LEFT JOIN prodorders o ON o.product_id = k.product_id AND o.date = s.date""",
    **SPINE,
)
ORACLES["gap_fill_carry"] = query(
    "prodorders",
    """SELECT product_id, date, orders, photo_key FROM (
SELECT k.product_id, s.date, coalesce(o.orders, 0) AS orders,
  last_value(o.photo_key IGNORE NULLS) OVER (PARTITION BY k.product_id ORDER BY s.date) AS photo_key, k.first_day
FROM (SELECT product_id, min(date) AS first_day FROM prodorders GROUP BY product_id) k CROSS JOIN spine s
LEFT JOIN prodorders o ON o.product_id = k.product_id AND o.date = s.date) WHERE date >= first_day""",
    **SPINE,
)
ORACLES["dynamic_filter"] = query(
    "skuday",
    """SELECT date, product_id, sku_id, title, median_price, is_eco FROM skuday
WHERE title ILIKE '%p1%' AND median_price BETWEEN 100000 AND 110000
AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND is_eco""",
)
ORACLES["period_range"] = """SELECT period, from_date, DATE '2024-01-31' AS to_date, count(*) AS snapshots
FROM (SELECT unnest(['week', 'two_week', 'month', 'two_month']) AS period,
  DATE '2024-01-31' - unnest([7, 14, 30, 60]) AS from_date) p
JOIN events e ON cast(e.ts AS date) BETWEEN p.from_date AND DATE '2024-01-31' GROUP BY period, from_date"""
ORACLES["pct_diff"] = query(
    "catorders",
    f"""SELECT c.category_id, c.date, {pct('p.revenue', 'c.revenue')} AS revenue_pct,
{pct_count('p.orders', 'c.orders')} AS orders_pct
FROM days c JOIN days p ON p.category_id = c.category_id AND p.date + 1 = c.date""",
    days=f"""SELECT root_id AS category_id, date, {big('sum(orders)')} AS orders,
{half_up('greatest(sum(orders * median), 0.0) / 100', 2)} AS revenue FROM catorders GROUP BY root_id, date""",
)
ORACLES["trunc_decimal"] = """SELECT l_orderkey, l_linenumber, l_partkey,
cast(trunc((cast(l_extendedprice AS decimal(12,2)) * cast(l_discount AS decimal(4,2)) - 100) * 10) / 10 AS decimal(30,1))
  AS discount_over_100 FROM lineitem"""
ORACLES["to_money"] = """SELECT o_orderkey, '860' AS currency_code, cast(trunc(amount) AS bigint) AS units,
cast(trunc((amount - trunc(amount)) * 1000000000) AS integer) AS nanos
FROM (SELECT o_orderkey, cast(o_totalprice AS decimal(18,2)) * cast('0.123456789' AS decimal(10,9)) - 20000 AS amount FROM orders)"""

# --- streams --------------------------------------------------------------

ROUTED = """SELECT 'product' AS target, cast(ts AS date) AS date FROM events
UNION ALL SELECT 'position', cast(ts AS date) FROM events WHERE event_type = 'view'
UNION ALL SELECT 'quarantine', cast(ts AS date) FROM events WHERE event_id % 97 = 1
UNION ALL SELECT 'category', unnest([DATE '2024-01-02', DATE '2024-01-20']) FROM region"""
ORACLES["route_events"] = (
    f"SELECT target, date, count(*) AS events FROM ({ROUTED}) GROUP BY target, date"
)
# The second SKU of every tenth product event.
SECOND = TABLES["snap"].replace("FROM events", ", event_id FROM events")
ORACLES["stream_products"] = f"""WITH s AS ({SECOND}), both_skus AS (
SELECT * EXCLUDE (date, event_id) FROM s
UNION ALL SELECT * EXCLUDE (date, event_id) REPLACE (product_id * 10 + 2 AS sku_id, NULL AS photo_key, NULL AS full_price)
FROM s WHERE event_id % 10 = 0)
SELECT *, 'blue' AS color, 'sale,top' AS tags FROM both_skus"""
ORACLES["ingest_products"] = ORACLES["stream_products"]
ORACLES["stream_positions"] = query("pos", "SELECT * FROM pos")
ORACLES["ingest_positions"] = ORACLES["stream_positions"]
_STREAMED = f"""SELECT * EXCLUDE (event_id) FROM ({SECOND})
UNION ALL SELECT * EXCLUDE (event_id) REPLACE (product_id * 10 + 2 AS sku_id, NULL AS photo_key, NULL AS full_price)
FROM ({SECOND}) WHERE event_id % 10 = 0"""
_SKUDAY = (
    TABLES["skuday"]
    .replace("FROM snap", "FROM streamed")
    .replace(
        "arg_max(photo_key, (timestamp, photo_key)) AS",
        "arg_max(photo_key, (timestamp, photo_key)) FILTER (photo_key IS NOT NULL) AS",
    )
)
ORACLES["stream_daily_rollup"] = f"WITH streamed AS ({_STREAMED}), skuday AS ({_SKUDAY}) {DAILY}"
ORACLES["stream_categories"] = query(
    "edges",
    "SELECT category_id, parent_category_id, concat(title, ' v2') AS title FROM edges",
)
ORACLES["stream_sellers"] = ORACLES["upsert_sellers"]
PAYMENTS = {
    "ev": """
SELECT payment_id, created_at AS "at", status, 0 AS ord FROM payments
UNION ALL SELECT payment_id, created_at + INTERVAL 1 DAY,
  CASE payment_id % 3 WHEN 0 THEN 'success' ELSE 'failed' END, 1
  FROM payments WHERE status = 'pending' AND payment_id % 3 <> 2
UNION ALL SELECT payment_id, created_at + INTERVAL 2 DAY, 'success', 1
  FROM payments WHERE status = 'pending' AND payment_id % 6 = 0
UNION ALL SELECT payment_id, created_at + to_days(cast(n AS integer)), 'success', 1
  FROM payments, (SELECT unnest([3, 4]) AS n) WHERE status = 'pending' AND payment_id % 3 = 1 AND payment_id % 10 = 0""",
    "won": """
SELECT e.payment_id, p.user_id, e."at", p.subscription_type AS plan,
  30 * CASE WHEN p.multiply > 1 THEN p.multiply ELSE 1 END AS days
FROM (SELECT *, lag(status) OVER (PARTITION BY payment_id ORDER BY "at", ord) AS earlier FROM ev) e
JOIN payments p USING (payment_id) WHERE e.status = 'success' AND coalesce(e.earlier, '') <> 'success'""",
    "summed": """
SELECT *, sum(days) OVER (PARTITION BY user_id ORDER BY "at", payment_id) AS upto FROM won""",
    "subs": """
SELECT user_id, CASE arg_max(plan, ("at", payment_id)) WHEN 1 THEN 'default' WHEN 2 THEN 'advanced' ELSE 'pro' END
  AS subscription_type, max("at") AS subscription_created_at,
  max("at" - to_days(cast(upto - days AS integer))) + to_days(cast(sum(days) AS integer)) AS subscription_end_at
FROM summed GROUP BY user_id""",
}
ORACLES["subscription_state"] = query("payments", "SELECT * FROM subs", **PAYMENTS)
ORACLES["stream_subscriptions"] = ORACLES["subscription_state"]
ORACLES["payment_orphans"] = query(
    "payments",
    """SELECT payment_id + 1000000000 AS payment_id, created_at AS "at", 'success' AS status
FROM payments WHERE payment_id % 97 = 0""",
)
ORACLES["demo_grant"] = query(
    "payments plans",
    """SELECT user_id, 'demo' AS subscription_type, TIMESTAMP '2024-01-31' AS subscription_created_at,
TIMESTAMP '2024-02-03' AS subscription_end_at
FROM plans WHERE subscription_type IS NULL AND user_id NOT IN (SELECT user_id FROM subs)""",
    **PAYMENTS,
)
ORACLES["payment_stream_late"] = ORACLES["stream_subscriptions"]
ORACLES["quarantine_events"] = """SELECT CASE event_id % 97 WHEN 1 THEN 'no_id' WHEN 2 THEN 'bad_price' ELSE 'bad_shape' END AS reason,
cast(ts AS date) AS date, count(*) AS events FROM events WHERE event_id % 97 IN (1, 2, 3) GROUP BY ALL"""
ORACLES["retention_raw"] = query(
    "snap",
    """SELECT product_id, count(*) AS kept_rows FROM snap
WHERE timestamp + INTERVAL 4 MONTH > TIMESTAMP '2024-05-20' GROUP BY product_id""",
)
ORACLES["retention_snapshots"] = query(
    "pos",
    """SELECT cast(cast(timestamp AS date) AS timestamp) AS snapshot_date, count(*) AS kept_rows FROM pos
WHERE cast(timestamp AS date) + INTERVAL 3 DAY > TIMESTAMP '2024-01-31' GROUP BY 1""",
)
ORACLES["report_export"] = f"""SELECT seller_link, product_id, days_in_stock, order_amount, revenue, abc_orders, abc_revenue
FROM ({ORACLES["abc_report"]})"""

# A key's places as a state carried row by row: a recursive step per visit, in (ts, ip, browser) order.
_KEY_STATES = {
    "visits": """  SELECT api_key, ip, browser, ts, row_number() OVER (PARTITION BY api_key ORDER BY ts, ip, browser) AS i
  FROM (SELECT api_key, ip, browser, min(ts) AS ts FROM access GROUP BY api_key, ip, browser, date_trunc('second', ts))""",
    "states": """  SELECT api_key, 0::BIGINT AS i, NULL::TIMESTAMP AS started, NULL::TIMESTAMP AS renewed, false AS flagged,
    []::STRUCT(ip VARCHAR, browser VARCHAR)[] AS places, false AS alarm, NULL::TIMESTAMP AS seen_at
  FROM (SELECT DISTINCT api_key FROM visits)
  UNION ALL
  SELECT api_key, i, started, renewed, flagged OR alarm, places, alarm, seen_at FROM (
    SELECT *, NOT known AND NOT was_flagged AND len(places) > 2 AND (
        (len(list_distinct(list_transform(places, lambda p: p.ip))) > 4
         AND len(list_distinct(list_transform(places, lambda p: p.browser))) > 2)
        OR list_max(list_transform(places, lambda p: len(list_filter(places, lambda q: q.ip = p.ip)))) > 3
      ) AS alarm
    FROM (
      SELECT api_key, i, known, was_flagged, vts AS seen_at,
        CASE WHEN known THEN p0 ELSE list_append(p0, {'ip': vip, 'browser': vbr}) END AS places,
        CASE WHEN known THEN st0 ELSE coalesce(st0, vts) END AS started,
        CASE WHEN known THEN rn0 ELSE greatest(coalesce(rn0, vts), vts) END AS renewed,
        was_flagged AS flagged
      FROM (
        SELECT *, list_contains(p0, {'ip': vip, 'browser': vbr}) AS known FROM (
          SELECT s.api_key, v.i, v.ts AS vts, v.ip AS vip, v.browser AS vbr,
            CASE WHEN reset THEN []::STRUCT(ip VARCHAR, browser VARCHAR)[] ELSE s.places END AS p0,
            CASE WHEN reset THEN NULL ELSE s.started END AS st0,
            CASE WHEN reset THEN NULL ELSE s.renewed END AS rn0,
            CASE WHEN reset THEN false ELSE s.flagged END AS was_flagged
          FROM states s JOIN visits v ON v.api_key = s.api_key AND v.i = s.i + 1,
            LATERAL (SELECT s.renewed IS NOT NULL AND v.ts > s.renewed + INTERVAL 2 HOUR AS reset)
        )
      )
    )
  )""",
}
ORACLES["key_sharing_detector"] = query(
    "access",
    """SELECT api_key::BIGINT AS api_key, started AS started_at, seen_at AS flagged_at, len(places)::INTEGER AS places,
  len(list_distinct(list_transform(places, lambda p: p.ip)))::INTEGER AS addresses,
  len(list_distinct(list_transform(places, lambda p: p.browser)))::INTEGER AS browsers
FROM states WHERE alarm""",
    **_KEY_STATES,
)
