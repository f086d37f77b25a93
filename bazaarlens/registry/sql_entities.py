"""The entity views of ``sources.entities`` as DuckDB CTEs for the checks."""

def digest_bucket(text: str, buckets) -> str:
    """md5 of a text as a 128-bit number modulo ``buckets``, folded 32 bits at a time."""
    out = "0"
    for start in (1, 9, 17, 25):
        out = f"(({out}) * 4294967296 + ('0x' || substring(md5({text}), {start}, 8))::BIGINT) % {buckets}"
    return out


MERCHANTS = """merchants AS (
  SELECT n_nationkey AS merchant_id, n_name AS merchant_name, r_name AS industry,
    CASE n_nationkey % 4 WHEN 0 THEN 'platinum' WHEN 1 THEN 'gold' WHEN 2 THEN 'silver' ELSE 'bronze' END AS merchant_tier,
    CASE WHEN n_nationkey % 12 = 11 THEN 'suspended' ELSE 'active' END AS status
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

CUSTOMERS = """customers AS (
  SELECT c_custkey AS customer_id, c_nationkey AS merchant_id,
    lower(replace(c_name, '#', '.')) || '@example.com' AS email,
    CASE WHEN c_custkey % 17 <> 0 THEN 'Customer' END AS first_name,
    substring(c_name, 10, 9) AS last_name,
    CASE WHEN c_custkey % 20 = 0 THEN 'inactive' ELSE 'active' END AS status,
    c_mktsegment AS acquisition_source, c_custkey % 2 = 0 AS email_opt_in, c_custkey % 3 = 0 AS sms_opt_in,
    CAST(c_acctbal AS DECIMAL(12,2)) AS ltv,
    DATE '1994-01-01' + CAST(c_custkey % 365 AS INTEGER) AS created_at,
    CASE WHEN c_custkey % 50 = 0 THEN DATE '2001-01-01' END AS deleted_at
  FROM customer)"""

ORDERS = """orders0 AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, c_nationkey AS merchant_id,
    CASE WHEN o_orderstatus = 'F' THEN 'delivered' WHEN o_orderstatus = 'O' THEN 'processing'
         WHEN o_orderkey % 5 = 0 THEN 'cancelled' WHEN o_orderkey % 5 = 1 THEN 'refunded' ELSE 'pending' END AS status,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'web' WHEN '2-HIGH' THEN 'mobile_web' WHEN '3-MEDIUM' THEN 'ios_app'
         WHEN '4-NOT SPECIFIED' THEN 'android_app' ELSE 'api' END AS channel,
    o_orderdate AS created_at,
    CASE WHEN o_orderkey % 9 <> 0 THEN 'USD' END AS currency_raw,
    CAST(o_totalprice AS DECIMAL(12,2)) AS subtotal,
    CASE WHEN o_orderkey % 4 <> 0 THEN CAST(CAST(o_totalprice AS DECIMAL(12,2)) * CAST((o_orderkey % 4) * 0.05 AS DECIMAL(4,2)) AS DECIMAL(12,2)) END AS discount_amount,
    CAST(CAST(o_totalprice AS DECIMAL(12,2)) * CAST(0.08 AS DECIMAL(3,2)) AS DECIMAL(12,2)) AS tax_amount,
    CAST(CASE WHEN o_orderkey % 3 = 0 THEN 5.99 ELSE 0 END AS DECIMAL(12,2)) AS shipping_amount,
    o_orderkey % 5 + 1 AS item_count, o_orderkey % 3 + 1 AS unique_item_count,
    CASE WHEN o_orderkey % 11 = 0 THEN 'tiktok' ELSE CASE o_orderkey % 7 WHEN 0 THEN 'direct' WHEN 2 THEN 'google' WHEN 3 THEN 'google'
         WHEN 4 THEN 'facebook_ads' WHEN 5 THEN 'newsletter' WHEN 6 THEN 'partner' END END AS utm_source,
    CASE WHEN o_orderkey % 11 = 0 THEN 'display' ELSE CASE o_orderkey % 7 WHEN 2 THEN 'cpc' WHEN 3 THEN 'organic'
         WHEN 4 THEN 'social' WHEN 5 THEN 'email' WHEN 6 THEN 'referral' END END AS utm_medium,
    CASE WHEN o_orderkey % 7 >= 2 THEN 'camp_' || (o_orderkey % 3) END AS utm_campaign,
    CASE WHEN o_orderkey % 8 < 3 THEN 'SAVE' || (o_orderkey % 8) END AS coupon_code
  FROM orders JOIN customer ON o_custkey = c_custkey),
orders1 AS (
  SELECT *, CAST(subtotal + tax_amount + shipping_amount - coalesce(discount_amount, 0) AS DECIMAL(12,2)) AS total_amount,
    CASE WHEN status <> 'pending' THEN created_at + INTERVAL 1 HOUR END AS paid_at,
    CASE WHEN status = 'delivered' OR (status = 'processing' AND order_id % 2 = 0)
         THEN created_at + to_hours(order_id % 72) END AS shipped_at,
    CASE WHEN status = 'refunded' THEN created_at + INTERVAL 10 DAY END AS refunded_at,
    CASE WHEN status = 'refunded' THEN CAST(subtotal * CAST(0.5 AS DECIMAL(2,1)) AS DECIMAL(12,2)) END AS refund_amount,
    order_id % 6 = 0 AS has_recommended_items,
    CASE WHEN order_id % 6 = 0 THEN CAST(subtotal * CAST(0.25 AS DECIMAL(3,2)) AS DECIMAL(12,2)) ELSE CAST(0 AS DECIMAL(12,2)) END AS recommended_items_value,
    created_at + INTERVAL 1 DAY AS updated_at
  FROM orders0),
ord AS (
  SELECT *, CASE WHEN status = 'delivered' THEN shipped_at + to_hours(order_id % 96) END AS delivered_at FROM orders1)"""

ITEMS = ORDERS + """,
items0 AS (
  SELECT *, CAST(gross * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(12,2)) AS disc
  FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(12,2)) AS gross FROM lineitem)),
items1 AS (
  SELECT *, CAST((gross - disc) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(12,2)) AS tax FROM items0),
items AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS quantity,
    CAST(round(CAST(gross * 100 AS BIGINT) / l_quantity) / 100 AS DECIMAL(12,2)) AS unit_price,
    gross AS line_subtotal, disc AS discount_amount, tax AS tax_amount, CAST(gross - disc + tax AS DECIMAL(12,2)) AS total_amount,
    l_partkey % 8 = 0 AS from_recommendation, l_linenumber AS line_number, l_shipdate AS shipped_on,
    merchant_id, customer_id, status, created_at
  FROM items1 JOIN ord ON l_orderkey = order_id)"""

PRODUCTS = """products AS (
  SELECT p_partkey AS product_id, p_name AS product_name, 'SKU-' || p_partkey AS sku, p_brand AS brand,
    p_type || ' > ' || p_brand AS category_path, p_type AS product_type,
    CAST(p_retailprice AS DECIMAL(12,2)) AS price,
    CASE WHEN p_partkey % 10 = 0 THEN CAST(CAST(p_retailprice AS DECIMAL(12,2)) * CAST(0.8 AS DECIMAL(2,1)) AS DECIMAL(12,2))
         WHEN p_partkey % 10 = 1 THEN CAST(0 AS DECIMAL(12,2)) END AS sale_price,
    CASE WHEN p_partkey % 13 <> 0 THEN CAST(CAST(p_retailprice AS DECIMAL(12,2)) * CAST(0.6 AS DECIMAL(2,1)) AS DECIMAL(12,2)) END AS cost,
    CASE WHEN p_partkey % 19 <> 0 THEN p_size * 10 - 30 END AS inventory_quantity, 50 AS low_stock_threshold,
    CASE WHEN p_partkey % 7 = 0 THEN 'continue' ELSE 'deny' END AS inventory_policy,
    CASE WHEN p_partkey % 23 = 0 THEN 'archived' ELSE 'active' END AS status
  FROM part)"""

MERCHANT_PRODUCTS = """merchant_products AS (
  SELECT s.merchant_id, p.* FROM (SELECT DISTINCT merchant_id, product_id FROM items) s JOIN products p USING (product_id))"""

EVENTS = """ev AS (
  SELECT event_id, user_id AS customer_id, c_nationkey AS merchant_id,
    CASE event_type WHEN 'view' THEN 'product_view' WHEN 'click' THEN 'add_to_cart' WHEN 'purchase' THEN 'purchase'
         WHEN 'signup' THEN 'sign_up' ELSE 'page_view' END AS event_type,
    ts, ts + to_seconds(event_id % 90) AS received_at, CAST(value AS DECIMAL(12,2)) AS value, CAST(value AS DECIMAL(12,2)) AS revenue,
    CASE WHEN event_type = 'purchase' THEN event_id END AS order_id, props AS properties,
    user_id || '-' || strftime(ts, '%Y%m%d') AS session_id,
    CASE event_id % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' ELSE 'tablet' END AS device,
    CASE event_id % 4 WHEN 0 THEN 'ios' WHEN 1 THEN 'android' WHEN 2 THEN 'server' ELSE 'web' END AS source
  FROM events JOIN customer ON user_id = c_custkey)"""

SUBSCRIPTIONS = ORDERS + """,
subs AS (
  SELECT order_id AS subscription_id, merchant_id, customer_id,
    CASE order_id // 10 % 7 WHEN 0 THEN 'weekly' WHEN 1 THEN 'biweekly' WHEN 2 THEN 'monthly' WHEN 3 THEN 'bimonthly'
         WHEN 4 THEN 'quarterly' WHEN 5 THEN 'annually' ELSE 'custom' END AS frequency,
    CASE WHEN status IN ('cancelled','refunded','pending') THEN 'cancelled' WHEN status = 'delivered' THEN 'active'
         WHEN order_id // 10 % 3 = 0 THEN 'paused' WHEN order_id // 10 % 3 = 1 THEN 'payment_failed' ELSE 'active' END AS status,
    subtotal AS estimated_total, created_at AS started_at,
    CASE WHEN status IN ('cancelled','refunded','pending') THEN created_at + to_days(CAST(order_id % 400 AS INTEGER)) END AS cancelled_at,
    CASE WHEN status IN ('cancelled','refunded','pending') THEN CASE order_id // 10 % 6 WHEN 0 THEN 'price' WHEN 1 THEN 'not_using'
         WHEN 2 THEN 'competitor' WHEN 3 THEN 'temporary' WHEN 4 THEN 'other' END END AS cancellation_reason,
    order_id // 10 % 12 AS total_orders_generated,
    CAST(subtotal * CAST(order_id // 10 % 12 AS DECIMAL(4,0)) AS DECIMAL(12,2)) AS total_revenue,
    order_id // 10 % 3 + 1 AS interval_count,
    CASE WHEN order_id // 10 % 5 = 0 THEN 2 ELSE 0 END AS retry_count
  FROM ord WHERE order_id % 10 = 0)"""


PAYLOADS = """payload AS (
  SELECT event_id, CASE WHEN event_id % 29 <> 0 THEN user_id % 25 END AS merchant_id, list_extract(
      ['product_view','product_view','add_to_cart','add_to_cart','purchase','purchase','page_view','page_view','custom','teleport','recommendation_view','logout',
       'recommendation_click','search','search_click','sign_up','login'], event_id % 17 + 1) AS event_type,
    CASE event_id % 17
      WHEN 0 THEN '{"product_id":"prod_' || k || '","price":' || amount || '}'
      WHEN 1 THEN '{"price":' || amount || ',"position":0}'
      WHEN 2 THEN '{"product_id":"prod_' || k || '","quantity":' || (event_id % 1100) || '}'
      WHEN 3 THEN '{"product_id":"sku' || repeat(k, 20) || '","quantity":"2"}'
      WHEN 4 THEN '{"order_id":"order_' || event_id || '","revenue":' || amount || ',"items":[]}'
      WHEN 5 THEN '{"order_id":null,"revenue":-' || amount || ',"items":{}}'
      WHEN 6 THEN '{"page_path":"/p/' || k || '","page_title":' || k || '}'
      WHEN 7 THEN '{}'
      WHEN 8 THEN '{"event_name":"Bad Name ' || k || '"}'
      WHEN 9 THEN '{"x":1}'
      WHEN 10 THEN '{"placement":"' || CASE WHEN event_id % 2 = 0 THEN 'pdp' ELSE 'sidebar' END || '","product_ids":["a","b"],"strategy":"hybrid"}'
      WHEN 11 THEN '{}'
      WHEN 12 THEN '{"placement":"pdp","product_id":"a","position":2.0,"strategy":"hybrid"}'
      WHEN 13 THEN '{"query":"ring","result_count":true,"filters":[]}'
      WHEN 14 THEN '{"query":"ring","product_id":"a","position":' || (event_id % 5) || '}'
      WHEN 15 THEN '{"method":"carrier pigeon"}'
      ELSE '{}' END AS properties,
    CASE event_id % 7 WHEN 0 THEN 'yesterday' WHEN 1 THEN '2024-01-15T12:00:00Z' END AS context_timestamp,
    CASE WHEN event_id % 2 = 0 THEN 'sess_' || k END AS session_id, CASE WHEN event_id % 4 = 0 THEN CAST(user_id AS VARCHAR) END AS user_id,
    CASE WHEN event_id % 5 = 0 THEN 'ios' WHEN event_id % 5 = 1 THEN 'fridge' END AS source, ts AS received_at
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) AS amount FROM events))"""
