"""Checked queries over orders, customers, merchants, products and subscriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.guards import ratio
from ..operators import customers as C
from ..operators import daily as D
from ..operators import merchants as M
from ..operators import orders as O
from ..operators import products as P
from ..operators import subscriptions as SUB
from ..plans import marts
from ..sources import entities as E
from . import sql_entities as Q
from .core import query

ASOF = "2001-08-02"
START, END = "1995-01-01", "2001-08-01"

SOLD = "ord WHERE status <> 'cancelled'"


def _orders(spark, root):
    return E.orders(spark, root)


# ------------------------------------------------------------------ order facts

ITEM_METRICS = """item_metrics AS (
  SELECT order_id, sum(quantity) AS item_count, count(DISTINCT product_id) AS unique_products,
    sum(line_subtotal) AS items_subtotal, sum(discount_amount) AS items_discount, sum(tax_amount) AS items_tax,
    CAST(sum(unit_price) AS DOUBLE) / count(unit_price) AS avg_item_price, max(unit_price) AS max_item_price, min(unit_price) AS min_item_price
  FROM items GROUP BY order_id)"""


@query("ag01_order_item_metrics",
       "order_id:i item_count:i unique_products:i items_subtotal:m items_discount:m items_tax:m avg_item_price:r max_item_price:m min_item_price:m",
       "SELECT * FROM item_metrics", (Q.ITEMS, ITEM_METRICS))
def _(spark, root):
    return O.item_metrics(E.raw_items(spark, root))


@query("jn01_orders_item_metrics", "order_id:i subtotal:m item_count:i unique_products:i items_subtotal:m",
       "SELECT o.order_id, o.subtotal, m.item_count, m.unique_products, m.items_subtotal FROM ord o LEFT JOIN item_metrics m USING (order_id)",
       (Q.ITEMS, ITEM_METRICS))
def _(spark, root):
    return O.with_item_metrics(E.raw_orders(spark, root), E.raw_items(spark, root))


@query("jn03_items_of_orders", "order_id:i product_id:i quantity:i line_subtotal:m",
       "SELECT order_id, product_id, quantity, line_subtotal FROM items WHERE order_id IN (SELECT order_id FROM ord)", (Q.ITEMS,))
def _(spark, root):
    return O.items_of(E.raw_items(spark, root), E.raw_orders(spark, root))


SEQUENCE = """sequence AS (
  SELECT *, row_number() OVER w = 1 AS is_first_order,
    date_diff('day', lag(created_at) OVER w, created_at) AS days_since_prev_order
  FROM ord WHERE status <> 'cancelled'
  WINDOW w AS (PARTITION BY merchant_id, customer_id ORDER BY created_at, order_id))"""


@query("wn01_first_order_flag", "order_id:i merchant_id:i customer_id:i is_first_order:b",
       "SELECT order_id, merchant_id, customer_id, is_first_order FROM sequence", (Q.ORDERS, SEQUENCE))
@query("wn03_days_since_previous_order", "order_id:i customer_id:i days_since_prev_order:i",
       "SELECT order_id, customer_id, days_since_prev_order FROM sequence", (Q.ORDERS, SEQUENCE))
def _(spark, root):
    return O.with_sequence(O.without_status(_orders(spark, root), "cancelled"))


@query("wn02_first_order_by_timestamp", "order_id:i customer_id:i is_first_order:b",
       """SELECT order_id, o.customer_id, created_at = f.first_at AS is_first_order FROM ord o
          JOIN (SELECT customer_id, min(created_at) AS first_at FROM ord GROUP BY 1) f ON f.customer_id = o.customer_id""", (Q.ORDERS,))
def _(spark, root):
    o = E.raw_orders(spark, root)
    return O.first_order_by_match(o, o.groupBy("customer_id").agg(F.min("created_at").alias("first_order_at")))


@query("pr06_without_cancelled", "status:s n:i gmv:m",
       "SELECT status, count(*) AS n, sum(subtotal) AS gmv FROM ord WHERE status NOT IN ('cancelled') GROUP BY 1", (Q.ORDERS,))
def _(spark, root):
    return O.without_status(E.raw_orders(spark, root), "cancelled").groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("subtotal").alias("gmv"))


@query("pr07_completed_orders", "status:s n:i revenue:m",
       "SELECT status, count(*) AS n, sum(total_amount) AS revenue FROM ord WHERE status IN ('delivered','shipped','confirmed','processing') GROUP BY 1", (Q.ORDERS,))
def _(spark, root):
    return O.completed(E.raw_orders(spark, root)).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_amount").alias("revenue"))


@query("pr09_gmv_nmv", "order_id:i gmv:m nmv:m",
       "SELECT order_id, subtotal AS gmv, subtotal - coalesce(discount_amount, 0) AS nmv FROM ord", (Q.ORDERS,))
def _(spark, root):
    return O.with_gmv(E.raw_orders(spark, root))


CAL = """SELECT order_id, CAST(created_at AS DATE) AS order_date, hour(created_at) AS order_hour, dayofweek(created_at) + 1 AS order_day_of_week,
  weekofyear(created_at) AS order_week, month(created_at) AS order_month, quarter(created_at) AS order_quarter, year(created_at) AS order_year,
  dayofweek(created_at) IN (0, 6) AS is_weekend FROM ord"""


@query("pr11_time_dimensions",
       "order_id:i order_date:d order_hour:i order_day_of_week:i order_week:i order_month:i order_quarter:i order_year:i is_weekend:b", CAL, (Q.ORDERS,))
def _(spark, root):
    return O.with_calendar(E.raw_orders(spark, root))


@query("pr13_status_category", "category:s n:i",
       """SELECT CASE WHEN status IN ('delivered','shipped') THEN 'fulfilled' WHEN status IN ('cancelled','refunded') THEN 'cancelled'
          WHEN status IN ('pending','confirmed','processing') THEN 'in_progress' ELSE 'other' END AS category, count(*) AS n FROM ord GROUP BY 1""", (Q.ORDERS,))
def _(spark, root):
    return E.raw_orders(spark, root).groupBy(S.order_status_category("status").alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("pr14_net_revenue", "order_id:i net_revenue:m",
       "SELECT order_id, total_amount - coalesce(refund_amount, 0) AS net_revenue FROM ord", (Q.ORDERS,))
@query("pr17_recommendation_share", "order_id:i recommendation_revenue_share:r",
       """SELECT order_id, CASE WHEN has_recommended_items THEN CAST(recommended_items_value AS DOUBLE) / CAST(nullif(subtotal, 0) AS DOUBLE) ELSE 0 END
          AS recommendation_revenue_share FROM ord""", (Q.ORDERS,))
def _(spark, root):
    return E.raw_orders(spark, root).withColumns(O.revenue_columns())


@query("pr15_fulfilment_hours", "order_id:i hours_to_ship:i hours_in_transit:i",
       """SELECT order_id, CASE WHEN shipped_at IS NOT NULL THEN date_diff('hour', created_at, shipped_at) END AS hours_to_ship,
          CASE WHEN delivered_at IS NOT NULL THEN date_diff('hour', shipped_at, delivered_at) END AS hours_in_transit FROM ord""", (Q.ORDERS,))
def _(spark, root):
    return E.raw_orders(spark, root).withColumns(O.fulfilment_hours())


GROUPING = """CASE WHEN utm_source = 'direct' OR utm_source IS NULL THEN 'Direct' WHEN utm_medium = 'cpc' THEN 'Paid Search'
  WHEN utm_medium = 'organic' THEN 'Organic Search' WHEN utm_source LIKE '%facebook%' OR utm_source LIKE '%instagram%' THEN 'Paid Social'
  WHEN utm_medium = 'email' THEN 'Email' WHEN utm_medium = 'referral' THEN 'Referral' ELSE 'Other' END"""


@query("pr16_channel_grouping", "channel_grouping:s n:i gmv:m",
       f"SELECT {GROUPING} AS channel_grouping, count(*) AS n, sum(subtotal) AS gmv FROM ord GROUP BY 1", (Q.ORDERS,))
def _(spark, root):
    return E.raw_orders(spark, root).groupBy(S.channel_grouping("utm_source", "utm_medium").alias("channel_grouping")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("subtotal").alias("gmv"))


@query("pr18_order_flags", "order_id:i is_paid:b has_coupon:b is_refunded:b",
       "SELECT order_id, paid_at IS NOT NULL AS is_paid, coupon_code IS NOT NULL AS has_coupon, refunded_at IS NOT NULL AS is_refunded FROM ord", (Q.ORDERS,))
def _(spark, root):
    return E.raw_orders(spark, root).withColumns(O.order_flags())


@query("pr39_order_state", "status:s is_terminal:b is_active:b is_fully_refunded:b n:i",
       """SELECT status, status IN ('delivered','cancelled','refunded') AS is_terminal, status IN ('pending','confirmed','processing','shipped') AS is_active,
          coalesce(refund_amount >= total_amount, false) AS is_fully_refunded, count(*) AS n FROM ord GROUP BY ALL""", (Q.ORDERS,))
def _(spark, root):
    cols = O.lifecycle_flags()
    return E.raw_orders(spark, root).withColumns(cols).groupBy("status", *cols).agg(F.count(F.lit(1)).alias("n"))


@query("pr19_line_economics", "order_id:i product_id:i line_number:i quantity:i gmv:m nmv:m effective_unit_price:r discount_rate:r",
       """SELECT order_id, product_id, line_number, quantity, quantity * unit_price AS gmv, quantity * unit_price - discount_amount AS nmv,
          CASE WHEN quantity > 0 THEN CAST(total_amount - tax_amount AS DOUBLE) / quantity ELSE 0 END AS effective_unit_price,
          CASE WHEN quantity * unit_price > 0 THEN CAST(discount_amount AS DOUBLE) / CAST(quantity * unit_price AS DOUBLE) ELSE 0 END AS discount_rate FROM items""", (Q.ITEMS,))
def _(spark, root):
    return E.raw_items(spark, root).withColumns(O.line_economics())


@query("pr43_recommendation_attribution", "order_id:i has_recommended_items:b recommended_items_value:m recommended_lines:i",
       """SELECT order_id, bool_or(from_recommendation) AS has_recommended_items, sum(CASE WHEN from_recommendation THEN total_amount ELSE 0 END) AS recommended_items_value,
          count(*) FILTER (from_recommendation) AS recommended_lines FROM items GROUP BY 1""", (Q.ITEMS,))
def _(spark, root):
    return O.recommendation_attribution(E.raw_items(spark, root))


@query("pr44_line_margin", "product_id:i lines:i margin:m unknown:i",
       """SELECT product_id, count(*) AS lines, sum(i.total_amount - i.quantity * p.cost) AS margin, count(*) FILTER (p.cost IS NULL) AS unknown
          FROM items i LEFT JOIN products p USING (product_id) GROUP BY 1""", (Q.ITEMS, Q.PRODUCTS))
def _(spark, root):
    return O.line_margin(E.raw_items(spark, root), E.products(spark, root)).groupBy("product_id").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("margin").alias("margin"), F.sum(F.col("cost").isNull().cast("int")).alias("unknown"))


INT_ITEMS = """SELECT i.order_id, i.merchant_id, i.customer_id, i.product_id, i.line_number, i.status AS order_status, CAST(i.created_at AS DATE) AS order_date,
  p.product_name, p.sku, p.category_path, split_part(p.category_path, ' > ', 1) AS category_l1, split_part(p.category_path, ' > ', 2) AS category_l2,
  i.quantity, i.unit_price, quantity * unit_price AS gmv, quantity * unit_price - discount_amount AS nmv
  FROM items i LEFT JOIN products p USING (product_id)"""


@query("jb07_int_order_items",
       "order_id:i merchant_id:i customer_id:i product_id:i line_number:i order_status:s order_date:d product_name:s sku:s category_path:s category_l1:s category_l2:s quantity:i unit_price:m gmv:m nmv:m",
       INT_ITEMS, (Q.ITEMS, Q.PRODUCTS))
@query("jn11_items_orders_products", "order_id:i product_id:i line_number:i merchant_id:i product_name:s",
       f"SELECT order_id, product_id, line_number, merchant_id, product_name FROM ({INT_ITEMS})", (Q.ITEMS, Q.PRODUCTS))
@query("pr41_category_levels", "product_id:i line_number:i order_id:i category_l1:s category_l2:s",
       f"SELECT product_id, line_number, order_id, category_l1, category_l2 FROM ({INT_ITEMS})", (Q.ITEMS, Q.PRODUCTS))
def _(spark, root):
    return O.enrich_items(E.raw_items(spark, root), _orders(spark, root), E.products(spark, root))


# ------------------------------------------------------------------ customers

TIER_SQL = "CASE WHEN {0} >= 5000 THEN 'platinum' WHEN {0} >= 1000 THEN 'gold' WHEN {0} >= 250 THEN 'silver' ELSE 'bronze' END"
LEGACY_SQL = "CASE {0} WHEN 'platinum' THEN 'tier1' WHEN 'gold' THEN 'tier2' WHEN 'silver' THEN 'tier3' ELSE 'tier4' END"
CHURN_SQL = "CASE WHEN {0} > 365 THEN 0.95 WHEN {0} > 180 THEN 0.75 WHEN {0} > 90 THEN 0.50 WHEN {0} > 30 THEN 0.25 ELSE 0.10 END"
SEGMENT_SQL = """CASE WHEN recency_score >= 4 AND frequency_score >= 4 AND monetary_score >= 4 THEN 'champion'
  WHEN frequency_score >= 4 AND recency_score >= 3 THEN 'loyal' WHEN recency_score >= 4 AND frequency_score <= 2 THEN 'promising'
  WHEN recency_score <= 2 AND frequency_score >= 3 THEN 'at_risk' WHEN recency_score <= 2 AND frequency_score <= 2 THEN 'hibernating'
  WHEN recency_score = 3 AND frequency_score = 3 THEN 'needs_attention' ELSE 'regular' END"""
RECENCY_SQL = "CASE WHEN {0} <= 7 THEN 5 WHEN {0} <= 30 THEN 4 WHEN {0} <= 90 THEN 3 WHEN {0} <= 180 THEN 2 ELSE 1 END"

LTV = """ltv AS (
  SELECT merchant_id, customer_id, sum(total_amount) AS ltv, count(*) AS total_orders,
    CAST(sum(total_amount) AS DOUBLE) / count(*) AS avg_order_value, min(created_at) AS first_order_at, max(created_at) AS last_order_at,
    sum(item_count) AS total_items_purchased, max(total_amount) AS largest_order, min(total_amount) AS smallest_order,
    stddev_samp(CAST(total_amount AS DOUBLE)) AS order_value_stddev
  FROM ord WHERE status IN ('delivered','shipped','confirmed','processing') GROUP BY 1, 2)"""

DIM = f"""dim0 AS (
  SELECT c.customer_id, c.merchant_id, c.email, c.first_name, c.last_name, c.status, c.email_opt_in, c.sms_opt_in, c.acquisition_source, c.created_at,
    coalesce(l.ltv, 0) AS ltv, coalesce(l.total_orders, 0) AS total_orders, coalesce(l.avg_order_value, 0) AS avg_order_value,
    coalesce(l.total_items_purchased, 0) AS total_items_purchased, l.largest_order, l.smallest_order, l.first_order_at, l.last_order_at,
    date_diff('day', CAST(l.last_order_at AS DATE), DATE '{ASOF}') AS days_since_last_order
  FROM customers c LEFT JOIN ltv l USING (merchant_id, customer_id)),
dim1 AS (
  SELECT *, {TIER_SQL.format('ltv')} AS tier, {RECENCY_SQL.format('days_since_last_order')} AS recency_score,
    CASE WHEN total_orders >= 10 THEN 5 WHEN total_orders >= 5 THEN 4 WHEN total_orders >= 3 THEN 3 WHEN total_orders >= 2 THEN 2 ELSE 1 END AS frequency_score,
    CASE WHEN ltv >= 1000 THEN 5 WHEN ltv >= 500 THEN 4 WHEN ltv >= 200 THEN 3 WHEN ltv >= 50 THEN 2 ELSE 1 END AS monetary_score,
    {CHURN_SQL.format('days_since_last_order')} AS churn_risk,
    date_diff('month', date_trunc('month', first_order_at), date_trunc('month', DATE '{ASOF}'))
      + CASE WHEN day(first_order_at) = 2 OR (first_order_at::DATE = last_day(first_order_at) AND DATE '{ASOF}' = last_day(DATE '{ASOF}')) THEN 0
             ELSE (2 - day(first_order_at)) / 31.0 END AS tenure_months
  FROM dim0),
dim AS (
  SELECT *, {LEGACY_SQL.format('tier')} AS legacy_tier, recency_score + frequency_score + monetary_score AS rfm_score,
    {SEGMENT_SQL} AS segment, CASE WHEN tenure_months < 3 THEN 'new' WHEN tenure_months < 12 THEN 'developing'
      WHEN tenure_months < 24 THEN 'established' ELSE 'mature' END AS lifecycle_stage,
    total_orders > 1 AS is_repeat_customer, days_since_last_order <= 30 AS has_recent_activity, last_order_at IS NULL AS never_ordered
  FROM dim1)"""
DIM_CTES = (Q.CUSTOMERS, Q.ORDERS, LTV, DIM)


@query("ag02_customer_ltv",
       "merchant_id:i customer_id:i ltv:m total_orders:i avg_order_value:r first_order_at:t last_order_at:t total_items_purchased:i largest_order:m smallest_order:m order_value_stddev:r4",
       "SELECT * FROM ltv", (Q.ORDERS, LTV))
def _(spark, root):
    return C.customer_value(O.completed(_orders(spark, root)))


def _dim(spark, root):
    return marts.dim_customers(E.customers(spark, root), _orders(spark, root), ASOF)


@query("jb02_dim_customers",
       "customer_id:i merchant_id:i email:s first_name:s last_name:s status:s tier:s legacy_tier:s segment:s lifecycle_stage:s ltv:m total_orders:i "
       "avg_order_value:r total_items_purchased:i largest_order:m smallest_order:m first_order_at:t last_order_at:t days_since_last_order:i tenure_months:r6 "
       "recency_score:i frequency_score:i monetary_score:i rfm_score:i churn_risk:r is_repeat_customer:b has_recent_activity:b never_ordered:b email_opt_in:b sms_opt_in:b "
       "acquisition_source:s created_at:d", "SELECT * FROM dim", DIM_CTES)
@query("pr20_customer_tier", "customer_id:i ltv:m tier:s", "SELECT * FROM dim", DIM_CTES)
@query("pr21_legacy_tier", "customer_id:i tier:s legacy_tier:s", "SELECT * FROM dim", DIM_CTES)
@query("pr22_rfm_scores", "customer_id:i recency_score:i frequency_score:i monetary_score:i rfm_score:i", "SELECT * FROM dim", DIM_CTES)
@query("pr24_rfm_segment", "customer_id:i segment:s", "SELECT * FROM dim", DIM_CTES)
@query("pr25_churn_risk", "customer_id:i days_since_last_order:i churn_risk:r", "SELECT * FROM dim", DIM_CTES)
@query("pr26_tenure_lifecycle", "customer_id:i tenure_months:r6 lifecycle_stage:s", "SELECT * FROM dim", DIM_CTES)
@query("pr27_activity_flags", "customer_id:i is_repeat_customer:b has_recent_activity:b never_ordered:b", "SELECT * FROM dim", DIM_CTES)
@query("jn04_customers_with_value", "customer_id:i merchant_id:i ltv:m total_orders:i avg_order_value:r", "SELECT * FROM dim", DIM_CTES)
def _(spark, root):
    return _dim(spark, root)


STG_ORD = f"""stg AS (
  SELECT *, status AS order_status, utm_source AS traffic_source, utm_medium AS traffic_medium, utm_campaign AS campaign_name,
    coalesce(currency_raw, 'USD') AS currency
  FROM ord WHERE merchant_id NOT IN (24) AND status <> 'test')"""


def _staged(spark, root):
    return O.stage_orders(_orders(spark, root), test_merchants=(24,))


@query("jb06_stg_orders", "order_id:i merchant_id:i customer_id:i order_status:s currency:s subtotal:m discount_amount:m total_amount:m traffic_source:s traffic_medium:s campaign_name:s coupon_code:s created_at:t updated_at:t",
       "SELECT * FROM stg", (Q.ORDERS, STG_ORD))
def _(spark, root):
    return _staged(spark, root)


@query("pr04_staging_orders", "merchant_id:i order_status:s currency:s n:i total_amount:m",
       "SELECT merchant_id, order_status, currency, count(*) AS n, sum(total_amount) AS total_amount FROM stg GROUP BY 1, 2, 3", (Q.ORDERS, STG_ORD))
def _(spark, root):
    return _staged(spark, root).groupBy("merchant_id", "order_status", "currency").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_amount").alias("total_amount"))


STG_CUST = """stg_customers AS (
  SELECT *, coalesce(first_name, '') || ' ' || coalesce(last_name, '') AS full_name,
    CASE WHEN coalesce(first_name, '') = '' AND coalesce(last_name, '') = '' THEN 'Unknown'
         ELSE concat_ws(' ', nullif(first_name, ''), nullif(last_name, '')) END AS display_name
  FROM customers WHERE deleted_at IS NULL)"""


@query("pr05_staging_customers", "customer_id:i merchant_id:i email:s full_name:s display_name:s", "SELECT * FROM stg_customers", (Q.CUSTOMERS, STG_CUST))
@query("jb06_stg_customers", "customer_id:i merchant_id:i email:s first_name:s last_name:s full_name:s ltv:m created_at:d",
       "SELECT * FROM stg_customers", (Q.CUSTOMERS, STG_CUST))
def _(spark, root):
    return C.stage_customers(E.customers(spark, root))


MODEL_DIM = f"""om AS (
  SELECT customer_id, count(*) AS n, sum(total_amount) AS spent, min(created_at) AS first_at, max(created_at) AS last_at, sum(subtotal) AS gmv,
    sum(CASE WHEN has_recommended_items THEN recommended_items_value ELSE 0 END) AS rec
  FROM stg WHERE order_status NOT IN ('cancelled','refunded') GROUP BY 1),
l12 AS (
  SELECT customer_id, sum(total_amount - coalesce(refund_amount, 0)) AS net12 FROM stg
  WHERE order_status <> 'cancelled' AND created_at >= DATE '{ASOF}' - INTERVAL 12 MONTH GROUP BY 1),
seg AS (
  SELECT customer_id, date_diff('day', CAST(last_at AS DATE), DATE '{ASOF}') AS days,
    CASE WHEN date_diff('day', CAST(first_at AS DATE), DATE '{ASOF}') <= 30 THEN 'new' WHEN net12 >= 5000 AND n >= 10 THEN 'vip'
      WHEN date_diff('day', CAST(last_at AS DATE), DATE '{ASOF}') <= 90 THEN 'active'
      WHEN date_diff('day', CAST(last_at AS DATE), DATE '{ASOF}') > 180 THEN 'churned' ELSE 'active' END AS segment
  FROM om LEFT JOIN l12 USING (customer_id)),
mdim AS (
  SELECT c.customer_id, c.merchant_id, c.full_name, coalesce({{tier}}, 'bronze') AS customer_tier, s.segment AS customer_segment,
    coalesce(l.net12, c.ltv, 0) AS ltv, coalesce(o.n, 0) AS total_orders, coalesce(o.spent, 0) AS total_spent,
    coalesce(CAST(o.spent AS DOUBLE) / o.n, 0) AS average_order_value, coalesce(o.gmv, 0) AS total_gmv, coalesce(o.rec, 0) AS recommendation_attributed_revenue,
    o.first_at AS first_order_at, o.last_at AS last_order_at, coalesce(s.days, 0) AS days_since_last_order, coalesce(s.days > 180, false) AS is_churned
  FROM stg_customers c LEFT JOIN om o USING (customer_id) LEFT JOIN l12 l USING (customer_id) LEFT JOIN seg s USING (customer_id))""".replace(
    "{tier}", "CASE WHEN l.net12 IS NOT NULL THEN " + TIER_SQL.format("l.net12") + " END")
MODEL_CTES = (Q.CUSTOMERS, Q.ORDERS, STG_ORD, STG_CUST, MODEL_DIM)


def _model_dim(spark, root):
    return C.model_customers(C.stage_customers(E.customers(spark, root)), _staged(spark, root), ASOF)


@query("jb09_model_dim_customers",
       "customer_id:i merchant_id:i full_name:s customer_tier:s customer_segment:s ltv:m total_orders:i total_spent:m average_order_value:r total_gmv:m "
       "recommendation_attributed_revenue:m first_order_at:t last_order_at:t days_since_last_order:i is_churned:b", "SELECT * FROM mdim", MODEL_CTES)
@query("pr28_activity_segment", "customer_id:i customer_segment:s", "SELECT * FROM mdim", MODEL_CTES)
@query("pr29_churn_flag", "customer_id:i days_since_last_order:i is_churned:b", "SELECT * FROM mdim", MODEL_CTES)
@query("jn13_customers_metrics_tier_segment", "customer_id:i customer_tier:s customer_segment:s total_orders:i", "SELECT * FROM mdim", MODEL_CTES)
def _(spark, root):
    return _model_dim(spark, root)


@query("ag03_model_order_metrics", "customer_id:i calculated_order_count:i calculated_total_spent:m calculated_aov:r calculated_first_order_at:t calculated_last_order_at:t gmv:m rec_attributed_revenue:m",
       """SELECT customer_id, n AS calculated_order_count, spent AS calculated_total_spent, CAST(spent AS DOUBLE) / n AS calculated_aov, first_at AS calculated_first_order_at,
          last_at AS calculated_last_order_at, gmv, rec AS rec_attributed_revenue FROM om""", MODEL_CTES)
def _(spark, root):
    return C.model_order_metrics(_staged(spark, root))


@query("ag04_trailing_ltv", "customer_id:i calculated_ltv:m", "SELECT customer_id, net12 AS calculated_ltv FROM l12", MODEL_CTES)
def _(spark, root):
    return C.trailing_ltv(_staged(spark, root), ASOF)


VIEW = f"""v0 AS (
  SELECT customer_id, merchant_id, email, ltv, total_orders, last_order_at, days_since_last_order,
    CASE WHEN months > 0 THEN CAST(total_orders AS DOUBLE) / months ELSE total_orders END AS orders_per_month,
    CASE WHEN total_orders > 0 THEN CAST(ltv AS DOUBLE) / total_orders ELSE 0 END AS avg_order_value
  FROM (SELECT *, date_diff('month', created_at, DATE '{ASOF}') AS months FROM dim WHERE status = 'active')),
v1 AS (
  SELECT *, {RECENCY_SQL.format('days_since_last_order')} AS recency_score,
    CASE WHEN orders_per_month >= 2 THEN 5 WHEN orders_per_month >= 1 THEN 4 WHEN orders_per_month >= 0.5 THEN 3 WHEN orders_per_month >= 0.25 THEN 2 ELSE 1 END AS frequency_score,
    CASE WHEN avg_order_value >= 200 THEN 5 WHEN avg_order_value >= 100 THEN 4 WHEN avg_order_value >= 50 THEN 3 WHEN avg_order_value >= 25 THEN 2 ELSE 1 END AS monetary_score
  FROM v0)"""
VIEW_SQL = f"""SELECT *, recency_score + frequency_score + monetary_score AS rfm_score, {SEGMENT_SQL} AS segment,
  {CHURN_SQL.format('days_since_last_order')} AS churn_risk FROM v1"""


@query("jb12_customer_segments_view",
       "customer_id:i merchant_id:i email:s ltv:m total_orders:i last_order_at:t days_since_last_order:i orders_per_month:r avg_order_value:r recency_score:i frequency_score:i monetary_score:i rfm_score:i segment:s churn_risk:r",
       VIEW_SQL, (*DIM_CTES, VIEW))
@query("pr23_rfm_by_rate", "customer_id:i orders_per_month:r avg_order_value:r frequency_score:i monetary_score:i", VIEW_SQL, (*DIM_CTES, VIEW))
def _(spark, root):
    return C.segments_view(_dim(spark, root), ASOF)


@query("pr30_behaviour_segments", "merchant_id:i customer_id:i line_count:i sale_lines:i top_brand_orders:i order_count:i category_count:i behaviour:s",
       """SELECT *, CASE WHEN sale_lines >= 0.5 * line_count THEN 'bargain' WHEN order_count >= 3 AND top_brand_orders >= 0.6 * order_count THEN 'brand_loyal'
            WHEN category_count >= 5 THEN 'explorer' ELSE 'none' END AS behaviour FROM (
          SELECT merchant_id, customer_id, count(*) AS line_count, count(*) FILTER (discount_amount > 0) AS sale_lines,
            count(DISTINCT order_id) AS order_count, count(DISTINCT product_type) AS category_count
          FROM items JOIN products USING (product_id) GROUP BY 1, 2)
          JOIN (SELECT merchant_id, customer_id, max(bo) AS top_brand_orders FROM (
            SELECT merchant_id, customer_id, brand, count(DISTINCT order_id) AS bo FROM items JOIN products USING (product_id) GROUP BY 1, 2, 3) GROUP BY 1, 2)
          USING (merchant_id, customer_id)""", (Q.ITEMS, Q.PRODUCTS))
def _(spark, root):
    return C.behaviour(E.items(spark, root), E.products(spark, root), rows=E.table(spark, root, "lineitem").count())


@query("pr42_shareable_customers", "customer_hash:s merchant_id:i email_masked:s first_name_masked:s last_name_masked:s name_slug:s",
       """SELECT sha256(CAST(customer_id AS VARCHAR)) AS customer_hash, merchant_id,
          substring(split_part(email, '@', 1), 1, 2) || repeat('*', length(split_part(email, '@', 1)) - 2) || '@' || split_part(email, '@', 2) AS email_masked,
          CASE WHEN length(first_name) <= 1 THEN repeat('*', length(first_name)) ELSE substring(first_name, 1, 1) || repeat('*', length(first_name) - 1) END AS first_name_masked,
          substring(last_name, 1, 4) || repeat('*', length(last_name) - 4) AS last_name_masked,
          replace(lower(concat_ws(' ', first_name, last_name)), ' ', '-') AS name_slug FROM customers""", (Q.CUSTOMERS,))
def _(spark, root):
    return C.shareable(E.customers(spark, root))


@query("jn17_new_customers", "merchant_id:i new_customers:i",
       """SELECT merchant_id, count(*) AS new_customers FROM (SELECT merchant_id, customer_id, min(created_at) AS f FROM ord WHERE status <> 'cancelled' GROUP BY 1, 2)
          WHERE f BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31' GROUP BY 1""", (Q.ORDERS,))
def _(spark, root):
    return C.new_customers(O.without_status(_orders(spark, root), "cancelled"), "1996-01-01", "1996-12-31")


# ------------------------------------------------------------------ facts and daily aggregates

FACT = """fact AS (
  SELECT s.order_id, s.merchant_id, s.customer_id, s.status, s.channel, CAST(s.created_at AS DATE) AS order_date, s.created_at, s.subtotal, s.discount_amount,
    s.tax_amount, s.shipping_amount, s.total_amount, s.subtotal AS gmv, s.subtotal - coalesce(s.discount_amount, 0) AS nmv,
    m.item_count, m.unique_products, m.avg_item_price, coalesce(d.tier, 'bronze') AS customer_tier, d.ltv AS customer_ltv_at_order,
    s.is_first_order, s.days_since_prev_order, s.utm_source, s.utm_medium, s.utm_campaign,
    dayofweek(s.created_at) + 1 AS order_day_of_week, dayofweek(s.created_at) IN (0, 6) AS is_weekend, quarter(s.created_at) AS order_quarter
  FROM sequence s LEFT JOIN item_metrics m USING (order_id) LEFT JOIN dim d USING (merchant_id, customer_id))"""
FACT_CTES = (Q.CUSTOMERS, Q.ITEMS, LTV, DIM, ITEM_METRICS, SEQUENCE, FACT)


def _fact(spark, root):
    return marts.fact_orders(_orders(spark, root), E.raw_items(spark, root), _dim(spark, root))


FACT_SPEC = ("order_id:i merchant_id:i customer_id:i status:s channel:s order_date:d created_at:t subtotal:m discount_amount:m tax_amount:m shipping_amount:m "
             "total_amount:m gmv:m nmv:m item_count:i unique_products:i avg_item_price:r customer_tier:s customer_ltv_at_order:m is_first_order:b "
             "days_since_prev_order:i order_day_of_week:i order_quarter:i is_weekend:b utm_source:s utm_medium:s utm_campaign:s")


@query("jb01_fact_orders", FACT_SPEC, "SELECT * FROM fact", FACT_CTES)
@query("jn02_orders_with_tier", "order_id:i customer_id:i customer_tier:s customer_ltv_at_order:m", "SELECT * FROM fact", FACT_CTES)
def _(spark, root):
    return _fact(spark, root)


@query("io10_fact_orders_one_day", FACT_SPEC, "SELECT * FROM fact WHERE order_date = DATE '1998-10-03'", FACT_CTES)
def _(spark, root):
    return marts.fact_orders(_orders(spark, root), E.raw_items(spark, root), _dim(spark, root), "1998-10-03")


@query("io27_backfill_range", FACT_SPEC, "SELECT * FROM fact WHERE order_date BETWEEN DATE '1998-01-01' AND DATE '1998-03-31'", FACT_CTES)
def _(spark, root):
    return marts.fact_orders(_orders(spark, root), E.raw_items(spark, root), _dim(spark, root), "1998-01-01", "1998-03-31")


@query("pr08_sold_in_range", "order_date:d n:i gmv:m",
       "SELECT order_date, count(*) AS n, sum(gmv) AS gmv FROM fact WHERE order_date BETWEEN DATE '1998-01-01' AND DATE '1998-03-31' AND status NOT IN ('cancelled','refunded') GROUP BY 1", FACT_CTES)
def _(spark, root):
    return D.sold_between(_fact(spark, root), "1998-01-01", "1998-03-31").groupBy("order_date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("gmv").alias("gmv"))


_CH = "".join(f", sum(gmv) FILTER (channel = '{c}') AS {c}_gmv, nullif(count(*) FILTER (channel = '{c}'), 0) AS {c}_orders" for c in D.CHANNELS)
_TI = "".join(f", sum(gmv) FILTER (customer_tier = '{t}') AS {t}_gmv, nullif(count(*) FILTER (customer_tier = '{t}'), 0) AS {t}_orders, count(DISTINCT customer_id) FILTER (customer_tier = '{t}') AS {t}_customers" for t in D.TIERS)

DAILY = f"""daily AS (
  SELECT merchant_id, order_date, sum(gmv) AS total_gmv, sum(nmv) AS total_nmv, sum(total_amount) AS total_revenue, count(*) AS order_count,
    sum(item_count) AS total_items_sold, sum(unique_products) AS total_unique_products, CAST(sum(gmv) AS DOUBLE) / count(gmv) AS avg_order_value,
    CAST(sum(total_amount) AS DOUBLE) / count(*) AS avg_revenue_per_order, sum(discount_amount) AS total_discounts,
    count(DISTINCT customer_id) AS unique_customers, count(*) FILTER (is_first_order) AS new_customers, max(gmv) AS max_order_gmv, min(gmv) AS min_order_gmv,
    quantile_disc(gmv, 0.5) AS median_order_gmv,
    count(DISTINCT customer_id) - count(*) FILTER (is_first_order) AS returning_customers,
    CAST(count(*) FILTER (is_first_order) AS DOUBLE) / count(DISTINCT customer_id) AS new_customer_rate,
    CASE WHEN sum(gmv) > 0 THEN CAST(sum(discount_amount) AS DOUBLE) / CAST(sum(gmv) AS DOUBLE) ELSE 0 END AS discount_rate,
    CAST(sum(item_count) AS DOUBLE) / count(*) AS items_per_order{_CH}{_TI}
  FROM fact WHERE status NOT IN ('cancelled','refunded') GROUP BY 1, 2),
daily_cmp AS (
  SELECT *, CASE WHEN prev_day_gmv > 0 THEN (CAST(total_gmv AS DOUBLE) - CAST(prev_day_gmv AS DOUBLE)) / CAST(prev_day_gmv AS DOUBLE) * 100 END AS gmv_dod_change,
    CASE WHEN prev_week_gmv > 0 THEN (CAST(total_gmv AS DOUBLE) - CAST(prev_week_gmv AS DOUBLE)) / CAST(prev_week_gmv AS DOUBLE) * 100 END AS gmv_wow_change
  FROM (SELECT *, lag(total_gmv, 1) OVER w AS prev_day_gmv, lag(total_gmv, 7) OVER w AS prev_week_gmv, sum(total_gmv) OVER w7 AS gmv_7d_rolling,
      sum(order_count) OVER w7 AS orders_7d_rolling, sum(total_gmv) OVER w30 AS gmv_30d_rolling, sum(order_count) OVER w30 AS orders_30d_rolling,
      CAST(sum(total_gmv) OVER w7 AS DOUBLE) / count(total_gmv) OVER w7 AS avg_daily_gmv_7d, CAST(sum(total_gmv) OVER w30 AS DOUBLE) / count(total_gmv) OVER w30 AS avg_daily_gmv_30d
    FROM daily WINDOW w AS (PARTITION BY merchant_id ORDER BY order_date),
      w7 AS (PARTITION BY merchant_id ORDER BY order_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
      w30 AS (PARTITION BY merchant_id ORDER BY order_date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)))"""
DAILY_CTES = (*FACT_CTES, DAILY)
CORE_SPEC = ("merchant_id:i order_date:d total_gmv:m total_nmv:m total_revenue:m order_count:i total_items_sold:i total_unique_products:i avg_order_value:r "
             "avg_revenue_per_order:r total_discounts:m unique_customers:i new_customers:i max_order_gmv:m min_order_gmv:m median_order_gmv:m "
             "returning_customers:i new_customer_rate:r discount_rate:r items_per_order:r")
CH_SPEC = " ".join(f"{c}_gmv:m {c}_orders:i" for c in D.CHANNELS)
TI_SPEC = " ".join(f"{t}_gmv:m {t}_orders:i {t}_customers:i" for t in D.TIERS)
CMP_SPEC = ("prev_day_gmv:m prev_week_gmv:m gmv_dod_change:r gmv_wow_change:r gmv_7d_rolling:m orders_7d_rolling:i gmv_30d_rolling:m orders_30d_rolling:i "
            "avg_daily_gmv_7d:r avg_daily_gmv_30d:r")


def _sold(spark, root):
    return D.sold_between(_fact(spark, root), START, END)


@query("ag05_daily_gmv", CORE_SPEC, "SELECT * FROM daily", DAILY_CTES)
def _(spark, root):
    return D.daily_gmv(_sold(spark, root))


@query("ag07_channel_pivot", f"merchant_id:i order_date:d {CH_SPEC}", "SELECT * FROM daily", DAILY_CTES)
def _(spark, root):
    return D.channel_breakdown(_sold(spark, root)).withColumns({f"{c}_orders": F.nullif(f"{c}_orders", F.lit(0)) for c in D.CHANNELS})


@query("ag08_tier_pivot", f"merchant_id:i order_date:d {TI_SPEC}", "SELECT * FROM daily", DAILY_CTES)
def _(spark, root):
    return D.tier_breakdown(_sold(spark, root)).withColumns({f"{t}_customers": F.coalesce(f"{t}_customers", F.lit(0)) for t in D.TIERS})


@query("jb03_agg_daily_gmv", f"{CORE_SPEC} {CH_SPEC} {TI_SPEC} {CMP_SPEC}", "SELECT * FROM daily_cmp", DAILY_CTES)
@query("jn05_daily_with_breakdowns", f"merchant_id:i order_date:d total_gmv:m {CH_SPEC} {TI_SPEC}", "SELECT * FROM daily_cmp", DAILY_CTES)
@query("wn04_day_week_change", "merchant_id:i order_date:d total_gmv:m prev_day_gmv:m prev_week_gmv:m gmv_dod_change:r gmv_wow_change:r", "SELECT * FROM daily_cmp", DAILY_CTES)
@query("wn06_rolling_rows", "merchant_id:i order_date:d gmv_7d_rolling:m orders_7d_rolling:i gmv_30d_rolling:m orders_30d_rolling:i avg_daily_gmv_7d:r avg_daily_gmv_30d:r",
       "SELECT * FROM daily_cmp", DAILY_CTES)
def _(spark, root):
    return marts.agg_daily_gmv(_fact(spark, root), START, END)


def _daily(spark, root):
    return D.daily_core(_sold(spark, root))


@query("wn06_rolling_calendar", "merchant_id:i order_date:d gmv_7d_rolling:m gmv_30d_rolling:m orders_7d_rolling:i",
       """SELECT merchant_id, order_date, sum(total_gmv) OVER (PARTITION BY merchant_id ORDER BY order_date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS gmv_7d_rolling,
          sum(total_gmv) OVER (PARTITION BY merchant_id ORDER BY order_date RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW) AS gmv_30d_rolling,
          sum(order_count) OVER (PARTITION BY merchant_id ORDER BY order_date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS orders_7d_rolling FROM daily""", DAILY_CTES)
def _(spark, root):
    return D.rolling(_daily(spark, root), calendar=True)


@query("wn05_lag_month", "merchant_id:i order_date:d total_gmv_same_day_last_month:m",
       "SELECT merchant_id, order_date, lag(total_gmv, 30) OVER (PARTITION BY merchant_id ORDER BY order_date) AS total_gmv_same_day_last_month FROM daily", DAILY_CTES)
def _(spark, root):
    return D.lag_month(_daily(spark, root), "total_gmv")


@query("wn07_month_to_date", "merchant_id:i order_date:d gmv_mtd:m",
       "SELECT merchant_id, order_date, sum(total_gmv) OVER (PARTITION BY merchant_id, date_trunc('month', order_date) ORDER BY order_date) AS gmv_mtd FROM daily", DAILY_CTES)
def _(spark, root):
    return D.to_date_sum(_daily(spark, root), "month", "gmv_mtd")


@query("wn08_quarter_to_date", "merchant_id:i order_date:d gmv_qtd:m",
       "SELECT merchant_id, order_date, sum(total_gmv) OVER (PARTITION BY merchant_id, date_trunc('quarter', order_date) ORDER BY order_date) AS gmv_qtd FROM daily", DAILY_CTES)
def _(spark, root):
    return D.to_date_sum(_daily(spark, root), "quarter", "gmv_qtd")


MTIER_SQL = "CASE WHEN {0} >= 2000000 THEN 'platinum' WHEN {0} >= 500000 THEN 'gold' WHEN {0} >= 100000 THEN 'silver' ELSE 'bronze' END"
TIERS_CTE = """tiers AS (SELECT * FROM (VALUES ('platinum', 99.99, 10, 0.015), ('gold', 99.95, 5, 0.020), ('silver', 99.9, 2, 0.025), ('bronze', 99.5, 1, 0.029))
  AS t(tier, sla, rate_multiplier, take_rate))"""
TRAIL = f"""trail AS (SELECT merchant_id, sum(total_gmv) AS gmv_12m FROM daily WHERE order_date >= DATE '{ASOF}' - 365 GROUP BY 1)"""


@query("ag09_trailing_gmv_tier", "merchant_id:i gmv_12m:m calculated_tier:s",
       f"SELECT *, {MTIER_SQL.format('gmv_12m')} AS calculated_tier FROM trail", (*DAILY_CTES, TRAIL))
def _(spark, root):
    return D.trailing_gmv(_daily(spark, root), ASOF)


@query("jb13_merchant_tiers", "merchant_id:i gmv_12m:m calculated_tier:s sla:r rate_multiplier:i take_rate:r",
       f"SELECT r.*, t.* FROM (SELECT *, {MTIER_SQL.format('gmv_12m')} AS calculated_tier FROM trail) r JOIN tiers t ON calculated_tier = tier", (*DAILY_CTES, TRAIL, TIERS_CTE))
def _(spark, root):
    return marts.merchant_tiers(_daily(spark, root), M.tier_table(spark), ASOF)


@query("pr31_merchant_tier_bases", "merchant_id:i gmv_12m:m gmv_mtd:m tier_annual:s tier_monthly:s tier_mtd:s",
       f"""SELECT *, {MTIER_SQL.format('gmv_12m')} AS tier_annual, {MTIER_SQL.format('gmv_12m / 12.0')} AS tier_monthly, {MTIER_SQL.format('gmv_mtd')} AS tier_mtd FROM (
           SELECT merchant_id, sum(CASE WHEN order_date >= DATE '{ASOF}' - INTERVAL 12 MONTH THEN total_gmv ELSE 0 END) AS gmv_12m,
             sum(CASE WHEN order_date >= date_trunc('month', DATE '{ASOF}') THEN total_gmv ELSE 0 END) AS gmv_mtd FROM daily WHERE order_date <= DATE '{ASOF}' GROUP BY 1)""", DAILY_CTES)
def _(spark, root):
    return M.tier_variants(D.merchant_to_date(_daily(spark, root), ASOF))


@query("pr32_tier_attributes", "merchant_id:i merchant_name:s merchant_tier:s sla:r rate_multiplier:i take_rate:r",
       "SELECT m.*, t.sla, t.rate_multiplier, t.take_rate FROM merchants m JOIN tiers t ON merchant_tier = tier", (Q.MERCHANTS, TIERS_CTE))
def _(spark, root):
    return M.with_tier_attributes(E.merchants(spark, root), M.tier_table(spark))


@query("pr33_platform_fee", "merchant_id:i gmv:m platform_fee:r4",
       """SELECT merchant_id, gmv, CAST(gmv AS DOUBLE) * CAST(take_rate AS DOUBLE) AS platform_fee FROM (SELECT merchant_id, sum(total_gmv) AS gmv FROM daily GROUP BY 1)
          JOIN merchants USING (merchant_id) JOIN tiers ON merchant_tier = tier""", (*DAILY_CTES, Q.MERCHANTS, TIERS_CTE))
def _(spark, root):
    return M.platform_fees(_daily(spark, root), E.merchants(spark, root), M.tier_table(spark))


@query("pr34_tier_progress", "merchant_id:i tier:s next_tier:s gmv_to_next_tier:r4 progress_pct:r6",
       f"""SELECT merchant_id, {MTIER_SQL.format('g')} AS tier, next_tier, need - CAST(g AS DOUBLE) AS gmv_to_next_tier, CAST(g AS DOUBLE) / need * 100 AS progress_pct FROM (
           SELECT merchant_id, g, CASE WHEN g < 100000 THEN 'silver' WHEN g < 500000 THEN 'gold' WHEN g < 2000000 THEN 'platinum' END AS next_tier,
             CAST(CASE WHEN g < 100000 THEN 100000 WHEN g < 500000 THEN 500000 WHEN g < 2000000 THEN 2000000 END AS DOUBLE) AS need
           FROM (SELECT merchant_id, gmv_12m AS g FROM trail))""", (*DAILY_CTES, TRAIL))
def _(spark, root):
    return M.tier_progress(D.trailing_gmv(_daily(spark, root), ASOF))


@query("pr34_monthly_tier_progress", "merchant_id:i tier:s next_tier:s gmv_to_next_tier:r4 progress_pct:r6",
       f"""SELECT merchant_id, {MTIER_SQL.format('g')} AS tier, next_tier, need - CAST(g AS DOUBLE) AS gmv_to_next_tier, CAST(g AS DOUBLE) / need * 100 AS progress_pct FROM (
           SELECT merchant_id, g, CASE WHEN g < 100000 THEN 'silver' WHEN g < 500000 THEN 'gold' WHEN g < 2000000 THEN 'platinum' END AS next_tier,
             CAST(CASE WHEN g < 100000 THEN 100000 WHEN g < 500000 THEN 500000 WHEN g < 2000000 THEN 2000000 END AS DOUBLE) AS need
           FROM (SELECT merchant_id, sum(CASE WHEN order_date >= date_trunc('month', DATE '{ASOF}') THEN total_gmv ELSE 0 END) AS g FROM daily WHERE order_date <= DATE '{ASOF}' GROUP BY 1))""", DAILY_CTES)
def _(spark, root):
    return M.tier_progress(D.merchant_to_date(_daily(spark, root), ASOF), "gmv_mtd")


@query("wn10_tier_history", "merchant_id:i tier:s valid_from:d valid_to:d months:i",
       f"""SELECT merchant_id, tier, valid_from, lead(valid_from) OVER (PARTITION BY merchant_id ORDER BY valid_from) AS valid_to, months FROM (
           SELECT merchant_id, tier, run, min(month) AS valid_from, count(*) AS months FROM (
             SELECT *, sum(new) OVER (PARTITION BY merchant_id ORDER BY month) AS run FROM (
               SELECT *, CASE WHEN tier = lag(tier) OVER (PARTITION BY merchant_id ORDER BY month) THEN 0 ELSE 1 END AS new FROM (
                 SELECT merchant_id, month, {MTIER_SQL.format('gmv')} AS tier FROM (SELECT merchant_id, date_trunc('month', order_date) AS month, sum(total_gmv) AS gmv FROM daily GROUP BY 1, 2))))
           GROUP BY 1, 2, 3)""", DAILY_CTES)
def _(spark, root):
    return M.tier_history(M.monthly_gmv(_daily(spark, root)))


@query("ag27_merchant_to_date", "merchant_id:i gmv_mtd:m gmv_qtd:m gmv_ytd:m gmv_12m:m",
       """SELECT merchant_id, sum(CASE WHEN order_date >= DATE '2001-07-01' THEN total_gmv ELSE 0 END) AS gmv_mtd, sum(CASE WHEN order_date >= DATE '2001-07-01' THEN total_gmv ELSE 0 END) AS gmv_qtd,
          sum(CASE WHEN order_date >= DATE '2001-01-01' THEN total_gmv ELSE 0 END) AS gmv_ytd, sum(CASE WHEN order_date >= DATE '2000-07-20' THEN total_gmv ELSE 0 END) AS gmv_12m
          FROM daily WHERE order_date <= DATE '2001-07-20' GROUP BY 1""", DAILY_CTES)
def _(spark, root):
    return D.merchant_to_date(_daily(spark, root), "2001-07-20")


@query("ag28_merchant_rollup", "merchant_id:i total_customers:i total_orders:i total_products:i revenue_30d:m arpu_30d:r",
       """SELECT c.merchant_id, total_customers, total_orders, total_products, revenue_30d, CASE WHEN act > 0 THEN CAST(revenue_30d AS DOUBLE) / act ELSE 0 END AS arpu_30d
          FROM (SELECT merchant_id, count(*) AS total_customers FROM customers GROUP BY 1) c
          LEFT JOIN (SELECT merchant_id, count(*) AS total_orders, coalesce(sum(total_amount) FILTER (created_at >= DATE '2001-07-03' AND created_at < DATE '2001-08-03'), 0) AS revenue_30d,
            count(DISTINCT customer_id) FILTER (created_at >= DATE '2001-07-03' AND created_at < DATE '2001-08-03') AS act FROM ord GROUP BY 1) o USING (merchant_id)
          LEFT JOIN (SELECT merchant_id, count(DISTINCT product_id) AS total_products FROM items GROUP BY 1) p USING (merchant_id)""", (Q.CUSTOMERS, Q.ITEMS))
def _(spark, root):
    return M.rollup(E.customers(spark, root), _orders(spark, root), E.items(spark, root), ASOF)


@query("ag31_merchant_activity", "merchant_id:i idle_days:i activity_status:s",
       """SELECT merchant_id, idle_days, CASE WHEN status = 'suspended' THEN 'suspended' WHEN idle_days IS NULL OR idle_days >= 90 THEN 'churned' ELSE 'active' END AS activity_status
          FROM (SELECT m.merchant_id, m.status, date_diff('day', CAST(l AS DATE), DATE '2001-10-30') AS idle_days FROM merchants m
          LEFT JOIN (SELECT merchant_id, max(created_at) AS l FROM ord GROUP BY 1) USING (merchant_id))""", (Q.MERCHANTS, Q.ORDERS))
def _(spark, root):
    return M.activity_status(_orders(spark, root), E.merchants(spark, root), "2001-10-30")


@query("pr35_feature_flag", "merchant_id:i feature_live_view:b feature_beta:b",
       "SELECT merchant_id, CASE WHEN merchant_id % 3 = 0 THEN merchant_id % 2 = 0 ELSE false END AS feature_live_view, true AS feature_beta FROM merchants", (Q.MERCHANTS,))
def _(spark, root):
    flags = F.when(F.col("merchant_id") % 3 == 0, F.to_json(F.struct((F.col("merchant_id") % 2 == 0).alias("live_view")))).otherwise(F.lit("{}"))
    m = E.merchants(spark, root).withColumn("feature_flags", flags)
    return M.feature_flag(M.feature_flag(m, "live_view"), "beta", default=True)


# ------------------------------------------------------------------ SQL model chain

MFACT = f"""mfact AS (
  SELECT o.*, m.merchant_name, m.merchant_tier, m.industry AS merchant_industry, c.customer_tier, c.customer_segment, c.ltv AS customer_ltv, c.total_orders AS customer_total_orders,
    c.is_churned AS customer_is_churned, CAST(o.created_at AS DATE) AS order_date, date_trunc('week', o.created_at) AS order_week, date_trunc('month', o.created_at) AS order_month,
    hour(o.created_at) AS order_hour, dayofweek(o.created_at) AS order_day_of_week, coalesce(c.first_order_at = o.created_at, false) AS is_first_order, o.subtotal AS gmv,
    CASE WHEN order_status IN ('delivered','shipped') THEN 'fulfilled' WHEN order_status IN ('cancelled','refunded') THEN 'cancelled'
      WHEN order_status IN ('pending','confirmed','processing') THEN 'in_progress' ELSE 'other' END AS order_status_category,
    o.total_amount - coalesce(o.refund_amount, 0) AS net_revenue, {GROUPING} AS channel_grouping,
    CASE WHEN shipped_at IS NOT NULL THEN date_diff('hour', o.created_at, shipped_at) END AS hours_to_ship,
    CASE WHEN delivered_at IS NOT NULL THEN date_diff('hour', shipped_at, delivered_at) END AS hours_in_transit,
    CASE WHEN has_recommended_items THEN CAST(recommended_items_value AS DOUBLE) / CAST(nullif(subtotal, 0) AS DOUBLE) ELSE 0 END AS recommendation_revenue_share,
    paid_at IS NOT NULL AS is_paid, coupon_code IS NOT NULL AS has_coupon, refunded_at IS NOT NULL AS is_refunded
  FROM stg o LEFT JOIN mdim c USING (customer_id) LEFT JOIN merchants m ON o.merchant_id = m.merchant_id)"""
MFACT_CTES = (*MODEL_CTES, Q.MERCHANTS, MFACT)


def _mfact(spark, root):
    return marts.model_fact_orders(_staged(spark, root), _model_dim(spark, root), E.merchants(spark, root))


@query("jb08_model_fact_orders",
       "order_id:i order_date:d order_week:d order_month:d order_hour:i order_day_of_week:i merchant_id:i merchant_name:s merchant_tier:s merchant_industry:s customer_id:i "
       "customer_tier:s customer_segment:s customer_ltv:m customer_total_orders:i customer_is_churned:b is_first_order:b order_status:s order_status_category:s subtotal:m "
       "total_amount:m refund_amount:m net_revenue:m gmv:m currency:s item_count:i is_paid:b hours_to_ship:i hours_in_transit:i channel_grouping:s recommendation_revenue_share:r has_coupon:b is_refunded:b",
       "SELECT * FROM mfact", MFACT_CTES)
@query("jn12_orders_customers_merchants", "order_id:i merchant_name:s customer_tier:s customer_segment:s", "SELECT * FROM mfact", MFACT_CTES)
@query("pr12_model_time_dimensions", "order_id:i order_date:d order_week:d order_month:d order_hour:i order_day_of_week:i", "SELECT * FROM mfact", MFACT_CTES)
def _(spark, root):
    return _mfact(spark, root)


_GR = ", ".join(f"sum(CASE WHEN channel_grouping = '{g}' THEN gmv ELSE 0 END) AS gmv_{g.lower().replace(' ', '_')}" for g in D.GROUPINGS)
_MT = ", ".join(f"sum(CASE WHEN customer_tier = '{t}' THEN gmv ELSE 0 END) AS gmv_{t}_customers" for t in D.TIERS)
MDAILY = f"""mdaily AS (
  SELECT concat(merchant_id, '_', order_date) AS merchant_date_key, merchant_id, merchant_name, merchant_tier, order_date, sum(gmv) AS gmv, sum(net_revenue) AS net_revenue,
    sum(total_amount) AS gross_revenue, sum(refund_amount) AS refund_amount, sum(discount_amount) AS discount_amount, sum(shipping_amount) AS shipping_revenue,
    count(DISTINCT order_id) AS order_count, count(DISTINCT customer_id) AS unique_customers, count(DISTINCT CASE WHEN is_first_order THEN customer_id END) AS new_customers,
    sum(item_count) AS total_items, CAST(sum(item_count) AS DOUBLE) / count(item_count) AS avg_items_per_order, CAST(sum(total_amount) AS DOUBLE) / count(total_amount) AS average_order_value,
    sum(CASE WHEN has_recommended_items THEN 1 ELSE 0 END) AS orders_with_recommendations, sum(recommended_items_value) AS recommendation_attributed_revenue,
    CAST(sum(recommended_items_value) AS DOUBLE) / CAST(nullif(sum(gmv), 0) AS DOUBLE) AS recommendation_revenue_share, {_GR}, {_MT},
    sum(CASE WHEN has_coupon THEN 1 ELSE 0 END) AS orders_with_coupon, sum(CASE WHEN has_coupon THEN discount_amount ELSE 0 END) AS coupon_discount_total,
    CAST(sum(hours_to_ship) AS DOUBLE) / nullif(count(hours_to_ship), 0) AS avg_hours_to_ship
  FROM mfact WHERE order_status_category <> 'cancelled' GROUP BY 2, 3, 4, 5),
mdaily_cmp AS (
  SELECT *, CASE WHEN gmv_prev_day > 0 THEN (CAST(gmv AS DOUBLE) - CAST(gmv_prev_day AS DOUBLE)) / CAST(gmv_prev_day AS DOUBLE) * 100 END AS gmv_change_vs_prev_day_pct,
    CASE WHEN gmv_same_day_last_week > 0 THEN (CAST(gmv AS DOUBLE) - CAST(gmv_same_day_last_week AS DOUBLE)) / CAST(gmv_same_day_last_week AS DOUBLE) * 100 END AS gmv_change_vs_last_week_pct
  FROM (SELECT *, lag(gmv, 1) OVER w AS gmv_prev_day, lag(gmv, 7) OVER w AS gmv_same_day_last_week, lag(gmv, 30) OVER w AS gmv_same_day_last_month,
    sum(gmv) OVER (PARTITION BY merchant_id ORDER BY order_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS gmv_rolling_7d,
    sum(gmv) OVER (PARTITION BY merchant_id ORDER BY order_date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS gmv_rolling_30d,
    sum(gmv) OVER (PARTITION BY merchant_id, date_trunc('month', order_date) ORDER BY order_date) AS gmv_mtd
    FROM mdaily WINDOW w AS (PARTITION BY merchant_id ORDER BY order_date)))"""
MD_SPEC = ("merchant_date_key:s merchant_id:i merchant_name:s merchant_tier:s order_date:d gmv:m net_revenue:m gross_revenue:m refund_amount:m discount_amount:m shipping_revenue:m "
           "order_count:i unique_customers:i new_customers:i total_items:i avg_items_per_order:r average_order_value:r orders_with_recommendations:i recommendation_attributed_revenue:m "
           "recommendation_revenue_share:r " + " ".join(f"gmv_{g.lower().replace(' ', '_')}:m" for g in D.GROUPINGS) + " " + " ".join(f"gmv_{t}_customers:m" for t in D.TIERS)
           + " orders_with_coupon:i coupon_discount_total:m avg_hours_to_ship:r")


@query("ag06_model_daily_gmv", MD_SPEC, "SELECT * FROM mdaily", (*MFACT_CTES, MDAILY))
def _(spark, root):
    return D.model_daily_gmv(_mfact(spark, root).filter(F.col("order_status_category") != "cancelled"))


@query("jb10_model_agg_daily_gmv", MD_SPEC + " gmv_prev_day:m gmv_same_day_last_week:m gmv_same_day_last_month:m gmv_rolling_7d:m gmv_rolling_30d:m gmv_mtd:m gmv_change_vs_prev_day_pct:r gmv_change_vs_last_week_pct:r",
       "SELECT * FROM mdaily_cmp", (*MFACT_CTES, MDAILY))
def _(spark, root):
    return marts.model_daily_gmv(_mfact(spark, root))


# ------------------------------------------------------------------ products

SALES = """sales AS (
  SELECT merchant_id, product_id, sum(total_amount) AS total_revenue, sum(quantity) AS total_units_sold, count(DISTINCT order_id) AS order_count,
    CAST(sum(unit_price) AS DOUBLE) / count(unit_price) AS avg_selling_price, CAST(sum(quantity) AS DOUBLE) / count(*) AS avg_quantity_per_order,
    sum(discount_amount) AS total_discounts, max(created_at) AS last_sold_at FROM items{where} GROUP BY 1, 2)"""
FUNNEL = """pev AS (SELECT *, CAST(json_extract(properties, '$.k') AS BIGINT) AS product_id FROM ev{where}),
funnel0 AS (
  SELECT merchant_id, product_id, count(*) FILTER (event_type = 'product_view') AS view_count, count(*) FILTER (event_type = 'add_to_cart') AS cart_add_count,
    0 AS checkout_count, count(*) FILTER (event_type = 'purchase') AS purchase_count
  FROM pev WHERE event_type IN ('product_view','add_to_cart','purchase') GROUP BY 1, 2),
funnel AS (
  SELECT *, CASE WHEN view_count > 0 THEN CAST(cart_add_count AS DOUBLE) / view_count ELSE 0 END AS view_to_cart_rate,
    CASE WHEN cart_add_count > 0 THEN CAST(checkout_count AS DOUBLE) / cart_add_count ELSE 0 END AS cart_to_checkout_rate,
    CASE WHEN checkout_count > 0 THEN CAST(purchase_count AS DOUBLE) / checkout_count ELSE 0 END AS checkout_to_purchase_rate,
    CASE WHEN view_count > 0 THEN CAST(purchase_count AS DOUBLE) / view_count ELSE 0 END AS overall_conversion_rate FROM funnel0)"""
SALES_ALL, FUNNEL_ALL = SALES.format(where=""), FUNNEL.format(where="")
SALES_SPEC = "merchant_id:i product_id:i total_revenue:m total_units_sold:i order_count:i avg_selling_price:r avg_quantity_per_order:r total_discounts:m last_sold_at:t"
FUNNEL_SPEC = "view_count:i cart_add_count:i checkout_count:i purchase_count:i view_to_cart_rate:r cart_to_checkout_rate:r checkout_to_purchase_rate:r overall_conversion_rate:r"


@query("ag10_product_sales", SALES_SPEC, "SELECT * FROM sales", (Q.ITEMS, SALES_ALL))
def _(spark, root):
    return P.sales(E.items(spark, root))


@query("ag11_product_funnel", "merchant_id:i product_id:i " + FUNNEL_SPEC, "SELECT * FROM funnel", (Q.EVENTS, FUNNEL_ALL))
def _(spark, root):
    return P.funnel(P.product_events(E.events(spark, root), "$.k"))


@query("ag12_product_events", "event_id:i event_type:s product_id:i",
       "SELECT event_id, event_type, product_id FROM pev WHERE event_type IN ('product_view','add_to_cart','purchase')", (Q.EVENTS, FUNNEL_ALL))
def _(spark, root):
    return P.product_events(E.raw_events(spark, root), "$.k")


@query("jn06_sales_full_outer_funnel", SALES_SPEC + " " + FUNNEL_SPEC, "SELECT * FROM sales FULL JOIN funnel USING (merchant_id, product_id)", (Q.ITEMS, SALES_ALL, Q.EVENTS, FUNNEL_ALL))
def _(spark, root):
    return P.sales_and_funnel(P.sales(E.items(spark, root)), P.funnel(P.product_events(E.events(spark, root), "$.k")))


STOCK = """stock AS (
  SELECT s.*, p.* EXCLUDE (product_id), CASE WHEN days_of_stock < 7 THEN 'critical' WHEN days_of_stock < 14 THEN 'high' WHEN days_of_stock < 30 THEN 'medium' ELSE 'low' END AS stockout_risk,
    CASE WHEN p.price > 0 THEN CAST(p.price - coalesce(p.cost, 0) AS DOUBLE) / CAST(p.price AS DOUBLE) ELSE 0 END AS margin
  FROM (SELECT x.*, CASE WHEN avg_daily_units > 0 THEN q.inventory_quantity / avg_daily_units ELSE 999 END AS days_of_stock
        FROM (SELECT *, total_units_sold / 30.0::DOUBLE AS avg_daily_units FROM {base}) x LEFT JOIN products q USING (product_id)) s
  LEFT JOIN products p USING (product_id))"""


@query("ag13_inventory_metrics", "merchant_id:i product_id:i total_units_sold:i avg_daily_units:r inventory_quantity:i days_of_stock:r stockout_risk:s margin:r",
       "SELECT * FROM stock", (Q.ITEMS, Q.PRODUCTS, SALES_ALL, STOCK.format(base="sales")))
@query("jn07_sales_inventory_attributes", "merchant_id:i product_id:i product_name:s sku:s price:m inventory_quantity:i",
       "SELECT * FROM stock", (Q.ITEMS, Q.PRODUCTS, SALES_ALL, STOCK.format(base="sales")))
def _(spark, root):
    return P.with_stock(P.sales(E.items(spark, root)), E.products(spark, root), 30, ("product_id",))


PASOF = "2001-08-01"
PERF = """perf AS (
  SELECT *, dense_rank() OVER (PARTITION BY merchant_id ORDER BY total_revenue DESC NULLS LAST) AS revenue_rank,
    dense_rank() OVER (PARTITION BY merchant_id ORDER BY total_units_sold DESC NULLS LAST) AS units_rank,
    dense_rank() OVER (PARTITION BY merchant_id ORDER BY overall_conversion_rate DESC NULLS LAST) AS conversion_rank,
    dense_rank() OVER (PARTITION BY merchant_id ORDER BY avg_daily_units DESC NULLS LAST) AS velocity_rank FROM stock)"""
PERF_CTES = (Q.ITEMS, Q.EVENTS, Q.PRODUCTS, SALES.format(where=f" WHERE created_at >= DATE '{PASOF}' - 365"), FUNNEL.format(where=" WHERE ts >= DATE '2024-02-01' - 365"),
             "combined AS (SELECT * FROM sales FULL JOIN funnel USING (merchant_id, product_id))",
             STOCK.replace("30.0", "365.0").format(base="combined"), PERF)
PERF_SQL = "SELECT *, CASE WHEN revenue_rank <= 10 THEN 'top_10' WHEN revenue_rank <= 50 THEN 'top_50' WHEN revenue_rank <= 100 THEN 'top_100' ELSE 'long_tail' END AS performance_tier FROM perf"


@query("jb04_agg_product_performance", SALES_SPEC + " " + FUNNEL_SPEC + " avg_daily_units:r days_of_stock:r stockout_risk:s margin:r product_name:s sku:s category_path:s product_type:s status:s "
       "revenue_rank:i units_rank:i conversion_rank:i velocity_rank:i performance_tier:s", PERF_SQL, PERF_CTES)
@query("wn09_product_rankings", "merchant_id:i product_id:i revenue_rank:i units_rank:i conversion_rank:i velocity_rank:i performance_tier:s", PERF_SQL, PERF_CTES)
@query("io11_lookback_sales", "merchant_id:i product_id:i total_revenue:m total_units_sold:i", PERF_SQL, PERF_CTES)
def _(spark, root):
    return marts.agg_product_performance(E.items(spark, root), E.events(spark, root), E.products(spark, root), PASOF, 365,
                                         events_asof="2024-02-01", path="$.k", keys=("product_id",))


@query("pr36_product_price", "product_id:i current_price:m is_on_sale:b discount_percentage:i",
       """SELECT product_id, coalesce(nullif(sale_price, 0), price) AS current_price, coalesce(sale_price < price, false) AS is_on_sale,
          CASE WHEN sale_price < price THEN floor(100 * (price - sale_price) / price) END AS discount_percentage FROM products""", (Q.PRODUCTS,))
def _(spark, root):
    return E.products(spark, root).withColumns(P.price_columns())


@query("pr37_product_stock", "product_id:i available_quantity:i is_in_stock:b is_low_stock:b",
       """SELECT product_id, greatest(inventory_quantity, 0) AS available_quantity, inventory_policy = 'continue' OR coalesce(inventory_quantity > 0, false) AS is_in_stock,
          greatest(inventory_quantity, 0) <= low_stock_threshold AS is_low_stock FROM products""", (Q.PRODUCTS,))
def _(spark, root):
    return E.products(spark, root).withColumns(P.stock_columns())


@query("pr38_product_margin", "product_id:i margin_pct:r6",
       "SELECT product_id, CASE WHEN cost > 0 THEN CAST(c - cost AS DOUBLE) / CAST(c AS DOUBLE) * 100 END AS margin_pct FROM (SELECT *, coalesce(nullif(sale_price, 0), price) AS c FROM products)", (Q.PRODUCTS,))
def _(spark, root):
    return E.products(spark, root).withColumns(P.price_columns()).withColumn("margin_pct", P.margin_pct(F.col("current_price")))


@query("tk03_top_products", "merchant_id:i product_id:i revenue:m units:i rank:i",
       """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY revenue DESC, product_id) AS rank FROM (
          SELECT merchant_id, product_id, sum(total_amount) AS revenue, sum(quantity) AS units FROM items GROUP BY 1, 2)) WHERE rank <= 10""", (Q.ITEMS,))
def _(spark, root):
    return P.top_products(E.items(spark, root), 10)


POP = """pop0 AS (SELECT merchant_id, product_id, sum(quantity) AS units FROM items GROUP BY 1, 2),
pop AS (SELECT *, CAST(units AS DOUBLE) / max(units) OVER (PARTITION BY merchant_id) AS score FROM pop0)"""


@query("rc15_popularity_scores", "merchant_id:i product_id:i units:i score:r", "SELECT * FROM pop", (Q.ITEMS, POP))
def _(spark, root):
    return P.popularity(E.items(spark, root))


@query("tk05_popular_products", "merchant_id:i product_id:i score:r rank:i",
       "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY score DESC, product_id) AS rank FROM pop) WHERE rank <= 10", (Q.ITEMS, POP))
def _(spark, root):
    return P.popular_products(P.popularity(E.items(spark, root)), 10)


@query("ag29_product_rollup", "merchant_id:i product_id:i view_count:i order_count:i revenue:m conversion_rate:r",
       """SELECT merchant_id, product_id, coalesce(view_count, 0) AS view_count, coalesce(order_count, 0) AS order_count, coalesce(revenue, 0) AS revenue,
          CASE WHEN view_count > 0 THEN round(CAST(coalesce(order_count, 0) AS DOUBLE) / view_count, 4) ELSE 0 END AS conversion_rate
          FROM (SELECT merchant_id, product_id, count(DISTINCT order_id) AS order_count, sum(total_amount) AS revenue FROM items GROUP BY 1, 2)
          FULL JOIN (SELECT merchant_id, product_id, count(*) AS view_count FROM pev WHERE event_type = 'product_view' GROUP BY 1, 2) USING (merchant_id, product_id)""",
       (Q.ITEMS, Q.EVENTS, FUNNEL_ALL))
def _(spark, root):
    return P.rollup(E.items(spark, root), P.product_events(E.events(spark, root), "$.k"))


@query("ag30_category_rollup", "path:s depth:i product_count:i active_products:i",
       """SELECT path, depth, count(*) AS product_count, count(*) FILTER (status = 'active') AS active_products FROM (
          SELECT product_type AS path, 1 AS depth, status FROM products UNION ALL SELECT category_path, 2, status FROM products) GROUP BY 1, 2""", (Q.PRODUCTS,))
def _(spark, root):
    return P.category_rollup(E.products(spark, root))


@query("rc25_item_features", "product_id:i category:s brand:s price:m units:i popularity:r",
       """SELECT product_id, product_type AS category, brand, price, coalesce(u, 0) AS units, coalesce(s, 0) AS popularity FROM products
          LEFT JOIN (SELECT product_id, sum(units) AS u, max(score) AS s FROM pop GROUP BY 1) USING (product_id)""", (Q.ITEMS, POP, Q.PRODUCTS))
def _(spark, root):
    return P.item_features(E.products(spark, root), P.popularity(E.items(spark, root)))


@query("rc24_user_features", "customer_id:i total_orders:i avg_order_value:r days_since_last_order:i favourite_category:s segment:s",
       f"""SELECT *, {SEGMENT_SQL} AS segment FROM (SELECT *, {RECENCY_SQL.format('days_since_last_order')} AS recency_score,
            CASE WHEN total_orders >= 10 THEN 5 WHEN total_orders >= 5 THEN 4 WHEN total_orders >= 3 THEN 3 WHEN total_orders >= 2 THEN 2 ELSE 1 END AS frequency_score,
            CASE WHEN ltv >= 1000 THEN 5 WHEN ltv >= 500 THEN 4 WHEN ltv >= 200 THEN 3 WHEN ltv >= 50 THEN 2 ELSE 1 END AS monetary_score FROM (
          SELECT customer_id, count(*) AS total_orders, sum(total_amount) AS ltv, CAST(sum(total_amount) AS DOUBLE) / count(*) AS avg_order_value,
            date_diff('day', CAST(max(created_at) AS DATE), DATE '{ASOF}') AS days_since_last_order FROM ord WHERE status <> 'cancelled' GROUP BY 1)
          LEFT JOIN (SELECT customer_id, product_type AS favourite_category FROM (SELECT customer_id, product_type, row_number() OVER (PARTITION BY customer_id ORDER BY sum(quantity) DESC, product_type DESC) AS rn
            FROM items JOIN products USING (product_id) GROUP BY 1, 2) WHERE rn = 1) USING (customer_id))""", (Q.ITEMS, Q.PRODUCTS))
def _(spark, root):
    return C.features(E.items(spark, root), E.products(spark, root), O.without_status(_orders(spark, root), "cancelled"), ASOF)


# ------------------------------------------------------------------ subscriptions

MRR = """mrr AS (
  SELECT *, CAST(CASE frequency WHEN 'weekly' THEN 4.33 WHEN 'biweekly' THEN 2.17 WHEN 'monthly' THEN 1 WHEN 'bimonthly' THEN 0.5 WHEN 'quarterly' THEN 0.33
    WHEN 'annually' THEN 0.083 ELSE 1 END AS DECIMAL(6,3)) AS monthly_multiplier FROM subs),
mrr1 AS (SELECT *, estimated_total * monthly_multiplier AS subscription_mrr FROM mrr),
mm AS (
  SELECT merchant_id, sum(subscription_mrr) AS total_mrr, count(*) AS active_subscriptions, CAST(sum(subscription_mrr) AS DOUBLE) / count(*) AS avg_subscription_mrr,
    count(DISTINCT customer_id) AS unique_subscribers, sum(subscription_mrr) * 12 AS total_arr FROM mrr1 WHERE status = 'active' GROUP BY 1)"""
CHURN = f"""ch AS (
  SELECT merchant_id, count(*) AS churned_subscriptions, sum(subscription_mrr) AS churned_mrr,
    {", ".join(f"nullif(count(*) FILTER (coalesce(cancellation_reason, 'unspecified') = '{r}'), 0) AS {r}" for r in SUB.REASONS)}
  FROM mrr1 WHERE status = 'cancelled' AND cancelled_at >= DATE '{ASOF}' - 365 AND cancelled_at < DATE '{ASOF}' + 1 GROUP BY 1)"""
SLTV = """sl AS (
  SELECT merchant_id, is_subscriber, CAST(sum(ltv) AS DOUBLE) / count(*) AS avg_ltv, CAST(sum(n) AS DOUBLE) / count(*) AS avg_orders, count(*) AS customer_count FROM (
    SELECT merchant_id, customer_id, sum(total_amount) AS ltv, count(*) AS n,
      (merchant_id, customer_id) IN (SELECT (merchant_id, customer_id) FROM subs) AS is_subscriber
    FROM ord WHERE status IN ('delivered','shipped','confirmed') GROUP BY 1, 2) GROUP BY 1, 2)"""
SUB_CTES = (Q.SUBSCRIPTIONS, MRR, CHURN, SLTV)


@query("ag14_subscription_mrr", "subscription_id:i frequency:s status:s monthly_multiplier:r subscription_mrr:m", "SELECT * FROM mrr1", SUB_CTES)
def _(spark, root):
    return SUB.with_mrr(E.subscriptions(spark, root))


@query("ag15_merchant_mrr", "merchant_id:i total_mrr:m active_subscriptions:i avg_subscription_mrr:r unique_subscribers:i total_arr:m", "SELECT * FROM mm", SUB_CTES)
def _(spark, root):
    return SUB.merchant_mrr(SUB.with_mrr(E.subscriptions(spark, root)))


@query("ag16_churn_totals", "merchant_id:i churned_subscriptions:i churned_mrr:m", "SELECT * FROM ch", SUB_CTES)
@query("ag17_churn_reasons", "merchant_id:i " + " ".join(f"{r}:i" for r in SUB.REASONS), "SELECT * FROM ch", SUB_CTES)
@query("jn09_churn_with_reasons", "merchant_id:i churned_subscriptions:i " + " ".join(f"{r}:i" for r in SUB.REASONS), "SELECT * FROM ch", SUB_CTES)
def _(spark, root):
    return SUB.churn(SUB.with_mrr(E.subscriptions(spark, root)), ASOF, 365)


@query("ag18_subscriber_ltv", "merchant_id:i is_subscriber:b avg_ltv:r avg_orders:r customer_count:i", "SELECT * FROM sl", SUB_CTES)
@query("jn10_subscriber_existence", "merchant_id:i is_subscriber:b customer_count:i", "SELECT * FROM sl", SUB_CTES)
def _(spark, root):
    return SUB.subscriber_ltv(E.subscriptions(spark, root), _orders(spark, root))


@query("ag26_distinct_subscribers", "merchant_id:i customer_id:i", "SELECT DISTINCT merchant_id, customer_id FROM subs", SUB_CTES)
def _(spark, root):
    return E.subscriptions(spark, root).select("merchant_id", "customer_id").distinct()


JB05 = """SELECT *, CASE WHEN non_subscriber_avg_ltv > 0 THEN (subscriber_avg_ltv - non_subscriber_avg_ltv) / non_subscriber_avg_ltv * 100 ELSE 0 END AS subscriber_ltv_lift,
  CAST(coalesce(churned_subscriptions, 0) AS DOUBLE) / (active_subscriptions + coalesce(churned_subscriptions, 0)) AS churn_rate
  FROM mm LEFT JOIN ch USING (merchant_id)
  LEFT JOIN (SELECT merchant_id, avg_ltv AS subscriber_avg_ltv, avg_orders AS subscriber_avg_orders, customer_count AS subscriber_count FROM sl WHERE is_subscriber) USING (merchant_id)
  LEFT JOIN (SELECT merchant_id, avg_ltv AS non_subscriber_avg_ltv, avg_orders AS non_subscriber_avg_orders FROM sl WHERE NOT is_subscriber) USING (merchant_id)"""


@query("jb05_agg_subscription_metrics",
       "merchant_id:i total_mrr:m total_arr:m active_subscriptions:i avg_subscription_mrr:r unique_subscribers:i churned_subscriptions:i churned_mrr:m "
       + " ".join(f"{r}:i" for r in SUB.REASONS) + " subscriber_avg_ltv:r subscriber_avg_orders:r subscriber_count:i non_subscriber_avg_ltv:r non_subscriber_avg_orders:r subscriber_ltv_lift:r churn_rate:r",
       JB05, SUB_CTES)
@query("ag19_ltv_lift_churn_rate", "merchant_id:i subscriber_ltv_lift:r churn_rate:r", JB05, SUB_CTES)
@query("jn08_subscription_joins", "merchant_id:i total_mrr:m churned_subscriptions:i subscriber_avg_ltv:r non_subscriber_avg_ltv:r", JB05, SUB_CTES)
def _(spark, root):
    return marts.agg_subscription_metrics(E.subscriptions(spark, root), _orders(spark, root), ASOF, 365)


@query("ag20_subscription_cohorts", "merchant_id:i cohort_month:d cohort_size:i still_active:i avg_orders_per_sub:r cohort_revenue:m retention_rate:r",
       """SELECT merchant_id, date_trunc('month', started_at) AS cohort_month, count(*) AS cohort_size, count(*) FILTER (status = 'active') AS still_active,
          CAST(sum(total_orders_generated) AS DOUBLE) / count(*) AS avg_orders_per_sub, sum(total_revenue) AS cohort_revenue,
          CAST(count(*) FILTER (status = 'active') AS DOUBLE) / count(*) AS retention_rate FROM subs GROUP BY 1, 2""", SUB_CTES)
def _(spark, root):
    return SUB.cohorts(E.subscriptions(spark, root))


_RET = ", ".join(
    f"count(*) FILTER (r{k}) AS reached_{k}m, count(*) FILTER (r{k} AND (cancelled_at IS NULL OR CAST(cancelled_at AS DATE) >= s + INTERVAL {k} MONTH)) AS kept_{k}m" for k in (1, 3, 6, 12))


@query("ag20_cohort_retention", "merchant_id:i cohort_month:d " + " ".join(f"reached_{k}m:i kept_{k}m:i retention_{k}m:r" for k in (1, 3, 6, 12)),
       f"""SELECT *, {", ".join(f"CAST(kept_{k}m AS DOUBLE) / nullif(reached_{k}m, 0) AS retention_{k}m" for k in (1, 3, 6, 12))} FROM (
           SELECT merchant_id, date_trunc('month', s) AS cohort_month, {_RET} FROM (
             SELECT *, {", ".join(f"s + INTERVAL {k} MONTH <= DATE '{ASOF}' AS r{k}" for k in (1, 3, 6, 12))} FROM (SELECT *, CAST(started_at AS DATE) AS s FROM subs)) GROUP BY 1, 2)""", SUB_CTES)
def _(spark, root):
    return SUB.cohort_retention(E.subscriptions(spark, root), ASOF)


@query("sb02_subscription_status", "merchant_id:i status:s subscriptions:i value:m retrying:i",
       """SELECT merchant_id, status, count(*) AS subscriptions, sum(estimated_total) AS value, count(*) FILTER (status = 'payment_failed' AND retry_count > 0) AS retrying
          FROM subs GROUP BY 1, 2""", SUB_CTES)
def _(spark, root):
    return SUB.status_rollup(E.subscriptions(spark, root))


@query("sb01_next_billing", "subscription_id:i frequency:s next_billing_date:d",
       f"""WITH RECURSIVE live AS (SELECT subscription_id, frequency, CAST(started_at AS DATE) AS s, interval_count AS k FROM subs WHERE status IN ('active','payment_failed')),
           step AS (SELECT *, CASE frequency WHEN 'weekly' THEN to_days(CAST(7 * k AS INTEGER)) WHEN 'biweekly' THEN to_days(CAST(14 * k AS INTEGER)) WHEN 'bimonthly' THEN to_months(CAST(2 * k AS INTEGER))
             WHEN 'quarterly' THEN to_months(CAST(3 * k AS INTEGER)) WHEN 'annually' THEN to_months(CAST(12 * k AS INTEGER)) ELSE to_months(CAST(k AS INTEGER)) END AS unit FROM live),
           grid AS (SELECT subscription_id, frequency, CAST(s + unit * n AS DATE) AS due FROM step, generate_series(1, 400) AS g(n))
           SELECT subscription_id, frequency, min(due) AS next_billing_date FROM grid WHERE due > DATE '{ASOF}' GROUP BY 1, 2""", SUB_CTES)
def _(spark, root):
    return SUB.next_billing(E.subscriptions(spark, root), ASOF)


@query("sb03_subscription_items", "subscription_id:i product_id:i quantity:i price:m",
       "SELECT subscription_id, product_id, quantity, unit_price AS price FROM subs JOIN items ON subscription_id = order_id", (Q.ITEMS, "subs AS (SELECT order_id AS subscription_id FROM ord WHERE order_id % 10 = 0)"))
def _(spark, root):
    line = F.struct("product_id", "quantity", F.col("unit_price").alias("price"))
    lines = E.raw_items(spark, root).filter(F.col("order_id") % 10 == 0).select(
        F.col("order_id").alias("subscription_id"), F.to_json(F.array(line)).alias("items"))
    return SUB.explode_items(lines)
