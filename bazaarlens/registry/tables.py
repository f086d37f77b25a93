"""Checked queries over generic transforms, table checks, loads and promotions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import promotions as PM
from ..operators import quality as DQ
from ..operators import records as R
from ..sources import connectors as CX
from ..sources import entities as E
from ..session import scratch
from ..sources import warehouse as WH
from . import commerce as CM
from . import sql_entities as Q
from .core import query


# ------------------------------------------------------------------ generic transforms

@query("pr01_rename_columns", "key:i label:s c_acctbal:r", "SELECT c_custkey AS key, c_name AS label, c_acctbal FROM customer")
def _(spark, root):
    return R.map_columns(E.table(spark, root, "customer"), {"c_custkey": "key", "c_name": "label"})


@query("pr02_cast_columns", "event_id:i type_as_int:i type_cast_error:b k:i k_cast_error:b",
       """SELECT event_id, TRY_CAST(event_type AS BIGINT) AS type_as_int, true AS type_cast_error, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, false AS k_cast_error FROM events""")
def _(spark, root):
    e = E.table(spark, root, "events").select("event_id", F.col("event_type").alias("t"), F.get_json_object("props", "$.k").alias("k"))
    return R.cast_columns(e, {"t": "int", "k": "int", "absent": "int"}).withColumnsRenamed({"t": "type_as_int", "t_cast_error": "type_cast_error"})


@query("pr03_filter_rows", "order_id:i total_amount:m", "SELECT order_id, total_amount FROM ord WHERE status = 'delivered' AND total_amount > 400000", (Q.ORDERS,))
def _(spark, root):
    return R.keep_where(E.raw_orders(spark, root), (F.col("status") == "delivered") & (F.col("total_amount") > 400000))


@query("pr10_record_gmv", "order_id:i gmv:m other:m", "SELECT order_id, subtotal AS gmv, 0 AS other FROM ord", (Q.ORDERS,))
def _(spark, root):
    return R.gmv_column(R.gmv_column(E.raw_orders(spark, root)), "no_such_column", "other")


@query("ag24_generic_group_by", "status:s revenue:m refunds:m n:i avg_refund:r first_refund:m biggest:m",
       """SELECT status, sum(total_amount) AS revenue, coalesce(sum(refund_amount), 0) AS refunds, count(order_id) AS n,
          coalesce(CAST(sum(refund_amount) AS DOUBLE) / nullif(count(refund_amount), 0), 0) AS avg_refund, min(refund_amount) AS first_refund, max(total_amount) AS biggest FROM ord GROUP BY 1""", (Q.ORDERS,))
def _(spark, root):
    return R.aggregate(E.raw_orders(spark, root), ["status"], {
        "revenue": ("total_amount", "sum"), "refunds": ("refund_amount", "sum"), "n": ("order_id", "count"), "avg_refund": ("refund_amount", "mean"),
        "first_refund": ("refund_amount", "min"), "biggest": ("total_amount", "max")})


@query("ag25_deduplicate_last", "customer_id:i order_id:i created_at:t",
       "SELECT customer_id, order_id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, order_id DESC) AS rn FROM ord) WHERE rn = 1", (Q.ORDERS,))
def _(spark, root):
    return R.deduplicate(E.raw_orders(spark, root), ["customer_id"], ["created_at", "order_id"], "last")


@query("wn15_latest_row_per_key", "customer_id:i channel:s order_id:i",
       "SELECT customer_id, channel, order_id FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, channel ORDER BY updated_at DESC, order_id DESC) AS rn FROM ord) WHERE rn = 1", (Q.ORDERS,))
def _(spark, root):
    return WH.latest(E.raw_orders(spark, root), ["customer_id", "channel"], ["updated_at", "order_id"])


@query("jn15_lookup_with_default", "order_id:i industry:s",
       """SELECT order_id, CASE WHEN m.merchant_id IS NULL THEN 'none' ELSE m.industry END AS industry FROM ord o
          LEFT JOIN (SELECT merchant_id, nullif(industry, 'ASIA') AS industry FROM merchants WHERE merchant_id < 20) m USING (merchant_id)""", (Q.ORDERS, Q.MERCHANTS))
def _(spark, root):
    m = E.merchants(spark, root).filter("merchant_id < 20").withColumn("industry", F.nullif("industry", F.lit("ASIA")))
    return R.look_up(E.orders(spark, root), m, "merchant_id", "merchant_id", "industry", "industry", "none")


# ------------------------------------------------------------------ scans and loads

@query("io01_filtered_scan", "order_id:i total:r", "SELECT o_orderkey AS order_id, o_totalprice AS total FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' AND o_orderstatus = 'F'")
def _(spark, root):
    df = E.table(spark, root, "orders")
    return df.filter((F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")) & (F.col("o_orderstatus") == "F")).select(
        F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("total"))


MERGE = """upd AS (SELECT order_id, customer_id, 'archived' AS status FROM ord WHERE order_id % 7 = 0
  UNION ALL SELECT order_id + 100000000, customer_id, 'new' FROM ord WHERE order_id % 100 = 0)"""


@query("so03_merge_as_union", "order_id:i status:s",
       "SELECT order_id, status FROM ord WHERE order_id NOT IN (SELECT order_id FROM upd) UNION ALL SELECT order_id, status FROM upd", (Q.ORDERS, MERGE))
def _(spark, root):
    rows, changes = _versions(spark, root)
    return WH.merge_rows(rows, changes, ["order_id"], ["version"])


@query("io03_merge_upsert", "order_id:i customer_id:i status:s",
       "SELECT order_id, customer_id, status FROM ord WHERE order_id NOT IN (SELECT order_id FROM upd) UNION ALL SELECT * FROM upd", (Q.ORDERS, MERGE))
def _(spark, root):
    rows, changes = _versions(spark, root)
    wh = WH.Warehouse(spark, scratch(spark, "io03"))
    wh.write(rows, "orders", "overwrite")
    wh.merge(changes, "orders", ["order_id"], ["version"])
    return wh.read("orders")


def _versions(spark, root):
    o = E.raw_orders(spark, root).select("order_id", "customer_id", "status")
    upd = o.filter("order_id % 7 = 0").withColumn("status", F.lit("archived")).withColumn("version", F.lit(2))
    stale = o.filter("order_id % 14 = 0").withColumn("status", F.lit("stale")).withColumn("version", F.lit(1))
    new = o.filter("order_id % 100 = 0").select((F.col("order_id") + 100000000).alias("order_id"), "customer_id", F.lit("new").alias("status"), F.lit(1).alias("version"))
    return o.withColumn("version", F.lit(0)), upd.unionByName(stale).unionByName(new)


@query("io07_newer_than_watermark", "order_id:i updated_at:t",
       "SELECT order_id, updated_at FROM ord WHERE updated_at > (SELECT max(updated_at) FROM ord WHERE created_at < TIMESTAMP '2001-01-01')", (Q.ORDERS,))
@query("io08_incremental_model_predicate", "order_id:i updated_at:t",
       "SELECT order_id, updated_at FROM ord WHERE updated_at > (SELECT max(updated_at) FROM ord WHERE created_at < TIMESTAMP '2001-01-01')", (Q.ORDERS,))
def _(spark, root):
    o = E.raw_orders(spark, root)
    loaded = o.filter(F.col("created_at") < F.lit("2001-01-01").cast("timestamp_ntz")).agg(F.max("updated_at")).first()[0]
    return WH.newer_than(o, "updated_at", loaded)


@query("io09_three_day_lookback", "order_id:i created_at:t", "SELECT order_id, created_at FROM ord WHERE created_at >= DATE '2001-08-01' - 3", (Q.ORDERS,))
def _(spark, root):
    return WH.since_days(E.raw_orders(spark, root), "created_at", "2001-08-01", 3)


@query("io13_warehouse_query", "status:s n:i", "SELECT status, count(*) AS n FROM ord GROUP BY 1", (Q.ORDERS,))
def _(spark, root):
    return CX.from_query(spark, "SELECT status, count(*) AS n FROM {orders} GROUP BY status", {"orders": E.raw_orders(spark, root)})


@query("io14_file_extract", "n_nationkey:i n_name:s n_regionkey:i", "SELECT * FROM nation")
def _(spark, root):
    return CX.from_files(spark, f"{root}/nation.parquet", "parquet")


@query("io16_event_store_query", "event_type:s n:i value:m", "SELECT event_type, count(*) AS n, sum(value) AS value FROM ev GROUP BY 1", (Q.EVENTS,))
def _(spark, root):
    return CX.from_query(spark, "SELECT event_type, count(*) AS n, sum(value) AS value FROM {events} GROUP BY event_type", {"events": E.raw_events(spark, root)})


@query("io17_offset_limit", "order_id:i created_at:t", "SELECT order_id, created_at FROM ord ORDER BY created_at DESC, order_id LIMIT 100 OFFSET 50", (Q.ORDERS,))
def _(spark, root):
    return CX.slice_rows(E.raw_orders(spark, root), [F.desc("created_at"), F.asc("order_id")], 50, 100)


@query("io22_key_value_export", "key:s name:s expires_at:t",
       "SELECT 'merchant:' || merchant_id || ':row' AS key, merchant_name AS name, TIMESTAMP '2001-08-02 01:00:00' AS expires_at FROM merchants", (Q.MERCHANTS,))
def _(spark, root):
    kv = CX.key_values(E.merchants(spark, root), "merchant:{merchant_id}:row", "merchant_id", 3600, "2001-08-02")
    return kv.withColumn("name", F.get_json_object("value", "$.merchant_name"))


@query("io28_published_view", "tier:s customers:i", "SELECT tier, count(*) AS customers FROM dim GROUP BY 1", CM.DIM_CTES)
def _(spark, root):
    CX.publish(CM._dim(spark, root), "published_customers")
    return spark.sql("SELECT tier, count(*) AS customers FROM published_customers GROUP BY tier")


# ------------------------------------------------------------------ table checks

@query("dq01_required_columns", "table_rows:i missing:i extra:i", "SELECT count(*) AS table_rows, 1 AS missing, 5 AS extra FROM customer")
def _(spark, root):
    df = E.table(spark, root, "customer")
    diff = DQ.schema_diff(df, ["no_such_column"])
    return df.agg(F.count(F.lit(1)).alias("table_rows"), F.lit(len(diff["missing"])).alias("missing"), F.lit(len(diff["extra"])).alias("extra"))


@query("so04_contract_difference", "kind:s column_name:s rows:i",
       "SELECT kind, column_name, (SELECT count(*) FROM orders) AS rows FROM (VALUES ('missing','o_comment'), ('extra','o_orderdate'), ('extra','o_orderpriority')) AS t(kind, column_name)")
def _(spark, root):
    df = E.table(spark, root, "orders")
    diff = DQ.schema_diff(df, ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_comment"])
    rows = [(kind, c) for kind in ("missing", "extra") for c in diff[kind]]
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.lit(c).alias("column_name")) for k, c in rows])).alias("x")).select("rows", "x.*")


@query("dq02_null_counts", "column_name:s null_count:i",
       """SELECT unnest(['discount_amount','utm_source','coupon_code','order_id']) AS column_name, unnest([count(*) FILTER (discount_amount IS NULL), count(*) FILTER (utm_source IS NULL),
          count(*) FILTER (coupon_code IS NULL), count(*) FILTER (order_id IS NULL)]) AS null_count FROM ord""", (Q.ORDERS,))
def _(spark, root):
    return DQ.null_counts(E.raw_orders(spark, root), ["discount_amount", "utm_source", "coupon_code", "order_id"])


@query("dq03_empty_input", "has_rows:b n:i", "SELECT count(*) > 0 AS has_rows, count(*) AS n FROM ord WHERE subtotal > 1000000", (Q.ORDERS,))
def _(spark, root):
    df = E.raw_orders(spark, root).filter("subtotal > 1000000")
    return df.agg(F.lit(DQ.validate(df, ["order_id"])).alias("has_rows"), F.count(F.lit(1)).alias("n"))


@query("dq04_source_freshness", "latest:t age_hours:r6 is_stale:b",
       "SELECT max(updated_at) AS latest, CAST(epoch(TIMESTAMP '2001-08-02 01:30:00' - max(updated_at)) AS DOUBLE) / 3600 AS age_hours, max(updated_at) < TIMESTAMP '2001-08-01 23:30:00' AS is_stale FROM ord", (Q.ORDERS,))
def _(spark, root):
    return DQ.freshness(E.raw_orders(spark, root), "updated_at", "2001-08-02 01:30:00")


@query("dq05_training_gate", "interactions:i latest:t passes:b",
       "SELECT count(*) AS interactions, max(ts) AS latest, count(*) >= 100000 AS passes FROM events WHERE ts >= DATE '2024-01-31' - 20")
def _(spark, root):
    return DQ.training_gate(E.table(spark, root, "events"), "ts", "2024-01-31", days=20)


@query("dq06_format_checks", "rule:s violations:i",
       """SELECT unnest(['email','merchant_id']) AS rule, unnest([count(*) FILTER (NOT regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$')),
          count(*) FILTER (length('merch_' || left(lpad(CAST(customer_id % 1300 AS VARCHAR), CAST(greatest(3, length(CAST(customer_id % 1300 AS VARCHAR))) AS INTEGER), '0'), 3) || repeat('x', CAST(9 - customer_id % 2 AS INTEGER))) <> 18)]) AS violations FROM customers""", (Q.CUSTOMERS,))
def _(spark, root):
    c = E.customers(spark, root).withColumn("mid", F.concat(
        F.lit("merch_"), F.when(F.col("customer_id") % 1300 < 1000, F.lpad((F.col("customer_id") % 1300).cast("string"), 3, "0")).otherwise(
            F.left((F.col("customer_id") % 1300).cast("string"), F.lit(3))), F.repeat(F.lit("x"), (F.lit(9) - F.col("customer_id") % 2).cast("int"))))
    return DQ.rule_counts(c, {"email": DQ.email_ok("email"), "merchant_id": DQ.merchant_id_ok("mid")})


@query("dq07_duplicate_keys", "l_orderkey:i l_linenumber:i copies:i",
       "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, root):
    return DQ.duplicates(E.table(spark, root, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("dq08_domain_checks", "rule:s violations:i",
       """SELECT unnest(['frequency','status','interval']) AS rule, unnest([count(*) FILTER (frequency NOT IN ('weekly','biweekly','monthly','bimonthly','quarterly','annually')),
          count(*) FILTER (status NOT IN ('active','paused','cancelled')), count(*) FILTER (interval_count NOT BETWEEN 1 AND 2)]) AS violations FROM subs""", (Q.SUBSCRIPTIONS,))
def _(spark, root):
    return DQ.rule_counts(E.subscriptions(spark, root), {
        "frequency": DQ.one_of("frequency", "weekly", "biweekly", "monthly", "bimonthly", "quarterly", "annually"),
        "status": DQ.one_of("status", "active", "paused", "cancelled"), "interval": F.col("interval_count").between(1, 2)})


@query("dq09_total_reconciliation", "order_id:i subtotal_diff:m items_diff:i total_diff:m",
       """SELECT * FROM (SELECT order_id, o.subtotal - coalesce(l, 0) AS subtotal_diff, o.item_count - coalesce(q, 0) AS items_diff,
            o.total_amount - (o.subtotal + o.tax_amount + o.shipping_amount - coalesce(o.discount_amount, 0)) AS total_diff
          FROM ord o LEFT JOIN (SELECT order_id, sum(line_subtotal) AS l, sum(quantity) AS q FROM items GROUP BY 1) USING (order_id))
          WHERE subtotal_diff <> 0 OR items_diff <> 0 OR total_diff <> 0""", (Q.ITEMS,))
def _(spark, root):
    return DQ.reconcile_totals(E.raw_orders(spark, root), E.raw_items(spark, root))


@query("dq10_orphan_rows", "order_id:i product_id:i",
       "SELECT l_orderkey AS order_id, l_partkey AS product_id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def _(spark, root):
    parents = E.table(spark, root, "orders").filter("o_orderstatus <> 'P'")
    return DQ.orphans(E.raw_items(spark, root), parents, "order_id", "o_orderkey")


# ------------------------------------------------------------------ promotions

PROMO_SQL = """promo AS (
  SELECT 'p' || merchant_id || '_' || kind AS promotion_id, merchant_id AS promo_merchant, kind,
    CASE kind WHEN 0 THEN 'percentage' WHEN 1 THEN 'fixed_amount' WHEN 2 THEN 'free_shipping' WHEN 3 THEN 'buy_x_get_y' ELSE 'tiered' END AS discount_type,
    kind = 1 AND merchant_id % 2 = 0 AS is_exclusive, 10 - kind AS priority, CASE WHEN kind = 0 THEN 50 END AS total_usage_limit, CASE WHEN kind = 1 THEN 2 END AS per_customer_limit
  FROM merchants, generate_series(0, 4) AS g(kind)),
oty AS (SELECT order_id, list(DISTINCT product_type) AS order_product_types FROM items JOIN products USING (product_id) GROUP BY 1),
elig AS (
  SELECT f.order_id, f.customer_id, f.created_at, f.merchant_id, f.subtotal, f.shipping_amount, f.total_amount, f.ic AS item_count, p.* EXCLUDE (promo_merchant)
  FROM (SELECT f.*, o.item_count AS ic, coalesce(t.order_product_types, []) AS types FROM fact f JOIN ord o USING (order_id) LEFT JOIN oty t USING (order_id)) f JOIN promo p ON f.merchant_id = p.promo_merchant
  WHERE f.order_date >= DATE '1996-01-01' AND (kind <> 1 OR f.order_date <= DATE '1999-12-31') AND (kind <> 0 OR f.subtotal >= 100000) AND f.ic >= CASE WHEN kind = 3 THEN 3 ELSE 1 END
    AND (kind <> 0 OR f.channel IN ('web','ios_app')) AND (kind <> 1 OR list_has_any(types, ['ECONOMY','PROMO'])) AND (kind <> 4 OR NOT list_has_any(types, ['SMALL']))
    AND (kind <> 2 OR f.is_first_order) AND (kind <> 3 OR f.customer_tier IN ('platinum','gold'))),
disc AS (
  SELECT *, CAST(least(coalesce(CASE kind WHEN 0 THEN least(CAST(subtotal * CAST(0.10 AS DECIMAL(3,2)) AS DECIMAL(12,2)), 20000) WHEN 1 THEN 500 WHEN 2 THEN shipping_amount
      WHEN 3 THEN CAST(CAST(item_count // 3 AS DECIMAL(4,0)) * CAST(round(CAST(subtotal * 100 AS BIGINT) / item_count) / 100 AS DECIMAL(12,2)) * CAST(0.5 AS DECIMAL(2,1)) AS DECIMAL(12,2))
      ELSE CASE WHEN subtotal >= 300000 THEN 9000 WHEN subtotal >= 100000 THEN 2000 END END, 0), greatest(subtotal, shipping_amount)) AS DECIMAL(12,2)) AS discount FROM elig),
stk AS (SELECT * FROM (SELECT *, min(CASE WHEN is_exclusive THEN rk END) OVER (PARTITION BY order_id) AS best FROM (
  SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY priority DESC, promotion_id) AS rk FROM disc)) WHERE best IS NULL OR rk = best),
used AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY promotion_id ORDER BY created_at, order_id) AS use_number FROM (
  SELECT *, row_number() OVER (PARTITION BY promotion_id, customer_id ORDER BY created_at, order_id) AS customer_use FROM stk) WHERE per_customer_limit IS NULL OR customer_use <= per_customer_limit)
  WHERE total_usage_limit IS NULL OR use_number <= total_usage_limit)"""
PROMO_CTES = (*CM.FACT_CTES, Q.MERCHANTS, Q.PRODUCTS, PROMO_SQL)


def _promotions(spark, root):
    """Five promotions per merchant, one of each type."""
    k, text = F.col("kind"), "array<string>"
    date = lambda d: F.lit(d).cast("date")
    arr = lambda *v: F.array(*[F.lit(x) for x in v])
    m = E.merchants(spark, root).select("merchant_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("kind"))
    types = ("percentage", "fixed_amount", "free_shipping", "buy_x_get_y", "tiered")
    out = m.select(
        F.concat(F.lit("p"), F.col("merchant_id"), F.lit("_"), k).alias("promotion_id"), F.col("merchant_id").alias("promo_merchant"),
        F.element_at(arr(*types), k + 1).alias("discount_type"),
        F.when(k == 0, F.lit("10")).when(k == 1, F.lit("500")).otherwise("0").cast("decimal(10,2)").alias("discount_value"),
        F.when(k == 0, F.lit(20000)).cast("decimal(10,2)").alias("max_discount_amount"), F.when(k == 3, 2).alias("buy_quantity"), F.when(k == 3, 1).alias("get_quantity"),
        F.lit(50).cast("decimal(5,2)").alias("get_discount_percent"),
        F.when(k == 4, F.lit('[{"min":100000,"discount":2000},{"min":300000,"discount":9000}]')).alias("tier_config"),
        F.when(k == 0, F.lit(100000)).cast("decimal(10,2)").alias("minimum_order_value"), F.when(k == 3, 3).otherwise(1).alias("minimum_quantity"),
        F.when(k == 1, arr("ECONOMY", "PROMO")).alias("applicable_product_types"), F.when(k == 4, arr("SMALL")).alias("excluded_product_types"),
        F.when(k == 3, arr("platinum", "gold")).otherwise(F.array().cast(text)).alias("applicable_customer_tiers"), (k == 2).alias("first_order_only"),
        F.when(k == 0, 50).alias("total_usage_limit"), F.when(k == 1, 2).alias("per_customer_limit"), ((k == 1) & (F.col("merchant_id") % 2 == 0)).alias("is_exclusive"),
        (F.lit(10) - k).alias("priority"), date("1996-01-01").alias("starts_on"), F.when(k == 1, date("1999-12-31")).alias("ends_on"),
        F.lit("active").alias("promo_status"), F.when(k == 0, arr("web", "ios_app")).alias("applicable_channels"))
    return out


def _promo_orders(spark, root):
    types = E.raw_items(spark, root).join(E.products(spark, root).select("product_id", "product_type"), "product_id").groupBy("order_id").agg(
        F.collect_set("product_type").alias("order_product_types"))
    own = E.raw_orders(spark, root).select("order_id", F.col("item_count").alias("stored_items"))
    fact = CM._fact(spark, root).join(own, "order_id").drop("item_count").withColumnRenamed("stored_items", "item_count")
    return fact.join(types, "order_id", "left").withColumn("order_product_types", F.coalesce("order_product_types", F.array().cast("array<string>")))


def _applied(spark, root):
    return PM.stacked(PM.with_discount(PM.eligible(_promo_orders(spark, root), _promotions(spark, root))))


@query("pm01_eligible_promotions", "order_id:i promotion_id:s", "SELECT order_id, promotion_id FROM elig", PROMO_CTES)
@query("pm02_promotion_discount", "order_id:i promotion_id:s discount:m", "SELECT order_id, promotion_id, discount FROM disc", PROMO_CTES)
def _(spark, root):
    return PM.with_discount(PM.eligible(_promo_orders(spark, root), _promotions(spark, root)))


@query("pm03_stacked_promotions", "order_id:i promotion_id:s discount:m", "SELECT order_id, promotion_id, discount FROM stk", PROMO_CTES)
def _(spark, root):
    return _applied(spark, root)


def _used(spark, root):
    needed = ("order_id", "promotion_id", "customer_id", "created_at", "per_customer_limit", "total_usage_limit", "discount", "total_amount")
    return PM.within_usage(_applied(spark, root).select(*needed), _promotions(spark, root))


@query("pm04_usage_limits", "order_id:i promotion_id:s customer_use:i use_number:i", "SELECT order_id, promotion_id, CASE WHEN per_customer_limit IS NOT NULL THEN customer_use END AS customer_use, CASE WHEN total_usage_limit IS NOT NULL THEN use_number END AS use_number FROM used", PROMO_CTES)
def _(spark, root):
    return _used(spark, root)


@query("pm04_promotion_rollup", "promotion_id:s orders:i discount_given:m attributed_revenue:m",
       "SELECT promotion_id, count(*) AS orders, sum(discount) AS discount_given, sum(total_amount) AS attributed_revenue FROM used GROUP BY 1", PROMO_CTES)
def _(spark, root):
    return PM.rollup(_used(spark, root))
