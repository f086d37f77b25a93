"""Commerce entities as lazy views over the supplied parquet tables.

Only projections and key joins; a predicate on an entity column that is a plain
rename (``created_at``, ``order_id`` ...) therefore still reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.guards import money
from ..operators.scale import dealt


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def _pick(key: Column, *pairs: tuple[int, str | None]) -> Column:
    expr = None
    for value, label in pairs:
        expr = F.when(key == value, F.lit(label)) if expr is None else expr.when(key == value, F.lit(label))
    return expr


def merchants(spark: SparkSession, root: str) -> DataFrame:
    """One merchant per nation; the region is its industry."""
    n, r = table(spark, root, "nation"), table(spark, root, "region")
    k = F.col("n_nationkey")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        k.alias("merchant_id"), F.col("n_name").alias("merchant_name"),
        F.col("r_name").alias("industry"),
        _pick(k % 4, (0, "platinum"), (1, "gold"), (2, "silver"), (3, "bronze")).alias("merchant_tier"),
        F.when(k % 12 == 11, "suspended").otherwise("active").alias("status"),
    )


def customers(spark: SparkSession, root: str) -> DataFrame:
    c, k = table(spark, root, "customer"), F.col("c_custkey")
    return c.select(
        k.alias("customer_id"), F.col("c_nationkey").alias("merchant_id"),
        F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("email"),
        F.when(k % 17 != 0, F.lit("Customer")).alias("first_name"),
        F.substring(F.col("c_name"), 10, 9).alias("last_name"),
        F.when(k % 20 == 0, "inactive").otherwise("active").alias("status"),
        F.col("c_mktsegment").alias("acquisition_source"),
        (k % 2 == 0).alias("email_opt_in"), (k % 3 == 0).alias("sms_opt_in"),
        money("c_acctbal").alias("ltv"),
        F.date_add(F.lit("1994-01-01").cast("date"), (k % 365).cast("int")).alias("created_at"),
        F.when(k % 50 == 0, F.lit("2001-01-01").cast("date")).alias("deleted_at"),
    )


def raw_orders(spark: SparkSession, root: str) -> DataFrame:
    """Orders without the merchant key (no join)."""
    o, k = table(spark, root, "orders"), F.col("o_orderkey")
    placed = F.col("o_orderdate")
    base = o.select(
        k.alias("order_id"), F.col("o_custkey").alias("customer_id"),
        F.when(F.col("o_orderstatus") == "F", "delivered").when(F.col("o_orderstatus") == "O", "processing")
        .when(k % 5 == 0, "cancelled").when(k % 5 == 1, "refunded").otherwise("pending").alias("status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "web").when(F.col("o_orderpriority") == "2-HIGH", "mobile_web")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "ios_app")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "android_app").otherwise("api").alias("channel"),
        placed.alias("created_at"),
        F.when(k % 9 != 0, F.lit("USD")).alias("currency_raw"),
        money("o_totalprice").alias("subtotal"),
        F.when(k % 4 != 0, money(money("o_totalprice") * ((k % 4) * 5).cast("decimal(4,0)") / F.lit(100).cast("decimal(3,0)"))).alias("discount_amount"),
        money(money("o_totalprice") * F.lit("0.08").cast("decimal(3,2)")).alias("tax_amount"),
        F.when(k % 3 == 0, F.lit("5.99")).otherwise(F.lit("0.00")).cast("decimal(12,2)").alias("shipping_amount"),
        (k % 5 + 1).cast("int").alias("item_count"), (k % 3 + 1).cast("int").alias("unique_item_count"),
        _pick(k % 7, (0, "direct"), (2, "google"), (3, "google"), (4, "facebook_ads"), (5, "newsletter"), (6, "partner")).alias("source_raw"),
        _pick(k % 7, (2, "cpc"), (3, "organic"), (4, "social"), (5, "email"), (6, "referral")).alias("medium_raw"),
        F.when(k % 8 < 3, F.concat(F.lit("SAVE"), (k % 8).cast("string"))).alias("coupon_code"),
    )
    k, total = F.col("order_id"), F.col("subtotal") + F.col("tax_amount") + F.col("shipping_amount") - F.coalesce(F.col("discount_amount"), F.lit(0))
    refunded, delivered = F.col("status") == "refunded", F.col("status") == "delivered"
    hours = lambda n: F.make_interval(hours=n.cast("int"))
    shipped = F.when(delivered | ((F.col("status") == "processing") & (k % 2 == 0)), F.col("created_at") + hours(k % 72))
    return base.select(
        "*", money(total).alias("total_amount"),
        F.when(k % 11 == 0, "tiktok").otherwise(F.col("source_raw")).alias("utm_source"),
        F.when(k % 11 == 0, "display").otherwise(F.col("medium_raw")).alias("utm_medium"),
        F.when(k % 7 >= 2, F.concat(F.lit("camp_"), (k % 3).cast("string"))).alias("utm_campaign"),
        F.when(F.col("status") != "pending", F.col("created_at") + F.make_interval(hours=F.lit(1))).alias("paid_at"),
        shipped.alias("shipped_at"),
        F.when(delivered, shipped + hours(k % 96)).alias("delivered_at"),
        F.when(refunded, F.col("created_at") + F.make_interval(days=F.lit(10))).alias("refunded_at"),
        F.when(refunded, money(F.col("subtotal") * F.lit("0.5").cast("decimal(2,1)"))).alias("refund_amount"),
        (k % 6 == 0).alias("has_recommended_items"),
        F.when(k % 6 == 0, money(F.col("subtotal") * F.lit("0.25").cast("decimal(3,2)"))).otherwise(F.lit(0).cast("decimal(12,2)")).alias("recommended_items_value"),
        (F.col("created_at") + F.make_interval(days=F.lit(1))).alias("updated_at"),
    ).drop("source_raw", "medium_raw")


def customer_merchant(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("merchant_id"))


def orders(spark: SparkSession, root: str) -> DataFrame:
    """Orders with their merchant; each customer belongs to exactly one merchant."""
    return raw_orders(spark, root).join(customer_merchant(spark, root), "customer_id")


def raw_items(spark: SparkSession, root: str) -> DataFrame:
    """Order lines without merchant or order date (no join)."""
    # Whole cents in BIGINT, rounded half up; only the results become decimals.
    li = table(spark, root, "lineitem")
    whole = lambda c: F.round(F.col(c) * 100).cast("bigint")
    li = li.withColumns({"_g": whole("l_extendedprice"), "_q": F.col("l_quantity").cast("int")}).withColumn(
        "_d", F.expr("(_g * cast(round(l_discount * 100) AS BIGINT) + 50) div 100")).withColumn(
        "_t", F.expr("((_g - _d) * cast(round(l_tax * 100) AS BIGINT) + 50) div 100"))
    return li.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), F.col("_q").alias("quantity"),
        from_cents(F.expr("(2 * _g + _q) div (2 * _q)")).alias("unit_price"), from_cents(F.col("_g")).alias("line_subtotal"),
        from_cents(F.col("_d")).alias("discount_amount"), from_cents(F.col("_t")).alias("tax_amount"),
        from_cents(F.col("_g") - F.col("_d") + F.col("_t")).alias("total_amount"),
        (F.col("l_partkey") % 8 == 0).alias("from_recommendation"),
        F.col("l_linenumber").alias("line_number"), F.col("l_shipdate").alias("shipped_on"))


def from_cents(cents: Column) -> Column:
    return (cents.cast("decimal(12,0)") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(12,2)")


def items(spark: SparkSession, root: str) -> DataFrame:
    """Order lines carrying merchant, customer, status and order date."""
    head = orders(spark, root).select("order_id", "merchant_id", "customer_id", "status", "created_at")
    lines = dealt(raw_items(spark, root), table(spark, root, "lineitem").count(), "order_id")
    return lines.join(head, "order_id")


def products(spark: SparkSession, root: str) -> DataFrame:
    p, k = table(spark, root, "part"), F.col("p_partkey")
    price = money("p_retailprice")
    return p.select(
        k.alias("product_id"), F.col("p_name").alias("product_name"),
        F.concat(F.lit("SKU-"), k.cast("string")).alias("sku"), F.col("p_brand").alias("brand"),
        F.concat_ws(" > ", F.col("p_type"), F.col("p_brand")).alias("category_path"),
        F.col("p_type").alias("product_type"), price.alias("price"),
        F.when(k % 10 == 0, money(price * F.lit("0.8").cast("decimal(2,1)"))).when(k % 10 == 1, F.lit(0).cast("decimal(12,2)")).alias("sale_price"),
        F.when(k % 13 != 0, money(price * F.lit("0.6").cast("decimal(2,1)"))).alias("cost"),
        F.when(k % 19 != 0, F.col("p_size") * 10 - 30).cast("int").alias("inventory_quantity"),
        F.lit(50).alias("low_stock_threshold"),
        F.when(k % 7 == 0, "continue").otherwise("deny").alias("inventory_policy"),
        F.when(k % 23 == 0, "archived").otherwise("active").alias("status"),
    )


def merchant_products(spark: SparkSession, root: str) -> DataFrame:
    """Catalogue per merchant: the products each merchant has sold."""
    sold = items(spark, root).select("merchant_id", "product_id").distinct()
    return sold.join(products(spark, root), "product_id")


def raw_events(spark: SparkSession, root: str) -> DataFrame:
    return canonical_events(table(spark, root, "events"))


def canonical_events(e: DataFrame) -> DataFrame:
    """(Streamed) events under canonical names, without merchant (no join)."""
    k, kind = F.col("event_id"), F.col("event_type")
    return e.select(
        "event_id", F.col("user_id").alias("customer_id"),
        F.when(kind == "view", "product_view").when(kind == "click", "add_to_cart").when(kind == "purchase", "purchase")
        .when(kind == "signup", "sign_up").otherwise("page_view").alias("event_type"),
        F.col("ts"), (F.col("ts") + F.make_interval(secs=(k % 90).cast("decimal(18,6)"))).alias("received_at"),
        money("value").alias("value"), money("value").alias("revenue"), F.when(kind == "purchase", k).alias("order_id"),
        F.col("props").alias("properties"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format(F.to_date("ts"), "yyyyMMdd")).alias("session_id"),
        F.when(k % 3 == 0, "desktop").when(k % 3 == 1, "mobile").otherwise("tablet").alias("device"),
        F.when(k % 4 == 0, "ios").when(k % 4 == 1, "android").when(k % 4 == 2, "server").otherwise("web").alias("source"),
    )


def raw_payloads(spark: SparkSession, root: str) -> DataFrame:
    return payloads_of(table(spark, root, "events"))


def payloads_of(e: DataFrame) -> DataFrame:
    """Client payloads (JSON text) in every state of repair, from (streamed) events."""
    k = F.col("event_id")
    item, amount = F.get_json_object("props", "$.k"), F.col("value").cast("decimal(12,2)").cast("string")
    q = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    cases = (
        ("product_view", q('{"product_id":"prod_', item, '","price":', amount, "}")),
        ("product_view", q('{"price":', amount, ',"position":0}')),
        ("add_to_cart", q('{"product_id":"prod_', item, '","quantity":', (k % 1100).cast("string"), "}")),
        ("add_to_cart", q('{"product_id":"sku', F.repeat(item, 20), '","quantity":"2"}')),
        ("purchase", q('{"order_id":"order_', k.cast("string"), '","revenue":', amount, ',"items":[]}')),
        ("purchase", q('{"order_id":null,"revenue":-', amount, ',"items":{}}')),
        ("page_view", q('{"page_path":"/p/', item, '","page_title":', item, "}")),
        ("page_view", q("{}")),
        ("custom", q('{"event_name":"Bad Name ', item, '"}')),
        ("teleport", q('{"x":1}')),
        ("recommendation_view", q('{"placement":"', F.when(k % 2 == 0, "pdp").otherwise("sidebar"), '","product_ids":["a","b"],"strategy":"hybrid"}')),
        ("logout", q("{}")),
        ("recommendation_click", q('{"placement":"pdp","product_id":"a","position":2.0,"strategy":"hybrid"}')),
        ("search", q('{"query":"ring","result_count":true,"filters":[]}')),
        ("search_click", q('{"query":"ring","product_id":"a","position":', (k % 5).cast("string"), "}")),
        ("sign_up", q('{"method":"carrier pigeon"}')),
        ("login", q('{"method":"google"')),
    )
    pick = lambda i: _pick_columns(k % len(cases), [c[i] if i else F.lit(c[0]) for c in cases])
    return e.select(
        "event_id", F.when(k % 29 != 0, F.col("user_id") % 25).alias("merchant_id"), pick(0).alias("event_type"),
        pick(1).alias("properties"),
        F.when(k % 7 == 0, '{"timestamp":"yesterday"}').when(k % 7 == 1, '{"timestamp":"2024-01-15T12:00:00Z"}').otherwise("{}").alias("context"),
        F.when(k % 3 == 0, F.lit("1705320000000")).when(k % 3 == 1, F.lit("1705320000")).otherwise("2024-01-15T12:00:00Z").alias("timestamp"),
        F.when(k % 2 == 0, F.concat(F.lit("sess_"), item)).alias("session_id"), F.lit(None).cast("string").alias("anonymous_id"),
        F.when(k % 4 == 0, F.col("user_id").cast("string")).alias("user_id"),
        F.when(k % 5 == 0, "ios").when(k % 5 == 1, "fridge").otherwise(F.lit(None)).alias("source"),
        F.concat_ws(".", F.lit("10"), (k % 4).cast("string"), (k % 250).cast("string"), F.lit("7")).alias("ip_address"),
        F.col("ts").alias("received_at"))


def _pick_columns(key: Column, values: list[Column]) -> Column:
    expr = None
    for i, value in enumerate(values):
        expr = F.when(key == i, value) if expr is None else expr.when(key == i, value)
    return expr


def events(spark: SparkSession, root: str) -> DataFrame:
    return raw_events(spark, root).join(customer_merchant(spark, root), "customer_id")


def subscriptions(spark: SparkSession, root: str) -> DataFrame:
    """Every tenth order started a subscription."""
    o, k = orders(spark, root).filter(F.col("order_id") % 10 == 0), F.col("order_id")
    step = F.floor(k / 10)
    cancelled = F.col("status").isin("cancelled", "refunded", "pending")
    return o.select(
        k.alias("subscription_id"), "merchant_id", "customer_id",
        F.coalesce(_pick(step % 7, (0, "weekly"), (1, "biweekly"), (2, "monthly"), (3, "bimonthly"), (4, "quarterly"), (5, "annually")), F.lit("custom")).alias("frequency"),
        F.when(cancelled, "cancelled").when(F.col("status") == "delivered", "active").when(step % 3 == 0, "paused")
        .when(step % 3 == 1, "payment_failed").otherwise("active").alias("status"),
        F.col("subtotal").alias("estimated_total"), F.col("created_at").alias("started_at"),
        F.when(cancelled, F.col("created_at") + F.make_interval(days=(k % 400).cast("int"))).alias("cancelled_at"),
        F.when(cancelled, _pick(step % 6, (0, "price"), (1, "not_using"), (2, "competitor"), (3, "temporary"), (4, "other"))).alias("cancellation_reason"),
        (step % 12).cast("int").alias("total_orders_generated"),
        money(F.col("subtotal") * (step % 12).cast("decimal(4,0)")).alias("total_revenue"),
        (step % 3 + 1).cast("int").alias("interval_count"),
        F.when(step % 5 == 0, 2).otherwise(0).alias("retry_count"),
    )
