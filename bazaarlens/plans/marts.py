"""Order, customer, merchant, product and subscription marts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import day_window
from ..operators import customers as C
from ..operators import daily as D
from ..operators import orders as O
from ..operators import products as P
from ..operators import subscriptions as SUB

FACT_COLUMNS = (
    "order_id", "merchant_id", "customer_id", "status", "channel", "order_date", "created_at",
    "subtotal", "discount_amount", "tax_amount", "shipping_amount", "total_amount", "gmv", "nmv",
    "item_count", "unique_products", "avg_item_price", "customer_tier", "customer_ltv_at_order",
    "is_first_order", "days_since_prev_order", "order_hour", "order_day_of_week", "order_week",
    "order_month", "order_quarter", "order_year", "is_weekend", "utm_source", "utm_medium", "utm_campaign")


def fact_orders(orders: DataFrame, items: DataFrame, dim_customers: DataFrame,
                start: str | None = None, end: str | None = None) -> DataFrame:
    """Order fact. A date range restricts the output; history-dependent columns
    still see every earlier order, so incremental runs equal a full rebuild."""
    sold = O.without_status(orders, "cancelled")
    part = sold
    if start is not None:
        part = sold.filter(day_window("created_at", start, end or start))
        items = O.items_of(items, part)
        sold = sold.filter(F.col("created_at") < F.date_add(F.lit(end or start).cast("date"), 1))
        sold = sold.join(part.select("merchant_id", "customer_id").distinct(), ["merchant_id", "customer_id"], "left_semi")
    out = O.with_sequence(O.with_gmv(O.with_item_metrics(part, items)), history=sold)
    out = O.with_calendar(O.with_customer_tier(out, dim_customers))
    return out.select(*FACT_COLUMNS, F.current_timestamp().alias("_loaded_at"))


DIM_COLUMNS = (
    "customer_id", "merchant_id", "email", "first_name", "last_name", "status", "tier", "legacy_tier",
    "segment", "lifecycle_stage", "ltv", "total_orders", "avg_order_value", "total_items_purchased",
    "largest_order", "smallest_order", "first_order_at", "last_order_at", "days_since_last_order",
    "tenure_months", "recency_score", "frequency_score", "monetary_score", "rfm_score", "churn_risk",
    "is_repeat_customer", "has_recent_activity", "never_ordered", "email_opt_in", "sms_opt_in", "acquisition_source",
    "created_at")


def dim_customers(customers: DataFrame, orders: DataFrame, asof: str) -> DataFrame:
    """Customer dimension (current state) as of the run date."""
    df = C.with_customer_value(customers, C.customer_value(O.completed(orders)))
    df = C.with_segment(C.with_rfm(C.with_tier(df), asof))
    df = C.with_activity_flags(C.with_tenure(C.with_churn_risk(df), asof))
    return df.select(*DIM_COLUMNS, F.current_timestamp().alias("_loaded_at"))


def agg_daily_gmv(fact: DataFrame, start: str, end: str, history_days: int | None = None) -> DataFrame:
    """Daily GMV with channel and tier breakdowns, comparisons and rolling sums.

    Everything but the median comes from one pass. ``history_days`` widens the
    input before ``start`` so that lags and rolling sums of the first days are
    right; only ``start..end`` is returned.
    """
    first = start if history_days is None else None
    sold = fact.filter(~F.col("status").isin("cancelled", "refunded"))
    lower = F.lit(start).cast("date") if first else F.date_sub(F.lit(start).cast("date"), history_days)
    sold = sold.filter((F.col("order_date") >= lower) & (F.col("order_date") <= F.lit(end).cast("date")))
    daily = D.daily_core(sold, D.CHANNELS, D.TIERS).join(D.daily_median(sold), list(D.DAY), "left")
    out = D.rolling(D.period_over_period(daily))
    return out.filter(F.col("order_date") >= F.lit(start).cast("date"))


def agg_product_performance(items: DataFrame, events: DataFrame, products: DataFrame, asof: str,
                            lookback_days: int = 30, events_asof: str | None = None, path: str = "$.product_id",
                            keys: tuple[str, ...] = P.KEY) -> DataFrame:
    """Product sales, funnel, stock and rankings over the look-back."""
    since = lambda d: F.date_sub(F.lit(d).cast("date"), lookback_days)
    sold = P.sales(items.filter(F.col("created_at") >= since(asof)))
    fun = P.funnel(P.product_events(events.filter(F.col("ts") >= since(events_asof or asof)), path).filter(F.col("product_id").isNotNull()))
    out = P.with_stock(P.sales_and_funnel(sold, fun), products, lookback_days, keys)
    return P.with_rankings(out).withColumn("lookback_days", F.lit(lookback_days))


def agg_subscription_metrics(subs: DataFrame, orders: DataFrame, asof: str, lookback_days: int = 30) -> DataFrame:
    """Merchant subscription row: MRR, churn, subscriber LTV lift."""
    priced = SUB.with_mrr(subs)
    return SUB.metrics(SUB.merchant_mrr(priced), SUB.churn(priced, asof, lookback_days), SUB.subscriber_ltv(subs, orders))


def model_fact_orders(staged: DataFrame, dim: DataFrame, merchants: DataFrame) -> DataFrame:
    """The SQL model's order fact: staged orders with customer and merchant attributes."""
    c = dim.select("customer_id", "customer_tier", "customer_segment", F.col("ltv").alias("customer_ltv"),
                   F.col("total_orders").alias("customer_total_orders"), F.col("is_churned").alias("customer_is_churned"),
                   F.col("first_order_at").alias("_first"))
    m = merchants.select("merchant_id", "merchant_name", "merchant_tier", F.col("industry").alias("merchant_industry"))
    source = staged.withColumnsRenamed({"traffic_source": "utm_source", "traffic_medium": "utm_medium", "order_status": "status"})
    out = source.join(c, "customer_id", "left").join(m, "merchant_id", "left").withColumns({
        "order_date": F.to_date("created_at"), "order_week": F.trunc("created_at", "week"),
        "order_month": F.trunc("created_at", "month"), "order_hour": F.hour("created_at"),
        "order_day_of_week": F.dayofweek("created_at") - 1,
        "is_first_order": F.coalesce(F.col("_first") == F.col("created_at"), F.lit(False)),
        "gmv": F.col("subtotal"), **O.channel_and_status(), **O.revenue_columns(), **O.order_flags(),
        **O.fulfilment_hours()}).drop("_first")
    return out.withColumnsRenamed({"utm_source": "traffic_source", "utm_medium": "traffic_medium", "status": "order_status"})


def model_daily_gmv(fact: DataFrame) -> DataFrame:
    return D.model_comparisons(D.model_daily_gmv(fact.filter(F.col("order_status_category") != "cancelled")))


def merchant_performance(fact: DataFrame, sessions: DataFrame) -> DataFrame:
    sold = fact.filter(~F.col("order_status").isin("cancelled", "refunded"))
    return D.merchant_performance(D.merchant_daily_orders(sold), D.daily_sessions(sessions))


def merchant_tiers(daily: DataFrame, tiers: DataFrame, asof: str) -> DataFrame:
    """Trailing 12-month GMV, tier and the tier's service attributes."""
    return D.trailing_gmv(daily, asof).join(F.broadcast(tiers), F.col("calculated_tier") == F.col("tier"), "left").drop("tier")
