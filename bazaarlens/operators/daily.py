"""Daily merchant aggregates, their calendar comparisons and merchant tiers.

The fact table is shuffled once, by (merchant, day, customer), already reduced
map-side; distinct customers then are a plain count in a second, small step
instead of an Expand over every distinct expression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import as_date, day_window
from ..functions.guards import count_if, pct_change, ratio, sum_if
from ..functions.scoring import merchant_tier
from .scale import value_band

CHANNELS = ("web", "mobile_web", "ios_app", "android_app", "api")
TIERS = ("platinum", "gold", "silver", "bronze")
GROUPINGS = ("Direct", "Paid Search", "Organic Search", "Paid Social", "Email", "Referral")
DAY = ("merchant_id", "order_date")


def _nullable_sum_if(cond: Column, value: str) -> Column:
    """Sum over matching rows, null when there are none (pivot behaviour)."""
    return F.sum(F.when(cond, F.col(value)))


def _nullable_count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, F.lit(1)))


def daily_core(orders: DataFrame, channels: Sequence[str] = (), tiers: Sequence[str] = ()) -> DataFrame:
    """Daily sums, counts, distinct customers and optional breakdowns in one pass.

    Breakdown columns are null on days without such orders, as a pivot gives.
    """
    ch = [(c, F.col("channel") == c) for c in channels]
    ti = [(t, F.col("customer_tier") == t) for t in tiers]
    per_customer = orders.groupBy(*DAY, "customer_id").agg(
        F.sum("gmv").alias("gmv"), F.sum("nmv").alias("nmv"), F.sum("total_amount").alias("revenue"),
        F.count(F.lit(1)).alias("orders"), F.count("gmv").alias("gmv_rows"),
        F.count("total_amount").alias("revenue_rows"),
        F.sum("item_count").alias("items"), F.sum("unique_products").alias("uniq"),
        F.sum("discount_amount").alias("discounts"), count_if(F.col("is_first_order")).alias("firsts"),
        F.max("gmv").alias("max_gmv"), F.min("gmv").alias("min_gmv"),
        *[_nullable_sum_if(c, "gmv").alias(f"c_gmv_{n}") for n, c in ch],
        *[_nullable_count_if(c).alias(f"c_n_{n}") for n, c in ch],
        *[_nullable_sum_if(c, "gmv").alias(f"t_gmv_{n}") for n, c in ti],
        *[_nullable_count_if(c).alias(f"t_n_{n}") for n, c in ti])
    day = per_customer.groupBy(*DAY).agg(
        F.sum("gmv").alias("total_gmv"), F.sum("nmv").alias("total_nmv"), F.sum("revenue").alias("total_revenue"),
        F.sum("orders").alias("order_count"), F.sum("items").alias("total_items_sold"),
        F.sum("uniq").alias("total_unique_products"),
        F.sum("gmv_rows").alias("_gmv_rows"), F.sum("revenue_rows").alias("_revenue_rows"),
        F.sum("discounts").alias("total_discounts"), F.count("customer_id").alias("unique_customers"),
        F.sum("firsts").alias("new_customers"),
        F.max("max_gmv").alias("max_order_gmv"), F.min("min_gmv").alias("min_order_gmv"),
        *[F.sum(f"c_gmv_{n}").alias(f"{n}_gmv") for n, _ in ch],
        *[F.sum(f"c_n_{n}").alias(f"{n}_orders") for n, _ in ch],
        *[F.sum(f"t_gmv_{n}").alias(f"{n}_gmv") for n, _ in ti],
        *[F.sum(f"t_n_{n}").alias(f"{n}_orders") for n, _ in ti],
        *[count_if((F.col(f"t_n_{n}") > 0) & F.col("customer_id").isNotNull()).alias(f"{n}_customers") for n, _ in ti])
    return day.withColumns({
        "avg_order_value": ratio("total_gmv", "_gmv_rows", None),
        "avg_revenue_per_order": ratio("total_revenue", "_revenue_rows", None),
        "returning_customers": F.col("unique_customers") - F.col("new_customers"),
        "new_customer_rate": ratio("new_customers", "unique_customers"),
        "discount_rate": ratio("total_discounts", "total_gmv"),
        "items_per_order": ratio("total_items_sold", "order_count"),
    }).drop("_gmv_rows", "_revenue_rows")


def daily_median(orders: DataFrame, exact: bool = False, value: str = "gmv", name: str = "median_order_gmv") -> DataFrame:
    """Median per day; approximate picks an element, exact interpolates.

    The exact one counts equal values first, finds by the sizes of value bands which
    band holds the middle, and orders only the values of that band.
    """
    if not exact:
        return orders.groupBy(*DAY).agg(F.percentile_approx(value, 0.5).alias(name))
    counts = orders.filter(F.col(value).isNotNull()).groupBy(*DAY, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_band", value_band(F.col("_v")))
    day = Window.partitionBy(*DAY)
    bands = counts.groupBy(*DAY, "_band").agg(F.sum("_n").alias("_size"))
    bands = bands.withColumn("_total", F.sum("_size").over(day)).withColumn("_before", F.sum("_size").over(day.orderBy("_band").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"))
    low, high = F.floor((F.col("_total") + 1) / 2), F.floor((F.col("_total") + 2) / 2)
    middle = bands.filter((F.col("_before") < high) & (F.col("_before") + F.col("_size") >= low)).drop("_size")
    upto = Window.partitionBy(*DAY, "_band").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    near = counts.join(middle, [*DAY, "_band"]).withColumn("_to", F.col("_before") + F.sum("_n").over(upto))
    holds = lambda at: F.max(F.when((F.col("_to") >= at) & (F.col("_to") - F.col("_n") < at), F.col("_v")))
    return near.groupBy(*DAY).agg(((holds(low) + holds(high)) / 2).alias(name))


def daily_gmv(orders: DataFrame) -> DataFrame:
    """Daily GMV measures including the approximate median order value."""
    return daily_core(orders).join(daily_median(orders), list(DAY), "left")


def channel_breakdown(orders: DataFrame, channels: Sequence[str] = CHANNELS) -> DataFrame:
    return orders.groupBy(*DAY).pivot("channel", list(channels)).agg(
        F.sum("gmv").alias("gmv"), F.count(F.lit(1)).alias("orders"))


def tier_breakdown(orders: DataFrame) -> DataFrame:
    """GMV, orders and distinct customers per customer tier (two-level, no Expand)."""
    per_customer = orders.groupBy(*DAY, "customer_tier", "customer_id").agg(
        F.sum("gmv").alias("gmv"), F.count(F.lit(1)).alias("n"))
    return per_customer.groupBy(*DAY).pivot("customer_tier", list(TIERS)).agg(
        F.sum("gmv").alias("gmv"), F.sum("n").alias("orders"), F.count("customer_id").alias("customers"))


def _by_day() -> Window:
    return Window.partitionBy("merchant_id").orderBy("order_date")


def period_over_period(daily: DataFrame) -> DataFrame:
    """Previous row and seventh previous row, with change %. One row per merchant-day."""
    w = _by_day()
    return daily.withColumns({
        "prev_day_gmv": F.lag("total_gmv", 1).over(w), "prev_week_gmv": F.lag("total_gmv", 7).over(w),
    }).withColumns({
        "gmv_dod_change": pct_change("total_gmv", "prev_day_gmv"),
        "gmv_wow_change": pct_change("total_gmv", "prev_week_gmv"),
    })


def rolling(daily: DataFrame, calendar: bool = False) -> DataFrame:
    """7/30 rolling GMV and orders, by rows or (``calendar``) by days."""
    def frame(n: int) -> Window:
        if not calendar:
            return _by_day().rowsBetween(-(n - 1), 0)
        days = F.datediff("order_date", F.lit("1970-01-01").cast("date"))
        return Window.partitionBy("merchant_id").orderBy(days).rangeBetween(-(n - 1), 0)
    w7, w30 = frame(7), frame(30)
    mean = lambda w: F.sum("total_gmv").over(w).cast("double") / F.count("total_gmv").over(w)
    return daily.withColumns({
        "gmv_7d_rolling": F.sum("total_gmv").over(w7), "orders_7d_rolling": F.sum("order_count").over(w7),
        "gmv_30d_rolling": F.sum("total_gmv").over(w30), "orders_30d_rolling": F.sum("order_count").over(w30),
        "avg_daily_gmv_7d": mean(w7), "avg_daily_gmv_30d": mean(w30),
    })


def lag_month(daily: DataFrame, value: str = "gmv") -> DataFrame:
    return daily.withColumn(f"{value}_same_day_last_month", F.lag(value, 30).over(_by_day()))


def to_date_sum(daily: DataFrame, unit: str, name: str, value: str = "total_gmv") -> DataFrame:
    """Running sum since the start of the month, quarter or year."""
    w = Window.partitionBy("merchant_id", F.trunc("order_date", unit)).orderBy("order_date")
    return daily.withColumn(name, F.sum(value).over(w))


def model_daily_gmv(fact: DataFrame) -> DataFrame:
    """The SQL model's daily measures over a merchant-enriched order fact."""
    gmv_if = lambda cond: F.sum(F.when(cond, F.col("gmv")).otherwise(F.lit(0)))
    key = ["merchant_id", "merchant_name", "merchant_tier", "order_date"]
    rec, coupon = F.coalesce("has_recommended_items", F.lit(False)), F.col("has_coupon")
    sums = ["gmv", "net_revenue", "total_amount", "refund_amount", "discount_amount", "shipping_amount",
            "item_count", "recommended_items_value", "hours_to_ship"]
    slug = lambda s: s.lower().replace(" ", "_")
    parts = {
        **{f"s_{c}": F.sum(c) for c in sums},
        "n_orders": F.count("order_id"), "n_items": F.count("item_count"), "n_total": F.count("total_amount"),
        "n_ship": F.count("hours_to_ship"),
        "orders_with_recommendations": count_if(rec), "orders_with_coupon": count_if(coupon),
        "coupon_discount_total": sum_if(coupon, "discount_amount"),
        **{f"gmv_{slug(g)}": gmv_if(F.col("channel_grouping") == g) for g in GROUPINGS},
        **{f"gmv_{t}_customers": gmv_if(F.col("customer_tier") == t) for t in TIERS},
    }
    # One row stands for a customer's day, a first order if there is one; sorted rows are far narrower than hash entries with all sums.
    one = F.row_number().over(Window.partitionBy(*key, "customer_id").orderBy(F.desc("is_first_order"))) == 1
    counted = fact.withColumn("_one", one & F.col("customer_id").isNotNull())
    day = counted.groupBy(*key).agg(
        *[e.alias(n) for n, e in parts.items()],
        count_if(F.col("_one")).alias("unique_customers"),
        count_if(F.col("_one") & F.col("is_first_order")).alias("new_customers"))
    return day.select(
        F.concat_ws("_", F.col("merchant_id").cast("string"), F.col("order_date").cast("string")).alias("merchant_date_key"),
        *key, F.col("s_gmv").alias("gmv"), F.col("s_net_revenue").alias("net_revenue"),
        F.col("s_total_amount").alias("gross_revenue"), F.col("s_refund_amount").alias("refund_amount"),
        F.col("s_discount_amount").alias("discount_amount"), F.col("s_shipping_amount").alias("shipping_revenue"),
        F.col("n_orders").alias("order_count"), "unique_customers", "new_customers",
        F.col("s_item_count").alias("total_items"), ratio("s_item_count", "n_items", None).alias("avg_items_per_order"),
        ratio("s_total_amount", "n_total", None).alias("average_order_value"),
        "orders_with_recommendations", F.col("s_recommended_items_value").alias("recommendation_attributed_revenue"),
        ratio("s_recommended_items_value", "s_gmv", None).alias("recommendation_revenue_share"),
        *[f"gmv_{slug(g)}" for g in GROUPINGS], *[f"gmv_{t}_customers" for t in TIERS],
        "orders_with_coupon", "coupon_discount_total", ratio("s_hours_to_ship", "n_ship", None).alias("avg_hours_to_ship"))


def model_comparisons(daily: DataFrame) -> DataFrame:
    """Lags 1/7/30, rolling 7/30 rows, month-to-date, and change % of the SQL model."""
    w = _by_day()
    month = Window.partitionBy("merchant_id", F.trunc("order_date", "month")).orderBy("order_date")
    return daily.withColumns({
        "gmv_prev_day": F.lag("gmv", 1).over(w), "gmv_same_day_last_week": F.lag("gmv", 7).over(w),
        "gmv_same_day_last_month": F.lag("gmv", 30).over(w),
        "gmv_rolling_7d": F.sum("gmv").over(w.rowsBetween(-6, 0)),
        "gmv_rolling_30d": F.sum("gmv").over(w.rowsBetween(-29, 0)),
        "gmv_mtd": F.sum("gmv").over(month),
    }).withColumns({
        "gmv_change_vs_prev_day_pct": pct_change("gmv", "gmv_prev_day"),
        "gmv_change_vs_last_week_pct": pct_change("gmv", "gmv_same_day_last_week"),
    })


def merchant_daily_orders(fact: DataFrame) -> DataFrame:
    """Per merchant-day order measures with the exact median."""
    per_customer = fact.groupBy(*DAY, "customer_id").agg(
        F.count("order_id").alias("n"), F.sum("subtotal").alias("gmv"), F.count("subtotal").alias("n_gmv"),
        F.sum("total_amount").alias("revenue"), F.sum("item_count").alias("units"),
        F.max("subtotal").alias("top"), F.max(F.col("is_first_order").cast("int")).alias("first"))
    day = per_customer.groupBy(*DAY).agg(
        F.sum("n").alias("order_count"), F.sum("gmv").alias("gmv"), F.sum("revenue").alias("revenue"),
        F.sum("units").alias("units_sold"), F.count("customer_id").alias("ordering_customers"),
        count_if((F.col("first") == 1) & F.col("customer_id").isNotNull()).alias("new_customers"),
        F.sum("n_gmv").alias("_n"), F.max("top").alias("max_order_value"))
    day = day.withColumn("avg_order_value", ratio("gmv", "_n", None)).drop("_n")
    return day.join(daily_median(fact, exact=True, value="subtotal", name="median_order_value"), list(DAY), "left")


def daily_sessions(sessions: DataFrame) -> DataFrame:
    """Per merchant-day session measures from a session table.

    Sessions are one row each, so distinct sessions are a count; visitors are
    counted by a first level per (merchant, day, visitor).
    """
    has = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0))
    per_visitor = sessions.groupBy("merchant_id", "session_date", "anonymous_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("page_views").alias("pv"),
        count_if(F.col("page_views") == 1).alias("bounced"),
        has("has_product_view").alias("viewed"), has("has_add_to_cart").alias("carted"))
    return per_visitor.groupBy("merchant_id", F.col("session_date").alias("order_date")).agg(
        F.sum("n").alias("sessions"), F.count("anonymous_id").alias("unique_visitors"), F.sum("pv").alias("page_views"),
        ratio(F.sum("pv"), F.sum("n"), None).alias("avg_pages_per_session"),
        ratio(F.sum("bounced"), F.sum("n"), None).alias("bounce_rate"),
        F.sum("viewed").alias("sessions_with_product_view"), F.sum("carted").alias("sessions_with_add_to_cart"))


def merchant_performance(daily_orders: DataFrame, sessions: DataFrame) -> DataFrame:
    """Orders ⟕ sessions per merchant-day, with rates."""
    j = daily_orders.join(sessions, list(DAY), "left")
    filled = {c: F.coalesce(c, F.lit(0)) for c in (
        "sessions", "unique_visitors", "page_views", "avg_pages_per_session", "bounce_rate",
        "sessions_with_product_view", "sessions_with_add_to_cart")}
    j = j.withColumns(filled)
    return j.withColumns({
        "returning_customers": F.col("ordering_customers") - F.col("new_customers"),
        "new_customer_rate": ratio("new_customers", "ordering_customers"),
        "conversion_rate": ratio("order_count", "sessions"),
        "product_view_rate": ratio("sessions_with_product_view", "sessions"),
        "add_to_cart_rate": ratio("sessions_with_add_to_cart", "sessions"),
        "cart_to_checkout_rate": ratio("order_count", "sessions_with_add_to_cart"),
        "revenue_per_session": ratio("revenue", "sessions"),
        "revenue_per_visitor": ratio("revenue", "unique_visitors"),
        "units_per_order": ratio("units_sold", "order_count"),
    })


def trailing_gmv(daily: DataFrame, asof: str, days: int = 365, value: str = "total_gmv") -> DataFrame:
    """GMV per merchant since ``days`` before the run date, with its tier."""
    since = F.date_sub(as_date(asof), days)
    return daily.filter(F.col("order_date") >= since).groupBy("merchant_id").agg(
        F.sum(value).alias("gmv_12m")).withColumn("calculated_tier", merchant_tier("gmv_12m"))


def merchant_to_date(daily: DataFrame, asof: str, value: str = "total_gmv") -> DataFrame:
    """MTD / QTD / YTD / trailing 12-month GMV per merchant in one aggregation."""
    a, d = as_date(asof), F.col("order_date")
    return daily.filter(d <= a).groupBy("merchant_id").agg(
        sum_if(d >= F.trunc(a, "month"), value).alias("gmv_mtd"),
        sum_if(d >= F.trunc(a, "quarter"), value).alias("gmv_qtd"),
        sum_if(d >= F.trunc(a, "year"), value).alias("gmv_ytd"),
        sum_if(d >= F.add_months(a, -12), value).alias("gmv_12m"))


def sold_between(fact: DataFrame, start: str, end: str) -> DataFrame:
    """Orders dated ``start..end`` without cancelled and refunded ones."""
    return fact.filter(day_window("order_date", start, end) & ~F.col("status").isin("cancelled", "refunded"))
