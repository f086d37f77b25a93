"""Merchant tier, fee, roll-up and lifecycle operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import as_date
from ..functions.guards import ratio
from ..functions.scoring import MERCHANT_TIERS, merchant_tier

# Service level %, rate-limit multiplier, take rate and order per tier.
TIER_TABLE = (
    ("platinum", 99.99, 10, 0.015, 4),
    ("gold", 99.95, 5, 0.020, 3),
    ("silver", 99.9, 2, 0.025, 2),
    ("bronze", 99.5, 1, 0.029, 1),
)


def tier_table(spark: SparkSession) -> DataFrame:
    """Four-row attribute table; constant size, so always safe to broadcast."""
    return spark.createDataFrame(list(TIER_TABLE), "tier string, sla double, rate_multiplier int, take_rate double, rank int")


def tier_variants(gmv: DataFrame, annual: str = "gmv_12m", month: str = "gmv_mtd") -> DataFrame:
    """Tier on each basis: the year's value, its monthly mean, and the value of the month to date."""
    return gmv.withColumns({
        "tier_annual": merchant_tier(annual, "annual_12m"), "tier_monthly": merchant_tier(annual, "monthly_avg"),
        "tier_mtd": merchant_tier(month, "mtd")})


def with_tier_attributes(df: DataFrame, tiers: DataFrame, tier: str = "merchant_tier") -> DataFrame:
    return df.join(F.broadcast(tiers.withColumnRenamed("tier", tier)), tier, "left")


def platform_fees(daily: DataFrame, merchants: DataFrame, tiers: DataFrame, value: str = "total_gmv") -> DataFrame:
    """Fee per merchant: GMV times the tier's take rate."""
    gmv = daily.groupBy("merchant_id").agg(F.sum(value).alias("gmv"))
    m = with_tier_attributes(merchants.select("merchant_id", "merchant_tier"), tiers)
    return gmv.join(m, "merchant_id").withColumn("platform_fee", F.col("gmv").cast("double") * F.col("take_rate"))


def tier_progress(gmv: DataFrame, column: str = "gmv_12m") -> DataFrame:
    """Next tier, GMV still required, and progress %; null at the top tier."""
    v = F.col(column).cast("double")
    order = list(reversed(MERCHANT_TIERS))
    next_tier, need = None, None
    for name, floor in order:
        cond = v < F.lit(float(floor))
        next_tier = F.when(cond, F.lit(name)) if next_tier is None else next_tier.when(cond, F.lit(name))
        need = F.when(cond, F.lit(float(floor))) if need is None else need.when(cond, F.lit(float(floor)))
    return gmv.withColumns({"tier": merchant_tier(column), "next_tier": next_tier, "_need": need}).withColumns({
        "gmv_to_next_tier": F.col("_need") - v, "progress_pct": v / F.col("_need") * 100}).drop("_need")


def tier_history(monthly: DataFrame) -> DataFrame:
    """Intervals of constant tier from monthly GMV: islands over the months of a merchant."""
    w = Window.partitionBy("merchant_id").orderBy("month")
    t = monthly.withColumn("tier", merchant_tier("gmv", "mtd"))
    t = t.withColumn("_new", F.when(F.lag("tier").over(w) == F.col("tier"), 0).otherwise(1))
    t = t.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = t.groupBy("merchant_id", "_run", "tier").agg(F.min("month").alias("valid_from"), F.count(F.lit(1)).alias("months"))
    return spans.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("merchant_id").orderBy("_run"))).drop("_run")


def monthly_gmv(daily: DataFrame, value: str = "total_gmv") -> DataFrame:
    return daily.groupBy("merchant_id", F.trunc("order_date", "month").alias("month")).agg(F.sum(value).alias("gmv"))


def rollup(customers: DataFrame, orders: DataFrame, items: DataFrame, asof: str, days: int = 30) -> DataFrame:
    """Customers, orders, products sold and 30-day revenue per active customer."""
    a = as_date(asof)
    recent = (F.col("created_at") >= F.date_sub(a, days)) & (F.col("created_at") < F.date_add(a, 1))
    c = customers.groupBy("merchant_id").agg(F.count(F.lit(1)).alias("total_customers"))
    per_customer = orders.groupBy("merchant_id", "customer_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(recent, F.col("total_amount"))).alias("rev"),
        F.max(recent.cast("int")).alias("active"))
    o = per_customer.groupBy("merchant_id").agg(
        F.sum("n").alias("total_orders"), F.coalesce(F.sum("rev"), F.lit(0)).alias("revenue_30d"),
        F.sum("active").alias("active_customers_30d"))
    p = items.groupBy("merchant_id").agg(F.countDistinct("product_id").alias("total_products"))
    return c.join(o, "merchant_id", "left").join(p, "merchant_id", "left").withColumn(
        "arpu_30d", ratio("revenue_30d", "active_customers_30d"))


def activity_status(orders: DataFrame, merchants: DataFrame, asof: str, days: int = 90) -> DataFrame:
    """Merchants without an order for ``days`` are churned."""
    last = orders.groupBy("merchant_id").agg(F.max("created_at").alias("last_order_at"))
    idle = F.datediff(as_date(asof), "last_order_at")
    return merchants.select("merchant_id", "status").join(last, "merchant_id", "left").withColumns({
        "idle_days": idle,
        "activity_status": F.when(F.col("status") == "suspended", "suspended")
        .when(idle.isNull() | (idle >= days), "churned").otherwise("active")})


def feature_flag(df: DataFrame, name: str, default: bool = False, column: str = "feature_flags") -> DataFrame:
    """Flag from the JSON settings, or the default where it is not set."""
    value = F.get_json_object(column, f"$.{name}").try_cast("boolean")
    return df.withColumn(f"feature_{name}", F.coalesce(value, F.lit(default)))
