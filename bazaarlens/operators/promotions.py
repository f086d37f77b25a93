"""Promotion eligibility, discount, stacking and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import money, zero
from ..session import scratch

PROMOTION_SCHEMA = (
    "promotion_id string, promo_merchant int, discount_type string, discount_value decimal(10,2), max_discount_amount decimal(10,2), "
    "buy_quantity int, get_quantity int, get_discount_percent decimal(5,2), tier_config string, minimum_order_value decimal(10,2), "
    "minimum_quantity int, applicable_product_types array<string>, excluded_product_types array<string>, applicable_customer_tiers array<string>, "
    "first_order_only boolean, total_usage_limit int, per_customer_limit int, is_exclusive boolean, priority int, starts_on date, ends_on date, "
    "promo_status string, applicable_channels array<string>")
STEPS = "array<struct<min: decimal(12,2), discount: decimal(12,2)>>"


def _allowed(targets: str, have: Column) -> Column:
    """A missing or empty target list allows everything."""
    return F.col(targets).isNull() | (F.size(targets) == 0) | have


def eligible(orders: DataFrame, promotions: DataFrame) -> DataFrame:
    """(order, promotion) pairs whose conditions hold.

    Equi join on the merchant: an order meets only its own merchant's active
    promotions, so the output is bounded by orders times promotions per merchant.
    """
    p = promotions.filter(F.col("promo_status") == "active")
    day = F.to_date("created_at")
    return orders.join(p, F.col("merchant_id") == F.col("promo_merchant")).filter(
        (day >= F.col("starts_on")) & (F.col("ends_on").isNull() | (day <= F.col("ends_on")))
        & (F.col("subtotal") >= zero("minimum_order_value")) & (F.col("item_count") >= zero("minimum_quantity"))
        & _allowed("applicable_customer_tiers", F.array_contains("applicable_customer_tiers", F.col("customer_tier")))
        & _allowed("applicable_channels", F.array_contains("applicable_channels", F.col("channel")))
        & _allowed("applicable_product_types", F.arrays_overlap("applicable_product_types", "order_product_types"))
        & ~F.coalesce(F.arrays_overlap("excluded_product_types", "order_product_types"), F.lit(False))
        & (~F.coalesce("first_order_only", F.lit(False)) | F.col("is_first_order")))


def with_discount(pairs: DataFrame) -> DataFrame:
    """Discount by promotion type, never above the subtotal."""
    sub, val = F.col("subtotal"), F.col("discount_value")
    pct = F.least(money(sub * val / F.lit(100)), F.coalesce("max_discount_amount", money(sub)))
    bundle = F.col("buy_quantity") + F.col("get_quantity")
    free = F.floor(F.col("item_count") / bundle) * F.col("get_quantity")
    unit = money(sub / F.col("item_count"))
    reached = F.filter(F.from_json("tier_config", STEPS), lambda s: s["min"] <= sub)
    tiered = F.array_max(F.transform(reached, lambda s: s["discount"]))
    t = F.col("discount_type")
    amount = (F.when(t == "percentage", pct).when(t == "fixed_amount", val).when(t == "free_shipping", F.col("shipping_amount"))
              .when(t == "buy_x_get_y", money(free * unit * F.coalesce("get_discount_percent", F.lit(100)) / F.lit(100))).when(t == "tiered", tiered))
    return pairs.withColumn("discount", money(F.least(zero(amount), F.greatest(sub, F.col("shipping_amount")))))


def stacked(pairs: DataFrame) -> DataFrame:
    """Promotions that apply together: the best exclusive one alone, else all the others.

    One window per order; an order holds at most its merchant's active promotions.
    """
    w = Window.partitionBy("order_id").orderBy(F.desc("priority"), F.asc("promotion_id"))
    best = F.min(F.when(F.col("is_exclusive"), F.col("_rank"))).over(Window.partitionBy("order_id"))
    ranked = pairs.withColumn("_rank", F.row_number().over(w)).withColumn("_best", best)
    return ranked.filter(F.col("_best").isNull() | (F.col("_rank") == F.col("_best"))).drop("_rank", "_best")


def _numbered(rows: DataFrame, keys: list[str], limit: str, name: str, ts: str) -> DataFrame:
    """Uses numbered by time inside ``keys`` and kept up to the row's limit; unlimited rows pass by and keep a null number.

    Only rows of one minute are ordered: the uses before it are a running sum over a
    table with one row per (keys, minute). A promotion used everywhere is spread over
    its minutes, whatever its limit.
    """
    limited = rows.filter(F.col(limit).isNotNull()).withColumn("_slot", F.date_trunc("minute", ts))
    per_slot = limited.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slot.select(*keys, "_slot", zero(F.sum("_c").over(before)).alias("_before"))
    inside = Window.partitionBy(*keys, "_slot").orderBy(ts, "order_id")
    numbered = limited.withColumn("_pos", F.row_number().over(inside)).join(carried, [*keys, "_slot"])
    kept = numbered.withColumn(name, F.col("_before") + F.col("_pos")).filter(F.col(name) <= F.col(limit)).select(*rows.columns, name)
    return kept.unionByName(rows.filter(F.col(limit).isNull()).withColumn(name, F.lit(None).cast(kept.schema[name].dataType)))


def within_usage(applied: DataFrame, promotions: DataFrame | None = None, ts: str = "created_at") -> DataFrame:
    """Uses in order of time, first up to the customer's limit, then up to the total limit.

    The applied pairs are written once in the shared folder, since each limit reads them more than once. A limited
    row without promotion or (for the customer's limit) customer cannot be counted and is left out.
    """
    path = scratch(applied.sparkSession, "applied-promotions")
    applied.write.parquet(path)
    rows = applied.sparkSession.read.schema(applied.schema).parquet(path)
    rows = _numbered(rows, ["promotion_id", "customer_id"], "per_customer_limit", "customer_use", ts)
    return _numbered(rows, ["promotion_id"], "total_usage_limit", "use_number", ts)


def rollup(applied: DataFrame) -> DataFrame:
    return applied.groupBy("promotion_id").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("discount").alias("discount_given"), F.sum("total_amount").alias("attributed_revenue"))
