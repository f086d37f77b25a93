"""Product sales, funnel, stock, ranking and catalogue operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import count_if, ratio, zero
from .scale import top_k, with_dense_ranks

KEY = ("merchant_id", "product_id")
# Canonical event names with their accepted aliases.
FUNNEL = {
    "view_count": ("product_view",), "cart_add_count": ("add_to_cart",),
    "checkout_count": ("begin_checkout", "checkout_started"), "purchase_count": ("purchase", "order_completed"),
}


def _first_of_order(items: DataFrame) -> DataFrame:
    """Lines with ``_first``: true on one line of each (order, merchant, product), so that orders are counted by a plain sum.

    Lines joined by order are already dealt by order; they are sorted there, which needs a row's own size and spills,
    while a distinct count holds two hash entries with all sums for nearly every line.
    """
    one = F.row_number().over(Window.partitionBy("order_id", *KEY).orderBy("order_id")) == 1
    return items.withColumn("_first", one & F.col("order_id").isNotNull())


def sales(items: DataFrame) -> DataFrame:
    """Sales per (merchant, product); orders are counted by their first line."""
    return _first_of_order(items).groupBy(*KEY).agg(
        F.sum("total_amount").alias("total_revenue"), F.sum("quantity").alias("total_units_sold"),
        count_if(F.col("_first")).alias("order_count"),
        ratio(F.sum("unit_price"), F.count("unit_price"), None).alias("avg_selling_price"),
        ratio(F.sum("quantity"), F.count("quantity"), None).alias("avg_quantity_per_order"),
        F.sum("discount_amount").alias("total_discounts"), F.max("created_at").alias("last_sold_at"))


def product_events(events: DataFrame, path: str = "$.product_id") -> DataFrame:
    """Product-related events with ``product_id`` read from the JSON properties."""
    names = [n for group in FUNNEL.values() for n in group] + ["remove_from_cart"]
    return events.filter(F.col("event_type").isin(*names)).withColumn(
        "product_id", F.expr(f"try_cast(get_json_object(properties, '{path}') AS BIGINT)"))


def funnel(events: DataFrame) -> DataFrame:
    """Stage counts per product and the four conversion rates."""
    counts = events.groupBy(*KEY).agg(*[
        count_if(F.col("event_type").isin(*names)).alias(out) for out, names in FUNNEL.items()])
    return counts.withColumns({
        "view_to_cart_rate": ratio("cart_add_count", "view_count"),
        "cart_to_checkout_rate": ratio("checkout_count", "cart_add_count"),
        "checkout_to_purchase_rate": ratio("purchase_count", "checkout_count"),
        "overall_conversion_rate": ratio("purchase_count", "view_count"),
    })


def sales_and_funnel(sales_df: DataFrame, funnel_df: DataFrame) -> DataFrame:
    """Products with sales, events or both."""
    return sales_df.join(funnel_df, list(KEY), "full_outer")


def with_stock(df: DataFrame, products: DataFrame, lookback_days: int = 30, keys: Sequence[str] = KEY) -> DataFrame:
    """Velocity, days of stock, stock-out risk and margin; attributes in the same join."""
    cols = [c for c in ("product_name", "sku", "category_path", "product_type", "status", "brand") if c in products.columns]
    inv = products.select(*keys, "inventory_quantity", "low_stock_threshold", "cost", "price", *cols)
    j = df.withColumn("avg_daily_units", F.col("total_units_sold").cast("double") / F.lit(float(lookback_days)))
    j = j.join(inv, list(keys), "left")
    stock = F.when(F.col("avg_daily_units") > 0, F.col("inventory_quantity").cast("double") / F.col("avg_daily_units")).otherwise(F.lit(999.0))
    d = F.col("days_of_stock")
    return j.withColumn("days_of_stock", stock).withColumns({
        "stockout_risk": F.when(d < 7, "critical").when(d < 14, "high").when(d < 30, "medium").otherwise("low"),
        "margin": ratio(F.col("price") - zero("cost"), "price"),
    })


def with_rankings(df: DataFrame) -> DataFrame:
    """Dense ranks per merchant and the performance tier, without one task per merchant."""
    ranked = with_dense_ranks(df, ["merchant_id"], {
        "revenue_rank": "total_revenue", "units_rank": "total_units_sold",
        "conversion_rank": "overall_conversion_rate", "velocity_rank": "avg_daily_units"}, ["product_id"])
    r = F.col("revenue_rank")
    return ranked.withColumn("performance_tier", F.when(r <= 10, "top_10").when(r <= 50, "top_50")
                             .when(r <= 100, "top_100").otherwise("long_tail"))


def price_columns() -> dict[str, Column]:
    """Effective price (a zero sale price does not count), sale flag, whole discount %."""
    sale, price = F.col("sale_price"), F.col("price")
    on_sale = F.coalesce(sale < price, F.lit(False))
    pct = F.floor(F.lit(100) * (price - sale) / F.when(price > 0, price)).cast("int")
    return {
        "current_price": F.coalesce(F.nullif(sale, F.lit(0)), price),
        "is_on_sale": on_sale, "discount_percentage": F.when(on_sale, pct),
    }


def stock_columns(reserved: Column | None = None) -> dict[str, Column]:
    qty = F.col("inventory_quantity") - (reserved if reserved is not None else F.lit(0))
    free = F.greatest(qty, F.lit(0))
    return {
        "available_quantity": free,
        "is_in_stock": (F.col("inventory_policy") == "continue") | F.coalesce(qty > 0, F.lit(False)),
        "is_low_stock": free <= F.col("low_stock_threshold"),
    }


def margin_pct(current: Column) -> Column:
    """Margin % of the current price; null where cost is missing or zero."""
    cost = F.col("cost")
    return F.when(cost > 0, (current - cost).cast("double") / F.when(current > 0, current.cast("double")) * 100)


def top_products(items: DataFrame, k: int = 10) -> DataFrame:
    """Best products per merchant by revenue."""
    s = items.groupBy(*KEY).agg(F.sum("total_amount").alias("revenue"), F.sum("quantity").alias("units"))
    return top_k(s, ["merchant_id"], [F.desc("revenue"), F.asc("product_id")], k)


def popularity(items: DataFrame, products: DataFrame | None = None, category: str | None = None) -> DataFrame:
    """Units per (merchant, product) and score = units / best units of the merchant."""
    u = items.groupBy(*KEY).agg(F.sum("quantity").alias("units"))
    if products is not None and category is not None:
        keep = products.filter(F.col("product_type") == category).select("product_id")
        u = u.join(keep, "product_id", "left_semi")
    best = u.groupBy("merchant_id").agg(F.max("units").alias("_best"))
    return u.join(best, "merchant_id").withColumn("score", ratio("units", "_best")).drop("_best")


def popular_products(scores: DataFrame, k: int = 10) -> DataFrame:
    return top_k(scores, ["merchant_id"], [F.desc("score"), F.asc("product_id")], k)


def rollup(items: DataFrame, events: DataFrame) -> DataFrame:
    """Stored product counters: views, orders, revenue and conversion (4 places).

    Lines and views are summed together instead of being joined; a missing key equals none, so its sides stay apart.
    """
    known = F.col(KEY[0]).isNotNull() & F.col(KEY[1]).isNotNull()
    side = lambda df, no, **sums: df.select(*KEY, F.when(known, 0).otherwise(no).alias("_side"), *[c.alias(n) for n, c in sums.items()])
    lines = side(_first_of_order(items), 1, order_count=F.when(F.col("_first"), 1).otherwise(0), revenue=F.col("total_amount"), view_count=F.lit(0))
    views = side(events.filter(F.col("event_type") == "product_view"), 2, order_count=F.lit(0), revenue=F.lit(None).cast(items.schema["total_amount"].dataType), view_count=F.lit(1))
    j = lines.unionByName(views).groupBy(*KEY, "_side").agg(*[F.sum(c).alias(c) for c in ("order_count", "revenue", "view_count")]).drop("_side").withColumn("revenue", zero("revenue"))
    return j.withColumn("conversion_rate", F.round(ratio("order_count", "view_count"), 4))


def category_levels(products: DataFrame) -> DataFrame:
    """One row per product and ancestor path (``A``, ``A > B``, ...)."""
    parts = F.split("category_path", " > ")
    depth = F.size(parts)
    return products.withColumn("depth", F.explode(F.sequence(F.lit(1), depth))).withColumn(
        "path", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), " > "))


def category_rollup(products: DataFrame) -> DataFrame:
    """Products per category node including its subtree."""
    return category_levels(products).groupBy("path", "depth").agg(
        F.count(F.lit(1)).alias("product_count"), count_if(F.col("status") == "active").alias("active_products"))


def item_features(products: DataFrame, scores: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Item features: category, brand, price, popularity across merchants, vector."""
    pop = scores.groupBy("product_id").agg(F.sum("units").alias("units"), F.max("score").alias("popularity"))
    out = products.select("product_id", F.col("product_type").alias("category"), "brand", "price").join(
        pop, "product_id", "left").withColumns({"units": zero("units"), "popularity": zero("popularity")})
    if vectors is not None:
        out = out.join(vectors.select("product_id", "embedding"), "product_id", "left")
    return out
