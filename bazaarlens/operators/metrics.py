"""Dashboard metrics for all merchants at once.

Distinct sessions, orders and customers are counted by a first grouping on the
thing itself (reduced map-side) and a second on the merchant.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import count_if, pct_change, ratio, sum_if, zero
from .scale import asof_latest, top_k

# Window lengths in seconds and funnel stages in order.
WINDOWS = {"realtime": 300, "hourly": 3600, "daily": 86400, "weekly": 604800, "monthly": 2592000}
STAGES = (("Sessions", None), ("Product Views", "product_view"), ("Add to Cart", "add_to_cart"),
          ("Checkout Started", "begin_checkout"), ("Purchase", "purchase"))


def in_window(events: DataFrame, end: str, window: str | int, ts: str = "received_at", shift: int = 0) -> DataFrame:
    """Events of the window ending at ``end`` (both ends inclusive); ``shift`` windows back."""
    seconds = WINDOWS[window] if isinstance(window, str) else window
    stop = F.lit(end).cast("timestamp_ntz") - F.make_interval(secs=F.lit(seconds * shift).cast("decimal(18,6)"))
    start = stop - F.make_interval(secs=F.lit(seconds).cast("decimal(18,6)"))
    return events.filter((F.col(ts) >= start) & (F.col(ts) <= stop))


def session_flags(events: DataFrame) -> DataFrame:
    """One row per (merchant, session): which stages it reached, its page views."""
    reached = lambda t: F.max(F.when(F.col("event_type") == t, 1).otherwise(0))
    return events.groupBy("merchant_id", "session_id").agg(
        count_if(F.col("event_type") == "page_view").alias("page_views"),
        *[reached(t).alias(f"s{i}") for i, (_, t) in enumerate(STAGES) if t])


def merchant_metrics(events: DataFrame) -> DataFrame:
    """GMV, orders, order value, sessions, page views, conversion %, ARPU per merchant."""
    s = session_flags(events).groupBy("merchant_id").agg(
        F.count("session_id").alias("sessions"), F.sum("page_views").alias("page_views"),
        *[F.sum(f"s{i}").alias(f"stage_{i}") for i, (_, t) in enumerate(STAGES) if t])
    bought = events.filter(F.col("event_type") == "purchase")
    per_order = bought.groupBy("merchant_id", "order_id").agg(F.sum("revenue").alias("revenue"))
    o = per_order.groupBy("merchant_id").agg(F.count("order_id").alias("orders"), F.sum("revenue").alias("gmv"))
    c = bought.select("merchant_id", "customer_id").distinct().groupBy("merchant_id").agg(F.count("customer_id").alias("customers"))
    out = s.join(o, "merchant_id", "left").join(c, "merchant_id", "left").withColumns({
        "gmv": zero("gmv"), "orders": zero("orders"), "customers": zero("customers")})
    return out.withColumns({
        "aov": F.round(ratio("gmv", "orders"), 2), "conversion_rate": F.round(ratio("stage_4", "sessions") * 100, 2),
        "arpu": F.round(ratio("gmv", "customers"), 2),
        "cart_abandonment_rate": F.when(F.col("stage_2") > 0, F.round((F.lit(1.0) - ratio("stage_4", "stage_2")) * 100, 2)).otherwise(F.lit(0.0))})


def funnel(events: DataFrame) -> DataFrame:
    """Five stages per merchant with the rate from the previous stage, drop-off and width."""
    flags = session_flags(events).groupBy("merchant_id").agg(
        F.count("session_id").alias("n0"), *[F.sum(f"s{i}").alias(f"n{i}") for i in range(1, len(STAGES))])
    rows = flags.select("merchant_id", F.explode(F.array(*[
        F.struct(F.lit(i).alias("stage_no"), F.lit(name).alias("stage"), F.col(f"n{i}").alias("sessions"))
        for i, (name, _) in enumerate(STAGES)])).alias("x")).select("merchant_id", "x.*")
    w = Window.partitionBy("merchant_id").orderBy("stage_no")
    prev, nxt, first = F.lag("sessions").over(w), F.lead("sessions").over(w), F.max("sessions").over(Window.partitionBy("merchant_id"))
    return rows.withColumns({
        "step_rate": F.when(prev.isNull(), F.lit(100.0)).otherwise(F.round(ratio("sessions", prev) * 100, 2)),
        "drop_off": F.round(F.when(F.col("sessions") > 0, (F.lit(1.0) - nxt.cast("double") / F.col("sessions")) * 100), 2),
        "bar_width": F.round(ratio("sessions", first) * 100, 2)})


def overall_conversion(funnel_rows: DataFrame) -> DataFrame:
    """Last over first stage, in percent."""
    at = lambda i: F.max(F.when(F.col("stage_no") == i, F.col("sessions")))
    return funnel_rows.groupBy("merchant_id").agg(F.round(ratio(at(len(STAGES) - 1), at(0)) * 100, 2).alias("overall_conversion"))


def long_metrics(metrics: DataFrame, window: str, stamp: str,
                 names: Sequence[str] = ("gmv", "orders", "aov", "conversion_rate", "sessions", "arpu")) -> DataFrame:
    """Metrics in long form: merchant, name, value, window, timestamp."""
    rows = metrics.select("merchant_id", *[F.col(n).cast("double").alias(n) for n in names])
    return rows.unpivot("merchant_id", list(names), "metric_name", "value").withColumns({
        "metric_window": F.lit(window), "timestamp": F.lit(stamp).cast("timestamp_ntz")})


def timeseries(events: DataFrame, granularity: str, start: str, end: str, ts: str = "received_at") -> DataFrame:
    """GMV and orders per merchant and bucket, empty buckets as zero."""
    step = {"minute": "INTERVAL 1 MINUTE", "hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY"}[granularity]
    s, e = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    bucket = F.date_trunc(granularity, F.col(ts)).cast("timestamp_ntz")
    per_order = events.filter((F.col("event_type") == "purchase") & (F.col(ts) >= s) & (F.col(ts) <= e)).groupBy(
        "merchant_id", bucket.alias("bucket"), "order_id").agg(F.sum("revenue").alias("revenue"))
    got = per_order.groupBy("merchant_id", "bucket").agg(F.sum("revenue").alias("gmv"), F.count("order_id").alias("orders"))
    grid = events.select("merchant_id").distinct().withColumn("bucket", F.explode(F.sequence(
        F.date_trunc(granularity, s).cast("timestamp_ntz"), F.date_trunc(granularity, e).cast("timestamp_ntz"), F.expr(step))))
    return grid.join(got, ["merchant_id", "bucket"], "left").withColumns({"gmv": zero("gmv"), "orders": zero("orders")})


def revenue_by(events: DataFrame, dimension: str, k: int | None = None, other: bool = False) -> DataFrame:
    """Revenue per value of a dimension with % share; top ``k`` and optionally the rest as ``Other``."""
    if dimension not in events.columns:
        raise ValueError(f"no column {dimension!r} to break revenue down by")
    seg = events.filter(F.col("event_type") == "purchase").groupBy("merchant_id", F.col(dimension).cast("string").alias("segment")).agg(
        F.sum("revenue").alias("revenue"))
    if k is not None and other:
        best = top_k(seg, ["merchant_id"], [F.desc("revenue"), F.asc("segment")], k).select(
            F.col("merchant_id").alias("_m"), F.col("segment").alias("_s"), F.lit(True).alias("_top"))
        j = seg.join(best, (F.col("merchant_id") == F.col("_m")) & F.col("segment").eqNullSafe(F.col("_s")), "left")
        seg = j.withColumn("segment", F.when(F.col("_top"), F.col("segment")).otherwise("Other")).groupBy("merchant_id", "segment").agg(F.sum("revenue").alias("revenue"))
    total = seg.groupBy("merchant_id").agg(F.sum("revenue").alias("_total"))
    out = seg.join(total, "merchant_id").withColumn("share_pct", F.round(ratio("revenue", "_total") * 100, 2)).drop("_total")
    if k is not None and not other:
        out = top_k(out, ["merchant_id"], [F.desc("revenue"), F.asc("segment")], k).drop("rank")
    return out


def summary(events: DataFrame, end: str, window: str) -> DataFrame:
    """Four headline metrics, their change against the previous window, and the trend."""
    names = ("gmv", "orders", "aov", "conversion_rate")
    cur = merchant_metrics(in_window(events, end, window)).select("merchant_id", *names)
    prev = merchant_metrics(in_window(events, end, window, shift=1)).select("merchant_id", *[F.col(n).alias(f"prev_{n}") for n in names])
    j = cur.join(prev, "merchant_id", "left").withColumns({f"prev_{n}": zero(f"prev_{n}") for n in names})
    j = j.withColumns({f"{n}_change_pct": F.round(pct_change(n, f"prev_{n}", 0.0), 2) for n in names})
    trend = lambda c: F.when(F.col(c) > 0, "up").when(F.col(c) < 0, "down").otherwise("flat")
    return j.withColumns({f"{n}_trend": trend(f"{n}_change_pct") for n in names})


def realtime(events: DataFrame, end: str) -> DataFrame:
    """Last five minutes with the sessions active in the last minute."""
    now = in_window(events, end, "realtime")
    since = F.lit(end).cast("timestamp_ntz") - F.expr("INTERVAL 1 MINUTE")
    active = F.max(F.when(F.col("received_at") >= since, 1).otherwise(0))
    visitors = now.groupBy("merchant_id", "session_id").agg(active.alias("a")).groupBy("merchant_id").agg(F.sum("a").alias("visitors_now"))
    return merchant_metrics(now).select("merchant_id", "gmv", "orders", "sessions").join(visitors, "merchant_id")


def recommendation_ctr(events: DataFrame) -> DataFrame:
    """Impressions (one per shown product), clicks and click rate by placement and strategy."""
    p = lambda f: F.get_json_object("properties", f"$.{f}")
    shown = F.when(F.col("event_type") == "recommendation_view", F.size(F.from_json(p("product_ids"), "array<string>"))).otherwise(0)
    clicks = F.when(F.col("event_type") == "recommendation_click", 1).otherwise(0)
    rec = events.filter(F.col("event_type").isin("recommendation_view", "recommendation_click"))
    return rec.groupBy(p("placement").alias("placement"), p("strategy").alias("strategy")).agg(
        F.sum(shown).alias("impressions"), F.sum(clicks).alias("clicks")).withColumn("ctr", ratio("clicks", "impressions"))


def recommendation_revenue(events: DataFrame, hours: int = 24, ts: str = "received_at") -> DataFrame:
    """Click rate by placement and strategy, with the orders and revenue that recommendation clicks led to.

    A purchase belongs to its user's latest recommendation click of the ``hours`` before it. Purchases without user,
    without a positive revenue or without such a click are not attributed.
    """
    p = lambda f: F.get_json_object("properties", f"$.{f}")
    known = events.filter(F.col("user_id").isNotNull())
    clicks = known.filter(F.col("event_type") == "recommendation_click").select(
        "user_id", F.col(ts).alias("click_ts"), F.col("event_id").alias("click_id"), p("placement").alias("placement"), p("strategy").alias("strategy"))
    orders = known.filter(F.col("event_type") == "purchase").select("event_id", "user_id", F.col(ts).alias("order_ts"), p("revenue").try_cast("decimal(12,2)").alias("revenue")).filter("revenue > 0")
    led = asof_latest(orders, clicks, "user_id", "order_ts", "click_ts", ["placement", "strategy"], "click_id")
    led = led.filter(F.col("touch_at") >= F.col("order_ts") - F.make_interval(hours=F.lit(hours)))
    earned = led.groupBy("placement", "strategy").agg(F.count(F.lit(1)).alias("_orders"), F.sum("revenue").alias("_revenue")).select(
        F.col("placement").alias("_p"), F.col("strategy").alias("_s"), "_orders", "_revenue")
    shown = recommendation_ctr(events)
    both = shown.join(earned, F.col("placement").eqNullSafe(F.col("_p")) & F.col("strategy").eqNullSafe(F.col("_s")), "left")
    return both.select(*shown.columns, F.coalesce("_orders", F.lit(0)).alias("attributed_orders"), zero("_revenue").alias("attributed_revenue"))


def search_ctr(events: DataFrame) -> DataFrame:
    """Searches, clicks, click rate and mean click position per query."""
    p = lambda f: F.get_json_object("properties", f"$.{f}")
    s = events.filter(F.col("event_type").isin("search", "search_click"))
    click = F.col("event_type") == "search_click"
    pos = F.when(click, p("position").try_cast("bigint"))
    return s.groupBy(p("query").alias("query")).agg(
        count_if(F.col("event_type") == "search").alias("searches"), count_if(click).alias("clicks"),
        ratio(F.sum(pos), F.count(pos), None).alias("avg_click_position")).withColumn("ctr", ratio("clicks", "searches"))


def processing_lag(events: DataFrame, limit_seconds: int = 60) -> DataFrame:
    """Receipt lag per merchant: mean, maximum and events over the limit."""
    lag = F.timestamp_diff("SECOND", "ts", "received_at")
    return events.groupBy("merchant_id").agg(
        F.count(F.lit(1)).alias("events"), ratio(F.sum(lag), F.count(lag), None).alias("avg_lag_seconds"),
        F.max(lag).alias("max_lag_seconds"), count_if(lag > limit_seconds).alias("late_events"))


def rule_metrics(events: DataFrame, merchants: DataFrame, end: str) -> DataFrame:
    """Every metric that the default rules name, over each rule's own window, in long form.

    Order counts cover merchants without any event; rates and lags need events.
    """
    hour = in_window(events, end, "hourly")
    orders = merchants.select("merchant_id").distinct().join(
        hour.filter(F.col("event_type") == "purchase").groupBy("merchant_id", "order_id").agg(F.lit(1).alias("_o")).groupBy("merchant_id").agg(F.count("order_id").alias("n")), "merchant_id", "left")
    change = summary(events, end, "hourly").select("merchant_id", F.col("gmv_change_pct").alias("gmv_change_percent"))
    lag = processing_lag(in_window(events, end, "realtime")).select("merchant_id", F.col("avg_lag_seconds").alias("event_processing_lag_seconds"))
    day = merchant_metrics(in_window(events, end, "daily"))
    parts = (long_metrics(orders.select("merchant_id", zero("n").alias("order_count")), "hourly", end, ("order_count",)), long_metrics(change, "hourly", end, ("gmv_change_percent",)),
             long_metrics(day, "daily", end, ("conversion_rate", "cart_abandonment_rate")), long_metrics(lag, "realtime", end, ("event_processing_lag_seconds",)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# The widgets of a dashboard unless others are asked for.
WIDGETS = ("summary", "realtime", "series", "funnel", "top_products", "traffic")


def dashboard(events: DataFrame, end: str, window: str, widgets: Sequence[str] = WIDGETS, product_path: str = "$.product_id") -> DataFrame:
    """One row per merchant with a struct (or array) per widget."""
    if unknown := set(widgets) - set(WIDGETS):
        raise ValueError(f"unknown widgets {sorted(unknown)}")
    now = in_window(events, end, window)
    parts = {}
    if "summary" in widgets:
        s = summary(events, end, window)
        parts["summary"] = s.select("merchant_id", F.struct(*[c for c in s.columns if c != "merchant_id"]).alias("summary"))
    if "funnel" in widgets:
        # At most one row per stage, so the array is of fixed length.
        parts["funnel"] = funnel(now).groupBy("merchant_id").agg(
            F.array_sort(F.collect_list(F.struct("stage_no", "stage", "sessions", "step_rate"))).alias("funnel"))
    if "traffic" in widgets:
        parts["traffic"] = revenue_by(now, "source", 10, other=True).groupBy("merchant_id").agg(
            F.array_sort(F.collect_list(F.struct("segment", "revenue", "share_pct"))).alias("traffic"))
    if "series" in widgets:
        grain = {"realtime": "minute", "hourly": "minute", "daily": "hour", "weekly": "day", "monthly": "day"}[window]
        bucket = F.date_trunc(grain, "received_at").cast("timestamp_ntz")
        # Bounded by the window's bucket count.
        parts["series"] = now.filter(F.col("event_type") == "purchase").groupBy("merchant_id", bucket.alias("bucket")).agg(
            F.sum("revenue").alias("gmv")).groupBy("merchant_id").agg(
            F.array_sort(F.collect_list(F.struct("bucket", "gmv"))).alias("series"))
    if "realtime" in widgets:
        r = realtime(events, end)
        parts["realtime"] = r.select("merchant_id", F.struct(*[c for c in r.columns if c != "merchant_id"]).alias("realtime"))
    if "top_products" in widgets:
        sold = now.filter(F.col("event_type") == "purchase").withColumn("product_id", F.get_json_object("properties", product_path)).filter("product_id is not null")
        best = top_k(sold.groupBy("merchant_id", "product_id").agg(F.sum("revenue").alias("revenue")), ["merchant_id"], [F.desc("revenue"), F.asc("product_id")], 10)
        parts["top_products"] = best.groupBy("merchant_id").agg(F.array_sort(F.collect_list(F.struct("rank", "product_id", "revenue"))).alias("top_products"))
    out = None
    for part in parts.values():
        out = part if out is None else out.join(part, "merchant_id", "left")
    return out
