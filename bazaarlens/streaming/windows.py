"""Event-time windows and sessions on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ingest import event_time


def tumbling(events: DataFrame, width: str, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Events and revenue per merchant and window."""
    return event_time(events, ts).withWatermark(ts, delay).groupBy("merchant_id", F.window(ts, width).alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.sum("value").alias("revenue")).select(
        "merchant_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events", "revenue")


def sessions(events: DataFrame, gap: str = "30 minutes", ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Sessions per merchant and customer, closed by a pause longer than ``gap``.

    With ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition``
    on, open sessions are merged before the shuffle, which thins a hot customer.
    """
    t = F.col("event_type")
    n = lambda name: F.sum(F.when(t == name, 1).otherwise(0))
    return event_time(events, ts).withWatermark(ts, delay).groupBy("merchant_id", "customer_id", F.session_window(ts, gap).alias("w")).agg(
        F.count(F.lit(1)).alias("event_count"), n("page_view").alias("page_views"), n("product_view").alias("product_views"),
        n("add_to_cart").alias("cart_adds")).select(
        "merchant_id", "customer_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"),
        "event_count", "page_views", "product_views", "cart_adds")


def active_sessions(events: DataFrame, width: str = "5 minutes", slide: str = "1 minute", ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Approximate distinct sessions per sliding window (streams allow no exact distinct)."""
    return event_time(events, ts).withWatermark(ts, delay).groupBy("merchant_id", F.window(ts, width, slide).alias("w")).agg(
        F.approx_count_distinct("session_id").alias("active_sessions")).select(
        "merchant_id", F.col("w.start").alias("window_start"), "active_sessions")


def exact_active_sessions(events: DataFrame, width: str = "5 minutes", slide: str = "1 minute", ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Distinct sessions per merchant and sliding window, exactly: two stateful operators in a row.

    The first keeps the (merchant, window, session) combinations of the windows still open and passes each on once; the
    second counts them by window. Both forget a window when the watermark passes its end, when its count is emitted.
    """
    marked = event_time(events, ts).withWatermark(ts, delay).filter(F.col("session_id").isNotNull())
    seen = marked.select("merchant_id", "session_id", F.window(ts, width, slide).alias("w")).dropDuplicates(["merchant_id", "session_id", "w"])
    return seen.groupBy("merchant_id", "w").agg(F.count(F.lit(1)).alias("active_sessions")).select("merchant_id", F.col("w.start").alias("window_start"), "active_sessions")
