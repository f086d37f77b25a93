"""Reports that run unchanged on batch and streaming event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def over_limit(events: DataFrame, ts: str = "ts", width: str = "1 second", limit: int = 10_000) -> DataFrame:
    """Merchant windows holding more events than the ingest limit."""
    return events.groupBy("merchant_id", F.window(ts, width)["start"].alias("bucket")).agg(
        F.count(F.lit(1)).alias("events")).filter(F.col("events") > limit)


def over_tier_limit(events: DataFrame, tiers: DataFrame, per_minute: int = 1000, ts: str = "ts") -> DataFrame:
    """Merchant minutes above the tier's share of the per-minute limit."""
    counts = events.groupBy("merchant_id", F.window(ts, "1 minute")["start"].alias("bucket")).agg(F.count(F.lit(1)).alias("events"))
    return counts.join(tiers, "merchant_id").filter(F.col("events") > F.col("rate_multiplier") * per_minute)


def retained(events: DataFrame, asof: str, days: int = 90, ts: str = "ts") -> DataFrame:
    """Events inside the retention period, as a range predicate that reaches the scan."""
    return events.filter(F.col(ts) >= F.date_sub(F.lit(asof).cast("date"), days))
