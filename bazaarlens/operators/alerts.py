"""Alert rules, their state over time, and anomaly detectors."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RULE_SCHEMA = ("rule_id string, rule_name string, metric string, operator string, threshold double, window string, "
               "severity string, cooldown_minutes int, enabled boolean, rule_merchant bigint")
# The default rules.
DEFAULT_RULES = (
    ("gmv_drop", "Significant GMV Drop", "gmv_change_percent", "lt", -20.0, "hourly", "warning", 15, True, None),
    ("zero_orders", "No Orders Received", "order_count", "eq", 0.0, "hourly", "critical", 15, True, None),
    ("low_conversion", "Low Conversion Rate", "conversion_rate", "lt", 1.0, "daily", "warning", 15, True, None),
    ("processing_lag", "Event Processing Lag", "event_processing_lag_seconds", "gt", 60.0, "realtime", "critical", 15, True, None),
    ("cart_abandonment", "High Cart Abandonment", "cart_abandonment_rate", "gt", 80.0, "daily", "info", 15, True, None),
)


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DEFAULT_RULES), RULE_SCHEMA)


def breached(value: Column | str, operator: Column | str, threshold: Column | str) -> Column:
    v, o, t = (F.col(x) if isinstance(x, str) else x for x in (value, operator, threshold))
    return (F.when(o == "gt", v > t).when(o == "gte", v >= t).when(o == "lt", v < t)
            .when(o == "lte", v <= t).when(o == "eq", v == t).when(o == "neq", v != t))


def evaluate(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules against long-form metrics (merchant_id, metric_name, value and, if present, metric_window).

    A rule meets the metric of its name and window, a rule without a merchant those of
    all merchants; null values are not evaluated. The rule list is part of the program
    (tens of rows), so it is read once and stands in the plan as a literal: no join.
    """
    fields = [f for f in rules.schema.fields if f.name != "enabled"]
    listed = [F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f"_{f.name}") for f in fields]) for r in rules.filter("enabled").collect()]
    if not listed:
        listed = [F.struct(*[F.lit(None).cast(f.dataType).alias(f"_{f.name}") for f in fields])]
    windowed = "metric_window" in metrics.columns

    def applies(r: Column) -> Column:
        fits = (r["_metric"] == F.col("metric_name")) & (r["_rule_merchant"].isNull() | (r["_rule_merchant"] == F.col("merchant_id")))
        return fits & (r["_window"] == F.col("metric_window")) if windowed else fits
    j = metrics.filter(F.col("value").isNotNull()).withColumn("_rule", F.explode(F.filter(F.array(*listed), applies)))
    j = j.select(*metrics.columns, *[F.col(f"_rule._{f.name}").alias(f.name) for f in fields if f.name != "window"])
    return j.withColumn("is_breached", breached("value", "operator", "threshold"))


def transitions(checks: DataFrame, ts: str = "ts") -> DataFrame:
    """Trigger and resolve points without cool-down. One row per evaluation tick."""
    w = Window.partitionBy("rule_id", "merchant_id").orderBy(ts)
    was = F.coalesce(F.lag("is_breached").over(w), F.lit(False))
    return checks.withColumn("change", F.when(F.col("is_breached") & ~was, "triggered").when(~F.col("is_breached") & was, "resolved")).filter(
        F.col("change").isNotNull())


def incidents(checks: DataFrame, ts: str = "ts") -> DataFrame:
    """One row per run of consecutive breaches: start, resolution (null if open), ticks."""
    w = Window.partitionBy("rule_id", "merchant_id").orderBy(ts)
    starts = F.when(F.col("is_breached") & ~F.coalesce(F.lag("is_breached").over(w), F.lit(False)), 1).otherwise(0)
    ends = F.lead(ts).over(w)
    run = checks.withColumn("_s", starts).withColumn("_next", ends).withColumn("_run", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.filter("is_breached").groupBy("rule_id", "merchant_id", "_run").agg(
        F.min(ts).alias("triggered_at"), F.max_by("_next", F.col(ts)).alias("resolved_at"), F.count(F.lit(1)).alias("ticks"),
        F.max_by("value", F.col(ts)).alias("last_value")).drop("_run")


CHANGE_SCHEMA = "rule_id string, merchant_id bigint, ts timestamp, value double, change string"


def step(active: bool, last: datetime | None, at: datetime, breach: bool, cooldown_minutes: int) -> tuple[bool, datetime | None, str | None]:
    """One evaluation of one (rule, merchant): new state and what happened.

    Inside the cool-down after a trigger nothing is evaluated, not even a resolve.
    """
    if last is not None and at - last < timedelta(minutes=cooldown_minutes):
        return active, last, None
    if breach and not active:
        return True, at, "triggered"
    if not breach and active:
        return False, last, "resolved"
    return active, last, None


def jumps(at: np.ndarray, breach: np.ndarray, cool: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a state moves on within a run of ordered ticks, whatever state the run is entered in.

    Per tick (and for the end of the run): the next breach, the next tick without one, and the first
    tick that is evaluated again after a trigger here. From these every entry state leads to its exit state and its
    changes in as many steps as there are changes.
    """
    m = len(at)
    place = np.arange(m)
    ahead = lambda flags: np.append(np.minimum.accumulate(np.where(flags, place, m)[::-1])[::-1], m).astype(np.int32)
    return ahead(breach), ahead(~breach), np.maximum(np.searchsorted(at, at + cool, side="left"), place + 1).astype(np.int32)


TABLE = ("series string, rule_id string, merchant_id bigint, segment timestamp, cool bigint, at array<bigint>, value array<double>, "
         "next_breach array<int>, next_good array<int>, resume array<int>")


def _tabulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per segment of ordered ticks; a segment may begin in one batch and end in the next."""
    def table(own: pd.DataFrame) -> tuple:
        at, cool, first = own["ts"].to_numpy().astype("datetime64[us]").astype(np.int64), int(own["cooldown_minutes"].iloc[0]) * 60_000_000, own.iloc[0]
        return (first["series"], first["rule_id"], first["merchant_id"], first["segment"], cool, at, own["value"].to_numpy(dtype=float), *jumps(at, own["is_breached"].to_numpy(dtype=bool), cool))

    names, held = [c.split()[0] for c in TABLE.split(", ")], None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if rows.empty:
            continue
        series, segment = rows["series"].to_numpy(), rows["segment"].to_numpy()
        cuts = (np.flatnonzero((series[1:] != series[:-1]) | (segment[1:] != segment[:-1])) + 1).tolist()
        held = rows.iloc[cuts[-1] if cuts else 0 :]
        yield pd.DataFrame([table(rows.iloc[a:b]) for a, b in zip([0, *cuts], cuts)], columns=names)
    if held is not None:
        yield pd.DataFrame([table(held)], columns=names)


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Changes of every series, its segments following each other; the state between two of them is a flag and a time."""
    series, active, until = None, False, None
    for batch in batches:
        rows = []
        for t in batch.itertuples(index=False):
            if t.series != series:
                series, active, until = t.series, False, None
            j, m = 0 if until is None else int(np.searchsorted(t.at, until, side="left")), len(t.at)
            while True:
                k = int((t.next_good if active else t.next_breach)[j])
                if k == m:
                    break
                rows.append((t.rule_id, t.merchant_id, pd.Timestamp(int(t.at[k]), unit="us"), t.value[k], "resolved" if active else "triggered"))
                if active:
                    active, j = False, k + 1
                else:
                    active, j, until = True, int(t.resume[k]), int(t.at[k]) + t.cool
        yield pd.DataFrame(rows, columns=["rule_id", "merchant_id", "ts", "value", "change"])


def with_cooldown(checks: DataFrame, segment: str = "day") -> DataFrame:
    """Exact trigger / resolve history with cool-down.

    The decision at a tick depends on the last trigger, so a series has to be read in order; but a segment of it
    (``segment``: a date_trunc unit) becomes a function of the state it is entered in before that state is known.
    Segments are ordered and tabulated in parallel, however many ticks one series has; then each series is
    folded over its segments, which takes a step per change instead of one per tick, and holds one segment at a time.

    Ticks of one time go by value; an unknown outcome counts as no breach; a rule's cool-down is constant.
    """
    cols = checks.select(F.concat_ws("|", F.coalesce(F.col("merchant_id").cast("string"), F.lit("")), "rule_id").alias("series"), "rule_id", F.col("merchant_id").cast("bigint").alias("merchant_id"),
                         F.date_trunc(segment, F.col("ts").cast("timestamp")).alias("segment"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"),
                         F.coalesce("is_breached", F.lit(False)).alias("is_breached"), F.col("cooldown_minutes").cast("int").alias("cooldown_minutes"))
    ticks = cols.repartition("series", "segment").sortWithinPartitions("series", "segment", "ts", "value", "is_breached")
    tables = ticks.mapInPandas(_tabulate, TABLE)
    return tables.repartition("series").sortWithinPartitions("series", "segment").mapInPandas(_fold, CHANGE_SCHEMA)


def outliers(daily: DataFrame, value: str, ts: str = "order_date", trailing: int = 30, limit: float = 3.0) -> DataFrame:
    """Points more than ``limit`` standard deviations from the trailing mean (itself excluded)."""
    w = Window.partitionBy("merchant_id").orderBy(ts).rowsBetween(-trailing, -1)
    v = F.col(value).cast("double")
    mean, sd, n = F.avg(v).over(w), F.stddev_samp(v).over(w), F.count(v).over(w)
    z = F.when((sd > 0) & (n >= 2), (v - mean) / sd)
    return daily.withColumn("z_score", z).withColumn("is_outlier", F.coalesce(F.abs(F.col("z_score")) > limit, F.lit(False)))


def trend(daily: DataFrame, value: str, ts: str = "order_date", trailing: int = 7) -> DataFrame:
    """Least-squares slope per row over the trailing rows."""
    w = Window.partitionBy("merchant_id").orderBy(ts)
    x = F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("double")
    frame = w.rowsBetween(-(trailing - 1), 0)
    return daily.withColumn("slope", F.regr_slope(F.col(value).cast("double"), x).over(frame))


def covered(events: DataFrame, unit: str = "hour", ts: str = "ts") -> tuple[datetime, datetime]:
    """First and last bucket of the events there are (two values reach the driver)."""
    bucket = F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz")
    return tuple(events.agg(F.min(bucket), F.max(bucket)).first())


def missing_heartbeats(events: DataFrame, start: str | datetime, end: str | datetime, ts: str = "ts", merchants: DataFrame | None = None) -> DataFrame:
    """Merchant-hours without a single event, of ``merchants`` or else of all that have events."""
    s, e = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    everyone = (events if merchants is None else merchants).select("merchant_id").distinct()
    grid = everyone.withColumn("hour", F.explode(F.sequence(s, e, F.expr("INTERVAL 1 HOUR"))))
    seen = events.select("merchant_id", F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour")).distinct()
    return grid.join(seen, ["merchant_id", "hour"], "left_anti")


def acknowledge(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Apply acknowledgements (rule, merchant, by, at) to open alerts."""
    a = acks.select("rule_id", "merchant_id", F.col("acknowledged_by"), F.col("acknowledged_at"))
    open_ = F.col("resolved_at").isNull() & F.col("acknowledged_at").isNotNull()
    return alerts.join(a, ["rule_id", "merchant_id"], "left").withColumns({
        "status": F.when(F.col("resolved_at").isNotNull(), "resolved").when(open_, "acknowledged").otherwise("active"),
        "acknowledged_by": F.when(open_, F.col("acknowledged_by")), "acknowledged_at": F.when(open_, F.col("acknowledged_at"))})


def page(df: DataFrame, *order: Column, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of a totally ordered table."""
    out = df.orderBy(*order)
    return (out.offset(offset) if offset else out).limit(limit)
