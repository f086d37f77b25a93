"""Alert state on a stream of rule evaluations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.alerts import CHANGE_SCHEMA, step

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class AlertState(StatefulProcessor):
    """One value per (rule, merchant) with an active alert: when it was triggered, and when its cool-down ends.

    An alert resolves only after its cool-down, so a key without an active alert is as good as new and holds no state: it
    is dropped with the resolution. ``idle_ms``: an active alert whose key sends no tick for so long (event
    time) expires by a timer, which emits the change and drops the state too.
    """

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alert = handle.getValueState("alert", "triggered_at bigint, value double")

    def _timers(self, newest_ms: int | None) -> None:
        if self.idle_ms is None:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if newest_ms is not None:
            self.handle.registerTimer(newest_ms + self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        active = self.alert.exists()
        last = pd.Timestamp(self.alert.get()[0], unit="us") if active else None
        ticks = pd.concat(list(rows)).sort_values(["ts", "value", "is_breached"], kind="stable")
        out, held = [], active
        for at, value, breach, cool in zip(ticks["ts"], ticks["value"], ticks["is_breached"], ticks["cooldown_minutes"]):
            active, last, change = step(active, last, at, bool(breach), int(cool))
            if change:
                out.append((key[0], key[1], at, value, change))
        if active:
            self.alert.update((int(last.value // 1000), float(out[-1][3]) if out else 0.0))
            self._timers(int(ticks["ts"].iloc[-1].value // 1_000_000))
        elif held:
            self.alert.clear()
            self._timers(None)
        yield pd.DataFrame(out, columns=["rule_id", "merchant_id", "ts", "value", "change"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.alert.exists():
            self.alert.clear()
            out.append((key[0], key[1], pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms"), None, "expired"))
        yield pd.DataFrame(out, columns=["rule_id", "merchant_id", "ts", "value", "change"])

    def close(self) -> None:
        pass


def changes(checks: DataFrame, idle: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """Trigger and resolve events with cool-down, as ``with_cooldown`` gives them for a table.

    Ticks of a (rule, merchant) have to arrive in order; inside a micro-batch they are put in order. With ``idle``
    (an interval) alerts whose key falls silent for so long after the watermark (``delay`` behind the newest tick)
    expire. State is kept in RocksDB, which this sets for queries started later in the session.
    """
    spark = checks.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    cols = checks.select("rule_id", F.col("merchant_id").cast("bigint").alias("merchant_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"),
                         F.coalesce("is_breached", F.lit(False)).alias("is_breached"), F.col("cooldown_minutes").cast("int").alias("cooldown_minutes"))
    idle_ms = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)
    if idle_ms is not None:
        cols = cols.withWatermark("ts", delay)
    return cols.groupBy("rule_id", "merchant_id").transformWithStateInPandas(
        AlertState(idle_ms), CHANGE_SCHEMA, "Append", "None" if idle_ms is None else "EventTime")
