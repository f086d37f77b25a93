"""Cool-down over segments against a walk over every tick."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from bazaarlens.operators import alerts as A

T0 = datetime(2024, 1, 15, 22, 0)
SCHEMA = "rule_id string, merchant_id long, ts timestamp, value double, is_breached boolean, cooldown_minutes int"


def walk(rows):
    out = []
    for key in {(r[0], r[1]) for r in rows}:
        active, last = False, None
        for rule, merchant, ts, value, breach, cool in sorted((r for r in rows if (r[0], r[1]) == key), key=lambda r: (r[2], r[3], bool(r[4]))):
            active, last, change = A.step(active, last, ts, bool(breach), cool)
            if change:
                out.append((rule, merchant, ts, value, change))
    return sorted(out, key=repr)


@pytest.mark.parametrize("segment", ["hour", "day", "year"])
def test_segments_equal_a_walk(spark, segment):
    rnd = random.Random(31)
    rows = []
    for rule, cool in (("a", 15), ("b", 0), ("c", 200), ("d", 3000)):
        for merchant in (1, 2, None):
            at = T0
            for _ in range(250):
                at += timedelta(minutes=rnd.choice([0, 1, 1, 2, 5, 40]))
                breach = rnd.choice([True, False, None]) if rnd.random() < 0.3 else rnd.random() < 0.5
                rows.append((rule, merchant, at, float(rnd.randint(0, 3)), breach, cool))
    got = A.with_cooldown(spark.createDataFrame(rows, SCHEMA).repartition(6), segment)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == walk(rows)
    assert A.with_cooldown(spark.createDataFrame([], SCHEMA)).count() == 0


def test_minute_ticks_of_one_series_are_many_tasks(spark):
    """Half a year of minutes: ordered and tabulated by day, so no task sorts the series."""
    n = 180 * 1440
    ticks = spark.range(n).select(F.lit("r").alias("rule_id"), F.lit(1).cast("bigint").alias("merchant_id"), (F.lit(T0).cast("timestamp") + F.make_interval(mins=F.col("id").cast("int"))).alias("ts"),
                                  F.lit(0.0).alias("value"), (F.col("id") % 100 < 50).alias("is_breached"), F.lit(70).alias("cooldown_minutes"))
    got = sorted((r["ts"], r["change"]) for r in A.with_cooldown(ticks).collect())
    assert got == [(T0 + timedelta(minutes=100 * (i // 2) + (70 if i % 2 else 0)), "resolved" if i % 2 else "triggered") for i in range(n // 50)][: len(got)]
    assert len(got) in (2 * (n // 100), 2 * (n // 100) + 1)
    tables = A.with_cooldown(ticks)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(series" in tables and "segment" in tables
