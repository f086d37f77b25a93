import os
import time
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from bazaarlens.operators import alerts as A
from bazaarlens.operators.scale import sessionize
from bazaarlens.sources.connectors import from_stream
from bazaarlens.sources.entities import events as all_events
from bazaarlens.sources.entities import raw_payloads
from bazaarlens.sources.warehouse import Warehouse
from bazaarlens.streaming import alerts as SA
from bazaarlens.streaming import ingest as SI
from bazaarlens.streaming import reports as SR
from bazaarlens.streaming import windows as SW

T0 = datetime(2024, 1, 1)


def age_in_order(path, names):
    """Give files rising modification times: the file source reads them in that order."""
    for n, name in enumerate(names):
        os.utime(f"{path}/{name}", (time.time() - 1000 + n * 10,) * 2)


def parts(path):
    return sorted(f for f in os.listdir(path) if f.endswith(".parquet"))


@pytest.fixture
def source(spark, sf, tmp_path):
    """Events split into time-ordered files, as a stream and as a table."""
    df = all_events(spark, sf)
    path = str(tmp_path / "events")
    df.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
    age_in_order(path, parts(path))
    return from_stream(spark, path, df.schema, max_files_per_trigger=1), spark.read.parquet(path)


def drain(stream, tmp_path, name, mode="append"):
    """Run to the end and return what the sink received."""
    out = str(tmp_path / name)
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"{name}_cp"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def test_tumbling_equals_batch_up_to_the_watermark(source, tmp_path):
    stream, table = source
    got = drain(SW.tumbling(stream, "1 hour"), tmp_path, "w").select("merchant_id", F.col("window_start").cast("string"), "events", "revenue")
    want = table.groupBy("merchant_id", F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("revenue")).select(
        "merchant_id", F.col("w.start").cast("string").alias("window_start"), "events", "revenue")
    g, w = set(rows(got)), set(rows(want))
    assert g <= w and len(w - g) <= 5 and len(g) > 100


def test_sessions_equal_batch_up_to_the_watermark(source, tmp_path):
    stream, table = source
    got = {(r[0], r[1], r[2]) for r in rows(drain(SW.sessions(stream), tmp_path, "s"), "customer_id", "session_start", "event_count")}
    want = {(r[0], r[1], r[2]) for r in rows(sessionize(table, ["merchant_id", "customer_id"]), "customer_id", "session_start", "event_count")}
    assert got <= want and len(want - got) <= 10


def test_duplicates_are_dropped(spark, tmp_path):
    data = [(i % 5, T0 + timedelta(minutes=i % 5)) for i in range(15)]
    spark.createDataFrame(data, "event_id long, ts timestamp_ntz").repartition(3).write.parquet(str(tmp_path / "d"))
    stream = from_stream(spark, str(tmp_path / "d"), "event_id long, ts timestamp_ntz", max_files_per_trigger=1)
    assert rows(drain(SI.deduplicated(stream), tmp_path, "dd"), "event_id") == [(i,) for i in range(5)]


def test_sliding_active_sessions_runs(source, tmp_path):
    stream, _ = source
    assert drain(SW.active_sessions(stream), tmp_path, "a").filter("active_sessions < 1").isEmpty()


def test_ingest_splits_and_resumes(spark, sf, tmp_path):
    raw = raw_payloads(spark, sf)
    raw.repartition(3).write.parquet(str(tmp_path / "raw"))
    stream = from_stream(spark, str(tmp_path / "raw"), raw.schema, max_files_per_trigger=2)
    good, bad, cp = (str(tmp_path / n) for n in ("good", "bad", "cp"))
    for _ in range(2):  # the second run resumes from the checkpoint and finds nothing new
        SI.ingest(stream, ["event_id"], good, bad, cp, every=None).awaitTermination()
        g, b = spark.read.parquet(good), spark.read.parquet(bad)
        assert g.count() + b.count() == raw.count() and g.count() > 0 and b.count() > 0
        assert g.select("id").distinct().count() == g.count()


def test_replayed_batch_leaves_one_copy(spark, tmp_path):
    df = spark.range(10)
    for _ in range(2):
        SI.write_batch(df, str(tmp_path / "b"), 7)
    SI.write_batch(df, str(tmp_path / "b"), 8)
    assert spark.read.parquet(str(tmp_path / "b")).count() == 20


def test_stream_upsert(spark, tmp_path):
    data = [(f"k{i % 4}", i, i) for i in range(20)]
    spark.createDataFrame(data, "id string, value int, version int").repartition(4).write.parquet(str(tmp_path / "u"))
    wh = Warehouse(spark, str(tmp_path / "wh"))
    stream = from_stream(spark, str(tmp_path / "u"), "id string, value int, version int")
    SI.upsert(stream, wh, "t", ["id"], ["version"], str(tmp_path / "ucp")).awaitTermination()
    assert rows(wh.read("t"), "id", "value") == [("k0", 16), ("k1", 17), ("k2", 18), ("k3", 19)]


def _checks(spark, minutes_and_flags, cool=15):
    data = [("r", 1, T0 + timedelta(minutes=m), float(b), b, cool) for m, b in minutes_and_flags]
    return spark.createDataFrame(data, "rule_id string, merchant_id long, ts timestamp, value double, is_breached boolean, cooldown_minutes int")


# breach, still breach, good inside cool-down, good after, breach inside no cool-down of the second alert, good, breach after
SERIES = [(0, True), (5, True), (10, False), (14, False), (15, False), (16, True), (20, False), (31, False), (40, True)]
WANT = [(0, "triggered"), (15, "resolved"), (16, "triggered"), (31, "resolved"), (40, "triggered")]


def test_cooldown_in_batch_and_stream_agree(spark, tmp_path):
    checks = _checks(spark, SERIES)
    batch = rows(A.with_cooldown(checks), "ts", "change")
    assert batch == [(T0 + timedelta(minutes=m), c) for m, c in WANT]
    path = str(tmp_path / "c")
    for i in range(0, len(SERIES), 3):
        _checks(spark, SERIES[i:i + 3]).coalesce(1).write.mode("append").parquet(path)
    age_in_order(path, sorted(parts(path), key=lambda f: spark.read.parquet(f"{path}/{f}").agg(F.min("ts")).first()[0]))
    stream = from_stream(spark, path, checks.schema, max_files_per_trigger=1)
    assert rows(drain(SA.changes(stream), tmp_path, "out"), "ts", "change") == batch


def test_alert_state_survives_a_restart_and_idle_keys_vanish(spark, tmp_path):
    """Two runs over one checkpoint; the key that falls silent expires, the resolved one leaves no state."""
    path, out = str(tmp_path / "c"), str(tmp_path / "o")
    first = [("r", 1, 0, True), ("r", 2, 0, True), ("q", 1, 3, True)]
    later = [("r", 1, 10, False), ("r", 1, 20, True), ("q", 1, 30, False)]
    much_later = [("r", 1, 600, True), ("z", 9, 900, False)]
    end = [("z", 9, 1200, False)]

    def add(rows):
        spark.createDataFrame([(k, m, T0 + timedelta(minutes=t), 1.0, b, 15) for k, m, t, b in rows], "rule_id string, merchant_id long, ts timestamp, value double, is_breached boolean, cooldown_minutes int").coalesce(
            1).write.mode("append").parquet(path)

    def run():
        stream = from_stream(spark, path, "rule_id string, merchant_id long, ts timestamp, value double, is_breached boolean, cooldown_minutes int")
        q = SA.changes(stream, idle="5 hours").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        progress = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        return progress[-1] if progress else None
    for rows_ in (first, later, much_later, end):
        add(rows_)
        left = run()
    got = rows(spark.read.parquet(out), "rule_id", "merchant_id", "ts", "change")
    at = lambda m: T0 + timedelta(minutes=m)
    assert [g for g in got if g[0] == "q"] == [("q", 1, at(3), "triggered"), ("q", 1, at(30), "resolved")]
    assert [g for g in got if g[1] == 2] == [("r", 2, at(0), "triggered"), ("r", 2, at(300), "expired")]
    # r/1 ticked at 20 inside no cool-down of its own: still active from 0, so nothing new; silent until 600, it expires at 320.
    assert [g[2:] for g in got if g[:2] == ("r", 1)][:1] == [(at(0), "triggered")]
    assert left is not None and left <= 3


def test_streamed_sessions_are_exact(spark, tmp_path):
    data = [(1, f"s{i % 5}", T0 + timedelta(seconds=37 * i)) for i in range(60)] + [(2, "s0", T0), (2, None, T0), (1, "s0", T0 + timedelta(hours=5))]
    path = str(tmp_path / "a")
    spark.createDataFrame(data, "merchant_id int, session_id string, ts timestamp").repartition(3).write.parquet(path)
    stream = from_stream(spark, path, "merchant_id int, session_id string, ts timestamp")
    got = {(r.merchant_id, r.window_start): r.active_sessions for r in drain(SW.exact_active_sessions(stream), tmp_path, "act").collect()}
    want = {}
    for m, s, t in data:
        for k in range(5):
            start_ = t.replace(second=0, microsecond=0) - timedelta(minutes=k)
            if s is not None and start_ + timedelta(minutes=5) <= T0 + timedelta(hours=5) - timedelta(minutes=10):
                want.setdefault((m, start_), set()).add(s)
    assert got == {k: len(v) for k, v in want.items()}


def test_late_rows_by_state_of_earlier_batches(spark, tmp_path):
    path, out = str(tmp_path / "l"), str(tmp_path / "lo")
    batches = [[(1, 0), (2, 0)], [(1, 200), (None, 5)], [(1, 10), (2, 10), (1, 199), (None, 3), (2, None)]]
    for batch in batches:
        spark.createDataFrame([(m, t, None if t is None else T0 + timedelta(minutes=t)) for m, t in batch], "merchant_id int, minute int, ts timestamp").coalesce(1).write.mode("append").parquet(path)
        SI.divert_late(from_stream(spark, path, "merchant_id int, minute int, ts timestamp"), out, str(tmp_path / "lcp")).awaitTermination()
    both = {s: rows(spark.read.parquet(f"{out}/{s}"), "merchant_id", "minute") for s in ("on_time", "late")}
    assert both["late"] == [(1, 10), (2, None)]
    assert len(both["on_time"]) + len(both["late"]) == sum(map(len, batches))


def test_rule_operators(spark):
    df = spark.createDataFrame([("gt", 1.0), ("gte", 2.0), ("lt", 3.0), ("lte", 2.0), ("eq", 2.0), ("neq", 2.0), ("odd", 2.0)], "o string, t double")
    assert [r[0] for r in df.select(A.breached(F.lit(2.0), F.col("o"), F.col("t"))).collect()] == [True, True, True, True, True, False, None]


def test_rules_by_merchant_disabled_and_null(spark):
    rules = spark.createDataFrame([("a", "A", "m", "gt", 1.0, "daily", "info", 15, True, 1), ("b", "B", "m", "gt", 1.0, "daily", "info", 15, False, None)], A.RULE_SCHEMA)
    metrics = spark.createDataFrame([(1, "m", 2.0), (2, "m", 2.0), (1, "m", None)], "merchant_id long, metric_name string, value double")
    assert rows(A.evaluate(metrics, rules), "rule_id", "merchant_id", "is_breached") == [("a", 1, True)]


def test_late_rows_go_aside(spark):
    df = spark.createDataFrame([(1, T0), (2, T0 + timedelta(hours=2)), (3, T0 + timedelta(minutes=70))], "i int, ts timestamp")
    fresh, late = SI.split_late(df)
    assert rows(fresh, "i") == [(2,), (3,)] and rows(late, "i") == [(1,)]
    gaps = spark.createDataFrame([(1, T0), (2, None)], "i int, ts timestamp")
    fresh, late = SI.split_late(gaps)
    assert rows(fresh, "i") == [(1,)] and rows(late, "i") == [(2,)]
    fresh, late = SI.split_late(gaps.filter("i = 2"))
    assert rows(fresh, "i") == [] and rows(late, "i") == [(2,)]


def test_over_limit_reports(spark):
    df = spark.createDataFrame([(1, T0), (1, T0), (1, T0), (2, T0)], "merchant_id int, ts timestamp_ntz")
    assert rows(SR.over_limit(df, limit=2), "merchant_id", "events") == [(1, 3)]
    tiers = spark.createDataFrame([(1, 3), (2, 1)], "merchant_id int, rate_multiplier int")
    assert rows(SR.over_tier_limit(df, tiers, per_minute=1)) == []
