"""Checked queries over sinks and streams: written whole, then read back."""

from __future__ import annotations

import time
from datetime import datetime

from pyspark.sql import functions as F

from ..session import scratch
from ..sources import connectors as CX
from ..sources import entities as E
from ..sources.warehouse import Warehouse, run_job
from ..streaming import alerts as SA
from ..streaming import ingest as SI
from ..streaming import windows as SW
from . import behaviour as B
from . import sql_entities as Q
from .core import query


def _small_orders(spark, root):
    return E.raw_orders(spark, root).select("order_id", "customer_id", "status", "total_amount", "created_at", "updated_at").withColumn(
        "order_year", F.year("created_at"))


YEARS = "SELECT year(created_at) AS order_year, count(*) AS n, sum(total_amount) AS total FROM ord GROUP BY 1"
YSPEC = "order_year:i n:i total:m"


def _by_year(df):
    return df.groupBy("order_year").agg(F.count(F.lit(1)).alias("n"), F.sum("total_amount").alias("total"))


@query("io02_partitioned_write", YSPEC, YEARS, (Q.ORDERS,))
@query("io20_compressed_partitioned_load", YSPEC, YEARS, (Q.ORDERS,))
def _(spark, root):
    wh = Warehouse(spark, scratch(spark, "io02"))
    wh.write(_small_orders(spark, root), "marts.orders", "overwrite", ["order_year"], compression="snappy")
    return _by_year(wh.read("marts.orders"))


@query("io04_partition_overwrite", YSPEC, "SELECT * FROM (SELECT order_year, n, CASE WHEN order_year = 1998 THEN 2 * total ELSE total END AS total FROM (" + YEARS + "))", (Q.ORDERS,))
def _(spark, root):
    wh, o = Warehouse(spark, scratch(spark, "io04")), _small_orders(spark, root)
    wh.write(o, "t", "overwrite", ["order_year"])
    redone = o.filter("order_year = 1998").withColumn("total_amount", (F.col("total_amount") * 2).cast("decimal(12,2)"))
    wh.write(redone, "t", "overwrite_partitions", ["order_year"])
    return _by_year(wh.read("t"))


@query("io05_full_refresh", YSPEC, YEARS, (Q.ORDERS,))
def _(spark, root):
    wh, o = Warehouse(spark, scratch(spark, "io05")), _small_orders(spark, root)
    wh.write(o.filter("order_year = 1998"), "t", "overwrite")
    wh.write(o, "t", "overwrite")
    return _by_year(wh.read("t"))


@query("io06_append", YSPEC, YEARS, (Q.ORDERS,))
def _(spark, root):
    wh, o = Warehouse(spark, scratch(spark, "io06")), _small_orders(spark, root)
    wh.write(o.filter("order_year < 1998"), "t", "append")
    wh.write(o.filter("order_year >= 1998"), "t", "append")
    return _by_year(wh.read("t"))


LAST = """SELECT customer_id, order_id, status FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, order_id DESC) AS rn FROM ord) WHERE rn = 1"""


@query("io18_merge_load", "customer_id:i order_id:i status:s", LAST, (Q.ORDERS,))
@query("io19_upsert_on_conflict", "customer_id:i order_id:i status:s", LAST, (Q.ORDERS,))
def _(spark, root):
    wh, o = Warehouse(spark, scratch(spark, "io18")), _small_orders(spark, root)
    for part in (o.filter("order_year < 1998"), o.filter("order_year >= 1998")):
        wh.merge(part, "latest", ["customer_id"], ["created_at", "order_id"])
    return wh.read("latest")


@query("io21_json_rows", "event_type:s n:i value:m", "SELECT event_type, count(*) AS n, sum(value) AS value FROM ev GROUP BY 1", (Q.EVENTS,))
def _(spark, root):
    path = scratch(spark, "io21")
    CX.to_files(E.raw_events(spark, root).select("event_id", "event_type", "value"), path, "json", "overwrite")
    df = CX.from_files(spark, path, "json", "event_id bigint, event_type string, value decimal(12,2)")
    return df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


@query("io23_fan_out", "sink:s n:i", "SELECT unnest(['rows', 'a', 'b']) AS sink, unnest([2 * count(*), count(*), count(*)]) AS n FROM ord", (Q.ORDERS,))
def _(spark, root):
    a, b = scratch(spark, "io23a"), scratch(spark, "io23b")
    total = CX.fan_out(_small_orders(spark, root), [lambda d: CX.to_files(d, a), lambda d: CX.to_files(d, b, "json")])
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("sink"), "n")
    read = count(CX.from_files(spark, a), "a").unionByName(count(CX.from_files(spark, b, "json", "order_id bigint"), "b"))
    return read.unionByName(spark.createDataFrame([("rows", total)], "sink string, n bigint"))


@query("io24_csv_series_export", "timestamp:t gmv:m orders:i",
       "SELECT date_trunc('day', received_at) AS timestamp, sum(revenue) AS gmv, count(DISTINCT order_id) AS orders FROM ev WHERE event_type = 'purchase' GROUP BY 1", (Q.EVENTS,))
def _(spark, root):
    path = scratch(spark, "io24")
    e = E.raw_events(spark, root).filter("event_type = 'purchase'")
    day = F.date_trunc("day", "received_at").cast("timestamp_ntz")
    CX.to_csv(e.groupBy(day.alias("timestamp")).agg(F.sum("revenue").alias("gmv"), F.countDistinct("order_id").alias("orders")), path)
    return CX.from_files(spark, path, "csv", "timestamp timestamp_ntz, gmv decimal(22,2), orders bigint", header="true")


def _audited(spark, root):
    wh = Warehouse(spark, scratch(spark, "io26"))
    audit = lambda r: wh.log_run("orders", "2001-08-02", r.status, r.extracted, r.transformed, r.loaded, r.failed_stage, r.error)
    run_job(lambda: _small_orders(spark, root), [lambda d: d.filter("status <> 'cancelled'")], lambda d: wh.write(d, "out", "overwrite"), audit)

    def broken(_):
        raise RuntimeError("no such column")
    try:
        run_job(lambda: _small_orders(spark, root), [broken], lambda d: None, audit)
    except RuntimeError:
        pass
    return wh.read("audit.job_runs")


RUNS = """SELECT 'success' AS status, count(*) AS rows_extracted, count(*) FILTER (status <> 'cancelled') AS rows_transformed, count(*) FILTER (status <> 'cancelled') AS rows_loaded, NULL AS failed_stage FROM ord
  UNION ALL SELECT 'failed', NULL, NULL, NULL, 'transform'"""


@query("io25_job_audit", "status:s rows_loaded:i failed_stage:s", RUNS, (Q.ORDERS,))
@query("io26_pipeline_run_record", "status:s rows_extracted:i rows_transformed:i rows_loaded:i failed_stage:s", RUNS, (Q.ORDERS,))
@query("ag32_rows_by_run", "status:s rows_extracted:i rows_loaded:i", RUNS, (Q.ORDERS,))
def _(spark, root):
    return _audited(spark, root)


# ------------------------------------------------------------------ streams

def _event_stream(spark, root):
    """The event file as a stream."""
    return CX.from_stream(spark, f"{root}/events.parquet", E.table(spark, root, "events").schema)


def _ingested(spark, root):
    base = scratch(spark, "ingest")
    SI.ingest(E.payloads_of(_event_stream(spark, root)), ["event_id"], f"{base}/valid", f"{base}/quarantine", f"{base}/cp", every=None).awaitTermination()
    return spark.read.parquet(f"{base}/valid"), spark.read.parquet(f"{base}/quarantine")


@query("st01_micro_batch_ingestion", "event_type:s n:i ids:i", "SELECT event_type, count(*) AS n, count(*) AS ids FROM checked WHERE reject_code IS NULL GROUP BY 1", B.CHECKS)
def _(spark, root):
    valid, _ = _ingested(spark, root)
    return valid.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))


@query("st02_valid_and_quarantine", "sink:s reject_code:s n:i",
       "SELECT CASE WHEN reject_code IS NULL THEN 'valid' ELSE 'quarantine' END AS sink, reject_code, count(*) AS n FROM checked GROUP BY 1, 2", B.CHECKS)
def _(spark, root):
    valid, bad = _ingested(spark, root)
    rows = valid.select(F.lit("valid").alias("sink"), F.lit(None).cast("string").alias("reject_code")).unionByName(
        bad.select(F.lit("quarantine").alias("sink"), "reject_code"))
    return rows.groupBy("sink", "reject_code").agg(F.count(F.lit(1)).alias("n"))


def _run(stream, spark, name, mode="append"):
    """Drain a stream into a table and read that."""
    path = scratch(spark, name)
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query("io15_stream_extract", "event_type:s n:i", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(spark, root):
    return _run(_event_stream(spark, root).select("event_id", "event_type"), spark, "io15").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("io15_stream_positions", "start:s event_type:s n:i",
       """SELECT start, event_type, count(*) AS n FROM events, (SELECT unnest(['earliest', 'latest', 'time']) AS start)
          WHERE start = 'earliest' OR event_id % 3 > 0 GROUP BY 1, 2""")
def _(spark, root):
    """Three streams over one folder: the first third of the events is there before two of them start, the last arrives between two runs of each."""
    base = scratch(spark, "io15p")
    e = E.table(spark, root, "events").select("event_id", "event_type")
    write = lambda k: e.filter(F.col("event_id") % 3 == k).write.mode("append").parquet(f"{base}/in")
    write(0)
    time.sleep(0.05)
    starts = {"earliest": "earliest", "latest": "latest", "time": datetime.now()}
    time.sleep(0.05)
    out = None
    for k in (1, 2):
        streams = {name: CX.from_position(spark, f"{base}/in", e.schema, start, f"{base}/{name}/start") for name, start in starts.items()}
        write(k)
        for name, stream in streams.items():
            stream.writeStream.format("parquet").option("path", f"{base}/{name}/out").option("checkpointLocation", f"{base}/{name}/cp").trigger(availableNow=True).start().awaitTermination()
    for name in starts:
        rows = spark.read.schema(e.schema).parquet(f"{base}/{name}/out").select(F.lit(name).alias("start"), "event_type")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("start", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("st03_deduplicated_stream", "event_type:s n:i", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(spark, root):
    twice = scratch(spark, "st03in")
    e = E.table(spark, root, "events").select("event_id", "event_type", "ts")
    e.unionByName(e).write.parquet(twice)
    out = _run(SI.deduplicated(CX.from_stream(spark, twice, e.schema), delay="60 days"), spark, "st03")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("st04_streamed_tumbling", "merchant_id:i window_start:t events:i revenue:m",
       """SELECT merchant_id, w AS window_start, count(*) AS events, sum(value) AS revenue FROM (SELECT *, date_trunc('hour', ts) AS w FROM ev) GROUP BY 1, 2
          HAVING w + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""", (Q.EVENTS,))
def _(spark, root):
    e = _event_stream(spark, root).join(E.customer_merchant(spark, root).withColumnRenamed("customer_id", "user_id"), "user_id").withColumn(
        "value", F.col("value").cast("decimal(12,2)"))
    return _run(SW.tumbling(e, "1 hour"), spark, "st04")


@query("st05_streamed_sessions", "merchant_id:i customer_id:i session_start:t event_count:i page_views:i product_views:i cart_adds:i",
       """SELECT merchant_id, customer_id, session_start, event_count, page_views, product_views, cart_adds FROM sess
          WHERE session_end + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""", (Q.EVENTS, B.SESSIONS))
def _(spark, root):
    e = E.canonical_events(_event_stream(spark, root)).join(E.customer_merchant(spark, root), "customer_id")
    return _run(SW.sessions(e), spark, "st05")


@query("st10_partitioned_retention", "event_month:s n:i",
       "SELECT strftime(ts, '%Y-%m') AS event_month, count(*) AS n FROM ev WHERE CAST(ts AS DATE) >= DATE '2024-04-10' - 90 GROUP BY 1", (Q.EVENTS,))
def _(spark, root):
    from ..streaming.reports import retained
    wh = Warehouse(spark, scratch(spark, "st10"))
    kept = retained(E.raw_events(spark, root), "2024-04-10", 90).withColumn("event_month", F.date_format("ts", "yyyy-MM"))
    wh.write(kept.select("event_id", "ts", "event_month"), "events", "overwrite_partitions", ["event_month"])
    return wh.read("events").groupBy("event_month").agg(F.count(F.lit(1)).alias("n"))


@query("st08_streamed_alert_state", "rule_id:s merchant_id:i ts:t change:s",
       """SELECT 'zero_orders' AS rule_id, merchant_id, ts, change FROM (SELECT *, CASE WHEN is_breached AND NOT was THEN 'triggered' WHEN NOT is_breached AND was THEN 'resolved' END AS change FROM (
          SELECT *, coalesce(lag(is_breached) OVER (PARTITION BY merchant_id ORDER BY ts), false) AS was FROM checks)) WHERE change IS NOT NULL""", (Q.EVENTS, B.HOURS))
def _(spark, root):
    checks = B._hourly_checks(spark, root).select("rule_id", "merchant_id", "ts", "value", "is_breached", "cooldown_minutes")
    path = scratch(spark, "st08in")
    checks.write.parquet(path)
    return _run(SA.changes(CX.from_stream(spark, path, checks.schema)), spark, "st08")


@query("st06_streamed_active_sessions", "merchant_id:i window_start:t active_sessions:i",
       """SELECT merchant_id, window_start, count(DISTINCT session_id) AS active_sessions FROM (
            SELECT merchant_id, session_id, time_bucket(INTERVAL 1 MINUTE, ts, TIMESTAMP '1970-01-01') - to_minutes(n) AS window_start FROM ev, generate_series(0, 4) AS g(n)) GROUP BY 1, 2
          HAVING window_start + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""", (Q.EVENTS,))
def _(spark, root):
    e = E.canonical_events(_event_stream(spark, root)).join(E.customer_merchant(spark, root), "customer_id")
    return _run(SW.exact_active_sessions(e), spark, "st06")


@query("st07_streamed_late_rows", "sink:s merchant_id:i n:i",
       """WITH placed AS (SELECT merchant_id, ts, max(ts) OVER (PARTITION BY merchant_id) AS newest FROM ev)
          SELECT CASE WHEN ts >= newest - INTERVAL 10 DAY THEN 'on_time' ELSE 'late' END AS sink, merchant_id, count(*) AS n FROM placed GROUP BY 1, 2""", (Q.EVENTS,))
def _(spark, root):
    base = scratch(spark, "st07")
    e = E.canonical_events(_event_stream(spark, root)).join(E.customer_merchant(spark, root), "customer_id").select("merchant_id", "ts")
    SI.divert_late(e, base, f"{base}/cp", allowed_seconds=10 * 86400).awaitTermination()
    read = lambda sink: spark.read.parquet(f"{base}/{sink}").select(F.lit(sink).alias("sink"), "merchant_id")
    return read("on_time").unionByName(read("late")).groupBy("sink", "merchant_id").agg(F.count(F.lit(1)).alias("n"))


@query("st11_stream_upsert", "customer_id:i order_id:i status:s", LAST, (Q.ORDERS,))
def _(spark, root):
    base = scratch(spark, "st11")
    o = _small_orders(spark, root)
    o.write.partitionBy("order_year").parquet(f"{base}/in")
    wh = Warehouse(spark, base)
    stream = CX.from_stream(spark, f"{base}/in", o.schema, max_files_per_trigger=4)
    SI.upsert(stream, wh, "latest", ["customer_id"], ["created_at", "order_id"], f"{base}/cp").awaitTermination()
    return wh.read("latest")


@query("st12_resume_from_checkpoint", YSPEC, YEARS, (Q.ORDERS,))
def _(spark, root):
    base, o = scratch(spark, "st12"), _small_orders(spark, root)
    write = lambda b, i: SI.write_batch(b, f"{base}/out", i)
    for part in ("order_year < 1998", "order_year >= 1998"):
        o.filter(part).write.mode("append").parquet(f"{base}/in")
        SI.start(CX.from_stream(spark, f"{base}/in", o.schema), write, f"{base}/cp").awaitTermination()
    return _by_year(spark.read.parquet(f"{base}/out"))


@query("st13_ordered_by_merchant", "merchant_id:i n:i first_at:t last_at:t",
       "SELECT merchant_id, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM ev GROUP BY 1", (Q.EVENTS,))
def _(spark, root):
    path = scratch(spark, "st13")
    SI.write_batch(E.events(spark, root).select("merchant_id", "event_id", "ts"), path, 0, order=("merchant_id", "ts"), cluster=("merchant_id",))
    return spark.read.parquet(path).groupBy("merchant_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


