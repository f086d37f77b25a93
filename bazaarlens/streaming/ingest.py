"""Event ingestion as Structured Streaming: validate, split, deduplicate, upsert.

Every sink writes a micro-batch under its own ``batch_id`` partition and
overwrites only that, so a batch replayed after a failure leaves no duplicates.
Positions and state live in the query's checkpoint folder, which must be shared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import events as EV
from ..sources.warehouse import Warehouse


def event_time(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Event time as an instant; a watermark does not accept TIMESTAMP_NTZ."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def deduplicated(events: DataFrame, keys: Sequence[str] = ("event_id",), ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Drop repeats of an event inside the watermark delay."""
    return event_time(events, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def write_batch(df: DataFrame, path: str, batch_id: int, order: Sequence[str] = (), cluster: Sequence[str] = ()) -> None:
    """Write one micro-batch idempotently, optionally clustered and ordered inside files.

    Clusters are ranges of (cluster, order), so one key with most of the rows is
    split by its order and files still follow each other.
    """
    out = df.withColumn("batch_id", F.lit(batch_id))
    if cluster:
        out = out.repartitionByRange(*cluster, *[c for c in order if c not in cluster])
    if order:
        out = out.sortWithinPartitions(*order)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def start(stream: DataFrame, handler, checkpoint: str, name: str | None = None, every: str | None = None) -> StreamingQuery:
    """Start a query over ``handler(batch, id)``: periodic trigger, or all available data once."""
    writer = stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def ingest(raw: DataFrame, identity: Sequence[str], valid_path: str, quarantine_path: str, checkpoint: str,
           book: EV.RuleBook | None = None, strict: bool = True, allow_unknown: bool = False, every: str | None = "5 seconds") -> StreamingQuery:
    """Raw payload stream to a valid and a quarantine table; each batch is checked once."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        checked = EV.validated(batch, book, strict, allow_unknown).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            good = EV.enriched(checked.filter("is_valid"), identity).drop("errors", "reject_code", "is_valid")
            write_batch(good, valid_path, batch_id, order=("merchant_id", "timestamp"))
            write_batch(checked.filter("NOT is_valid"), quarantine_path, batch_id)
        finally:
            checked.unpersist()
    return start(raw, handle, checkpoint, every=every)


def upsert(stream: DataFrame, warehouse: Warehouse, table: str, keys: Sequence[str], order: Sequence[str], checkpoint: str,
           partition_by: Sequence[str] = (), every: str | None = None) -> StreamingQuery:
    """Merge each micro-batch into a table; replaying a batch gives the same table."""
    def handle(batch: DataFrame, _batch_id: int) -> None:
        if not batch.isEmpty():
            warehouse.merge(batch, table, keys, order, partition_by)
    return start(stream, handle, checkpoint, every=every)


def split_late(batch: DataFrame, ts: str = "ts", allowed_seconds: int = 3600) -> tuple[DataFrame, DataFrame]:
    """On-time and late rows of a batch, late being far behind the batch's newest event.

    Every row is in exactly one part; one without a time is late.
    """
    newest = batch.agg(F.max(ts)).first()[0]
    limit = F.lit(newest) - F.make_interval(secs=F.lit(allowed_seconds).cast("decimal(18,6)"))
    on_time = F.coalesce(F.col(ts) >= limit, F.lit(False)) if newest is not None else F.lit(False)
    return batch.filter(on_time), batch.filter(~on_time)


def divert_late(stream: DataFrame, path: str, checkpoint: str, key: str = "merchant_id", ts: str = "ts", allowed_seconds: int = 3600) -> StreamingQuery:
    """A stream parted into ``path/on_time`` and ``path/late``: late is far behind the newest time of the row's key so far.

    The newest time per key, batch by batch, is a table in ``path/newest``: a batch reads what the one before it left, adds its own
    rows' times by a map-side maximum, and joins that small table (a row per key) with its rows, so a hot key is split and nothing
    passes through the driver. Each batch writes its own partition of all three, so a replay gives the same rows. Every
    row is in exactly one part; one without a time is late; a null key is a key.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            known = rows.select(F.col(key).alias("_key"), F.col(ts).alias("_newest"))
            if batch_id:
                before = spark.read.parquet(f"{path}/newest/batch_id={batch_id - 1}")
                known = known.unionByName(before)
            write = lambda df, part: df.write.mode("overwrite").parquet(f"{path}/{part}/batch_id={batch_id}")
            write(known.groupBy("_key").agg(F.max("_newest").alias("_newest")), "newest")
            newest = spark.read.parquet(f"{path}/newest/batch_id={batch_id}")
            limit = F.col("_newest") - F.make_interval(secs=F.lit(allowed_seconds).cast("decimal(18,6)"))
            judged = rows.join(newest, F.col(key).eqNullSafe(F.col("_key"))).withColumn("_on_time", F.coalesce(F.col(ts) >= limit, F.lit(False))).drop("_key", "_newest")
            write(judged.filter("_on_time").drop("_on_time"), "on_time")
            write(judged.filter("NOT _on_time").drop("_on_time"), "late")
        finally:
            rows.unpersist()
    return start(stream, handle, checkpoint)
