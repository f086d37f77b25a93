"""Extract and load connectors as thin uses of Spark's readers and writers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .warehouse import newer_than


def from_jdbc(spark: SparkSession, url: str, query: str, incremental_column: str | None = None, since=None,
              partition_column: str | None = None, bounds: tuple | None = None, partitions: int = 16, **options: str) -> DataFrame:
    """JDBC extract; the incremental predicate is pushed to the database and the
    scan is split over ``partition_column`` when bounds are given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) AS extract").options(**options)
    if partition_column and bounds:
        reader = (reader.option("partitionColumn", partition_column).option("lowerBound", str(bounds[0]))
                  .option("upperBound", str(bounds[1])).option("numPartitions", str(partitions)))
    df = reader.load()
    return newer_than(df, incremental_column, since) if incremental_column else df


def from_query(spark: SparkSession, sql: str, views: dict[str, DataFrame] | None = None) -> DataFrame:
    """Warehouse or event-store query over the given DataFrames (``{name}`` in the text)."""
    return spark.sql(sql, **(views or {}))


def from_files(spark: SparkSession, path: str, file_format: str = "parquet", schema: StructType | str | None = None, **options: str) -> DataFrame:
    """Parquet, ORC, CSV or JSON files; text formats need a schema (no inference pass)."""
    if file_format not in ("parquet", "orc", "csv", "json"):
        raise ValueError(f"unsupported file format {file_format!r}")
    if file_format in ("csv", "json") and schema is None:
        raise ValueError(f"{file_format} needs a schema")
    reader = spark.read.format(file_format).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def from_stream(spark: SparkSession, path: str, schema: StructType | str, file_format: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream extract from the start of a folder; the checkpoint holds the position.

    A path to one file watches that file name in its folder.
    """
    reader = spark.readStream.schema(schema).format(file_format)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(where) and fs.getFileStatus(where).isFile():
        reader, path = reader.option("pathGlobFilter", where.getName()), where.getParent().toString()
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(path)


def from_position(spark: SparkSession, path: str, schema: StructType | str, start: str | datetime, position: str, file_format: str = "parquet",
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream extract from ``earliest``, from ``latest`` (what arrives after this call) or from a time (files written then or later).

    The start is settled once and kept in the folder ``position``, next to the query's checkpoint: a restart with
    ``latest`` goes on from where the first start was, so nothing that arrived in between is lost. Positions inside
    the stream are the checkpoint's. Files that are too old are left out by their modification time, before
    they are read. The folder has to exist.
    """
    if isinstance(start, str) and start not in ("earliest", "latest"):
        raise ValueError(f"start is 'earliest', 'latest' or a time, not {start!r}")
    written = F.col("_metadata.file_modification_time")
    after = F.lit(None).cast("timestamp")
    if start == "latest":
        there = spark.read.schema(schema).format(file_format).load(path).agg(F.max(written).alias("after"))
    else:
        there = spark.range(1).select(after.alias("after") if start == "earliest" else (F.lit(start).cast("timestamp") - F.expr("INTERVAL 1 MICROSECOND")).alias("after"))
    there.coalesce(1).write.mode("ignore").parquet(position)
    settled = spark.read.schema("after timestamp").parquet(position).first()["after"]
    stream = from_stream(spark, path, schema, file_format, max_files_per_trigger)
    return stream if settled is None else stream.filter(written > F.lit(settled))


def slice_rows(df: DataFrame, order: Sequence[Column], offset: int = 0, limit: int | None = None) -> DataFrame:
    """``offset`` / ``limit`` over an explicit order."""
    out = df.orderBy(*order)
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def key_values(df: DataFrame, template: str, key_field: str, ttl_seconds: int | None = None, asof: str | None = None) -> DataFrame:
    """Key–value export: templated key, the row as JSON, expiry stamp."""
    head, tail = template.split("{" + key_field + "}")
    expires = F.lit(None).cast("timestamp_ntz")
    if ttl_seconds is not None:
        expires = F.lit(asof).cast("timestamp_ntz") + F.make_interval(secs=F.lit(ttl_seconds).cast("decimal(18,6)"))
    return df.select(F.concat(F.lit(head), F.col(key_field).cast("string"), F.lit(tail)).alias("key"),
                     F.to_json(F.struct(*df.columns)).alias("value"), expires.alias("expires_at"))


def to_files(df: DataFrame, path: str, file_format: str = "parquet", mode: str = "append", partition_by: Sequence[str] = (),
             compression: str = "snappy") -> None:
    writer = df.write.format(file_format).mode(mode)
    if file_format in ("parquet", "orc"):
        writer = writer.option("compression", compression)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def to_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; one file set per run."""
    df.write.mode("overwrite").option("header", True).csv(path)


def fan_out(df: DataFrame, loads: Sequence[Callable[[DataFrame], None]]) -> int:
    """Write to several sinks from one computation; returns rows written over all sinks."""
    from pyspark import StorageLevel
    from pyspark.sql import Observation
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    total = 0
    try:
        for i, load in enumerate(loads):
            seen = Observation(f"sink_{i}")
            load(kept.observe(seen, F.count(F.lit(1)).alias("n")))
            total += seen.get["n"]
    finally:
        kept.unpersist()
    return total


def publish(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)
