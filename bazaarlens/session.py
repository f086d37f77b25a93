"""Session settings the library is tuned for."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import SparkSession

# Adaptive execution splits skewed join partitions and coalesces small ones.
# The sort-based fall-back of object aggregates (percentiles) is raised so that
# partial aggregation still collapses rows map-side when a task sees many groups.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def get_session(app_name: str = "bazaarlens", master: str | None = None, **extra: str) -> SparkSession:
    """Build (or fetch) a session with the library's settings; caller owns it."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, also set for checkpoints.

    It is ``spark.checkpoint.dir``, or the checkpoint folder set before. Only a local
    master may do without: it gets a temporary folder of this machine, once.
    """
    current = spark.sparkContext.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    folder = configured or current
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="bazaarlens-")
    if not current:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid4().hex[:12]}"
