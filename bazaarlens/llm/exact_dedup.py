"""Exact duplicates by a content sort (DataFrame functions only)."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage, texts


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, prefix: int = 32) -> DataFrame:
    """Groups of equal texts (A-Z lower-cased), with the row of the largest id kept.

    Returns, per input row, doc_id, keep_id, group_size, kept, text_sha256.

    Normalised bytes are range-partitioned by sampled splitters and sorted
    externally, so equal texts lie side by side and neighbours are compared in full.
    Splitters are sampled from the first ``prefix`` characters and a hash of the whole
    text, so that a sample of long texts does not pass through the driver.
    The sort key ends in a salt taken from the id: a text that owns a third of all
    rows is cut into ``salts`` runs that splitters can part; what is left of a run
    (digest, largest id, count) meets the other runs of its text by digest.

    Null text is empty; all empty texts are one group. A null id is the smallest; a
    row repeated with its id is kept once. No rows in, no rows out; further columns
    of ``docs`` are not read.
    """
    rows = texts(docs, id_col, text_col)
    rows = rows.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"),
                       F.translate("text", ascii_uppercase, ascii_lowercase).alias("norm"))
    rows = rows.withColumn("head", F.substring("norm", 1, prefix)).withColumn("hash", F.xxhash64("norm"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run = Window.partitionBy("head", "hash", "norm", "salt")
    placed = (rows.repartitionByRange(parts, "head", "hash", "salt")
              .withColumn("place", F.row_number().over(run.orderBy(F.col("doc_id").desc_nulls_last())))
              .withColumn("run_size", F.count("*").over(run))
              .select("doc_id", "place", "run_size", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")))
    placed = stage(placed, "content-sort")
    groups = (placed.filter("place = 1").groupBy("text_sha256")
              .agg(F.max("doc_id").alias("keep_id"), F.sum("run_size").alias("group_size")))
    return (placed.join(groups, "text_sha256")
            .select("doc_id", "keep_id", "group_size", ((F.col("place") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256"))


def op8_content_sort(spark, sf_dir: str) -> DataFrame:
    """Every row of documents with its group of equal texts."""
    return content_sort(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)"""
