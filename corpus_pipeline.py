"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes the documents that the one before kept and works on all of them. Ids are
taken to be unique; a row repeated with its id is kept or dropped with it, and
exact dedup leaves one of them. Rows of null id take part like any other id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm import exact_dedup, near_dedup, packing, quality, secrets
from bazaarlens.llm.shared import stage


def _only(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` whose id is (or, for an anti join, is not) among ``ids``."""
    ids = ids.select(F.col("doc_id").alias("kept_id"))
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["kept_id"]), how)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_rows(docs, model, name="__score").filter(F.col("__score") >= 0.5).drop("__score")


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that of the largest id."""
    placed = stage(exact_dedup.content_sort(docs), "distinct")
    kept = _only(docs, placed.filter("kept"))
    repeated = placed.filter("kept").count() < placed.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).count()
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept


def dissimilar_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the smallest id."""
    return _only(docs, near_dedup.near_duplicates(docs).filter(F.col("doc_id").eqNullSafe(F.col("class_id"))))


def documents_without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which the scan finds no secret."""
    return _only(docs, secrets.scan_secrets(docs).filter("spans <> ''"), "left_anti")


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, with the sequence that holds each."""
    return packing.pack_documents(docs, packing.vocabulary_path())


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", distinct_documents),
    ("near dedup", dissimilar_documents),
    ("secret scan", documents_without_secrets),
    ("best-fit packing", packed_sequences),
]

#: SQL cannot express the first, third and last stage; tests compare each stage with its operator, and the operators with plain versions where they have one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
