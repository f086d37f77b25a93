"""Quality rules, and an isolation forest over rule statistics."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .features import COUNTS, feature_table
from .shared import stage

#: Statistics the forest splits on; each is a rate, so that length does not make a text odd.
FOREST_RULES = ("word_length", "symbols", "upper", "bangs", "stops", "pipes", "short_words")
MIN_WORDS, MOST_REPEATED, BINS = 50, 50, 4096


@dataclass
class Forest:
    """Trees as arrays in heap order: split column (-1 at leaves), threshold, path length to the leaf's end."""

    column: np.ndarray
    threshold: np.ndarray
    length: np.ndarray
    height: int
    mean_length: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly in 0..1: short average paths come near 1."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for column, threshold, length in zip(self.column, self.threshold, self.length):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.height):
                c = column[node]
                node = np.where(c < 0, node, 2 * node + 2 - (x[rows, np.maximum(c, 0)] < threshold[node]))
            total += length[node]
        return 2.0 ** (-total / max(len(self.column), 1) / self.mean_length)


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), (n == 2).astype(float))


def _tree(part: np.ndarray, rng: np.random.Generator, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One isolation tree over all rows of ``part``, at most ``height`` deep."""
    nodes = 2 ** (height + 1) - 1
    column, threshold, length = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
    todo = [(0, 0, part)]
    while todo:
        node, depth, part = todo.pop()
        low, high = part.min(axis=0), part.max(axis=0)
        open_ = np.flatnonzero(high > low)
        if depth == height or len(part) < 2 or not len(open_):
            length[node] = depth + _mean_path(len(part))
            continue
        c = rng.choice(open_)
        cut = rng.uniform(low[c], high[c])
        column[node], threshold[node] = c, cut
        left = part[:, c] < cut
        if left.all() or not left.any():
            column[node], length[node] = -1, depth + _mean_path(len(part))
            continue
        todo += [(2 * node + 1, depth + 1, part[left]), (2 * node + 2, depth + 1, part[~left])]
    return column, threshold, length


def fit_forest(x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 7) -> Forest:
    """Isolation trees over the rows of ``x``, each over ``sample`` of them."""
    rng, height = np.random.default_rng(seed), int(np.ceil(np.log2(sample)))
    grown = [_tree(x[rng.choice(len(x), min(sample, len(x)), replace=False)], rng, height) for _ in range(trees)]
    return Forest(*(np.stack(p) for p in zip(*grown)), height, float(_mean_path(min(sample, len(x)))) or 1.0)


def fit_dealt(rows: DataFrame, trees: int = 100, least: int = 256, seed: int = 7) -> Forest | None:
    """Isolation trees over all ``rows``, which are dealt out to them by hash; a tree is grown in a task over all of its share.

    Every row is in a tree, and in several where a share would have fewer than ``least`` rows (in all of them, where there are
    no more rows than that). Depth is bounded by ``least``, so the forest has one size at every number of rows.
    """
    n = rows.count()
    if not n:
        return None
    height, copies = int(np.ceil(np.log2(least))), min(trees, ceil(trees * least / n))
    first = F.pmod(F.xxhash64(F.lit("tree"), "doc_id", *FOREST_RULES), F.lit(trees))
    dealt = rows.select(*FOREST_RULES, first.alias("_first"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("_copy")).select(
        *FOREST_RULES, ((F.col("_first") + F.col("_copy")) % trees).cast("int").alias("tree"))

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        number = int(part["tree"].iloc[0])
        column, threshold, length = _tree(part[list(FOREST_RULES)].sort_values(list(FOREST_RULES)).to_numpy(), np.random.default_rng((seed, number)), height)
        return pd.DataFrame({"tree": [number], "n": [len(part)], "column": [column], "threshold": [threshold], "length": [length]})

    grown = dealt.groupBy("tree").applyInPandas(grow, "tree int, n bigint, column array<int>, threshold array<double>, length array<double>").orderBy("tree").toPandas()
    mean = float(_mean_path(grown["n"].to_numpy()).mean()) or 1.0
    return Forest(*(np.stack(grown[c].to_list()) for c in ("column", "threshold", "length")), height, mean)


def _rates(b: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([b.column(f).to_numpy() for f in FOREST_RULES]) if b.num_rows else np.zeros((0, len(FOREST_RULES)))


def calibrate(scored: DataFrame) -> float:
    """Score above which a text is rejected: best sum of kept good and rejected bad shares over all rows of (score, good); infinite without both.

    Rows of one score are added up first; running sums are carried over ``BINS`` ranges of scores.
    """
    count = lambda c: F.sum(c.cast("bigint"))
    by = stage(scored.groupBy("score").agg(count(F.col("good")).alias("good"), count(~F.col("good")).alias("bad")).withColumn("_bin", F.floor(F.col("score") * BINS)), "rule-scores")
    total = by.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    if not total["good"] or not total["bad"]:
        return float("inf")
    before, inside = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_bin").orderBy("score")
    # At most BINS + 1 rows, as a score is in 0..1.
    sums = by.groupBy("_bin").agg(F.sum("good").alias("_g"), F.sum("bad").alias("_b"))
    starts = sums.select("_bin", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("_g", "_b")])
    value = (F.col("_g0") + F.sum("good").over(inside)) / F.lit(float(total["good"])) + 1 - (F.col("_b0") + F.sum("bad").over(inside)) / F.lit(float(total["bad"]))
    values = stage(by.join(starts, "_bin").select("score", value.alias("value")), "rule-cuts")
    most = values.agg(F.max("value")).first()[0]
    best = values.filter(F.col("value") >= most - 1e-12).agg(F.max("score")).first()[0]
    after = values.filter(F.col("score") > best).agg(F.min("score")).first()[0]
    return float((best + (best if after is None else after)) / 2)


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", trees: int = 100, sample: int = 256) -> DataFrame:
    """Rule counts and verdict of every row.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, anomaly. A text fails the base rules with fewer than 50 words
    or with over half of its words in repeated three-word windows. Of the others, one
    is kept if its anomaly in an isolation forest over ``FOREST_RULES`` is at most the
    threshold that best parts labelled good from labelled bad texts.

    Forest and threshold come from all labelled rows that pass the base rules: the
    rows are dealt out to ``trees`` trees of at least ``sample`` rows, where there are as many.
    Every row is scored. Without labels of both
    kinds only the base rules decide. Null text is empty and fails; rows are judged
    one by one, so repeated rows and null ids each get a result.
    """
    spark = docs.sparkSession
    stats = feature_table(docs, id_col, text_col).withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    stats = stage(stats.select("doc_id", *COUNTS, "base_failed", *FOREST_RULES), "rule-statistics")
    known = labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    fit = stage(stats.filter("not base_failed").join(known, "doc_id").select("doc_id", "quality", *FOREST_RULES), "rule-labelled")
    forest, limit = fit_dealt(fit, trees, sample), float("inf")
    if forest is None:
        forest = fit_forest(np.zeros((1, len(FOREST_RULES))), 1)
    else:
        model = spark.sparkContext.broadcast(forest)

        def score(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(model.value.score(_rates(b))), b.column("good")], names=["score", "good"])

        limit = calibrate(fit.select(*FOREST_RULES, (F.col("quality") == 1).alias("good")).mapInArrow(score, "score double, good boolean"))
    shared = spark.sparkContext.broadcast((forest, limit))

    def judge(batches):
        model, most = shared.value
        for b in batches:
            anomaly = model.score(_rates(b))
            failed = b.column("base_failed").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", *COUNTS, "base_failed")], pa.array(~failed & (anomaly <= most)), pa.array(anomaly)],
                                             names=["doc_id", *COUNTS, "base_failed", "kept", "anomaly"])

    spec = ", ".join([f"doc_id {stats.schema['doc_id'].dataType.simpleString()}", *[f"{c} bigint" for c in COUNTS], "base_failed boolean, kept boolean, anomaly double"])
    return stats.mapInArrow(judge, spec)


def op4_rule_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and forest over every whole text of documents."""
    return apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
