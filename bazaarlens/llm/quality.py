"""Quality classifier learnt from positive and unlabelled texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import FEATURES, bounded_sample, feature_table, features, statistics
from .shared import byte_chunks, remainder, stage, texts

HELD_OUT_OF, HELD_OUT = 3, 1


@dataclass
class Scorer:
    """A sum of step functions of the features through a logistic curve."""

    edges: list[np.ndarray]
    weights: np.ndarray
    prior: float
    scale: tuple[float, float] = (1.0, 0.0)

    def steps(self, x: np.ndarray) -> np.ndarray:
        """Cell number of each feature, as columns of one weight vector."""
        cells, base = np.empty(x.shape, dtype=np.int64), 0
        for j, edge in enumerate(self.edges):
            cells[:, j] = base + np.searchsorted(edge, x[:, j], side="right")
            base += len(edge) + 1
        return cells

    def margin(self, cells: np.ndarray) -> np.ndarray:
        return self.weights[cells].sum(axis=1) + self.weights[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.margin(self.steps(x)) + b, -30, 30)))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(gradient, size: int, rounds: int, rate: float = 0.05) -> np.ndarray:
    """Adam over the whole sample."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, rounds + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among unlabelled texts by the best bin of a ranking score.

    The least ratio of the two tail shares, each with its confidence margin: where
    only positives score that high, the ratio is the share itself.
    """
    cuts = np.unique(np.quantile(positive, np.linspace(0, 0.9, 91)))
    p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    margin = np.sqrt(np.log(4 / delta) / 2 / len(unlabelled)) + np.sqrt(np.log(4 / delta) / 2 / len(positive))
    ratio = (u + margin) / np.maximum(p, 1e-9)
    best = int(np.argmin(ratio))
    return float(np.clip(u[best] / max(p[best], 1e-9), 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, bins: int = 24, rounds: int = 250, decay: float = 1e-3, seed: int = 5) -> Scorer:
    """Non-negative unbiased risk: prior * positive risk + max(0, unlabelled risk - prior * positives' negative risk).

    Where the second part turns negative, the step goes against it, as it shows
    overfitting. The prior comes from a first ranking of positives against
    unlabelled texts, read on the half it was not fitted to.
    """
    both = np.vstack([positive, unlabelled])
    edges = [np.unique(np.quantile(both[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(both.shape[1])]
    edges = [np.unique(np.append(e, [np.nextafter(e.max(), np.inf) if len(e) else 0.0])) for e in edges]
    model = Scorer(edges, np.zeros(sum(len(e) + 1 for e in edges) + 1), 0.5)
    size = len(model.weights)
    p, u = model.steps(positive), model.steps(unlabelled)

    def pushed(cells, by):
        g = np.bincount(cells.ravel(), weights=np.repeat(by, cells.shape[1]), minlength=size)
        g[-1] = by.sum()
        return g

    def margin(w, cells):
        return w[cells].sum(axis=1) + w[-1]

    rng = np.random.default_rng(seed)
    hp, hu = rng.random(len(p)) < 0.5, rng.random(len(u)) < 0.5
    a, b = p[hp], u[hu]

    def ranking(w):
        return pushed(a, -(1 - _sigmoid(margin(w, a))) / max(len(a), 1)) + pushed(b, _sigmoid(margin(w, b)) / max(len(b), 1)) + decay * w

    first = _descend(ranking, size, rounds // 2)
    model.prior = estimate_prior(margin(first, p[~hp]), margin(first, u[~hu])) if (~hp).any() and (~hu).any() else 0.5

    def risk(w):
        zp, zu = margin(w, p), margin(w, u)
        softplus = lambda z: np.logaddexp(0, z)
        negative = softplus(zu).mean() - model.prior * softplus(zp).mean()
        g = pushed(u, _sigmoid(zu) / len(u)) - pushed(p, model.prior * _sigmoid(zp) / len(p))
        if negative < 0:
            return -g + decay * w
        return pushed(p, -model.prior * (1 - _sigmoid(zp)) / len(p)) + g + decay * w

    model.weights = _descend(risk, size, rounds)
    return model


def calibrate(model: Scorer, x: np.ndarray, good: np.ndarray) -> Scorer:
    """Scale and shift of the margin that fit labels of the training rows; unchanged without both kinds."""
    if good.all() or not good.any():
        return model
    z = model.margin(model.steps(x))
    spread = z.std() or 1.0

    def gradient(w):
        e = _sigmoid(w[0] * z / spread + w[1]) - good
        e = e * np.where(good, 0.5 / good.mean(), 0.5 / (1 - good.mean()))
        return np.array([(e * z / spread).mean(), e.mean()]) + 1e-3 * w

    w = _descend(gradient, 2, 400)
    model.scale = (float(w[0] / spread), float(w[1]))
    return model


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_positive: int = 10_000, most_unlabelled: int = 20_000) -> Scorer | None:
    """A scorer from labelled and unlabelled texts outside the held-out part, or None without positives or texts.

    Samples are drawn by the hash of the id before any text is looked at: about
    ``most_positive`` labelled ids, ``most_unlabelled`` of all rows.
    """
    fetch = lambda df, *more: df.select(*FEATURES, *more).orderBy(*FEATURES, *more).toPandas()
    rows = texts(docs, id_col, text_col).filter(F.coalesce(remainder("doc_id", HELD_OUT_OF) != HELD_OUT, F.lit(True)))
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality is not null")
    known = known.filter(remainder("doc_id", HELD_OUT_OF) != HELD_OUT).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = F.broadcast(stage(bounded_sample(known, most_positive), "quality-labels"))  # about most_positive ids at most
    labelled = fetch(feature_table(rows.join(known.select("doc_id"), "doc_id", "left_semi")).join(known, "doc_id"), "quality")
    unlabelled = fetch(feature_table(bounded_sample(rows, most_unlabelled)))[list(FEATURES)].to_numpy()
    x, good = labelled[list(FEATURES)].to_numpy(), labelled["quality"].to_numpy() == 1
    return calibrate(fit(x[good], unlabelled), x, good) if good.any() and len(unlabelled) else None


def score_rows(docs: DataFrame, model: Scorer | None, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with all its columns and the score of each row's text; 0.5 without a model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            m, out = shared.value, [np.zeros(0)]
            for _, data, ends in byte_chunks([pa.RecordBatch.from_arrays([column], names=["text"])]):
                out.append(np.full(len(ends) - 1, 0.5) if m is None else m.score(features(statistics(data, ends))))
            yield pa.array(np.concatenate(out))

    return docs.withColumn(name, F.arrow_udf(score, "double")(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_positive: int = 10_000, most_unlabelled: int = 20_000) -> DataFrame:
    """Quality score of every row: doc_id, held_out, score, predicted.

    Trusted positives are rows labelled 1 whose crc32 of the id has a remainder by 3
    other than 1; the unlabelled sample is drawn by hash from all rows outside the
    held-out part, labels aside. The margin is scaled on labelled training rows. Only
    statistics of the text are inputs of a score, and every row is scored. Without
    positives or texts to learn from every score is 0.5. Null text is empty; a null id
    counts as not held out; repeated rows each get a result.
    """
    model = learn(docs, labels, id_col, text_col, most_positive, most_unlabelled)
    rows = texts(docs, id_col, text_col).withColumn("held_out", F.coalesce(remainder("doc_id", HELD_OUT_OF) == HELD_OUT, F.lit(False)))
    return score_rows(rows, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of documents."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
