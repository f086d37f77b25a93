"""Training-set, factor-model and evaluation job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import recommend as RC
from ..operators.neighbours import _stage


@dataclass
class Trained:
    """A fitted model with its evaluation row (lazy)."""

    model: RC.Factors
    metrics: DataFrame


def train(events: DataFrame, start: str, asof: str, n: int = 20, minimum_hr: float = 0.1, min_interactions: int = RC.MIN_TRAIN,
          train_days: int = 70, validate_days: int = 80, test_days: int = 90, **fit: float) -> Trained:
    """Split by day, fit on the training days, evaluate on the test days, gate.

    Events are parsed once: the days that train or test are written as plain columns, and so are the training pairs.
    """
    parts = RC.split_by_day(events, start, train=train_days, validate=validate_days, test=test_days).filter("split <> 'validation'")
    parts = _stage(parts.select("user_id", "item_id", "event_type", "ts", "split"), "training-events")
    fitted = _stage(RC.active_users(RC.interactions(parts.filter("split = 'train'"), asof, days=test_days), min_interactions), "training-pairs")
    model = RC.fit_factors(fitted, **fit)
    test = parts.filter("split = 'test' AND item_id IS NOT NULL").select("user_id", "item_id").distinct()
    known = fitted.select("user_id").distinct()
    test = test.join(known, "user_id", "left_semi")
    ranked = RC.recommend(model.userFactors, model.itemFactors, test.select("user_id").distinct(), n)
    return Trained(model, RC.gate(RC.evaluate(ranked, test, fitted.select("item_id")), minimum=minimum_hr))


def training_events(events: DataFrame, path: str = "$.product_id") -> DataFrame:
    """Events as (user, item, type, time) rows for training."""
    return events.select(F.col("customer_id").alias("user_id"), F.get_json_object("properties", path).try_cast("bigint").alias("item_id"), "event_type", "ts")
