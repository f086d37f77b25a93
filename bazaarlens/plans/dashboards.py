"""Dashboard snapshot, alert evaluation and event ingestion jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators import alerts as A
from ..operators import events as EV
from ..operators import metrics as MX


def snapshot(events: DataFrame, end: str, window: str = "daily",
             widgets: Sequence[str] = MX.WIDGETS, product_path: str = "$.product_id") -> DataFrame:
    """All merchants' dashboards in one job."""
    return MX.dashboard(events, end, window, widgets, product_path)


def check_alerts(series: DataFrame, rules: DataFrame) -> DataFrame:
    """Metric series against rules: trigger / resolve history with cool-down."""
    return A.with_cooldown(A.evaluate(series, rules))


def ingest(raw: DataFrame, identity: Sequence[str], book: EV.RuleBook | None = None, strict: bool = True,
           allow_unknown: bool = False) -> tuple[DataFrame, DataFrame]:
    """Valid, enriched events and the quarantine (rejected rows with their problems)."""
    checked = EV.validated(raw, book, strict, allow_unknown)
    return EV.enriched(checked.filter("is_valid"), identity), checked.filter("NOT is_valid")
