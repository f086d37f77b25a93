"""Date arithmetic with warehouse semantics (boundary counts) next to Spark's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .guards import col


def as_date(value: Column | str) -> Column:
    """A run date given as ``YYYY-MM-DD`` text or as a column."""
    return F.lit(value).cast("date") if isinstance(value, str) else value


def month_boundaries(start: Column | str, end: Column | str) -> Column:
    """Number of month boundaries crossed between two dates."""
    a, b = col(start), col(end)
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def hour_boundaries(start: Column | str, end: Column | str) -> Column:
    """Number of hour boundaries crossed; negative when ``end`` precedes ``start``."""
    a, b = col(start), col(end)
    return F.datediff(b, a) * 24 + F.hour(b) - F.hour(a)


def day_window(column: Column | str, start: str, end: str) -> Column:
    """``start <= column < end + 1 day`` as a range predicate that reaches the scan."""
    c = col(column)
    return (c >= F.lit(start).cast("date")) & (c < F.date_add(F.lit(end).cast("date"), 1))


def same_day(column: Column | str, day: str) -> Column:
    return day_window(column, day, day)


def calendar_dims(ts: Column | str, prefix: str = "order_") -> dict[str, Column]:
    """Date parts of ``ts``; weekday numbering is 1 = Sunday."""
    t = col(ts)
    return {
        f"{prefix}date": F.to_date(t),
        f"{prefix}hour": F.hour(t),
        f"{prefix}day_of_week": F.dayofweek(t),
        f"{prefix}week": F.weekofyear(t),
        f"{prefix}month": F.month(t),
        f"{prefix}quarter": F.quarter(t),
        f"{prefix}year": F.year(t),
        "is_weekend": F.dayofweek(t).isin(1, 7),
    }
