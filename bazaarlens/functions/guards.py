"""Null- and zero-safe arithmetic. ANSI mode raises on ``x / 0``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str, default: float | None = 0.0) -> Column:
    """``num / den`` as double where ``den > 0``, else ``default``."""
    n, d = col(num).cast("double"), col(den).cast("double")
    return F.when(d > 0, n / d).otherwise(F.lit(default).cast("double"))


def pct_change(cur: Column | str, prev: Column | str, default: float | None = None) -> Column:
    """Percentage change against a positive previous value."""
    c, p = col(cur).cast("double"), col(prev).cast("double")
    return F.when(p > 0, (c - p) / p * F.lit(100.0)).otherwise(F.lit(default).cast("double"))


def zero(c: Column | str) -> Column:
    """Null becomes zero."""
    return F.coalesce(col(c), F.lit(0))


def money(c: Column | str) -> Column:
    return col(c).cast(MONEY)


def count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


def sum_if(cond: Column, value: Column | str) -> Column:
    """Sum of ``value`` over matching rows; non-matching rows add zero."""
    return F.sum(F.when(cond, col(value)).otherwise(F.lit(0)))
