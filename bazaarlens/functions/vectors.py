"""Dense-vector kernels as higher-order functions (stay inside the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .guards import col


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(
        F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda acc, x: acc + x,
    )


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(
        col(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    ))


def unit(a: Column | str) -> Column:
    """L2-normalised vector; a zero or null vector stays as it is."""
    v = col(a)
    length = norm(v)
    return F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length)).otherwise(
        F.transform(v, lambda x: x.cast("double"))
    )


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine, 0 when either vector is null or has no length."""
    na, nb = norm(a), norm(b)
    return F.when((na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(F.lit(0.0))
