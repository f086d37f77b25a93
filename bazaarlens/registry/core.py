"""Registration of checked queries.

Each query states its output once as ``"name:kind ..."``; the same list shapes
the Spark result and the check SQL, so names and types agree by construction.

Kinds: i bigint, s text, b boolean, d date as text, t timestamp as text
(seconds), m exact decimal shown as double, r double, r2/r4/r6 rounded double.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _spark_column(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind == "i":
        return c.cast("bigint")
    if kind == "s":
        return c.cast("string")
    if kind == "b":
        return c.cast("boolean")
    if kind == "d":
        return F.date_format(c, "yyyy-MM-dd")
    if kind == "t":
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    if kind.startswith("r") and len(kind) > 1:
        return F.round(c.cast("double"), int(kind[1:])) + F.lit(0.0)
    return c.cast("double")


def _sql_column(name: str, kind: str) -> str:
    if kind == "i":
        return f"CAST({name} AS BIGINT) AS {name}"
    if kind == "s":
        return f"CAST({name} AS VARCHAR) AS {name}"
    if kind == "b":
        return f"CAST({name} AS BOOLEAN) AS {name}"
    if kind == "d":
        return f"strftime({name}, '%Y-%m-%d') AS {name}"
    if kind == "t":
        return f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {name}"
    if kind.startswith("r") and len(kind) > 1:
        return f"round(CAST({name} AS DOUBLE), {kind[1:]}) + 0.0 AS {name}"
    return f"CAST({name} AS DOUBLE) AS {name}"


def _fields(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in spec.split()]


def query(name: str, spec: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Register ``fn(spark, root)`` under ``name`` with its check SQL."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        fields = _fields(spec)

        def run(spark: SparkSession, root: str) -> DataFrame:
            return fn(spark, root).select(*[_spark_column(n, k).alias(n) for n, k in fields])

        run.__name__, run.__doc__ = name, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = run
        if sql is not None:
            head = f"WITH {', '.join(ctes)} " if ctes else ""
            cols = ", ".join(_sql_column(n, k) for n, k in fields)
            ORACLE[name] = f"{head}SELECT {cols} FROM ({sql}) AS result"
        return fn

    return register
