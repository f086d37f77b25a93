"""Generic record transforms: mapping, casting, filtering, dedup, look-up, group-by."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guards import zero
from .scale import keep_one


def map_columns(df: DataFrame, mapping: Mapping[str, str], drop_unmapped: bool = False) -> DataFrame:
    """Rename columns. Two sources for one name: the later column wins."""
    chosen: dict[str, str] = {}
    for c in df.columns:
        if c in mapping or not drop_unmapped:
            target = mapping.get(c, c)
            chosen.pop(target, None)
            chosen[target] = c
    return df.select(*[F.col(f"`{src}`").alias(name) for name, src in chosen.items()])


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast text columns. A failed cast gives null and sets ``<column>_cast_error``.

    Date-times accept ISO text with ``Z``; booleans accept true/false, 1/0, yes/no.
    """
    out = {}
    for name, kind in types.items():
        if name not in df.columns:
            continue
        raw = F.col(name)
        if kind == "datetime":
            value = F.regexp_replace(raw.cast("string"), "Z$", "+00:00").try_cast("timestamp")
        else:
            value = raw.try_cast({"int": "bigint", "integer": "bigint", "float": "double", "str": "string", "bool": "boolean"}.get(kind, kind))
        out[name], out[f"{name}_cast_error"] = value, raw.isNotNull() & value.isNull()
    return df.withColumns(out)


def keep_where(df: DataFrame, predicate: Column) -> DataFrame:
    return df.filter(predicate)


def deduplicate(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "last") -> DataFrame:
    """First or last row per key under an explicit total order."""
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be 'first' or 'last', not {keep!r}")
    return keep_one(df, keys, [F.col(c).asc() if keep == "first" else F.col(c).desc() for c in order])


def look_up(df: DataFrame, table: DataFrame, source_key: str, table_key: str, value: str, target: str, default=None) -> DataFrame:
    """Look up ``value``: no key or no match gives ``default``; a matched null stays null."""
    t = table.select(F.col(table_key).alias("_k"), F.col(value).alias("_v"), F.lit(True).alias("_hit"))
    j = df.join(t, F.col(source_key) == F.col("_k"), "left")
    return j.withColumn(target, F.when(F.col("_hit"), F.col("_v")).otherwise(F.lit(default))).drop("_k", "_v", "_hit")


def aggregate(df: DataFrame, group_by: Sequence[str], aggregations: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``{output: (column, function)}``; empty sums and means are 0, empty min and max null."""
    fns = {
        "sum": lambda c: zero(F.sum(c)), "count": F.count, "min": F.min, "max": F.max,
        "mean": lambda c: F.coalesce(F.try_divide(F.sum(c).cast("double"), F.count(c)), F.lit(0.0)),
    }
    unknown = {fn for _, fn in aggregations.values()} - set(fns)
    if unknown:
        raise ValueError(f"unknown aggregation {sorted(unknown)}")
    return df.groupBy(*group_by).agg(*[fns[fn](F.col(c)).alias(name) for name, (c, fn) in aggregations.items()])


def gmv_column(df: DataFrame, subtotal: str = "subtotal", name: str = "gmv") -> DataFrame:
    """GMV of a generic record; 0 where the subtotal column or value is missing."""
    return df.withColumn(name, zero(subtotal) if subtotal in df.columns else F.lit(0))


def chain(df: DataFrame, *steps) -> DataFrame:
    """Apply DataFrame functions in turn; still one lazy plan."""
    return reduce(lambda acc, fn: acc.transform(fn), steps, df)
