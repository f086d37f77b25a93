"""Table checks; each is one pass that yields a small table of findings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.guards import count_if, zero

EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"


class ContractError(ValueError):
    """A table does not satisfy its contract."""


def schema_diff(df: DataFrame, contract: T.StructType | Sequence[str]) -> dict[str, list[str]]:
    """Missing, extra and wrongly typed columns against a contract (schema only, no job)."""
    names = contract.fieldNames() if isinstance(contract, T.StructType) else list(contract)
    diff = {"missing": [c for c in names if c not in df.columns], "extra": [c for c in df.columns if c not in names], "type": []}
    if isinstance(contract, T.StructType):
        have = {f.name: f.dataType for f in df.schema}
        diff["type"] = [f.name for f in contract if f.name in have and have[f.name] != f.dataType]
    return diff


def conform(df: DataFrame, contract: T.StructType) -> DataFrame:
    """Columns of the contract, in its order and types; raises on missing columns."""
    missing = schema_diff(df, contract)["missing"]
    if missing:
        raise ContractError(f"missing columns: {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in contract])


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls per column, all columns in one aggregation, in long form."""
    one = df.agg(*[count_if(F.col(c).isNull()).alias(c) for c in columns])
    filled = one.select(*[zero(c).cast("bigint").alias(c) for c in columns])
    return filled.unpivot([], list(columns), "column_name", "null_count")


def validate(df: DataFrame, required: Sequence[str], non_null: Sequence[str] = ()) -> bool:
    """Raise on missing columns or nulls; False on an empty table."""
    missing = schema_diff(df, required)["missing"]
    if missing:
        raise ContractError(f"missing columns: {missing}")
    if non_null:
        bad = {r["column_name"]: r["null_count"] for r in null_counts(df, non_null).filter("null_count > 0").collect()}
        if bad:
            raise ContractError(f"null values: {bad}")
    return not df.isEmpty()


def freshness(df: DataFrame, ts: str, asof: str, max_hours: int = 2) -> DataFrame:
    """Newest stamp, its age in hours and whether the source is stale."""
    a = F.lit(asof).cast("timestamp_ntz")
    age = F.timestamp_diff("SECOND", F.col("latest"), a) / F.lit(3600.0)
    return df.agg(F.max(F.col(ts).cast("timestamp_ntz")).alias("latest")).select(
        "latest", age.alias("age_hours"), F.coalesce(age > max_hours, F.lit(True)).alias("is_stale"))


def training_gate(interactions: DataFrame, ts: str, asof: str, minimum: int = 100_000, days: int = 90) -> DataFrame:
    """Interactions inside the look-back and whether they suffice for training."""
    recent = interactions.filter(F.col(ts) >= F.date_sub(F.lit(asof).cast("date"), days))
    return recent.agg(F.count(F.lit(1)).alias("interactions"), F.max(ts).alias("latest")).withColumn(
        "passes", F.col("interactions") >= minimum)


def rule_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Violations per named rule (a rule is true where the row is good; null passes)."""
    one = df.agg(*[zero(count_if(~F.coalesce(ok, F.lit(True)))).cast("bigint").alias(name) for name, ok in rules.items()])
    return one.unpivot([], list(rules), "rule", "violations")


def email_ok(column: str) -> Column:
    return F.col(column).rlike(EMAIL)


def merchant_id_ok(column: str) -> Column:
    return F.col(column).startswith("merch_") & (F.length(column) == 18)


def one_of(column: str, *allowed) -> Column:
    return F.col(column).isin(*allowed)


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Child rows whose (non-null) key has no parent."""
    p = parent.select(F.col(parent_key or key).alias(key))
    return child.filter(F.col(key).isNotNull()).join(p, key, "left_anti")


def reconcile_totals(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders whose stored amounts differ from their lines or from their own parts."""
    sums = items.groupBy("order_id").agg(F.sum("line_subtotal").alias("line_total"), F.sum("quantity").alias("line_items"))
    total = F.col("subtotal") + F.col("tax_amount") + F.col("shipping_amount") - zero("discount_amount")
    j = orders.drop("line_total", "line_items").join(sums, "order_id", "left").withColumns({
        "subtotal_diff": F.col("subtotal") - zero("line_total"), "items_diff": F.col("item_count") - zero("line_items"),
        "total_diff": F.col("total_amount") - total})
    return j.filter((F.col("subtotal_diff") != 0) | (F.col("items_diff") != 0) | (F.col("total_diff") != 0))
