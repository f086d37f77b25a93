"""Skew-proof building blocks.

A merchant, customer, user or value may own a third of all rows, so none of
these puts an unbounded group into one task: each first reduces the group with
map-side partial aggregation to something bounded by the calendar or by the
distinct values of a small range, orders that, and joins the outcome back on a
key that is unique on one side (adaptive execution splits the other side).
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TASK_ROWS = 1 << 18


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` of so many rows, dealt by ``keys`` to as many tasks as it takes to give each ``TASK_ROWS`` on average.

    Sorts and hash tables of a task then keep their size while the input grows. Where the session's cores get
    fewer rows each, the frame stays as it is.
    """
    tasks = ceil(rows / TASK_ROWS)
    return df.repartition(tasks, *keys) if tasks > df.sparkSession.sparkContext.defaultParallelism else df


def purchase_sequence(
    orders: DataFrame, keys: Sequence[str] = ("merchant_id", "customer_id"),
    ts: str = "created_at", order_id: str = "order_id",
) -> DataFrame:
    """``(order_id, is_first_order, days_since_prev_order)`` for day-leading orders.

    Only a customer's first order of a day can have a predecessor on an earlier
    day; every later order of that day is 0 days after the previous one. So the
    order history is reduced to one row per (customer, day) and only that is
    windowed. Orders missing from the result: not first, 0 days.
    """
    days = orders.groupBy(*keys, F.to_date(ts).alias("_day")).agg(
        F.min(F.struct(F.col(ts), F.col(order_id))).alias("_lead"))
    w = Window.partitionBy(*keys).orderBy("_day")
    prev = F.lag("_day").over(w)
    return days.select(
        F.col("_lead")[order_id].alias(order_id),
        prev.isNull().alias("is_first_order"),
        F.datediff("_day", prev).alias("days_since_prev_order"),
    )


def with_purchase_sequence(orders: DataFrame, history: DataFrame | None = None, **names) -> DataFrame:
    """Add ``is_first_order`` and ``days_since_prev_order``; joins on the unique order id.

    ``history`` is the full order history when ``orders`` is only a slice of it.
    """
    order_id = names.get("order_id", "order_id")
    seq = purchase_sequence(history if history is not None else orders, **names).withColumn("_leads", F.lit(True))
    leads = F.coalesce(F.col("_leads"), F.lit(False))
    return (
        orders.join(seq, order_id, "left")
        .withColumns({
            "is_first_order": F.coalesce("is_first_order", F.lit(False)),
            "days_since_prev_order": F.when(leads, F.col("days_since_prev_order")).otherwise(F.lit(0)),
        })
        .drop("_leads")
    )


def value_band(v: Column) -> Column:
    """Order-preserving integer band of a double: 32 bands per doubling, 0 for 0."""
    mag = F.floor(F.log2(F.abs(v)) * 32) + F.lit(40000)
    return F.when(v > 0, mag).when(v < 0, -mag).when(v == 0, F.lit(0)).cast("int")


def with_dense_ranks(df: DataFrame, group: Sequence[str], ranks: dict[str, str], key: Sequence[str]) -> DataFrame:
    """Descending dense ranks per group, nulls last: ``{rank column: measure column}``.

    rank(v) = distinct values in higher bands + position inside v's band. Ties
    collapse before any ordering, so a value shared by millions of rows is one row.
    All measures are ranked in one long table (row ``key``, measure, value), meet
    their values in one join and come back to the rows in one more; ``key`` names the
    columns that tell rows apart.
    """
    group, key = list(group), list(dict.fromkeys([*group, *key]))
    cells = df.select(*key, F.posexplode(F.array(*[F.col(c).cast("double") for c in ranks.values()])).alias("_m", "_v"))
    # Null ranks last: below every finite band.
    cells = cells.withColumn("_band", F.coalesce(value_band(F.col("_v")), F.lit(-200000))).withColumn("_v", F.coalesce("_v", F.lit(0.0)))
    band_key = [*group, "_m", "_band"]
    values = cells.select(*band_key, "_v").distinct()
    above = Window.partitionBy(*group, "_m").orderBy(F.desc("_band")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = values.groupBy(*band_key).agg(F.count(F.lit(1)).alias("_n")).select(
        *band_key, F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*band_key).orderBy(F.desc("_v"))
    placed = values.withColumn("_pos", F.row_number().over(inside)).join(offsets, band_key).select(
        *band_key, "_v", (F.col("_offset") + F.col("_pos")).cast("int").alias("_rank"))
    folded = cells.join(placed, [*band_key, "_v"]).groupBy(*key).agg(
        *[F.max(F.when(F.col("_m") == i, F.col("_rank"))).alias(name) for i, name in enumerate(ranks)])
    return df.join(folded, key)


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group. The rank filter is pushed below the shuffle
    (window group limit), so each task forwards at most ``k`` rows per group."""
    w = Window.partitionBy(*group).orderBy(*order) if group else Window.orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order`` (same map-side limit as :func:`top_k`)."""
    return top_k(df, keys, order, 1, "_keep").drop("_keep")


def sessionize(
    events: DataFrame, keys: Sequence[str], ts: str = "ts", gap_minutes: int = 30,
    measures: dict[str, Column] | None = None,
) -> DataFrame:
    """Sessions split where the pause exceeds ``gap_minutes``.

    Events of one key inside one aligned slot of the gap's length always share a
    session, so rows are first folded into slots (map-side). A key then has at
    most one row per slot of the calendar, and only those rows are ordered.
    ``measures`` are sum-able columns (flags, counts), summed over the session.
    """
    measures = measures or {}
    seconds = gap_minutes * 60
    slot = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(seconds * 1_000_000))
    slots = events.groupBy(*keys, slot.alias("_slot")).agg(
        F.min(ts).alias("_from"), F.max(ts).alias("_to"), F.count(F.lit(1)).alias("_n"),
        *[F.sum(c).alias(f"_m_{name}") for name, c in measures.items()])
    w = Window.partitionBy(*keys).orderBy("_slot")
    pause = F.timestamp_diff("MICROSECOND", F.lag("_to").over(w), F.col("_from"))
    starts = F.when(pause <= seconds * 1_000_000, 0).otherwise(1)
    numbered = slots.withColumn("_starts", starts).withColumn(
        "session_no", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "session_no").agg(
        F.min("_from").alias("session_start"), F.max("_to").alias("session_end"), F.sum("_n").alias("event_count"),
        *[F.sum(f"_m_{name}").alias(name) for name in measures])


def asof_latest(
    left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str,
    payload: Sequence[str], tie: str, slot_minutes: int = 60, piece_rows: int = 1 << 16,
) -> DataFrame:
    """Latest ``right`` row at or before each ``left`` row of the same key.

    Only instants are ordered: touches of one (key, instant) are reduced to the greatest ``tie`` and left rows to
    their distinct instants, both map-side. Time is cut into pieces of ``slot_minutes``, and a piece of a key with
    more than ``piece_rows`` rows is cut further, in proportion, so one key's busy hour is many tasks. Inside a
    piece a running maximum carries the latest touch; the last touch of each piece is carried over later pieces in a
    table with one row per piece. The outcome joins back on (key, instant), which is unique on its side.

    A touch at the same instant counts. A row without key or time has no touch.
    """
    unit = slot_minutes * 60_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    touches = right.filter(F.col(right_ts).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(right_ts).alias("_at"), F.struct(F.col(tie).alias("tie"), *[F.col(p).alias(p) for p in payload]).alias("_touch"))
    instants = left.filter(F.col(left_ts).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(left_ts).alias("_at"))
    slot = F.floor(micros("_at") / F.lit(unit))
    sizes = touches.select("_key", slot.alias("_slot")).unionByName(instants.select("_key", slot.alias("_slot"))).groupBy("_key", "_slot").agg(F.count(F.lit(1)).alias("_n"))
    busy = sizes.filter(F.col("_n") > piece_rows).select(F.col("_key").alias("_k"), F.col("_slot").alias("_s"), F.least(F.ceil(F.col("_n") / piece_rows) * 4, F.lit(1 << 16)).alias("_parts"))
    reduced = touches.groupBy("_key", "_at").agg(F.max("_touch").alias("_touch"))
    both = reduced.select("_key", "_at", F.lit(0).alias("_side"), F.struct(F.col("_at").alias("at"), *[F.col(f"_touch.{n}").alias(n) for n in ("tie", *payload)]).alias("_touch")).unionByName(
        instants.distinct().withColumn("_side", F.lit(1)), allowMissingColumns=True).withColumn("_slot", slot)
    both = both.join(busy, (F.col("_key") == F.col("_k")) & (F.col("_slot") == F.col("_s")), "left")
    within = F.floor((micros("_at") - F.col("_slot") * unit) * F.coalesce("_parts", F.lit(1)) / F.lit(unit))
    both = both.withColumn("_piece", F.col("_slot") * (1 << 16) + within).select("_key", "_at", "_side", "_touch", "_piece")
    inside = Window.partitionBy("_key", "_piece").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    here = both.withColumn("_here", F.max("_touch").over(inside))
    # Last touch of every earlier piece, per piece that holds left or right rows.
    ends = both.groupBy("_key", "_piece").agg(F.max("_touch").alias("_end"))
    before = Window.partitionBy("_key").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    marks = ends.select(F.col("_key").alias("_k"), F.col("_piece").alias("_p"), F.max("_end").over(before).alias("_earlier"))
    found = here.filter("_side = 1").join(marks, (F.col("_key") == F.col("_k")) & (F.col("_piece") == F.col("_p")), "left").select("_key", "_at", F.coalesce("_here", "_earlier").alias("_found"))
    return left.join(found, (F.col(key) == F.col("_key")) & (F.col(left_ts) == F.col("_at")), "left").select(
        *[left[n] for n in left.columns], F.col("_found.at").alias("touch_at"), *[F.col(f"_found.{p}").alias(p) for p in payload])
