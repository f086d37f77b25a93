"""Nearest items by co-purchases, exactly, without listing the pairs of wide baskets."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import packed, scale
from .neighbours import BLOCKS, Search, Visits, _stage
from .scale import dealt, top_k

WIDE, BLOCK_ROWS, SLICE = 256, 1024, 2048
#: Rows of a busy item are spread over so many tasks where they get its number of orders, and where they get its list of baskets.
SPREAD, SPREAD_LISTS = 16, 4


def _shared(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    """Wide baskets that each source and each item have in common: a sparse product, a slice of baskets at a time."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    sides = []
    for rows in (left, right):
        many = np.array([len(x) for x in rows["wide"]])
        sides.append((np.repeat(np.arange(len(rows)), many), np.concatenate(rows["wide"].to_list())))
    both = np.intersect1d(sides[0][1], sides[1][1])
    for at in range(0, len(both), SLICE):
        some = both[at : at + SLICE]
        dense = []
        for (row, basket), rows in zip(sides, (left, right)):
            place = np.minimum(np.searchsorted(some, basket), len(some) - 1)
            ok = some[place] == basket
            m = np.zeros((len(rows), len(some)), dtype=np.float32)
            m[row[ok], place[ok]] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def _cosine(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    together = _shared(left, right).astype(float)
    out = together / np.sqrt(left["f"].to_numpy(dtype=float)[:, None] * right["f"].to_numpy(dtype=float)[None, :])
    out[(together == 0) | (left["item_id"].to_numpy()[:, None] == right["other_id"].to_numpy()[None, :])] = -np.inf
    return out


def _bound(rows: pd.DataFrame, blocks: pd.DataFrame) -> np.ndarray:
    """No pair shares more wide baskets than either of it has, nor than the rarer one has baskets."""
    f, g = rows["f"].to_numpy(dtype=float)[:, None], rows["_wide"].to_numpy(dtype=float)[:, None]
    low, high, most = (blocks[c].to_numpy(dtype=float)[None, :] for c in ("f_min", "f_max", "g_max"))
    by_wide = np.minimum(g, most) / np.sqrt(f * low)
    by_size = np.where(f < low, f / np.sqrt(f * low), np.where(f > high, high / np.sqrt(f * high), 1.0))
    return np.minimum(by_wide, by_size)


def _blocks(items: DataFrame, block_rows: int) -> tuple[DataFrame, pd.DataFrame]:
    """Items in the order of (f, id), in blocks of neighbours."""
    n = items.count()
    rows = max(block_rows, ceil(n / BLOCKS))
    parts = max(1, ceil(n / (rows * 8)))

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = 0
        for batch in batches:
            yield batch.assign(_block=((TaskContext.get().partitionId() << 16) + (seen + np.arange(len(batch))) // rows).astype("int64"))
            seen += len(batch)

    spec = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema)
    ordered = items.repartitionByRange(parts, "f", "other_id").sortWithinPartitions("f", "other_id")
    numbered = _stage(ordered.mapInPandas(number, spec + ", _block bigint"), "copurchase-items")
    stats = numbered.groupBy("_block").agg(F.min("f").alias("f_min"), F.max("f").alias("f_max"), F.max(F.size("wide")).alias("g_max"), F.min("other_id").alias("first"), F.count(F.lit(1)).alias("size")).toPandas()
    stats = stats.sort_values("_block").reset_index(drop=True)
    names = numbered.sparkSession.createDataFrame([(int(b), i) for i, b in enumerate(stats["_block"])], "b bigint, i int")
    return numbered.join(names, numbered["_block"] == names["b"]).select(F.col("i").alias("_block"), "other_id", "f", "wide"), stats


def item_item(baskets: DataFrame, anchors: DataFrame, n: int = 10, wide: int = WIDE, block_rows: int = BLOCK_ROWS, visits: Visits | None = None) -> DataFrame:
    """Nearest items by cosine over co-purchases: item, other, together, score = together / sqrt(orders * orders), rank; ties by other.

    Pairs of baskets of up to ``wide`` different items are counted as ``bought_together`` does: a line meets at most that many
    others. For wider baskets an item carries the list of those that hold it. Pairs known from the smaller baskets are
    completed from these lists. All further pairs share wide baskets only; they are searched block by block, items in the
    order of their number of orders: a block is left out where neither its items' numbers nor the wide baskets
    they could share let it reach an anchor's n-th score, or where it could only tie with larger ids. Cells are
    products of sparse matrices and emit their best n. So no wide basket's pairs are ever listed, and the result is the same for
    every ``wide``. Ids are numbers. Where all items are anchors and lines are many, pairs travel as packed lists (``packed``).
    """
    rows = baskets.count()
    if anchors is baskets and _tasks(baskets, rows) and _whole_numbers(baskets):
        return _of_many(baskets, rows, n, wide, block_rows, visits)
    lines = _stage(dealt(baskets.select("order_id", "item_id"), rows, "order_id", "item_id").distinct(), "copurchase-lines")
    freq = lines.groupBy("item_id").agg(F.count(F.lit(1)).alias("f"))
    chosen = None if anchors is baskets else anchors.select("item_id").distinct()
    size = F.col("n")
    sizes = lines.groupBy("order_id").agg(F.count(F.lit(1)).alias("n"))
    n_lines, n_small, n_pairs = sizes.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(F.when(size <= wide, size)), F.lit(0)), F.coalesce(F.sum(F.when(size <= wide, size * (size - 1))), F.lit(0))).first()
    n_pairs = n_pairs // 2 if chosen is None else n_pairs
    if n_lines == n_small:
        return top_k(_limited(_scored(_both_ways(_pairs(lines, freq, chosen, n_small, n_pairs), chosen)), n_pairs, n), ["item_id"], [F.desc("score"), F.asc("other_id")], n)
    large = _stage(sizes.filter(size > wide).select("order_id"), "copurchase-wide")
    held = _lists(lines.join(large, "order_id"), freq, n_lines - n_small)
    known = _known(_pairs(lines.join(large, "order_id", "left_anti"), freq, chosen, n_small, n_pairs), held, chosen, n_pairs, n)
    return _searched(held, _stage(known, "copurchase-known"), freq, chosen, n, block_rows, visits)


def _of_many(baskets: DataFrame, rows: int, n: int, wide: int, block_rows: int, visits: Visits | None) -> DataFrame:
    """As ``item_item``, of more lines than the cores should sort at once: pairs are shuffled as packed lists of a line's others.

    Only pairs of two items that wide baskets hold, which their lists complete, are rows.
    """
    kind = baskets.schema["item_id"].dataType
    tasks, raw = _tasks(baskets, rows), baskets.select(F.col("order_id").cast("bigint").alias("order_id"), F.col("item_id").cast("bigint").alias("item_id"))
    lines = packed.counted(raw, rows, tasks).withColumn("held", F.lit(False))
    groups = packed.grouped(lines, tasks, packed.busy(raw, "order_id", rows, max(wide, packed.BUSY_LINES)))
    size = F.size("items")
    small = F.col("whole") & (size <= wide)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    n_lines, n_small, n_pairs = groups.agg(total(size), total(F.when(small, size)), total(F.when(small, size.cast("bigint") * (size - 1)))).first()
    typed = lambda df: df.withColumns({c: F.col(c).cast(kind) for c in ("item_id", "other_id")})
    if n_lines == n_small:
        return typed(packed.nearest(groups, n_pairs, n_small, n))
    freq = _stage(packed.lines_of(groups).groupBy("item_id").agg(F.max("f").alias("f")), "copurchase-freq")
    held = _lists(packed.lines_of(groups.filter(~small)).select("order_id", "item_id"), freq, n_lines - n_small)
    both, n_both = groups.filter(small), n_pairs
    known = None
    if held.count() < freq.count():
        marked = packed.lines_of(both).drop("held").join(held.select("item_id", F.lit(True).alias("held")), "item_id", "left").withColumn("held", F.coalesce("held", F.lit(False)))
        both = packed.grouped(marked, tasks, [])
        of_both = F.size(F.filter("held", lambda x: x))
        n_both = both.agg(total(of_both.cast("bigint") * (of_both - 1))).first()[0]
        known = packed.nearest(both, n_pairs - n_both, n_small, n).drop("rank")
        lines, n_small = packed.lines_of(both).filter("held"), both.agg(total(of_both)).first()[0]
    else:
        lines = packed.lines_of(both)
    completed = _known(_pairs(lines.drop("held"), None, None, n_small, n_both // 2), held, None, n_both // 2, n)
    if known is not None:
        known = top_k(known.unionByName(completed), ["item_id"], [F.desc("score"), F.asc("other_id")], n).drop("rank")
    return typed(_searched(held, _stage(completed if known is None else known, "copurchase-known"), freq, None, n, block_rows, visits))


def _whole_numbers(baskets: DataFrame) -> bool:
    return all(isinstance(baskets.schema[c].dataType, IntegralType) for c in ("order_id", "item_id"))


def _lists(lines: DataFrame, freq: DataFrame, n: int) -> DataFrame:
    """(item, wide, f): the orders of ``n`` lines of wide baskets, by item."""
    lines = dealt(lines.select("item_id", F.col("order_id").cast("bigint").alias("order_id")), n, "item_id")
    return _stage(lines.groupBy("item_id").agg(F.sort_array(F.collect_list("order_id")).alias("wide")).join(freq, "item_id"), "copurchase-lists")


def _known(pairs: DataFrame, held: DataFrame, chosen: DataFrame | None, n_pairs: int, n: int) -> DataFrame:
    """Pairs of smaller baskets, completed by the wide ones; the best ``n`` of each item."""
    lists = lambda key, name: held.select(F.col("item_id").alias(key), F.col("wide").alias(name))
    pairs = _looked_up(pairs, lists("item_id", "_a"), "item_id", "other_id", n_pairs, SPREAD_LISTS, "left")
    pairs = _looked_up(pairs, lists("other_id", "_b"), "other_id", "item_id", n_pairs, SPREAD_LISTS, "left")
    more = F.coalesce(F.size(F.array_intersect("_a", "_b")), F.lit(0))
    pairs = pairs.withColumn("together", F.col("together") + F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), more).otherwise(0)).drop("_a", "_b")
    # What a cell says of a known pair is no more than its score, so no pair beyond an item's n best known ones can come in.
    return top_k(_limited(_scored(_both_ways(pairs, chosen)), n_pairs, n), ["item_id"], [F.desc("score"), F.asc("other_id")], n).drop("rank")


def _searched(held: DataFrame, known: DataFrame, freq: DataFrame, chosen: DataFrame | None, n: int, block_rows: int, visits: Visits | None) -> DataFrame:
    """The ``known`` pairs with those that only wide baskets hold."""
    sources = (held if chosen is None else held.join(chosen, "item_id", "left_semi")).select("item_id", "f", "wide", F.size("wide").alias("_wide"))
    items, blocks = _blocks(held.select(F.col("item_id").alias("other_id"), "f", "wide"), block_rows)
    search = Search(items, blocks, _bound, "other_id", block_rows)
    found = _stage(search.top_n(sources, _cosine, n, "item_id", visits, known.join(sources.select("item_id"), "item_id", "left_semi")).drop("rank"), "copurchase-found")
    # What a cell finds is a pair of wide baskets alone unless it is known; both give together back exactly.
    n_found = found.count()
    counted = _looked_up(dealt(found, n_found, "item_id").join(freq, "item_id"), freq.select(F.col("item_id").alias("other_id"), F.col("f").alias("_g")), "other_id", "item_id", n_found, SPREAD)
    counted = counted.select("item_id", "other_id", F.round(F.col("score") * F.sqrt(F.col("f").cast("double") * F.col("_g"))).cast("bigint").alias("together"), "score")
    rest = known.join(sources.select("item_id"), "item_id", "left_anti").select("item_id", "other_id", "together", "score")
    return top_k(dealt(counted.unionByName(rest), n_found + known.count(), "item_id"), ["item_id"], [F.desc("score"), F.asc("other_id")], n)


def _tasks(df: DataFrame, rows: int) -> int:
    """Tasks of ``scale.TASK_ROWS`` rows; 0 where the session's cores get fewer each."""
    tasks = ceil(rows / scale.TASK_ROWS)
    return tasks if tasks > df.sparkSession.sparkContext.defaultParallelism else 0


def _looked_up(rows: DataFrame, table: DataFrame, key: str, by: str, n: int, spread: int, how: str = "inner") -> DataFrame:
    """``n`` ``rows`` with what ``table`` (one row per ``key``) says; those of a busy key are spread over tasks by ``by``."""
    tasks = _tasks(rows, n)
    if not tasks:
        return rows.join(table, key, how)
    left = rows.withColumn("_s", F.pmod(F.xxhash64(by), F.lit(spread)).cast("int")).repartition(tasks, key, "_s")
    right = table.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))).repartition(tasks, key, "_s")
    return left.join(right, [key, "_s"], how).drop("_s")


def _pairs(lines: DataFrame, freq: DataFrame | None, chosen: DataFrame | None, n_lines: int, n_pairs: int) -> DataFrame:
    """(item, other, together, f, g): as ``bought_together``, with the number of orders of both.

    Without ``freq`` the lines have their item's ``f``. Lines take these numbers along before they meet, so that the pairs, which are many more, are not shuffled for them.
    Where all items are anchors a pair is counted once, the smaller item first. Many pairs are added up in the task
    where their lines meet, and then in tasks of even numbers of pairs.
    """
    b = lines.filter("order_id IS NOT NULL")
    b = b if freq is None else _looked_up(b, freq, "item_id", "order_id", n_lines, SPREAD)
    tasks = _tasks(lines, n_pairs)
    if tasks:
        b = b.withColumn("_task", F.pmod(F.xxhash64("order_id"), F.lit(tasks * 16)).cast("int"))
    task = ["_task"] if tasks else []
    here = lambda df: df.repartition(tasks, "_task") if tasks else df
    left = here(b if chosen is None else b.join(chosen, "item_id", "left_semi"))
    right = here(b.select(*task, "order_id", F.col("item_id").alias("other_id"), F.col("f").alias("g")))
    apart = F.col("item_id") < F.col("other_id") if chosen is None else F.col("item_id") != F.col("other_id")
    met = left.join(right, [*task, "order_id"]).filter(apart).groupBy(*task, "item_id", "other_id", "f", "g").agg(F.count(F.lit(1)).alias("together"))
    if not tasks:
        return met
    return met.drop("_task").repartition(tasks, "item_id", "other_id").groupBy("item_id", "other_id", "f", "g").agg(F.sum("together").alias("together"))


def _both_ways(pairs: DataFrame, chosen: DataFrame | None) -> DataFrame:
    if chosen is not None:
        return pairs
    ways = F.array(F.struct("item_id", "other_id", "f", "g"), F.struct(F.col("other_id").alias("item_id"), F.col("item_id").alias("other_id"), F.col("g").alias("f"), F.col("f").alias("g")))
    return pairs.select("together", F.inline(ways))


def _limited(scored: DataFrame, n_pairs: int, n: int) -> DataFrame:
    """The ``scored`` pairs by item in even tasks; of an item, only the best ``n`` of each of ``SPREAD`` parts of its pairs."""
    tasks = _tasks(scored, 2 * n_pairs)
    if not tasks:
        return scored
    parts = scored.withColumn("_part", F.pmod(F.xxhash64("other_id"), F.lit(SPREAD)).cast("int")).repartition(tasks, "item_id", "_part")
    return top_k(parts, ["item_id", "_part"], [F.desc("score"), F.asc("other_id")], n).drop("rank", "_part").repartition(tasks, "item_id")


def _scored(pairs: DataFrame) -> DataFrame:
    return pairs.select("item_id", "other_id", "together", (F.col("together") / F.sqrt(F.col("f").cast("double") * F.col("g"))).alias("score"))
