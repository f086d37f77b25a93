"""Pairs of items in baskets, shuffled as packed lists, a line with all others of its basket.

Pairs are several times as many as lines, and a pair as a row of its own took 14 to 22 bytes of each of four shuffles.
Here a line travels once to the task of its item, with the others of its basket and their numbers of orders; many lines for one
task are one row of compressed columns, which makes 3 to 4 bytes a pair. The task counts and ranks all pairs of its items.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scale
from .neighbours import _stage

#: An item or order is busy in more than BUSY_LINES lines and more than its BUSY-th part of all, so that at most BUSY are.
BUSY_LINES, BUSY, SLOTS = 1 << 14, 1024, 1 << 16
#: Pairs that are made at once, that are packed together, and that a task holds before it adds up equal ones.
CELL, CHUNK, HELD = 1 << 18, 1 << 20, 1 << 21
#: A task gets so many times ``scale.TASK_ROWS`` pairs on average; rows of a busy item are spread over so many tasks.
TASK, SPREAD = 4, 16
GROUPS = "order_id bigint, whole boolean, items array<bigint>, freqs array<bigint>, held array<boolean>"
PACKED = "task int, lines int, pairs int, item binary, f binary, many binary, other binary, g binary"
RANKED = "item_id bigint, other_id bigint, together bigint, score double, rank int"


def busy(lines: DataFrame, key: str, rows: int, least: int) -> list[int]:
    """Values of ``key`` in more of the ``rows`` lines than ``least`` and a ``BUSY``-th: counted by hash first, then where a hash is full."""
    most = F.col("n") > max(least, ceil(rows / BUSY))
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS))
    full = [r["_slot"] for r in lines.groupBy(slot.alias("_slot")).agg(F.count(F.lit(1)).alias("n")).filter(most).collect()]
    if not full:
        return []
    return [r[key] for r in lines.filter(F.col(key).isNotNull() & slot.isin(full)).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(most).collect()]


def counted(lines: DataFrame, rows: int, tasks: int) -> DataFrame:
    """Different ``(order_id, item_id, f)``: ``f`` orders hold the item. Lines without item are left out, those without order are one order."""
    lines = lines.filter("item_id IS NOT NULL")
    many = busy(lines, "item_id", rows, BUSY_LINES)
    keys = ["item_id", "_s"] if many else ["item_id"]
    if many:
        lines = lines.withColumn("_s", F.when(F.col("item_id").isin(many), F.pmod(F.xxhash64("order_id"), F.lit(SPREAD)).cast("int")).otherwise(0))
    out = lines.repartition(tasks, *keys).distinct().withColumn("f", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    if not many:
        return out
    known = lines.filter(F.col("item_id").isin(many)).select("order_id", "item_id").distinct().groupBy("item_id").agg(F.count(F.lit(1)).alias("_f")).collect()
    known = lines.sparkSession.createDataFrame([tuple(r) for r in known], "item_id bigint, _f bigint")
    return out.join(F.broadcast(known), "item_id", "left").select("order_id", "item_id", F.coalesce("_f", "f").alias("f"))


def grouped(lines: DataFrame, tasks: int, large: list[int]) -> DataFrame:
    """Baskets of ``(order_id, item_id, f, held)``; those of the orders ``large`` are in parts, which are not ``whole``."""
    part = F.when(F.col("order_id").isin(large), F.pmod(F.xxhash64("item_id"), F.lit(tasks)).cast("int")).otherwise(-1) if large else F.lit(-1)
    lines = lines.filter("order_id IS NOT NULL").select("order_id", "item_id", "f", "held", part.alias("_part"))
    keys = ["order_id", "_part"] if large else ["order_id"]
    return _stage(lines.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(_group, GROUPS), "copurchase-baskets")


def _group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rest = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = (now if rest is None else pa.concat_tables([rest, now])).combine_chunks()
        order, part = now["order_id"].to_numpy(), now["_part"].to_numpy()
        starts = np.flatnonzero(np.append(len(order) > 0, (order[1:] != order[:-1]) | (part[1:] != part[:-1])))
        if len(starts) > 1:
            yield _listed(now.slice(0, starts[-1]), starts[:-1])
        rest = now.slice(starts[-1]) if len(starts) else rest
    if rest is not None:
        yield _listed(rest, np.array([0]))


def _listed(lines: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    at = pa.array(np.append(starts, len(lines)).astype("int32"))
    lists = [pa.ListArray.from_arrays(at, lines[c].combine_chunks()) for c in ("item_id", "f", "held")]
    return pa.RecordBatch.from_arrays([pa.array(lines["order_id"].to_numpy()[starts]), pa.array(lines["_part"].to_numpy()[starts] < 0), *lists], ["order_id", "whole", "items", "freqs", "held"])


def lines_of(baskets: DataFrame) -> DataFrame:
    """(order, item, f, held) of baskets."""
    line = F.explode(F.arrays_zip("items", "freqs", "held")).alias("_line")
    return baskets.select("order_id", line).select("order_id", F.col("_line.items").alias("item_id"), F.col("_line.freqs").alias("f"), F.col("_line.held").alias("held"))


def nearest(baskets: DataFrame, pairs: int, rows: int, n: int) -> DataFrame:
    """Best ``n`` others of each item by together / sqrt(f * g), over the pairs of whole baskets; ties by id.

    Pairs of two ``held`` items are left out. ``pairs``: their number, each counted both ways; ``rows``: that of lines.
    """
    tasks = max(ceil(pairs / (TASK * scale.TASK_ROWS)), baskets.sparkSession.sparkContext.defaultParallelism)
    many = busy(lines_of(baskets), "item_id", rows, BUSY_LINES)
    out = baskets.mapInArrow(_packer(tasks, many), PACKED).repartition(tasks, "task").mapInArrow(_ranker(n), RANKED)
    if not many:
        return out
    # The pairs of a busy item are more than a task should count; they are rows, added up before they are shuffled.
    line = lambda name: F.explode(F.arrays_zip("items", "freqs", "held")).alias(name)
    rare = baskets.filter(F.exists("items", lambda x: x.isin(many))).select(line("_a"), "items", "freqs", "held").filter(F.col("_a.items").isin(many)).select("_a", line("_b"))
    rare = rare.filter((F.col("_a.items") != F.col("_b.items")) & ~(F.col("_a.held") & F.col("_b.held")))
    rare = rare.groupBy(F.col("_a.items").alias("item_id"), F.col("_b.items").alias("other_id"), F.col("_a.freqs").alias("f"), F.col("_b.freqs").alias("g")).agg(F.count(F.lit(1)).alias("together"))
    rare = rare.select("item_id", "other_id", "together", (F.col("together") / F.sqrt(F.col("f").cast("double") * F.col("g"))).alias("score"))
    order = [F.desc("score"), F.asc("other_id")]
    rare = scale.top_k(rare.withColumn("_part", F.pmod(F.xxhash64("other_id"), F.lit(SPREAD))), ["item_id", "_part"], order, n).drop("rank", "_part")
    return out.unionByName(scale.top_k(rare, ["item_id"], order, n))


def _task(items: np.ndarray, tasks: int) -> np.ndarray:
    """Task of each item, by a mixed hash."""
    x = items.astype("int64").view("uint64")
    for by in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(by)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(tasks)).astype("int32")


def _pack(x: np.ndarray) -> bytes:
    """Numbers as planes of bytes, compressed: the high bytes are mostly alike."""
    return pa.compress(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def _unpack(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n).T.copy().view("<i8").ravel()


def _packer(tasks: int, many: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines of whole baskets, each with the others, as packed rows for the tasks of their items; without lines of the items ``many``."""
    skip = np.array(many, dtype="int64")

    def cells(items: np.ndarray, freqs: np.ndarray, held: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
        at = (first[:, None] + np.arange(size)).ravel()
        others = np.arange(size - 1) + (np.arange(size - 1) >= np.arange(size)[:, None])
        with_ = (first[:, None, None] + others).reshape(len(at), size - 1)
        if len(skip) and len(away := np.flatnonzero(~np.isin(items[at], skip))) < len(at):
            at, with_ = at[away], with_[away]
        if not held.any():
            return items[at], freqs[at], np.full(len(at), size - 1), items[with_.ravel()], freqs[with_.ravel()]
        ok = ~(held[at][:, None] & held[with_])
        return items[at], freqs[at], ok.sum(1), items[with_[ok]], freqs[with_[ok]]

    def rows(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        a, f, k, b, g = (np.concatenate(x) for x in zip(*parts))
        task = _task(a, tasks)
        order, starts = np.lexsort((a, task)), np.cumsum(k) - k
        a, f, k, task, starts = a[order], f[order], k[order], task[order], starts[order]
        ends = np.cumsum(k)
        at = np.repeat(starts - (ends - k), k) + np.arange(len(b))
        b, g = b[at], g[at]
        low = np.flatnonzero(np.append(len(task) > 0, task[1:] != task[:-1]))
        high, ends = np.append(low[1:], len(task)), np.append(0, ends)
        kinds = [pa.int32()] * 3 + [pa.binary()] * 5
        out = [(int(task[i]), int(j - i), int(ends[j] - ends[i]), _pack(np.diff(a[i:j], prepend=0)), _pack(f[i:j]), _pack(k[i:j]), _pack(b[ends[i] : ends[j]]), _pack(g[ends[i] : ends[j]])) for i, j in zip(low, high)]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * len(kinds), kinds)], ["task", "lines", "pairs", "item", "f", "many", "other", "g"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, waiting = [], 0
        for batch in batches:
            sizes = pc.list_value_length(batch.column("items")).to_numpy()
            items, freqs, held = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("items", "freqs", "held"))
            first, whole = np.cumsum(sizes) - sizes, batch.column("whole").to_numpy(zero_copy_only=False)
            for size in np.unique(sizes[whole & (sizes > 1)]).tolist():
                chosen = first[whole & (sizes == size)]
                step = max(1, CELL // (size * (size - 1)))
                for i in range(0, len(chosen), step):
                    parts.append(cells(items, freqs, held, chosen[i : i + step], size))
                    waiting += len(parts[-1][3])
                    if waiting >= CHUNK:
                        yield rows(parts)
                        parts, waiting = [], 0
        if parts:
            yield rows(parts)

    return pack


def _ranker(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts the pairs of packed rows and yields the best ``n`` of each item."""

    def summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        a, b, f, g, c = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.append(len(a) > 0, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        return a[first], b[first], f[order[first]], g[order[first]], np.add.reduceat(c[order], first) if len(first) else c

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, waiting, most = [], 0, HELD
        for batch in batches:
            for r in batch.to_pylist():
                k = _unpack(r["many"], r["lines"])
                a, f = np.repeat(np.cumsum(_unpack(r["item"], r["lines"])), k), np.repeat(_unpack(r["f"], r["lines"]), k)
                parts.append((a, _unpack(r["other"], r["pairs"]), f, _unpack(r["g"], r["pairs"]), np.ones(len(a), dtype="int64")))
                waiting += len(a)
                if waiting > most:
                    parts = [summed(parts)]
                    waiting = len(parts[0][0])
                    most = max(HELD, 2 * waiting)
        if not parts:
            return
        a, b, f, g, c = summed(parts)
        score = c / np.sqrt(f.astype(float) * g.astype(float))
        order = np.lexsort((b, -score, a))
        a = a[order]
        starts = np.flatnonzero(np.append(len(a) > 0, a[1:] != a[:-1]))
        place = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
        best = place < n
        at = order[best]
        out = pa.RecordBatch.from_arrays([pa.array(x) for x in (a[best], b[at], c[at], score[at], (place[best] + 1).astype("int32"))], ["item_id", "other_id", "together", "score", "rank"])
        for i in range(0, len(out), 1 << 16):
            yield out.slice(i, 1 << 16)

    return rank
