"""Removal of passages that occur elsewhere: column-wise construction over anchored blocks of many texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import byte_chunks, hash_prefix, span_hash, stage, texts

LENGTH = 200
GRAM = 40
_PLACE = np.uint64((1 << 24) - 1)


def blocks_of(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Blocks of windows that share an anchor, of all texts of a chunk.

    The anchor of a ``length``-byte window is the leftmost of its ``gram``-byte strings
    with the least hash, so equal windows have equal anchors at equal places in
    them. Neighbouring windows of one anchor make a block, the bytes from the first
    one's start to the last one's end. Every window lies in one block.
    """
    n, span = len(data), length - gram + 1
    if n < length:
        z = np.zeros(0, dtype=np.int64)
        return {"text": z, "start": z, "windows": z, "lead": z, "anchor": z, "content": z}
    prefix = hash_prefix(data)
    at = np.arange(n - gram + 1)
    grams = span_hash(prefix, at, at + gram)
    best = grams & ~_PLACE | at.astype(np.uint64)
    width = 1
    while 2 * width <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < span:
        best = np.minimum(best[: n - length + 1], best[span - width :][: n - length + 1])
    anchor = (best & _PLACE).astype(np.int64)
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[: n - length + 1]
    inside = np.arange(n - length + 1) + length <= ends[1:][text]
    first = np.empty(len(anchor), dtype=bool)
    first[0] = True
    np.not_equal(anchor[1:], anchor[:-1], out=first[1:])
    first[1:] |= text[1:] != text[:-1]
    first[1:] |= inside[1:] != inside[:-1]
    cut = np.flatnonzero(first)
    stop = np.append(cut[1:], len(anchor))
    use = inside[cut]
    cut, stop = cut[use], stop[use]
    return {"text": text[cut], "start": cut - ends[:-1][text[cut]], "windows": stop - cut, "lead": anchor[cut] - cut,
            "anchor": grams[anchor[cut]].view(np.int64), "content": span_hash(prefix, cut, stop - 1 + length).view(np.int64)}


def repeated_windows(blocks: list[bytes], lead: np.ndarray, copies: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each block, which of its windows another block or copy has.

    Blocks are aligned at their anchors, where equal windows stand in equal columns.
    From the last column to the first, each round inserts one symbol of every block
    that reaches there: a stable counting sort of the current order by that symbol
    is the order of the longer suffixes, and the common prefix of two neighbours with
    the same symbol is one more than the least common prefix between their old
    places. Windows whose suffix shares ``length`` symbols with a neighbour's repeat.
    Both arrays are rewritten front to back in each round; nothing else is kept.
    """
    m, sizes = len(blocks), np.fromiter(map(len, blocks), dtype=np.int64, count=len(blocks))
    windows = sizes - length + 1
    widest = int(lead.max()) if m else 0
    left = widest - lead
    right = left + sizes
    columns = int(right.max()) if m else 0
    table = np.zeros((columns, m), dtype=np.uint8)
    flat = np.frombuffer(b"".join(blocks), dtype=np.uint8)
    owner = np.repeat(np.arange(m), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + left[owner]
    table[place, owner] = flat
    found = np.zeros((columns, m), dtype=bool)
    joins = np.argsort(-right, kind="stable")
    joined, order, common = 0, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for j in range(columns - 1, -1, -1):
        keep = np.flatnonzero(left[order] <= j)
        if len(keep) < len(order):
            common = np.minimum.reduceat(common[: keep[-1] + 1], np.append(0, keep[:-1] + 1)) if len(keep) else common[:0]
            order = order[keep]
        upto = joined
        while upto < m and right[joins[upto]] > j:
            upto += 1
        if upto > joined:
            fresh = joins[joined:upto][left[joins[joined:upto]] <= j]
            if len(common):
                common[0] = 0
            order, common, joined = np.concatenate([fresh, order]), np.concatenate([np.zeros(len(fresh), np.int64), common]), upto
        if not len(order):
            continue
        symbol = table[j, order]
        by = np.argsort(symbol, kind="stable")
        longer = np.zeros(len(order), dtype=np.int64)
        edge = np.append(np.flatnonzero(np.append(True, symbol[by][1:] != symbol[by][:-1])), len(by))
        for a, b in zip(edge.tolist(), edge[1:].tolist()):
            if b - a > 1:
                old = by[a:b]
                longer[a + 1 : b] = np.minimum.reduceat(common[: old[-1] + 1], old[:-1] + 1) + 1
        order, common = order[by], longer
        hit = np.flatnonzero(common >= length)
        if len(hit):
            found[j, order[hit]] = True
            found[j, order[hit - 1]] = True
    return [np.ones(w, dtype=bool) if c > 1 else found[a : a + w, i] for i, (a, w, c) in enumerate(zip(left, windows, copies))]


def _runs(flags: np.ndarray) -> list[int]:
    """Start and end of each run of true flags, in one list."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge.tolist()


_BLOCK = "row bigint, place bigint, anchor bigint, content bigint"


def _blocks(batches: Iterator[pa.RecordBatch], part: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """(row, place, anchor, content) of every block; place packs start, windows and lead.

    Texts of over ``part`` bytes are taken in parts that overlap by a window less one byte.
    """
    for rows, data, ends in byte_chunks(batches, limit=1 << 20):
        row = rows.column("row").to_numpy()
        for at in range(0, max(len(data), 1), part) if rows.num_rows == 1 else (0,):
            piece = data[at : at + part + LENGTH - 1] if rows.num_rows == 1 else data
            b = blocks_of(piece, np.array([0, len(piece)]) if rows.num_rows == 1 else ends)
            place = b["start"] + at << 20 | b["windows"] << 10 | b["lead"]
            yield pa.RecordBatch.from_arrays([pa.array(row[b["text"]]), pa.array(place), pa.array(b["anchor"]), pa.array(b["content"])], names=["row", "place", "anchor", "content"])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of wanted blocks: each row has a text and the places, anchors, contents and counts of its blocks."""
    for batch in batches:
        out = []
        for text, wanted in zip(batch.column("text"), batch.column("wanted").to_pylist()):
            data = text.as_py().encode()
            for w in wanted:
                start, windows, lead = w["place"] >> 20, w["place"] >> 10 & 1023, w["place"] & 1023
                out.append((w["anchor"], w["content"], w["n"], lead, data[start : start + windows - 1 + LENGTH]))
        cols = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["anchor", "content", "n", "lead", "bytes"])


def _cells(batches: Iterator[pa.RecordBatch], most: int = 8192) -> Iterator[pa.RecordBatch]:
    """Runs of repeated windows per block, from blocks sorted by anchor; a cell holds whole anchors, about ``most`` blocks."""

    def done(cell):
        anchor, content, n, lead, data = (list(c) for c in zip(*cell))
        flags = repeated_windows(data, np.array(lead, dtype=np.int64), np.array(n, dtype=np.int64))
        return pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(content, pa.int64()), pa.array([_runs(f) for f in flags], pa.list_(pa.int32()))], names=["anchor", "content", "runs"])

    cell = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if len(cell) >= most and row[0] != cell[-1][0]:
                yield done(cell)
                cell = []
            cell.append(row)
    if cell:
        yield done(cell)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, pieces in zip(batch.column("text"), batch.column("pieces").to_pylist()):
            data, kept, at, removed, spans = text.as_py().encode(), hashlib.sha256(), 0, 0, []
            for a, b in sorted((p["a"], p["b"]) for p in pieces or []):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            for a, b in spans:
                kept.update(data[at:a])
                at, removed = b, removed + b - a
            kept.update(data[at:])
            out.append((len(data), removed, len(spans), kept.hexdigest(), [x for s in spans for x in s]))
        cols = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())))]],
                                         names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What is left of every row after removing bytes under 200-byte strings that start elsewhere too.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (starts and ends
    of the removed runs, in bytes).

    Windows are dealt by their anchors, whole blocks at a time. Anchors that occur once
    are dropped after a count. Equal blocks are counted and stand for each other, so a
    passage with any number of copies is one block; only anchors with several
    different blocks need symbols compared. A cell of that takes whole anchors, so an
    anchor with very many different blocks is one large cell. Runs go back to all
    places of their block.

    The rows are read three times and matched by their place in the scan, so
    ``docs`` must be a table or a written result. Null and empty texts, and those below
    200 bytes, lose nothing. Repeated rows remove each other; null ids pass through.
    """
    rows = texts(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    read = rows.select("row", "text")
    blocks = read.mapInArrow(_blocks, _BLOCK)
    often = blocks.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    found = stage(blocks.join(often, "anchor"), "repeat-blocks")
    groups = found.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(F.struct("row", "place")).alias("at"))
    groups = stage(groups.select("anchor", "content", "n", "at.row", "at.place"), "repeat-groups")
    kinds = groups.groupBy("anchor").agg(F.count("*").alias("kinds"))
    groups = groups.join(kinds, "anchor")
    wanted = groups.filter("kinds > 1").groupBy("row").agg(F.collect_list(F.struct("place", "anchor", "content", "n")).alias("wanted"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    content = read.join(wanted, "row").select("text", "wanted").mapInArrow(_contents, "anchor bigint, content bigint, n bigint, lead int, bytes binary")
    compared = content.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_cells, "anchor bigint, content bigint, runs array<int>")
    alone = groups.filter("kinds = 1").select("anchor", "content", F.array(F.lit(0), F.shiftright("place", 10).bitwiseAND(F.lit(1023)).cast("int")).alias("runs"))
    runs = stage(compared.filter("size(runs) > 0").unionByName(alone), "repeat-runs")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.size("runs") - 1, F.lit(2)), lambda i: F.struct(
        (F.shiftright("place", 20) + F.get("runs", i)).alias("a"), (F.shiftright("place", 20) + F.get("runs", i + 1) - 1 + LENGTH).alias("b"))))
    pieces = found.join(runs, ["anchor", "content"]).select("row", pair.alias("p")).groupBy("row").agg(F.collect_list("p").alias("pieces"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.join(pieces, "row", "left").select("doc_id", "text", "pieces").mapInArrow(
        _cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<bigint>")


def op1_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its repeated passages removed."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
