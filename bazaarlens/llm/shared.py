"""Helpers shared by the operators of this package: staging, ids, byte arrays, components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of this machine only for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="bazaarlens-llm-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def columns(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns under inner names, so that further or clashing columns do no harm."""
    return df.select(*[df[old].alias(new) for new, old in names.items()])


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null text as empty."""
    return columns(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def remainder(key: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    c = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(n))


def byte_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole rows with about ``limit`` bytes of text: (rows, bytes, offsets).

    A single longer text is a slice of its own.
    """
    for batch in batches:
        i = batch.schema.get_field_index(column)
        n, at = batch.num_rows, 0
        if not n:
            continue
        column_ = batch.column(i).fill_null("") if batch.column(i).null_count else batch.column(i)
        width = np.int64 if pa.types.is_large_string(column_.type) or pa.types.is_large_binary(column_.type) else np.int32
        ends = np.frombuffer(column_.buffers()[1], dtype=width)[column_.offset : column_.offset + n + 1].astype(np.int64)
        data = np.frombuffer(column_.buffers()[2] or b"", dtype=np.uint8)
        while at < n:
            to = int(min(n, max(at + 1, np.searchsorted(ends, ends[at] + limit, side="right") - 1)))
            yield batch.slice(at, to - at), data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
            at = to


_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []
_rng = np.random.default_rng(20240115)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64; kept up to 8 million."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS[0], _POWERS[1]
    size = 1 << max(16, int(n).bit_length())
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        a = np.full(size, base, dtype=np.uint64)
        a[0] = 1
        np.multiply.accumulate(a, out=a)
        out.append(a)
    if size <= 1 << 23:
        _POWERS[:] = out
    return out[0], out[1]


def hash_prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash of the bytes; ``span_hash`` reads any span from it."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.multiply(_BYTE[data], _powers(len(data) + 1)[0][: len(data)], out=out[1:])
    np.cumsum(out[1:], out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Bit mixer over uint64 (changes a fresh array)."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for arrays of spans; equal bytes give equal hashes."""
    inverse = _powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs without ASCII white space) of all texts of a chunk: start, end, text number."""
    n = len(data)
    if not n:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    inside = ~_SPACE[data]
    edge = np.empty(n, dtype=bool)
    edge[0] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:])
    edge[ends[:-1][ends[:-1] < n]] = True
    cuts = np.flatnonzero(edge)
    keep = inside[cuts]
    to = np.append(cuts[1:], n)[keep]
    start = cuts[keep]
    return start, to, np.searchsorted(ends, start, side="right") - 1


LINKS_TO_A_TASK = 1_000_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one task as links of each node to the smallest node that they join it with."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    a, b = (pa.concat_arrays([x.column(k) for x in batches]) for k in (0, 1))
    names = pa.concat_arrays([a, b]).unique()
    names = names.take(pc.array_sort_indices(names))
    i, j = (pc.index_in(x, names).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    own = np.flatnonzero(root != np.arange(len(root)))
    yield pa.RecordBatch.from_arrays([names.take(pa.array(own)), names.take(pa.array(root[own]))], names=["a", "b"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected links (a, b): (node, root), root being the smallest node.

    Links are first contracted in tasks of about a million, each on its own. Then two rewirings that keep
    components alternate: every larger neighbour of a node, then every smaller one, is tied to the smallest
    neighbour. The number of links never grows, hubs are pre-aggregated by ``min`` before the shuffle, and
    only a count and a sum reach the driver. Raises if it has not settled.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    marked = lambda links: tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = marked(now)
    tasks = -(-seen[0] // LINKS_TO_A_TASK)
    if tasks:
        now = stage(now.repartition(tasks).mapInArrow(_contract, now.schema).distinct(), "links")
        seen = marked(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = stage(small.filter("a <> b").distinct(), "links")
        mark = marked(now)
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
    raise RuntimeError(f"components did not settle in {rounds} rounds")
