"""Fill-in-middle: segments of a text exchanged in place by block rotations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .shared import byte_chunks, texts

# fixed values: sentinels before the prefix, the suffix and the middle
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
BLOCK = 1 << 16


def rotate(buffer: bytearray, start: int, cut: int, end: int) -> None:
    """Exchange ``buffer[start:cut]`` and ``buffer[cut:end]`` in place, by three reversals."""
    view = np.frombuffer(buffer, dtype=np.uint8)
    for a, b in ((start, cut), (cut, end), (start, end)):
        view[a:b] = view[a:b][::-1]


class CodePoints:
    """Code points of UTF-8 bytes, counted by block so that long texts need no table of their places."""

    def __init__(self, data: np.ndarray):
        self.lead = (data & 0xC0) != 0x80
        blocks = np.arange(0, len(data), BLOCK)
        self.before = np.concatenate([[0], np.cumsum(np.add.reduceat(self.lead, blocks, dtype=np.int64))]) if len(data) else np.zeros(1, dtype=np.int64)
        self.total = int(self.before[-1])

    def byte_of(self, k: int) -> int:
        """Offset of code point ``k``, or of the end."""
        if k >= self.total:
            return len(self.lead)
        block = int(np.searchsorted(self.before, k, side="right")) - 1
        return block * BLOCK + int(np.flatnonzero(self.lead[block * BLOCK : (block + 1) * BLOCK])[k - self.before[block]])


def draws(key: str, seed: int) -> list[int]:
    """Four unsigned 32-bit numbers from the SHA-256 of ``seed:key``."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def exchange(data: bytes, prefix: int, middle: int, form: str) -> bytearray:
    """Text with sentinels, in the order of ``form``; ``prefix`` and ``middle`` are the byte offsets of the two cuts."""
    buffer = bytearray(data)
    buffer[middle:middle] = SUFFIX
    buffer[prefix:prefix] = MIDDLE
    buffer[0:0] = PREFIX
    suffix = middle + len(PREFIX) + len(MIDDLE)
    rotate(buffer, 0 if form == "spm" else prefix + len(PREFIX), suffix, len(buffer))
    return buffer


def rebuild(data: bytes, form: str) -> bytearray:
    """The text that ``exchange`` was given, from its output and form alone."""
    buffer = bytearray(data)
    if form == "plain":
        return buffer
    # A sentinel begins with the only '<' in it, so its first match is the sentinel itself whatever stands before it.
    if form == "spm":
        start, cut = 0, buffer.find(PREFIX)
    else:
        start = buffer.find(SUFFIX)
        cut = buffer.find(MIDDLE, start)
    rotate(buffer, start, cut, len(buffer))
    suffix = len(buffer) - (cut - start)
    middle = buffer.find(MIDDLE)
    for at in (suffix, middle, 0):
        del buffer[at : at + 3]
    return buffer


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).view(pa.string())


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, share: int = 90, spm: int = 20) -> DataFrame:
    """Texts cut in three at two places drawn from their id, prefix and suffix put before the middle.

    Returns, per input row, doc_id, n (code points), form, prefix_chars, middle_chars
    and output. ``share`` per cent of the texts are exchanged, ``spm`` per cent of these
    with the suffix first; the others, empty texts and texts that hold a sentinel are
    ``plain``: output is the text, and the two lengths are null.

    A text is one bytearray: cuts are found by a scan over code points, sentinels are
    inserted, and segments change places by three reversals in place. Rows are worked
    on alone, in slices of about 1 MB (a longer text is a slice of its own), so memory is
    a few times the longest text.

    Null text is empty. Ids may be of any type that has a text form; a null id counts as
    an empty one. Rows with equal id and text get the same result, each its own row. No
    rows in, no rows out; further columns of ``docs`` are not read.
    """
    rows = texts(docs, id_col, text_col).withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, ends in byte_chunks(batches):
            found: dict[str, list] = {name: [] for name in ("n", "form", "prefix", "middle", "output")}
            for key, a, b in zip(batch.column(2).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                points, raw = CodePoints(data[a:b]), data[a:b].tobytes()
                h1, h2, h3, h4 = draws(key, seed)
                low, high = sorted((h1 % (points.total + 1), h2 % (points.total + 1)))
                plain = not raw or any(s in raw for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= share
                form = "plain" if plain else "spm" if h4 % 100 < spm else "psm"
                found["n"].append(points.total)
                found["form"].append(form)
                found["prefix"].append(None if plain else low)
                found["middle"].append(None if plain else high - low)
                found["output"].append(raw if plain else bytes(exchange(raw, points.byte_of(low), points.byte_of(high), form)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found["n"], pa.int64()), pa.array(found["form"], pa.string()), pa.array(found["prefix"], pa.int64()),
                 pa.array(found["middle"], pa.int64()), _strings(found["output"])], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(exchanged: DataFrame, form_col: str = "form", output_col: str = "output", name: str = "restored") -> DataFrame:
    """Rows with one more column ``name``: the text before the exchange, by the inverse rotations.

    Only form and output are looked at. A null output counts as empty; a null form as ``plain``.
    ``name`` must not be a column yet.
    """
    if name in exchanged.columns:
        raise ValueError(f"column {name!r} exists")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, ends in byte_chunks(batches, output_col):
            forms = rows.column(rows.schema.get_field_index(form_col)).to_pylist()
            back = [bytes(rebuild(data[a:b].tobytes(), form or "plain")) for form, a, b in zip(forms, ends[:-1].tolist(), ends[1:].tolist())]
            yield rows.append_column(name, _strings(back))

    schema = StructType([*exchanged.schema.fields, StructField(name, StringType())])
    return exchanged.mapInArrow(work, schema)


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Every document exchanged, and restored from the outcome."""
    done = restore(fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
s AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM s"""
