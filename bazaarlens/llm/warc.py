"""WARC archives written and read by Spark, with verified record boundaries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import new_path, stage

MAGIC = b"WARC/1.1\r\n"
END = "\r\n\r\n"
MIN_REVISIT = 100
PACKED = ("brotli", 5)
_FIELDS = ("page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string")
_CANDIDATE = f"file string, block bigint, rel bigint, label bigint, next bigint, head bigint, size bigint, whole boolean, {_FIELDS}"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payloads compressed for the shuffle (brotli knows markup beforehand, and each is compressed alone), with length and digest."""
    codec = pa.Codec(PACKED[0], compression_level=PACKED[1])
    for batch in batches:
        data = [(v.as_py() or "").encode() for v in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([codec.compress(d, asbytes=True) for d in data], type=pa.binary()), pa.array([len(d) for d in data], type=pa.int64()),
                                          pa.array([hashlib.sha256(d).digest() for d in data], type=pa.binary())], names=["page_id", "url", "packed", "bytes", "digest"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Length and digest of the payloads alone."""
    for batch in batches:
        data = [(v.as_py() or "").encode() for v in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(d) for d in data], type=pa.int64()), pa.array([hashlib.sha256(d).digest() for d in data], type=pa.binary())], names=["page_id", "bytes", "digest"])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One record per row, less the line ends that close it."""
    codec = pa.Codec(PACKED[0])
    urn = lambda i: f"<urn:page:{'' if i is None else i}>"
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            payload = "" if r["revisit"] else codec.decompress(r["packed"], r["bytes"], asbytes=True).decode()
            url = (r["url"] or "").replace("\r", "%0D").replace("\n", "%0A")  # no value can end its line
            fields = {"WARC-Type": "revisit" if r["revisit"] else "response", "WARC-Record-ID": urn(r["page_id"]), "WARC-Target-URI": url, "WARC-Date": "2024-01-15T00:00:00Z",
                      "WARC-Payload-Digest": f"sha256:{r['digest'].hex()}", "WARC-Payload-Length": r["bytes"]}
            if r["revisit"]:
                fields |= {"WARC-Refers-To": urn(r["first"]), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
            fields |= {"Content-Type": "text/html; charset=utf-8", "Content-Length": len(payload.encode())}
            out.append(MAGIC.decode() + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n" + payload)
        yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.string())], names=["value"])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT) -> None:
    """One record per row, in one archive per task below ``path``.

    Of equal payloads of at least ``min_revisit`` bytes, that of the smallest id is
    a response and the others are revisits without a payload that refer to it. Null
    html is an empty payload; a null id stays null and is never referred to unless
    all ids of its group are null; a row repeated with the smallest id is a response each time.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    seen = rows.select("page_id", "html").mapInArrow(_digests, "page_id bigint, bytes bigint, digest binary")
    rows = rows.mapInArrow(_pack, "page_id bigint, url string, packed binary, bytes bigint, digest binary")
    first = seen.filter(F.col("bytes") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    rows = rows.join(first, "digest", "left").withColumn("revisit", F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    rows.mapInArrow(_records, "value string").write.option("lineSep", END).text(path)


def _header(head: bytes) -> dict[str, str] | None:
    """Header fields, or None for what is no record header."""
    fields = {}
    for row in head.split(b"\r\n"):
        name, colon, value = row.partition(b": ")
        if not colon:
            return None
        fields[name.decode("utf-8", "replace").lower()] = value.decode("utf-8", "replace")
    return fields if fields.get("content-length", "").isdecimal() and "warc-type" in fields else None


def _number(text: str) -> int | None:
    digits = text.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdecimal() else None


def _labels(found: list[dict]) -> None:
    """Give the candidates of a split the chain they lie on and where that chain goes on.

    Walking from the lowest unlabelled candidate to its successor until the split
    or unlabelled ground ends makes chains; each goes on at one place, a candidate
    of another chain or one beyond the split.
    """
    by_place = {c["rel"]: c for c in found}
    for c in found:
        if "label" in c:
            continue
        chain, at = [], c
        while at is not None and "label" not in at:
            at["label"] = c["rel"]
            chain.append(at)
            at = by_place.get(chain[-1]["succ"])
        for x in chain:
            x["next"] = chain[-1]["succ"]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split of an archive, whatever looks like a record, and the split's length.

    Rows are the text between two magic lines, in file order. A place is counted
    from the split's first byte read; ``rel`` is where a candidate's header begins.
    """
    names = [f.split()[0] for f in _CANDIDATE.split(", ")]
    types = [pa.string() if "string" in f else pa.bool_() if "boolean" in f else pa.int64() for f in _CANDIDATE.split(", ")]

    def rows(key, found, length):
        _labels(found)
        out = [dict(c, file=key[0], block=key[1]) for c in found] + [{"file": key[0], "block": key[1], "rel": -1, "size": length}]
        return pa.RecordBatch.from_arrays([pa.array([c.get(n) for c in out], type=t) for n, t in zip(names, types)], names=names)

    key, found, at = None, [], 0
    for batch in batches:
        for file, block, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if (file, block) != key:
                if key is not None:
                    yield rows(key, found, at)
                key, found, at = (file, block), [], 0
            data = value.as_py()
            head, gap, rest = data.partition(b"\r\n\r\n")
            fields = _header(head) if gap else None
            if fields is not None:
                size = int(fields["content-length"])
                whole = len(rest) == size + 4 and rest.endswith(b"\r\n\r\n")
                response = fields["warc-type"] == "response"
                found.append({
                    "rel": at, "succ": at + len(head) + 4 + size + 4 + len(MAGIC), "head": len(head) + 4, "size": size, "whole": whole,
                    "page_id": _number(fields.get("warc-record-id", "")), "record_type": fields["warc-type"], "url": fields.get("warc-target-uri"),
                    "payload_bytes": size if response else _number(fields.get("warc-payload-length", "")),
                    "payload_digest": hashlib.sha256(memoryview(rest)[:size]).hexdigest() if response else fields.get("warc-payload-digest", "").removeprefix("sha256:"),
                    "refers_to": _number(fields.get("warc-refers-to", ""))})
            at += len(data) + len(MAGIC)
    if key is not None:
        yield rows(key, found, at)


def _reached(nodes: DataFrame, start: int) -> DataFrame:
    """Nodes (file, at, next) that the start of their file leads to, by pointer jumping.

    Each round doubles the reach of every pointer, so a file of n splits takes about
    log2 n rounds over a few rows per split.
    """
    got = stage(nodes.filter(F.col("at") == start).select("file", "at"), "warc-reached")
    jump, n = stage(nodes.select("file", "at", "next").filter("next is not null"), "warc-jump"), got.count()
    while True:
        step = got.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))
        more = stage(got.unionByName(step).distinct(), "warc-reached")
        ahead = jump.select("file", F.col("at").alias("next"), F.col("next").alias("beyond"))
        jump = stage(jump.join(ahead, ["file", "next"]).select("file", "at", F.col("beyond").alias("next")), "warc-jump")
        m = more.count()
        got = more
        if m == n or jump.isEmpty():
            return got
        n = m


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    Archives are split at the magic line wherever it stands. Every piece that has a
    record header is a candidate with the place of its successor; only candidates
    that a chain of successors joins to the file's start are records. A payload
    that holds the magic line is put together again from its pieces, also over
    splits. Archives without records give no rows.
    """
    lines = (spark.read.option("lineSep", MAGIC.decode()).text(path)
             .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value")))
    found = stage(lines.mapInArrow(_candidates, _CANDIDATE), "warc-candidates")
    order = Window.partitionBy("file").orderBy("block")
    splits = found.filter("rel < 0").select("file", "block", F.col("size").alias("length"), (F.sum("size").over(order) - F.col("size")).alias("base"))
    splits = stage(splits, "warc-splits")
    cand = (found.filter("rel >= 0").join(splits.drop("length"), ["file", "block"])
            .withColumn("at", F.col("base") + F.col("rel")).withColumn("label", F.col("base") + F.col("label")).withColumn("next", F.col("base") + F.col("next")))
    start = len(MAGIC)
    entries = cand.select("file", F.col("next").alias("at")).unionByName(cand.filter(F.col("at") == start).select("file", "at")).distinct()
    nodes = stage(cand.select("file", "at", "label", "next").join(entries, ["file", "at"]), "warc-nodes")
    low = nodes.join(_reached(nodes, start), ["file", "at"]).groupBy("file", "label").agg(F.min("at").alias("low"))
    records = stage(cand.join(low, ["file", "label"]).filter("at >= low"), "warc-records")
    fields = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    parted = records.filter("not whole and record_type = 'response'").select("file", "at", "head", "size")
    if parted.isEmpty():
        return records.select(fields)
    return (records.join(_joined_payloads(lines, splits, parted), ["file", "at"], "left")
            .withColumn("payload_digest", F.coalesce("joined_digest", "payload_digest")).select(fields))


def _joined_payloads(lines: DataFrame, splits: DataFrame, parted: DataFrame) -> DataFrame:
    """Digest of payloads that the magic line cuts: (file, at, joined_digest)."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at = None, 0
        for batch in batches:
            out = []
            for file, block, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if (file, block) != key:
                    key, at = (file, block), 0
                out.append((file, block, at, value))
                at += len(value) + len(MAGIC)
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.binary()))], names=["file", "block", "rel", "value"])

    spans = parted.select("file", F.col("at").alias("record"), (F.col("at") + F.col("head")).alias("from"), (F.col("at") + F.col("head") + F.col("size")).alias("to"))
    over = spans.join(splits, "file").filter("base < `to` and base + length > record")
    placed = lines.mapInArrow(places, "file string, block bigint, rel bigint, value binary")
    part = (placed.join(over, ["file", "block"]).withColumn("at", F.col("base") + F.col("rel"))
            .filter("at < `to` and at + length(value) >= record and at >= record"))
    cut = F.substring(F.concat(F.col("value"), F.lit(MAGIC)), F.greatest(F.col("from") - F.col("at"), F.lit(0)) + 1, F.greatest(F.col("to") - F.greatest("from", "at"), F.lit(0)))
    whole = part.select("file", F.col("record"), F.struct("at", cut.cast("binary").alias("bytes")).alias("piece")).groupBy("file", "record").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    return whole.select("file", F.col("record").alias("at"), F.sha2(F.aggregate("pieces", F.lit(b""), lambda a, p: F.concat(a, p["bytes"])), 256).alias("joined_digest"))


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as archives and read every record back."""
    path = path or new_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through archives: payload, digest, record type and reference per page."""
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS d FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS f FROM p)
SELECT page_id, b AS payload_bytes, d AS payload_digest, CASE WHEN b >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN b >= 100 AND page_id <> f THEN f END AS refers_to
FROM g"""
