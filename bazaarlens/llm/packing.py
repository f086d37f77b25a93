"""Packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stage, texts

CAPACITY = 2048
END_ID = 0
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


class _Table(dict):
    """Ids by word; words asked for in vain are noted."""

    def __init__(self):
        super().__init__()
        self.missed = []

    def __missing__(self, word: str) -> None:
        self.missed.append(word)


class WordTokenizer:
    """Ids of a text by the ``tokenizers`` library, word by word with bounded tables.

    The vocabulary drops white space and no token spans it, so a text cut at
    spaces and line feeds has the ids of its parts in order. It also folds case and
    parts letters from punctuation, so a Latin word with one mark behind it is the
    word in lower case and the mark. Each distinct part goes through the library;
    of two bounded generations, the older gives back what is still in use.
    """

    def __init__(self, path: str, keep: int = 700_000):
        from tokenizers import Tokenizer
        self.tokenizer, self.keep, self.known, self.older = Tokenizer.from_file(path), keep, _Table(), {}

    def _library(self, words: list[str]) -> None:
        for at in range(0, len(words), 10_000):
            some = words[at : at + 10_000]
            coded = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            self.known.update((w, array("I", e.ids).tobytes()) for w, e in zip(some, coded))

    def _learn(self, words: set[str]) -> None:
        if len(self.known) > self.keep:
            self.known, self.older = _Table(), self.known
        base, made, older = {}, self.known, self.older
        for w in words:
            if w in made:
                continue
            if (ids := older.get(w)) is not None:
                made[w] = ids
                continue
            stem = w[:-1] if w[-1:] in ",.!?;:" else w
            base[w] = stem.lower() if stem.isalpha() and max(stem) < "\u0100" else None
        ask = {b if b is not None else w for w, b in base.items()} | {w[-1:] for w, b in base.items() if b is not None and len(w) > len(b)}
        for w in [w for w in ask if w not in made and w in older]:
            made[w] = older[w]
        self._library([w for w in ask if w not in made])
        for w, b in base.items():
            if b is not None:
                made[w] = made[b] if len(w) == len(b) else made[b] + made[w[-1:]]

    def __call__(self, text: str) -> bytes:
        parts = text.replace("\n", " ").split(" ")
        found = list(map(self.known.__getitem__, parts))
        if self.known.missed:
            new, self.known.missed = set(self.known.missed), []
            self._learn(new)
            found = [self.known[p] if ids is None else ids for p, ids in zip(parts, found)]
        return b"".join(found)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of each document: doc_id, piece, start, length, ids_crc32.

    A document is its ids and ``end_id``; only one of more than ``capacity`` ids is
    cut. Null and empty texts are the end id alone. Tokens themselves are not
    returned: the checksum of a piece and its place in the document identify them.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _tokenizer(vocabulary), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(cols, _PIECES)], schema=_PIECES)

    return texts(docs, id_col, text_col).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(uids: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: per item the bin (uid of its first item), the offset, the bin's fill.

    Open bins are kept by free space; a bit mask over free spaces finds the
    tightest one that takes an item, so an item costs the same at any bin count.
    """
    order = np.lexsort((uids, -lengths))
    bins, offsets = np.empty(len(uids), dtype=np.int64), np.empty(len(uids), dtype=np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, fill = 0, {}
    for i in order.tolist():
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            owner = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            room, owner = capacity, int(uids[i])
        bins[i], offsets[i] = owner, capacity - room
        room -= size
        fill[owner] = capacity - room
        if room:
            if not free[room]:
                mask |= 1 << room
            free[room].append(owner)
    return bins, offsets, np.fromiter((fill[b] for b in bins.tolist()), dtype=np.int64, count=len(bins))


def hierarchical_best_fit(items: DataFrame, capacity: int = CAPACITY, group_items: int = 20_000, slack: int = 8) -> DataFrame:
    """Bins for items (uid unique bigint, length 1..capacity): uid, bin, offset.

    Round 0 deals items by hash into groups of about ``group_items`` and packs each
    by best fit. Bins with at most ``slack`` free tokens are final; the others go on
    as single items of their fill, dealt into fewer groups, and are packed again,
    until one group has held them all or a round has joined fewer than one bin in a
    thousand (bins over half full cannot be joined at any group size). A group is
    bounded by its expected size because ids are unique and hashed. Offsets add up
    over rounds. No items give no bins.
    """
    spark = items.sparkSession
    level = stage(items.select("uid", F.col("length").cast("bigint").alias("length")), "pack-items")
    placed, n = [], level.count()
    while n:
        groups = -(-n // group_items)

        def pack(frame: pd.DataFrame) -> pd.DataFrame:
            b, o, f = best_fit(frame["uid"].to_numpy(), frame["length"].to_numpy(), capacity)
            return pd.DataFrame({"uid": frame["uid"].to_numpy(), "bin": b, "offset": o, "fill": f})

        dealt = level.withColumn("g", F.pmod(F.xxhash64("uid", F.lit(len(placed))), F.lit(groups)))
        out = stage(dealt.groupBy("g").applyInPandas(pack, "uid bigint, bin bigint, offset bigint, fill bigint"), "pack-round")
        placed.append(out)
        level = out.filter((F.col("uid") == F.col("bin")) & (F.col("fill") < capacity - slack)).select("uid", F.col("fill").alias("length"))
        made, left = out.filter("uid = bin").count(), level.count()
        if groups == 1 or left < 2 or (len(placed) > 1 and made > 0.999 * n):
            break
        n = left
    if not placed:
        return spark.createDataFrame([], "uid bigint, bin bigint, offset bigint")
    result = placed[0].select("uid", "bin", "offset")
    for later in placed[1:]:
        step = later.select(F.col("uid").alias("bin"), F.col("bin").alias("next"), F.col("offset").alias("shift"))
        result = (result.join(step, "bin", "left")
                  .select("uid", F.coalesce("next", "bin").alias("bin"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")))
    return result


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document with the sequence that holds them.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Full
    pieces are sequences of their own; shorter ones are packed. Null ids pass
    through; repeated rows are packed as often as they occur.
    """
    cut = stage(pieces(docs, vocabulary, capacity, id_col=id_col, text_col=text_col).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    bins = hierarchical_best_fit(cut.filter(F.col("length") < capacity).select("uid", "length"), capacity)
    return (cut.join(bins, "uid", "left")
            .select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("bin", "uid").alias("sequence_id"), F.coalesce("offset", F.lit(0)).cast("bigint").alias("offset")))


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op10_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
