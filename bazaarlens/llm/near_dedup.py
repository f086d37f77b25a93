"""Near duplicates: improved consistent weighted sampling over TF-IDF shingles, banded and verified."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import byte_chunks, components, hash_prefix, mix, span_hash, stage, texts, word_spans

WORDS, SIMILARITY = 5, 0.8
BANDS, BAND_ROWS = 12, 3
#: Sketched agreement below which a candidate is not compared: 2.8 standard errors under 0.8 of 36 samples.
LEAST_AGREEMENT = 22
#: Buckets of up to SMALL texts are paired in full; in larger ones a text first meets the FEW before it in
#: a random order of its part of about PART texts, and then the texts of other classes in all of the bucket.
SMALL, FEW, PART = 16, 3, 300
#: Further samples of texts in larger buckets, the agreement of all samples below which these are not compared
#: (again 2.8 standard errors under 0.8), and texts to a block when all pairs of a bucket are looked at.
FURTHER, LEAST_OF_ALL, BLOCK = 128, 116, 2048
#: Bytes of shingles to a block of full comparisons, and of text to a step of ``verify``; a longer text is alone.
BLOCK_BYTES, STEP_BYTES = 1 << 25, 1 << 22
IDF_SHARE = 0.25
DF_BITS, DF_SLICE = 20, 1 << 16
_ID_BITS = np.uint64(52)
_ID_MASK = np.uint64((1 << 52) - 1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def shingles(data: np.ndarray, ends: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct shingles of each text: (text number, 52-bit id, times in the text), and the word hashes of each text.

    A text with fewer words than a shingle has one, of all its words; one without words has none.
    """
    low = _FOLD[data]
    start, to, owner = word_spans(low, ends)
    word = span_hash(hash_prefix(low), start, to)
    n = len(ends) - 1
    many = np.bincount(owner, minlength=n)
    first = np.cumsum(many) - many
    full = np.flatnonzero(owner[words - 1 :] == owner[: len(owner) - words + 1]) if len(owner) >= words else np.zeros(0, np.int64)
    value = np.zeros(len(full), dtype=np.uint64)
    for k in range(words):
        value = value * np.uint64(0x9E3779B97F4A7C15) + word[full + k]
    short = np.flatnonzero((many > 0) & (many < words))
    few = np.zeros(len(short), dtype=np.uint64)
    for k in range(words - 1):
        has = many[short] > k
        few[has] = few[has] * np.uint64(0x9E3779B97F4A7C15) + word[first[short][has] + k]
    key = np.concatenate([owner[full], short]).astype(np.uint64) << _ID_BITS | mix(np.concatenate([value, few])) >> np.uint64(12)
    key, times = np.unique(key, return_counts=True)
    return (key >> _ID_BITS).astype(np.int64), key & _ID_MASK, times, np.split(word, np.cumsum(many)[:-1])


def _chunks(batches: Iterator[pa.RecordBatch], column: str = "text"):
    for rows, data, ends in byte_chunks(batches, column):
        for at in range(0, rows.num_rows, 4000):  # text numbers take 12 bits
            to = min(at + 4000, rows.num_rows)
            yield rows.slice(at, to - at), data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]


def _df_cell(ids: np.ndarray) -> np.ndarray:
    return (mix(ids) >> np.uint64(64 - DF_BITS)).astype(np.int64)


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Texts per cell of hashed shingles over all rows, and the number of texts with shingles.

    A count sketch of fixed size: a shingle's count is never too low, and too high
    by about (shingles per text / 2**20) of all texts at every corpus size.
    """

    def count(batches):
        codec, table, n = pa.Codec("zstd"), np.zeros(1 << DF_BITS, dtype=np.int64), 0
        for _, data, ends in _chunks(batches):
            owner, ids, _, _ = shingles(data, ends)
            table += np.bincount(_df_cell(ids), minlength=1 << DF_BITS)
            n += len(np.unique(owner))
        packed = [codec.compress(s.tobytes(), asbytes=True) for s in table.reshape(-1, DF_SLICE)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(packed)), pa.int32()), pa.array(packed, pa.binary()), pa.array([n] + [0] * (len(packed) - 1), pa.int64())], names=["slice", "counts", "n"])

    def add(batches):
        codec, total, n = pa.Codec("zstd"), {}, 0
        for b in batches:
            for k, data, m in zip(*[c.to_pylist() for c in b.columns]):
                part = np.frombuffer(codec.decompress(data, DF_SLICE * 8, asbytes=True), dtype=np.int64)
                total[k], n = total.get(k, 0) + part, n + m
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary()), pa.array([n] + [0] * (len(total) - 1) if total else [], pa.int64())], names=["slice", "counts", "n"])

    spec = "slice int, counts binary, n bigint"
    got = rows.select("text").mapInArrow(count, spec).repartition(16, "slice").mapInArrow(add, spec).collect()  # 8 MB, whatever the corpus
    table = np.zeros(1 << DF_BITS, dtype=np.int64)
    for r in got:
        table[r["slice"] * DF_SLICE : (r["slice"] + 1) * DF_SLICE] = np.frombuffer(r["counts"], dtype=np.int64)
    return table, sum(r["n"] for r in got)


def idf_table(df: np.ndarray, n: int) -> np.ndarray:
    """Weight per cell: 1 for a shingle that all texts hold, up to 1 + IDF_SHARE for one of a single text.

    A group of copies raises the frequency of its own shingles. The bounded share keeps
    that from parting its members: a pair of plain similarity 0.84 stays above 0.8.
    """
    return (1 + IDF_SHARE * np.log(max(n, 1) / np.clip(df, 1, max(n, 1))) / math.log(max(n, 2))).astype(np.float32)


# ---- consistent weighted samples

_grid = (np.arange(1 << 16) + 0.5) / (1 << 16)


def _gamma2_quantiles() -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2 at the middles of 2**16 cells, by bisection."""
    low, high = np.zeros(1 << 16), np.full(1 << 16, 64.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - np.exp(-mid) * (1 + mid) < _grid
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


_GAMMA = _gamma2_quantiles()
_R, _INV_R, _LN_C = _GAMMA.astype(np.float32), (1 / _GAMMA).astype(np.float32), np.log(_GAMMA).astype(np.float32)
_BETA = _grid.astype(np.float32)
_MULT = np.random.default_rng(11).integers(1, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT_FURTHER = np.random.default_rng(12).integers(1, 2**63, FURTHER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def samples(owner: np.ndarray, ids: np.ndarray, weights: np.ndarray, n: int, mult: np.ndarray = _MULT) -> np.ndarray:
    """One 32-bit value per text and sample; two texts share each with the chance of their weighted Jaccard similarity.

    Per shingle and sample: r and c from the gamma(2, 1) distribution, b uniform, all
    read from one hash; t = floor(ln w / r + b), ln y = r (t - b), ln a = ln c - ln y - r.
    The shingle and t of the least a are the sample. Texts without shingles get zeros.
    """
    out = np.zeros((n, len(mult)), dtype=np.uint32)
    if not len(owner):
        return out
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    who, lnw = owner[first], np.log(weights).astype(np.float32)
    low = np.uint64(0xFFFF)
    for k, m in enumerate(mult):
        h = ids * m
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        i = (h >> np.uint64(48)).astype(np.int64)
        beta = _BETA.take((h >> np.uint64(16) & low).astype(np.int64))
        t = np.floor(lnw * _INV_R.take(i) + beta)
        lna = _LN_C.take((h >> np.uint64(32) & low).astype(np.int64)) - _R.take(i) * (t - beta + np.float32(1))
        bits = lna.view(np.uint32)
        order = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))
        name = (h ^ h >> np.uint64(32)).astype(np.uint32) * np.uint32(0x9E3779B1) + t.astype(np.int32).view(np.uint32) * np.uint32(0x85EBCA6B)
        out[who, k] = np.minimum.reduceat(order.astype(np.uint64) << np.uint64(32) | name, first) & np.uint64(0xFFFFFFFF)
    return out


def sketches(rows: DataFrame, weight: "np.ndarray") -> DataFrame:
    """doc_id, digest of the words (null without words), bands, one byte per sample."""
    shared = rows.sparkSession.sparkContext.broadcast(weight)

    def work(batches):
        cell_weight = shared.value
        for part, data, ends in _chunks(batches):
            n = part.num_rows
            owner, ids, times, words = shingles(data, ends)
            got = samples(owner, ids, times * cell_weight[_df_cell(ids)], n)
            band = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
            for j in range(BAND_ROWS):
                band = mix(band * np.uint64(0x9E3779B97F4A7C15) + got[:, j::BAND_ROWS].astype(np.uint64))
            digest = [hashlib.blake2b(w.tobytes(), digest_size=16).digest() if len(w) else None for w in words]
            has = [d is not None for d in digest]
            keys = pa.array([b.view(np.int64) if h else None for b, h in zip(band, has)], type=pa.list_(pa.int64()))
            marks = pa.array([s.tobytes() for s in (got & 255).astype(np.uint8)], type=pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(digest, pa.binary()), keys, marks], names=["doc_id", "digest", "bands", "marks"])

    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, digest binary, bands array<bigint>, marks binary")


def buckets(reps: DataFrame) -> DataFrame:
    """Members of every bucket with at least two texts: key, part, n, id, place and, with their samples, this text and those before it.

    Buckets are counted first (partial sums) and single ones dropped. A bucket of over
    PART texts is dealt by hash into parts of about that size. Order inside a bucket is
    a hash of id and bucket, so a text of a large group meets other members in each
    of its buckets.
    """
    keyed = reps.select("id", F.struct("id", "marks").alias("own"), F.explode("bands").alias("key"))
    many = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    placed = keyed.join(many, "key").withColumn("h", F.xxhash64("id", "key")).withColumn("part", F.pmod("h", F.ceil(F.col("n") / PART)))
    inside = Window.partitionBy("key", "part").orderBy("h", "id")
    before = lambda k: F.collect_list("own").over(inside.rowsBetween(-k, -1))
    near = placed.withColumn("before", F.when(F.col("n") > SMALL, before(FEW)).otherwise(before(SMALL - 1)))
    return near.withColumn("place", F.row_number().over(inside)).select("key", "part", "n", "id", "own", "place", "before")


def candidates(near: DataFrame) -> DataFrame:
    """First pairs (a < b, same) that agree in enough samples: a number linear in the bucket's size, with parts of a bucket chained by their first members."""
    kind = near.schema["id"].dataType.simpleString()
    heads = near.filter(f"place = 1 and n > {PART}").withColumn("before", F.collect_list("own").over(Window.partitionBy("key").orderBy("part").rowsBetween(-1, -1)))
    both = near.select("own", F.explode("before").alias("o")).unionByName(heads.select("own", F.explode("before").alias("o"))).filter("own.id <> o.id")

    def agreeing(batches):
        for b in batches:
            if b.num_rows:
                same = _agreement(b.column("ma"), b.column("mb"))
                ok = pa.array(same >= LEAST_AGREEMENT)
                yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok), pa.array(same.astype(np.int32)).filter(ok)], names=["a", "b", "same"])

    pairs = both.select(F.least("own.id", "o.id").alias("a"), F.greatest("own.id", "o.id").alias("b"), F.col("own.marks").alias("ma"), F.col("o.marks").alias("mb"))
    return pairs.mapInArrow(agreeing, f"a {kind}, b {kind}, same int").groupBy("a", "b").agg(F.max("same").alias("same"))


def further_marks(members: DataFrame, weight: np.ndarray) -> DataFrame:
    """id and one byte per further sample of each text."""
    shared = members.sparkSession.sparkContext.broadcast(weight)

    def work(batches):
        cell_weight = shared.value
        for part, data, ends in _chunks(batches):
            owner, ids, times, _ = shingles(data, ends)
            got = samples(owner, ids, times * cell_weight[_df_cell(ids)], part.num_rows, _MULT_FURTHER)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([s.tobytes() for s in (got & 255).astype(np.uint8)], type=pa.binary())], names=["id", "more"])

    return members.select("id", "text").mapInArrow(work, f"id {members.schema['id'].dataType.simpleString()}, more binary")


def _side(batch: pa.RecordBatch, r: int, prefix: str):
    """Columns of one block of a cell, by name."""
    return lambda name: batch.column(prefix + name)[r].values


class _Cell:
    """A block of texts outside their bucket's largest class, and a block of any of the bucket's texts."""

    def __init__(self, batch: pa.RecordBatch, r: int):
        outer, every = _side(batch, r, "outer_"), _side(batch, r, "")
        self.ids = pa.concat_arrays([outer("id"), every("id")])
        self.roots = pa.concat_arrays([outer("root"), every("root")]).dictionary_encode().indices.to_numpy()
        self.n = len(outer("id"))
        size = BANDS * BAND_ROWS + FURTHER
        self.outer, self.table = (np.frombuffer(b"".join(x("marks").to_pylist()), dtype=np.uint8).reshape(-1, size) for x in (outer, every))
        self.outer_bands, self.bands = (x("bands").flatten().to_numpy().reshape(len(x("id")), -1) for x in (outer, every))
        place = np.empty(len(self.ids), dtype=np.int64)
        place[pc.array_sort_indices(self.ids).to_numpy()] = np.arange(len(self.ids))
        self.place, self.inner = place, ~every("outside").to_numpy(zero_copy_only=False)
        self.key = batch.column("key")[r].as_py()
        self.head = np.ascontiguousarray(self.table[:, : BANDS * BAND_ROWS].T)

    def partners(self, i: int, class_: np.ndarray) -> np.ndarray:
        """Texts of the second block of another class that agree with text ``i`` of the first in most samples.

        A pair is looked at in the first bucket that both are in: there the two classes meet as well.
        """
        first, n = BANDS * BAND_ROWS, self.n
        agree = (self.head == self.outer[i, :first, None]).view(np.uint8).sum(axis=0, dtype=np.uint8)
        j = np.flatnonzero((agree >= LEAST_AGREEMENT) & (class_[n:] != class_[i]) & (self.inner | (self.place[n:] > self.place[i])))
        j = j[agree[j] + (self.table[j, first:] == self.outer[i, first:]).sum(axis=1) >= LEAST_OF_ALL]
        shared = self.bands[j] == self.outer_bands[i]
        earliest = self.outer_bands[i][shared.argmax(axis=1)] == self.key
        here = (self.bands[j] == self.key).any(axis=1) & (self.outer_bands[i] == self.key).any()
        return j[earliest | ~here | ~shared.any(axis=1)]


def _hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id) of the texts that have a partner in a cell."""
    for batch in batches:
        for r in range(batch.num_rows):
            cell = _Cell(batch, r)
            found = np.zeros(len(cell.ids), dtype=bool)
            for i in range(cell.n):
                j = cell.partners(i, cell.roots)
                found[i] = len(j) > 0
                found[cell.n + j] = True
            ids = cell.ids.filter(pa.array(found))
            yield pa.RecordBatch.from_arrays([pa.array([cell.key] * len(ids), pa.int64()), ids], names=["key", "id"])


def _links(similarity: float):
    """Compare the partners of every cell in full; the links that join two classes of the cell."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                cell = _Cell(batch, r)
                outer, every = _side(batch, r, "outer_"), _side(batch, r, "")
                lists = lambda x, name, kind: [np.frombuffer(b, dtype=kind) for b in x(name).to_pylist()]
                own, own_w = lists(outer, "shingles", np.uint64), lists(outer, "weights", np.float32)
                there, there_w = lists(every, "shingles", np.uint64), lists(every, "weights", np.float32)
                size = np.array([len(x) for x in there])
                start = np.cumsum(size) - size
                vocabulary, at = np.unique(np.concatenate(there), return_inverse=True)
                flat_w = np.concatenate(there_w).astype(np.float64)
                total = np.array([w.sum(dtype=np.float64) for w in there_w])
                dense, class_ = np.zeros(len(vocabulary) + 1), cell.roots.copy()
                a, b = [], []
                for i in range(cell.n):
                    j = cell.partners(i, class_)
                    if not len(j):
                        continue
                    known = np.minimum(np.searchsorted(vocabulary, own[i]), len(vocabulary) - 1)
                    known = np.where(vocabulary[known] == own[i], known, len(vocabulary))
                    dense[known] = own_w[i]
                    dense[-1] = 0
                    for some in np.split(j, np.flatnonzero(np.diff(np.cumsum(size[j]) >> 20)) + 1):  # about a million shingles at a time
                        many = size[some]
                        places = np.repeat(start[some] - np.cumsum(many) + many, many) + np.arange(many.sum())
                        common = np.add.reduceat(np.minimum(dense[at[places]], flat_w[places]), np.cumsum(many) - many)
                        sure = common >= (similarity - 1e-9) * (own_w[i].sum(dtype=np.float64) + total[some] - common)
                        for x in some[sure].tolist():
                            if class_[cell.n + x] != class_[i]:
                                a.append(i)
                                b.append(cell.n + x)
                                class_[class_ == class_[cell.n + x]] = class_[i]
                    dense[known] = 0
                yield pa.RecordBatch.from_arrays([cell.ids.take(pa.array(a, pa.int64())), cell.ids.take(pa.array(b, pa.int64()))], names=["a", "b"])

    return work


def packed_shingles(members: DataFrame, weight: np.ndarray) -> DataFrame:
    """id, distinct shingles and their weights, as bytes."""
    shared = members.sparkSession.sparkContext.broadcast(weight)

    def work(batches):
        cell_weight = shared.value
        for part, data, ends in _chunks(batches):
            owner, ids, times, _ = shingles(data, ends)
            cuts = np.searchsorted(owner, np.arange(1, part.num_rows))
            w = (times * cell_weight[_df_cell(ids)]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([x.tobytes() for x in np.split(ids, cuts)], pa.binary()), pa.array([x.tobytes() for x in np.split(w, cuts)], pa.binary())], names=["id", "shingles", "weights"])

    return members.select("id", "text").mapInArrow(work, f"id {members.schema['id'].dataType.simpleString()}, shingles binary, weights binary")


def _cells(placed: DataFrame, names: list[str], block_bytes: str | None = None) -> DataFrame:
    """One row per cell of every bucket: a block of the texts outside its largest class, and any block of it.

    Texts are dealt by hash into blocks of about BLOCK, and of about BLOCK_BYTES of ``block_bytes``.
    """
    size = F.sum(F.octet_length(block_bytes)) / BLOCK_BYTES if block_bytes else F.lit(0.0)
    blocks = placed.groupBy("key").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, size)).cast("int").alias("blocks"), F.max("outside").alias("_any"))
    placed = placed.join(blocks.filter("_any").drop("_any"), "key").withColumn("block", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int"))

    def packed(rows: DataFrame, own: str, other: str, prefix: str) -> DataFrame:
        rows = rows.groupBy("key", "block", "blocks").agg(F.collect_list(F.struct(*names)).alias("t"))
        return rows.select("key", F.col("block").alias(own), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias(other), *[F.col(f"t.{k}").alias(prefix + k) for k in names])

    outer = packed(placed.filter("outside"), "o", "m", "outer_")
    return outer.join(packed(placed, "m", "o", "").hint("merge"), ["key", "o", "m"])


def across_classes(near: DataFrame, root: DataFrame | None, marks: DataFrame, members: DataFrame, weight: np.ndarray, similarity: float) -> DataFrame:
    """Links (a, b) between classes of larger buckets: in each bucket that still holds several classes, of texts outside its largest class with any others.

    Every block of texts outside the largest class meets every block of the bucket in a task of its own, whatever the
    bucket's size. First only samples travel: more of them than the bands need tell which texts have a likely partner
    in another class at all, and keep texts that are alike only by what all of the bucket shares from being
    compared in full. Then the shingles of the texts that are left meet in cells of the same kind, and pairs are compared in
    full inside; a cell emits a link where it joins two classes, never its pairs.
    """
    kind = near.schema["id"].dataType.simpleString()
    near = near.filter(f"n > {SMALL}").select("key", "id")
    near = near.withColumn("root", F.col("id")) if root is None else near.join(root.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    classes = near.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("root", "n").alias("top"))
    placed = stage(near.join(classes.filter("n > most").select("key", "top"), "key").withColumn("outside", F.col("root") != F.col("top")).drop("top"), "near-open")
    more = further_marks(members.join(placed.select("id").distinct(), "id", "left_semi"), weight)
    more = stage(marks.join(more, "id").select("id", F.concat("m.marks", "more").alias("marks"), F.col("m.bands").alias("bands")), "near-further")
    placed = placed.join(more, "id")
    names = ["id", "root", "marks", "bands", "outside"]
    hopeful = stage(_cells(placed, names).mapInArrow(_hopeful, f"key bigint, id {kind}").distinct(), "near-hopeful")
    shingled = packed_shingles(members.join(hopeful.select("id").distinct(), "id", "left_semi"), weight)
    left = placed.join(hopeful, ["key", "id"], "left_semi").join(shingled, "id")
    return _cells(left, [*names, "shingles", "weights"], "shingles").mapInArrow(_links(similarity), f"a {kind}, b {kind}")


def _agreement(marks_a: pa.Array, marks_b: pa.Array) -> np.ndarray:
    size = BANDS * BAND_ROWS
    view = lambda m: np.frombuffer(b"".join(m.to_pylist()), dtype=np.uint8).reshape(-1, size)
    return (view(marks_a) == view(marks_b)).sum(axis=1)


def verify(pairs: DataFrame, members: DataFrame, weight: np.ndarray, similarity: float) -> DataFrame:
    """Pairs whose exact weighted Jaccard similarity over TF-IDF shingles is at least ``similarity``."""
    shared = pairs.sparkSession.sparkContext.broadcast(weight)

    def work(batches):
        cell_weight = shared.value
        for batch in batches:
            length = np.cumsum(pc.add(pc.binary_length(batch.column("text_a")), pc.binary_length(batch.column("text_b"))).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < batch.num_rows:  # STEP_BYTES of text, 4,000 pairs or one pair at a time
                to = int(np.searchsorted(length, (length[at - 1] if at else 0) + STEP_BYTES, side="right"))
                part = batch.slice(at, min(max(to - at, 1), 4000))
                at += part.num_rows
                sides = []
                for name in ("text_a", "text_b"):
                    for k, (_, data, ends) in enumerate(byte_chunks([part], name, limit=1 << 62)):
                        owner, ids, times, _ = shingles(data, ends)
                        sides.append((owner.astype(np.uint64) << _ID_BITS | ids, times * cell_weight[_df_cell(ids)]))
                key, w = np.concatenate([s[0] for s in sides]), np.concatenate([s[1] for s in sides]).astype(np.float64)
                order = np.argsort(key, kind="stable")
                key, w = key[order], w[order]
                same = np.flatnonzero(key[1:] == key[:-1])
                n = part.num_rows
                shared_w = np.bincount((key[same] >> _ID_BITS).astype(np.int64), weights=np.minimum(w[same], w[same + 1]), minlength=n)
                total = np.bincount((key >> _ID_BITS).astype(np.int64), weights=w, minlength=n)
                sure = shared_w >= (similarity - 1e-9) * (total - shared_w)
                yield pa.RecordBatch.from_arrays([part.column("a").filter(pa.array(sure)), part.column("b").filter(pa.array(sure))], names=["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    joined = pairs.join(members.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(members.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(work, f"a {kind}, b {kind}")


def _still_apart(pairs: DataFrame, of) -> DataFrame:
    """Pairs (a, b, same) of different classes, with the smaller and larger class; ``of`` gives the classes by node."""
    pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left") if of else pairs.withColumns({"root_a": F.col("a"), "root_b": F.col("b")})
    return (pairs.withColumns({"root_a": F.coalesce("root_a", "a"), "root_b": F.coalesce("root_b", "b")}).filter("root_a <> root_b")
            .select("a", "b", "same", F.least("root_a", "root_b").alias("root_low"), F.greatest("root_a", "root_b").alias("root_high")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Class of near-duplicate texts of every row: doc_id, class_id (the smallest id of the class).

    Texts are compared by the weighted Jaccard similarity of their shingles of five
    words (A-Z lower-cased), a shingle weighing its times in the text by its idf over
    all rows. Texts of the same words stand for each other. Pairs that share a band of
    the samples, and most of the samples, are compared in full; classes are what
    links of at least ``similarity`` join. Comparing starts with each text's likeliest
    partner; pairs that links have joined by then need no comparison.

    A text without words (null, empty) is a class of its own. A null id has a null
    class and is linked to nothing. An id that is repeated is one node. No rows give no
    rows. Pairs of exactly the least similarity are found with a chance of about 0.996.
    """
    rows = texts(docs, id_col, text_col)
    weight = idf_table(*document_frequencies(rows))
    sketch = stage(sketches(rows, weight), "near-sketches")
    reps = stage(sketch.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.min("bands").alias("bands"), F.min("marks").alias("marks")), "near-texts")
    marks = stage(reps.groupBy("id").agg(F.min(F.struct("marks", "bands")).alias("m")), "near-marks")
    near = stage(buckets(reps), "near-buckets")
    pairs = stage(candidates(near), "near-pairs")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(near.filter(f"n > {SMALL}").select("id")).distinct()
    # One shuffle of the texts at every size, so that a small run tells what a large one does.
    members = stage(rows.withColumnRenamed("doc_id", "id").join(ids.hint("merge"), "id"), "near-members").dropDuplicates(["id"])
    left, root = pairs, None
    of = lambda x: root.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    for turn in range(2):
        # each text's likeliest partner; then all others whose classes are still apart, and those of larger buckets
        likeliest = Window.partitionBy("b").orderBy(F.col("same").desc(), F.xxhash64("a", "b"))
        tested = left.withColumn("k", F.row_number().over(likeliest)).filter("k = 1") if turn == 0 else left
        tested = stage(tested.select("a", "b"), "near-tested")
        found = verify(tested, members, weight, similarity)
        if turn == 1:
            found = found.unionByName(across_classes(near, root, marks, members, weight, similarity))
        found = stage(found, "near-links")
        if not found.isEmpty():
            root = components(found if root is None else found.unionByName(root.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        if turn == 0:
            left = stage(_still_apart(left.select("a", "b", "same").join(tested, ["a", "b"], "left_anti"), of if root is not None else None), "near-left")
    stands = sketch.join(reps.select("digest", "id"), "digest", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("id", "doc_id")).alias("id"))
    if root is None:
        return stands.select("doc_id", F.col("id").alias("class_id"))
    return stands.join(root.withColumnRenamed("node", "id"), "id", "left").select("doc_id", F.coalesce("root", "id").alias("class_id"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes over all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
