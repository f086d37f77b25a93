"""Language-model scores: exact word counts, and online mixing of context predictors over bits."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import byte_chunks, hash_prefix, mix, remainder, span_hash, stage, texts, word_spans

HELD_OUT_OF, HELD_OUT = 7, 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# ---- code tree: every byte is a path of binary decisions


def _code() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Huffman paths for bytes under fixed weights: (path start, path length, node per step, bit per step).

    The tree only says in which order bits ask for a byte; frequent letters of
    Latin prose get few questions. It is the same for every corpus.
    """
    weight = np.ones(256)
    weight[32:127] = 4
    weight[48:58], weight[0xA0:0xC0], weight[0xC3], weight[10], weight[32] = 15, 12, 150, 100, 1800
    for k, c in enumerate("etaoinsrhldcumfpgwybvkxjqz"):
        weight[ord(c)] = round(1200 / (1 + 0.45 * k))
    for c in ".,":
        weight[ord(c)] = 100
    heap = [(w, i, i) for i, w in enumerate(weight.tolist())]
    heapq.heapify(heap)
    parent, side, n = {}, {}, 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s, x in enumerate((a, b)):
            parent[x[2]], side[x[2]] = n, s
        heapq.heappush(heap, (a[0] + b[0], n, n))
        n += 1
    first, size, nodes, bits = np.zeros(256, np.int64), np.zeros(256, np.int64), [], []
    for b in range(256):
        path, x = [], b
        while x in parent:
            path.append((parent[x] - 256, side[x]))
            x = parent[x]
        first[b], size[b] = len(nodes), len(path)
        nodes += [p for p, _ in reversed(path)]
        bits += [s for _, s in reversed(path)]
    return first, size, np.array(nodes, dtype=np.int64), np.array(bits, dtype=np.uint8)


FIRST, SIZE, NODES, PATH_BITS = _code()
DEPTH = np.concatenate([np.arange(n) for n in SIZE]).astype(np.int64)

_AWAY = np.where(PATH_BITS > 0, -1, 1).astype(np.float32)

# ---- predictors

PREDICTORS = ("two bytes", "four bytes", "word so far")
SLOT_BITS = 20
SLICE = 1 << 14
_NODE_KEY = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)
_STEP_KEY = _NODE_KEY[NODES]
_DEEP = SIZE - 3  # bits of a byte in the last gate; every path has the three of the others
STRETCH = 15.0  # stretch values are kept as whole numbers of fifteenths


def contexts(low: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Per predictor a 24-bit context hash of every byte; contexts do not cross texts."""
    n, starts = len(low), ends[:-1][ends[:-1] < len(low)]
    past = []
    last = low.astype(np.uint32)
    for _ in range(4):
        last = np.concatenate([np.zeros(min(1, n), np.uint32), last[:-1]])
        last[starts] = 0
        past.append(last)
    two = past[0] | past[1] << np.uint32(8)
    four = two | past[2] << np.uint32(16) | past[3] << np.uint32(24)
    gap = (past[0] <= 32) | (past[0] == 0)
    at = np.arange(n)
    begin = np.maximum.accumulate(np.where(gap, at, 0)) if n else at
    prefix = hash_prefix(low)
    word = span_hash(prefix, begin, at)
    return [((two + np.uint32(1)) * np.uint32(0x9E3779B1)) >> np.uint32(8), ((four + np.uint32(7)) * np.uint32(0x85EBCA6B)) >> np.uint32(8), (word >> np.uint64(40)).astype(np.uint32)]


def _spread(context: np.ndarray) -> np.ndarray:
    return context * np.uint32(0xC2B2AE35)


def _slots(spread: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Slots of bits: the ``_spread`` context of their byte and the key of their step."""
    h = spread + key
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x27D4EB2F)
    return (h >> np.uint32(32 - SLOT_BITS)).astype(np.int64)


def _expand(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits per symbol, and the place of each bit in the path table."""
    size = SIZE[symbols]
    upto = np.cumsum(size)
    return size, np.arange(upto[-1] if len(upto) else 0) + np.repeat(FIRST[symbols] - upto + size, size)


class BitCounts:
    """Bits seen per predictor slot, as (slot, bit) counts."""

    def __init__(self):
        self.table = np.zeros((len(PREDICTORS), 2 << SLOT_BITS), dtype=np.int32)

    def add(self, low: np.ndarray, context: list[np.ndarray], use: np.ndarray) -> None:
        """Learn the bytes that ``use`` marks; equal (context, byte) pairs are counted first."""
        for k, c in enumerate(context):
            pair, times = np.unique((c << np.uint32(8) | low)[use], return_counts=True)
            size, step = _expand((pair & np.uint32(255)).astype(np.int64))
            slot = _slots(np.repeat(_spread(pair >> np.uint32(8)), size), _STEP_KEY.take(step))
            self.table[k] += np.bincount(slot * 2 + PATH_BITS.take(step), weights=np.repeat(times, size), minlength=2 << SLOT_BITS).astype(np.int32)

    def slices(self) -> list[tuple[int, int, bytes]]:
        """(predictor, slice, packed counts), of slices with counts."""
        codec, out = pa.Codec("zstd"), []
        for k, t in enumerate(self.table):
            for i, part in enumerate(t.reshape(-1, SLICE)):
                if part.any():
                    out.append((k, i, codec.compress(part.tobytes(), asbytes=True)))  # of one task, so far below 2**31
        return out


def _sum_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum slices over tasks; a partition holds few distinct slices, each of a fixed size."""
    codec, total = pa.Codec("zstd"), {}
    for b in batches:
        for k, i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            part = np.frombuffer(codec.decompress(data, SLICE * 4, asbytes=True), dtype=np.int32).astype(np.int64)
            total[k, i] = total[k, i] + part if (k, i) in total else part
    keys = sorted(total)
    values = []
    for key in keys:
        zero, one = total[key][0::2], total[key][1::2]
        values.append(np.clip(np.rint(np.log((one + 0.4) / (zero + 0.4)) * STRETCH), -120, 120).astype(np.int8).tobytes())
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int32()), pa.array([i for _, i in keys], pa.int32()), pa.array(values, pa.binary())], names=["predictor", "slice", "values"])


class Mixer:
    """Bits per text from fixed predictor tables and weights that learn as the text goes on.

    A text is cut into segments of ``SEGMENT`` bytes that start from the same weights.
    Weights are gated by the depth of the decision; after every ``BLOCK`` bytes of a
    segment they move along the mean of error times input, and so does the last
    stage, a scale and shift of the mixed stretch. A result depends on the text
    and the tables alone, not on which texts are scored together.
    """

    SEGMENT, BLOCK, GATES, RATE, LAST_RATE = 4096, 64, 4, 0.35, 0.05

    def __init__(self, tables: np.ndarray):
        self.tables = tables

    def bits(self, low: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n, texts_ = len(low), len(ends) - 1
        if not n:
            return np.zeros(texts_)
        context = [_spread(c) for c in contexts(low, ends)]
        text_of = np.repeat(np.arange(texts_), np.diff(ends))
        place = np.arange(n) - ends[text_of]
        lane_key = (ends[:-1] // self.SEGMENT + np.arange(texts_))[text_of] + place // self.SEGMENT
        new_lane = np.append(True, lane_key[1:] != lane_key[:-1])
        lane = np.cumsum(new_lane) - 1
        block = place % self.SEGMENT // self.BLOCK
        order = np.argsort(block.astype(np.uint8), kind="stable")
        cuts = np.searchsorted(block[order], np.arange(self.SEGMENT // self.BLOCK + 1))
        lanes, inputs, flat = int(lane[-1]) + 1, len(PREDICTORS), self.GATES - 1
        weights = [np.full(lanes * self.GATES, 0.4 / STRETCH, dtype=np.float32) for _ in range(inputs)]
        scale, shift = np.ones(lanes, dtype=np.float32), np.zeros(lanes, dtype=np.float32)
        cost = np.zeros(lanes)
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                break
            at = order[a:b]
            symbol, own = low.take(at), lane.take(at)
            begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            # Bits stand gate by gate, and lane by lane inside a gate: a cell of both is a run, whose sums need no scatter.
            who, count, m = own[begin], np.diff(np.append(begin, len(at))), len(at) * flat
            first, deep = FIRST.take(symbol), _DEEP.take(symbol)
            upto = np.cumsum(deep)
            step = np.empty(m + int(upto[-1]), dtype=np.int64)
            for k in range(flat):
                np.add(first, k, out=step[k * len(at) : (k + 1) * len(at)])
            step[m:] = np.arange(len(step) - m)
            step[m:] += np.repeat(first + flat - upto + deep, deep)
            runs = np.concatenate([count] * flat + [np.add.reduceat(deep, begin)])
            some = np.flatnonzero(runs)
            here = (np.cumsum(runs) - runs)[some]
            runs, who = runs[some], np.tile(who, self.GATES)[some]
            cell = some // len(begin) * lanes + who
            many = np.bincount(who, weights=runs, minlength=lanes)[who]

            def total(values):
                return np.add.reduceat(values, here, dtype=np.float64)

            def by_lane(sums):
                return np.bincount(who, weights=sums, minlength=lanes)

            key, away = _STEP_KEY.take(step, mode="clip"), _AWAY.take(step, mode="clip")
            x, spread = [], np.empty(len(step), dtype=np.uint32)
            for k in range(inputs):
                own_context = context[k].take(at)
                spread[:m].reshape(flat, -1)[:] = own_context
                spread[m:] = np.repeat(own_context, deep)
                x.append(self.tables[k].take(_slots(spread, key), mode="wrap").astype(np.float32))
            mixed = np.repeat(weights[0][cell], runs) * x[0]
            for k in range(1, inputs):
                mixed += np.repeat(weights[k][cell], runs) * x[k]
            z = np.clip(np.repeat(scale[who], runs) * mixed + np.repeat(shift[who], runs), -12, 12) * away
            small = np.exp(-np.abs(z))
            one = 1 + small
            # A run has fewer than 1,024 bits, so that this product of numbers up to two stays finite.
            cost += by_lane(total(np.maximum(z, 0)) + np.log(np.multiply.reduceat(one, here, dtype=np.float64)))
            half = np.float32(0.5)
            error = -away * (half + np.copysign(half - small / one, z))
            rate = self.RATE / many / STRETCH**2
            for k in range(inputs):
                weights[k][cell] += (rate * total(error * x[k])).astype(np.float32)
            scale += (self.LAST_RATE / 4 * by_lane(total(error * mixed) / many)).astype(np.float32)
            shift += (self.LAST_RATE * by_lane(total(error) / many)).astype(np.float32)
        return np.bincount(text_of[new_lane], weights=cost, minlength=texts_) / math.log(2)


# ---- one pass over the texts: words of each chunk, and bits of training texts

BUCKETS = 256
CHUNK_BYTES = 12 << 20
_END = np.uint64(0x5851F42D4C957F2D)  # the end token, no hash of a word's bytes but by chance
_GATHER = "kind int, chunk bigint, bucket int, a binary, b binary, ids array<bigint>"


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of three kinds: words of a chunk by bucket, the chunk's texts as word numbers, slices of bit counts.

    Kind 0: sorted distinct words (a) and their training counts (b) of one bucket of
    hashes. Kind 1: word number of every token (a), tokens per text (b), row numbers.
    Kind 2: counts of one slice (chunk: predictor, bucket: slice). Rows of a chunk
    are named by the row number of its first text.
    """
    codec, counts, held = pa.Codec("zstd"), BitCounts(), []

    def row(kind, chunk, bucket, a, b, ids):
        return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([chunk], pa.int64()), pa.array([bucket], pa.int32()), pa.array([a], pa.binary()), pa.array([b], pa.binary()), pa.array([ids], pa.list_(pa.int64()))],
                                          names=["kind", "chunk", "bucket", "a", "b", "ids"])

    def flush():
        ids, sizes, train = (np.concatenate(p) for p in zip(*[h[:3] for h in held]))
        tokens = np.concatenate([h[3] for h in held])
        words, number = np.unique(tokens, return_inverse=True)
        many = np.bincount(number[np.repeat(train, sizes)], minlength=len(words)).astype(np.uint32)
        cuts = np.searchsorted(words, np.arange(BUCKETS, dtype=np.uint64) << np.uint64(56)).tolist() + [len(words)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a < b:
                yield row(0, int(ids[0]), k, words[a:b].tobytes(), many[a:b].tobytes(), None)
        yield row(1, int(ids[0]), len(tokens), codec.compress(number.astype(np.uint32).tobytes(), asbytes=True), sizes.astype(np.uint32).tobytes(), ids.tolist())
        held.clear()

    size = 0
    for rows, data, ends in byte_chunks(batches):
        low = LOWER[data]
        use = rows.column("train").to_numpy(zero_copy_only=False)
        counts.add(low, contexts(low, ends), np.repeat(use, np.diff(ends)))
        start, to, owner = word_spans(low, ends)
        word, n = span_hash(hash_prefix(low), start, to), rows.num_rows
        many = np.bincount(owner, minlength=n)
        held.append((rows.column("row").to_numpy(), many + 1, use, np.insert(word, np.cumsum(many), _END)))
        size += len(data)
        if size >= CHUNK_BYTES:
            yield from flush()
            size = 0
    if held:
        yield from flush()
    for k, i, packed in counts.slices():
        yield row(2, k, i, packed, None, None)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Total training counts of each chunk's words, from a bucket's totals (kind -1, first) and its questions."""
    bucket, words, totals = None, None, None
    for b in batches:
        chunk, out = b.column("chunk").to_pylist(), []
        for i, (kind, key) in enumerate(zip(b.column("kind").to_pylist(), b.column("bucket").to_pylist())):
            asked = np.frombuffer(b.column("a")[i].as_py(), dtype=np.uint64)
            if kind < 0:
                bucket, words, totals = key, asked, np.frombuffer(b.column("b")[i].as_py(), dtype=np.int64)
            elif key == bucket:
                out.append((chunk[i], key, totals[np.searchsorted(words, asked)].tobytes()))
            else:
                raise ValueError(f"no totals for bucket {key}")
        cols = list(zip(*out)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary()))], names=["chunk", "bucket", "totals"])


def _merge(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(words, kind="stable")
    words, counts = words[order], counts[order]
    first = np.flatnonzero(np.append(True, words[1:] != words[:-1])) if len(words) else np.zeros(0, np.int64)
    return words[first], np.add.reduceat(counts, first) if len(words) else counts


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training counts per word of each bucket, merged as rows come: memory is a bucket's distinct words."""

    def out(key, parts):
        words, many = _merge(*(np.concatenate(p) for p in zip(*parts)))
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([words.tobytes()], pa.binary()), pa.array([many.tobytes()], pa.binary()), pa.array([int(many.sum())], pa.int64()), pa.array([int((many > 0).sum())], pa.int64())],
                                          names=["bucket", "a", "b", "tokens", "known"])

    bucket, parts, size = None, [], 0
    for b in batches:
        for key, a, c in zip(b.column("bucket").to_pylist(), b.column("a").to_pylist(), b.column("b").to_pylist()):
            if key != bucket:
                if parts:
                    yield out(bucket, parts)
                bucket, parts, size = key, [], 0
            parts.append((np.frombuffer(a, dtype=np.uint64), np.frombuffer(c, dtype=np.uint32).astype(np.int64)))
            size += len(parts[-1][0])
            if len(parts) > 1 and size > 2 * len(parts[0][0]) + (1 << 20):
                parts = [_merge(*(np.concatenate(p) for p in zip(*parts)))]
                size = len(parts[0][0])
    if parts:
        yield out(bucket, parts)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Word-count and model scores of every row.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes,
    bits_per_byte. Texts whose crc32 of the id has remainder 2 by 7 are held out; all
    others teach, in full. A-Z are lower-cased first; the model scores the lower-cased
    bytes. Words are told apart by 64-bit hashes.

    Word counts: each chunk of texts sends its distinct words, by bucket of hashes, to
    be counted, and gets the totals back in the same order, so no text or vocabulary
    is shuffled whole or broadcast. Predictor tables have a fixed size at any
    corpus size and are summed slice by slice.

    The rows are read twice and matched by their place in the scan, so ``docs`` must be
    a table or a written result, which reads the same each time.

    Null text is empty: one end token, model score 0. A null id teaches. Repeated rows
    teach and are scored as often as they occur. Without any row to learn from, counts
    are zero and the base score divides by one.
    """
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col).withColumn("held_out", F.coalesce(remainder("doc_id", HELD_OUT_OF) == HELD_OUT, F.lit(False)))
    rows = rows.withColumn("train", ~F.col("held_out")).withColumn("row", F.monotonically_increasing_id())
    got = stage(rows.select("row", "train", "text").mapInArrow(_gather, _GATHER), "lm-gathered")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = got.filter("kind = 0")
    totals = stage(asked.select("bucket", "a", "b").repartition(parts, "bucket").sortWithinPartitions("bucket")
                   .mapInArrow(_totals, "bucket int, a binary, b binary, tokens bigint, known bigint"), "lm-totals")
    n, v = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    question = asked.select("kind", "chunk", "bucket", "a", F.lit(None).cast("binary").alias("b")).unionByName(totals.select(F.lit(-1).alias("kind"), F.lit(0).cast("bigint").alias("chunk"), "bucket", "a", "b"))
    answers = question.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_answer, "chunk bigint, bucket int, totals binary")
    text_rows = got.filter("kind = 1").select("chunk", F.col("bucket").alias("tokens"), "a", "b", "ids")
    both = answers.select("chunk", "bucket", F.col("totals").alias("a"), F.lit(None).cast("binary").alias("b"), F.lit(None).cast("array<bigint>").alias("ids")).unionByName(
        text_rows.select("chunk", (F.lit(1 << 20) + F.col("tokens")).cast("int").alias("bucket"), "a", "b", "ids"))
    divisor = math.log10(max(n + v + 1, 1))

    def words_score(batches):
        codec, chunk, found = pa.Codec("zstd"), None, []
        for b in batches:
            for c, key, a, sizes, ids in zip(*[b.column(x).to_pylist() for x in ("chunk", "bucket", "a", "b", "ids")]):
                if c != chunk:
                    chunk, found = c, []
                if ids is None:
                    found.append(np.frombuffer(a, dtype=np.int64))
                    continue
                total = np.concatenate(found)
                tokens, sizes = np.frombuffer(codec.decompress(a, 4 * (key - (1 << 20)), asbytes=True), dtype=np.uint32), np.frombuffer(sizes, dtype=np.uint32).astype(np.int64)
                start = np.cumsum(sizes) - sizes
                base = np.add.reduceat(np.log10(total + 1.0)[tokens], start) - sizes * divisor
                known = np.add.reduceat((total > 0)[tokens].astype(np.int64), start)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), pa.array(known), pa.array(base)], names=["row", "n_tokens", "n_known", "base_score"])

    base = both.repartition(parts, "chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(words_score, "row bigint, n_tokens bigint, n_known bigint, base_score double")
    slices = (got.filter("kind = 2").select(F.col("chunk").cast("int").alias("predictor"), F.col("bucket").alias("slice"), "a")
              .repartition(parts, "predictor", "slice").mapInArrow(_sum_slices, "predictor int, slice int, values binary"))
    table = np.zeros((len(PREDICTORS), 1 << SLOT_BITS), dtype=np.int8)
    for k, i, data in slices.collect():  # three predictors of 2**20 bytes each, at any corpus size
        table[k, i * SLICE // 2 : (i + 1) * SLICE // 2] = np.frombuffer(data, dtype=np.int8)
    shared = spark.sparkContext.broadcast(table)

    def model_score(batches):
        mixer = Mixer(shared.value)
        for r, data, ends in byte_chunks(batches, limit=1 << 18):
            bits = mixer.bits(LOWER[data], ends)
            yield pa.RecordBatch.from_arrays([*[r.column(c) for c in ("row", "doc_id", "held_out")], pa.array(bits * -math.log10(2)), pa.array(np.diff(ends)), pa.array(bits / np.maximum(np.diff(ends), 1))],
                                             names=["row", "doc_id", "held_out", "score", "n_bytes", "bits_per_byte"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    model = stage(rows.select("row", "doc_id", "held_out", "text").mapInArrow(model_score, f"row bigint, doc_id {kind}, held_out boolean, score double, n_bytes bigint, bits_per_byte double"), "lm-scores")
    return model.join(stage(base, "lm-base"), "row").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score", "n_bytes", "bits_per_byte")


def op9_mixing_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text of documents."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
