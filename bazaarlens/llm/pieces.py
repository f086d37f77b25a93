"""BPE pieces of a SentencePiece model: encoding by vectorised merge rounds, and decoding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import texts

SPACE = "▁"
_UNKNOWN = 1 << 22  # plus code point: a character that the model lacks
_NONE = np.int64(1 << 40)  # rank of a pair that does not merge


class PieceModel:
    """A BPE model with byte fall-back, read from its file.

    Supports what such models use: identity normalisation with removal of extra
    spaces and a leading space mark, byte fall-back, no user-defined pieces.
    Anything else raises, so that a result is never silently different.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, trainer = model.normalizer_spec, model.trainer_spec
        if trainer.model_type != 2 or not trainer.byte_fallback or norm.precompiled_charsmap or not norm.escape_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only BPE models with byte fall-back and identity normalisation are supported")
        kinds = {p.type for p in model.pieces}
        if kinds - {1, 2, 3, 6}:
            raise ValueError(f"piece types {sorted(kinds)} are not supported")
        self.squeeze = norm.remove_extra_whitespaces
        self.pieces = [p.piece for p in model.pieces]
        self.byte_id = np.zeros(256, dtype=np.int64)
        self.id_byte = {}
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.byte_id[int(p.piece[3:5], 16)], self.id_byte[i] = i, int(p.piece[3:5], 16)
        self.control = {i for i, p in enumerate(model.pieces) if p.type == 3}
        self.unknown = {i for i, p in enumerate(model.pieces) if p.type == 2}
        self.unk_surface = trainer.unk_surface
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        order = {s: k for k, s in enumerate(sorted({p.score for p in model.pieces if p.type == 1}, reverse=True))}
        rank = {p: order[model.pieces[i].score] for p, i in normal.items()}
        self.symbol = {c: normal.get(c, _UNKNOWN + ord(c)) for p in normal for c in p}
        part = lambda s: normal.get(s, self.symbol.get(s) if len(s) == 1 else None)
        keys, ranks, merged = [], [], []
        for p, i in normal.items():
            for k in range(1, len(p)):
                left, right = part(p[:k]), part(p[k:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    ranks.append(rank[p])
                    merged.append(i)
        self._table(np.array(keys, dtype=np.uint64), np.array(ranks), np.array(merged))
        # A break between two characters that stand side by side in no piece parts independent words.
        joined = {p[k : k + 2] for p in normal for k in range(len(p) - 1)}
        if any(a != SPACE and b == SPACE for a, b in joined):
            raise ValueError("pieces go on after a space mark")
        alone = "" if any("\n" in p for p in joined) else "\n"
        self.words = re.compile(f"{alone}|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    def _table(self, keys: np.ndarray, ranks: np.ndarray, merged: np.ndarray) -> None:
        """Open-addressing table of pairs, read for whole arrays at once."""
        size = 1 << int(len(keys) * 4).bit_length()
        self.shift, self.mask = np.uint64(64 - size.bit_length() + 1), size - 1
        self.t_key = np.full(size, 2**64 - 1, dtype=np.uint64)
        self.t_rank, self.t_merged = np.full(size, _NONE), np.zeros(size, dtype=np.int64)
        slots = (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift
        self.probes = 1
        for key, slot, r, m in zip(keys.tolist(), slots.tolist(), ranks.tolist(), merged.tolist()):
            n = 1
            while self.t_key[slot] != 2**64 - 1:
                slot, n = (slot + 1) & self.mask, n + 1
            self.t_key[slot], self.t_rank[slot], self.t_merged[slot] = key, r, m
            self.probes = max(self.probes, n)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs; rank ``_NONE`` where there is none."""
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = ((key * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        rank, merged = np.full(len(key), _NONE), np.zeros(len(key), dtype=np.int64)
        todo = np.arange(len(key))
        for _ in range(self.probes):
            held = self.t_key[slot]
            hit = held == key[todo]
            rank[todo[hit]], merged[todo[hit]] = self.t_rank[slot[hit]], self.t_merged[slot[hit]]
            on = ~hit & (held != np.uint64(2**64 - 1))
            todo, slot = todo[on], (slot[on] + 1) & self.mask
            if not len(todo):
                break
        return rank, merged

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub("  +", " ", text.strip(" "))
        if not text:
            return ""
        text = SPACE + text.replace(" ", SPACE)
        return text.rstrip(SPACE) if self.squeeze else text

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of independent words: rounds over one flat array of symbols.

        Each round finds the smallest pair rank of every word, merges its
        occurrences from the left without overlap, and compacts. A merge that gives
        birth to a pair of no larger rank ends its word's round, as that pair is next.
        """
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        distinct, back = np.unique(codes, return_inverse=True)
        sym = np.array([self.symbol.get(chr(c), _UNKNOWN + c) for c in distinct.tolist()], dtype=np.int64)[back]
        word = np.repeat(np.arange(len(words)), sizes)
        done_sym, done_word = [], []
        rank, merged = self._ranks(sym, word)
        while len(sym):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(sym)))
            alive = np.repeat(best < _NONE, sizes)
            if not alive.all():
                done_sym.append(sym[~alive])
                done_word.append(word[~alive])
                best = np.repeat(best, sizes)[alive]
                sym, word, rank, merged = sym[alive], word[alive], rank[alive], merged[alive]
                if not len(sym):
                    break
            else:
                best = np.repeat(best, sizes)
            at = np.flatnonzero(rank == best)
            at = self._leftmost(at)
            at = self._before_better(at, sym, word, rank, merged)
            sym[at] = merged[at]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            new = (np.cumsum(keep) - 1)[at]
            sym, word, rank, merged = sym[keep], word[keep], rank[keep], merged[keep]
            touched = np.unique(np.concatenate([new, new[new > 0] - 1]))
            self._refresh(touched, sym, word, rank, merged)
        all_word = np.concatenate(done_word) if done_word else np.zeros(0, dtype=np.int64)
        order = np.argsort(all_word, kind="stable")
        flat, cuts = np.concatenate(done_sym)[order].tolist() if done_sym else [], np.searchsorted(all_word[order], np.arange(len(words) + 1)).tolist()
        return [self._ids(flat[a:b]) for a, b in zip(cuts, cuts[1:])]

    def _ranks(self, sym, word):
        rank, merged = np.full(len(sym), _NONE), np.zeros(len(sym), dtype=np.int64)
        self._refresh(np.arange(len(sym)), sym, word, rank, merged)
        return rank, merged

    def _refresh(self, at, sym, word, rank, merged) -> None:
        rank[at] = _NONE
        at = at[at < len(sym) - 1]
        at = at[word[at] == word[at + 1]]
        rank[at], merged[at] = self.pair(sym[at], sym[at + 1])

    @staticmethod
    def _leftmost(at: np.ndarray) -> np.ndarray:
        """Of places whose pairs overlap (neighbours), every other one from the left."""
        start = np.append(True, at[1:] != at[:-1] + 1)
        run = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
        return at[(np.arange(len(at)) - run) % 2 == 0]

    def _before_better(self, at, sym, word, rank, merged) -> np.ndarray:
        w = word[at]
        several = np.zeros(len(at), dtype=bool)
        same = w[1:] == w[:-1]
        several[1:] |= same
        several[:-1] |= same
        if not several.any():
            return at
        i = np.flatnonzero(several)
        p, r = at[i], rank[at[i]]
        before = np.where((i > 0) & (at[i - 1] == p - 2), merged[at[i - 1]], sym[p - 1])
        left = self.pair(before, merged[p])[0]
        left[(p == 0) | (word[p - 1] != word[p])] = _NONE
        after = np.minimum(p + 2, len(sym) - 1)
        right = self.pair(merged[p], sym[after])[0]
        right[(p + 2 >= len(sym)) | (word[after] != word[p])] = _NONE
        stops = np.zeros(len(at), dtype=np.int64)
        stops[i] = (left <= r) | (right <= r)
        if not stops.any():
            return at
        total = np.cumsum(stops)
        head = np.append(True, ~same)
        base = np.maximum.accumulate(np.where(head, total - stops, 0))
        return at[total - stops - base == 0]

    def _ids(self, symbols: list[int]) -> list[int]:
        if max(symbols) < _UNKNOWN:
            return symbols
        out = []
        for s in symbols:
            out += [s] if s < _UNKNOWN else self.byte_id[list(chr(s - _UNKNOWN).encode())].tolist()
        return out

    def encode(self, text: str) -> list[int]:
        words = self.words(self.normalise(text))
        return [i for w in self.encode_words(words) for i in w] if words else []

    def decode(self, ids: list[int]) -> str:
        """Text of ids, bytes of byte pieces that are no UTF-8 as U+FFFD each."""
        return self.decode_from("", ids)

    def decode_from(self, text: str, ids: list[int]) -> str:
        """``text`` and the text of further ids; one leading space mark goes where the text is empty."""
        out, at, leading = [text] if text else [], 0, not text
        while at < len(ids):
            i = ids[at]
            if i in self.id_byte:
                to = at
                while to < len(ids) and ids[to] in self.id_byte:
                    to += 1
                out.append(_utf8(bytes(self.id_byte[k] for k in ids[at:to])))
                at, leading = to, False
                continue
            piece = self.unk_surface if i in self.unknown else "" if i in self.control else self.pieces[i]
            if leading and i not in self.unknown and piece.startswith(SPACE):
                piece, leading = piece[1:], False
            elif piece:
                leading = False
            out.append(piece.replace(SPACE, " "))
            at += 1
        return "".join(out)


def _utf8(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


class CachedEncoder:
    """Ids (joined by commas) of words met so far, in two bounded generations.

    A full generation becomes the older one, from which words in use come back, so
    frequent words stay and rare ones go.
    """

    def __init__(self, path: str, keep: int = 400_000):
        self.model, self.keep, self.known, self.older = PieceModel(path), keep, {}, {}

    def learn(self, words: set[str]) -> None:
        if len(self.known) > self.keep:
            self.known, self.older = {}, self.known
        new = []
        for w in words.difference(self.known):
            if (ids := self.older.get(w)) is None:
                new.append(w)
            else:
                self.known[w] = ids
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            for w, ids in zip(some, self.model.encode_words(some)):
                if self.model.decode_from(" ", ids)[1:] != w.replace(SPACE, " "):
                    raise ValueError(f"ids of {w!r} do not decode to it")
                self.known[w] = ",".join(map(str, ids))

    def batch(self, batch: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, hash of ids, hash of decoded text) per text.

        A word's ids have been decoded when it was learnt and give the word again,
        so decoding a text gives its words less the leading space.
        """
        parts = [self.model.words(self.model.normalise(t)) for t in batch]
        self.learn({w for p in parts for w in p})
        out = []
        for words in parts:
            ids = ",".join([self.known[w] for w in words])
            text = "".join(words).replace(SPACE, " ").removeprefix(" ")
            out.append((ids.count(",") + bool(words), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        return out


_ENCODERS: dict[str, CachedEncoder] = {}
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encoder(path: str) -> CachedEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = CachedEncoder(path)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text: doc_id and ids array<int>; null and empty texts have none."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_ = encoder(model).model
        for batch in batches:
            ids = [model_.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, type=pa.list_(pa.int32()))], names=["doc_id", "ids"])

    rows = texts(docs, id_col, text_col)
    return rows.mapInArrow(code, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(coded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Text of every row of ids; null ids are the empty text."""

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_ = encoder(model).model
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model_.decode(i or []) for i in batch.column(1).to_pylist()], type=pa.string())], names=["doc_id", "text"])

    rows = coded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(back, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", rows_at_once: int = 500) -> DataFrame:
    """Digests of the ids and of the text decoded from them, per document.

    Words repeat, so each worker keeps coded words in a bounded table; new ones of
    a slice of documents are merged together, and only slices are held in memory.
    Null text is empty: no ids, and the hashes of the empty string.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                cols = list(zip(*enc.batch(part.column(1).to_pylist())))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(list(c), type=f.type) for c, f in zip(cols, list(_RESULT)[1:])]], schema=_RESULT)

    return texts(docs, id_col, text_col).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        code, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op7_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents as ids and back."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path())
