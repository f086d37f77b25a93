"""Rule statistics of whole texts, worked out over arrays of bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import byte_chunks, hash_prefix, mix, span_hash, texts, word_spans

# fixed values: the symbols that the rules count
SYMBOLS = b"#*$%&|<>"
CLASSES = ("blank", "newline", "lower", "upper", "digit", "symbol", "bang", "stop", "mark", "lead", "rest", "control", "pipe")
_CLASS = np.full(256, CLASSES.index("control"), dtype=np.int64)
_CLASS[[0x20, 9, 11, 12, 13]] = 0
_CLASS[10] = 1
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 2, 3, 4
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum()]] = CLASSES.index("mark")
_CLASS[list(SYMBOLS)] = CLASSES.index("symbol")
_CLASS[ord("|")], _CLASS[ord("!")] = CLASSES.index("pipe"), CLASSES.index("bang")
_CLASS[list(b".,;:?")] = CLASSES.index("stop")
_CLASS[0x80:0xC0], _CLASS[0xC0:] = CLASSES.index("rest"), CLASSES.index("lead")

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeat_words", "upper", "digits", "bangs", "stops", "marks", "pipes", "line_words", "short_words", "long_words", "controls", "distinct_words")


def _per_text(flags: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner[flags], minlength=n)


def statistics(data: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Counts per text of a chunk: class_* (bytes), COUNTS, n_lines (with a word), short, long and distinct words."""
    n, k = len(ends) - 1, len(CLASSES)
    text_of = np.repeat(np.arange(n) * k, np.diff(ends))
    table = np.bincount(text_of + _CLASS[data], minlength=n * k).reshape(n, k) if len(data) else np.zeros((n, k), dtype=np.int64)
    out = {f"class_{c}": table[:, i] for i, c in enumerate(CLASSES)}
    out["word_chars"] = np.diff(ends) - out["class_blank"] - out["class_newline"] - out["class_rest"]
    out["n_symbols"] = out["class_symbol"] + out["class_pipe"]
    start, to, owner = word_spans(data, ends)
    prefix = hash_prefix(data)
    out["n_words"] = np.bincount(owner, minlength=n)
    size = to - start
    out["short"], out["long"] = _per_text(size <= 3, owner, n), _per_text(size >= 25, owner, n)
    # Lines with a word, equal to an earlier one of their text.
    breaks = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([ends[:-1], breaks + 1]))
    line_end = np.append(line_start[1:], len(data))
    line_text = np.searchsorted(ends, line_start, side="right") - 1
    has = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end, line_text = line_start[has], line_end[has], line_text[has]
    line_end = line_end - (data[line_end - 1] == 10)
    key = mix(span_hash(prefix, line_start, line_end) + line_text.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    out["n_lines"] = np.bincount(line_text, minlength=n)
    _, first = np.unique(key, return_index=True)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_text[first], minlength=n)
    # Words under three-word windows that their text has twice or more.
    word = span_hash(prefix, start, to)
    salted = word + owner.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    out["distinct"] = np.bincount(owner[np.unique(mix(salted), return_index=True)[1]], minlength=n)
    repeated = np.zeros(len(start), dtype=bool)
    if len(start) > 2:
        at = np.flatnonzero(owner[2:] == owner[:-2])
        window = mix(word[at] * np.uint64(3) + mix(word[at + 1] * np.uint64(5) + mix(salted[at + 2])))
        order = np.argsort(window)
        same = window[order][1:] == window[order][:-1]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        for shift in range(3):
            repeated[at[twice] + shift] = True
    out["n_repeat_words"] = _per_text(repeated, owner, n)
    return out


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """FEATURES per text, each free of the text's length but the first."""
    words = np.maximum(s["n_words"], 1)
    letters = np.maximum(s["class_lower"] + s["class_upper"] + s["class_lead"], 1)
    chars = np.maximum(s["word_chars"], 1)
    lines = np.maximum(s["n_lines"], 1)
    return np.column_stack([
        np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / words, s["n_dup_lines"] / lines, s["n_repeat_words"] / words, s["class_upper"] / letters,
        s["class_digit"] / chars, s["class_bang"] / words, s["class_stop"] / words, s["class_mark"] / words, s["class_pipe"] / words, np.log1p(s["n_words"] / lines),
        s["short"] / words, s["long"] / words, s["class_control"] / chars, s["distinct"] / words]).astype(np.float64)


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, COUNTS and FEATURES of every row; null text is empty, empty texts are all zero."""

    def work(batches):
        for rows, data, ends in byte_chunks(batches):
            s = statistics(data, ends)
            yield pa.RecordBatch.from_arrays([rows.column(0), *[pa.array(s[c].astype(np.int64)) for c in COUNTS], *[pa.array(x) for x in features(s).T.copy()]], names=["doc_id", *COUNTS, *FEATURES])

    rows = texts(docs, id_col, text_col)
    spec = ", ".join([f"doc_id {rows.schema['doc_id'].dataType.simpleString()}", *[f"{c} bigint" for c in COUNTS], *[f"{f} double" for f in FEATURES]])
    return rows.mapInArrow(work, spec)


def bounded_sample(rows: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """About ``most`` rows, chosen by the hash of their id, or all where there are fewer."""
    n = rows.count()
    return rows if n <= most else rows.filter(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) < int(most / n * (1 << 30)))
