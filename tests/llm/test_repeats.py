"""Repeat removal against counting every window."""

import collections
import hashlib
import random

import numpy as np
import pytest

from bazaarlens.llm import suffix_dedup as S


def brute(texts, size=200):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + size] for b in data for i in range(len(b) - size + 1))
    out = []
    for b in data:
        mark = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                mark[i : i + size] = True
        runs = int((np.diff(np.concatenate([[0], mark.astype(int)])) == 1).sum())
        out.append((len(b), int(mark.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~mark])).hexdigest()))
    return out


def hard_texts():
    rnd = random.Random(5)
    words = lambda n: " ".join(rnd.choice(["alpha", "be", "gamma", "del", "épsilon", "z"]) + str(rnd.randint(0, 99)) for _ in range(n))
    p, q, big = words(60), words(90), words(400)
    return ([None, "", "a" * 199, "a" * 200, "a" * 1000, "ab" * 600, "abc" * 90, p, p + words(50), words(50) + p, words(10) + p + words(10) + p, q[5:] + "x", q[:300] + words(40), "y" + q,
             words(200), p[:201], "q" + p[:199] + "r", "é" * 150, "é" * 150 + "x", "line of text, again and again\n" * 40, "pre line of text, again and again\n" * 40,
             big, big.replace("alpha1", "ALPHA"), big[:1000] + "!" + big[1001:], big[::-1]] + [words(20) + p + words(20) for _ in range(40)] + [big, big])


@pytest.fixture
def table(spark, tmp_path):
    def write(rows, schema, parts=3):
        spark.createDataFrame(rows, schema).repartition(parts).write.parquet(str(tmp_path / "t"))
        return spark.read.parquet(str(tmp_path / "t"))
    return write


def test_hard_texts_with_clashing_columns(table):
    t = hard_texts()
    df = table([(i, x, 1, 2, "a") for i, x in enumerate(t)], "doc_id bigint, text string, row int, anchor int, content string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.remove_repeats(df).collect()}
    assert [got[i] for i in range(len(t))] == brute(t)


def test_repeated_rows_null_ids_and_no_rows(table):
    long = " ".join(map(str, range(100)))
    df = table([(1, long), (1, long), (None, "short"), (2, None)], "doc_id bigint, text string", 1)
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in S.remove_repeats(df).collect())
    assert got == [("1", len(long)), ("1", len(long)), ("2", 0), ("None", 0)]
    assert S.remove_repeats(df.filter("doc_id > 5")).count() == 0


def test_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.op1_repeat_removal(spark, sf).collect()}
    assert [got[r["doc_id"]] for r in rows] == brute([r["text"] for r in rows])


def test_parts_of_a_long_text_give_the_same_windows():
    import pyarrow as pa
    text = hard_texts()[21] * 30
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([text])], names=["row", "text"])

    def windows(part):
        out = set()
        for b in S._blocks([batch], part):
            for place, anchor in zip(b.column("place").to_pylist(), b.column("anchor").to_pylist()):
                start, n, lead = place >> 20, place >> 10 & 1023, place & 1023
                out |= {(start + k, anchor, lead - k) for k in range(n)}
        return out
    assert windows(8 << 20) == windows(5000)
