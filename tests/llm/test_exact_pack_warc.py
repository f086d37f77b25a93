"""Content sort, packing, pieces, archives and the pipeline."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from compare import connect, differences

from bazaarlens.llm import exact_dedup, packing, pieces, queries, warc

TEXTS = ["", " ", "a", "  a  b ", "\n", "\nabc", "a\n b", "▁", "▁▁a", "a▁▁▁▁b▁ c▁", " ▁a", "<s>hi</s>", "<0x41>", "é中文😀\x00x", "a" * 300, "the" * 40, "\t\tx\r\n y", "▁" * 17 + "x", "　a",
         "=" * 80, "ananas" * 30, "<|endoftext|> I'll can't <|startoftext|>x", "ΑΣ Σα ΣΣ. İx ﬁ é \x1cq\x85z", "Hello, World! 12345 it's"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(name, spark, sf):
    diffs, n = differences(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLE[name])
    assert not diffs, diffs
    assert n > 0


def test_content_sort_of_odd_rows(spark):
    rows = [(1, "Abc"), (2, "aBC"), (3, "É"), (4, "é"), (5, None), (6, ""), (None, "abc"), (2, "aBC"), (None, None), (None, "only"), (None, "only")] + [(100 + i, "hot") for i in range(500)]
    df = spark.createDataFrame([(i, t, "s", 5) for i, t in rows], "doc_id bigint, text string, norm string, salt int").repartition(4)
    got = exact_dedup.content_sort(df).collect()
    assert len(got) == len(rows)
    size = collections.Counter((t or "").replace("A", "a").replace("B", "b").replace("C", "c") for _, t in rows)
    assert collections.Counter(r["group_size"] for r in got) == collections.Counter(size[(t or "").replace("A", "a").replace("B", "b").replace("C", "c")] for _, t in rows)
    kept = [(r["keep_id"], r["doc_id"]) for r in got if r["kept"]]
    assert sorted(kept, key=str) == sorted([(2, 2), (3, 3), (4, 4), (6, 6), (599, 599), (None, None)], key=str)
    assert exact_dedup.content_sort(df.limit(0)).count() == 0


def test_tokens_and_pieces(spark):
    from tokenizers import Tokenizer
    rnd = random.Random(2)
    rows = list(enumerate([*TEXTS, None, " ".join(rnd.choice(TEXTS) for _ in range(3000))]))
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in rows] + [(None, "x", 1, "q"), (2, "a", 1, "q")], "doc_id bigint, text string, uid int, offset string").repartition(3)
    tok = Tokenizer.from_file(packing.vocabulary_path())
    got = packing.pack_documents(df, packing.vocabulary_path()).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for i, t in rows:
        if i == 2:
            continue
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want = [(k, a, min(2048, len(ids) - a), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by[i]) == want, t
    assert len(by[None]) == 1 and len(by[2]) == 2
    check_bins(got)
    assert packing.pack_documents(df.limit(0), packing.vocabulary_path()).count() == 0


def check_bins(rows):
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins)


def test_packing_is_tight_over_many_groups(spark):
    rnd = random.Random(9)
    lengths = [min(2047, max(1, int(rnd.expovariate(1 / 400)))) for _ in range(6000)]
    items = spark.createDataFrame(list(enumerate(lengths)), "uid bigint, length bigint")
    got = packing.hierarchical_best_fit(items, 2048, group_items=700).join(items, "uid").collect()
    assert len(got) == len(lengths)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["bin"]].append((r["offset"], r["length"]))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.01 * sum(lengths) / 2048 + 1
    wide = spark.createDataFrame([(i, 1100) for i in range(3000)], "uid bigint, length bigint")
    assert packing.hierarchical_best_fit(wide, 2048, group_items=500).select("bin").distinct().count() == 3000


def test_pieces_are_the_librarys():
    import sentencepiece
    model, lib = pieces.PieceModel(pieces.model_path()), sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    rnd = random.Random(1)
    parts = ["the", "in", "er", "▁", " ", "\n", "a", "e", "x", "=", "-", "é", "😀", "ing", "1", "0"]
    texts = TEXTS + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 60))) for _ in range(600)]
    for t in texts:
        ids = lib.encode(t)
        assert model.encode(t) == ids, t
        assert model.decode(ids) == lib.decode(ids), t
    for _ in range(600):
        ids = [rnd.choice([rnd.randint(0, 31999), rnd.randint(3, 258), rnd.randint(0, 3), 259, 260]) for _ in range(rnd.randint(0, 12))]
        assert model.decode(ids) == lib.decode(ids), ids


def test_piece_round_trip(spark, sf):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(10_000 + i, t) for i, t in enumerate([*TEXTS, None])] + [(None, "x"), (1, "again")]
    df = spark.createDataFrame([(i, t, 3) for i, t in docs], "doc_id bigint, text string, ids int").repartition(3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((str(i), len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids))) for i, ids in ((i, lib.encode(t or "")) for i, t in docs))
    assert sorted((str(r[0]), *r[1:]) for r in pieces.round_trip(df, pieces.model_path()).collect()) == want
    back = pieces.decode_documents(pieces.encode_documents(df, pieces.model_path()), pieces.model_path()).collect()
    assert sorted(str(r["text"]) for r in back) == sorted(lib.decode(lib.encode(t or "")) for _, t in docs)


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:777>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


@pytest.mark.parametrize("split", ["134217728", "700"])
def test_archives_with_magic_in_payloads(spark, split):
    pages = [(1, "u", FAKE * 3), (2, None, None), (3, "u\r\nx", "é" * 80), (4, "v", "é" * 80), (5, "u", "WARC/1.1\r\n"), (6, "u", "x" * 300 + "WARC/1.1\r\nabc\r\n\r\n" + "y" * 3000 + FAKE), (None, "q", "short"),
             (7, "z", "x" * 300 + "WARC/1.1\r\nabc\r\n\r\n" + "y" * 3000 + FAKE), (8, "z", "short"), (9, "a", (FAKE + "q" * 500) * 20), (10, "a", "\r\n\r\n"),
             (11, "b", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 100000\r\n\r\n")] + [(i, "k", f"page {i} " + FAKE * (i % 3)) for i in range(100, 160)]
    df = spark.createDataFrame([(i, u, h, "r", 0) for i, u, h in pages], "page_id bigint, url string, html string, digest string, first int").coalesce(2)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = sorted(map(str, (tuple(r) for r in warc.round_trip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    want = []
    for i, _, h in pages:
        data = (h or "").encode()
        same = [j for j, _, k in pages if (k or "").encode() == data and j is not None]
        first = min(same, default=None)
        again = len(data) >= 100 and i != first
        want.append(str((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None)))
    assert got == sorted(want)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_pipeline_against_its_stages(spark, sf):
    import corpus_pipeline as P
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality classifier", "exact dedup", "near dedup", "secret scan", "best-fit packing"]
    from bazaarlens.llm import near_dedup, quality, secrets
    from bazaarlens.llm.shared import stage
    now = docs
    for (name, apply), plain in zip(P.STAGES, ("quality", "exact", "near", "secrets", None)):
        after = stage(apply(spark, now, sf), "t")
        if plain is None:
            assert {r["doc_id"] for r in after.select("doc_id").collect()} == {r["doc_id"] for r in now.select("doc_id").collect()}
            check_bins(after.collect())
            break
        assert after.columns == docs.columns
        ids = [r["doc_id"] for r in after.collect()]
        if plain == "quality":
            want = [r["doc_id"] for r in quality.classify(now, spark.read.parquet(f"{sf}/labels.parquet")).filter("predicted = 1").collect()]
        elif plain == "exact":
            groups = {}
            for r in now.collect():
                key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"])
                groups[key] = max(r["doc_id"], groups.get(key, -1))
            want = list(groups.values())
        elif plain == "near":
            want = [r["doc_id"] for r in near_dedup.near_duplicates(now).filter("doc_id = class_id").collect()]
        else:
            want = [r["doc_id"] for r in secrets.scan_secrets(now).filter("spans = ''").collect()]
        assert sorted(ids) == sorted(want), name
        now = after
    odd = spark.createDataFrame([(1, "x " * 60, "en", "s", 1), (1, "x " * 60, "en", "s", 1), (None, None, None, None, None), (2, "", "en", None, 0)], docs.schema)
    for name, apply in P.STAGES:
        odd = stage(apply(spark, odd, sf), "odd")


def test_payloads_cross_the_shuffle_smaller_than_packed_by_zstd(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").toArrow().to_batches()
    packed = [b for b in warc._pack(iter(pages))]
    texts = [(v or "").encode() for b in pages for v in b.column(2).to_pylist()]
    zstd = pa.Codec("zstd")
    sent = sum(len(v) + len(d) for b in packed for v, d in zip(b.column(2).to_pylist(), b.column(4).to_pylist()))
    assert sent < 0.95 * sum(len(zstd.compress(t, asbytes=True)) + 64 for t in texts)
    codec = pa.Codec(warc.PACKED[0])
    assert [codec.decompress(v, n, asbytes=True) if n else b"" for b in packed for v, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist())] == texts
