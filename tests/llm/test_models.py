"""Rule forest, quality classifier and language-model scores."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pandas as pd

from bazaarlens.llm import features as FE
from bazaarlens.llm import lm as L
from bazaarlens.llm import quality as Q
from bazaarlens.llm import rules as R
from bazaarlens.llm.shared import byte_chunks

WORD = r"[^\x20\x09-\x0D]+"


def counts(text):
    text = text or ""
    words, seen, dup = re.findall(WORD, text), set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    mark = [False] * len(words)
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            mark[i : i + 3] = [True] * 3
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, sum(mark)


ODD = [None, "", " ", "\n\n", "a", "a b c a b c", "x\nx\n x\nx \n\nx", "é#é\x0bü*\r\nü", "a " * 100, "😀 b\n😀 b\n", "same line\n" * 60, "word " * 49 + "word", "|<>&%$*#" * 5, "\x1c\x85 　x"]


def labelled(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_rule_counts_of_odd_texts(spark, sf):
    df = spark.createDataFrame([(i, t, True, 0.5) for i, t in enumerate(ODD)] + [(None, "null id", False, 0.0), (3, "again", True, 0.0)], "doc_id bigint, text string, base_failed boolean, upper double").repartition(3)
    got = collections.defaultdict(list)
    for r in R.apply_rules(df, labelled(spark, sf)[1].limit(0)).collect():
        got[r["doc_id"]].append(r)
    for i, t in enumerate(ODD):
        r = next(x for x in got[i] if i != 3 or x["n_words"] == 0)
        want = counts(t)
        assert tuple(r[c] for c in FE.COUNTS) == want, t
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == (not r["base_failed"])  # no labels: base rules alone
    assert len(got[3]) == 2 and len(got[None]) == 1
    assert R.apply_rules(df.limit(0), labelled(spark, sf)[1]).count() == 0


def test_forest_keeps_good_and_drops_bad(spark, sf):
    root = sf.replace("0.001", "0.01")
    docs, labels = labelled(spark, root)
    got = R.apply_rules(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    open_ = got[~got.base_failed]
    assert open_[open_.quality == 1].kept.mean() > 0.97
    assert open_[open_.quality == 0].kept.mean() < 0.1
    sample = docs.limit(80).collect()
    by = got.set_index("doc_id")
    for r in sample:
        if r["doc_id"] in by.index:
            assert tuple(by.loc[r["doc_id"], list(FE.COUNTS)]) == counts(r["text"])


def test_forest_paths_match_a_walk():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(500, 3))
    forest = R.fit_forest(x, trees=5, sample=64)
    point = np.array([[4.0, 4.0, 4.0]])
    total = 0.0
    for c, t, length in zip(forest.column, forest.threshold, forest.length):
        node = 0
        while c[node] >= 0:
            node = 2 * node + (1 if point[0, c[node]] < t[node] else 2)
        total += length[node]
    assert math.isclose(forest.score(point)[0], 2 ** (-total / 5 / forest.mean_length))
    assert forest.score(point)[0] > forest.score(np.zeros((1, 3)))[0]


def test_forest_and_threshold_see_every_labelled_row(spark):
    """A kind of good text that fills one row in 5,000 still has its share of the trees; the cut is that of all rows."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30_000, len(R.FOREST_RULES)))
    x[17] = 900.0
    rows = spark.createDataFrame(pd.DataFrame(x, columns=list(R.FOREST_RULES)).assign(doc_id=np.arange(len(x)))).repartition(5)
    forest = R.fit_dealt(rows)
    assert forest.column.shape == (100, 511)
    assert (forest.threshold.max(axis=1) > 10).any()  # the odd row spreads the range of the tree that holds it
    assert R.fit_dealt(rows.limit(0)) is None
    few = R.fit_dealt(rows.filter("doc_id < 40"))
    assert len(few.column) == 100 and math.isclose(few.mean_length, float(R._mean_path(40)))
    score, good = np.round(rng.random(30_000), 3), rng.random(30_000) < 0.5
    score[good] *= 0.8
    value = {s: (score[good] <= s).mean() + (score[~good] > s).mean() for s in np.unique(score)}
    best = max(s for s in value if value[s] >= max(value.values()) - 1e-12)
    after = min(s for s in value if s > best)
    frame = spark.createDataFrame(pd.DataFrame({"score": score, "good": good}))
    assert math.isclose(R.calibrate(frame), (best + after) / 2)
    assert R.calibrate(frame.filter("good")) == float("inf") and R.calibrate(frame.limit(0)) == float("inf")


def test_quality_of_held_out_rows(spark, sf):
    docs, labels = labelled(spark, sf.replace("0.001", "0.01"))
    got = Q.classify(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(got.doc_id, got.held_out))
    assert (got.predicted == (got.score >= 0.5)).all()
    held = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.95
    # Labels of held-out rows play no part.
    flipped = labels.withColumn("quality", labels["quality"] * (Q.F.pmod(Q.F.crc32(labels["doc_id"].cast("string").cast("binary")), Q.F.lit(3)) != 1).cast("int"))
    again = Q.classify(docs, flipped).toPandas().set_index("doc_id").score
    assert np.allclose(again[got.doc_id].to_numpy(), got.score.to_numpy())


def test_quality_of_odd_rows(spark, sf):
    docs, labels = labelled(spark, sf)
    odd = spark.createDataFrame([(i, t, 9.0, True) for i, t in enumerate([*ODD, "x " * 50_000])] + [(None, "n", 1.0, False), (1, "b", 1.0, False)], "doc_id bigint, text string, score double, held_out boolean")
    for ls in (labels, labels.limit(0)):
        got = Q.classify(odd, ls).collect()
        assert len(got) == len(ODD) + 3 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in Q.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert Q.classify(odd.limit(0), labels).count() == 0


def test_prior_is_estimated():
    rnd = np.random.default_rng(3)
    positive, unlabelled = rnd.normal(2, 1, 4000), np.concatenate([rnd.normal(2, 1, 3500), rnd.normal(-3, 1, 1500)])
    assert abs(Q.estimate_prior(positive, unlabelled) - 0.7) < 0.06


def lm_brute(rows):
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    tokens = [(i, [*re.findall(WORD, fold(t)), None]) for i, t in rows]
    train = collections.Counter(w for i, ts in tokens if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for w in ts)
    n, v = sum(train.values()), len(train)
    return sorted((str(i), len(ts), sum(train[w] > 0 for w in ts), n, round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ts), 6)) for i, ts in tokens)


def lm_rows(df):
    return sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in L.score_texts(df).collect())


def test_word_counts(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert lm_rows(docs) == lm_brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    odd = [(i, t) for i, t in enumerate(ODD)] + [(None, "Null id"), (1, "again"), (1, "again"), (50, "x" * 70_000)]
    spark.createDataFrame([(i, t, 1, True) for i, t in odd], "doc_id bigint, text string, row int, train boolean").repartition(3).write.parquet(str(tmp_path / "odd"))
    df = spark.read.parquet(str(tmp_path / "odd"))
    assert lm_rows(df) == lm_brute(odd)
    assert lm_rows(df.filter("doc_id = 1 and text = 'none'")) == []
    assert all(r["score"] == 0 for r in L.score_texts(df).filter("n_bytes = 0").collect())


def test_mixer_is_a_distribution_and_ignores_company():
    """Costs of all 256 next bytes after a prefix are a probability distribution; texts do not affect each other."""
    rnd = random.Random(4)
    train = ("the cat sat on the mat and the dog ran to the door. " * 40).encode()
    counts_ = L.BitCounts()
    data, ends = np.frombuffer(train, np.uint8), np.array([0, len(train)])
    counts_.add(data, L.contexts(data, ends), np.ones(len(data), bool))
    table = np.clip(np.rint(np.log((counts_.table[:, 1::2] + 0.4) / (counts_.table[:, 0::2] + 0.4)) * L.STRETCH), -120, 120).astype(np.int8)
    mixer = L.Mixer(table)
    prefix = b"the cat sat on the m"
    alone = mixer.bits(np.frombuffer(prefix, np.uint8), np.array([0, len(prefix)]))[0]
    many = [prefix + bytes([b]) for b in range(256)]
    flat, cuts = np.frombuffer(b"".join(many), np.uint8), np.arange(257) * (len(prefix) + 1)
    total = (2.0 ** -(mixer.bits(flat, cuts) - alone)).sum()
    assert abs(total - 1) < 1e-3
    noise = bytes(rnd.randrange(97, 123) for _ in range(9000))
    pair = np.frombuffer(noise + prefix, np.uint8)
    together = mixer.bits(pair, np.array([0, len(noise), len(pair)]))
    assert math.isclose(together[1], alone, rel_tol=1e-6)
    assert together[1] / len(prefix) < together[0] / len(noise) / 2


def plain_bits(tables, text):
    """The mixer bit by bit: one segment after the other, weights moved after every block."""
    low, total = np.frombuffer(text, np.uint8), 0.0
    context = [_c.tolist() for _c in L.contexts(low, np.array([0, len(low)]))]
    for begin in range(0, len(low), L.Mixer.SEGMENT):
        weights, scale, shift = np.full((L.Mixer.GATES, 3), 0.4 / L.STRETCH), 1.0, 0.0
        for at in range(begin, min(begin + L.Mixer.SEGMENT, len(low)), L.Mixer.BLOCK):
            move, by_scale, by_shift, bits = np.zeros_like(weights), 0.0, 0.0, 0
            for i in range(at, min(at + L.Mixer.BLOCK, begin + L.Mixer.SEGMENT, len(low))):
                for d in range(L.SIZE[low[i]]):
                    step = L.FIRST[low[i]] + d
                    slot = [L._slots(L._spread(np.array([c[i]], np.uint32)), L._STEP_KEY[[step]])[0] for c in context]
                    x, bit, gate = np.array([float(t[k]) for t, k in zip(tables, slot)]), int(L.PATH_BITS[step]), min(d, L.Mixer.GATES - 1)
                    mixed = weights[gate] @ x
                    p = 1 / (1 + math.exp(-min(12, max(-12, scale * mixed + shift))))
                    total -= math.log2(p if bit else 1 - p)
                    move[gate] += (bit - p) * x
                    by_scale, by_shift, bits = by_scale + (bit - p) * mixed, by_shift + bit - p, bits + 1
            weights += L.Mixer.RATE / L.STRETCH**2 * move / bits
            scale += L.Mixer.LAST_RATE / 4 * by_scale / bits
            shift += L.Mixer.LAST_RATE * by_shift / bits
    return total


def test_mixer_equals_bit_by_bit_and_scatters_no_bits(monkeypatch):
    rng = np.random.default_rng(12)
    tables = rng.integers(-60, 61, (3, 1 << L.SLOT_BITS)).astype(np.int8)
    shortest = bytes([int(np.argmin(L.SIZE))])  # no bits in the last gate
    texts = [b"the cat sat on the mat", shortest, b"", shortest * 70, rng.integers(0, 256, 5000).astype(np.uint8).tobytes(), b"x"]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    scattered, bincount = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, *a, **k: scattered.append(len(x)) or bincount(x, *a, **k))
    got = L.Mixer(tables).bits(data, ends)
    assert sum(scattered) < len(data)  # sums go over runs of bits, not bit by bit
    assert np.allclose(got, [plain_bits(tables, t) for t in texts], rtol=1e-5)


def test_code_is_a_prefix_code():
    assert math.isclose(sum(2.0 ** -int(n) for n in L.SIZE), 1.0)


def test_chunks_are_whole_rows():
    import pyarrow as pa
    batch = pa.RecordBatch.from_pandas(pd.DataFrame({"text": ["ab", None, "", "c" * 50, "de"]}))
    parts = [(r.num_rows, bytes(d), e.tolist()) for r, d, e in byte_chunks([batch.slice(1)], limit=10)]
    assert sum(p[0] for p in parts) == 4 and b"".join(p[1] for p in parts) == b"c" * 50 + b"de"
