"""Filter interactions, fill-in-middle and chat trees: edges, odd rows, brute force."""

import hashlib
import itertools
import random
import re

import pytest

from bazaarlens.llm import chats, fim, interactions

ODD = ["", None, "<", "<P", "<P>", "x<S>y", "<M>", "a", "é中😀", "<<P", "P>", "<|turn|>", "\\", "\\\\", "<\\|end|>", "</s>[INST] ok [/INST]", "<|en<|end|>d|>", "[INS[INST]T]", "a\nb", "<|says|>\\<s>\\"]


# ------------------------------------------------------------------ fill in the middle

def brute_fim(key, text, seed=1):
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h = [int(h[i:i + 8], 16) for i in range(0, 32, 8)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def test_fim_equals_slices_and_restores(spark):
    rnd = random.Random(4)
    alphabet = ["a", "é", "中", "😀", "<", ">", "P", "S", "M", "\n"]
    texts = ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(600)] + ["中é" * 150_000, "x" * 3_000_000]
    rows = [(i, t, "k", 1) for i, t in enumerate(texts)] + [(None, "no id", "k", 2), (3, "same id", "k", 3), (3, "same id", "k", 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, form string, n int").repartition(3)
    done = fim.restore(fim.fill_in_middle(df))
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in done.collect()), key=repr)
    want = sorted(((i, *brute_fim("" if i is None else i, t or ""), t or "") for i, t, _, _ in rows), key=repr)
    assert got == want
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    assert fim.restore(fim.fill_in_middle(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        fim.restore(done)
    text_ids = fim.fill_in_middle(df.select(df.doc_id.cast("string").alias("k"), df.text.alias("t")), "k", "t")
    assert sorted((str(r["doc_id"]), r["output"]) for r in text_ids.collect()) == sorted((str(g[0]), g[5]) for g in got)


def test_rotation_in_place():
    for n in range(8):
        for a, b, c in itertools.combinations_with_replacement(range(n + 1), 3):
            buffer = bytearray(range(n))
            fim.rotate(buffer, a, b, c)
            whole = list(range(n))
            assert list(buffer) == whole[:a] + whole[b:c] + whole[a:b] + whole[c:]


# ------------------------------------------------------------------ filters

def brute_audit(rows, letters):
    out = []
    for part in {r[0] or "" for r in rows}:
        own = [r for r in rows if (r[0] or "") == part]
        removed_by = dict.fromkeys(letters, 0)
        lines = []
        for order in map("".join, itertools.permutations(letters)):
            alive = list(own)
            for step, k in enumerate(order, 1):
                gone = [r for r in alive if k in r[1]]
                alive = [r for r in alive if k not in r[1]]
                redundant = sum(k in r[1] for r in own) - len(gone)
                removed_by[k] += len(gone)
                lines.append([part, order, step, len(alive), len(gone), redundant, sum(r[1] == k for r in own), sum(bool(r[2]) for r in gone), sum(bool(r[3]) for r in gone)])
        out += [(*line, removed_by[line[1][line[2] - 1]]) for line in lines]
    return sorted(out)


@pytest.mark.parametrize("letters", ["A", "AB", "WXYZ"])
def test_audit_equals_every_order_run(spark, letters):
    rnd = random.Random(len(letters))
    rows = [(rnd.choice(["x", "y", None, ""]), "".join(k for k in letters if rnd.random() < 0.4), rnd.choice([True, False, None]), rnd.random() < 0.2) for _ in range(300)]
    df = spark.createDataFrame([(p, g, x, 1, *[k in f for k in letters]) for p, f, g, x in rows], "part string, good boolean, toxic boolean, state int, " + ", ".join(f"{k} boolean" for k in letters))
    got = interactions.audit_orders(df, letters)
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(rows, letters)
    assert interactions.audit_orders(df.limit(0), letters).count() == 0


def test_lattice_counts():
    for n in range(1, 7):
        edges = interactions.lattice(n)
        assert len(edges) == n << (n - 1)
        for f in range(n):
            assert sum(w for _, g, w in edges if g == f) == len(list(itertools.permutations(range(n))))
    with pytest.raises(ValueError):
        interactions.edge_counts(None, "AA")


def test_document_flags_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(199))
    rows = [(1, None, None), (2, "", "de"), (3, long, "de"), (4, long + " last", "de"), (5, "A" * 3 + "b" * 97, "fr"), (6, "A" * 4 + "b" * 96, "fr"), (7, "a b\x0bc\td e a", "fr"), (8, "a a a\n", ""),
            (9, "x#", None), (10, long, "es"), (3, long, "de"), (None, long, "es"), (11, "a a b", "fr")]
    docs = spark.createDataFrame([(i, t, p, "c", True) for i, t, p in rows], "doc_id bigint, text string, lang string, digest string, A boolean").repartition(3)
    labels = spark.createDataFrame([(3, 1, 0), (3, None, 1), (6, 0, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    want = []
    for i, t, p in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        want.append((i, p or "", len(words) < 200, 2 * len(set(words)) < len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > first[t],
                     i == 3 or None if i == 3 else False if i == 6 else None, True if i == 3 else False if i == 6 else None))
    got = [tuple(r) for r in interactions.document_flags(docs, labels).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


# ------------------------------------------------------------------ chats

def test_template_is_exact_for_odd_texts(spark):
    rnd = random.Random(9)
    alphabet = ["<", ">", "|", "\\", "/", "s", "turn", "says", "end", "[", "]", "INST", "<|end|>", "<s>", "é"]
    rows = [(7, "l7", None, i, rnd.choice(["user", "assistant", None, "<|says|>", "a\\"]), t) for i, t in enumerate(ODD)]
    rows += [(c, f"l{c}", 1, i, rnd.choice(["user", "assistant"]), "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 12)))) for c in range(40) for i in range(rnd.randint(1, 9))]
    turns = spark.createDataFrame(rows, "conv_id bigint, leaf string, branch int, position int, role string, text string").distinct().repartition(5)
    made = chats.format_chats(turns)
    want = sorted((c, leaf, p, r or "", t or "") for c, leaf, _, p, r, t in {tuple(r) for r in turns.collect()})
    by_leaf = {}
    for c, leaf, p, r, t in want:
        by_leaf.setdefault(leaf, []).append((p, r, t))
    got = {}
    for r in chats.read_chats(made).collect():
        got.setdefault(r["leaf"], []).append((r["segment"], r["place"], r["role"], r["text"]))
    assert {k: [x[2:] for x in sorted(v)] for k, v in got.items()} == {k: [x[1:] for x in sorted(v)] for k, v in by_leaf.items()}
    for r in made.collect():
        own = [x for x in sorted(by_leaf[r["leaf"]])]
        assert [chats.Template().unescape(r["formatted"][a:b]) for a, b in r["loss"]] == [t for _, role, t in own if role == "assistant"]
        marks = re.findall(r"<\|turn\|>|<\|says\|>|<\|end\|>|<s>|</s>|\[/?INST\]", r["formatted"])
        assert marks == ["<|turn|>", "<|says|>", "<|end|>"] * len(own)
    assert chats.digest_chats(chats.format_chats(turns.limit(0))).count() == 0
    for bad in ({"begin": "a"}, {"end": "<|<|"}, {"says": "<\\x"}):
        with pytest.raises(ValueError):
            chats.Template(**bad)


def test_long_conversation_goes_on_in_segments(spark, monkeypatch):
    monkeypatch.setattr(chats, "CHUNK_TURNS", 16)
    monkeypatch.setattr(chats, "SEGMENT_CHARS", 200)
    rows = [(1, i * 3 if i else None, ["user", "assistant"][i % 2], f"text <s> {i} " + "z" * (i % 40)) for i in range(300)] + [(1, 30, "user", "part"), (1, 30, "user", "part")] + [(2, 5, "assistant", None), (None, 1, "user", "x")]
    made = chats.format_chats(chats.turn_paths(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)))
    assert made.filter("conv_id = 1").count() > 30
    got = {r["conv_id"]: r for r in chats.digest_chats(made).collect()}
    for conv in (1, 2, None):
        own = sorted([(-1 if t is None else t, r, x or "") for c, t, r, x in rows if c == conv])
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256("".join(x for _, r, x in own if r == "assistant").encode()).hexdigest()


def brute_paths(rows, best):
    out = []
    for tree in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == tree}
        parent = {i: (r[2] if r[2] in own and r[2] != i else None) for i, r in own.items()}
        for i in sorted(own, key=str):  # circles are opened at their smallest message
            seen, at = [], i
            while at is not None and at not in seen:
                seen.append(at)
                at = parent[at]
            if at is not None:
                parent[min(seen[seen.index(at):], key=str)] = None
        leaves = set(own) - set(parent.values())
        found = []
        for leaf in leaves:
            path = []
            at = leaf
            while at is not None:
                path.insert(0, at)
                at = parent[at]
            found.append((-sum(own[m][4] or 0 for m in path), str(leaf), path))
        for branch, (_, _, path) in enumerate(sorted(found)[:best], 1):
            out += [(tree, branch, p, own[m][3]) for p, m in enumerate(path)]
    return sorted(out, key=repr)


def test_reply_trees_equal_a_walk(spark):
    rnd = random.Random(12)
    rows = []
    for tree in (1, 2, None, 4):
        for i in range(60):
            rows.append((tree, i, None if i == 0 else rnd.randint(0, i - 1) if rnd.random() < 0.9 else 999, f"m{tree}.{i}", rnd.choice([0.0, 1.0, 2.5, None])))
    rows += [(5, i, i - 1 if i else None, f"chain{i}", 1.0) for i in range(40)]
    rows += [(6, 10, 12, "c10", 1.0), (6, 11, 10, "c11", 0.0), (6, 12, 11, "c12", 0.0), (6, 13, 12, "under", 0.0), (6, 1, 13, "deeper", 0.0), (6, 20, 20, "self", 0.0), (6, 30, 31, "two", 0.0), (6, 31, 30, "ring", 0.0)]
    rows += [(7, i, 0 if i else None, f"star{i}", float(i % 7)) for i in range(400)]
    df = spark.createDataFrame([(*r, "user", "spare") for r in rows], "conv_id bigint, message_id bigint, parent_id bigint, text string, score double, role string, node string").repartition(5)
    for best in (2, 1000):
        got = chats.reply_paths(df, score="score", best=best)
        assert sorted(((r["conv_id"], r["branch"], r["position"], r["text"]) for r in got.collect()), key=repr) == brute_paths(rows, best)
    every = chats.reply_paths(df.filter("conv_id = 4"), score="score")
    assert every.count() == len(brute_paths([r for r in rows if r[0] == 4], None)) and every.filter("branch IS NOT NULL").count() == 0
    assert chats.reply_paths(df.limit(0), best=2).count() == 0


def test_rows_without_id_and_parts(spark):
    rows = [(1, None, None, "lost", "user"), (1, None, None, "lost", "user"), (1, 5, None, "b", "user"), (1, 5, None, "a", "user"), (1, 6, 5, None, None)]
    got = chats.reply_paths(spark.createDataFrame(rows, "conv_id bigint, message_id bigint, parent_id bigint, text string, role string"))
    found = {}
    for r in got.collect():
        found.setdefault(r["leaf"], []).append((r["position"], r["text"]))
    assert sorted(sorted(v) for v in found.values()) == [[(0, "a"), (0, "b"), (1, "")], [(0, "lost"), (0, "lost")]]
