"""How filters interact: removals on the edges of the lattice of filters already applied."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import columns, stage

# fixed values: white space between words, and the symbols of filter D
BLANK = " \t\n\x0b\x0c\r"
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#$%&*|]"
MOST = 8


def lattice(n: int) -> list[tuple[int, int, int]]:
    """Edges (state, filter, orders) of the subset lattice of ``n`` filters.

    A state is the bit set of filters applied. Forward counts are the orders that reach a
    state from the empty one, backward counts those that lead on to the full one; the
    product over an edge is the number of orders that pass it.
    """
    full = (1 << n) - 1
    ahead, back = [0] * (full + 1), [0] * (full + 1)
    ahead[0] = back[full] = 1
    for state in range(full + 1):
        for f in range(n):
            if not state >> f & 1:
                ahead[state | 1 << f] += ahead[state]
    for state in range(full, -1, -1):
        for f in range(n):
            if not state >> f & 1:
                back[state] += back[state | 1 << f]
    return [(state, f, ahead[state] * back[state | 1 << f]) for state in range(full + 1) for f in range(n) if not state >> f & 1]


def orders_through(letters: str) -> list[tuple[int, int, str, int]]:
    """(state, filter, filter_order, step) of every order, read along the lattice's edges."""
    n = len(letters)
    ways: dict[int, list[str]] = {0: [""]}
    edges = []
    for state, f, _ in lattice(n):
        ways.setdefault(state | 1 << f, []).extend(way + letters[f] for way in ways[state])
    for order in ways[(1 << n) - 1]:
        state = 0
        for step, letter in enumerate(order, 1):
            edges.append((state, letters.index(letter), order, step))
            state |= 1 << letters.index(letter)
    return edges


def _sum(condition: Column, of: str) -> Column:
    return F.sum(F.when(condition, F.col(of)).otherwise(0))


def edge_counts(flags: DataFrame, letters: str, part: str = "part", good: str = "good", toxic: str = "toxic") -> DataFrame:
    """Counts on every edge (state, filter) of the lattice, per part.

    ``flags`` has one boolean column per letter (true: the row fails that filter), and
    booleans ``good`` and ``toxic``. Returns part, state, filter, orders (that pass the
    edge), kept, removed, redundant, unique_fails, good_lost, toxic_lost.

    Rows are first counted per (part, set of failed filters), map-side, so however many rows
    a part has, at most ``2 ** n`` counts of it meet the edges. Null flags count as false.
    """
    if not 1 <= len(letters) <= MOST or len(set(letters)) != len(letters):
        raise ValueError(f"one to {MOST} different letters, not {letters!r}")
    fails = reduce(Column.__add__, [F.when(F.col(c), 1 << i).otherwise(0) for i, c in enumerate(letters)])
    one = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0))
    sets = flags.groupBy(F.col(part).alias("part"), fails.alias("fails")).agg(F.count(F.lit(1)).alias("n"), one(good).alias("n_good"), one(toxic).alias("n_toxic"))
    edges = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter"), F.lit(1 << f).alias("own"), F.lit(w).cast("bigint").alias("orders")) for s, f, w in lattice(len(letters))])
    rows = sets.select("*", F.inline(edges))
    own = F.col("own")
    fails_it, passed = F.col("fails").bitwiseAND(own) != 0, F.col("fails").bitwiseAND(F.col("state")) == 0
    return rows.groupBy("part", "state", "filter", "orders").agg(
        _sum(~fails_it & passed, "n").alias("kept"), _sum(fails_it & passed, "n").alias("removed"), _sum(fails_it & ~passed, "n").alias("redundant"),
        _sum(F.col("fails") == own, "n").alias("unique_fails"), _sum(fails_it & passed, "n_good").alias("good_lost"), _sum(fails_it & passed, "n_toxic").alias("toxic_lost"))


def shapley(edges: DataFrame) -> DataFrame:
    """(part, filter, shapley): removals of each filter, summed over all orders by the weights of its edges."""
    return edges.groupBy("part", "filter").agg(F.sum(F.col("orders") * F.col("removed")).alias("shapley"))


def audit_orders(flags: DataFrame, letters: str, part: str = "part", good: str = "good", toxic: str = "toxic") -> DataFrame:
    """Per part, order of all filters and step: what that step keeps and removes, and the filter's Shapley sum.

    Returns part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley; zeros are
    included. Every number is read from ``edge_counts``: a step of an order is an edge. A null part is the
    empty string's. No rows in, no rows out. The table of orders has ``n * n!`` rows for ``n``
    filters, which the program fixes, so it may be broadcast; above five filters ask ``shapley`` instead.
    """
    flags = flags.withColumn(part, F.coalesce(F.col(part).cast("string"), F.lit("")))
    edges = stage(edge_counts(flags, letters, part, good, toxic), "filter-edges")
    steps = flags.sparkSession.createDataFrame(orders_through(letters), "state int, filter int, filter_order string, step int")
    return (edges.join(shapley(edges), ["part", "filter"]).join(F.broadcast(steps), ["state", "filter"])
            .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))


def document_flags(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
                   least_words: int = 200, distinct_share: int = 50, upper_share: int = 3) -> DataFrame:
    """doc_id, part, the failures A to E of every row, and its labels good (quality 1) and toxic.

    A: fewer words than ``least_words``; B: under ``distinct_share`` per cent of the words are
    different; C: over ``upper_share`` per cent of the code points are A-Z; D: a symbol of
    ``# $ % & * |``; E: the text of a row with a smaller id.

    Whole texts are read once; what is shuffled afterwards is an id, a digest (SHA-256 stands for
    the text) and flags. The smallest id of each text is found map-side first, and its join
    has one row per text on one side, so a text that owns a third of all rows splits.

    Null text is empty, a null part the empty string. A null id has no order and never fails E.
    Rows of equal id are rows of their own, and do not fail E by each other. Several labels of an id count
    as one that is good, or toxic, if any of them is.
    """
    rows = columns(docs, doc_id=id_col, text=text_col, part=part_col).select(
        "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"))
    rows = rows.withColumn("bare", F.btrim("text", F.lit(BLANK)))
    rows = rows.withColumn("words", F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.split("bare", BLANKS)))
    rows = rows.withColumn("n_words", F.size("words"))
    read = stage(rows.select(
        "doc_id", "part", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), (F.col("n_words") < least_words).alias("A"),
        (100 * F.size(F.array_distinct("words")) < distinct_share * F.col("n_words")).alias("B"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")) > upper_share * F.char_length("text")).alias("C"), F.col("text").rlike(SYMBOLS).alias("D")), "filter-flags")
    first = read.groupBy(F.col("digest").alias("same")).agg(F.min("doc_id").alias("first_id"))
    marks = columns(labels, labelled="doc_id", quality="quality", toxic="toxic").groupBy("labelled").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    read = read.join(first, F.col("digest") == F.col("same")).withColumn("E", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)))
    return read.join(marks, F.col("doc_id") == F.col("labelled"), "left").select("doc_id", "part", *"ABCDE", "good", "toxic")


def op11_filter_interactions(spark, sf_dir: str) -> DataFrame:
    """Five filters over all documents, in all 120 orders, per language."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit_orders(document_flags(docs, labels), "ABCDE")


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  (CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END)
  || (CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 'C' ELSE '' END)
  || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > first_id THEN 'E' ELSE '' END) AS fails
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY 1, 2),
a AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (SELECT a1.k || a2.k || a3.k || a4.k || a5.k AS filter_order FROM a a1, a a2, a a3, a a4, a a5
  WHERE len(list_distinct([a1.k, a2.k, a3.k, a4.k, a5.k])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS k, substr(filter_order, 1, step - 1) AS before FROM o, range(1, 6) r(step)),
m AS (SELECT part, filter_order, step, k, contains(fails, k) AS hit, before <> '' AND regexp_matches(fails, '[' || before || '_]') AS gone, fails, n, g, x FROM c, s),
r AS (SELECT part, filter_order, step, k, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed,
  coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails = k), 0) AS unique_fails,
  coalesce(sum(g) FILTER (hit AND NOT gone), 0) AS good_lost, coalesce(sum(x) FILTER (hit AND NOT gone), 0) AS toxic_lost FROM m GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley FROM r"""
