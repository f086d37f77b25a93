"""The metric index gives the neighbours of all pairs, and leaves out blocks that cannot hold any."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bazaarlens.operators import neighbours as NB
from bazaarlens.operators import recommend as RC
from bazaarlens.operators import similarity as SIM


def got(df, key="source_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append((r["rank"], r["item_id"], r["score"]))
    return {k: [(i, s) for _, i, s in sorted(v)] for k, v in out.items()}


def agree(a, b):
    assert set(a) == set(b)
    for k in a:
        assert [i for i, _ in a[k]] == [i for i, _ in b[k]], k
        assert np.allclose([s for _, s in a[k]], [s for _, s in b[k]])


@pytest.fixture(scope="module")
def clustered(spark):
    """1,500 vectors in 30 tight clusters, with zero and missing ones, repeats, categories and prices."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 8))
    rows = []
    for i in range(1500):
        v = centres[i % 30] + 0.05 * rng.normal(size=8)
        v = None if i == 11 else np.zeros(8) if i in (7, 8) else centres[3] if i % 100 == 3 else v
        rows.append((i, None if v is None else [float(x) for x in v * (1 + 5 * (i % 13 == 0))], None if i % 17 == 0 else f"c{i % 30 % 6}", f"b{i % 4}", None if i % 50 == 1 else float(i % 97)))
    return spark.createDataFrame(rows, "item_id long, embedding array<double>, category string, brand string, price double").cache()


def test_cosine_neighbours_equal_all_pairs_with_most_cells_skipped(spark, clustered):
    sources = clustered.withColumnRenamed("item_id", "source_id").filter("source_id % 3 = 0")
    seen = NB.Visits()
    index = NB.Index(clustered, NB.Bounds(), block_rows=40)
    agree(got(index.top_n(sources, SIM.cosine_score(), 7, visits=seen)), got(SIM.block_top_n(sources, clustered, SIM.cosine_score(), 7)))
    assert index.blocks["size"].sum() == 1500 and index.blocks["size"].max() <= 80 and len(index.blocks) >= 37
    assert len(seen.rounds) > 1 and seen.skipped > 0.5
    again = index.top_n(sources.filter("source_id < 5"), SIM.cosine_score(), 2000)
    assert {k: len(v) for k, v in got(again).items()} == {0: 1499, 3: 1499}
    assert index.top_n(sources.limit(0), SIM.cosine_score(), 3).count() == 0
    assert NB.Index(clustered.limit(0), NB.Bounds(), block_rows=40).top_n(sources, SIM.cosine_score(), 3).count() == 0


def test_content_neighbours_and_search_through_the_index(spark, clustered):
    sources = clustered.select(F.col("item_id").alias("source_id")).filter("source_id % 4 = 1")
    agree(got(SIM.similar_content(sources, clustered, 6, block_rows=50)), got(SIM.similar_content(sources, clustered, 6)))
    k = F.col("item_id")
    queries = clustered.filter("item_id % 6 = 0").select(k.alias("query_id"), "embedding", F.when(k % 12 == 0, F.col("category")).alias("category"), F.lit("nobody").alias("brand"),
                                                        F.when(k % 18 == 0, F.lit(20.0)).alias("price_min"), F.when(k % 5 == 0, F.lit(33.0)).alias("price_max"))
    a, b = SIM.search(queries, clustered, 5, block_rows=50), SIM.search(queries, clustered, 5)
    agree(got(a, "query_id"), got(b, "query_id"))


def test_cells_of_products_give_the_pairs_of_full_scores(spark, clustered):
    """Large tables: every source's own number, ties by id, zero and missing vectors, filters, in one cell and over many."""
    sources = clustered.withColumnRenamed("item_id", "source_id").withColumn("need", F.when(F.col("source_id") % 9 == 0, 600).when(F.col("source_id") % 7 == 0, 0).otherwise(4))
    full = SIM.block_top_n(sources, clustered, SIM.cosine_score(), 4)
    agree(got(NB.nearest(sources, clustered, SIM.cosine_score(), NB.Bounds(), 4, block_rows=60)), got(full))
    left, right = sources.toPandas(), clustered.toPandas()
    tiles, NB.TILE = NB.TILE, (64, 128)
    try:
        cell = NB.best_by_product(left, right, NB.Bounds(), "need", "source_id", "item_id")
    finally:
        NB.TILE = tiles
    assert len(cell) == full.count() and not cell.duplicated(["source_id", "item_id"]).any()
    weights = (0.5, 0.2, 0.15, 0.15)
    for frame in (left, right):
        frame["price_z"] = frame["price"] / 10
    bounds = NB.Bounds(weight=0.5, same=(("category", 0.2), ("brand", 0.15)), near=("price_z", 0.15), must=("brand",), between=("price", "low", "high"))
    left = left.assign(low=np.where(left.source_id % 2 == 0, 5.0, np.nan), high=np.where(left.source_id % 4 == 0, 50.0, np.nan))
    table = SIM.content_score(weights)(left, right)
    cost = right["price"].to_numpy()[None, :]
    table[(left["brand"].to_numpy()[:, None] != right["brand"].to_numpy()[None, :]) | (cost < left["low"].to_numpy()[:, None]) | (cost > left["high"].to_numpy()[:, None])] = -np.inf
    mine = NB.best_by_product(left, right, bounds, "need", "source_id", "item_id").sort_values(["source_id", "score", "item_id"], ascending=[True, False, True])
    want = SIM.best_of_cell(left, right, lambda a, b: table, "need", "source_id", "item_id").sort_values(["source_id", "score", "item_id"], ascending=[True, False, True])
    assert mine["source_id"].to_list() == want["source_id"].to_list() and np.allclose(mine["score"], want["score"])


def test_inner_products_of_all_users_with_their_own_exclusions(spark):
    rng = np.random.default_rng(8)
    users = rng.normal(size=(300, 6))
    items = rng.normal(size=(900, 6)) * rng.pareto(1.5, size=(900, 1))
    items[5] = items[6]
    users[4] = 0
    frame = lambda m: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, features array<double>")
    seen = {(int(u), int(i)) for u, i in zip(rng.integers(0, 300, 2000), rng.integers(0, 900, 2000))} | {(9, i) for i in range(880)}
    exclude = spark.createDataFrame(sorted(seen), "user_id long, item_id long")
    ask = spark.createDataFrame([(i,) for i in range(300)] + [(999,)], "user_id long")
    visits = NB.Visits()
    out = got(RC.recommend(frame(users), frame(items), ask, 5, exclude, block_rows=25, visits=visits), "user_id")
    scores = users @ items.T
    for u in range(300):
        best = sorted((-round(scores[u, i], 9), i) for i in range(900) if (u, i) not in seen)[:5]
        assert [i for i, _ in out[u]] == [i for _, i in best], u
    assert 999 not in out and len(out[9]) == 5
    assert visits.skipped > 0.3


def test_a_block_that_everybody_wants_is_many_cells(spark):
    """One vector owns most of the items and sources: blocks and chunks stay bounded, ties go by id."""
    rows = [(i, [1.0, 0.0]) for i in range(700)] + [(700 + i, [0.0, 1.0]) for i in range(100)]
    df = spark.createDataFrame(rows, "item_id long, embedding array<double>")
    index = NB.Index(df, NB.Bounds(), block_rows=50)
    assert index.blocks["size"].max() <= 100
    out = got(index.top_n(df.withColumnRenamed("item_id", "source_id"), SIM.cosine_score(), 3))
    assert all([i for i, _ in v] == [x for x in (0, 1, 2, 3) if x != k][:3] for k, v in out.items() if k < 700)
    assert all([i for i, _ in v] == [x for x in (700, 701, 702, 703) if x != k][:3] for k, v in out.items() if k >= 700)
