"""Exact top-n scoring of sources against items, in bounded blocks, and co-purchases.

``block_top_n`` hashes each side into blocks of a bounded size, makes every (source block, item block) cell
one cogroup, and lets a cell emit only its own best n per source; the final n come from those. It serves up to a few
blocks of items. Larger item tables go through the index of ``neighbours``, which leaves out the blocks that
cannot hold one of the best n.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scale import top_k

BLOCK_ROWS, PLACES = 4096, 12
# (sources, items) -> score matrix [sources x items]; -inf drops a pair.
Score = Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]


def _product(left: pd.Series, right: pd.Series) -> np.ndarray:
    """Cosines of all rows of two columns of vectors; a missing vector is a zero vector of the others' width.

    Rounded to ``PLACES``, so that equal vectors tie in whatever block they stand.
    """
    width = max((len(v) for side in (left, right) for v in side if v is not None), default=1)
    return np.round(_matrix(left, width) @ _matrix(right, width).T, PLACES)


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Unit rows; a missing vector is a zero row."""
    m = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        if v is not None:
            m[i] = v
    length = np.linalg.norm(m, axis=1, keepdims=True)
    length[length == 0] = 1.0
    return m / length


def _best(scores: np.ndarray, items: np.ndarray, wanted: np.ndarray) -> list[np.ndarray]:
    """Column positions of each row's best ``wanted`` ones: score descending, then item ascending."""
    order = np.argsort(items, kind="stable")
    picks = []
    for row, n in zip(scores, wanted.tolist()):
        ranked = order[np.argsort(-row[order], kind="stable")][:n]
        picks.append(ranked[np.isfinite(row[ranked])])
    return picks


def best_of_cell(left: pd.DataFrame, right: pd.DataFrame, score: Score, need: str, source_key: str, item_key: str) -> pd.DataFrame:
    """(source, item, score) of the best items of every source of one cell; column ``need`` says how many."""
    if left.empty or right.empty:
        return pd.DataFrame({source_key: [], item_key: [], "score": []})
    table, ids = score(left, right), right[item_key].to_numpy()
    picks = _best(table, ids, left[need].to_numpy())
    rows = np.repeat(np.arange(len(left)), [len(p) for p in picks])
    cols = np.concatenate(picks) if len(rows) else np.array([], dtype=int)
    return pd.DataFrame({source_key: left[source_key].to_numpy()[rows], item_key: ids[cols], "score": table[rows, cols]})


def block_top_n(sources: DataFrame, items: DataFrame, score: Score, n: int, source_key: str = "source_id",
                item_key: str = "item_id", block_rows: int = BLOCK_ROWS, best_of: Callable[..., pd.DataFrame] = best_of_cell) -> DataFrame:
    """Best ``n`` items per source as (source, item, score, rank), over all pairs.

    A source may ask for its own number in a column ``need``. ``best_of`` finds the best of a cell.
    """
    own = "need" in sources.columns
    src_blocks = max(1, ceil(sources.count() / block_rows))
    item_blocks = max(1, ceil(items.count() / block_rows))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    block = lambda key, k: F.pmod(F.xxhash64(key), F.lit(k)).cast("int")
    s = sources.withColumn("_sb", block(source_key, src_blocks)).withColumn("_ib", every(item_blocks))
    # Fresh attribute ids: sources are often a projection of the items themselves.
    items = items.select(*[F.col(c).alias(c) for c in items.columns])
    i = items.withColumn("_ib", block(item_key, item_blocks)).withColumn("_sb", every(src_blocks))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return best_of(left if own else left.assign(need=n), right, score, "need", source_key, item_key)

    kinds = {f.name: f.dataType.simpleString() for f in [*sources.schema, *items.schema]}
    schema = f"{source_key} {kinds[source_key]}, {item_key} {kinds[item_key]}, score double"
    best = s.groupBy("_sb", "_ib").cogroup(i.groupBy("_sb", "_ib")).applyInPandas(cell, schema)
    if not own:
        return top_k(best, [source_key], [F.desc("score"), F.asc(item_key)], n)
    w = Window.partitionBy(source_key).orderBy(F.desc("score"), F.asc(item_key))
    ranked = best.join(sources.select(source_key, "need"), source_key).withColumn("rank", F.row_number().over(w))
    return ranked.filter("rank <= need").drop("need")


def dot_score(source_vector: str = "source_vector", vector: str = "vector") -> Score:
    """Inner product of the vectors."""
    def score(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
        return np.array([np.asarray(v, dtype=float) for v in left[source_vector]]) @ np.array([np.asarray(v, dtype=float) for v in right[vector]]).T
    return score


def cosine_score(vector: str = "embedding", source_vector: str | None = None, source_key: str = "source_id", item_key: str = "item_id") -> Score:
    """Cosine of the vectors; an item is never its own neighbour."""
    def score(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
        out = _product(left[source_vector or vector], right[vector])
        if source_key in left and item_key in right:
            out[left[source_key].to_numpy()[:, None] == right[item_key].to_numpy()[None, :]] = -np.inf
        return out
    return score


def content_score(weights: Sequence[float] = (0.5, 0.2, 0.15, 0.15)) -> Score:
    """Text cosine, same category, same brand and a Gaussian on the price z-score."""
    total = float(sum(weights))
    text, category, brand, price = (w / total for w in weights)

    def same(a: pd.Series, b: pd.Series) -> np.ndarray:
        x, y = a.to_numpy(dtype=object), b.to_numpy(dtype=object)
        known = pd.notna(x)[:, None] & pd.notna(y)[None, :]
        return (x[:, None] == y[None, :]) & known

    def score(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
        gap = left["price_z"].to_numpy(dtype=float)[:, None] - right["price_z"].to_numpy(dtype=float)[None, :]
        out = (text * (_product(left["embedding"], right["embedding"])) + category * same(left["category"], right["category"])
               + brand * same(left["brand"], right["brand"]) + price * np.exp(-gap ** 2 / 2))
        out[left["source_id"].to_numpy()[:, None] == right["item_id"].to_numpy()[None, :]] = -np.inf
        return out
    return score


def search_score() -> Score:
    """Cosine to a query vector under optional category, brand and price filters."""
    cosine = cosine_score(source_key="_none")

    def score(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
        out = cosine(left, right)
        for name in ("category", "brand"):
            want, have = left[name].to_numpy(dtype=object), right[name].to_numpy(dtype=object)
            out[pd.notna(want)[:, None] & (want[:, None] != have[None, :])] = -np.inf
        cost = right["price"].astype(float).to_numpy()
        low, high = left["price_min"].astype(float).to_numpy(), left["price_max"].astype(float).to_numpy()
        with np.errstate(invalid="ignore"):
            out[(cost[None, :] < low[:, None]) | (cost[None, :] > high[:, None])] = -np.inf
        return out
    return score


def price_stats(items: DataFrame) -> tuple[float, float]:
    """Mean and population deviation of positive prices (two numbers)."""
    p = F.col("price").cast("double")
    row = items.filter(p > 0).agg(F.avg(p).alias("m"), F.stddev_pop(p).alias("s")).first()
    return float(row["m"] or 0.0), float(row["s"] or 0.0)


def with_price_z(items: DataFrame, stats: tuple[float, float]) -> DataFrame:
    """Price z-score; a missing price counts as 0 before scaling."""
    p = F.coalesce(F.col("price").cast("double"), F.lit(0.0))
    mean, sd = stats
    return items.withColumn("price_z", (p - F.lit(mean)) / F.lit(sd) if sd > 0 else p)


def similar_content(sources: DataFrame, items: DataFrame, n: int = 10, stats: tuple[float, float] | None = None,
                    weights: Sequence[float] = (0.5, 0.2, 0.15, 0.15), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Content neighbours of the ``source_id`` rows. ``stats`` frozen: items can be added later."""
    from .neighbours import Bounds, nearest
    total = float(sum(weights))
    text, category, brand, price = (w / total for w in weights)
    ready = with_price_z(items, stats or price_stats(items)).select("item_id", "category", "brand", "price_z", "embedding")
    s = ready.withColumnRenamed("item_id", "source_id").join(sources.select("source_id").distinct(), "source_id", "left_semi")
    bounds = Bounds(weight=text, same=(("category", category), ("brand", brand)), near=("price_z", price))
    return nearest(s, ready, content_score(weights), bounds, n, block_rows=block_rows)


def search(queries: DataFrame, items: DataFrame, n: int = 10, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Items for query vectors; a category or brand no item has is ignored."""
    from .neighbours import Bounds, nearest
    def known(name: str) -> DataFrame:
        return items.select(F.col(name).alias(f"_{name}")).distinct()
    q = queries
    for name in ("category", "brand"):
        q = q.join(known(name), F.col(name) == F.col(f"_{name}"), "left").withColumn(name, F.col(f"_{name}")).drop(f"_{name}")
    bounds = Bounds(must=("category", "brand"), between=("price", "price_min", "price_max"))
    return nearest(q, items.select("item_id", "category", "brand", "price", "embedding"), search_score(), bounds, n, source_key="query_id", block_rows=block_rows)


# ------------------------------------------------------------------ co-occurrence

def bought_together(baskets: DataFrame, anchors: DataFrame) -> DataFrame:
    """(item, other, together): orders holding both, for every anchor item.

    An anchor line meets the other lines of its order and nothing else; counts are
    summed in the task that makes them, so pairs are never shuffled one by one. Both
    sides of the join split where one order is large, and the same path serves
    baskets of every size.
    """
    b = baskets.select("order_id", "item_id").distinct()
    left = b.join(anchors.select("item_id").distinct(), "item_id", "left_semi")
    right = b.select("order_id", F.col("item_id").alias("other_id"))
    return left.join(right, "order_id").filter(F.col("item_id") != F.col("other_id")).groupBy("item_id", "other_id").agg(F.count(F.lit(1)).alias("together"))


#: A list of an item's others is cut at ``PIECE``; carts of more than ``WIDE_CART`` items vote pair by pair; ``CART_LINES`` lines of carts make a task.
PIECE, WIDE_CART, CART_LINES = 4096, 4096, 1 << 14


def complete_carts(carts: DataFrame, baskets: DataFrame, n: int = 10, wide: int = WIDE_CART) -> DataFrame:
    """Items most often bought with the items of each cart (``cart_id, item_id``).

    What is bought with an item equally often travels to the carts that hold it as one list, and votes are added up in
    the task of their cart: none is shuffled by itself. Votes of a cart of more than ``wide`` items are spread by candidate.
    """
    from .neighbours import _stage
    own = _stage(carts.select("cart_id", "item_id").distinct(), "cart-items")
    pairs = bought_together(baskets, own)
    tasks = max(ceil(own.count() / CART_LINES), own.sparkSession.sparkContext.defaultParallelism)
    large = own.groupBy("cart_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > wide).select("cart_id")
    split = not large.isEmpty()
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("other_id"))
    pieces = pairs.repartition(tasks, "item_id").withColumn("_piece", F.floor((place - 1) / PIECE)).groupBy("item_id", "together", "_piece").agg(F.collect_list("other_id").alias("_others"))
    own_light = own.join(large, "cart_id", "left_anti") if split else own
    met = own_light.join(pieces, "item_id").select("cart_id", "together", "_others")
    # An item of the cart itself votes null and is dropped; rows without a cart id are no cart's items.
    itself = own_light.filter("cart_id IS NOT NULL").select("cart_id", F.lit(None).cast("bigint").alias("together"), F.array("item_id").alias("_others"))
    votes = met.unionByName(itself).repartition(tasks, "cart_id").select("cart_id", "together", F.explode("_others").alias("candidate_id")).groupBy("cart_id", "candidate_id").agg(
        F.sum("together").alias("together"), F.count(F.lit(1)).alias("_all"), F.count("together").alias("_votes"))
    fresh = votes.filter("_all = _votes").select("cart_id", "candidate_id", "together")
    if split:
        some = own.join(large, "cart_id", "left_semi")
        more = some.join(pairs, "item_id").groupBy("cart_id", F.col("other_id").alias("candidate_id")).agg(F.sum("together").alias("together"))
        fresh = fresh.unionByName(more.join(some.withColumnRenamed("item_id", "candidate_id"), ["cart_id", "candidate_id"], "left_anti"))
    return top_k(fresh, ["cart_id"], [F.desc("together"), F.asc("candidate_id")], n)
