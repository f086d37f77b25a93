"""Interactions, factor models, evaluation and batch recommendations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import count_if, ratio
from ..functions.privacy import digest_bucket
from ..functions.vectors import dot, unit
from .scale import top_k

# Interaction strength per event type.
WEIGHTS = {"page_view": 0.0, "product_view": 1.0, "add_to_cart": 3.0, "purchase": 5.0}
# Blend of collaborative and content scores, interactions needed.
BLEND = (0.7, 0.3)
MIN_SERVE, MIN_TRAIN = 100, 5


def interactions(events: DataFrame, asof: str, days: int = 90, weights: dict[str, float] = WEIGHTS, ts: str = "ts") -> DataFrame:
    """(user, item, weight, count, last_at) over the look-back."""
    w = F.lit(None).cast("double")
    for name, value in weights.items():
        w = F.when(F.col("event_type") == name, F.lit(value)).otherwise(w)
    recent = events.filter((F.col(ts) >= F.date_sub(F.lit(asof).cast("date"), days)) & F.col("item_id").isNotNull())
    return recent.withColumn("_w", w).filter(F.col("_w") > 0).groupBy("user_id", "item_id").agg(
        F.sum("_w").alias("weight"), F.count(F.lit(1)).alias("interactions"), F.max(ts).alias("last_at"))


def split_by_day(df: DataFrame, start: str, ts: str = "ts", train: int = 70, validate: int = 80, test: int = 90) -> DataFrame:
    """Tag rows train / validation / test by days since ``start``; later rows drop out."""
    day = F.datediff(F.col(ts), F.lit(start).cast("date"))
    part = F.when(day <= train, "train").when(day <= validate, "validation").when(day <= test, "test")
    return df.filter((day >= 0) & (day <= test)).withColumn("split", part)


def active_users(df: DataFrame, minimum: int = MIN_TRAIN, count: str = "interactions") -> DataFrame:
    """Rows of users with at least ``minimum`` interactions."""
    users = df.groupBy("user_id").agg(F.sum(count).alias("_n")).filter(F.col("_n") >= minimum).select("user_id")
    return df.join(users, "user_id", "left_semi")


def statistics(df: DataFrame) -> DataFrame:
    """Users, items, interactions and density in one row, without a distinct Expand."""
    users = df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("users"), F.sum("n").alias("pairs"))
    items = df.groupBy("item_id").agg(F.sum("interactions").alias("n")).agg(F.count(F.lit(1)).alias("items"), F.sum("n").alias("interactions"))
    one = users.withColumn("_k", F.lit(1)).join(items.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return one.withColumn("density", ratio("pairs", F.col("users") * F.col("items")))


def indexed(catalogue: DataFrame, key: str = "item_id", buckets: int = 4096) -> DataFrame:
    """Dense numbers 0..N-1 without a global sort: position in a hash bucket plus
    the sizes of the buckets before it (``buckets`` rows, whatever N)."""
    b = catalogue.select(key).distinct().withColumn("_b", digest_bucket(key, buckets))
    sizes = b.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_b", F.coalesce(before, F.lit(0)).alias("_o"))
    pos = F.row_number().over(Window.partitionBy("_b").orderBy(key)) - 1
    return b.withColumn("_p", pos).join(F.broadcast(offsets), "_b").select(key, (F.col("_o") + F.col("_p")).cast("bigint").alias("item_no"))


def negatives(positives: DataFrame, catalogue: DataFrame, per_positive: int = 4, seed: int = 42) -> DataFrame:
    """Seeded negative items: ``per_positive`` different ones per positive, never a positive of that user.

    Items are numbered 0..N-1 and a user's P positives leave N - P free places. A
    positive hashes to one place and takes the next ones in a circle, so it falls short
    only where fewer places than that exist. Place c is item c plus the number of
    positives whose own number less their rank is at most c: one running count per
    user over positives and places.
    """
    numbered = indexed(catalogue)
    own = positives.select("user_id", "item_id").distinct().join(numbered, "item_id")
    by_number = Window.partitionBy("user_id").orderBy("item_no")
    taken = own.select("user_id", (F.col("item_no") - F.row_number().over(by_number) + 1).alias("place"), F.lit(0).alias("kind"), F.lit(None).cast(own.schema["item_id"].dataType).alias("positive_id"))
    liked = own.groupBy("user_id").agg(F.count(F.lit(1)).alias("_p")).withColumn("_free", F.lit(numbered.count()) - F.col("_p"))
    start = digest_bucket(F.concat_ws("|", F.col("user_id").cast("string"), F.col("item_id").cast("string"), F.lit(str(seed))), F.col("_free"))
    wanted = own.join(liked, "user_id").filter("_free > 0").select("user_id", F.col("item_id").alias("positive_id"), start.alias("_s"), "_free", F.explode(
        F.sequence(F.lit(0), F.least(F.lit(per_positive).cast("bigint"), F.col("_free")).cast("int") - 1)).alias("_k"))
    places = wanted.select("user_id", ((F.col("_s") + F.col("_k")) % F.col("_free")).alias("place"), F.lit(1).alias("kind"), "positive_id")
    running = Window.partitionBy("user_id").orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, 0)
    placed = taken.unionByName(places).withColumn("_shift", F.sum(1 - F.col("kind")).over(running)).filter("kind = 1")
    return placed.select("user_id", "positive_id", (F.col("place") + F.col("_shift")).alias("item_no")).join(numbered, "item_no").select("user_id", "positive_id", "item_id")


@dataclass(frozen=True)
class Factors:
    """Factor tables (id, features) of users and items, under the ids of the ratings."""

    userFactors: DataFrame
    itemFactors: DataFrame
    rank: int


def fit_factors(ratings: DataFrame, rank: int = 64, reg: float = 0.01, iterations: int = 15, alpha: float = 40.0, seed: int = 42,
                blocks: int | None = None) -> Factors:
    """Implicit-feedback ALS over ids of any type; deep lineage is cut in the session's shared folder.

    As many blocks as the session has shuffle partitions, unless given. Ratings are written once, as the ids of both
    sides and the fit read them.
    """
    from ..session import shared_folder
    from .neighbours import _stage
    shared_folder(ratings.sparkSession)
    ratings = _stage(ratings.select("user_id", "item_id", "weight"), "ratings")
    blocks = blocks or int(ratings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    users = indexed(ratings, "user_id").select("user_id", F.col("item_no").cast("int").alias("_u"))
    items = indexed(ratings, "item_id").select("item_id", F.col("item_no").cast("int").alias("_i"))
    als = ALS(rank=rank, regParam=reg, maxIter=iterations, alpha=alpha, implicitPrefs=True, seed=seed, numUserBlocks=blocks, numItemBlocks=blocks,
              userCol="_u", itemCol="_i", ratingCol="weight", coldStartStrategy="nan", checkpointInterval=5)
    model = als.fit(ratings.join(users, "user_id").join(items, "item_id").select("_u", "_i", F.col("weight").cast("float")))
    named = lambda factors, names, key, no: factors.join(names, factors["id"] == names[no]).select(names[key].alias("id"), "features")
    return Factors(named(model.userFactors, users, "user_id", "_u"), named(model.itemFactors, items, "item_id", "_i"), rank)


def score_pairs(pairs: DataFrame, user_factors: DataFrame, item_factors: DataFrame) -> DataFrame:
    """Dot product per (user, item); an unknown user or item scores 0."""
    u = user_factors.select(F.col("id").alias("user_id"), F.col("features").alias("_u"))
    i = item_factors.select(F.col("id").alias("item_id"), F.col("features").alias("_i"))
    return pairs.join(u, "user_id", "left").join(i, "item_id", "left").withColumn(
        "score", F.coalesce(dot("_u", "_i"), F.lit(0.0))).drop("_u", "_i")


def recommend(user_factors: DataFrame, item_factors: DataFrame, users: DataFrame, n: int = 10, exclude: DataFrame | None = None, **search) -> DataFrame:
    """Best ``n`` items per known user without excluded (user, item) pairs; unknown users get none.

    Large item tables are compared in cells of matrices; with ``visits`` they are searched by norm: blocks whose largest norm
    times the user's cannot reach the user's n-th score so far are left out (``neighbours``). ``search``: block_rows, visits.

    A user is asked for n plus the number of their own exclusions, so dropping these
    leaves nobody short and one long list costs the others nothing.
    """
    from .neighbours import Bounds, nearest
    from .similarity import dot_score
    u = user_factors.select(F.col("id").alias("user_id"), F.col("features").alias("source_vector")).join(users.select("user_id").distinct(), "user_id")
    if exclude is not None:
        own = exclude.groupBy("user_id").agg(F.count(F.lit(1)).alias("_x"))
        u = u.join(own, "user_id", "left").withColumn("need", (F.lit(n) + F.coalesce("_x", F.lit(0))).cast("int")).drop("_x")
    i = item_factors.select(F.col("id").alias("item_id"), F.col("features").alias("vector"))
    flat = nearest(u, i, dot_score(), Bounds("vector", "source_vector", unit=False), n, source_key="user_id", **search).drop("rank")
    if exclude is not None:
        flat = flat.join(exclude.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    return top_k(flat, ["user_id"], [F.desc("score"), F.asc("item_id")], n)


def embeddings(factors: DataFrame) -> DataFrame:
    return factors.select(F.col("id").alias("item_id"), unit("features").alias("embedding"))


def fuse(text: DataFrame, image: DataFrame, key: str = "item_id") -> DataFrame:
    """Concatenate the normalised text and image vectors of an item."""
    t = text.select(key, unit("embedding").alias("_t"))
    i = image.select(key, unit("embedding").alias("_i"))
    return t.join(i, key).select(key, F.concat("_t", "_i").alias("embedding"))


def evaluate(ranked: DataFrame, actual: DataFrame, catalogue: DataFrame, ks: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """HR@k, NDCG@k, MRR and coverage over users with at least one actual item.

    ``ranked`` is (user, item, rank), ``actual`` (user, item), ``catalogue`` the items
    that could be shown; they are counted in the plan.
    """
    act = actual.select("user_id", "item_id").distinct()
    relevant = act.groupBy("user_id").agg(F.count(F.lit(1)).alias("_rel"))
    hits = ranked.join(act, ["user_id", "item_id"]).select("user_id", "rank")
    gain = F.lit(1.0) / F.log2(F.col("rank") + 1.0)
    per_user = hits.groupBy("user_id").agg(
        F.min("rank").alias("_first"), *[F.sum(F.when(F.col("rank") <= k, gain)).alias(f"_dcg{k}") for k in ks],
        *[F.max(F.when(F.col("rank") <= k, 1).otherwise(0)).alias(f"_hit{k}") for k in ks])
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.col("_rel"), F.lit(k)).cast("int")), F.lit(0.0),
                                  lambda acc, r: acc + F.lit(1.0) / F.log2(r + F.lit(1.0)))
    users = relevant.join(per_user, "user_id", "left")
    row = users.agg(
        F.count(F.lit(1)).alias("users"), F.avg(F.coalesce(F.lit(1.0) / F.col("_first"), F.lit(0.0))).alias("mrr"),
        *[F.avg(F.coalesce(F.col(f"_hit{k}"), F.lit(0)).cast("double")).alias(f"hr_at_{k}") for k in ks],
        *[F.avg(F.coalesce(F.col(f"_dcg{k}"), F.lit(0.0)) / ideal(k)).alias(f"ndcg_at_{k}") for k in ks])
    sides = catalogue.select("item_id").distinct().withColumn("_shown", F.lit(0)).unionByName(ranked.select("item_id").distinct().withColumn("_shown", F.lit(1)))
    shown = sides.agg(ratio(F.sum("_shown"), F.sum(1 - F.col("_shown"))).alias("coverage"))
    return row.withColumn("_k", F.lit(1)).join(shown.withColumn("_k", F.lit(1)), "_k").drop("_k")


def hit_rate(ranked: DataFrame, actual: DataFrame) -> DataFrame:
    """Hits over actual items per user (all users)."""
    act = actual.select("user_id", "item_id").distinct()
    hits = act.join(ranked.select("user_id", "item_id").distinct().withColumn("_hit", F.lit(1)), ["user_id", "item_id"], "left")
    return hits.groupBy("user_id").agg(F.count(F.lit(1)).alias("actual"), count_if(F.col("_hit") == 1).alias("hits")).withColumn(
        "hit_rate", ratio("hits", "actual"))


def gate(metrics: DataFrame, metric: str = "hr_at_10", minimum: float = 0.1) -> DataFrame:
    """Registry row with the deployment decision."""
    return metrics.withColumn("deploy", F.col(metric) >= F.lit(minimum))


# ------------------------------------------------------------------ serving tables

def strategy(placement: Column | str = "placement", default: str = "popularity") -> Column:
    """Strategy of a request from its placement and what it carries."""
    p = F.col(placement) if isinstance(placement, str) else placement
    user, source = F.col("user_id").isNotNull(), F.col("source_product_id").isNotNull()
    cart = F.coalesce(F.size("cart_product_ids") > 0, F.lit(False))
    return (F.when((p == "homepage") & user, "collaborative").when(p == "homepage", "popularity")
            .when((p == "pdp") & source & user, "hybrid").when((p == "pdp") & source, "content_based")
            .when((p == "cart") & (user | cart), "collaborative").otherwise(default))


def with_fallback(requests: DataFrame, counts: DataFrame, minimum: int = MIN_SERVE) -> DataFrame:
    """Too little history: collaborative falls to popularity, hybrid to content; content
    without a source product falls to popularity."""
    j = requests.join(counts.select("user_id", F.col("interactions").alias("_n")), "user_id", "left")
    thin = F.coalesce(F.col("_n"), F.lit(0)) < minimum
    s = F.col("strategy")
    s = F.when(thin & (s == "collaborative"), "popularity").when(thin & (s == "hybrid"), "content_based").otherwise(s)
    s = F.when((s == "content_based") & F.col("source_product_id").isNull(), "popularity").otherwise(s)
    return j.withColumn("strategy", s).drop("_n")


def blend(collaborative: DataFrame, content: DataFrame, keys: Sequence[str] = ("request_id", "item_id"), weights: tuple[float, float] = BLEND) -> DataFrame:
    """Weighted full outer merge of two scored lists."""
    a = collaborative.select(*keys, F.col("score").alias("_a"))
    b = content.select(*keys, F.col("score").alias("_b"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return a.join(b, list(keys), "full_outer").select(*keys, (F.lit(weights[0]) * zero("_a") + F.lit(weights[1]) * zero("_b")).alias("score"))


def exclusions(requests: DataFrame) -> DataFrame:
    """(request, item) pairs a request must not return: listed, in the cart, the source itself."""
    empty = F.array().cast("array<bigint>")
    ids = F.concat(F.coalesce("exclude_product_ids", empty), F.coalesce("cart_product_ids", empty),
                   F.array_compact(F.array(F.col("source_product_id").cast("bigint"))))
    return requests.select("request_id", F.explode(ids).alias("item_id")).distinct()


def filtered(candidates: DataFrame, requests: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """Drop exclusions; apply the request's price range and stock filter from the catalogue."""
    out = candidates.join(exclusions(requests), ["request_id", "item_id"], "left_anti")
    if catalogue is None:
        return out
    r = requests.select("request_id", "price_min", "price_max", "in_stock_only")
    c = catalogue.select("item_id", F.col("price").alias("_price"), F.col("is_in_stock").alias("_stock"))
    j = out.join(r, "request_id").join(c, "item_id", "left")
    ok = ((F.col("price_min").isNull() | (F.col("_price") >= F.col("price_min"))) & (F.col("price_max").isNull() | (F.col("_price") <= F.col("price_max")))
          & (~F.coalesce("in_stock_only", F.lit(False)) | F.coalesce("_stock", F.lit(False))))
    return j.filter(ok).select(*out.columns)


def _need(times: int = 1) -> Column:
    """Most candidates a request can use up: its limit, and its own exclusions."""
    return F.col("limit") * times + F.coalesce(F.size("exclude_product_ids"), F.lit(0)) + F.coalesce(F.size("cart_product_ids"), F.lit(0)) + F.lit(1)


#: Price blocks: 4**level cents wide, up to 4**15 cents; dearer items count as that dear. Level -1 holds all items.
LEVELS, TOP_CENTS = 16, 4**15 - 1


def postings(popular: DataFrame, catalogue: DataFrame | None, deepest: int, wanted: DataFrame | None = None) -> DataFrame:
    """Head of every posting list (or of those ``wanted``): merchant, scope (any, stock), level, block of prices, position, item, score.

    An item stands in the block of its price on each of 16 levels, and in the list of all items. Any range of prices is a
    union of a few whole blocks, so the best of a range are among the heads of its blocks; no list is
    read beyond ``deepest`` entries. Prices are whole cents.
    """
    items = popular.select("merchant_id", "item_id", "score")
    if catalogue is not None:
        items = items.join(catalogue.select("item_id", F.col("price").alias("_price"), F.col("is_in_stock").alias("_stock")), "item_id", "left")
    else:
        items = items.withColumns({"_price": F.lit(None).cast("double"), "_stock": F.lit(None).cast("boolean")})
    cents = F.least(F.round(F.col("_price") * 100).cast("bigint"), F.lit(TOP_CENTS).cast("bigint"))
    places = F.array(F.struct(F.lit(-1).alias("level"), F.lit(0).cast("bigint").alias("block")), *[F.struct(F.lit(k).alias("level"), F.floor(F.col("_cents") / 4**k).alias("block")) for k in range(LEVELS)])
    scopes = F.when(F.coalesce("_stock", F.lit(False)), F.array(F.lit("any"), F.lit("stock"))).otherwise(F.array(F.lit("any")))
    listed = items.withColumn("_cents", cents).select("merchant_id", "item_id", "score", F.explode(scopes).alias("scope"), "_cents").select(
        "merchant_id", "item_id", "score", "scope", F.inline(places)).filter("block IS NOT NULL")
    if wanted is not None:
        listed = listed.join(wanted.select("merchant_id", "scope", "level", "block").distinct(), ["merchant_id", "scope", "level", "block"], "left_semi")
    return top_k(listed, ["merchant_id", "scope", "level", "block"], [F.desc("score"), F.asc("item_id")], deepest, "_pos")


def price_blocks(ranges: DataFrame, low: str, high: str) -> DataFrame:
    """Rows with level and block of the whole blocks that make up their prices from ``low`` to ``high``: six to a level at most.

    A block is taken where the next larger block around it does not lie in the range as well. Open ends are null.
    """
    top, level = F.lit(TOP_CENTS).cast("bigint"), F.col("level")
    # A dearer lower limit meets what counts as that dear.
    lo = F.least(F.greatest(F.coalesce(F.ceil(F.round(F.col(low) * 100, 4)), F.lit(0)), F.lit(0)).cast("bigint"), top)
    hi = F.least(F.coalesce(F.floor(F.round(F.col(high) * 100, 4)), top), top).cast("bigint")
    width = F.pow(F.lit(4.0), level)
    first = lambda w: F.ceil(F.col("_lo") / w).cast("bigint")
    last = lambda w: (F.floor((F.col("_hi") + 1) / w) - 1).cast("bigint")
    run = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    rows = ranges.withColumns({"_lo": lo, "_hi": hi}).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    rows = rows.withColumns({"_a": first(width), "_b": last(width), "_up_a": first(width * 4), "_up_b": last(width * 4)})
    rows = rows.withColumn("_covered", (level < LEVELS - 1) & (F.col("_up_a") <= F.col("_up_b")))
    before = F.when(F.col("_covered"), F.least("_b", F.col("_up_a") * 4 - 1)).otherwise(F.col("_b"))
    after = F.when(F.col("_covered"), F.greatest("_a", F.col("_up_b") * 4 + 4)).otherwise(F.col("_b") + 1)
    return rows.withColumn("block", F.explode(F.concat(run(F.col("_a"), before), run(after, F.col("_b"))))).select(*ranges.columns, "level", "block")


def popular_for(requests: DataFrame, popular: DataFrame, catalogue: DataFrame | None = None, deepest: int | None = None) -> DataFrame:
    """(request, item, score): popularity candidates, at most the limit plus the request's exclusions of each block of its prices.

    A request meets the heads of the posting lists that its merchant, price range and stock filter name, and nothing
    else of its merchant's list.
    """
    deepest = deepest if deepest is not None else requests.agg(F.max(_need())).first()[0] or 0
    scope = F.lit("any") if catalogue is None else F.when(F.coalesce("in_stock_only", F.lit(False)), "stock").otherwise("any")
    asked = requests.select("request_id", "merchant_id", scope.alias("scope"), _need().alias("_need"), "price_min", "price_max")
    ranged = F.lit(False) if catalogue is None else F.col("price_min").isNotNull() | F.col("price_max").isNotNull()
    whole = asked.filter(~ranged).withColumns({"level": F.lit(-1), "block": F.lit(0).cast("bigint")})
    wanted = whole.unionByName(price_blocks(asked.filter(ranged), "price_min", "price_max")).drop("price_min", "price_max")
    heads = postings(popular, catalogue, deepest, wanted)
    met = wanted.join(heads, ["merchant_id", "scope", "level", "block"]).filter(F.col("_pos") <= F.col("_need"))
    return met.select("request_id", "item_id", "score")


def _served(candidates: DataFrame, plan: DataFrame, catalogue: DataFrame | None, widest: int, model_version: str) -> DataFrame:
    """Filters, and the best ``limit`` candidates of each request."""
    kept = filtered(candidates, plan, catalogue)
    # The widest limit is a constant, so the cap is applied before the shuffle as well.
    ranked = top_k(kept, ["request_id"], [F.desc("score"), F.asc("item_id")], widest)
    return ranked.join(plan.select("request_id", "placement", "strategy", F.col("limit").alias("_limit")), "request_id").filter(
        F.col("rank") <= F.col("_limit")).drop("_limit").withColumn("model_version", F.lit(model_version))


def batch(requests: DataFrame, collaborative: DataFrame, content: DataFrame, popular: DataFrame, counts: DataFrame,
          catalogue: DataFrame | None = None, model_version: str = "v1", minimum: int = MIN_SERVE) -> DataFrame:
    """Recommendations of a request table in one job, from given lists.

    ``collaborative`` is (user, item, score), ``content`` (source product, item,
    score), ``popular`` (merchant, item, score), ``counts`` (user, interactions).
    """
    widest = requests.agg(F.max("limit").alias("limit"), F.max(_need()).alias("need")).first()
    plan = with_fallback(requests.withColumn("strategy", strategy()), counts, minimum)
    of = lambda *names: plan.filter(F.col("strategy").isin(*names))
    by_user = lambda r: r.select("request_id", "user_id").join(collaborative, "user_id").select("request_id", "item_id", "score")
    by_item = lambda r: r.select("request_id", F.col("source_product_id")).join(content, "source_product_id").select("request_id", "item_id", "score")
    candidates = by_user(of("collaborative")).unionByName(by_item(of("content_based"))).unionByName(
        blend(by_user(of("hybrid")), by_item(of("hybrid")))).unionByName(popular_for(of("popularity"), popular, catalogue, widest["need"] or 0))
    return _served(candidates, plan, catalogue, widest["limit"] or 0, model_version)


def _under_filters(score):
    """A cell's scores without the pairs that the request's price range or stock filter rules out."""
    def masked(left, right):
        out = score(left, right)
        price = right["price"].to_numpy(dtype=float)[None, :]
        low, high = (left[c].to_numpy(dtype=float)[:, None] for c in ("price_min", "price_max"))
        with np.errstate(invalid="ignore"):
            out[((low == low) & ~(price >= low)) | ((high == high) & ~(price <= high))] = -np.inf
        asked = left["stock"].notna().to_numpy()[:, None]
        out[asked & (right["stock"].to_numpy()[None, :] != "yes")] = -np.inf
        return out
    return masked


def model_lists(plan: DataFrame, factors: Factors, items: DataFrame, catalogue: DataFrame, **search) -> tuple[DataFrame, DataFrame]:
    """Collaborative and content candidates (request, item, score) of every request that can have them.

    Each request is a source of its own in an exact search under its own price range and stock filter: by inner
    product with the fitted factors of its user, and by content similarity to its source product. It is asked for its
    limit and exclusions, twice the limit where two lists are blended, so no more candidates are made than can be
    used. An unknown user or source product has no list. ``items``: item_id, category, brand, price, embedding.
    """
    from .neighbours import Bounds, nearest
    from .similarity import content_score, dot_score, price_stats, with_price_z
    stock = lambda c: F.when(F.coalesce(c, F.lit(False)), F.lit("yes"))
    asked = plan.select("request_id", "user_id", "source_product_id", F.col("price_min").cast("double").alias("price_min"), F.col("price_max").cast("double").alias("price_max"),
                        stock(F.col("in_stock_only")).alias("stock"), "strategy", _need(2).cast("int").alias("need"))
    shop = catalogue.select("item_id", F.col("price").cast("double").alias("price"), F.coalesce(stock(F.col("is_in_stock")), F.lit("no")).alias("stock"))
    limits = {"must": ("stock",), "between": ("price", "price_min", "price_max"), "strict": True}
    users = factors.userFactors.select(F.col("id").alias("user_id"), F.col("features").alias("source_vector"))
    known = factors.itemFactors.select(F.col("id").alias("item_id"), F.col("features").alias("vector")).join(shop, "item_id", "left")
    sources = asked.filter(F.col("strategy").isin("collaborative", "hybrid")).join(users, "user_id").drop("user_id", "source_product_id", "strategy")
    collaborative = nearest(sources, known, _under_filters(dot_score()), Bounds("vector", "source_vector", unit=False, **limits), 0, "request_id", **search)
    ready = with_price_z(items, price_stats(items)).select("item_id", "category", "brand", "price_z", "embedding")
    like = asked.filter(F.col("strategy").isin("content_based", "hybrid")).join(ready.withColumnRenamed("item_id", "source_id"), F.col("source_product_id") == F.col("source_id"))
    weights = (0.5, 0.2, 0.15, 0.15)
    bounds = Bounds(weight=weights[0], same=(("category", weights[1]), ("brand", weights[2])), near=("price_z", weights[3]), **limits)
    content = nearest(like.drop("user_id", "source_product_id", "strategy"), ready.join(shop, "item_id", "left"), _under_filters(content_score(weights)), bounds, 0, "request_id", **search)
    return collaborative.drop("rank"), content.drop("rank")


def batch_from_models(requests: DataFrame, factors: Factors, items: DataFrame, popular: DataFrame, counts: DataFrame, catalogue: DataFrame,
                      model_version: str = "v1", minimum: int = MIN_SERVE, **search) -> DataFrame:
    """Recommendations of a request table made from the models: fitted factors, content similarity, popularity.

    As ``batch``, but the lists are searched for each request (``model_lists``). A hybrid request blends lists of twice its
    limit plus its exclusions.
    """
    widest = requests.agg(F.max("limit").alias("limit"), F.max(_need()).alias("need")).first()
    plan = with_fallback(requests.withColumn("strategy", strategy()), counts, minimum)
    collaborative, content = model_lists(plan, factors, items, catalogue, **search)
    hybrid = plan.filter("strategy = 'hybrid'").select("request_id")
    one = lambda rows: rows.join(hybrid, "request_id", "left_anti").select("request_id", "item_id", "score")
    two = lambda rows: rows.join(hybrid, "request_id", "left_semi").select("request_id", "item_id", "score")
    popularity = popular_for(plan.filter("strategy = 'popularity'"), popular, catalogue, widest["need"] or 0)
    candidates = one(collaborative).unionByName(one(content)).unionByName(blend(two(collaborative), two(content))).unionByName(popularity)
    return _served(candidates, plan, catalogue, widest["limit"] or 0, model_version)


def ab_assignment(user: Column | str, control: str, treatment: str, split: float | None) -> Column:
    """Stable assignment by digest bucket; an unknown test (no split) is collaborative."""
    if split is None:
        return F.lit("collaborative")
    return F.when(digest_bucket(user, 100) / F.lit(100.0) < F.lit(split), treatment).otherwise(control)
