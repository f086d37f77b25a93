"""Checked queries over interactions, similarity, evaluation and serving tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import copurchase as CP
from ..operators import neighbours as NB
from ..operators import products as P
from ..operators import recommend as RC
from ..operators import similarity as SIM
from ..plans import recommendations as PR
from ..sources import entities as E
from . import sql_entities as Q
from .core import query

ASOF = "2024-01-31"

INTER = """uev AS (SELECT customer_id AS user_id, CAST(json_extract_string(properties, '$.k') AS BIGINT) AS item_id, event_type, ts, merchant_id, session_id, value FROM ev),
inter AS (SELECT user_id, item_id, sum(CASE event_type WHEN 'product_view' THEN 1.0 WHEN 'add_to_cart' THEN 3.0 ELSE 5.0 END) AS weight, count(*) AS interactions, max(ts) AS last_at
  FROM uev WHERE event_type IN ('product_view','add_to_cart','purchase') AND ts >= DATE '2024-01-31' - 90 GROUP BY 1, 2)"""


def _training_events(spark, root):
    return PR.training_events(E.raw_events(spark, root), "$.k")


def _inter(spark, root):
    return RC.interactions(_training_events(spark, root), ASOF)


@query("rc01_interactions", "user_id:i item_id:i weight:r interactions:i last_at:t", "SELECT * FROM inter", (Q.EVENTS, INTER))
def _(spark, root):
    return _inter(spark, root)


@query("rc02_time_split", "split:s n:i first_at:t last_at:t",
       """SELECT CASE WHEN d <= 20 THEN 'train' WHEN d <= 25 THEN 'validation' ELSE 'test' END AS split, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at
          FROM (SELECT *, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS d FROM uev) WHERE d BETWEEN 0 AND 29 GROUP BY 1""", (Q.EVENTS, INTER))
def _(spark, root):
    s = RC.split_by_day(_training_events(spark, root), "2024-01-01", train=20, validate=25, test=29)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query("rc03_active_users", "user_id:i item_id:i interactions:i",
       "SELECT user_id, item_id, interactions FROM inter WHERE user_id IN (SELECT user_id FROM inter GROUP BY 1 HAVING sum(interactions) >= 40)", (Q.EVENTS, INTER))
def _(spark, root):
    return RC.active_users(_inter(spark, root), 40)


NEGATIVE = f"""numbered AS (SELECT item_id, row_number() OVER (ORDER BY b, item_id) - 1 AS item_no FROM (SELECT item_id, {Q.digest_bucket("CAST(item_id AS VARCHAR)", 4096)} AS b FROM (SELECT DISTINCT product_id AS item_id FROM products))),
own AS (SELECT user_id, item_id, item_no FROM inter JOIN numbered USING (item_id)),
liked AS (SELECT user_id, (SELECT count(*) FROM numbered) - count(*) AS free FROM own GROUP BY 1),
spot AS (SELECT user_id, item_id AS positive_id, ({Q.digest_bucket("user_id || '|' || item_id || '|42'", "free")} + k) % free AS place FROM own JOIN liked USING (user_id), (SELECT unnest(range(4)) AS k) WHERE k < free),
free_items AS (SELECT u.user_id, n.item_id, row_number() OVER (PARTITION BY u.user_id ORDER BY n.item_no) - 1 AS place
  FROM liked u CROSS JOIN numbered n WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.user_id = u.user_id AND o.item_id = n.item_id))"""


@query("rc04_negative_samples", "user_id:i positive_id:i item_id:i",
       "SELECT user_id, positive_id, item_id FROM spot JOIN free_items USING (user_id, place)", (Q.EVENTS, INTER, Q.PRODUCTS, NEGATIVE))
def _(spark, root):
    catalogue = E.products(spark, root).select(F.col("product_id").alias("item_id"))
    return RC.negatives(_inter(spark, root).select("user_id", "item_id"), catalogue)


@query("rc27_interaction_statistics", "users:i items:i pairs:i interactions:i density:r",
       """SELECT *, CAST(pairs AS DOUBLE) / (users * items) AS density FROM (SELECT count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items, count(*) AS pairs,
          sum(interactions) AS interactions FROM inter)""", (Q.EVENTS, INTER))
def _(spark, root):
    return RC.statistics(_inter(spark, root))


def _model(spark, root, **fit):
    return RC.fit_factors(_inter(spark, root), **fit)


@query("rc05_factor_model", "item_id:i dims:i has_length:b", "SELECT DISTINCT item_id, 64 AS dims, true AS has_length FROM inter", (Q.EVENTS, INTER))
def _(spark, root):
    f = _model(spark, root).itemFactors
    return f.select(F.col("id").alias("item_id"), F.size("features").alias("dims"), F.exists("features", lambda x: x != 0).alias("has_length"))


def _known_factors(spark, root):
    """Factor tables whose values SQL can see too: the vectors of ``embeddings``, for users and items alike."""
    return E.table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))


DOTS = """dots AS (SELECT u.vec_id AS user_id, i.vec_id AS item_id, list_inner_product(u.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS score FROM embeddings u CROSS JOIN embeddings i),
top AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM dots
  WHERE user_id IN (SELECT c_custkey FROM customer) AND (user_id, item_id) NOT IN (SELECT (user_id, item_id) FROM inter WHERE weight >= 5))"""


@query("rc06_pair_scores", "user_id:i item_id:i score:r4",
       "SELECT user_id, item_id, coalesce(score, 0.0) AS score FROM inter LEFT JOIN dots USING (user_id, item_id)", (Q.EVENTS, INTER, DOTS))
def _(spark, root):
    f = _known_factors(spark, root)
    return RC.score_pairs(_inter(spark, root).select("user_id", "item_id"), f, f)


@query("tk01_top_items_per_user", "user_id:i item_id:i rank:i", "SELECT user_id, item_id, rank FROM top WHERE rank <= 10", (Q.EVENTS, INTER, DOTS))
@query("rc07_model_recommendations", "user_id:i item_id:i rank:i score:r4", "SELECT * FROM top WHERE rank <= 10", (Q.EVENTS, INTER, DOTS))
@query("jn18_excluding_seen_items", "user_id:i item_id:i rank:i", "SELECT user_id, item_id, rank FROM top WHERE rank <= 10", (Q.EVENTS, INTER, DOTS))
def _(spark, root):
    f, seen = _known_factors(spark, root), _inter(spark, root).filter("weight >= 5").select("user_id", "item_id")
    return RC.recommend(f, f, E.customers(spark, root).select(F.col("customer_id").alias("user_id")), 10, seen)


@query("rc06_fitted_pair_scores", "user_id:i item_id:i score:r4")
def _(spark, root):
    """Scores of the fitted model for every observed pair."""
    m = _model(spark, root, rank=16, iterations=5)
    return RC.score_pairs(_inter(spark, root).select("user_id", "item_id"), m.userFactors, m.itemFactors)


@query("rc07_fitted_recommendations", "user_id:i item_id:i rank:i score:r4")
def _(spark, root):
    """Best ten unseen items of the fitted model for all customers with interactions."""
    m, seen = _model(spark, root, rank=16, iterations=5), _inter(spark, root).filter("weight >= 5").select("user_id", "item_id")
    return RC.recommend(m.userFactors, m.itemFactors, E.customers(spark, root).select(F.col("customer_id").alias("user_id")), 10, seen)


@query("rc08_fitted_similar_items", "source_id:i item_id:i score:r4 rank:i")
def _(spark, root):
    """Nearest items by the cosine of their fitted factors."""
    v = RC.embeddings(_model(spark, root, rank=16, iterations=5).itemFactors)
    return NB.nearest(v.withColumnRenamed("item_id", "source_id"), v, SIM.cosine_score(), NB.Bounds(), 10)


@query("rc08_similar_by_factors", "source_id:i item_id:i score:r4 rank:i",
       """SELECT * FROM (SELECT a.vec_id AS source_id, b.vec_id AS item_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score,
            row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rank
          FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 10""")
def _(spark, root):
    v = RC.embeddings(_known_factors(spark, root))
    return NB.nearest(v.withColumnRenamed("item_id", "source_id"), v, SIM.cosine_score(), NB.Bounds(), 10)


@query("jb17_training_invariants", "users:i in_bounds:b gate_agrees:b",
       """SELECT count(*) AS users, true AS in_bounds, true AS gate_agrees FROM (SELECT DISTINCT user_id FROM uev WHERE date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) BETWEEN 26 AND 30 AND item_id IS NOT NULL
            AND user_id IN (SELECT user_id FROM uev WHERE date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) BETWEEN 0 AND 20 AND item_id IS NOT NULL
              AND event_type IN ('product_view','add_to_cart','purchase') GROUP BY 1 HAVING count(*) >= 5))""", (Q.EVENTS, INTER))
def _(spark, root):
    m = PR.train(_training_events(spark, root), "2024-01-01", ASOF, train_days=20, validate_days=25, test_days=30, rank=16, iterations=5).metrics
    rates = [c for c in m.columns if c == "mrr" or c == "coverage" or "_at_" in c]
    inside = F.lit(True)
    for c in rates:
        inside = inside & F.col(c).between(0.0, 1.0)
    return m.select("users", inside.alias("in_bounds"), (F.col("deploy") == (F.col("hr_at_10") >= 0.1)).alias("gate_agrees"))


@query("jb17_train_and_evaluate", "users:i hr_at_10:r4 ndcg_at_10:r4 mrr:r4 coverage:r4 deploy:b")
def _(spark, root):
    return PR.train(_training_events(spark, root), "2024-01-01", ASOF, train_days=20, validate_days=25, test_days=30, rank=16, iterations=5).metrics


# ------------------------------------------------------------------ content similarity

CONTENT = """content AS (SELECT vec_id AS item_id, CAST(label AS VARCHAR) AS category, p_brand AS brand, p_retailprice AS price, embedding::DOUBLE[] AS embedding
  FROM embeddings JOIN part ON vec_id = p_partkey),
stats AS (SELECT avg(price) AS m, stddev_pop(price) AS s FROM content WHERE price > 0),
z AS (SELECT c.*, (price - m) / s AS z FROM content c CROSS JOIN stats)"""


def _content(spark, root):
    p = E.products(spark, root).select(F.col("product_id").alias("vec_id"), "brand", "price")
    return E.table(spark, root, "embeddings").join(p, "vec_id").select(
        F.col("vec_id").alias("item_id"), F.col("label").cast("string").alias("category"), "brand", F.col("price").cast("double").alias("price"), "embedding")


_PAIR = """SELECT a.item_id AS source_id, b.item_id, 0.5 * list_cosine_similarity(a.embedding, b.embedding) + CASE WHEN a.category = b.category THEN 0.2 ELSE 0 END
  + CASE WHEN a.brand = b.brand THEN 0.15 ELSE 0 END + 0.15 * exp(-power(a.z - b.z, 2) / 2) AS score FROM z a JOIN z b ON a.item_id <> b.item_id"""


@query("rc12_content_neighbours", "source_id:i item_id:i score:r6 rank:i",
       f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, item_id) AS rank FROM ({_PAIR})) WHERE rank <= 10", (CONTENT,))
@query("tk02_similar_items", "source_id:i item_id:i rank:i",
       f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, item_id) AS rank FROM ({_PAIR})) WHERE rank <= 10", (CONTENT,))
def _(spark, root):
    c = _content(spark, root)
    return SIM.similar_content(c.select(F.col("item_id").alias("source_id")), c, 10)


@query("rc13_vector_search", "query_id:i item_id:i score:r6 rank:i",
       """SELECT * FROM (SELECT q.item_id AS query_id, c.item_id, list_cosine_similarity(q.embedding, c.embedding) AS score,
            row_number() OVER (PARTITION BY q.item_id ORDER BY list_cosine_similarity(q.embedding, c.embedding) DESC, c.item_id) AS rank
          FROM content q JOIN content c ON (q.item_id % 3 <> 0 OR c.category = q.category) AND (q.item_id % 2 <> 0 OR c.price BETWEEN 905 AND 935)) WHERE rank <= 5""", (CONTENT,))
def _(spark, root):
    c, k = _content(spark, root), F.col("item_id")
    q = c.select(k.alias("query_id"), "embedding", F.when(k % 3 == 0, F.col("category")).alias("category"), F.lit("no such brand").alias("brand"),
                 F.when(k % 2 == 0, F.lit(905.0)).alias("price_min"), F.when(k % 2 == 0, F.lit(935.0)).alias("price_max"))
    return SIM.search(q, c, 5)


@query("rc14_added_items", "source_id:i item_id:i score:r6 rank:i",
       f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, item_id) AS rank FROM ({_PAIR})) WHERE rank <= 3""",
       (CONTENT.replace("FROM content WHERE price > 0", "FROM content WHERE price > 0 AND item_id % 10 <> 0"),))
def _(spark, root):
    from ..sources.warehouse import merge_rows
    c = _content(spark, root)
    old, new = c.filter("item_id % 10 <> 0"), c.filter("item_id % 10 = 0")
    grown = merge_rows(old, new, ["item_id"], ["item_id"])
    return SIM.similar_content(grown.select(F.col("item_id").alias("source_id")), grown, 3, stats=SIM.price_stats(old))


@query("rc26_fused_embeddings", "item_id:i dims:i length:r6", "SELECT vec_id AS item_id, 128 AS dims, sqrt(2.0) AS length FROM embeddings")
def _(spark, root):
    from ..functions.vectors import norm
    t = E.table(spark, root, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    image = t.select("item_id", F.reverse("embedding").alias("embedding"))
    return RC.fuse(t, image).select("item_id", F.size("embedding").alias("dims"), norm("embedding").alias("length"))


# ------------------------------------------------------------------ co-purchases

PAIRS = """bsk AS (SELECT DISTINCT l_orderkey AS order_id, l_partkey AS item_id FROM lineitem),
freq AS (SELECT item_id, count(*) AS f FROM bsk GROUP BY 1),
pairs AS (SELECT a.item_id, b.item_id AS other_id, count(*) AS together FROM bsk a JOIN bsk b ON a.order_id = b.order_id AND a.item_id <> b.item_id GROUP BY 1, 2)"""


def _baskets(spark, root):
    return E.raw_items(spark, root).select("order_id", F.col("product_id").alias("item_id"))


@query("rc22_item_item_model", "item_id:i other_id:i together:i score:r6 rank:i",
       """SELECT * FROM (SELECT p.item_id, other_id, together, together / sqrt(CAST(a.f AS DOUBLE) * b.f) AS score,
            row_number() OVER (PARTITION BY p.item_id ORDER BY together / sqrt(CAST(a.f AS DOUBLE) * b.f) DESC, other_id) AS rank
          FROM pairs p JOIN freq a ON p.item_id = a.item_id JOIN freq b ON other_id = b.item_id) WHERE rank <= 10""", (PAIRS,))
def _(spark, root):
    b = _baskets(spark, root)
    return CP.item_item(b, b, 10)


@query("rc22_wide_baskets", "item_id:i other_id:i together:i score:r6 rank:i",
       """SELECT * FROM (SELECT p.item_id, other_id, together, together / sqrt(CAST(a.f AS DOUBLE) * b.f) AS score,
            row_number() OVER (PARTITION BY p.item_id ORDER BY together / sqrt(CAST(a.f AS DOUBLE) * b.f) DESC, other_id) AS rank
          FROM (SELECT a.item_id, b.item_id AS other_id, count(*) AS together FROM wide a JOIN wide b ON a.order_id = b.order_id AND a.item_id <> b.item_id GROUP BY 1, 2) p
            JOIN (SELECT item_id, count(*) AS f FROM wide GROUP BY 1) a ON p.item_id = a.item_id JOIN (SELECT item_id, count(*) AS f FROM wide GROUP BY 1) b ON other_id = b.item_id) WHERE rank <= 10""",
       ("""wide AS (SELECT DISTINCT CASE WHEN l_orderkey % 10 < 3 THEN l_orderkey % 10 ELSE l_orderkey + 10 END AS order_id, l_partkey AS item_id FROM lineitem)""",))
def _(spark, root):
    """As rc22, where three orders hold three tenths of all lines."""
    o = F.col("order_id")
    b = _baskets(spark, root).select(F.when(o % 10 < 3, o % 10).otherwise(o + 10).alias("order_id"), "item_id")
    return CP.item_item(b, b, 10)


CARTS = """carts AS (SELECT DISTINCT customer_id AS cart_id, product_id AS item_id FROM items JOIN (
  SELECT customer_id AS c, max(order_id) AS o FROM ord GROUP BY 1) ON order_id = o)"""


@query("rc21_cart_completion", "cart_id:i candidate_id:i together:i rank:i",
       """SELECT * FROM (SELECT cart_id, other_id AS candidate_id, sum(together) AS together, row_number() OVER (PARTITION BY cart_id ORDER BY sum(together) DESC, other_id) AS rank
          FROM carts JOIN pairs USING (item_id) WHERE (cart_id, other_id) NOT IN (SELECT (cart_id, item_id) FROM carts) GROUP BY 1, 2) WHERE rank <= 5""", (Q.ITEMS, PAIRS, CARTS))
def _(spark, root):
    last = E.raw_orders(spark, root).groupBy("customer_id").agg(F.max("order_id").alias("order_id"))
    carts = _baskets(spark, root).join(last, "order_id").select(F.col("customer_id").alias("cart_id"), "item_id")
    return SIM.complete_carts(carts, _baskets(spark, root), 5)


# ------------------------------------------------------------------ serving

REQ = """req AS (SELECT c_custkey AS request_id, c_nationkey AS merchant_id, list_extract(['homepage','pdp','cart','category'], c_custkey % 4 + 1) AS placement,
    CASE WHEN c_custkey % 5 <> 0 THEN c_custkey END AS user_id, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey * 17 % n_items + 1 END AS source_product_id,
    CASE WHEN c_custkey % 4 = 2 THEN [c_custkey * 7 % n_items + 1, c_custkey * 13 % n_items + 1] END AS cart, [c_custkey * 3 % n_items + 1, c_custkey * 11 % n_items + 1] AS excl,
    5 + c_custkey % 6 AS lim, CASE WHEN c_custkey % 11 = 0 THEN 902.0 END AS price_min, CASE WHEN c_custkey % 11 = 0 THEN 907.5 END AS price_max, c_custkey % 13 = 0 AS in_stock_only FROM customer, (SELECT max(p_partkey) AS n_items FROM part)),
cnt AS (SELECT user_id, sum(interactions) AS n FROM inter GROUP BY 1),
strat0 AS (SELECT *, CASE WHEN placement = 'homepage' THEN CASE WHEN user_id IS NOT NULL THEN 'collaborative' ELSE 'popularity' END
    WHEN placement = 'pdp' AND source_product_id IS NOT NULL THEN CASE WHEN user_id IS NOT NULL THEN 'hybrid' ELSE 'content_based' END
    WHEN placement = 'cart' AND (user_id IS NOT NULL OR len(cart) > 0) THEN 'collaborative' ELSE 'popularity' END AS strategy FROM req),
strat AS (SELECT s.* EXCLUDE (strategy), s.strategy AS first_strategy, CASE WHEN coalesce(n, 0) < 40 AND s.strategy = 'collaborative' THEN 'popularity'
    WHEN coalesce(n, 0) < 40 AND s.strategy = 'hybrid' THEN 'content_based' ELSE s.strategy END AS strategy FROM strat0 s LEFT JOIN cnt USING (user_id))"""


def _requests(spark, root):
    k, items = F.col("customer_id"), E.products(spark, root).agg(F.max("product_id")).first()[0]
    big = lambda *c: F.array(*[x.cast("bigint") for x in c])
    return E.customers(spark, root).select(
        k.alias("request_id"), "merchant_id", F.element_at(F.array(*[F.lit(x) for x in ("homepage", "pdp", "cart", "category")]), (k % 4 + 1).cast("int")).alias("placement"),
        F.when(k % 5 != 0, k).alias("user_id"), F.when(k % 3 != 0, k * 17 % items + 1).alias("source_product_id"),
        F.when(k % 4 == 2, big(k * 7 % items + 1, k * 13 % items + 1)).alias("cart_product_ids"), big(k * 3 % items + 1, k * 11 % items + 1).alias("exclude_product_ids"),
        (k % 6 + 5).cast("int").alias("limit"), F.when(k % 11 == 0, F.lit(902.0)).alias("price_min"), F.when(k % 11 == 0, F.lit(907.5)).alias("price_max"),
        (k % 13 == 0).alias("in_stock_only"))


@query("rc16_strategy", "request_id:i strategy:s", "SELECT request_id, strategy FROM strat0", (Q.EVENTS, INTER, REQ))
def _(spark, root):
    return _requests(spark, root).withColumn("strategy", RC.strategy())


def _counts(spark, root):
    return _inter(spark, root).groupBy("user_id").agg(F.sum("interactions").alias("interactions"))


@query("rc17_fallback", "request_id:i strategy:s", "SELECT request_id, strategy FROM strat", (Q.EVENTS, INTER, REQ))
def _(spark, root):
    return RC.with_fallback(_requests(spark, root).withColumn("strategy", RC.strategy()), _counts(spark, root), 40)


LISTS = """coll AS (SELECT user_id, item_id, CAST(weight AS DOUBLE) / 100 AS score FROM inter),
sbsk AS (SELECT DISTINCT session_id AS order_id, item_id FROM uev),
cpairs AS (SELECT a.item_id AS source_product_id, b.item_id, CAST(count(*) AS DOUBLE) / 100 AS score FROM sbsk a JOIN sbsk b ON a.order_id = b.order_id AND a.item_id <> b.item_id GROUP BY 1, 2),
popl AS (SELECT merchant_id, item_id, CAST(count(*) AS DOUBLE) AS score FROM uev GROUP BY 1, 2),
hyb AS (SELECT request_id, item_id, 0.7 * coalesce(a.score, 0) + 0.3 * coalesce(b.score, 0) AS score
  FROM (SELECT request_id, item_id, score FROM strat JOIN coll USING (user_id) WHERE strategy = 'hybrid') a
  FULL JOIN (SELECT request_id, item_id, score FROM strat JOIN cpairs USING (source_product_id) WHERE strategy = 'hybrid') b USING (request_id, item_id)),
cand AS (SELECT request_id, item_id, score FROM strat JOIN coll USING (user_id) WHERE strategy = 'collaborative'
  UNION ALL SELECT request_id, item_id, score FROM strat JOIN cpairs USING (source_product_id) WHERE strategy = 'content_based'
  UNION ALL SELECT * FROM hyb UNION ALL SELECT request_id, item_id, score FROM strat JOIN popl USING (merchant_id) WHERE strategy = 'popularity'),
kept AS (SELECT c.*, s.placement, s.strategy, s.lim FROM cand c JOIN strat s USING (request_id) LEFT JOIN products p ON item_id = product_id
  WHERE NOT list_contains(excl, item_id) AND NOT coalesce(list_contains(cart, item_id), false) AND NOT coalesce(item_id = source_product_id, false)
    AND (price_min IS NULL OR p.price >= price_min) AND (price_max IS NULL OR p.price <= price_max)
    AND (NOT in_stock_only OR p.inventory_policy = 'continue' OR coalesce(p.inventory_quantity > 0, false))),
served AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, item_id) AS rank FROM kept) WHERE rank <= lim)"""
SERVE = (Q.EVENTS, INTER, REQ, Q.PRODUCTS, LISTS)


def _lists(spark, root):
    coll = _inter(spark, root).select("user_id", "item_id", (F.col("weight") / 100).alias("score"))
    e = E.events(spark, root).withColumn("item_id", F.get_json_object("properties", "$.k").try_cast("bigint"))
    baskets = e.select(F.col("session_id").alias("order_id"), "item_id")
    content = SIM.bought_together(baskets, baskets).select(F.col("item_id").alias("source_product_id"), F.col("other_id").alias("item_id"), (F.col("together") / 100).alias("score"))
    popular = e.groupBy("merchant_id", "item_id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return coll, content, popular


def _catalogue(spark, root):
    return E.products(spark, root).withColumns(P.stock_columns()).select(F.col("product_id").alias("item_id"), F.col("price").cast("double").alias("price"), "is_in_stock")


@query("jb18_batch_recommendations", "request_id:i item_id:i score:r6 rank:i placement:s strategy:s", "SELECT * FROM served", SERVE)
@query("rc20_request_table", "request_id:i item_id:i rank:i strategy:s", "SELECT * FROM served", SERVE)
@query("tk07_ranked_by_score", "request_id:i item_id:i score:r6 rank:i", "SELECT * FROM served", SERVE)
def _(spark, root):
    coll, content, popular = _lists(spark, root)
    return RC.batch(_requests(spark, root), coll, content, popular, _counts(spark, root), _catalogue(spark, root), minimum=40)


@query("jb18_model_recommendations", "request_id:i item_id:i score:r6 rank:i placement:s strategy:s")
def _(spark, root):
    """Requests served from the fitted factors, content similarity and popularity."""
    popular = _lists(spark, root)[2]
    return RC.batch_from_models(_requests(spark, root), _model(spark, root, rank=16, iterations=5), _content(spark, root), popular, _counts(spark, root), _catalogue(spark, root), minimum=40)


@query("rc18_hybrid_blend", "request_id:i item_id:i score:r6", "SELECT * FROM hyb", SERVE)
@query("jn19_hybrid_full_outer", "request_id:i item_id:i score:r6", "SELECT * FROM hyb", SERVE)
def _(spark, root):
    coll, content, _ = _lists(spark, root)
    plan = RC.with_fallback(_requests(spark, root).withColumn("strategy", RC.strategy()), _counts(spark, root), 40).filter("strategy = 'hybrid'")
    return RC.blend(plan.join(coll, "user_id"), plan.join(content, "source_product_id"))


@query("rc19_filtered_candidates", "request_id:i item_id:i score:r6",
       "SELECT k.request_id, k.item_id, k.score FROM kept k WHERE strategy = 'popularity'", SERVE)
@query("so02_exclusion_difference", "request_id:i item_id:i", "SELECT k.request_id, k.item_id FROM kept k WHERE strategy = 'popularity'", SERVE)
def _(spark, root):
    _, _, popular = _lists(spark, root)
    plan = RC.with_fallback(_requests(spark, root).withColumn("strategy", RC.strategy()), _counts(spark, root), 40).filter("strategy = 'popularity'")
    cand = plan.select("request_id", "merchant_id").join(popular, "merchant_id").select("request_id", "item_id", "score")
    return RC.filtered(cand, plan, _catalogue(spark, root))


RANKED = """act AS (SELECT DISTINCT user_id, item_id FROM uev WHERE event_type = 'purchase'),
rkd AS (SELECT user_id, item_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, item_id) AS rank FROM inter) WHERE rank <= 20),
rel AS (SELECT user_id, count(*) AS rel FROM act GROUP BY 1),
hit AS (SELECT user_id, rank FROM rkd JOIN act USING (user_id, item_id))"""


def _ranked(spark, root):
    from ..operators.scale import top_k
    inter = _inter(spark, root)
    actual = _training_events(spark, root).filter("event_type = 'purchase'").select("user_id", "item_id")
    return top_k(inter, ["user_id"], [F.desc("weight"), F.asc("item_id")], 20).select("user_id", "item_id", "rank"), actual


_IDEAL = lambda k: f"(SELECT sum(1.0 / log2(r + 1.0)) FROM generate_series(1, {k}) AS g(r) WHERE r <= rel)"


@query("rc10_ranking_metrics", "users:i mrr:r6 hr_at_5:r6 hr_at_10:r6 hr_at_20:r6 ndcg_at_5:r6 ndcg_at_10:r6 ndcg_at_20:r6 coverage:r6",
       "SELECT count(*) AS users, avg(coalesce(1.0 / first, 0)) AS mrr, " + ", ".join(
           f"avg(coalesce(h{k}, 0)) AS hr_at_{k}, avg(coalesce(d{k}, 0) / {_IDEAL(k)}) AS ndcg_at_{k}" for k in (5, 10, 20))
       + ", (SELECT count(DISTINCT item_id) FROM rkd) / (SELECT CAST(count(*) AS DOUBLE) FROM part) AS coverage FROM rel LEFT JOIN (SELECT user_id, min(rank) AS first, " + ", ".join(
           f"max(CASE WHEN rank <= {k} THEN 1.0 ELSE 0 END) AS h{k}, sum(CASE WHEN rank <= {k} THEN 1.0 / log2(rank + 1.0) END) AS d{k}" for k in (5, 10, 20))
       + " FROM hit GROUP BY 1) USING (user_id)", (Q.EVENTS, INTER, RANKED))
def _(spark, root):
    ranked, actual = _ranked(spark, root)
    return RC.evaluate(ranked, actual, E.products(spark, root).select(F.col("product_id").alias("item_id")))


@query("rc11_deployment_gate", "users:i deploy:b",
       "SELECT count(*) AS users, avg(coalesce(h, 0)) >= 0.1 AS deploy FROM rel LEFT JOIN (SELECT user_id, 1.0 AS h FROM hit WHERE rank <= 10 GROUP BY 1) USING (user_id)", (Q.EVENTS, INTER, RANKED))
def _(spark, root):
    ranked, actual = _ranked(spark, root)
    return RC.gate(RC.evaluate(ranked, actual, E.products(spark, root).select(F.col("product_id").alias("item_id"))))


@query("rc09_hit_rate", "user_id:i actual:i hits:i hit_rate:r",
       "SELECT user_id, rel AS actual, coalesce(h, 0) AS hits, CAST(coalesce(h, 0) AS DOUBLE) / rel AS hit_rate FROM rel LEFT JOIN (SELECT user_id, count(*) AS h FROM hit GROUP BY 1) USING (user_id)", (Q.EVENTS, INTER, RANKED))
@query("so01_hit_intersection", "user_id:i hits:i",
       "SELECT user_id, coalesce(h, 0) AS hits FROM rel LEFT JOIN (SELECT user_id, count(*) AS h FROM hit GROUP BY 1) USING (user_id)", (Q.EVENTS, INTER, RANKED))
def _(spark, root):
    return RC.hit_rate(*_ranked(spark, root))


@query("rc23_ab_assignment", "variant:s users:i",
       """SELECT CASE WHEN b < 10 THEN 'hybrid' ELSE 'collaborative' END AS variant, count(*) AS users FROM (
            SELECT (((w0 % 100 * 4294967296 + w1) % 100 * 4294967296 + w2) % 100 * 4294967296 + w3) % 100 AS b FROM (
              SELECT ('0x' || substring(h, 1, 8))::BIGINT AS w0, ('0x' || substring(h, 9, 8))::BIGINT AS w1, ('0x' || substring(h, 17, 8))::BIGINT AS w2, ('0x' || substring(h, 25, 8))::BIGINT AS w3
              FROM (SELECT md5(CAST(c_custkey AS VARCHAR)) AS h FROM customer))) GROUP BY 1""")
def _(spark, root):
    c = E.customers(spark, root)
    return c.groupBy(RC.ab_assignment("customer_id", "collaborative", "hybrid", 0.1).alias("variant")).agg(F.count(F.lit(1)).alias("users"))


