import numpy as np
from conftest import plan, rows
from pyspark.sql import functions as F

from bazaarlens.operators import promotions as PM
from bazaarlens.operators import recommend as RC
from bazaarlens.operators import similarity as SIM
from bazaarlens.plans import recommendations as PR


def test_block_top_n_equals_brute_force_across_blocks(spark):
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(60, 8))
    vecs[7] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "item_id long, embedding array<double>")
    got = {}
    for r in SIM.block_top_n(df.withColumnRenamed("item_id", "source_id"), df, SIM.cosine_score(), 5, block_rows=7).collect():
        got.setdefault(r.source_id, []).append((r["rank"], r.item_id, round(r.score, 9)))
    unit = vecs / np.where(np.linalg.norm(vecs, axis=1, keepdims=True) == 0, 1, np.linalg.norm(vecs, axis=1, keepdims=True))
    sim = unit @ unit.T
    for i in range(60):
        best = sorted(((-sim[i, j], j) for j in range(60) if j != i))[:5]
        assert [(x[1], x[2]) for x in sorted(got[i])] == [(j, round(-s, 9) + 0.0) for s, j in best]


def _baskets(spark):
    rng = np.random.default_rng(6)
    data = [(o, int(i)) for o in range(30) for i in rng.choice(40, size=3, replace=False)] + [(100, i) for i in range(35)] + [(101, i) for i in range(10, 40)]
    return spark.createDataFrame(data, "order_id long, item_id long"), data


def test_giant_baskets_count_like_small_ones(spark):
    b, data = _baskets(spark)
    want = {}
    for o in {d[0] for d in data}:
        held = {i for x, i in data if x == o}
        for i in held:
            for j in held - {i}:
                want[i, j] = want.get((i, j), 0) + 1
    split = {(r.item_id, r.other_id): r.together for r in SIM.bought_together(b.repartition(5), b).collect()}
    whole = {(r.item_id, r.other_id): r.together for r in SIM.bought_together(b, b).collect()}
    assert split == want and whole == want


def test_cart_completion_excludes_the_cart(spark):
    b, _ = _baskets(spark)
    carts = spark.createDataFrame([(1, 3), (1, 4), (2, 39)], "cart_id int, item_id long")
    out = SIM.complete_carts(carts, b, 5)
    assert out.join(carts.withColumnRenamed("item_id", "candidate_id"), ["cart_id", "candidate_id"]).isEmpty()
    assert out.groupBy("cart_id").count().filter("count <> 5").isEmpty()


def test_cart_completion_counts_like_brute_force_and_shuffles_no_votes(spark):
    b, data = _baskets(spark)
    orders = {}
    for o, i in data:
        orders.setdefault(o, set()).add(i)
    held = [(1, 3), (1, 4), (1, 4), (2, 39), (None, 3), (None, 5), (3, None), (4, 999), (5, 0), (5, 7), (5, 9)]
    carts = spark.createDataFrame(held, "cart_id int, item_id long")
    want = {}
    for c in {c for c, _ in held}:
        mine, votes = {i for x, i in held if x == c}, {}
        for i in mine:
            for o in orders.values():
                for j in o - {i} if i in o else ():
                    votes[j] = votes.get(j, 0) + 1
        best = sorted((-v, j) for j, v in votes.items() if c is None or j not in mine)[:5]
        want |= {(c, k): (j, -v) for k, (v, j) in enumerate(best, 1)}
    for wide in (4096, 2, 0):
        out = SIM.complete_carts(carts, b, 5, wide)
        assert {(r.cart_id, r["rank"]): (r.candidate_id, r.together) for r in out.collect()} == want
    assert not [x for x in plan(SIM.complete_carts(carts, b, 5)).splitlines() if "Exchange hashpartitioning(cart_id" in x and "candidate_id" in x]


def test_training_parses_events_once(spark):
    """Every event is read by one job; all further steps read what that job wrote."""
    rng = np.random.default_rng(8)
    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda p: read.add(1) or int(p), "long").asNondeterministic()
    data = [(int(u), str(int(i)), "purchase", int(d)) for u, i, d in zip(rng.integers(0, 12, 400), rng.integers(0, 15, 400), rng.integers(0, 30, 400))]
    raw = spark.createDataFrame(data, "user_id long, p string, event_type string, d int").repartition(3)
    events = raw.select("user_id", seen("p").alias("item_id"), "event_type", F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, d)").alias("ts"))
    m = PR.train(events, "2024-01-01", "2024-01-31", train_days=20, validate_days=25, test_days=30, rank=4, iterations=2).metrics.first()
    assert 0 < m["users"] <= 12 and 0 < read.value <= 400
    read.value = 0
    RC.fit_factors(events.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("weight")), rank=4, iterations=1).itemFactors.count()
    assert read.value == 400


def test_negatives_are_never_positives_and_repeatable(spark):
    pos = spark.createDataFrame([(u, i) for u in range(5) for i in range(u * 3, u * 3 + 4)], "user_id long, item_id long")
    catalogue = spark.range(200).withColumnRenamed("id", "item_id")
    a = rows(RC.negatives(pos, catalogue), "user_id", "positive_id", "item_id")
    assert a == rows(RC.negatives(pos.repartition(7), catalogue), "user_id", "positive_id", "item_id")
    assert len(a) == 20 * 4
    assert not {(u, i) for u, _, i in a} & {tuple(r) for r in rows(pos)}


def test_negatives_are_complete_for_users_who_like_nearly_everything(spark):
    pos = spark.createDataFrame([(1, i) for i in range(95)] + [(2, i) for i in range(98)] + [(3, i) for i in range(100)], "user_id long, item_id long")
    a = rows(RC.negatives(pos, spark.range(100).withColumnRenamed("id", "item_id")), "user_id", "positive_id", "item_id")
    by = {}
    for u, p, i in a:
        by.setdefault((u, p), set()).add(i)
    assert {len(v) for (u, _), v in by.items() if u == 1} == {4} and len([k for k in by if k[0] == 1]) == 95
    assert all(v == {98, 99} for (u, _), v in by.items() if u == 2) and not [k for k in by if k[0] == 3]


def test_item_numbers_are_dense(spark):
    nums = rows(RC.indexed(spark.range(500).withColumnRenamed("id", "item_id"), buckets=16), "item_no")
    assert sorted(n for n, in nums) == list(range(500))


def test_factor_model_invariants(spark):
    rng = np.random.default_rng(7)
    data = sorted({(int(u), int(i)) for u, i in zip(rng.integers(0, 30, 400), rng.integers(0, 25, 400))})
    ratings = spark.createDataFrame([(u, i, 1.0) for u, i in data], "user_id int, item_id int, weight double")
    model = RC.fit_factors(ratings, rank=8, iterations=3, blocks=2)
    seen = ratings.select("user_id", "item_id")
    users = spark.createDataFrame([(0,), (1,), (9999,)], "user_id int")
    out = RC.recommend(model.userFactors, model.itemFactors, users, 5, seen)
    assert out.join(seen, ["user_id", "item_id"]).isEmpty() and out.filter("user_id = 9999").isEmpty()
    for u in (0, 1):
        got = out.filter(F.col("user_id") == u).orderBy("rank").collect()
        assert [r["rank"] for r in got] == [1, 2, 3, 4, 5] and all(a.score >= b.score for a, b in zip(got, got[1:]))
    pairs = spark.createDataFrame([(0, got[0].item_id), (9999, 1)], "user_id int, item_id int")
    scores = {r.user_id: r.score for r in RC.score_pairs(pairs, model.userFactors, model.itemFactors).collect()}
    assert scores[9999] == 0.0
    assert model.itemFactors.select(F.size("features")).first()[0] == 8


def test_ranking_metrics_by_hand(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 13, 1)], "user_id int, item_id int, rank int")
    actual = spark.createDataFrame([(1, 11), (1, 12), (2, 99), (3, 10)], "user_id int, item_id int")
    m = RC.evaluate(ranked, actual, spark.range(8).withColumnRenamed("id", "item_id"), ks=(2,)).first()
    dcg = (1 / np.log2(3)) / (1 + 1 / np.log2(3))
    assert m.users == 3 and np.isclose(m.mrr, 0.5 / 3) and np.isclose(m.hr_at_2, 1 / 3) and np.isclose(m.ndcg_at_2, dcg / 3) and m.coverage == 0.5


REQUESTS = ("request_id int, merchant_id int, placement string, user_id int, source_product_id int, cart_product_ids array<bigint>, "
            "exclude_product_ids array<bigint>, limit int, price_min double, price_max double, in_stock_only boolean")


def test_strategy_table(spark):
    cases = [("homepage", 1, None, None, "collaborative"), ("homepage", None, None, None, "popularity"), ("pdp", None, 5, None, "content_based"),
             ("pdp", 1, 5, None, "hybrid"), ("pdp", 1, None, None, "popularity"), ("cart", None, None, [1], "collaborative"), ("cart", None, None, [], "popularity"),
             ("cart", 1, None, None, "collaborative"), ("email", 1, None, None, "popularity")]
    df = spark.createDataFrame([(i, 1, p, u, s, c, None, 5, None, None, None) for i, (p, u, s, c, _) in enumerate(cases)], REQUESTS)
    assert [r[0] for r in df.orderBy("request_id").select(RC.strategy()).collect()] == [c[-1] for c in cases]


def test_batch_respects_limits_exclusions_and_history(spark):
    req = spark.createDataFrame([
        (1, 1, "homepage", 1, None, None, [101], 3, None, None, None), (2, 1, "homepage", 2, None, None, None, 3, None, None, None),
        (3, 1, "cart", 1, None, [102, 103, 104], None, 2, None, None, None), (4, 1, "homepage", None, None, None, [1, 2], 4, None, None, None),
        (5, 1, "homepage", None, None, None, None, 4, 5.0, 7.0, True)], REQUESTS)
    coll = spark.createDataFrame([(1, 100 + i, 1.0 - i / 10) for i in range(6)], "user_id int, item_id long, score double")
    content = spark.createDataFrame([], "source_product_id int, item_id long, score double")
    popular = spark.createDataFrame([(1, i, 1.0 - i / 100) for i in range(20)], "merchant_id int, item_id long, score double")
    counts = spark.createDataFrame([(1, 100), (2, 99)], "user_id int, interactions int")
    catalogue = spark.createDataFrame([(i, float(i), i % 2 == 0) for i in list(range(20)) + list(range(100, 106))], "item_id long, price double, is_in_stock boolean")
    out = {}
    for r in RC.batch(req, coll, content, popular, counts, catalogue).orderBy("request_id", "rank").collect():
        out.setdefault(r.request_id, []).append((r.item_id, r.strategy))
    assert [i for i, _ in out[1]] == [100, 102, 103] and out[1][0][1] == "collaborative"
    assert [i for i, _ in out[2]] == [0, 1, 2] and out[2][0][1] == "popularity"  # 99 interactions are too few
    assert [i for i, _ in out[3]] == [100, 101]
    assert [i for i, _ in out[4]] == [0, 3, 4, 5]
    assert [i for i, _ in out[5]] == [6]


def test_blend_weights(spark):
    a = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.5)], "request_id int, item_id int, score double")
    b = spark.createDataFrame([(1, 2, 1.0), (1, 3, 1.0)], "request_id int, item_id int, score double")
    assert [(r[0], round(r[1], 6)) for r in rows(RC.blend(a, b), "item_id", "score")] == [(1, 0.7), (2, 0.65), (3, 0.3)]


def test_usage_number_across_days(spark):
    data = [(i, "p", i % 3, f"2024-01-{1 + i // 4:02d}") for i in range(12)]
    df = spark.createDataFrame(data, "order_id int, promotion_id string, customer_id int, d string").withColumns({
        "created_at": F.col("d").cast("timestamp_ntz"), "total_usage_limit": F.lit(5), "per_customer_limit": F.lit(2)})
    promotions = df.select("promotion_id", "total_usage_limit", "per_customer_limit").distinct()
    assert rows(PM.within_usage(df, promotions), "order_id", "use_number") == [(i, i + 1) for i in range(5)]
    free = df.withColumn("total_usage_limit", F.lit(None).cast("int"))
    assert rows(PM.within_usage(free, promotions), "order_id", "use_number") == [(i, None) for i in range(6)]


def test_price_blocks_are_the_range_exactly(spark):
    import random
    rnd = random.Random(3)
    ranges = [(None, 5.0), (0.0, 0.0), (0.01, 0.01), (3.0, 2.0), (7.5, None), (0.03, 4.17), (1.0, 9999999.0), (99999999.0, None)] + [tuple(sorted((rnd.randint(0, 3000) / 100, rnd.randint(0, 3000) / 100))) for _ in range(60)]
    df = spark.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(ranges)], "i int, lo double, hi double")
    got = {i: [] for i in range(len(ranges))}
    for r in RC.price_blocks(df, "lo", "hi").collect():
        got[r["i"]].append((r["level"], r["block"]))
    for i, (lo, hi) in enumerate(ranges):
        low = 0 if lo is None else min(round(lo * 100), RC.TOP_CENTS)
        high = RC.TOP_CENTS if hi is None else min(round(hi * 100), RC.TOP_CENTS)
        spans = sorted((b * 4**k, (b + 1) * 4**k - 1) for k, b in got[i])
        if low > high:
            assert not spans
            continue
        assert spans[0][0] == low and spans[-1][1] == high
        assert all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:])) and len(spans) <= 6 * RC.LEVELS


def test_posting_lists_serve_filtered_requests(spark):
    rng = np.random.default_rng(4)
    popular = [(int(m), int(i), float(s)) for m in (1, 2) for i, s in zip(range(400), rng.integers(0, 50, 400))]
    shop = [(i, None if i % 37 == 0 else float(rng.integers(0, 5000)) / 100, bool(rng.random() < 0.5)) for i in range(390)]
    asks = [(r, 1 + r % 2, "email", None, None, None, [int(x) for x in rng.integers(0, 400, 3)], 1 + r % 7, None if r % 3 == 0 else float(rng.integers(0, 4000)) / 100,
             None if r % 4 == 0 else float(rng.integers(1000, 5000)) / 100, r % 5 == 0) for r in range(80)]
    requests = spark.createDataFrame(asks, REQUESTS)
    lists = spark.createDataFrame(popular, "merchant_id int, item_id long, score double")
    catalogue = spark.createDataFrame(shop, "item_id long, price double, is_in_stock boolean")
    found = RC.popular_for(requests, lists, catalogue)
    most = {r[0]: r[7] + len(r[6]) + 1 for r in asks}
    assert max(n for n in (x["count"] for x in found.groupBy("request_id").count().collect())) <= max(most.values()) * 6 * RC.LEVELS
    empty = spark.createDataFrame([], "user_id int, item_id long, score double")
    out = RC.batch(requests, empty, empty.withColumnRenamed("user_id", "source_product_id"), lists, spark.createDataFrame([], "user_id int, interactions int"), catalogue)
    got = {}
    for r in out.collect():
        got.setdefault(r.request_id, []).append((r["rank"], r.item_id, r.score))
    price, stock = {i: p for i, p, _ in shop}, {i: s for i, _, s in shop}
    for r, m, _, _, _, _, excluded, limit, low, high, only in asks:
        fits = [(-s, i) for x, i, s in popular if x == m and i not in excluded and (low is None or (price.get(i) is not None and price[i] >= low))
                and (high is None or (price.get(i) is not None and price[i] <= high)) and (not only or stock.get(i, False))]
        assert [(i, s) for _, i, s in sorted(got.get(r, []))] == [(i, -s) for s, i in sorted(fits)[:limit]], r


def test_three_models_feed_the_batch(spark):
    """Collaborative, content and hybrid requests under filters against scores of all pairs; indexed and not."""
    rng = np.random.default_rng(11)
    users, items = rng.normal(size=(20, 4)), rng.normal(size=(150, 4))
    frame = lambda m: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, features array<double>")
    factors = RC.Factors(frame(users), frame(items), 4)
    vectors = rng.normal(size=(150, 5))
    facts = [(i, f"c{i % 3}", f"b{i % 5}", float(rng.integers(100, 9000)) / 100) for i in range(150)]
    content = spark.createDataFrame([(i, c, b, p, [float(x) for x in v]) for (i, c, b, p), v in zip(facts, vectors)], "item_id long, category string, brand string, price double, embedding array<double>")
    catalogue = spark.createDataFrame([(i, p, i % 4 != 0) for i, _, _, p in facts], "item_id long, price double, is_in_stock boolean")
    asks = []
    for r in range(60):
        place, user, source = [("homepage", r % 22, None), ("pdp", None, r % 160), ("pdp", r % 20, r % 150)][r % 3]
        asks.append((r, 1, place, user, source, None, [int(x) for x in rng.integers(0, 150, 4)], 4, 20.0 if r % 4 == 0 else None, 60.0 if r % 5 == 0 else None, r % 7 == 0))
    requests = spark.createDataFrame(asks, REQUESTS)
    counts = spark.createDataFrame([(u, 200) for u in range(25)], "user_id int, interactions int")
    popular = spark.createDataFrame([(1, 149, 1.0)], "merchant_id int, item_id long, score double")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    z = np.array([p for *_, p in facts])
    z = (z - z.mean()) / z.std()
    like = (0.5 * unit @ unit.T + 0.2 * np.array([[a[1] == b[1] for b in facts] for a in facts]) + 0.15 * np.array([[a[2] == b[2] for b in facts] for a in facts])
            + 0.15 * np.exp(-(z[:, None] - z[None, :]) ** 2 / 2))
    np.fill_diagonal(like, -np.inf)
    for block_rows in (4096, 12):
        got = {}
        for r in RC.batch_from_models(requests, factors, content, popular, counts, catalogue, block_rows=block_rows).collect():
            got.setdefault(r.request_id, []).append((r["rank"], r.item_id, r.score))
        for r, _, place, user, source, _, excluded, limit, low, high, only in asks:
            ok = [i for i, _, _, p in facts if (low is None or p >= low) and (high is None or p <= high) and (not only or i % 4 != 0)]
            need = 2 * limit + len(excluded) + 1
            head = lambda scores: sorted(((-scores[i], i) for i in ok if np.isfinite(scores[i])))[:need]
            mine = head(users[user] @ items.T) if user is not None and user < 20 else []
            near = head(like[source]) if source is not None and source < 150 else []
            if place == "homepage":
                scored = {i: -s for s, i in mine}
            elif user is None:
                scored = {i: -s for s, i in near}
            else:
                scored = {i: 0.0 for _, i in mine + near}
                for part, w in ((mine, 0.7), (near, 0.3)):
                    for s, i in part:
                        scored[i] += w * -s
            drop = {*excluded, source}
            want = sorted((-round(s, 9), i) for i, s in scored.items() if i not in drop)[:limit]
            assert [i for _, i, _ in sorted(got.get(r, []))] == [i for _, i in want], (r, block_rows)
