"""Aggregates whose tasks hold sorted rows instead of hash entries of every line."""

import contextlib
import io
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F

from bazaarlens.operators import customers as C
from bazaarlens.operators import daily as D
from bazaarlens.operators import products as P
from bazaarlens.operators import scale
from bazaarlens.sources import entities as E

ITEM = ("order_id long, merchant_id long, product_id long, customer_id long, total_amount decimal(12,2), quantity int, unit_price decimal(12,2), "
        "discount_amount decimal(12,2), created_at timestamp_ntz")


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def items(spark, rows):
    at = datetime(2024, 1, 1)
    return spark.createDataFrame([(o, m, p, c, Decimal(2), 1, Decimal(2), None if d is None else Decimal(d), at) for o, m, p, c, d in rows], ITEM)


def test_sales_count_orders_without_a_distinct_count(spark):
    df = items(spark, [(1, 1, 7, 1, 0), (1, 1, 7, 1, 0), (2, 1, 7, 1, 0), (None, 1, 7, 1, 0), (1, None, 7, 1, 0), (1, 1, None, 1, 0), (1, 2, 7, 1, 0), (None, 3, 7, 1, 0)])
    out = P.sales(df)
    got = {(r.merchant_id, r.product_id): (r.order_count, r.total_units_sold, int(r.total_revenue)) for r in out.collect()}
    assert got == {(1, 7): (2, 4, 8), (None, 7): (1, 1, 2), (1, None): (1, 1, 2), (2, 7): (1, 1, 2), (3, 7): (0, 1, 2)}
    assert "distinct" not in plan(out)


def test_rollup_sums_both_sides_without_a_join(spark):
    df = items(spark, [(1, 1, 7, 1, 0), (1, 1, 7, 1, 0), (2, 1, 7, 1, 0), (3, 1, None, 1, 0)])
    events = spark.createDataFrame([("product_view", 1, 7), ("product_view", 1, 7), ("product_view", 1, 7), ("purchase", 1, 7), ("product_view", 1, 9), ("product_view", 1, None)], "event_type string, merchant_id long, product_id long")
    out = P.rollup(df, events)
    got = sorted(((r.product_id or 0, r.order_count, int(r.revenue), r.view_count, r.conversion_rate) for r in out.collect()))
    assert got == [(0, 0, 0, 1, 0.0), (0, 1, 2, 0, 0.0), (7, 2, 6, 3, 0.6667), (9, 0, 0, 1, 0.0)]
    assert "Join" not in plan(out) and "distinct" not in plan(out)


def test_daily_customers_are_counted_by_marked_rows(spark):
    day = date(2024, 1, 1)
    rows = [(1, 1, False), (2, 1, True), (3, 2, False), (4, None, True), (5, 3, None), (6, 3, None)]
    fact = spark.createDataFrame([(o, 1, "m", "gold", day, c, f) for o, c, f in rows], "order_id long, merchant_id long, merchant_name string, merchant_tier string, order_date date, customer_id long, is_first_order boolean")
    money = ("gmv", "net_revenue", "total_amount", "refund_amount", "discount_amount", "shipping_amount", "recommended_items_value")
    fact = fact.withColumns({**{c: F.lit("2.00").cast("decimal(12,2)") for c in money}, "item_count": F.lit(1), "hours_to_ship": F.lit(3), "has_recommended_items": F.lit(True),
                             "has_coupon": F.lit(False), "channel_grouping": F.lit("Direct"), "customer_tier": F.lit("gold")})
    out = D.model_daily_gmv(fact)
    r = out.collect()
    assert [(x.order_count, x.unique_customers, x.new_customers, int(x.gmv), x.total_items) for x in r] == [(6, 3, 1, 12, 6)]
    assert not [x for x in plan(out).splitlines() if "HashAggregate" in x and "customer_id" in x.split("functions")[0]]


def test_lines_are_dealt_to_as_many_tasks_as_rows_ask_for(spark, sf, monkeypatch):
    assert scale.dealt(spark.range(5), 5, "id").rdd.getNumPartitions() == spark.range(5).rdd.getNumPartitions()
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(10).withColumn("v", F.lit(1))
    assert scale.dealt(rows, scale.TASK_ROWS * (cores + 3), "id").rdd.getNumPartitions() == cores + 3
    whole = E.items(spark, sf).count()
    monkeypatch.setattr(scale, "TASK_ROWS", 100)
    many = E.items(spark, sf)
    assert many.count() == whole and "REPARTITION_BY_NUM" in plan(many)


def test_behaviour_reads_lines_once_and_counts_like_sets(spark):
    lines = [(1, 1, 7, 1, 0), (1, 1, 8, 1, 1), (1, 1, 7, 1, None), (2, 1, 8, 1, 2), (3, 1, 99, 1, 1), (None, 1, 7, 1, 1), (None, 1, 9, 1, 0), (4, 1, 99, 2, 0), (5, None, 7, 3, 0), (6, 1, 7, None, 0), (7, 2, 10, 4, 1)]
    shop = {7: [("a", "x")], 8: [("a", "y")], 9: [(None, None)], 10: [("b", "z"), ("b", "z")]}
    products = spark.createDataFrame([(p, *x) for p, v in shop.items() for x in v], "product_id long, brand string, product_type string")
    df = items(spark, lines)
    want = {}
    for m, c in {(m, c) for _, m, _, c, _ in lines if m and c}:
        mine = [x for x in lines if (x[1], x[3]) == (m, c)]
        joined = [(x, s) for x in mine for s in shop.get(x[2], ())]
        if joined:
            brands = [len({x[0] for x, s in joined if s[0] == b}) for b in {s[0] for _, s in joined}]
            want[m, c] = (len(joined), sum((x[4] or 0) > 0 for x, _ in joined), max(brands), len({x[0] for x in mine}), len({s[1] for _, s in joined} - {None}))
    for n in (0, scale.TASK_ROWS * (spark.sparkContext.defaultParallelism + 1)):
        out = C.behaviour(df, products, rows=n)
        assert {(r.merchant_id, r.customer_id): (r.line_count, r.sale_lines, r.top_brand_orders, r.order_count, r.category_count) for r in out.collect()} == want
        fresh = plan(C.behaviour(df, products, rows=n))
        assert fresh.count("Join") == 1 and ("REPARTITION_BY_NUM" in fresh) == (n > 0)  # tasks by the number of lines
