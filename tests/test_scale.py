"""Skew-proof operators against brute force, with one key holding most rows."""

import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from bazaarlens.operators import daily as D
from bazaarlens.operators import orders as O
from bazaarlens.operators import scale as X


def _orders(spark, n=400, seed=1):
    rnd = random.Random(seed)
    t0 = datetime(2024, 1, 1)
    data = [(i, 1 if i % 3 else rnd.randrange(3), 7 if rnd.random() < 0.6 else rnd.randrange(20), t0 + timedelta(hours=rnd.randrange(24 * 20))) for i in range(n)]
    return spark.createDataFrame(data, "order_id long, merchant_id int, customer_id long, created_at timestamp_ntz")


def test_purchase_sequence_equals_window(spark):
    o = _orders(spark)
    w = Window.partitionBy("merchant_id", "customer_id").orderBy("created_at", "order_id")
    want = o.withColumn("is_first_order", F.row_number().over(w) == 1).withColumn(
        "days_since_prev_order", F.datediff("created_at", F.lag("created_at").over(w)))
    cols = ("order_id", "is_first_order", "days_since_prev_order")
    assert rows(X.with_purchase_sequence(o), *cols) == rows(want, *cols)


def test_sequence_of_a_slice_sees_history(spark):
    o = _orders(spark)
    part = o.filter(F.to_date("created_at") == "2024-01-15")
    full = X.with_purchase_sequence(o).filter(F.to_date("created_at") == "2024-01-15")
    cols = ("order_id", "is_first_order", "days_since_prev_order")
    assert rows(X.with_purchase_sequence(part, history=o), *cols) == rows(full, *cols)


def test_dense_ranks_with_ties_nulls_and_negatives(spark):
    rnd = random.Random(2)
    values = [None, 0.0, -5.0, -0.01, 3.0, 3.0, 1e9, 0.5] + [round(rnd.uniform(-100, 5000), 2) for _ in range(300)] + [0.0] * 100
    df = spark.createDataFrame([(i, i % 2 if i % 5 else 0, v, float(i % 4)) for i, v in enumerate(values)], "id int, g int, a double, b double")
    w = Window.partitionBy("g")
    want = df.withColumn("ra", F.dense_rank().over(w.orderBy(F.desc_nulls_last("a")))).withColumn("rb", F.dense_rank().over(w.orderBy(F.desc_nulls_last("b"))))
    assert rows(X.with_dense_ranks(df, ["g"], {"ra": "a", "rb": "b"}, ["id"]), "id", "ra", "rb") == rows(want, "id", "ra", "rb")


def test_top_k_limits_before_the_shuffle(spark):
    df = _orders(spark)
    plan = X.top_k(df, ["merchant_id"], [F.desc("created_at"), F.asc("order_id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_sessions_equal_row_by_row_gaps(spark):
    rnd = random.Random(3)
    t0 = datetime(2024, 1, 1)
    data = [(i, 1 if rnd.random() < 0.5 else rnd.randrange(5), t0 + timedelta(seconds=rnd.randrange(60 * 60 * 40))) for i in range(500)]
    data += [(900, 9, t0), (901, 9, t0 + timedelta(minutes=30)), (902, 9, t0 + timedelta(minutes=60, seconds=1))]
    ev = spark.createDataFrame(data, "id int, u int, ts timestamp_ntz")
    got = rows(X.sessionize(ev, ["u"]), "u", "session_start", "session_end", "event_count")
    want = []
    for u in {d[1] for d in data}:
        times = sorted(d[2] for d in data if d[1] == u)
        run = [times[0]]
        for t in times[1:]:
            if t - run[-1] > timedelta(minutes=30):
                want.append((u, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        want.append((u, run[0], run[-1], len(run)))
    assert got == sorted(want, key=lambda t: tuple((v is None, str(v)) for v in t))
    assert [x for x in got if x[0] == 9] == [(9, t0, t0 + timedelta(minutes=30), 2), (9, t0 + timedelta(minutes=60, seconds=1), t0 + timedelta(minutes=60, seconds=1), 1)]


@pytest.mark.parametrize("piece_rows", [1 << 16, 5])
def test_asof_takes_latest_touch_at_or_before(spark, piece_rows):
    rnd = random.Random(4)
    t0 = datetime(2024, 1, 1)
    busy = lambda: t0 + timedelta(hours=30, milliseconds=rnd.randrange(3_600_000))
    at = lambda: busy() if rnd.random() < 0.4 else t0 + timedelta(hours=7) if rnd.random() < 0.2 else t0 + timedelta(minutes=rnd.randrange(60 * 24 * 3))
    key = lambda: 1 if rnd.random() < 0.5 else rnd.randrange(6)
    left = [(i, key(), at()) for i in range(250)] + [(900, None, t0), (901, 1, None)]
    right = [(i, key(), at(), f"s{i}") for i in range(300)] + [(800, None, t0, "nobody"), (801, 1, None, "never")]
    got = rows(X.asof_latest(
        spark.createDataFrame(left, "oid int, c int, ots timestamp_ntz"), spark.createDataFrame(right, "tid int, c int, tts timestamp_ntz, src string"),
        "c", "ots", "tts", ["src"], "tid", piece_rows=piece_rows), "oid", "touch_at", "src")
    want = []
    for oid, c, ots in left:
        prior = [(tts, tid, src) for tid, k, tts, src in right if c is not None and ots is not None and k == c and tts is not None and tts <= ots]
        best = max(prior) if prior else (None, None, None)
        want.append((oid, best[0], best[2]))
    assert got == sorted(want, key=lambda t: tuple((v is None, str(v)) for v in t))


def test_daily_breakdowns_add_up(spark):
    o = _orders(spark).withColumns({
        "status": F.lit("delivered"), "order_date": F.to_date("created_at"), "gmv": (F.col("order_id") % 50).cast("decimal(12,2)"), "nmv": F.lit(1).cast("decimal(12,2)"),
        "total_amount": F.lit(2).cast("decimal(12,2)"), "item_count": F.lit(1), "unique_products": F.lit(1), "discount_amount": F.lit(None).cast("decimal(12,2)"),
        "is_first_order": F.lit(False), "channel": F.element_at(F.array(*[F.lit(c) for c in D.CHANNELS]), (F.col("order_id") % 5 + 1).cast("int")),
        "customer_tier": F.when(F.col("customer_id") == 7, "gold").otherwise("bronze")})
    d = D.daily_core(o, D.CHANNELS, D.TIERS)
    total = sum((F.coalesce(f"{c}_gmv", F.lit(0)) for c in D.CHANNELS), F.lit(0))
    tiers = sum((F.coalesce(f"{t}_customers", F.lit(0)) for t in D.TIERS), F.lit(0))
    assert d.filter((total != F.col("total_gmv")) | (tiers != F.col("unique_customers"))).isEmpty()
    assert d.filter("platinum_gmv is not null or discount_rate <> 0").isEmpty()


def test_row_and_calendar_frames_differ_on_missing_days(spark):
    d = spark.sql("select 1 merchant_id, date_add(date'2024-01-01', n) order_date, cast(n + 1 as decimal(12,2)) total_gmv, 1L order_count from values (0), (1), (20) as t(n)")
    by_row = rows(D.rolling(d), "order_date", "orders_7d_rolling")
    by_day = rows(D.rolling(d, calendar=True), "order_date", "orders_7d_rolling")
    assert [r[1] for r in by_row] == [1, 2, 3] and [r[1] for r in by_day] == [1, 2, 1]


def test_zero_previous_day_gives_no_change(spark):
    d = spark.sql("select 1 merchant_id, date_add(date'2024-01-01', n) order_date, cast(g as decimal(12,2)) total_gmv from values (0, 0), (1, 10), (2, 15) as t(n, g)")
    assert [r[1] for r in rows(D.period_over_period(d), "order_date", "gmv_dod_change")] == [None, None, 50.0]


def test_first_order_by_timestamp_keeps_all_ties(spark):
    o = spark.sql("select * from values (1, 5, timestamp_ntz'2024-01-01 00:00:00'), (2, 5, timestamp_ntz'2024-01-01 00:00:00'), (3, 5, timestamp_ntz'2024-01-02 00:00:00') as t(order_id, customer_id, created_at)")
    first = o.groupBy("customer_id").agg(F.min("created_at").alias("first_order_at"))
    assert rows(O.first_order_by_match(o, first), "order_id", "is_first_order") == [(1, True), (2, True), (3, False)]
    assert rows(X.with_purchase_sequence(o.withColumn("merchant_id", F.lit(1))), "order_id", "is_first_order") == [(1, True), (2, False), (3, False)]
