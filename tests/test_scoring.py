from datetime import date
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from bazaarlens.functions import scoring as S
from bazaarlens.functions.dates import hour_boundaries, month_boundaries
from bazaarlens.functions.guards import pct_change, ratio
from bazaarlens.functions.privacy import digest_bucket, mask_email, mask_text, slug
from bazaarlens.operators import customers as C
from bazaarlens.operators import merchants as M
from bazaarlens.operators import products as P


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_customer_tier_cutoffs(spark):
    values = [Decimal("249.99"), Decimal("250"), Decimal("999.99"), Decimal("1000"), Decimal("4999.99"), Decimal("5000"), None]
    assert column(spark, values, "decimal(12,2)", S.customer_tier("v")) == ["bronze", "silver", "silver", "gold", "gold", "platinum", "bronze"]


def test_legacy_tier_both_ways(spark):
    names = ["platinum", "gold", "silver", "bronze"]
    assert column(spark, names, "string", S.legacy_tier("v")) == ["tier1", "tier2", "tier3", "tier4"]
    assert column(spark, ["tier1", "tier4", "x"], "string", S.tier_from_legacy("v")) == ["platinum", "bronze", None]


@pytest.mark.parametrize("basis,values,want", [
    ("annual_12m", [99_999.99, 100_000, 499_999.99, 500_000, 1_999_999.99, 2_000_000], ["bronze", "silver", "silver", "gold", "gold", "platinum"]),
    ("annual_12m", [85_000, 350_000, 1_200_000, 4_500_000, 45_000], ["bronze", "silver", "gold", "platinum", "bronze"]),
    ("monthly_avg", [1_199_999.99, 1_200_000, 24_000_000], ["bronze", "silver", "platinum"]),
    ("mtd", [100_000], ["silver"]),
])
def test_merchant_tier_bases(spark, basis, values, want):
    assert column(spark, [float(v) for v in values], "double", S.merchant_tier("v", basis)) == want


def test_unknown_basis_is_an_error(spark):
    with pytest.raises(ValueError):
        S.merchant_tier("v", "weekly")


def test_rfm_boundaries(spark):
    days = [7, 8, 30, 31, 90, 91, 180, 181, None]
    assert column(spark, days, "int", S.recency_score("v")) == [5, 4, 4, 3, 3, 2, 2, 1, 1]
    assert column(spark, list(range(11)), "int", S.frequency_score("v")) == [1, 1, 2, 3, 3, 4, 4, 4, 4, 4, 5]
    assert column(spark, [49.0, 50.0, 200.0, 500.0, 1000.0], "double", S.monetary_score("v")) == [1, 2, 3, 4, 5]
    assert column(spark, [30, 31, 91, 181, 365, 366, None], "int", S.churn_risk("v")) == [0.10, 0.25, 0.50, 0.75, 0.75, 0.95, 0.10]


def test_every_rfm_cell_has_the_documented_segment(spark):
    def expected(r, f, m):
        if r >= 4 and f >= 4 and m >= 4:
            return "champion"
        if f >= 4 and r >= 3:
            return "loyal"
        if r >= 4 and f <= 2:
            return "promising"
        if r <= 2:
            return "at_risk" if f >= 3 else "hibernating"
        return "needs_attention" if r == 3 and f == 3 else "regular"
    cells = [(r, f, m) for r in range(1, 6) for f in range(1, 6) for m in range(1, 6)]
    got = spark.createDataFrame(cells, "r int, f int, m int").select("r", "f", "m", S.rfm_segment("r", "f", "m").alias("s")).collect()
    assert all(x.s == expected(x.r, x.f, x.m) for x in got)


def test_activity_bands(spark):
    df = spark.createDataFrame([("new", 10, 5, 0.0, 1), ("vip", 900, 5, 5000.0, 10), ("active", 900, 90, 0.0, 1), ("mid", 900, 150, 0.0, 1), ("churned", 900, 181, 0.0, 1)],
                               "name string, first int, last int, ltv double, n int")
    asof = F.lit("2024-06-30").cast("date")
    args = (F.date_sub(asof, F.col("first")), F.date_sub(asof, F.col("last")), F.col("ltv"), F.col("n"), asof)
    coded = {r[0]: r[1] for r in df.select("name", S.activity_segment(*args)).collect()}
    assert coded == {"new": "new", "vip": "vip", "active": "active", "mid": "active", "churned": "churned"}
    banded = {r[0]: r[1] for r in df.select("name", S.activity_segment(*args, at_risk_days=180)).collect()}
    assert banded["mid"] == "at_risk"


def test_boundary_counts(spark):
    df = spark.sql("select timestamp_ntz'2024-01-15 10:59:00' a, timestamp_ntz'2024-01-15 12:01:00' b, date'2024-01-31' c, date'2024-02-01' d")
    assert df.select(hour_boundaries("a", "b"), hour_boundaries("b", "a"), month_boundaries("c", "d")).first()[:] == (2, -2, 1)


def test_ratio_and_change_guards(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 4.0), (3.0, None)], "a double, b double")
    assert [r[0] for r in df.select(ratio("a", "b")).collect()] == [0.0, 0.25, 0.0]
    assert [r[0] for r in df.select(pct_change("a", "b")).collect()] == [None, -75.0, None]


def test_masks(spark):
    df = spark.createDataFrame([("jane.doe@shop.example", "Jane  Doe_X!"), ("a@b@c.com", "--a--"), ("nomail", "é")], "e string, n string")
    assert [tuple(r) for r in df.select(mask_email("e"), slug("n"), mask_text("n", 2)).collect()] == [
        ("ja******@shop.example", "jane-doe-x", "Ja**********"), ("a@*@c.com", "a", "--***"), ("noma**", "", "*")]


def test_digest_bucket_equals_python(spark):
    import hashlib
    ids = [f"user_{i}" for i in range(200)]
    got = column(spark, ids, "string", digest_bucket("v", 100))
    assert got == [int(hashlib.md5(i.encode()).hexdigest(), 16) % 100 for i in ids]


def test_customers_without_orders_keep_defaults(spark):
    customers = spark.createDataFrame([(1, 1), (1, 2)], "merchant_id int, customer_id int")
    orders = spark.sql("select 1 merchant_id, 1 customer_id, cast(120 as decimal(12,2)) total_amount, timestamp_ntz'2024-01-01 00:00:00' created_at, 2 item_count")
    df = C.with_tenure(C.with_churn_risk(C.with_rfm(C.with_tier(C.with_customer_value(customers, C.customer_value(orders))), "2024-02-01")), "2024-02-01")
    df = C.with_activity_flags(df)
    r = {x.customer_id: x for x in df.collect()}
    assert (r[2].tier, r[2].recency_score, r[2].churn_risk, r[2].lifecycle_stage, r[2].never_ordered) == ("bronze", 1, 0.10, "mature", True)
    assert r[1].order_value_stddev is None and r[1].days_since_last_order == 31 and not r[1].never_ordered


def test_product_price_and_stock_edges(spark):
    df = spark.sql("""select * from values (1, 10.00, 0.00, 5.00, 3, 'deny'), (2, 10.00, 6.67, null, -1, 'continue'), (3, 0.00, null, 1.00, null, 'deny')
        as t(product_id, price, sale_price, cost, inventory_quantity, inventory_policy)""").withColumn("low_stock_threshold", F.lit(5))
    df = df.withColumns(P.price_columns()).withColumns(P.stock_columns())
    got = rows(df.withColumn("margin", P.margin_pct(F.col("current_price"))), "product_id", "current_price", "is_on_sale", "discount_percentage", "available_quantity", "is_in_stock", "margin")
    assert got == [(1, Decimal("10.00"), True, 100, 3, True, 50.0), (2, Decimal("6.67"), True, 33, 0, True, None), (3, Decimal("0.00"), False, None, 0, False, None)]


def test_tier_progress_matches_documented_example(spark):
    df = M.tier_progress(spark.createDataFrame([(523456.78,), (2_000_000.0,)], "gmv_12m double"))
    a, b = df.orderBy("gmv_12m").collect()
    assert (a.tier, a.next_tier, round(a.progress_pct, 2)) == ("gold", "platinum", 26.17)
    assert (b.tier, b.next_tier, b.progress_pct) == ("platinum", None, None)


def test_tier_history_islands(spark):
    monthly = spark.createDataFrame([(1, date(2024, m, 1), g) for m, g in ((1, 50_000.0), (2, 60_000.0), (3, 150_000.0), (4, 90_000.0))], "merchant_id int, month date, gmv double")
    assert rows(M.tier_history(monthly), "tier", "valid_from", "valid_to", "months") == [
        ("bronze", date(2024, 1, 1), date(2024, 3, 1), 2), ("bronze", date(2024, 4, 1), None, 1), ("silver", date(2024, 3, 1), date(2024, 4, 1), 1)]
