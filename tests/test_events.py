import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from bazaarlens.operators import events as EV
from bazaarlens.plans.dashboards import ingest

SCHEMA = "n int, merchant_id string, event_type string, properties string, context string, timestamp string, session_id string, anonymous_id string, user_id string, source string, received_at timestamp"


def frame(spark, events):
    data = [(i, e.get("merchant_id", "merch_abc123def456"), e.get("event_type", "page_view"),
             e["properties"] if isinstance(e.get("properties"), str) else json.dumps(e.get("properties", {})), json.dumps(e.get("context", {})),
             e.get("timestamp"), e.get("session_id"), e.get("anonymous_id"), e.get("user_id"), e.get("source"), datetime(2024, 1, 15, 12, 0, 1)) for i, e in enumerate(events)]
    return spark.createDataFrame(data, SCHEMA)


def codes(spark, events, column="errors", **kw):
    out = EV.validated(frame(spark, events), **kw).orderBy("n").collect()
    return [[f"{p['field']}:{p['code']}" for p in r[column]] for r in out]


CASES = [
    ("page_view", {"page_path": "/home"}, []),
    ("page_view", {}, ["page_path:required_field_missing"]),
    ("page_view", {"page_path": None}, ["page_path:required_field_null"]),
    ("page_view", {"page_path": 5}, ["page_path:invalid_type"]),
    ("page_view", {"page_path": "x" * 500}, []),
    ("page_view", {"page_path": "x" * 501}, ["page_path:max_length_exceeded"]),
    ("add_to_cart", {"product_id": "prod_1", "quantity": 0}, ["quantity:below_minimum"]),
    ("add_to_cart", {"product_id": "prod_1", "quantity": 1}, []),
    ("add_to_cart", {"product_id": "prod_1", "quantity": 1000}, []),
    ("add_to_cart", {"product_id": "prod_1", "quantity": 1001}, ["quantity:above_maximum"]),
    ("add_to_cart", {"product_id": "prod_1", "quantity": 2.0}, ["quantity:invalid_type"]),
    ("add_to_cart", {"product_id": "prod_1", "quantity": True}, []),
    ("add_to_cart", {"product_id": "prod_1", "quantity": "2"}, ["quantity:invalid_type"]),
    ("add_to_cart", {"product_id": "prod_1", "quantity": 10 ** 20}, ["quantity:above_maximum"]),
    ("add_to_cart", {"product_id": "p" * 50, "quantity": 1}, []),
    ("add_to_cart", {"product_id": "p" * 51, "quantity": 1}, ["product_id:max_length_exceeded", "product_id:product_id_too_long"]),
    ("add_to_cart", {"product_id": "prod_" + "p" * 50, "quantity": 1}, ["product_id:max_length_exceeded"]),
    ("purchase", {"order_id": "order_1", "revenue": 0}, []),
    ("purchase", {"order_id": "order_1", "revenue": -0.5}, ["revenue:below_minimum", "revenue:negative_revenue"]),
    ("purchase", {"revenue": 5, "items": {}}, ["order_id:required_field_missing", "items:invalid_type", "order_id:missing_order_id"]),
    ("recommendation_view", {"placement": "pdp", "product_ids": []}, []),
    ("recommendation_view", {"placement": "attic", "product_ids": [], "strategy": "luck"}, ["placement:invalid_enum_value", "strategy:invalid_enum_value"]),
    ("custom", {"event_name": "ok_name"}, []),
    ("custom", {"event_name": "Bad"}, ["event_name:pattern_mismatch"]),
    ("sign_up", {}, []),
    ("sign_up", {"method": None}, []),
    ("logout", {}, ["event_type:unknown_event_type"]),
    ("page_view", "{broken", ["page_path:required_field_missing"]),
]


def test_rule_outcomes(spark):
    got = codes(spark, [{"event_type": t, "properties": p} for t, p, _ in CASES])
    assert [(t, p, g) for (t, p, _), g in zip(CASES, got)] == CASES


def test_lenient_mode_moves_custom_checks_to_warnings(spark):
    e = [{"event_type": "purchase", "properties": {"order_id": "o", "revenue": -1}}, {"event_type": "logout"}]
    assert codes(spark, e, strict=False) == [["revenue:below_minimum"], []]
    assert codes(spark, e, "warnings", strict=False) == [["revenue:negative_revenue"], []]


def test_messages_and_values(spark):
    r = EV.validated(frame(spark, [{"event_type": "add_to_cart", "properties": {"product_id": 7, "quantity": 0}}])).first()
    assert [(p["message"], p["value"]) for p in r["errors"]] == [
        ("Field 'product_id' should be string, got int", "7"), ("Field 'quantity' must be at least 1", "0")]


def test_context_timestamp_only_warns(spark):
    e = [{"properties": {"page_path": "/"}, "context": {"timestamp": t}} for t in ("2024-01-15T12:00:00Z", "soon", 5)]
    assert codes(spark, e) == [[], [], []]
    assert codes(spark, e, "warnings") == [[], ["context.timestamp:invalid_timestamp"], []]


def test_merchant_and_unknown_type(spark):
    df = frame(spark, [{"merchant_id": None, "properties": {"page_path": "/"}}, {"event_type": "teleport", "properties": {"event_name": "x"}}])
    assert [r.reject_code for r in EV.validated(df).orderBy("n").collect()] == ["merchant_required", "unknown_event_type"]
    loose = EV.validated(df, allow_unknown=True).orderBy("n").collect()[1]
    assert (loose.event_type, loose.is_valid) == ("custom", True)


def test_extended_rule_book(spark):
    book = EV.RuleBook().with_rules([EV.Rule("logout", "reason", "string", required=True, enum=("idle", "user"))]).with_check(
        "logout", lambda p, c: F.when(EV.text_of(p, "reason") == "user", EV.problem("reason", "voluntary", "left")))
    e = [{"event_type": "logout", "properties": p} for p in ({}, {"reason": "idle"}, {"reason": "user"}, {"reason": "x"})]
    assert codes(spark, e, book=book) == [["reason:required_field_missing"], [], ["reason:voluntary"], ["reason:invalid_enum_value"]]
    assert EV.RuleBook().frame(spark).count() == len(EV.RULES)


def test_batch_of_five_is_accepted_and_ids_are_stable(spark):
    df = frame(spark, [{"properties": {"page_path": f"/page/{i}"}} for i in range(5)])
    valid, bad = ingest(df, ["n"])
    a, b = valid.orderBy("n").collect(), ingest(df, ["n"])[0].orderBy("n").collect()
    assert bad.count() == 0 and len(a) == 5
    assert [r.id for r in a] == [r.id for r in b] and len({r.id for r in a}) == 5
    assert all(r.id.startswith("evt_") and len(r.id) == 22 and r.session_id.startswith("sess_") and r.source == "web" for r in a)


@pytest.mark.parametrize("stamp", ["1705320000", "1705320000000", "2024-01-15T12:00:00Z", "2024-01-15T13:00:00+01:00"])
def test_stamps(spark, stamp):
    assert spark.createDataFrame([(stamp,)], "t string").select(EV.parse_stamp("t")).first()[0] == datetime(2024, 1, 15, 12)


def test_revenue_falls_back_to_value(spark):
    df = spark.createDataFrame([('{"revenue":0,"value":7}',), ('{"revenue":3,"value":7}',), ("{}",)], "properties string")
    assert [r.revenue for r in EV.extracted(df).collect()] == [7.0, 3.0, None]


def test_ingestion_metrics(spark):
    df = EV.validated(frame(spark, [{"properties": {"page_path": "/"}}, {}, {}, {}]))
    r = EV.ingestion_metrics(df).first()
    assert (r.events_received, r.events_validated, r.events_rejected, r.rejection_rate) == (4, 1, 3, 0.75)


def test_geo_ranges(spark):
    ranges = spark.createDataFrame([(16777216, 16777471, "AU", "QLD"), (16777472, 16908287, "CN", "FJ")], "ip_from long, ip_to long, country_code string, region string")
    ips = spark.createDataFrame([("1.0.0.0",), ("1.0.0.255",), ("1.0.1.0",), ("1.1.255.255",), ("9.9.9.9",), ("bad",)], "ip_address string")
    assert [r.country_code for r in EV.geo_enriched(ips, ranges).orderBy("ip_address").collect()] == ["AU", "AU", "CN", "CN", None, None]
