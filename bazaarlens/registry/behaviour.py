"""Checked queries over events: rules, ingestion, sessions, dashboard metrics, alerts."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..functions.guards import count_if
from ..operators import alerts as A
from ..operators import daily as D
from ..operators import events as EV
from ..operators import metrics as MX
from ..operators.scale import asof_latest, sessionize
from ..plans import dashboards, marts
from ..sources import entities as E
from . import commerce as CM
from . import sql_entities as Q
from .core import query

END = "2024-01-30 23:59:59"


# ------------------------------------------------------------------ rules and ingestion

def _sql_text(x):
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


def _rules_cte() -> str:
    rows = ", ".join(
        f"('{r.event_type}', '{r.name}', '{r.type}', {str(r.required).upper()}, {'NULL' if r.min is None else r.min}, {'NULL' if r.max is None else r.max}, "
        f"{'NULL' if r.max_length is None else r.max_length}, {'NULL' if r.enum is None else '[' + ', '.join(_sql_text(e) for e in r.enum) + ']'}, {_sql_text(r.pattern)})"
        for r in EV.RULES)
    return f"rules AS (SELECT * FROM (VALUES {rows}) AS t(event_type, field, type, required, mn, mx, maxlen, enum, pattern))"


_TYPES = ", ".join(f"'{t}'" for t in EV.EVENT_TYPES)
CHECKS = (Q.PAYLOADS, _rules_cte(), """seen AS (
  SELECT p.event_id, r.*, json_type(properties, '$.' || field) AS jt, json_extract_string(properties, '$.' || field) AS txt
  FROM payload p JOIN rules r ON p.event_type = r.event_type),
typed AS (
  SELECT *, jt IS NOT NULL AND jt <> 'NULL' AS filled, CASE type WHEN 'string' THEN jt = 'VARCHAR' WHEN 'integer' THEN jt IN ('BIGINT','UBIGINT','BOOLEAN')
    WHEN 'number' THEN jt IN ('BIGINT','UBIGINT','DOUBLE','BOOLEAN') WHEN 'array' THEN jt = 'ARRAY' WHEN 'object' THEN jt = 'OBJECT' END AS fits FROM seen),
problems AS (
  SELECT event_id, field, unnest(list_filter([
    CASE WHEN required AND jt IS NULL THEN 'required_field_missing' WHEN required AND jt = 'NULL' THEN 'required_field_null' END,
    CASE WHEN filled AND NOT fits THEN 'invalid_type' END,
    CASE WHEN filled AND fits AND mn IS NOT NULL AND TRY_CAST(txt AS DOUBLE) < mn THEN 'below_minimum' END,
    CASE WHEN filled AND fits AND mx IS NOT NULL AND TRY_CAST(txt AS DOUBLE) > mx THEN 'above_maximum' END,
    CASE WHEN filled AND fits AND length(txt) > maxlen THEN 'max_length_exceeded' END,
    CASE WHEN filled AND fits AND enum IS NOT NULL AND NOT list_contains(enum, txt) THEN 'invalid_enum_value' END,
    CASE WHEN filled AND fits AND pattern IS NOT NULL AND NOT regexp_matches(txt, pattern) THEN 'pattern_mismatch' END], lambda x: x IS NOT NULL)) AS code
  FROM typed
  UNION ALL SELECT event_id, 'order_id', 'missing_order_id' FROM payload WHERE event_type = 'purchase' AND json_type(properties, '$.order_id') IS NULL
  UNION ALL SELECT event_id, 'revenue', 'negative_revenue' FROM payload WHERE event_type = 'purchase' AND json_type(properties, '$.order_id') IS NOT NULL
    AND TRY_CAST(json_extract_string(properties, '$.revenue') AS DOUBLE) < 0
  UNION ALL SELECT event_id, 'product_id', CASE WHEN json_extract_string(properties, '$.product_id') IS NULL THEN 'missing_product_id' ELSE 'product_id_too_long' END
    FROM payload WHERE event_type IN ('product_view','product_click','add_to_cart') AND (json_extract_string(properties, '$.product_id') IS NULL
      OR (NOT starts_with(json_extract_string(properties, '$.product_id'), 'prod_') AND length(json_extract_string(properties, '$.product_id')) > 50))""" + f"""
  UNION ALL SELECT event_id, 'event_type', 'unknown_event_type' FROM payload WHERE event_type IN ({_TYPES}) AND event_type NOT IN (SELECT event_type FROM rules)),
checked AS (
  SELECT p.*, coalesce(e.codes, '') AS error_codes, CASE WHEN merchant_id IS NULL THEN 'merchant_required' WHEN event_type NOT IN ({_TYPES}) THEN 'unknown_event_type'
    WHEN e.codes IS NOT NULL THEN 'validation_failed' END AS reject_code, context_timestamp = 'yesterday' AND event_type IN (SELECT event_type FROM rules) AS warned
  FROM payload p LEFT JOIN (SELECT event_id, string_agg(field || ':' || code, ',' ORDER BY field || ':' || code) AS codes FROM problems GROUP BY 1) e USING (event_id))""")


def _checked(spark, root, **kw):
    return EV.validated(E.raw_payloads(spark, root), **kw)


def _codes(column="errors"):
    return F.array_join(F.array_sort(F.transform(column, lambda x: F.concat(x["field"], F.lit(":"), x["code"]))), ",")


@query("ev10_validation_result", "event_id:i event_type:s is_valid:b reject_code:s error_codes:s warnings:i",
       "SELECT event_id, event_type, reject_code IS NULL AS is_valid, reject_code, error_codes, CASE WHEN warned THEN 1 ELSE 0 END AS warnings FROM checked", CHECKS)
@query("ev01_merchant_and_type", "event_id:i is_valid:b reject_code:s", "SELECT event_id, reject_code IS NULL AS is_valid, reject_code FROM checked", CHECKS)
@query("ev05_context_timestamp", "event_id:i warnings:i", "SELECT event_id, CASE WHEN warned THEN 1 ELSE 0 END AS warnings FROM checked", CHECKS)
def _(spark, root):
    df = _checked(spark, root)
    return df.select("event_id", "event_type", "is_valid", "reject_code", _codes().alias("error_codes"), F.size("warnings").alias("warnings"))


def _code_counts(*codes):
    inlist = ", ".join(f"'{c}'" for c in codes)
    return f"SELECT event_type, field, code, count(*) AS n FROM problems JOIN payload USING (event_id) WHERE code IN ({inlist}) GROUP BY 1, 2, 3"


def _problem_counts(spark, root, *codes):
    e = _checked(spark, root).select("event_type", F.explode("errors").alias("e")).select("event_type", "e.field", "e.code")
    return e.filter(F.col("code").isin(*codes)).groupBy("event_type", "field", "code").agg(F.count(F.lit(1)).alias("n"))


for _name, _codes_of in {
    "ev02_required_fields": ("required_field_missing", "required_field_null"),
    "ev03_field_types": ("invalid_type",),
    "ev04_field_constraints": ("below_minimum", "above_maximum", "max_length_exceeded", "invalid_enum_value", "pattern_mismatch"),
    "ev06_purchase_rule": ("missing_order_id", "missing_revenue", "negative_revenue"),
    "ev07_product_id_rule": ("missing_product_id", "product_id_too_long"),
    "ev08_no_schema_strict": ("unknown_event_type",),
}.items():
    query(_name, "event_type:s field:s code:s n:i", _code_counts(*_codes_of), CHECKS)(
        lambda spark, root, c=_codes_of: _problem_counts(spark, root, *c))


@query("ev08_no_schema_lenient", "event_type:s n:i valid:i",
       "SELECT event_type, count(*) AS n, count(*) FILTER (merchant_id IS NOT NULL) AS valid FROM payload WHERE event_type = 'logout' GROUP BY 1", CHECKS)
def _(spark, root):
    return _checked(spark, root, strict=False).filter("event_type = 'logout'").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("is_valid")).alias("valid"))


@query("ev09_rule_usage", "event_type:s field:s type:s required:b events:i",
       "SELECT r.event_type, field, type, required, count(p.event_id) AS events FROM rules r LEFT JOIN payload p USING (event_type) GROUP BY 1, 2, 3, 4", CHECKS)
def _(spark, root):
    n = E.raw_payloads(spark, root).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return EV.RuleBook().frame(spark).join(n, "event_type", "left").withColumn("events", F.coalesce("n", F.lit(0)))


@query("ev11_enriched_events", "event_id:i id:s timestamp:t session_id:s anonymous_id:s source:s",
       """SELECT event_id, 'evt_' || left(h, 18) AS id, TIMESTAMP '2024-01-15 12:00:00' AS timestamp, coalesce(session_id, 'sess_' || left(h, 16)) AS session_id,
          'anon_' || left(h, 16) AS anonymous_id, CASE WHEN source = 'ios' THEN 'ios' ELSE 'web' END AS source
          FROM (SELECT *, sha256(CAST(event_id AS VARCHAR)) AS h FROM checked WHERE reject_code IS NULL)""", CHECKS)
def _(spark, root):
    out = EV.enriched(_checked(spark, root).filter("is_valid"), ["event_id"])
    return out.withColumn("timestamp", F.convert_timezone(None, F.lit("UTC"), F.col("timestamp").cast("timestamp_ntz")))


@query("ev12_batch_outcome", "merchant_id:i is_valid:b n:i", "SELECT merchant_id, reject_code IS NULL AS is_valid, count(*) AS n FROM checked GROUP BY 1, 2", CHECKS)
def _(spark, root):
    return _checked(spark, root).groupBy("merchant_id", "is_valid").agg(F.count(F.lit(1)).alias("n"))


@query("ev13_ingestion_metrics", "merchant_id:i events_received:i events_validated:i events_rejected:i rejection_rate:r",
       """SELECT merchant_id, count(*) AS events_received, count(*) FILTER (reject_code IS NULL) AS events_validated, count(*) FILTER (reject_code IS NOT NULL) AS events_rejected,
          CAST(count(*) FILTER (reject_code IS NOT NULL) AS DOUBLE) / count(*) AS rejection_rate FROM checked GROUP BY 1""", CHECKS)
def _(spark, root):
    return EV.ingestion_metrics(_checked(spark, root))


@query("ev14_custom_rule_set", "event_type:s is_valid:b n:i",
       "SELECT event_type, false AS is_valid, count(*) AS n FROM payload WHERE event_type = 'logout' AND merchant_id IS NOT NULL GROUP BY 1", CHECKS)
def _(spark, root):
    book = EV.RuleBook().with_rules([EV.Rule("logout", "reason", "string", required=True)])
    return _checked(spark, root, book=book).filter("event_type = 'logout' AND merchant_id IS NOT NULL").groupBy("event_type", "is_valid").agg(
        F.count(F.lit(1)).alias("n"))


@query("ev15_event_fields", "event_id:i product_id:s order_id:s revenue:r",
       """SELECT event_id, json_extract_string(properties, '$.product_id') AS product_id, json_extract_string(properties, '$.order_id') AS order_id,
          coalesce(nullif(CAST(json_extract_string(properties, '$.revenue') AS DOUBLE), 0), CAST(json_extract_string(properties, '$.value') AS DOUBLE)) AS revenue FROM payload""", (Q.PAYLOADS,))
def _(spark, root):
    return EV.extracted(E.raw_payloads(spark, root))


@query("pr40_event_flags", "event_type:s is_conversion:b is_engagement:b is_identified:b n:i",
       """SELECT event_type, event_type IN ('purchase','sign_up','add_to_cart') AS is_conversion, event_type IN ('product_view','product_click','search','wishlist_add') AS is_engagement,
          user_id IS NOT NULL AS is_identified, count(*) AS n FROM payload GROUP BY ALL""", (Q.PAYLOADS,))
def _(spark, root):
    flags = EV.event_flags()
    return E.raw_payloads(spark, root).withColumns(flags).groupBy("event_type", *flags).agg(F.count(F.lit(1)).alias("n"))


@query("jn16_geo_enrichment", "country_code:s region:s n:i",
       """SELECT CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 250 < 128 THEN 'US' ELSE 'CA' END WHEN 1 THEN 'DE' END AS country_code,
            CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 250 < 128 THEN 'West' ELSE 'East' END WHEN 1 THEN 'North' END AS region, count(*) AS n
          FROM payload GROUP BY 1, 2""", (Q.PAYLOADS,))
def _(spark, root):
    base = 10 * 16777216
    rows = [(base, base + 128 * 256 - 1, "US", "West"), (base + 128 * 256, base + 65535, "CA", "East"), (base + 65536, base + 2 * 65536 - 1, "DE", "North")]
    ranges = spark.createDataFrame(rows, "ip_from bigint, ip_to bigint, country_code string, region string")
    return EV.geo_enriched(E.raw_payloads(spark, root), ranges).groupBy("country_code", "region").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ sessions and windows

SESSIONS = """gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY customer_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM ev),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY customer_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session_no FROM gaps),
sess AS (
  SELECT merchant_id, customer_id, session_no, min(ts) AS session_start, max(ts) AS session_end, count(*) AS event_count, count(*) FILTER (event_type = 'page_view') AS page_views,
    count(*) FILTER (event_type = 'product_view') AS product_views, count(*) FILTER (event_type = 'add_to_cart') AS cart_adds FROM numbered GROUP BY 1, 2, 3)"""


def _sessions(spark, root):
    t = F.col("event_type")
    flag = lambda n: F.when(t == n, 1).otherwise(0)
    return sessionize(E.events(spark, root), ["merchant_id", "customer_id"], measures={
        "page_views": flag("page_view"), "product_views": flag("product_view"), "cart_adds": flag("add_to_cart")})


@query("st05_sessions_by_gap", "merchant_id:i customer_id:i session_no:i session_start:t session_end:t event_count:i page_views:i product_views:i cart_adds:i",
       "SELECT * FROM sess", (Q.EVENTS, SESSIONS))
def _(spark, root):
    return _sessions(spark, root)


FSESS = """fsess AS (SELECT merchant_id, customer_id AS anonymous_id, CAST(session_start AS DATE) AS session_date, page_views, product_views > 0 AS has_product_view, cart_adds > 0 AS has_add_to_cart FROM sess),
dsess AS (
  SELECT merchant_id, session_date AS order_date, count(*) AS sessions, count(DISTINCT anonymous_id) AS unique_visitors, sum(page_views) AS page_views,
    CAST(sum(page_views) AS DOUBLE) / count(*) AS avg_pages_per_session, CAST(count(*) FILTER (page_views = 1) AS DOUBLE) / count(*) AS bounce_rate,
    count(*) FILTER (has_product_view) AS sessions_with_product_view, count(*) FILTER (has_add_to_cart) AS sessions_with_add_to_cart FROM fsess GROUP BY 1, 2)"""


def _fact_sessions(spark, root):
    return _sessions(spark, root).select(
        "merchant_id", F.col("customer_id").alias("anonymous_id"), F.to_date("session_start").alias("session_date"), "page_views",
        (F.col("product_views") > 0).alias("has_product_view"), (F.col("cart_adds") > 0).alias("has_add_to_cart"))


@query("ag22_daily_sessions", "merchant_id:i order_date:d sessions:i unique_visitors:i page_views:i avg_pages_per_session:r bounce_rate:r sessions_with_product_view:i sessions_with_add_to_cart:i",
       "SELECT * FROM dsess", (Q.EVENTS, SESSIONS, FSESS))
def _(spark, root):
    return D.daily_sessions(_fact_sessions(spark, root))


DORD = """dord AS (
  SELECT merchant_id, order_date, count(DISTINCT order_id) AS order_count, sum(subtotal) AS gmv, sum(total_amount) AS revenue, sum(item_count) AS units_sold,
    count(DISTINCT customer_id) AS ordering_customers, count(DISTINCT CASE WHEN is_first_order THEN customer_id END) AS new_customers,
    CAST(sum(subtotal) AS DOUBLE) / count(subtotal) AS avg_order_value, quantile_cont(CAST(subtotal AS DOUBLE), 0.5) AS median_order_value, max(subtotal) AS max_order_value
  FROM mfact WHERE order_status NOT IN ('cancelled','refunded') GROUP BY 1, 2)"""


@query("ag21_merchant_daily_orders", "merchant_id:i order_date:d order_count:i gmv:m revenue:m units_sold:i ordering_customers:i new_customers:i avg_order_value:r median_order_value:r4 max_order_value:m",
       "SELECT * FROM dord", (*CM.MFACT_CTES, DORD))
def _(spark, root):
    f = CM._mfact(spark, root)
    return D.merchant_daily_orders(f.filter(~F.col("order_status").isin("cancelled", "refunded")))


PERF = """perf AS (
  SELECT o.*, coalesce(s.sessions, 0) AS sessions, coalesce(s.unique_visitors, 0) AS unique_visitors, coalesce(s.page_views, 0) AS page_views,
    coalesce(s.bounce_rate, 0) AS bounce_rate, ordering_customers - new_customers AS returning_customers,
    CASE WHEN ordering_customers > 0 THEN CAST(new_customers AS DOUBLE) / ordering_customers ELSE 0 END AS new_customer_rate,
    CASE WHEN coalesce(s.sessions, 0) > 0 THEN CAST(order_count AS DOUBLE) / s.sessions ELSE 0 END AS conversion_rate,
    CASE WHEN coalesce(s.sessions, 0) > 0 THEN CAST(sessions_with_product_view AS DOUBLE) / s.sessions ELSE 0 END AS product_view_rate,
    CASE WHEN coalesce(s.sessions_with_add_to_cart, 0) > 0 THEN CAST(order_count AS DOUBLE) / s.sessions_with_add_to_cart ELSE 0 END AS cart_to_checkout_rate,
    CASE WHEN coalesce(s.sessions, 0) > 0 THEN CAST(revenue AS DOUBLE) / s.sessions ELSE 0 END AS revenue_per_session,
    CASE WHEN coalesce(s.unique_visitors, 0) > 0 THEN CAST(revenue AS DOUBLE) / s.unique_visitors ELSE 0 END AS revenue_per_visitor,
    CAST(units_sold AS DOUBLE) / order_count AS units_per_order
  FROM dord o LEFT JOIN (SELECT * REPLACE (CAST(order_date - INTERVAL 8766 DAY AS DATE) AS order_date) FROM dsess) s USING (merchant_id, order_date))"""
PERF_CTES = (*CM.MFACT_CTES, DORD, Q.EVENTS, SESSIONS, FSESS, PERF)


@query("jb11_merchant_performance",
       "merchant_id:i order_date:d order_count:i gmv:m revenue:m units_sold:i avg_order_value:r median_order_value:r4 max_order_value:m ordering_customers:i new_customers:i returning_customers:i "
       "new_customer_rate:r sessions:i unique_visitors:i page_views:i bounce_rate:r conversion_rate:r product_view_rate:r cart_to_checkout_rate:r revenue_per_session:r revenue_per_visitor:r units_per_order:r",
       "SELECT * FROM perf", PERF_CTES)
@query("ag23_merchant_rates", "merchant_id:i order_date:d conversion_rate:r product_view_rate:r cart_to_checkout_rate:r revenue_per_session:r revenue_per_visitor:r units_per_order:r",
       "SELECT * FROM perf", PERF_CTES)
@query("jn14_orders_with_sessions", "merchant_id:i order_date:d order_count:i sessions:i unique_visitors:i", "SELECT * FROM perf", PERF_CTES)
def _(spark, root):
    # The event month is laid over January 2000 so that both sides share days.
    sessions = _fact_sessions(spark, root).withColumn("session_date", F.date_sub("session_date", 8766))
    return marts.merchant_performance(CM._mfact(spark, root), sessions)


for _w, _step in (("5 minutes", "5 MINUTE"), ("1 hour", "1 HOUR"), ("1 day", "1 DAY"), ("7 days", "7 DAY"), ("30 days", "30 DAY")):
    query(f"st04_tumbling_{_w.replace(' ', '_')}", "merchant_id:i window_start:t events:i revenue:m",
          f"SELECT merchant_id, time_bucket(INTERVAL {_step}, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS events, sum(value) AS revenue FROM ev GROUP BY 1, 2", (Q.EVENTS,))(
        lambda spark, root, w=_w: E.events(spark, root).groupBy("merchant_id", F.window("ts", w)["start"].alias("window_start")).agg(
            F.count(F.lit(1)).alias("events"), F.sum("value").alias("revenue")))


@query("st06_active_sessions_sliding", "merchant_id:i window_start:t active_sessions:i",
       """SELECT merchant_id, window_start, count(DISTINCT session_id) AS active_sessions FROM (
            SELECT merchant_id, session_id, time_bucket(INTERVAL 1 MINUTE, ts, TIMESTAMP '1970-01-01') - to_minutes(n) AS window_start FROM ev, generate_series(0, 4) AS g(n)) GROUP BY 1, 2""", (Q.EVENTS,))
def _(spark, root):
    w = F.window("ts", "5 minutes", "1 minute")["start"]
    return E.events(spark, root).select("merchant_id", "session_id", w.alias("window_start")).distinct().groupBy("merchant_id", "window_start").agg(
        F.count("session_id").alias("active_sessions"))


@query("st07_processing_lag", "merchant_id:i events:i avg_lag_seconds:r max_lag_seconds:i late_events:i",
       """SELECT merchant_id, count(*) AS events, CAST(sum(event_id % 90) AS DOUBLE) / count(*) AS avg_lag_seconds, max(event_id % 90) AS max_lag_seconds,
          count(*) FILTER (event_id % 90 > 60) AS late_events FROM ev GROUP BY 1""", (Q.EVENTS,))
def _(spark, root):
    return MX.processing_lag(E.events(spark, root))


@query("st09_over_limit_seconds", "merchant_id:i bucket:t events:i",
       "SELECT merchant_id, date_trunc('minute', ts) AS bucket, count(*) AS events FROM ev GROUP BY 1, 2 HAVING count(*) > 1", (Q.EVENTS,))
def _(spark, root):
    from ..streaming.reports import over_limit
    return over_limit(E.events(spark, root), "ts", "1 minute", 1)


@query("st09_over_limit_each_second", "merchant_id:i bucket:t events:i",
       "SELECT merchant_id, date_trunc('second', ts) AS bucket, count(*) AS events FROM ev GROUP BY 1, 2 HAVING count(*) > 0", (Q.EVENTS,))
def _(spark, root):
    from ..streaming.reports import over_limit
    return over_limit(E.events(spark, root), "ts", "1 second", 0)


@query("st09_over_tier_limit", "merchant_id:i bucket:t events:i",
       """SELECT merchant_id, bucket, events FROM (SELECT merchant_id, date_trunc('minute', ts) AS bucket, count(*) AS events FROM ev GROUP BY 1, 2)
          JOIN (SELECT merchant_id, CASE merchant_tier WHEN 'bronze' THEN 1 WHEN 'silver' THEN 2 ELSE 3 END AS m FROM merchants) USING (merchant_id) WHERE events > m""", (Q.EVENTS, Q.MERCHANTS))
def _(spark, root):
    from ..streaming.reports import over_tier_limit
    tier = F.col("merchant_tier")
    share = E.merchants(spark, root).select("merchant_id", F.when(tier == "bronze", 1).when(tier == "silver", 2).otherwise(3).alias("rate_multiplier"))
    return over_tier_limit(E.events(spark, root), share, per_minute=1)


@query("st07_late_rows", "merchant_id:i late:i on_time:i",
       """SELECT merchant_id, count(*) FILTER (ts < cut) AS late, count(*) FILTER (ts >= cut) AS on_time FROM ev,
          (SELECT max(ts) - INTERVAL 10 DAY AS cut FROM ev) GROUP BY 1""", (Q.EVENTS,))
def _(spark, root):
    from ..streaming.ingest import split_late
    fresh, late = split_late(E.events(spark, root).select("merchant_id", "ts"), allowed_seconds=10 * 86400)
    both = late.withColumn("late", F.lit(1)).unionByName(fresh.withColumn("late", F.lit(0)))
    return both.groupBy("merchant_id").agg(F.sum("late").alias("late"), F.sum(1 - F.col("late")).alias("on_time"))


@query("st10_retained_events", "event_month:s n:i",
       "SELECT strftime(ts, '%Y-%m') AS event_month, count(*) AS n FROM ev WHERE CAST(ts AS DATE) >= DATE '2024-04-10' - 90 GROUP BY 1", (Q.EVENTS,))
def _(spark, root):
    from ..streaming.reports import retained
    return retained(E.raw_events(spark, root), "2024-04-10", 90).groupBy(F.date_format("ts", "yyyy-MM").alias("event_month")).agg(F.count(F.lit(1)).alias("n"))


@query("jn20_order_attribution", "event_id:i customer_id:i touch_at:t source:s device:s",
       """SELECT p.event_id, p.customer_id, t.ts AS touch_at, t.source, t.device FROM (SELECT * FROM ev WHERE event_type = 'purchase') p LEFT JOIN LATERAL (
            SELECT ts, source, device FROM ev t WHERE t.customer_id = p.customer_id AND t.event_type IN ('product_view','add_to_cart') AND t.ts <= p.ts ORDER BY ts DESC, event_id DESC LIMIT 1) t ON TRUE""", (Q.EVENTS,))
def _(spark, root):
    e = E.raw_events(spark, root)
    orders = e.filter("event_type = 'purchase'").select("event_id", "customer_id", "ts")
    touches = e.filter(F.col("event_type").isin("product_view", "add_to_cart")).select(
        "customer_id", F.col("ts").alias("touch_ts"), F.col("event_id").alias("touch_id"), "source", "device")
    return asof_latest(orders, touches, "customer_id", "ts", "touch_ts", ["source", "device"], "touch_id")


# ------------------------------------------------------------------ dashboard metrics

WIN = f"""win AS (SELECT * FROM ev WHERE received_at BETWEEN TIMESTAMP '{END}' - INTERVAL 7 DAY AND TIMESTAMP '{END}'),
prv AS (SELECT * FROM ev WHERE received_at BETWEEN TIMESTAMP '{END}' - INTERVAL 14 DAY AND TIMESTAMP '{END}' - INTERVAL 7 DAY)"""
_M = """SELECT *, CASE WHEN orders > 0 THEN round(CAST(gmv AS DOUBLE) / orders, 2) ELSE 0 END AS aov, round(CAST(stage_4 AS DOUBLE) / sessions * 100, 2) AS conversion_rate,
    CASE WHEN customers > 0 THEN round(CAST(gmv AS DOUBLE) / customers, 2) ELSE 0 END AS arpu,
    CASE WHEN stage_2 > 0 THEN round((1.0 - CAST(stage_4 AS DOUBLE) / stage_2) * 100, 2) ELSE 0 END AS cart_abandonment_rate FROM (
  SELECT merchant_id, count(DISTINCT session_id) AS sessions, count(*) FILTER (event_type = 'page_view') AS page_views,
    coalesce(sum(revenue) FILTER (event_type = 'purchase'), 0) AS gmv, count(DISTINCT order_id) FILTER (event_type = 'purchase') AS orders,
    count(DISTINCT customer_id) FILTER (event_type = 'purchase') AS customers, count(DISTINCT session_id) FILTER (event_type = 'product_view') AS stage_1,
    count(DISTINCT session_id) FILTER (event_type = 'add_to_cart') AS stage_2, count(DISTINCT session_id) FILTER (event_type = 'begin_checkout') AS stage_3,
    count(DISTINCT session_id) FILTER (event_type = 'purchase') AS stage_4 FROM {0} GROUP BY 1)"""
MET = f"met AS ({_M.format('win')}), pmet AS ({_M.format('prv')})"
MET_CTES = (Q.EVENTS, WIN, MET)


def _week(spark, root, shift=0):
    return MX.in_window(E.events(spark, root), END, "weekly", shift=shift)


MET_NAMES = {"mx01_gmv": "gmv:m", "mx02_order_count": "orders:i", "mx03_average_order_value": "aov:r2", "mx04_sessions": "sessions:i", "mx05_page_views": "page_views:i",
             "mx07_conversion_rate": "conversion_rate:r2", "mx08_arpu": "arpu:r2", "al02_cart_abandonment": "cart_abandonment_rate:r2"}
for _n, _spec in MET_NAMES.items():
    query(_n, f"merchant_id:i {_spec}", "SELECT * FROM met", MET_CTES)(lambda spark, root: MX.merchant_metrics(_week(spark, root)))


FUN = """fun AS (
  SELECT merchant_id, stage_no, stage, n AS sessions, CASE WHEN stage_no = 0 THEN 100.0 WHEN p > 0 THEN round(CAST(n AS DOUBLE) / p * 100, 2) ELSE 0 END AS step_rate,
    CASE WHEN n > 0 THEN round((1.0 - CAST(nx AS DOUBLE) / n) * 100, 2) END AS drop_off, CASE WHEN mx > 0 THEN round(CAST(n AS DOUBLE) / mx * 100, 2) ELSE 0 END AS bar_width
  FROM (SELECT *, lag(n) OVER w AS p, lead(n) OVER w AS nx, max(n) OVER (PARTITION BY merchant_id) AS mx FROM (
    SELECT merchant_id, 0 AS stage_no, 'Sessions' AS stage, sessions AS n FROM met UNION ALL SELECT merchant_id, 1, 'Product Views', stage_1 FROM met
    UNION ALL SELECT merchant_id, 2, 'Add to Cart', stage_2 FROM met UNION ALL SELECT merchant_id, 3, 'Checkout Started', stage_3 FROM met
    UNION ALL SELECT merchant_id, 4, 'Purchase', stage_4 FROM met) WINDOW w AS (PARTITION BY merchant_id ORDER BY stage_no)))"""


@query("mx06_conversion_funnel", "merchant_id:i stage_no:i stage:s sessions:i step_rate:r2", "SELECT * FROM fun", (*MET_CTES, FUN))
@query("wn12_funnel_step_rate", "merchant_id:i stage:s step_rate:r2", "SELECT * FROM fun", (*MET_CTES, FUN))
@query("wn13_funnel_dropoff", "merchant_id:i stage:s drop_off:r2 bar_width:r2", "SELECT * FROM fun", (*MET_CTES, FUN))
def _(spark, root):
    return MX.funnel(_week(spark, root))


@query("mx17_overall_conversion", "merchant_id:i overall_conversion:r2", "SELECT merchant_id, conversion_rate AS overall_conversion FROM met", MET_CTES)
def _(spark, root):
    return MX.overall_conversion(MX.funnel(_week(spark, root)))


@query("mx09_new_customers", "merchant_id:i new_customers:i",
       f"""SELECT merchant_id, count(*) AS new_customers FROM (SELECT merchant_id, customer_id, min(received_at) AS f FROM ev WHERE event_type = 'purchase' GROUP BY 1, 2)
           WHERE f BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '{END}' GROUP BY 1""", (Q.EVENTS,))
def _(spark, root):
    from ..operators.customers import new_customers
    bought = E.events(spark, root).filter("event_type = 'purchase'").withColumn("created_at", F.col("received_at"))
    return new_customers(bought, "2024-01-10 00:00:00", END)


@query("mx10_realtime_stats", "merchant_id:i gmv:m orders:i sessions:i visitors_now:i",
       """SELECT merchant_id, coalesce(sum(revenue) FILTER (event_type = 'purchase'), 0) AS gmv, count(DISTINCT order_id) AS orders, count(DISTINCT session_id) AS sessions,
          count(DISTINCT session_id) FILTER (received_at >= TIMESTAMP '2024-01-15 11:59:00') AS visitors_now
          FROM ev WHERE received_at BETWEEN TIMESTAMP '2024-01-15 11:55:00' AND TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1""", (Q.EVENTS,))
def _(spark, root):
    return MX.realtime(E.events(spark, root), "2024-01-15 12:00:00")


for _g, _i in (("minute", "1 MINUTE"), ("hour", "1 HOUR"), ("day", "1 DAY"), ("week", "7 DAY")):
    query(f"mx11_gmv_timeseries_{_g}", "merchant_id:i bucket:t gmv:m orders:i",
          f"""SELECT merchant_id, bucket, coalesce(gmv, 0) AS gmv, coalesce(orders, 0) AS orders FROM ((SELECT DISTINCT merchant_id FROM ev) CROSS JOIN
              (SELECT unnest(generate_series(date_trunc('{_g}', TIMESTAMP '2024-01-10 06:00:00'), date_trunc('{_g}', TIMESTAMP '2024-01-24 18:00:00'), INTERVAL {_i})) AS bucket))
              LEFT JOIN (SELECT merchant_id, date_trunc('{_g}', received_at) AS bucket, sum(revenue) AS gmv, count(DISTINCT order_id) AS orders FROM ev
                WHERE event_type = 'purchase' AND received_at BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-24 18:00:00' GROUP BY 1, 2) USING (merchant_id, bucket)""", (Q.EVENTS,))(
        lambda spark, root, g=_g: MX.timeseries(E.events(spark, root), g, "2024-01-10 06:00:00", "2024-01-24 18:00:00"))


SEG = """seg AS (SELECT merchant_id, {0} AS segment, sum(revenue) AS revenue FROM win WHERE event_type = 'purchase' GROUP BY 1, 2),
seg1 AS (SELECT *, round(CAST(revenue AS DOUBLE) / sum(revenue) OVER (PARTITION BY merchant_id) * 100, 2) AS share_pct,
  row_number() OVER (PARTITION BY merchant_id ORDER BY revenue DESC, segment) AS rn FROM seg)"""


@query("mx12_revenue_by_dimension", "merchant_id:i segment:s revenue:m share_pct:r2", "SELECT * FROM seg1", (Q.EVENTS, WIN, SEG.format("device")))
def _(spark, root):
    return MX.revenue_by(_week(spark, root), "device")


@query("mx14_traffic_sources", "merchant_id:i segment:s revenue:m share_pct:r2", "SELECT * FROM seg1", (Q.EVENTS, WIN, SEG.format("source")))
def _(spark, root):
    return MX.revenue_by(_week(spark, root), "source")


@query("tk04_top_segments", "merchant_id:i segment:s revenue:m share_pct:r2", "SELECT * FROM seg1 WHERE rn <= 2", (Q.EVENTS, WIN, SEG.format("source")))
def _(spark, root):
    return MX.revenue_by(_week(spark, root), "source", 2)


@query("tk04_top_segments_with_other", "merchant_id:i segment:s revenue:m share_pct:r2",
       """SELECT merchant_id, seg AS segment, sum(revenue) AS revenue, round(CAST(sum(revenue) AS DOUBLE) / any_value(t) * 100, 2) AS share_pct FROM (
            SELECT *, CASE WHEN rn <= 2 THEN segment ELSE 'Other' END AS seg, sum(revenue) OVER (PARTITION BY merchant_id) AS t FROM seg1) GROUP BY 1, 2""", (Q.EVENTS, WIN, SEG.format("source")))
def _(spark, root):
    return MX.revenue_by(_week(spark, root), "source", 2, other=True)


_CH = lambda n: f"CASE WHEN coalesce(p.{n}, 0) > 0 THEN round((CAST(m.{n} AS DOUBLE) - CAST(p.{n} AS DOUBLE)) / CAST(p.{n} AS DOUBLE) * 100, 2) ELSE 0 END"
SUMMARY = "SELECT m.merchant_id, m.gmv, m.orders, m.aov, m.conversion_rate, " + ", ".join(
    f"{_CH(n)} AS {n}_change_pct, CASE WHEN {_CH(n)} > 0 THEN 'up' WHEN {_CH(n)} < 0 THEN 'down' ELSE 'flat' END AS {n}_trend" for n in ("gmv", "orders", "aov", "conversion_rate")) + \
    " FROM met m LEFT JOIN pmet p USING (merchant_id)"


@query("mx13_summary_widget", "merchant_id:i gmv:m orders:i aov:r2 conversion_rate:r2 gmv_change_pct:r2 gmv_trend:s orders_change_pct:r2 orders_trend:s aov_change_pct:r2 aov_trend:s conversion_rate_change_pct:r2 conversion_rate_trend:s",
       SUMMARY, MET_CTES)
@query("wn11_period_summary", "merchant_id:i gmv:m gmv_change_pct:r2 gmv_trend:s", SUMMARY, MET_CTES)
def _(spark, root):
    return MX.summary(E.events(spark, root), END, "weekly")


@query("jb14_dashboard_snapshot", "merchant_id:i gmv:m gmv_trend:s stages:i purchase_sessions:i sources:i series_points:i series_gmv:m",
       f"""SELECT m.merchant_id, m.gmv, {_CH('gmv').join(['CASE WHEN ', ' > 0 THEN ']) + "'up' WHEN " + _CH('gmv') + " < 0 THEN 'down' ELSE 'flat' END"} AS gmv_trend, 5 AS stages, m.stage_4 AS purchase_sessions,
            s.sources, t.series_points, t.series_gmv FROM met m LEFT JOIN pmet p USING (merchant_id)
          LEFT JOIN (SELECT merchant_id, count(DISTINCT source) AS sources FROM win WHERE event_type = 'purchase' GROUP BY 1) s USING (merchant_id)
          LEFT JOIN (SELECT merchant_id, count(DISTINCT CAST(received_at AS DATE)) AS series_points, sum(revenue) AS series_gmv FROM win WHERE event_type = 'purchase' GROUP BY 1) t USING (merchant_id)""", MET_CTES)
@query("mx15_dashboard_all_merchants", "merchant_id:i gmv:m purchase_sessions:i series_points:i",
       """SELECT m.merchant_id, m.gmv, m.stage_4 AS purchase_sessions, t.series_points FROM met m
          LEFT JOIN (SELECT merchant_id, count(DISTINCT CAST(received_at AS DATE)) AS series_points FROM win WHERE event_type = 'purchase' GROUP BY 1) t USING (merchant_id)""", MET_CTES)
def _(spark, root):
    d = dashboards.snapshot(E.events(spark, root), END, "weekly")
    return d.select("merchant_id", F.col("summary.gmv").alias("gmv"), F.col("summary.gmv_trend").alias("gmv_trend"), F.size("funnel").alias("stages"),
                    F.element_at("funnel", -1)["sessions"].alias("purchase_sessions"), F.nullif(F.size("traffic"), F.lit(-1)).alias("sources"),
                    F.nullif(F.size("series"), F.lit(-1)).alias("series_points"),
                    F.aggregate("series", F.lit(0).cast("decimal(22,2)"), lambda a, x: (a + x["gmv"]).cast("decimal(22,2)")).alias("series_gmv"))


@query("mx15_realtime_and_top_products", "merchant_id:i visitors_now:i orders:i top_product:s top_revenue:m products:i",
       f"""SELECT m.merchant_id, visitors_now, r.orders, top_product, top_revenue, products FROM met m
          LEFT JOIN (SELECT merchant_id, count(DISTINCT order_id) FILTER (event_type = 'purchase') AS orders, count(DISTINCT session_id) FILTER (received_at >= TIMESTAMP '{END}' - INTERVAL 1 MINUTE) AS visitors_now
            FROM ev WHERE received_at BETWEEN TIMESTAMP '{END}' - INTERVAL 5 MINUTE AND TIMESTAMP '{END}' GROUP BY 1) r USING (merchant_id)
          LEFT JOIN (SELECT merchant_id, max(p) FILTER (rn = 1) AS top_product, max(revenue) FILTER (rn = 1) AS top_revenue, count(*) AS products FROM (
            SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY revenue DESC, p) AS rn FROM (
              SELECT merchant_id, json_extract_string(properties, '$.k') AS p, sum(revenue) AS revenue FROM win WHERE event_type = 'purchase' GROUP BY 1, 2) WHERE p IS NOT NULL) WHERE rn <= 10 GROUP BY 1) t USING (merchant_id)""", MET_CTES)
def _(spark, root):
    d = dashboards.snapshot(E.events(spark, root), END, "weekly", product_path="$.k")
    top = F.element_at("top_products", 1)
    return d.select("merchant_id", F.col("realtime.visitors_now").alias("visitors_now"), F.col("realtime.orders").alias("orders"), top["product_id"].alias("top_product"),
                    top["revenue"].alias("top_revenue"), F.nullif(F.size("top_products"), F.lit(-1)).alias("products"))


@query("mx16_metrics_long", "merchant_id:i metric_name:s value:r2 metric_window:s timestamp:t",
       f"""SELECT merchant_id, name AS metric_name, value, 'weekly' AS metric_window, TIMESTAMP '{END}' AS timestamp FROM (
           SELECT merchant_id, CAST(gmv AS DOUBLE) AS gmv, CAST(orders AS DOUBLE) AS orders, CAST(aov AS DOUBLE) AS aov, CAST(conversion_rate AS DOUBLE) AS conversion_rate,
             CAST(sessions AS DOUBLE) AS sessions, CAST(arpu AS DOUBLE) AS arpu FROM met) UNPIVOT (value FOR name IN (gmv, orders, aov, conversion_rate, sessions, arpu))""", MET_CTES)
def _(spark, root):
    return MX.long_metrics(MX.merchant_metrics(_week(spark, root)), "weekly", END)


@query("mx18_recommendation_ctr", "placement:s strategy:s impressions:i clicks:i ctr:r",
       """SELECT *, CASE WHEN impressions > 0 THEN CAST(clicks AS DOUBLE) / impressions ELSE 0 END AS ctr FROM (
          SELECT json_extract_string(properties, '$.placement') AS placement, json_extract_string(properties, '$.strategy') AS strategy,
            sum(CASE WHEN event_type = 'recommendation_view' THEN json_array_length(properties, '$.product_ids') ELSE 0 END) AS impressions, count(*) FILTER (event_type = 'recommendation_click') AS clicks
          FROM payload WHERE event_type IN ('recommendation_view','recommendation_click') GROUP BY 1, 2)""", (Q.PAYLOADS,))
def _(spark, root):
    return MX.recommendation_ctr(E.raw_payloads(spark, root))


@query("mx18_recommendation_revenue", "placement:s strategy:s impressions:i clicks:i ctr:r attributed_orders:i attributed_revenue:m",
       """SELECT r.*, coalesce(a.n, 0) AS attributed_orders, coalesce(a.revenue, 0) AS attributed_revenue FROM (
            SELECT *, CASE WHEN impressions > 0 THEN CAST(clicks AS DOUBLE) / impressions ELSE 0 END AS ctr FROM (
              SELECT json_extract_string(properties, '$.placement') AS placement, json_extract_string(properties, '$.strategy') AS strategy,
                sum(CASE WHEN event_type = 'recommendation_view' THEN json_array_length(properties, '$.product_ids') ELSE 0 END) AS impressions, count(*) FILTER (event_type = 'recommendation_click') AS clicks
              FROM payload WHERE event_type IN ('recommendation_view','recommendation_click') GROUP BY 1, 2)) r
          LEFT JOIN (SELECT json_extract_string(c.properties, '$.placement') AS placement, json_extract_string(c.properties, '$.strategy') AS strategy, count(*) AS n, sum(p.revenue) AS revenue
            FROM (SELECT user_id, received_at, TRY_CAST(json_extract_string(properties, '$.revenue') AS DECIMAL(12,2)) AS revenue FROM payload WHERE event_type = 'purchase' AND user_id IS NOT NULL) p,
              LATERAL (SELECT properties, received_at FROM payload q WHERE q.user_id = p.user_id AND q.event_type = 'recommendation_click' AND q.received_at <= p.received_at ORDER BY q.received_at DESC, q.event_id DESC LIMIT 1) c
            WHERE p.revenue > 0 AND c.received_at >= p.received_at - INTERVAL 720 HOUR GROUP BY 1, 2) a USING (placement, strategy)""", (Q.PAYLOADS,))
def _(spark, root):
    return MX.recommendation_revenue(E.raw_payloads(spark, root), hours=720)


@query("mx19_search_ctr", "query:s searches:i clicks:i avg_click_position:r ctr:r",
       """SELECT *, CASE WHEN searches > 0 THEN CAST(clicks AS DOUBLE) / searches ELSE 0 END AS ctr FROM (
          SELECT json_extract_string(properties, '$.query') AS query, count(*) FILTER (event_type = 'search') AS searches, count(*) FILTER (event_type = 'search_click') AS clicks,
            CAST(sum(CASE WHEN event_type = 'search_click' THEN CAST(json_extract_string(properties, '$.position') AS BIGINT) END) AS DOUBLE) / nullif(count(*) FILTER (event_type = 'search_click'), 0) AS avg_click_position
          FROM payload WHERE event_type IN ('search','search_click') GROUP BY 1)""", (Q.PAYLOADS,))
def _(spark, root):
    return MX.search_ctr(E.raw_payloads(spark, root))


# ------------------------------------------------------------------ alerts

HOURS = """span AS (SELECT date_trunc('hour', min(received_at)) AS first_hour, date_trunc('hour', max(received_at)) AS last_hour FROM ev),
hours AS (SELECT merchant_id, ts, coalesce(n, 0) AS value FROM ((SELECT DISTINCT merchant_id FROM ev) CROSS JOIN
  (SELECT unnest(generate_series(first_hour, last_hour, INTERVAL 1 HOUR)) AS ts FROM span))
  LEFT JOIN (SELECT merchant_id, date_trunc('hour', received_at) AS ts, count(DISTINCT order_id) AS n FROM ev WHERE event_type = 'purchase' GROUP BY 1, 2) USING (merchant_id, ts)),
checks AS (SELECT *, value = 0 AS is_breached FROM hours)"""


def _hourly_checks(spark, root):
    """The zero-orders rule at every hour that the events span, for every merchant."""
    e = E.events(spark, root)
    first, last = A.covered(E.raw_events(spark, root), "hour", "received_at")
    ts = MX.timeseries(e, "hour", first, last + timedelta(hours=1) - timedelta(microseconds=1))
    series = ts.select("merchant_id", F.lit("order_count").alias("metric_name"), F.col("bucket").alias("ts"), F.col("orders").cast("double").alias("value"))
    return A.evaluate(series, A.default_rules(spark))


@query("al01_threshold_rules", "rule_id:s merchant_id:i value:r2 threshold:r is_breached:b",
       f"""SELECT 'low_conversion' AS rule_id, merchant_id, conversion_rate AS value, 1.0 AS threshold, conversion_rate < 1.0 AS is_breached FROM dmet
          UNION ALL SELECT 'cart_abandonment', merchant_id, cart_abandonment_rate, 80.0, cart_abandonment_rate > 80.0 FROM dmet
          UNION ALL SELECT 'zero_orders', merchant_id, coalesce(orders, 0), 0.0, coalesce(orders, 0) = 0 FROM merchants LEFT JOIN hmet USING (merchant_id)
          UNION ALL SELECT 'gmv_drop', merchant_id, {_CH("gmv")}, -20.0, {_CH("gmv")} < -20.0 FROM hmet m LEFT JOIN hpmet p USING (merchant_id)
          UNION ALL SELECT 'processing_lag', merchant_id, CAST(sum(event_id % 90) AS DOUBLE) / count(*), 60.0, CAST(sum(event_id % 90) AS DOUBLE) / count(*) > 60.0
            FROM ev WHERE received_at BETWEEN TIMESTAMP '{END}' - INTERVAL 5 MINUTE AND TIMESTAMP '{END}' GROUP BY 2""",
       (Q.EVENTS, Q.MERCHANTS, f"""dwin AS (SELECT * FROM ev WHERE received_at BETWEEN TIMESTAMP '{END}' - INTERVAL 1 DAY AND TIMESTAMP '{END}'),
hwin AS (SELECT * FROM ev WHERE received_at BETWEEN TIMESTAMP '{END}' - INTERVAL 1 HOUR AND TIMESTAMP '{END}'),
hprv AS (SELECT * FROM ev WHERE received_at BETWEEN TIMESTAMP '{END}' - INTERVAL 2 HOUR AND TIMESTAMP '{END}' - INTERVAL 1 HOUR),
dmet AS ({_M.format('dwin')}), hmet AS ({_M.format('hwin')}), hpmet AS ({_M.format('hprv')})"""))
def _(spark, root):
    return A.evaluate(MX.rule_metrics(E.events(spark, root), E.merchants(spark, root), END), A.default_rules(spark))


@query("wn14_alert_transitions", "rule_id:s merchant_id:i ts:t change:s",
       """SELECT 'zero_orders' AS rule_id, merchant_id, ts, change FROM (SELECT *, CASE WHEN is_breached AND NOT was THEN 'triggered' WHEN NOT is_breached AND was THEN 'resolved' END AS change FROM (
          SELECT *, coalesce(lag(is_breached) OVER (PARTITION BY merchant_id ORDER BY ts), false) AS was FROM checks)) WHERE change IS NOT NULL""", (Q.EVENTS, HOURS))
def _(spark, root):
    return A.transitions(_hourly_checks(spark, root))


INC = """inc AS (SELECT merchant_id, run, min(ts) AS triggered_at, max(nxt) AS resolved_at, count(*) AS ticks FROM (
  SELECT *, sum(CASE WHEN is_breached AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY merchant_id ORDER BY ts) AS run FROM (
    SELECT *, coalesce(lag(is_breached) OVER w, false) AS was, lead(ts) OVER w AS nxt FROM checks WINDOW w AS (PARTITION BY merchant_id ORDER BY ts))) WHERE is_breached GROUP BY 1, 2),
inc1 AS (SELECT 'zero_orders' AS rule_id, merchant_id, triggered_at, CASE WHEN resolved_at IS NULL OR triggered_at + to_hours(ticks) > (SELECT last_hour FROM span) THEN NULL ELSE triggered_at + to_hours(ticks) END AS resolved_at, ticks FROM inc)"""


@query("jb15_alert_incidents", "rule_id:s merchant_id:i triggered_at:t resolved_at:t ticks:i", "SELECT * FROM inc1", (Q.EVENTS, HOURS, INC))
def _(spark, root):
    return A.incidents(_hourly_checks(spark, root))


@query("al03_alerts_with_cooldown", "rule_id:s merchant_id:i ts:t value:r change:s",
       """SELECT 'zero_orders' AS rule_id, merchant_id, ts, value, change FROM (SELECT *, CASE WHEN is_breached AND NOT was THEN 'triggered' WHEN NOT is_breached AND was THEN 'resolved' END AS change FROM (
          SELECT *, coalesce(lag(is_breached) OVER (PARTITION BY merchant_id ORDER BY ts), false) AS was FROM checks)) WHERE change IS NOT NULL""", (Q.EVENTS, HOURS))
def _(spark, root):
    # Hourly ticks lie further apart than the 15-minute cool-down; al03_minute_cooldown has ticks inside it.
    return A.with_cooldown(_hourly_checks(spark, root))


#: One tick per merchant and minute with events; a breach is a minute without a purchase; the cool-down is twelve hours.
MINUTES = """ticks AS (SELECT *, value = 0 AS is_breached, row_number() OVER (PARTITION BY merchant_id ORDER BY ts) AS n FROM (
  SELECT merchant_id, date_trunc('minute', received_at) AS ts, CAST(count(*) FILTER (event_type = 'purchase') AS DOUBLE) AS value FROM ev GROUP BY 1, 2))"""
COOLED = """WITH RECURSIVE seen AS (
  SELECT merchant_id, n, ts, value, is_breached AS active, CASE WHEN is_breached THEN ts END AS last_alert, CASE WHEN is_breached THEN 'triggered' END AS change FROM ticks WHERE n = 1
  UNION ALL SELECT t.merchant_id, t.n, t.ts, t.value,
    CASE WHEN s.last_alert IS NOT NULL AND t.ts < s.last_alert + INTERVAL 12 HOUR THEN s.active ELSE t.is_breached END,
    CASE WHEN NOT s.active AND t.is_breached AND (s.last_alert IS NULL OR t.ts >= s.last_alert + INTERVAL 12 HOUR) THEN t.ts ELSE s.last_alert END,
    CASE WHEN s.last_alert IS NOT NULL AND t.ts < s.last_alert + INTERVAL 12 HOUR THEN NULL WHEN t.is_breached AND NOT s.active THEN 'triggered' WHEN s.active AND NOT t.is_breached THEN 'resolved' END
  FROM seen s JOIN ticks t ON t.merchant_id = s.merchant_id AND t.n = s.n + 1)
SELECT 'quiet' AS rule_id, merchant_id, ts, value, change FROM seen WHERE change IS NOT NULL"""


def _minute_checks(spark, root):
    e = E.events(spark, root)
    ticks = e.groupBy("merchant_id", F.date_trunc("minute", "received_at").cast("timestamp_ntz").alias("ts")).agg(F.sum(F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0)).alias("value"))
    rule = spark.createDataFrame([("quiet", "Minutes without purchase", "purchases", "eq", 0.0, "realtime", "info", 720, True, None)], A.RULE_SCHEMA)
    return A.evaluate(ticks.withColumn("metric_name", F.lit("purchases")), rule)


@query("al03_minute_cooldown", "rule_id:s merchant_id:i ts:t value:r change:s", COOLED, (Q.EVENTS, MINUTES))
def _(spark, root):
    return A.with_cooldown(_minute_checks(spark, root))


@query("al05_acknowledged_alerts", "rule_id:s merchant_id:i triggered_at:t status:s acknowledged_by:s",
       """SELECT rule_id, merchant_id, triggered_at, CASE WHEN resolved_at IS NOT NULL THEN 'resolved' WHEN merchant_id % 2 = 0 THEN 'acknowledged' ELSE 'active' END AS status,
          CASE WHEN resolved_at IS NULL AND merchant_id % 2 = 0 THEN 'oncall' END AS acknowledged_by FROM inc1""", (Q.EVENTS, HOURS, INC))
def _(spark, root):
    acks = E.merchants(spark, root).filter("merchant_id % 2 = 0").select(
        F.lit("zero_orders").alias("rule_id"), "merchant_id", F.lit("oncall").alias("acknowledged_by"), F.lit(END).cast("timestamp_ntz").alias("acknowledged_at"))
    return A.acknowledge(A.incidents(_hourly_checks(spark, root)), acks)


@query("tk06_alert_history_page", "merchant_id:i triggered_at:t ticks:i",
       "SELECT merchant_id, triggered_at, ticks FROM inc1 ORDER BY triggered_at DESC, merchant_id LIMIT 50 OFFSET 20", (Q.EVENTS, HOURS, INC))
def _(spark, root):
    return A.page(A.incidents(_hourly_checks(spark, root)), F.desc("triggered_at"), F.asc("merchant_id"), limit=50, offset=20)


@query("al04_outliers", "merchant_id:i order_date:d z_score:r4 is_outlier:b",
       """SELECT merchant_id, order_date, CASE WHEN sd > 0 AND n >= 2 THEN (v - mean) / sd END AS z_score, coalesce(abs(CASE WHEN sd > 0 AND n >= 2 THEN (v - mean) / sd END) > 3, false) AS is_outlier FROM (
          SELECT merchant_id, order_date, CAST(total_gmv AS DOUBLE) AS v, avg(CAST(total_gmv AS DOUBLE)) OVER w AS mean, stddev_samp(CAST(total_gmv AS DOUBLE)) OVER w AS sd, count(*) OVER w AS n
          FROM daily WINDOW w AS (PARTITION BY merchant_id ORDER BY order_date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))""", CM.DAILY_CTES)
def _(spark, root):
    return A.outliers(CM._daily(spark, root), "total_gmv")


@query("al04_trend", "merchant_id:i order_date:d slope:r0",
       """SELECT merchant_id, order_date, CASE WHEN NOT isnan(slope) THEN slope END AS slope FROM (SELECT merchant_id, order_date, regr_slope(CAST(total_gmv AS DOUBLE), CAST(date_diff('day', DATE '1970-01-01', order_date) AS DOUBLE)) OVER (PARTITION BY merchant_id ORDER BY order_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS slope FROM daily)""", CM.DAILY_CTES)
def _(spark, root):
    return A.trend(CM._daily(spark, root), "total_gmv")


@query("al04_missing_heartbeats", "merchant_id:i hour:t",
       """SELECT merchant_id, hour FROM (SELECT DISTINCT merchant_id FROM ev), (SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS hour FROM ev)
          EXCEPT SELECT merchant_id, date_trunc('hour', ts) FROM ev""", (Q.EVENTS,))
def _(spark, root):
    e = E.events(spark, root)
    return A.missing_heartbeats(e, *A.covered(E.raw_events(spark, root)))


@query("al02_gmv_change", "merchant_id:i gmv_change_pct:r2", SUMMARY, MET_CTES)
def _(spark, root):
    return MX.summary(E.events(spark, root), END, "weekly")


@query("jb16_ingested_events", "merchant_id:i event_type:s n:i", "SELECT merchant_id, event_type, count(*) AS n FROM checked WHERE reject_code IS NULL GROUP BY 1, 2", CHECKS)
def _(spark, root):
    valid, _ = dashboards.ingest(E.raw_payloads(spark, root), ["event_id"])
    return valid.groupBy("merchant_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


