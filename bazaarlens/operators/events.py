"""Event validation, enrichment and ingestion; the same columns serve batch and streams.

Rule sets are data: each row picks up the rules of its event type as an array and
checks them with higher-order functions. JSON is parsed once per row, into VARIANT.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.guards import count_if, ratio

# Event types, classes and rule sets that results must equal.
EVENT_TYPES = (
    "page_view", "page_exit", "product_view", "product_click", "product_impression", "quick_view",
    "add_to_cart", "remove_from_cart", "cart_view", "update_cart_quantity", "begin_checkout",
    "add_shipping_info", "add_payment_info", "checkout_step", "purchase", "refund", "search",
    "search_click", "sign_up", "login", "logout", "wishlist_add", "wishlist_remove", "share",
    "review_submit", "recommendation_view", "recommendation_click", "custom",
)
CONVERSION = ("purchase", "sign_up", "add_to_cart")
ENGAGEMENT = ("product_view", "product_click", "search", "wishlist_add")
SOURCES = ("web", "ios", "android", "server", "import")
SIGN_IN_METHODS = ("email", "google", "facebook", "apple", "sso")
PLACEMENTS = ("pdp", "cart", "homepage", "category", "email", "checkout")
STRATEGIES = ("collaborative", "content_based", "popularity", "hybrid")


@dataclass(frozen=True)
class Rule:
    """Expectations on one property of one event type."""

    event_type: str
    name: str
    type: str
    required: bool = False
    min: float | None = None
    max: float | None = None
    max_length: int | None = None
    enum: tuple[str, ...] | None = None
    pattern: str | None = None


def _rules(event_type: str, *specs: tuple) -> list[Rule]:
    return [Rule(event_type, name, kind, **(extra[0] if extra else {})) for name, kind, *extra in specs]


_ID = {"required": True, "max_length": 50}
RULES: tuple[Rule, ...] = tuple(
    _rules("page_view", ("page_path", "string", {"required": True, "max_length": 500}), ("page_title", "string", {"max_length": 500}),
           ("page_url", "string", {"max_length": 2000}), ("referrer", "string"))
    + _rules("product_view", ("product_id", "string", _ID), ("product_name", "string"), ("product_sku", "string"),
             ("price", "number", {"min": 0}), ("currency", "string", {"max_length": 3}), ("category", "string"),
             ("brand", "string"), ("variant", "string"), ("position", "integer", {"min": 1}))
    + _rules("add_to_cart", ("product_id", "string", _ID), ("quantity", "integer", {"required": True, "min": 1, "max": 1000}),
             ("product_name", "string"), ("price", "number", {"min": 0}), ("currency", "string"), ("variant", "string"), ("cart_id", "string"))
    + _rules("remove_from_cart", ("product_id", "string", _ID), ("quantity", "integer", {"min": 1}), ("cart_id", "string"))
    + _rules("begin_checkout", ("cart_id", "string", {"required": True}), ("value", "number", {"min": 0}), ("currency", "string"),
             ("item_count", "integer", {"min": 1}), ("coupon", "string"))
    + _rules("purchase", ("order_id", "string", _ID), ("revenue", "number", {"required": True, "min": 0}), ("currency", "string"),
             ("tax", "number", {"min": 0}), ("shipping", "number", {"min": 0}), ("coupon", "string"), ("items", "array"), ("payment_method", "string"))
    + _rules("search", ("query", "string", {"required": True, "max_length": 500}), ("result_count", "integer", {"min": 0}),
             ("filters", "object"), ("sort", "string"), ("page", "integer", {"min": 1}))
    + _rules("search_click", ("query", "string", {"required": True}), ("product_id", "string", {"required": True}),
             ("position", "integer", {"required": True, "min": 1}), ("result_count", "integer"))
    + _rules("recommendation_view", ("placement", "string", {"required": True, "enum": PLACEMENTS}), ("product_ids", "array", {"required": True}),
             ("model_version", "string"), ("strategy", "string", {"enum": STRATEGIES}), ("source_product_id", "string"))
    + _rules("recommendation_click", ("placement", "string", {"required": True}), ("product_id", "string", {"required": True}),
             ("position", "integer", {"required": True, "min": 1}), ("model_version", "string"), ("strategy", "string"), ("source_product_id", "string"))
    + _rules("sign_up", ("method", "string", {"enum": SIGN_IN_METHODS}), ("referral_code", "string"))
    + _rules("login", ("method", "string", {"enum": SIGN_IN_METHODS}))
    + _rules("custom", ("event_name", "string", {"required": True, "max_length": 100, "pattern": "^[a-z_][a-z0-9_]*$"}))
)

PROBLEM = "struct<field:string,message:string,code:string,value:string>"
RULE_FIELDS = "field string, type string, required boolean, min double, max double, max_length int, enum array<string>, pattern string, limited boolean"
# A custom check maps (properties VARIANT, context VARIANT) to a nullable PROBLEM.
Check = Callable[[Column, Column], Column]


def problem(field_name: str, code: str, message: Column | str, value: Column | None = None) -> Column:
    return F.struct(
        F.lit(field_name).alias("field"), (F.lit(message) if isinstance(message, str) else message).alias("message"),
        F.lit(code).alias("code"), (F.lit(None).cast("string") if value is None else value.cast("string")).alias("value"))


def present_type(v: Column, name: str) -> Column:
    """VARIANT type name of a property; null when absent, ``VOID`` for JSON null."""
    return F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))


def text_of(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "string")


def number_of(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "double")


def _whole(t: Column) -> Column:
    """Integer literals; those beyond 64 bits arrive as wide DECIMAL with scale 0."""
    return (t == "BIGINT") | t.rlike(r"^DECIMAL\((19|2\d|3\d),0\)$")


def _fits(kind: Column, t: Column) -> Column:
    flag = t == "BOOLEAN"  # a boolean passes as a number, as in the host language
    return (F.when(kind == "string", t == "STRING").when(kind == "integer", _whole(t) | flag)
            .when(kind == "number", _whole(t) | flag | t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"))
            .when(kind == "boolean", flag).when(kind == "array", t.startswith("ARRAY"))
            .when(kind == "object", t.startswith("OBJECT")).otherwise(True))


def _host_name(t: Column) -> Column:
    return (F.when(t == "STRING", "str").when(_whole(t), "int").when(t == "BOOLEAN", "bool")
            .when(t.startswith("ARRAY"), "list").when(t.startswith("OBJECT"), "dict").otherwise("float"))


def _tail(field_name: Column, code: str, text: Column, value: Column | None = None) -> Column:
    return F.struct(field_name.alias("field"), text.alias("message"), F.lit(code).alias("code"),
                    (F.lit(None).cast("string") if value is None else value).alias("value"))


def _named(r: Column, *parts: Column | str) -> Column:
    return F.concat(F.lit("Field '"), r["field"], F.lit("' "), *[F.lit(x) if isinstance(x, str) else x for x in parts])


def _limits(r: Column, got: Column) -> Column:
    """Constraint problems of one filled, rightly typed field."""
    text, num = F.try_variant_get(got, "$", "string"), F.try_variant_get(got, "$", "double")
    shown = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    found = F.array(
        F.when(num < r["min"], _tail(r["field"], "below_minimum", _named(r, "must be at least ", shown(r["min"])), text))
        .when(num > r["max"], _tail(r["field"], "above_maximum", _named(r, "must be at most ", shown(r["max"])), text)),
        F.when(F.length(text) > r["max_length"], _tail(
            r["field"], "max_length_exceeded", _named(r, "exceeds max length of ", r["max_length"].cast("string")), text)),
        F.when(r["enum"].isNotNull() & ~F.array_contains(r["enum"], text), _tail(
            r["field"], "invalid_enum_value", _named(r, "must be one of: ['", F.array_join(r["enum"], "', '"), "']"), text)),
        F.when(r["pattern"].isNotNull() & ~F.rlike(text, r["pattern"]), _tail(
            r["field"], "pattern_mismatch", _named(r, "does not match pattern"), text)))
    return found


def _field_problems(x: Column) -> Column:
    """A field is absent, null, of the wrong type or subject to limits: one branch runs."""
    r, t = x["rule"], x["type"]
    absent = lambda code, tail: F.array(_tail(r["field"], code, F.concat(F.lit("Required field '"), r["field"], F.lit(tail))))
    wrong = _tail(r["field"], "invalid_type", _named(r, "should be ", r["type"], ", got ", _host_name(t)), F.try_variant_get(x["got"], "$", "string"))
    return (F.when(t.isNull(), F.when(r["required"], absent("required_field_missing", "' is missing")))
            .when(t == "VOID", F.when(r["required"], absent("required_field_null", "' cannot be null")))
            .when(~_fits(r["type"], t), F.array(wrong))
            .when(r["limited"], _limits(r, x["got"])))


def rule_readings(rules: Column, props: Column) -> Column:
    """Each rule with the value of its property and that value's VARIANT type."""
    def read(r: Column) -> Column:
        got = F.try_element_at(props, r["field"])
        return F.struct(r.alias("rule"), got.alias("got"), F.schema_of_variant(got).alias("type"))
    return F.transform(rules, read)


def rule_problems(readings: Column) -> Column:
    """All problems of a row, in rule order."""
    return F.filter(F.flatten(F.filter(F.transform(readings, _field_problems), lambda a: a.isNotNull())), lambda x: x.isNotNull())


def purchase_check(p: Column, _context: Column) -> Column:
    """Purchases name an order and a non-negative revenue."""
    return (F.when(present_type(p, "order_id").isNull(), problem("order_id", "missing_order_id", "Purchase events must have order_id"))
            .when(present_type(p, "revenue").isNull(), problem("revenue", "missing_revenue", "Purchase events must have revenue"))
            .when(number_of(p, "revenue") < 0, problem("revenue", "negative_revenue", "Revenue cannot be negative", text_of(p, "revenue"))))


def product_check(p: Column, _context: Column) -> Column:
    """Product events name a product; foreign ids are at most 50 characters long."""
    pid = text_of(p, "product_id")
    return (F.when(pid.isNull(), problem("product_id", "missing_product_id", "Product events must have product_id"))
            .when(~pid.startswith("prod_") & (F.length(pid) > 50),
                  problem("product_id", "product_id_too_long", "Product ID exceeds maximum length of 50 characters", pid)))


@dataclass(frozen=True)
class RuleBook:
    """Rule sets and custom checks; ``with_rules`` / ``with_check`` return extended copies."""

    rules: tuple[Rule, ...] = RULES
    checks: dict[str, tuple[Check, ...]] = field(default_factory=lambda: {
        "purchase": (purchase_check,), "product_view": (product_check,),
        "product_click": (product_check,), "add_to_cart": (product_check,)})

    def with_rules(self, rules: Sequence[Rule]) -> RuleBook:
        """Replace the rule sets of the event types named in ``rules``."""
        new = {r.event_type for r in rules}
        return RuleBook(tuple(r for r in self.rules if r.event_type not in new) + tuple(rules), self.checks)

    def with_check(self, event_type: str, check: Check) -> RuleBook:
        return RuleBook(self.rules, {**self.checks, event_type: (*self.checks.get(event_type, ()), check)})

    def types(self) -> list[str]:
        return sorted({r.event_type for r in self.rules})

    def rows(self) -> list[tuple]:
        number = lambda x: None if x is None else float(x)
        return [(r.event_type, r.name, r.type, r.required, number(r.min), number(r.max), r.max_length,
                 None if r.enum is None else list(r.enum), r.pattern,
                 any(x is not None for x in (r.min, r.max, r.max_length, r.enum, r.pattern))) for r in self.rules]

    def frame(self, spark: SparkSession) -> DataFrame:
        """The rules as a table."""
        return spark.createDataFrame(self.rows(), f"event_type string, {RULE_FIELDS}")

    def by_type(self, spark: SparkSession) -> DataFrame:
        """One row per event type with its rules as an array (some tens of rows)."""
        grouped: dict[str, list[tuple]] = {}
        for event_type, *rule in self.rows():
            grouped.setdefault(event_type, []).append(tuple(rule))
        fields = ", ".join(f"{n}: {t}" for n, t in (f.strip().split(" ", 1) for f in RULE_FIELDS.split(",")))
        return spark.createDataFrame(list(grouped.items()), f"_rule_type string, _rules array<struct<{fields}>>")


def _dispatch(event_type: Column, branches: dict[str, Column], default: Column) -> Column:
    expr = None
    for name, value in branches.items():
        expr = F.when(event_type == name, value) if expr is None else expr.when(event_type == name, value)
    return default if expr is None else expr.otherwise(default)


def _none_dropped(problems: Sequence[Column]) -> Column:
    if not problems:
        return F.array().cast(f"array<{PROBLEM}>")
    return F.filter(F.array(*problems), lambda x: x.isNotNull()).cast(f"array<{PROBLEM}>")


def validated(raw: DataFrame, book: RuleBook | None = None, strict: bool = True, allow_unknown: bool = False) -> DataFrame:
    """Add ``event_type`` (resolved), ``errors``, ``warnings``, ``is_valid`` and ``reject_code``.

    Needs ``merchant_id``, ``event_type``, ``properties`` and ``context`` (JSON text).
    """
    book = book or RuleBook()
    known = F.col("event_type").isin(*EVENT_TYPES)
    resolved = F.when(known, F.col("event_type")).otherwise(F.lit("custom") if allow_unknown else F.lit(None).cast("string"))
    empty = F.parse_json(F.lit("{}"))
    df = raw.withColumns({
        "_type": resolved, "_p": F.coalesce(F.try_parse_json("properties"), empty), "_c": F.coalesce(F.try_parse_json("context"), empty)})
    # The rule table is part of the program (tens of rows), so its broadcast is bounded.
    df = df.join(F.broadcast(book.by_type(raw.sparkSession)), F.col("_type") == F.col("_rule_type"), "left")
    # Each stage reads the one before by name, so nothing is evaluated per reference.
    df = df.withColumn("_props", F.try_variant_get("_p", "$", "map<string,variant>"))
    df = df.withColumn("_readings", rule_readings(F.col("_rules"), F.col("_props")))
    v, c, t, ruled = F.col("_p"), F.col("_c"), F.col("_type"), F.col("_rules").isNotNull()
    own = _dispatch(t, {name: _none_dropped([chk(v, c) for chk in checks]) for name, checks in book.checks.items()}, _none_dropped([]))
    own = F.when(ruled, own).otherwise(_none_dropped([]))
    no_rules = F.when(t.isNotNull() & ~ruled & F.lit(strict), problem(
        "event_type", "unknown_event_type", F.concat(F.lit("No schema found for event type: "), t)))
    stamp, stamp_type = text_of(c, "timestamp"), present_type(c, "timestamp")
    iso = F.regexp_replace(stamp, "Z", "+00:00").try_cast("timestamp")
    bad_stamp = F.when(ruled & (stamp_type == "STRING") & (iso.isNull() | ~stamp.rlike(r"^\d{4}-?\d{2}-?\d{2}")),
                       problem("context.timestamp", "invalid_timestamp", "Invalid timestamp format", stamp))
    found = F.when(ruled, rule_problems(F.col("_readings"))).otherwise(_none_dropped([no_rules])).cast(f"array<{PROBLEM}>")
    df = df.withColumns({
        "errors": F.concat(found, own) if strict else found,
        "warnings": _none_dropped([bad_stamp]) if strict else F.concat(_none_dropped([bad_stamp]), own)})
    reject = (F.when(F.coalesce(F.col("merchant_id").cast("string"), F.lit("")) == "", "merchant_required")
              .when(t.isNull(), "unknown_event_type").when(F.size("errors") > 0, "validation_failed"))
    return df.withColumns({"reject_code": reject, "event_type": F.coalesce(t, F.col("event_type"))}).withColumn(
        "is_valid", F.col("reject_code").isNull()).drop("_type", "_p", "_c", "_rule_type", "_rules", "_props", "_readings")


def parse_stamp(column: str) -> Column:
    """Event time from ISO text (``Z`` allowed) or from epoch seconds or milliseconds."""
    c = F.col(column).cast("string")
    num = c.try_cast("double")
    seconds = F.when(num > 1e12, num / 1000).otherwise(num)
    return F.when(num.isNotNull(), F.timestamp_seconds(seconds)).otherwise(F.regexp_replace(c, "Z", "+00:00").try_cast("timestamp"))


def enriched(valid: DataFrame, identity: Sequence[str], received_at: Column | None = None) -> DataFrame:
    """Ids, parsed time and defaults. Ids hash ``identity``, so a replay keeps them."""
    got = received_at if received_at is not None else F.col("received_at").cast("timestamp")
    key = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in identity]), 256)
    made = lambda prefix, n: F.concat(F.lit(prefix), F.left(key, F.lit(n)))
    src = F.lower(F.col("source"))
    return valid.withColumns({
        "id": made("evt_", 18), "timestamp": F.coalesce(parse_stamp("timestamp"), got), "received_at": got,
        "session_id": F.coalesce("session_id", made("sess_", 16)),
        "anonymous_id": F.coalesce("anonymous_id", made("anon_", 16)),
        "source": F.when(src.isin(*SOURCES), src).otherwise("web")})


def event_flags() -> dict[str, Column]:
    t = F.col("event_type")
    return {"is_conversion": t.isin(*CONVERSION), "is_engagement": t.isin(*ENGAGEMENT), "is_identified": F.col("user_id").isNotNull()}


def extracted(events: DataFrame) -> DataFrame:
    """Product, order and revenue out of the properties; a zero revenue falls to ``value``."""
    js = lambda path: F.get_json_object("properties", path)
    num = lambda path: js(path).try_cast("double")
    return events.withColumns({
        "product_id": js("$.product_id"), "order_id": js("$.order_id"),
        "revenue": F.coalesce(F.nullif(num("$.revenue"), F.lit(0.0)), num("$.value"))})


def ingestion_metrics(checked: DataFrame) -> DataFrame:
    """Received, accepted and rejected counts with the rejection rate, per merchant."""
    return checked.groupBy("merchant_id").agg(
        F.count(F.lit(1)).alias("events_received"), count_if(F.col("is_valid")).alias("events_validated"),
        count_if(~F.col("is_valid")).alias("events_rejected")).withColumn(
        "rejection_rate", ratio("events_rejected", "events_received"))


def geo_enriched(events: DataFrame, ranges: DataFrame, ip: str = "ip_address") -> DataFrame:
    """Country and region of an IPv4 address from non-overlapping ranges.

    Ranges are cut at /16 blocks, so the range join becomes an equi join on the
    block with a short range filter; neither side is broadcast by assumption.
    """
    octets = F.split(F.col(ip), r"\.")
    part = lambda i: F.try_element_at(octets, F.lit(i)).try_cast("bigint")
    addr = part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4)
    blocks = ranges.withColumn("_block", F.explode(F.sequence(F.floor(F.col("ip_from") / 65536), F.floor(F.col("ip_to") / 65536))))
    left = events.withColumns({"_ip": addr, "_block": F.floor(addr / 65536)})
    r = blocks.select(F.col("_block").alias("_b"), "ip_from", "ip_to", "country_code", "region")
    cond = (F.col("_block") == F.col("_b")) & (F.col("_ip") >= F.col("ip_from")) & (F.col("_ip") <= F.col("ip_to"))
    return left.join(r, cond, "left").drop("_ip", "_block", "_b", "ip_from", "ip_to")
