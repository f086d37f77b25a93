"""Tier, RFM, segment and churn step functions.

Thresholds are plain data; one builder turns a descending ladder into a CASE.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .guards import col

# Tier cut-offs, scores and risks that results must equal.
CUSTOMER_TIERS = (("platinum", 5000), ("gold", 1000), ("silver", 250))
MERCHANT_TIERS = (("platinum", 2_000_000), ("gold", 500_000), ("silver", 100_000))
LEGACY_TIERS = (("platinum", "tier1"), ("gold", "tier2"), ("silver", "tier3"), ("bronze", "tier4"))
RECENCY_DAYS = ((5, 7), (4, 30), (3, 90), (2, 180))
FREQUENCY_ORDERS = ((5, 10), (4, 5), (3, 3), (2, 2))
MONETARY_LTV = ((5, 1000), (4, 500), (3, 200), (2, 50))
FREQUENCY_PER_MONTH = ((5, 2.0), (4, 1.0), (3, 0.5), (2, 0.25))
MONETARY_AOV = ((5, 200), (4, 100), (3, 50), (2, 25))
CHURN_RISK_DAYS = ((0.95, 365), (0.75, 180), (0.50, 90), (0.25, 30))
LIFECYCLE_MONTHS = (("new", 3), ("developing", 12), ("established", 24))


def at_least(value: Column | str, ladder: Sequence[tuple], default) -> Column:
    """First label whose threshold is ``<= value``; null falls to ``default``."""
    v, expr = col(value), None
    for label, floor in ladder:
        cond = v >= F.lit(floor)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def at_most(value: Column | str, ladder: Sequence[tuple], default) -> Column:
    v, expr = col(value), None
    for label, ceiling in ladder:
        cond = v <= F.lit(ceiling)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def over(value: Column | str, ladder: Sequence[tuple], default) -> Column:
    v, expr = col(value), None
    for label, floor in ladder:
        cond = v > F.lit(floor)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def below(value: Column | str, ladder: Sequence[tuple], default) -> Column:
    v, expr = col(value), None
    for label, ceiling in ladder:
        cond = v < F.lit(ceiling)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def customer_tier(ltv: Column | str) -> Column:
    return at_least(ltv, CUSTOMER_TIERS, "bronze")


def merchant_tier(gmv: Column | str, basis: str = "annual_12m") -> Column:
    """Merchant tier; ``monthly_avg`` reads the ladder against gmv/12 annualised."""
    g = col(gmv).cast("double")
    if basis == "annual_12m":
        return at_least(g, MERCHANT_TIERS, "bronze")
    if basis in ("monthly_avg", "mtd"):
        value = g / F.lit(12.0) if basis == "monthly_avg" else g
        return at_least(value, MERCHANT_TIERS, "bronze")
    raise ValueError(f"unknown tier basis {basis!r}")


def legacy_tier(tier: Column | str) -> Column:
    pairs = [F.lit(x) for pair in LEGACY_TIERS for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), col(tier)), F.lit("tier4"))


def tier_from_legacy(label: Column | str) -> Column:
    pairs = [F.lit(x) for tier, old in LEGACY_TIERS for x in (old, tier)]
    return F.element_at(F.create_map(*pairs), col(label))


def recency_score(days: Column | str) -> Column:
    return at_most(days, RECENCY_DAYS, 1)


def frequency_score(orders: Column | str) -> Column:
    return at_least(orders, FREQUENCY_ORDERS, 1)


def monetary_score(ltv: Column | str) -> Column:
    return at_least(ltv, MONETARY_LTV, 1)


def churn_risk(days: Column | str) -> Column:
    return over(days, CHURN_RISK_DAYS, 0.10)


def lifecycle_stage(months: Column | str) -> Column:
    return below(months, LIFECYCLE_MONTHS, "mature")


def rfm_segment(r: Column | str, f: Column | str, m: Column | str) -> Column:
    r, f, m = col(r), col(f), col(m)
    rules = (
        ("champion", (r >= 4) & (f >= 4) & (m >= 4)),
        ("loyal", (f >= 4) & (r >= 3)),
        ("promising", (r >= 4) & (f <= 2)),
        ("at_risk", (r <= 2) & (f >= 3)),
        ("hibernating", (r <= 2) & (f <= 2)),
        ("needs_attention", (r == 3) & (f == 3)),
    )
    return F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in rules], F.lit("regular"))


def activity_segment(
    first_at: Column, last_at: Column, ltv: Column, orders: Column, asof: Column,
    at_risk_days: int = 90, churn_days: int = 180, active_days: int = 90,
) -> Column:
    """new / vip / active / at_risk / churned, in that order of precedence.

    The default bands leave ``at_risk`` empty, as the published model does;
    ``at_risk_days=180`` gives the documented 90..180 band.
    """
    since_first, since_last = F.datediff(asof, first_at), F.datediff(asof, last_at)
    return (
        F.when(since_first <= 30, "new")
        .when((ltv >= 5000) & (orders >= 10), "vip")
        .when(since_last <= active_days, "active")
        .when(since_last <= at_risk_days, "at_risk")
        .when(since_last > churn_days, "churned")
        .otherwise("active")
    )


def order_status_category(status: Column | str) -> Column:
    s = col(status)
    return (
        F.when(s.isin("delivered", "shipped"), "fulfilled")
        .when(s.isin("cancelled", "refunded"), "cancelled")
        .when(s.isin("pending", "confirmed", "processing"), "in_progress")
        .otherwise("other")
    )


def channel_grouping(source: Column | str, medium: Column | str) -> Column:
    s, m = col(source), col(medium)
    return (
        F.when((s == "direct") | s.isNull(), "Direct")
        .when(m == "cpc", "Paid Search")
        .when(m == "organic", "Organic Search")
        .when(s.like("%facebook%") | s.like("%instagram%"), "Paid Social")
        .when(m == "email", "Email")
        .when(m == "referral", "Referral")
        .otherwise("Other")
    )
