"""Column contracts of the raw and mart tables (fixed values; ``!`` marks required)."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bool": T.BooleanType(), "date": T.DateType(), "ts": T.TimestampType(),
    "d10": T.DecimalType(10, 2), "d12": T.DecimalType(12, 2), "d14": T.DecimalType(14, 2), "rate": T.DecimalType(5, 4), "pct": T.DecimalType(8, 2),
}


def contract(text: str) -> T.StructType:
    """Schema from ``name:type`` words."""
    out = T.StructType()
    for word in text.split():
        name, kind = word.split(":")
        out.add(name, _TYPES[kind.rstrip("!")], not kind.endswith("!"))
    return out


RAW_ORDERS = contract("""
    order_id:string! merchant_id:string! customer_id:string! status:string! channel:string utm_source:string utm_medium:string utm_campaign:string
    subtotal:d12! discount_amount:d10 tax_amount:d10 shipping_amount:d10 total_amount:d12! currency:string item_count:int coupon_code:string
    promotion_id:string is_first_order:bool is_gift:bool risk_score:int created_at:ts! updated_at:ts confirmed_at:ts shipped_at:ts delivered_at:ts""")
RAW_ORDER_ITEMS = contract("""
    order_item_id:string! order_id:string! product_id:string! merchant_id:string! product_name:string product_sku:string variant_id:string quantity:int!
    unit_price:d10! discount_amount:d10 tax_amount:d10 line_subtotal:d12 total_amount:d12! fulfillment_status:string unit_cost:d10 created_at:ts!""")
FACT_ORDERS = contract("""
    order_id:string! merchant_id:string! customer_id:string! status:string! channel:string order_date:date! created_at:ts! subtotal:d12! discount_amount:d10
    tax_amount:d10 shipping_amount:d10 total_amount:d12! gmv:d12! nmv:d12 item_count:int unique_products:int avg_item_price:d10 customer_tier:string
    customer_ltv_at_order:d12 is_first_order:bool days_since_prev_order:int order_hour:int order_day_of_week:int order_week:int order_month:int
    order_quarter:int order_year:int is_weekend:bool utm_source:string utm_medium:string utm_campaign:string _loaded_at:ts!""")
AGG_DAILY_GMV = contract("""
    merchant_id:string! order_date:date! total_gmv:d14 total_nmv:d14 total_revenue:d14 order_count:int total_items_sold:int avg_order_value:d10
    unique_customers:int new_customers:int returning_customers:int new_customer_rate:rate gmv_dod_change:pct gmv_wow_change:pct gmv_7d_rolling:d14
    gmv_30d_rolling:d14 _loaded_at:ts!""")
