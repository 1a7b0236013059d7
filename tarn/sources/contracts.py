"""Declared table shapes. Landed JSON is typed against them."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
}


def contract(columns: str) -> T.StructType:
    """``"name type, name type"`` as a schema; needs no running session."""
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


def array_of(element: T.DataType) -> T.ArrayType:
    return T.ArrayType(element)


# Column names and types of the documented sources.
CONTRACTS = {
    "charges": contract(
        "charge_id string, amount_usd double, currency string, status string, customer_id string, "
        "customer_email string, description string, refunded boolean, dispute boolean, "
        "created_at timestamp"
    ),
    "subscriptions": contract(
        "subscription_id string, customer_id string, plan_name string, interval string, "
        "amount_usd double, status string, current_period_start timestamp, "
        "current_period_end timestamp, canceled_at timestamp, created_at timestamp"
    ),
    "shop_orders": contract(
        "order_id string, order_number int, email string, financial_status string, "
        "fulfillment_status string, subtotal_usd double, total_discounts_usd double, "
        "total_usd double, line_item_count int, source_name string, created_at timestamp"
    ),
    "shop_line_items": contract(
        "order_id string, product_id string, variant_id string, title string, sku string, "
        "quantity int, price_usd double, total_discount_usd double, fulfillable_quantity int"
    ),
    "deals": contract(
        "deal_id string, deal_name string, stage string, amount_usd double, close_date date, "
        "owner_name string, pipeline string, created_at timestamp, last_modified_at timestamp"
    ),
    "contacts": contract(
        "contact_id string, email string, first_name string, last_name string, company string, "
        "lifecycle_stage string, lead_source string, created_at timestamp"
    ),
    "disks": contract(
        "devname string, serial string, model string, size bigint, rotationrate int, "
        "description string"
    ),
    "activity": contract("Id string, Name string, Type string, ShortOverview string, Date string"),
    "pool": contract("id string, name string, status string, allocated bigint, free bigint"),
}

HOURLY_FIELDS = (
    "temperature_2m",
    "relative_humidity_2m",
    "precipitation",
    "wind_speed_10m",
    "wind_direction_10m",
    "apparent_temperature",
    "cloud_cover",
)

HOURLY_PAYLOAD = T.StructType().add(
    "hourly",
    T.StructType(
        [T.StructField("time", array_of(T.StringType()))]
        + [T.StructField(name, array_of(T.DoubleType())) for name in HOURLY_FIELDS]
    ),
)

JOURNAL_LINE = contract(
    "PRIORITY string, _SYSTEMD_UNIT string, SYSLOG_IDENTIFIER string, MESSAGE string, "
    "__REALTIME_TIMESTAMP string"
)

ALERT = T.StructType(
    [
        *contract("formatted string, text string, args string").fields,
        T.StructField("datetime", contract("$date string")),
        *contract("source string, level string").fields,
    ]
)
