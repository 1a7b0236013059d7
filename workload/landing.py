"""Payload normalisers on payloads that Spark builds from the fixture tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions.moments import newest
from tarn.sources import landing
from tarn.sources.contracts import CONTRACTS, HOURLY_FIELDS, HOURLY_PAYLOAD, contract
from tarn.session import scratch_path
from tarn.sources.jdbc import incremental
from tarn.sources.lake import read_table, with_source_date, write_day, write_days
from tarn.sources.paths import pattern_of
from workload.tables import table

DAY = "2024-01-15"


def _show_day(df: DataFrame) -> DataFrame:
    return df.withColumn("source_date", F.date_format("source_date", "yyyy-MM-dd"))


def _case(column: str, mapping: dict[str, str | None], default: Column | None = None) -> Column:
    out = None
    for value, result in mapping.items():
        hit = F.col(column) == value
        out = (F if out is None else out).when(hit, F.lit(result))
    return out.otherwise(F.lit(None) if default is None else default)


def journal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as journal lines, some broken, some without message, unit or readable time."""
    events = table(spark, sf_dir, "events")
    line = F.to_json(
        F.struct(
            _case("event_type", {"view": "4", "signup": "6", "purchase": "3", "error": "2"}).alias("PRIORITY"),
            _case(
                "event_type", {"click": "", "signup": None}, F.concat("event_type", F.lit(".service"))
            ).alias("_SYSTEMD_UNIT"),
            _case("event_type", {"signup": "signupd", "click": ""}).alias("SYSLOG_IDENTIFIER"),
            F.when(F.col("value") < 2, "").otherwise(F.col("props")).alias("MESSAGE"),
            F.when(F.col("event_type") == "error", "bad")
            .otherwise(F.unix_micros(F.col("ts").cast("timestamp")).cast("string"))
            .alias("__REALTIME_TIMESTAMP"),
        )
    )
    return events.select(
        F.when(F.col("value") > 40, F.concat(F.lit("-- "), line)).otherwise(line).alias("value")
    )


def alert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    stamp = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    return events.select(
        F.when(F.col("event_type") == "view", F.concat(F.lit("seen "), F.col("value").cast("bigint"))).alias(
            "formatted"
        ),
        F.when(F.col("event_type") == "signup", F.col("props"))
        .when(F.col("event_type") == "view", F.lit(""))
        .alias("text"),
        F.when(F.col("event_type") == "click", F.lit("[]")).alias("args"),
        F.struct(F.when(F.col("event_type") != "signup", stamp).alias("$date")).alias("datetime"),
        F.when(F.col("event_type") == "view", "viewer").alias("source"),
        F.when(F.col("event_type") == "click", "CRITICAL").alias("level"),
    )


def journal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.normalize_journal(journal_lines(spark, sf_dir), DAY)


def journal_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.normalize_journal(landing.journal_window(journal_lines(spark, sf_dir), DAY), DAY)


def log_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = landing.build_logs(
        landing.normalize_journal(journal_lines(spark, sf_dir), DAY),
        landing.normalize_alerts(alert_rows(spark, sf_dir), DAY),
        DAY,
    )
    return _show_day(logs.drop("ingested_at"))


def activity_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payload per message with its text in an item list; first turns have no list at all."""
    activity = contract("Id string, Name string, Type string, ShortOverview string")
    shape = T.StructType().add("Items", T.ArrayType(activity))
    item = F.struct(
        F.concat_ws("-", "conv_id", "turn").alias("Id"),
        F.col("role").alias("Name"),
        F.lit("message").alias("Type"),
        F.col("text").alias("ShortOverview"),
    )
    echo = F.struct(
        F.concat_ws("-", "conv_id", "turn").alias("Id"),
        F.col("role").alias("Name"),
        F.lit("length").alias("Type"),
        F.length("text").cast("string").alias("ShortOverview"),
    )
    payload = F.to_json(F.struct(F.when(F.col("turn") > 0, F.array(item, echo)).alias("Items")))
    rows = table(spark, sf_dir, "conversations").select(F.from_json(payload, shape).alias("p")).select("p.*")
    return landing.explode_items(rows, activity)


def flatten_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = table(spark, sf_dir, "conversations").select(
        F.struct("conv_id", F.struct("turn", F.struct("role").alias("by")).alias("msg")).alias("rec"),
        F.length("text").cast("bigint").alias("size"),
    )
    return landing.flatten_struct(nested, sep="_")


def disk_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    disks = table(spark, sf_dir, "part").select(
        F.col("p_name").alias("devname"),
        F.nullif(F.col("p_brand"), F.lit("Brand#1")).alias("serial"),
        F.nullif(F.col("p_size"), F.lit(7)).alias("size"),
        F.col("p_type").alias("description"),
    )
    return landing.normalize_disks(disks).drop("rotationrate")


def hourly_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    arrays = [
        F.array(
            F.date_format(at, "yyyy-MM-dd'T'HH:mm"),
            F.date_format(at + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd'T'HH:mm"),
        ).alias("time")
    ]
    for position, name in enumerate(HOURLY_FIELDS):
        arrays.append(F.array(F.col("value"), F.col("value") + position).alias(name))
    payload = F.to_json(F.struct(F.struct(*arrays).alias("hourly")))
    rows = table(spark, sf_dir, "events").select(F.from_json(payload, HOURLY_PAYLOAD).alias("p")).select("p.*")
    return _show_day(landing.normalize_hourly(rows, 40.7128, -74.006, DAY))


def land_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").cast("string").alias("order_number"),
        F.col("o_orderstatus").alias("financial_status"),
        F.when(F.col("o_orderpriority") == "5-LOW", "n/a")
        .otherwise(F.col("o_totalprice").cast("string"))
        .alias("total_usd"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
    )
    payload = orders.select(F.to_json(F.struct("*")).alias("value"))
    rows = landing.land(payload, CONTRACTS["shop_orders"], DAY)
    shown = ("order_id", "order_number", "financial_status", "fulfillment_status", "total_usd", "created_at")
    return _show_day(rows.select(*shown, "source_date"))


# Every column of each contract, from the fixture tables; the expressions read the same in Spark and in DuckDB.
_ORDER, _LINE = "CAST(o_orderkey AS STRING)", "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING)"
CONTRACT_ROWS = {
    "charges": (
        "lineitem",
        {
            "charge_id": _LINE,
            "amount_usd": "l_extendedprice",
            "currency": "CASE WHEN l_returnflag = 'A' THEN 'usd' END",
            "status": "l_returnflag",
            "customer_id": "CAST(l_suppkey AS STRING)",
            "customer_email": "'c' || CAST(l_partkey AS STRING) || '@x'",
            "description": "l_linestatus",
            "refunded": "l_returnflag = 'R'",
            "dispute": "l_linestatus = 'O'",
            "created_at": "l_shipdate",
        },
    ),
    "subscriptions": (
        "orders",
        {
            "subscription_id": _ORDER,
            "customer_id": "CAST(o_custkey AS STRING)",
            "plan_name": "o_orderpriority",
            "interval": "CASE WHEN o_orderstatus = 'F' THEN 'month' ELSE 'year' END",
            "amount_usd": "o_totalprice",
            "status": "o_orderstatus",
            "current_period_start": "o_orderdate",
            "current_period_end": "o_orderdate + INTERVAL 30 DAYS",
            "canceled_at": "CASE WHEN o_orderstatus = 'P' THEN o_orderdate END",
            "created_at": "o_orderdate",
        },
    ),
    "shop_orders": (
        "orders",
        {
            "order_id": _ORDER,
            "order_number": "CAST(o_orderkey AS INT)",
            "email": "'c' || CAST(o_custkey AS STRING)",
            "financial_status": "o_orderstatus",
            "fulfillment_status": "CASE WHEN o_orderpriority = '1-URGENT' THEN 'fulfilled' END",
            "subtotal_usd": "o_totalprice",
            "total_discounts_usd": "o_totalprice / 4",
            "total_usd": "o_totalprice / 2",
            "line_item_count": "CAST(o_orderkey % 7 AS INT)",
            "source_name": "o_orderpriority",
            "created_at": "o_orderdate",
        },
    ),
    "shop_line_items": (
        "lineitem",
        {
            "order_id": "CAST(l_orderkey AS STRING)",
            "product_id": "CAST(l_partkey AS STRING)",
            "variant_id": "CAST(l_suppkey AS STRING)",
            "title": "'part ' || CAST(l_partkey AS STRING)",
            "sku": _LINE,
            "quantity": "CAST(l_quantity AS INT)",
            "price_usd": "l_extendedprice",
            "total_discount_usd": "l_discount",
            "fulfillable_quantity": "l_linenumber",
        },
    ),
    "deals": (
        "orders",
        {
            "deal_id": _ORDER,
            "deal_name": f"'deal ' || {_ORDER}",
            "stage": "o_orderpriority",
            "amount_usd": "o_totalprice",
            "close_date": "CAST(o_orderdate AS DATE)",
            "owner_name": "CAST(o_custkey AS STRING)",
            "pipeline": "o_orderstatus",
            "created_at": "o_orderdate",
            "last_modified_at": "o_orderdate + INTERVAL 3 DAYS",
        },
    ),
    "contacts": (
        "customer",
        {
            "contact_id": "CAST(c_custkey AS STRING)",
            "email": "CASE WHEN c_nationkey > 3 THEN c_name || '@x' END",
            "first_name": "c_mktsegment",
            "last_name": "c_name",
            "company": "CAST(c_nationkey AS STRING)",
            "lifecycle_stage": "CASE WHEN c_acctbal > 0 THEN 'customer' ELSE 'lead' END",
            "lead_source": "c_mktsegment",
            "created_at": "TIMESTAMP '2024-01-01 00:00:00'",
        },
    ),
}


def _land_contract(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        source, columns = CONTRACT_ROWS[name]
        rows = table(spark, sf_dir, source).select(*[F.expr(e).alias(c) for c, e in columns.items()])
        landed = landing.land(rows.select(F.to_json(F.struct("*")).alias("value")), CONTRACTS[name], DAY)
        return _show_day(landed)

    return query


def json_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers delivered as files of one nested object each."""
    folder = scratch_path(spark, "delivery")
    customers = table(spark, sf_dir, "customer")
    batches = customers.groupBy(F.floor(F.col("c_custkey") / 100).alias("batch")).agg(
        F.collect_list(F.struct("c_custkey", "c_name", "c_acctbal")).alias("Items")
    )
    batches.write.option("maxRecordsPerFile", 1).json(folder)
    shape = contract("c_custkey bigint, c_name string, c_acctbal double")
    payload = T.StructType([T.StructField("batch", T.LongType()), T.StructField("Items", T.ArrayType(shape))])
    return landing.explode_items(landing.read_json_folder(spark, folder, payload), shape)


def empty_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day that is loaded again without rows leaves the table as it is."""
    events = table(spark, sf_dir, "events")
    base = scratch_path(spark, "empty")
    root = write_days(events.withColumn("source_date", F.to_date("ts")), base, source="events")
    write_day(with_source_date(events, "2024-01-15").limit(0), base, "2024-01-15", source="events")
    write_day(with_source_date(events, "2031-01-01").limit(0), base, "2031-01-01", source="events")
    return read_table(spark, pattern_of(root)).groupBy("year", "month", "day").agg(F.count("*").alias("events"))


def incremental_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders past the high-water mark of a load that stopped at the end of 1999."""
    orders = table(spark, sf_dir, "orders")
    loaded = orders.where(F.col("o_orderdate") < F.lit("2000-01-01").cast(orders.schema["o_orderdate"].dataType))
    return incremental(orders, "o_orderdate", newest(loaded, "o_orderdate"))


def union_drifting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of different width under one prefix."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name")
    )
    return landing.union_files(customers, suppliers)


QUERIES = {
    "journal_rows": journal_rows,
    "journal_day": journal_day,
    "log_table": log_table,
    "activity_items": activity_items,
    "flatten_nested": flatten_nested,
    "disk_inventory": disk_inventory,
    "hourly_rows": hourly_rows,
    "land_orders": land_orders,
    **{f"land_{name}": _land_contract(name) for name in CONTRACT_ROWS},
    "json_folder": json_folder,
    "empty_day": empty_day,
    "incremental_orders": incremental_orders,
    "union_drifting": union_drifting,
}

_JOURNAL = """
    SELECT 'journal' AS log_type,
           CASE event_type WHEN 'click' THEN 'kernel' WHEN 'signup' THEN 'signupd' ELSE event_type END AS unit,
           CASE event_type WHEN 'signup' THEN '6' WHEN 'purchase' THEN 'ERROR' WHEN 'error' THEN 'CRITICAL'
                ELSE 'WARNING' END AS priority,
           CASE WHEN event_type = 'error' THEN TIMESTAMP '2024-01-15 00:00:00' ELSE ts END AS timestamp,
           props AS message
    FROM events WHERE value >= 2 AND value <= 40
"""

_ALERTS = """
    SELECT 'alert' AS log_type,
           CASE event_type WHEN 'view' THEN 'viewer' ELSE 'alert' END AS unit,
           CASE event_type WHEN 'click' THEN 'CRITICAL' ELSE 'WARNING' END AS priority,
           CASE event_type WHEN 'signup' THEN TIMESTAMP '1970-01-01 00:00:00'
                ELSE date_trunc('millisecond', ts) END AS timestamp,
           CASE event_type WHEN 'view' THEN 'seen ' || CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR)
                WHEN 'signup' THEN props ELSE '[]' END AS message
    FROM events WHERE event_type IN ('view', 'signup', 'click')
"""

_HOUR = ", ".join(f"value + {i} * hour AS {name}" for i, name in enumerate(HOURLY_FIELDS))

ORACLE = {
    "journal_rows": _JOURNAL,
    "journal_day": _JOURNAL
    + """ AND ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16'
          AND event_type NOT IN ('error', 'signup')""",
    "log_table": f"""
        WITH rows AS ({_JOURNAL} UNION ALL {_ALERTS}),
        logs AS (SELECT *, '[' || unit || '] ' || priority || ': ' || message AS content FROM rows)
        SELECT *, md5(content) AS id, '2024-01-15' AS source_date FROM logs
    """,
    "activity_items": """
        SELECT conv_id || '-' || turn AS "Id", role AS "Name", 'message' AS "Type", text AS "ShortOverview"
        FROM conversations WHERE turn > 0
        UNION ALL
        SELECT conv_id || '-' || turn, role, 'length', CAST(length(text) AS VARCHAR)
        FROM conversations WHERE turn > 0
    """,
    "flatten_nested": """
        SELECT conv_id AS rec_conv_id, turn AS rec_msg_turn, role AS rec_msg_by_role,
               length(text) AS size FROM conversations
    """,
    "disk_inventory": """
        SELECT p_name AS devname, coalesce(nullif(p_brand, 'Brand#1'), '') AS serial, '' AS model,
               CAST(coalesce(nullif(p_size, 7), 0) AS BIGINT) AS size, p_type AS description
        FROM part
    """,
    "hourly_rows": f"""
        SELECT strftime(ts + to_hours(hour), '%Y-%m-%dT%H:%M') AS timestamp, {_HOUR},
               '2024-01-15' AS source_date, 40.7128::DOUBLE AS latitude, (-74.006)::DOUBLE AS longitude
        FROM events CROSS JOIN (VALUES (0), (1)) AS h(hour)
    """,
    **{
        f"land_{name}": "SELECT "
        + ", ".join(f'{e} AS "{c}"' for c, e in columns.items())
        + f", '{DAY}' AS source_date FROM {source}"
        for name, (source, columns) in CONTRACT_ROWS.items()
    },
    "json_folder": "SELECT c_custkey, c_name, c_acctbal FROM customer",
    "empty_day": """
        SELECT strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day, count(*) AS events
        FROM events GROUP BY ALL
    """,
    "land_orders": """
        SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS INTEGER) AS order_number,
               o_orderstatus AS financial_status, CAST(NULL AS VARCHAR) AS fulfillment_status,
               CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS total_usd,
               o_orderdate AS created_at, '2024-01-15' AS source_date
        FROM orders
    """,
    "incremental_orders": """
        SELECT * FROM orders
        WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01')
    """,
    "union_drifting": """
        SELECT c_name AS name, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer
        UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier
    """,
}
