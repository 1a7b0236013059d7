"""Report queries over the fixture tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import money
from tarn.functions.moments import newest
from tarn.plans import reports
from workload.tables import charges, order_deals, shop_orders, table

CLOSED = ("1-URGENT", "5-LOW")


def recent_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("charge_id"),
        F.col("o_totalprice").alias("amount_usd"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("created_at"),
    )
    return reports.recent_charges(orders)


def top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Units are summed per part before the join, so the join never carries single line items.
    sold = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.sum("l_quantity").alias("quantity")
    )
    part = table(spark, sf_dir, "part")
    items = sold.join(part, sold.l_partkey == part.p_partkey).select(
        F.col("p_name").alias("title"), "quantity", F.col("p_retailprice").alias("price_usd")
    )
    return reports.top_products(items)


def deals_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.deals_by_stage(order_deals(spark, sf_dir), CLOSED)


def open_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.open_deals(order_deals(spark, sf_dir), CLOSED)


def embedding_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return reports.embedding_count(vectors.select(F.col("label").cast("string").alias("source")))


def mrr_by_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    return reports.mrr_by_plan(
        customers.select(
            F.col("c_mktsegment").alias("plan_name"),
            F.when(F.col("c_acctbal") > 0, "active").otherwise("canceled").alias("status"),
            F.col("c_acctbal").alias("amount_usd"),
        )
    )


def daily_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = charges(spark, sf_dir)
    return reports.daily_revenue(rows, newest(rows, "created_at"))


def monthly_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    subscriptions = items.join(orders, items.l_orderkey == orders.o_orderkey).select(
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("l_returnflag") == "N", "active").otherwise("canceled").alias("status"),
        F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("canceled_at"),
    )
    return reports.monthly_churn(subscriptions, newest(orders, "o_orderdate"))


def top_products_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    line_items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price_usd"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("total_discount_usd"),
    )
    products = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("title")
    )
    orders = shop_orders(spark, sf_dir)
    return reports.top_products_net(line_items, orders, newest(orders, "created_at"), products=products)


def aov_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = shop_orders(spark, sf_dir)
    return reports.aov_by_source(orders, newest(orders, "created_at"))


def stale_unfulfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = shop_orders(spark, sf_dir)
    shipped = (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_linestatus") == "F")
        .select(F.col("l_orderkey").alias("order_id"))
        .distinct()
        .withColumn("fulfillment_status", F.lit("fulfilled"))
    )
    return reports.stale_unfulfilled(
        orders.join(shipped, "order_id", "left"), newest(orders, "created_at")
    )


def win_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    deals = items.join(orders, items.l_orderkey == orders.o_orderkey).select(
        F.col("l_suppkey").alias("owner_name"),
        F.col("l_returnflag").alias("stage"),
        F.col("o_orderdate").alias("created_at"),
        F.col("l_shipdate").alias("last_modified_at"),
    )
    return reports.win_rate(deals, won="A", lost="R")


def new_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    contacts = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("lead_source"), F.col("ts").alias("created_at")
    )
    return reports.new_contacts(contacts, newest(contacts, "created_at"))


def signups_vs_won(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderdate").alias("created_at"),
    )
    deals = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("deal_id"), F.col("l_returnflag").alias("stage")
    )
    return reports.signups_vs_won(users, deals, "order_id", "deal_id", won="R")


def orders_by_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    weather = table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias("timestamp"),
        (F.col("l_quantity") / 100).alias("precipitation"),
    )
    return reports.orders_by_weather(shop_orders(spark, sf_dir), weather)


def micro_fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts far below a cent count as they are."""
    fee = F.col("l_partkey") * F.lit(0.00000049)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        money.total(fee).alias("fees"), money.mean(fee, 6).alias("mean_fee")
    )


QUERIES = {
    "recent_charges": recent_charges,
    "top_products": top_products,
    "deals_by_stage": deals_by_stage,
    "embedding_count": embedding_count,
    "mrr_by_plan": mrr_by_plan,
    "daily_revenue": daily_revenue,
    "monthly_churn": monthly_churn,
    "top_products_net": top_products_net,
    "aov_by_source": aov_by_source,
    "stale_unfulfilled": stale_unfulfilled,
    "open_deals": open_deals,
    "win_rate": win_rate,
    "new_contacts": new_contacts,
    "signups_vs_won": signups_vs_won,
    "orders_by_weather": orders_by_weather,
    "micro_fees": micro_fees,
}

ORACLE = {
    "micro_fees": """
        SELECT l_returnflag, CAST(round(sum(l_partkey * 0.00000049::DECIMAL(18,8)), 2) AS DOUBLE) AS fees,
               round(CAST(sum(l_partkey * 0.00000049::DECIMAL(18,8)) AS DOUBLE) / count(*), 6) AS mean_fee
        FROM lineitem GROUP BY 1
    """,
    "recent_charges": """
        SELECT o_orderkey AS charge_id, o_totalprice AS amount_usd, o_orderstatus AS status,
               o_custkey AS customer_id, o_orderdate AS created_at
        FROM orders ORDER BY created_at DESC, charge_id LIMIT 20
    """,
    "top_products": """
        SELECT p_name AS title, CAST(sum(l_quantity) AS BIGINT) AS units,
               CAST(round(sum(CAST(p_retailprice * l_quantity AS DECIMAL(18,2))), 2) AS DOUBLE) AS revenue
        FROM lineitem JOIN part ON l_partkey = p_partkey
        GROUP BY 1 ORDER BY revenue DESC, title LIMIT 20
    """,
    "deals_by_stage": """
        SELECT o_orderpriority AS stage, count(*) AS deals,
               CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,2))), 2) AS DOUBLE) AS value
        FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')
        GROUP BY 1 ORDER BY value DESC
    """,
    "embedding_count": """
        SELECT CAST(label AS VARCHAR) AS source, count(*) AS cnt
        FROM embeddings GROUP BY 1 ORDER BY cnt DESC
    """,
    "mrr_by_plan": """
        SELECT c_mktsegment AS plan_name, count(*) AS active_subscribers,
               CAST(round(sum(CAST(c_acctbal AS DECIMAL(18,2))), 2) AS DOUBLE) AS mrr_usd
        FROM customer WHERE c_acctbal > 0 GROUP BY 1 ORDER BY mrr_usd DESC
    """,
    "daily_revenue": """
        SELECT date_trunc('day', l_shipdate) AS day,
               CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18,2)))
                   FILTER (WHERE l_returnflag <> 'R'), 2) AS DOUBLE) AS gross_revenue,
               CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18,2)))
                   FILTER (WHERE l_returnflag = 'R'), 2) AS DOUBLE) AS refunds,
               count(*) FILTER (WHERE l_linestatus = 'O') AS disputes
        FROM lineitem
        WHERE l_shipdate >= (SELECT date_trunc('day', max(l_shipdate)) FROM lineitem) - INTERVAL 30 DAYS
        GROUP BY 1 ORDER BY 1
    """,
    "monthly_churn": """
        SELECT date_trunc('month', o_orderdate) AS month,
               count(*) FILTER (WHERE l_returnflag = 'N') AS new_subs,
               count(*) FILTER (WHERE l_returnflag = 'R' AND date_trunc('month', l_shipdate) =
                   (SELECT date_trunc('month', max(o_orderdate)) FROM orders)) AS canceled
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey
        GROUP BY 1 ORDER BY 1 DESC LIMIT 6
    """,
    "top_products_net": """
        SELECT p_name AS title, CAST(sum(l_quantity) AS BIGINT) AS units_sold,
               CAST(round(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))), 2) AS DOUBLE)
                   AS net_revenue
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        WHERE o_orderdate >= (SELECT date_trunc('quarter', max(o_orderdate)) FROM orders)
        GROUP BY 1 ORDER BY net_revenue DESC, title LIMIT 20
    """,
    "aov_by_source": """
        SELECT o_orderpriority AS source_name, count(*) AS orders,
               round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 2)
                   AS avg_order_value,
               CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,2))), 2) AS DOUBLE) AS total_revenue
        FROM orders
        WHERE o_orderstatus = 'F'
          AND o_orderdate >= (SELECT date_trunc('day', max(o_orderdate)) FROM orders) - INTERVAL 90 DAYS
        GROUP BY 1 ORDER BY total_revenue DESC
    """,
    "stale_unfulfilled": """
        SELECT o_orderkey AS order_id, o_orderkey AS order_number,
               'c' || CAST(o_custkey AS VARCHAR) AS email, o_totalprice AS total_usd,
               o_orderdate AS created_at
        FROM orders
        WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F')
          AND o_orderstatus = 'F'
          AND o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 48 HOURS
        ORDER BY created_at, order_id
    """,
    "open_deals": """
        SELECT o_orderpriority AS stage, count(*) AS deals,
               CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,2))), 2) AS DOUBLE) AS total_value,
               round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 2)
                   AS avg_deal_size
        FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')
        GROUP BY 1 ORDER BY total_value DESC
    """,
    "win_rate": """
        SELECT l_suppkey AS owner_name,
               count(*) FILTER (WHERE l_returnflag = 'A') AS won,
               count(*) FILTER (WHERE l_returnflag = 'R') AS lost,
               round(count(*) FILTER (WHERE l_returnflag = 'A') * CAST(100 AS DOUBLE) / count(*), 1)
                   AS win_rate_pct,
               round(avg((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1000000.0 / 86400.0)
                   FILTER (WHERE l_returnflag = 'A'), 0) AS avg_cycle_days
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE l_returnflag IN ('A', 'R') GROUP BY 1 ORDER BY won DESC, owner_name
    """,
    "new_contacts": """
        SELECT event_type AS lead_source, count(*) AS new_contacts FROM events
        WHERE ts >= (SELECT date_trunc('month', max(ts)) FROM events)
        GROUP BY 1 ORDER BY new_contacts DESC
    """,
    "signups_vs_won": """
        SELECT date_trunc('week', o_orderdate) AS week, count(DISTINCT o_custkey) AS signups,
               count(DISTINCT l_orderkey) AS closed_won
        FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'R'
        GROUP BY 1 ORDER BY 1 DESC LIMIT 12
    """,
    "orders_by_weather": """
        WITH w AS (
            SELECT date_trunc('day', l_shipdate) AS date,
                   CAST(sum(CAST(l_quantity / 100 AS DECIMAL(18,4))) AS DOUBLE) AS precipitation_sum
            FROM lineitem GROUP BY 1
        )
        SELECT round(precipitation_sum, 0) AS rain_mm, count(o_orderkey) AS orders,
               round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(o_totalprice), 2)
                   AS avg_order_value
        FROM orders JOIN w ON date_trunc('day', o_orderdate) = w.date
        GROUP BY 1 ORDER BY 1
    """,
}
