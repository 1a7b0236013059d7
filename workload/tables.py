"""Fixture tables, and the same rows seen through the business contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as charges."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("charge_id"),
        F.col("l_extendedprice").alias("amount_usd"),
        F.when(F.col("l_returnflag") == "R", "failed").otherwise("succeeded").alias("status"),
        (F.col("l_returnflag") == "R").alias("refunded"),
        (F.col("l_linestatus") == "O").alias("dispute"),
        F.col("l_shipdate").alias("created_at"),
    )


def shop_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderkey").alias("order_number"),
        F.concat(F.lit("c"), F.col("o_custkey")).alias("email"),
        F.when(F.col("o_orderstatus") == "F", "paid").otherwise("pending").alias("financial_status"),
        F.col("o_totalprice").alias("total_usd"),
        F.col("o_orderpriority").alias("source_name"),
        F.col("o_orderdate").alias("created_at"),
    )


def order_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("deal_id"),
        F.col("o_orderpriority").alias("stage"),
        F.col("o_totalprice").alias("amount_usd"),
    )
