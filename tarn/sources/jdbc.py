"""Incremental snapshots of a table in a relational database."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.moments import like_column


def jdbc_options(
    url: str,
    query: str,
    *,
    split_column: str | None = None,
    bounds: tuple[Any, Any] | None = None,
    partitions: int = 1,
    fetch_size: int = 10_000,
    **connection: str,
) -> dict[str, str]:
    """Reader options; with a split column the read runs as ``partitions`` range queries."""
    options = {
        "url": url,
        "dbtable": f"({query}) AS snapshot",
        "fetchsize": str(fetch_size),
        **connection,
    }
    if split_column is not None:
        if bounds is None:
            raise ValueError("a split column needs its lower and upper bound")
        options |= {
            "partitionColumn": split_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def jdbc_split(
    spark: SparkSession, url: str, query: str, split_column: str, rows_per_partition: int = 1_000_000, **connection: str
) -> dict[str, str]:
    """Reader options for parallel range queries; the database is asked once for the bounds and the number of rows.

    An empty result is read by one query.
    """
    asked = f"SELECT min({split_column}) AS low, max({split_column}) AS high, count(*) AS n FROM ({query}) AS snapshot"
    span = spark.read.format("jdbc").options(url=url, query=asked, **connection).load().first()
    low, high, rows = tuple(span)
    if not rows or low is None:
        return jdbc_options(url, query, **connection)
    partitions = max(1, -(-int(rows) // rows_per_partition))
    return jdbc_options(url, query, split_column=split_column, bounds=(low, high), partitions=partitions, **connection)


def jdbc_table(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(**options).load()


def incremental(rows: DataFrame, column: str, last_max: Any | None) -> DataFrame:
    """Rows past the high-water mark of the previous load; all rows at the first load.

    A plain comparison with a literal, so Spark sends it to the database.
    """
    if last_max is None:
        return rows
    return rows.where(F.col(column) > like_column(rows, column, last_max))


def jdbc_incremental(
    spark: SparkSession, options: dict[str, str], column: str, last_max: Any | None
) -> DataFrame:
    return incremental(jdbc_table(spark, options), column, last_max)
