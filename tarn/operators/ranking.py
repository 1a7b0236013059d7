"""Top rows, overall and per key."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def _order(order: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in order]


def top_rows(df: DataFrame, order: Sequence[tuple[str, bool]], n: int) -> DataFrame:
    """The first ``n`` whole rows by ``(column, ascending)`` pairs, nulls last, in that order.

    Spark's sorted limit: every task hands on at most ``n`` rows.
    """
    return df.orderBy(*_order(order)).limit(n)


def newest_rows(df: DataFrame, column: str, n: int, tie: str) -> DataFrame:
    """The ``n`` newest rows; equal dates are ordered by ``tie``."""
    return top_rows(df, [(column, False), (tie, True)], n)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the given order.

    Spark keeps one row per key and task before the shuffle, so a key that holds a third of all
    rows sends no more rows than any other key.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def top_n_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank: str = "rank",
    salts: int | None = None,
) -> DataFrame:
    """The first ``n`` rows of every group, ranked from 1.

    Two rounds: the best ``n`` of each slice of a group, then the best ``n`` of those. Before either
    shuffle each task already drops all but ``n`` rows per group (whatever ``n`` is: see
    ``windowGroupLimitThreshold`` in ``RUNTIME_CONF``), and a slice takes the rows of only some of the tasks, so
    a hot group never meets in one place before it is small. There are as many slices as the square root of the
    number of shuffle partitions, which both rounds then share evenly.
    """
    if salts is None:
        salts = math.isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    salt = F.pmod(F.spark_partition_id(), F.lit(salts))
    first = F.row_number().over(W.partitionBy(*keys, "_salt").orderBy(*order))
    final = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return (
        df.withColumn("_salt", salt)
        .withColumn(rank, first)
        .where(F.col(rank) <= n)
        .drop("_salt")
        .withColumn(rank, final)
        .where(F.col(rank) <= n)
    )


def joined_text(
    df: DataFrame, keys: Sequence[str], rank: str, text: str, sep: str = "\n", name: str = "context"
) -> DataFrame:
    """Texts of a group joined in rank order. The caller has cut the groups to a few rows."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(rank), F.col(text).alias("text"))))
    return df.groupBy(*keys).agg(F.concat_ws(sep, pairs.getField("text")).alias(name))
