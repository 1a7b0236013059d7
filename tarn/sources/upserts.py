"""Stored tables that are kept up to date: upserts by day, and loads that remember where they stopped."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions.moments import like_column
from tarn.operators.ranking import first_per_key
from tarn.session import cut_lineage, remove_path, scratch_path
from tarn.sources.lake import is_absent, read_table
from tarn.sources.paths import PARTITIONS, table_root

STAGED = "_staged"
READY = "_READY"
MARKS = "_marks"
#: The partition a key leaves.
LOST = [f"_lost_{name}" for name in PARTITIONS]
#: A day that is rewritten is cut into parts of so many bytes of Parquet.
PART_BYTES = 32 << 20
#: The keys of smaller batches go to all stored rows.
SMALL_BATCH = 1 << 20
#: Folders that the driver moves at a time.
THREADS = 8


def _files(spark: SparkSession, path: str):
    """A path and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    where, files = _files(spark, path)
    return files.exists(where)


def _with_day(df: DataFrame, day: str) -> DataFrame:
    parts = zip(PARTITIONS, ("yyyy", "MM", "dd"))
    return df.withColumns({name: F.date_format(day, fmt) for name, fmt in parts})


def _day() -> Column:
    """A row's day from its partition columns alone, so that a filter on it opens only those folders."""
    return F.concat_ws("-", *PARTITIONS)


def stored_rows(spark: SparkSession, root: str, merge_schema: bool = False) -> DataFrame | None:
    """The rows of a table, or nothing if none was written yet."""
    try:
        return read_table(spark, root, merge_schema)
    except AnalysisException as problem:
        if not is_absent(problem):
            raise
        return None


def upsert_days(
    batch: DataFrame, root: str, key: Sequence[str], version: Sequence[str], day: str = "source_date", day_of_key: bool = False
) -> list[str]:
    """Bring ``batch`` into the day-partitioned table at ``root``, one row per ``key``; returns the days that were rewritten.

    The row with the greatest ``version`` columns (in this order, nulls lowest) stays; of equal ones the stored row does, within a
    batch the one with the smallest other columns. A row whose ``day`` changed moves. Null keys are equal to each other; rows
    without a day lie in a folder of their own. Late rows go to their old day like any others.

    Copy on write: keys and versions alone tell which rows of the batch win, and only the days that win or lose
    rows are read whole and written anew; others keep their files. The batch is read once and shuffled by key once, where the stored keys meet it;
    only the rows that win are stored, with the day their key leaves. Old rows, winners and left keys then share one shuffle, by day and
    part of a day, which is also how the files are cut. Where Spark knows the batch to be small, its keys pick the stored ones first, and
    stored rows are sorted by no one. With ``day_of_key`` (a key never changes its day) only the days of the batch are looked at, else the key
    columns of the table.

    The new days are written beside the table first. Once they are complete they are moved into place day by day, and a run
    that dies in between is finished by the next one (see ``recover``); a day that is being moved may be missing until
    then. Running the same batch again changes nothing. One writer at a time.
    """
    spark, key, version = batch.sparkSession, list(key), list(version)
    recover(spark, root)
    others = [f.name for f in batch.schema.fields if f.name not in (*key, *version) and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    order = [F.col(f"`{c}`").desc_nulls_last() for c in version if c not in key] + [F.col(f"`{c}`") for c in others] or [F.lit(0)]
    staged, stored = f"{root}/{STAGED}", stored_rows(spark, root)
    if stored is None:
        rows = _with_day(first_per_key(batch, key, order), day)
        rows.hint("rebalance", *PARTITIONS).write.mode("overwrite").partitionBy(*PARTITIONS).parquet(f"{staged}/rows")
        days = {r[0] for r in spark.read.schema(rows.schema).parquet(f"{staged}/rows").select(_day()).distinct().collect()}
        filled = days
    else:
        won, path = _winners(batch, stored, key, version, order, day, day_of_key)
        counts = {r[0]: r[1] for r in won.groupBy(_day()).count().collect()}
        lost = {r[0] for r in won.where("_met").select(F.concat_ws("-", *LOST)).distinct().collect()}
        days = lost | set(counts)
        if days:
            width = _bytes(spark, path) / sum(counts.values())
            parts = [(d, 1 + int(_bytes(spark, f"{root}/{_day_path(d)}") + counts.get(d, 0) * width) // PART_BYTES) for d in sorted(days)]
            rows = _rewritten(stored.where(_day().isin(sorted(days))), won, key, spark.createDataFrame(parts, "_day string, _parts long"))
            rows.write.mode("overwrite").partitionBy(*PARTITIONS).parquet(f"{staged}/rows")
            # Days that only lose rows may have become empty.
            filled = days if days == set(counts) else {r[0] for r in spark.read.parquet(f"{staged}/rows").select(_day()).distinct().collect()}
    if not days:
        remove_path(spark, staged)
        return []
    plan = [(d, d in filled) for d in sorted(days)]
    spark.createDataFrame(plan, "day string, filled boolean").coalesce(1).write.mode("overwrite").parquet(f"{staged}/days")
    where, files = _files(spark, f"{staged}/{READY}")
    files.create(where, True).close()
    recover(spark, root)
    return sorted(days)


def _winners(
    batch: DataFrame, stored: DataFrame, key: list[str], version: list[str], order: list[Column], day: str, day_of_key: bool
) -> tuple[DataFrame, str]:
    """Rows of the batch that are new or newer than the stored ones of their key, and where they are kept.

    ``_met`` tells whether the key is stored, ``LOST`` on which day. A key that is stored several times gives one
    row for each; all but one are marked ``_again``.
    """
    spark, columns, looked_at = batch.sparkSession, [c for c in batch.columns if c not in PARTITIONS], stored
    if day_of_key:
        days = [r[0] for r in _with_day(batch.select(day), day).select(_day()).distinct().collect()]
        looked_at = stored.where(_day().isin(days))
    # As one column keys are equal where nulls are, and the shuffle that finds the first row per key serves the join.
    whole = F.struct(*[F.col(f"`{c}`") for c in key]).alias("_key")
    first = first_per_key(batch.select(whole, *[F.col(f"`{c}`") for c in columns if c not in key]), ["_key"], order)
    offered = F.struct(*[(F.col("_key").getField(c) if c in key else F.col(f"`{c}`")).alias(c) for c in version])
    held = F.struct(*[F.col(f"`{c}`").alias(c) for c in version])
    looked_at = looked_at.select(whole, held.alias("_held"), *[F.col(p).alias(lost) for p, lost in zip(PARTITIONS, LOST)])
    if _known_small(batch):
        first = cut_lineage(first)
        looked_at = cut_lineage(looked_at.join(first.select("_key"), "_key", "left_semi"))
    copies = W.partitionBy("_key").orderBy(*LOST)
    best = F.max("_held").over(copies.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    looked_at = looked_at.withColumns({"_held": best, "_again": F.row_number().over(copies) > 1})
    met = first.join(looked_at, "_key", "left").where(F.col("_held").isNull() | (offered > F.col("_held")))
    won = _with_day(met.withColumns({c: F.col("_key").getField(c) for c in key}), day)
    marks = F.col("_held").isNotNull().alias("_met"), F.coalesce("_again", F.lit(False)).alias("_again")
    won = won.select(*[F.col(f"`{c}`") for c in columns], *PARTITIONS, *LOST, *marks)
    path = scratch_path(spark, "won")
    won.write.parquet(path)
    return spark.read.schema(won.schema).parquet(path), path


def _rewritten(old: DataFrame, won: DataFrame, key: list[str], parts: DataFrame) -> DataFrame:
    """The touched days as they will be: old rows whose key does not leave their day, and the winners.

    ``parts`` (``_day, _parts``) tells into how many parts a day is cut; a part is in one task, and is one file.
    """
    left = won.where("_met").select(*[F.col(f"`{c}`") for c in key], *[F.col(lost).alias(p) for p, lost in zip(PARTITIONS, LOST)])
    new = won.where("NOT _again").drop(*LOST, "_met", "_again")
    kinds = (old.withColumn("_kind", F.lit("old")), new.withColumn("_kind", F.lit("new")), left.withColumn("_kind", F.lit("left")))
    rows = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kinds)
    keys = [F.col(f"`{c}`") for c in key]
    rows = rows.withColumn("_day", _day()).join(F.broadcast(parts), "_day")
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(*keys), "_parts")).drop("_day", "_parts").repartition(*PARTITIONS, "_part")
    leaves = F.max(F.col("_kind") == "left").over(W.partitionBy(*PARTITIONS, "_part", *keys))
    rows = rows.withColumn("_leaves", leaves).where((F.col("_kind") == "new") | ((F.col("_kind") == "old") & ~F.col("_leaves")))
    return rows.drop("_kind", "_part", "_leaves")


def _known_small(df: DataFrame) -> bool:
    """Whether Spark's own estimate of its Parquet bytes, often too high, says that a batch is small."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= SMALL_BATCH


def _bytes(spark: SparkSession, path: str) -> int:
    where, files = _files(spark, path)
    return files.getContentSummary(where).getLength() if files.exists(where) else 0


def _day_path(day: str) -> str:
    parts = day.split("-") if day else ["__HIVE_DEFAULT_PARTITION__"] * len(PARTITIONS)
    return "/".join(f"{name}={value}" for name, value in zip(PARTITIONS, parts))


def _folder(root: str, day: str) -> str:
    return f"{root}/{_day_path(day)}"


def recover(spark: SparkSession, root: str) -> bool:
    """Finish an upsert whose new days are complete but not all in place; drop the remains of one that is not complete.

    Every step may be repeated: a day that was moved is no longer beside the table, and one that has become empty is removed again.
    """
    staged = f"{root}/{STAGED}"
    if not _exists(spark, staged):
        return False
    complete = _exists(spark, f"{staged}/{READY}")
    if complete:

        def move(row) -> None:
            source, files = _files(spark, _folder(f"{staged}/rows", row.day))
            target, _ = _files(spark, _folder(root, row.day))
            if not row.filled:
                files.delete(target, True)
            elif files.exists(source):
                files.delete(target, True)
                files.mkdirs(target.getParent())
                if not files.rename(source, target):
                    raise OSError(f"could not move {source} to {target}")

        # As many rows as days were touched.
        with ThreadPoolExecutor(THREADS) as pool:
            list(pool.map(move, spark.read.parquet(f"{staged}/days").collect()))
    remove_path(spark, staged)
    return complete


def last_mark(spark: SparkSession, lake_root: str, name: str) -> tuple[int, Any] | None:
    """Number and high-water mark of the last complete load, or nothing before the first."""
    stored = stored_rows(spark, f"{lake_root}/{MARKS}/{name}")
    newest = None if stored is None else stored.orderBy(F.col("load").desc()).select("load", "mark").first()
    return None if newest is None else (int(newest.load), newest.mark)


def write_mark(rows: DataFrame, column: str, lake_root: str, name: str, load: int) -> None:
    """Store the greatest ``column`` of ``rows`` as the mark of load number ``load``."""
    mark = rows.agg(F.max(column).alias("mark")).withColumn("load", F.lit(load).cast("long"))
    mark.coalesce(1).write.mode("append").parquet(f"{lake_root}/{MARKS}/{name}")


def load_increment(
    source: DataFrame,
    lake_root: str,
    name: str,
    key: Sequence[str],
    column: str,
    day: str = "source_date",
    latest: bool = False,
    overlap: str | None = None,
) -> int:
    """Load what ``source`` has gained since the last load into ``<lake>/raw/<name>``; returns how many rows were read.

    Rows from the stored mark on are read, those equal to it included, as more of them may have appeared since; ``overlap``
    (such as ``1 hour``) also re-reads that much before a mark in time, for rows that become visible late. They are
    matched with the stored ones by ``key``, so re-reading a row changes nothing. With ``latest`` a key has one row, its newest by ``column``,
    and ``day`` may change with it; else every (key, ``column``) pair stays, and ``day`` has to follow from ``column``.

    The rows are staged first, so data and mark come from one read of the source. Data goes before the mark: a load that dies in
    between is read again from the old mark, finds its rows and writes the mark. Rows whose ``column`` is null are read until a mark is
    known. The filter is a comparison with a literal, which Spark sends to a database.
    """
    spark = source.sparkSession
    known = last_mark(spark, lake_root, name)
    if known is not None and known[1] is not None:
        start = like_column(source, column, known[1])
        start = start - F.expr(f"INTERVAL {overlap}") if overlap else start
        source = source.where(F.col(column) >= start)
    rows = cut_lineage(source)
    count, high = rows.agg(F.count("*"), F.max(column)).first()
    if count:
        keys = list(key) if latest else [*key, column]
        upsert_days(rows, table_root(lake_root, source=name), keys, [column], day, day_of_key=not latest)
        if known is None or high != known[1]:
            write_mark(rows, column, lake_root, name, 1 if known is None else known[0] + 1)
    return count
