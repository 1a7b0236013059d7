"""Datasets past their grace period: what would be freed, and freeing it."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.moments import AsOf, instant
from tarn.operators.storage import folders
from tarn.session import cut_lineage

# Default and allowed grace period in days.
GRACE_DAYS = 30
GRACE_RANGE = (0, 365)


def purge_date(deleted_at: Column, days: int = GRACE_DAYS) -> Column:
    """When a dataset deleted now may be purged."""
    if not GRACE_RANGE[0] <= days <= GRACE_RANGE[1]:
        raise ValueError(f"grace period must lie in {GRACE_RANGE}")
    return deleted_at + F.expr(f"INTERVAL {int(days)} DAYS")


def due_catalogs(catalogs: DataFrame, as_of: AsOf, workspaces: DataFrame | None = None) -> DataFrame:
    """Ids of catalogs to purge: deleted and due, or owned by an inactive workspace that is due."""
    now = instant(as_of)
    due = F.col("scheduled_purge_at").isNotNull() & (F.col("scheduled_purge_at") <= now)
    own = catalogs.where(due & F.col("deleted_at").isNotNull()).select("catalog_id")
    if workspaces is None:
        return own
    gone = workspaces.where((F.col("status") == "inactive") & due).select(
        F.col("workspace_id").alias("owner_workspace_id")
    )
    return own.union(catalogs.join(gone, "owner_workspace_id", "left_semi").select("catalog_id")).distinct()


def dataset_prefix(pattern: Column, lake_root: str) -> Column:
    """Key prefix of a path pattern: lake root and everything from the first wildcard dropped.

    Empty for a pattern outside the lake and for one that would cover the whole lake.
    """
    root = re.escape(lake_root.rstrip("/"))
    return F.regexp_extract(pattern, rf"^{root}/((?:[^/*]+/)*[^/*]+)/*(?:/[^/]*\*.*)?$", 1)


def _parents(path: Column) -> Column:
    """A path and all folders above it, whole segments only."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws("/", F.slice(parts, F.lit(1), i)))


def due_prefixes(due: DataFrame, tables: DataFrame, lake_root: str) -> DataFrame:
    """Tables of due catalogs: ``catalog_id, table_id, prefix, usable, overlaps``.

    A pattern without a prefix inside the lake is not ``usable`` (its prefix is empty). ``overlaps`` marks prefixes
    that are equal to, above or below those of a live table: deleting them would take live data along. All
    comparisons are equality joins on spelled-out folders.
    """
    named = tables.withColumn("prefix", dataset_prefix(F.col("path_pattern"), lake_root))
    own = named.join(due, "catalog_id", "left_semi").select("catalog_id", "table_id", "prefix")
    live = named.join(due, "catalog_id", "left_anti").select("prefix", "path_pattern")
    # A live table over the whole lake, or with a pattern that starts with a wildcard, overlaps with everything.
    whole = F.col("path_pattern").startswith(lake_root.rstrip("/") + "/") & (F.col("prefix") == "")
    everywhere = not live.where(whole).limit(1).isEmpty()
    live = live.where(F.col("prefix") != "").select("prefix").distinct()
    mine = own.where(F.col("prefix") != "").select("prefix").distinct()
    above = mine.withColumn("folder", F.explode(_parents(F.col("prefix"))))
    above = above.join(live.withColumnRenamed("prefix", "folder"), "folder", "left_semi").select("prefix")
    below = live.select(F.explode(_parents(F.col("prefix"))).alias("prefix")).join(mine, "prefix", "left_semi")
    met = above.union(below).distinct().withColumn("_met", F.lit(True))
    return own.join(met, "prefix", "left").select(
        "catalog_id",
        "table_id",
        "prefix",
        (F.col("prefix") != "").alias("usable"),
        (F.coalesce("_met", F.lit(False)) | (F.lit(everywhere) & (F.col("prefix") != ""))).alias("overlaps"),
    )


def purge_plan(prefixes: DataFrame, objects: DataFrame) -> DataFrame:
    """Files and bytes each due table would free; tables without files are listed with zero.

    Folders are summed first and spelled out as all their parents, so whole path segments are matched
    by an equality join.
    """
    usage = (
        folders(objects)
        .select("objects", "bytes", F.explode(_parents(F.col("folder"))).alias("prefix"))
        .join(prefixes.select("prefix").distinct(), "prefix", "left_semi")
        .groupBy("prefix")
        .agg(F.sum("objects").alias("objects"), F.sum("bytes").alias("bytes"))
    )
    zero = F.lit(0).cast("bigint")
    return prefixes.join(usage, "prefix", "left").select(
        "catalog_id",
        "table_id",
        "prefix",
        F.coalesce("objects", zero).alias("objects"),
        F.coalesce("bytes", zero).alias("bytes"),
        "usable",
        "overlaps",
    )


def purge_apply(plan: DataFrame, lake_root: str, catalogs: DataFrame, due: DataFrame, threads: int = 8) -> DataFrame:
    """Delete the planned folders, then return the catalogs that remain.

    Folders that overlap with live data, and tables whose pattern names no folder, are left alone; their catalogs
    remain, and ``withheld`` lists them. All other due catalogs go, also those without tables.

    Data goes first: when a deletion fails the error stops the run and no catalog is dropped, so the
    same plan can be run again. A few threads delete at a time, one call per folder; the driver holds as many
    folders as there are threads, and files are not listed.
    """
    spark = plan.sparkSession
    # The plan rests on a listing that is stale once files are gone.
    plan, due = cut_lineage(plan), cut_lineage(due.select("catalog_id").distinct())
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def remove(prefix: str) -> None:
        path = jvm.org.apache.hadoop.fs.Path(f"{lake_root.rstrip('/')}/{prefix}")
        files = path.getFileSystem(conf)
        if files.exists(path) and not files.delete(path, True) and files.exists(path):
            raise OSError(f"could not delete {prefix}")

    planned = plan.where("usable AND NOT overlaps").select("prefix").distinct().toLocalIterator()
    with ThreadPoolExecutor(threads) as pool:
        while batch := [row.prefix for row in islice(planned, 16 * threads)]:
            list(pool.map(remove, batch))
    gone = due.join(withheld(plan).select("catalog_id"), "catalog_id", "left_anti")
    return catalogs.join(gone, "catalog_id", "left_anti")


def withheld(plan: DataFrame) -> DataFrame:
    """Tables that a purge leaves alone, and why."""
    reason = F.when(~F.col("usable"), "no folder in the pattern").otherwise("overlaps with live data")
    return plan.where("NOT usable OR overlaps").select("catalog_id", "table_id", "prefix", reason.alias("reason"))
