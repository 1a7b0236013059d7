"""Rollups of an object listing (``key, size, last_modified``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.moments import AsOf, instant
from tarn.functions.text import freshness, human_size, segments, timestamp_label
from tarn.sources.paths import GLOB


def _usage() -> list[Column]:
    return [
        F.count("*").alias("objects"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"),
        F.max("last_modified").alias("last_modified"),
    ]


def storage_totals(objects: DataFrame) -> DataFrame:
    """Object count and size of the whole lake."""
    return objects.agg(*_usage()[:2]).withColumn("size", human_size(F.col("bytes")))


def storage_inventory(objects: DataFrame) -> DataFrame:
    """Usage per top-level prefix."""
    usage = objects.groupBy(segments(F.col("key"), 1).alias("prefix")).agg(*_usage())
    return usage.withColumns(
        {
            "size": human_size(F.col("bytes")),
            "last_modified_str": timestamp_label(F.col("last_modified"), "—"),
        }
    )


def dataset_listing(objects: DataFrame, lake_root: str) -> DataFrame:
    """Usage per dataset (two path levels), with a pattern ready for reading, sorted by prefix."""
    usage = objects.groupBy(segments(F.col("key"), 2).alias("prefix")).agg(*_usage())
    return usage.select(
        "prefix",
        "objects",
        "bytes",
        human_size(F.col("bytes")).alias("size"),
        timestamp_label(F.col("last_modified"), "—").alias("last_modified"),
        F.concat(F.lit(lake_root.rstrip("/") + "/"), "prefix", F.lit(GLOB)).alias("path"),
    ).orderBy("prefix")


def folders(objects: DataFrame) -> DataFrame:
    """Usage per folder: the listing shrunk before anything is joined to it."""
    name = F.substring_index("key", "/", -1)
    folder = F.substring(F.col("key"), F.lit(1), F.length("key") - F.length(name) - 1)
    return objects.groupBy(folder.alias("folder")).agg(*_usage())


def source_freshness(objects: DataFrame, sources: DataFrame, as_of: AsOf) -> DataFrame:
    """Newest object and freshness class of each source in ``sources`` (column ``source``).

    A folder belongs to a source when one of its path segments is the source's name, or starts with
    the name and an underscore. Each segment is spelled out as the names it can stand for, which
    makes the match an equality join instead of a scan of every source for every object.
    """
    words = F.split("part", "_")
    names = F.transform(
        F.sequence(F.lit(1), F.size(words)), lambda i: F.concat_ws("_", F.slice(words, F.lit(1), i))
    )
    named = (
        folders(objects)
        .select("last_modified", F.explode(F.split("folder", "/")).alias("part"))
        .groupBy("part")
        .agg(F.max("last_modified").alias("last_modified"))
        .select("last_modified", F.explode(names).alias("source"))
        .groupBy("source")
        .agg(F.max("last_modified").alias("last_modified"))
    )
    at = instant(as_of)
    return sources.select("source").join(named, "source", "left").select(
        "source",
        "last_modified",
        timestamp_label(F.col("last_modified"), "Never").alias("last_modified_str"),
        freshness(F.col("last_modified"), at).alias("status"),
        F.col("last_modified").isNull().alias("never"),
    )
