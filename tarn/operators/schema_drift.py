"""Column registry: inferred columns merged with what is recorded, and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.sources.lake import Lake

INFERRED = "table_id string, pos int, name string, type string"
COLUMN_DEFS = "array<struct<name:string,type:string,description:string,deprecated:boolean>>"


def infer_columns(lake: Lake) -> DataFrame:
    """``table_id, pos, name, type`` of every readable table, from file footers alone."""
    rows = [
        (table, pos, name, kind)
        for table, columns in lake.schemas().items()
        for pos, (name, kind) in enumerate(columns)
    ]
    return lake.spark.createDataFrame(rows, INFERRED)


def registry_columns(registry: DataFrame) -> DataFrame:
    """Registry entries (``table_id, column_defs``) as one row per column."""
    return registry.select("table_id", F.posexplode("column_defs").alias("pos", "c")).select(
        "table_id", "pos", "c.name", "c.type", "c.description", "c.deprecated"
    )


def merge_columns(recorded: DataFrame, inferred: DataFrame) -> DataFrame:
    """One row per column with its new state and whether it changed.

    Only tables that could be read are merged; the others keep what they have. New columns are
    added, missing ones deprecated, returning ones restored, types follow the files, descriptions
    stay. File order first, then columns only the registry knows.
    """
    readable = inferred.select("table_id").distinct()
    old = recorded.join(readable, "table_id", "left_semi").alias("o")
    new = inferred.alias("n")
    in_files, known = F.col("n.name").isNotNull(), F.col("o.name").isNotNull()
    was_deprecated = F.coalesce(F.col("o.deprecated"), F.lit(False))
    changed = (
        F.when(in_files & known, was_deprecated | (F.col("o.type") != F.col("n.type")))
        .when(in_files, F.lit(True))
        .otherwise(~was_deprecated)
    )
    return old.join(
        new,
        (F.col("o.table_id") == F.col("n.table_id")) & (F.col("o.name") == F.col("n.name")),
        "full_outer",
    ).select(
        F.coalesce("n.table_id", "o.table_id").alias("table_id"),
        F.coalesce("n.name", "o.name").alias("name"),
        F.coalesce("n.type", "o.type").alias("type"),
        F.col("o.description").alias("description"),
        (~in_files).alias("deprecated"),
        in_files.alias("in_files"),
        F.coalesce("n.pos", "o.pos").alias("pos"),
        F.coalesce(changed, F.lit(True)).alias("changed"),
    )


def table_drift(merged: DataFrame) -> DataFrame:
    """Per table: column counts and whether anything changed since the last refresh."""
    return merged.groupBy("table_id").agg(
        F.count("*").alias("columns"),
        F.count_if("deprecated").alias("deprecated"),
        F.count_if("changed").alias("changes"),
        F.bool_or("changed").alias("schema_drift"),
    )


def column_lists(merged: DataFrame) -> DataFrame:
    """Merged columns gathered per table: ``table_id, column_defs, schema_drift``."""
    entry = F.struct(
        (~F.col("in_files")).alias("k"), "pos", "name", "type", "description", "deprecated"
    )
    ordered = F.array_sort(F.collect_list(entry))
    return merged.groupBy("table_id").agg(
        F.transform(
            ordered,
            lambda c: F.struct(c["name"], c["type"], c["description"], c["deprecated"]),
        )
        .cast(COLUMN_DEFS)
        .alias("column_defs"),
        F.bool_or("changed").alias("schema_drift"),
    )


def refresh_catalog(lake: Lake, registry: DataFrame) -> DataFrame:
    """The registry with refreshed columns and drift flags; unreadable tables unchanged.

    ``registry`` has ``table_id`` (the table's name in the lake), ``column_defs``, ``schema_drift``.
    """
    merged = column_lists(merge_columns(registry_columns(registry), infer_columns(lake))).select(
        "table_id", F.col("column_defs").alias("_defs"), F.col("schema_drift").alias("_drift")
    )
    return registry.join(merged, "table_id", "left").select(
        "table_id",
        F.coalesce("_defs", "column_defs", F.array().cast(COLUMN_DEFS)).alias("column_defs"),
        F.coalesce("_drift", "schema_drift", F.lit(False)).alias("schema_drift"),
    )
