"""Promotion between lake layers: cleaned silver rows, report-shaped gold tables."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from tarn.functions.moments import AsOf
from tarn.operators.ranking import first_per_key
from tarn.sources.lake import Lake, write_day
from tarn.sources.landing import typed
from tarn.sources.paths import PARTITIONS, table_root
from tarn.sources.upserts import upsert_days

# Layers every catalog has.
LAYERS = ("bronze", "silver", "gold")
CUSTOM_LAYER = "custom"


def layer_of(schema_slug: str) -> str:
    return schema_slug if schema_slug in LAYERS else CUSTOM_LAYER


def to_silver(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[Column],
    shape: T.StructType,
    defaults: dict[str, Any] | None = None,
) -> DataFrame:
    """Typed rows, the first per key in the given order, nulls filled."""
    clean = first_per_key(typed(df, shape), key, order)
    return clean.fillna(defaults) if defaults else clean


def merge_silver(
    batch: DataFrame,
    lake: Lake,
    catalog: str,
    table: str,
    key: Sequence[str],
    version: Sequence[str],
    shape: T.StructType,
    defaults: dict[str, Any] | None = None,
    day: str = "source_date",
) -> list[str]:
    """Bring a bronze batch into the stored silver table of a catalog and register its name; returns the days rewritten.

    Rows are typed to ``shape`` and nulls filled; the newest per key by ``version`` stays, whether it comes with this batch or an
    earlier one (see ``upsert_days``).
    """
    clean = typed(batch, shape)
    clean = clean.fillna(defaults) if defaults else clean
    days = upsert_days(clean, table_root(lake.root, catalog=catalog, schema="silver", table=table), key, version, day)
    lake.register(f"{catalog}.silver.{table}")
    return days


def to_gold(report: DataFrame, lake: Lake, catalog: str, table: str, day: AsOf) -> str:
    """Store a report as a gold table of a catalog and register its name.

    Period columns named like a partition column are stored as ``<name>_start``.
    """
    for name in set(PARTITIONS) & set(report.columns):
        report = report.withColumnRenamed(name, f"{name}_start")
    write_day(report, lake.root, day, catalog=catalog, schema="gold", table=table)
    name = f"{catalog}.gold.{table}"
    lake.register(name)
    return name
