"""Landed payloads to flat, typed rows. All of it is column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions.moments import AsOf, parse_day
from tarn.functions.text import first_nonblank
from tarn.sources.contracts import CONTRACTS, HOURLY_FIELDS, JOURNAL_LINE
from tarn.sources.lake import with_source_date

# Names of the journal severity codes that are kept.
PRIORITY_NAMES = {
    "0": "EMERGENCY",
    "1": "ALERT",
    "2": "CRITICAL",
    "3": "ERROR",
    "4": "WARNING",
}
DEFAULT_PRIORITY = "4"
DEFAULT_UNIT = "kernel"


def read_json_folder(spark: SparkSession, folder: str, schema: T.StructType | None = None) -> DataFrame:
    """Every ``*.json`` of a folder; a file holds one object or an array of objects."""
    reader = spark.read.option("multiLine", True).option("pathGlobFilter", "*.json")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(folder)


def flatten_struct(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested records to columns named ``a.b``; arrays stay as they are."""

    def leaves(column: Column, name: str, dtype: T.DataType) -> list[Column]:
        if not isinstance(dtype, T.StructType):
            return [column.alias(name)]
        return [
            leaf
            for f in dtype.fields
            for leaf in leaves(column.getField(f.name), f"{name}{sep}{f.name}", f.dataType)
        ]

    columns = []
    for f in df.schema.fields:
        columns += leaves(F.col(f"`{f.name}`"), f.name, f.dataType)
    return df.select(*columns)


def explode_items(df: DataFrame, item_schema: T.StructType, field: str = "Items") -> DataFrame:
    """Rows of a ``{"Items": [...]}`` payload; a payload without the field gives none."""
    if field not in df.columns:
        df = df.withColumn(field, F.lit(None).cast(T.ArrayType(item_schema)))
    return df.select(F.explode(F.col(field)).alias("item")).select("item.*")


def normalize_disks(df: DataFrame) -> DataFrame:
    """Disk inventory with a fixed column list: text defaults to empty, size to zero."""

    def value(f: T.StructField) -> Column:
        col = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if isinstance(f.dataType, T.StringType):
            col = F.coalesce(col, F.lit(""))
        elif f.name == "size":
            col = F.coalesce(col, F.lit(0).cast("bigint"))
        return col.alias(f.name)

    return df.select(*[value(f) for f in CONTRACTS["disks"].fields])


def normalize_hourly(df: DataFrame, latitude: float, longitude: float, day: AsOf) -> DataFrame:
    """Parallel hourly arrays to one row per hour."""
    arrays = F.arrays_zip(
        F.col("hourly.time").alias("timestamp"),
        *[F.col(f"hourly.{name}").alias(name) for name in HOURLY_FIELDS],
    )
    rows = df.select(F.explode(arrays).alias("h")).select(
        "h.timestamp", *[f"h.{name}" for name in HOURLY_FIELDS]
    )
    return with_source_date(rows, day).withColumns(
        {"latitude": F.lit(float(latitude)), "longitude": F.lit(float(longitude))}
    )


def _nonempty(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def _day_start(day: AsOf) -> Column:
    return F.lit(parse_day(day)).cast("timestamp")


def normalize_journal(lines: DataFrame, day: AsOf, column: str = "value") -> DataFrame:
    """Journal JSON lines to log rows.

    A line that is no JSON parses to nulls and leaves with the empty messages.
    """
    entry = lines.select(F.from_json(F.col(column), JOURNAL_LINE).alias("e")).select("e.*")
    names = F.create_map(*[F.lit(x) for pair in PRIORITY_NAMES.items() for x in pair])
    priority = F.coalesce(F.col("PRIORITY"), F.lit(DEFAULT_PRIORITY))
    unit = F.coalesce(_nonempty("_SYSTEMD_UNIT"), _nonempty("SYSLOG_IDENTIFIER"), F.lit(DEFAULT_UNIT))
    micros = F.col("__REALTIME_TIMESTAMP").try_cast("bigint")
    return entry.where(_nonempty("MESSAGE").isNotNull()).select(
        F.lit("journal").alias("log_type"),
        F.replace(unit, F.lit(".service"), F.lit("")).alias("unit"),
        F.coalesce(F.try_element_at(names, priority), priority).alias("priority"),
        F.coalesce(F.timestamp_micros(micros), _day_start(day)).alias("timestamp"),
        F.col("MESSAGE").alias("message"),
    )


def journal_window(lines: DataFrame, day: AsOf, column: str = "value") -> DataFrame:
    """Lines of one day with severity warning or worse, as the log reader asks for them."""
    entry = F.from_json(F.col(column), JOURNAL_LINE)
    at = F.timestamp_micros(entry.getField("__REALTIME_TIMESTAMP").try_cast("bigint"))
    level = F.coalesce(entry.getField("PRIORITY"), F.lit(DEFAULT_PRIORITY)).try_cast("int")
    start = _day_start(day)
    return lines.where((at >= start) & (at < start + F.expr("INTERVAL 1 DAY")) & (level <= 4))


def normalize_alerts(alerts: DataFrame, day: AsOf) -> DataFrame:
    """Active alerts to log rows; they are current state and belong to the day being loaded."""
    text = F.coalesce(_nonempty("formatted"), _nonempty("text"), _nonempty("args"))
    # No date counts as epoch zero; an unreadable one as the start of the day.
    raw = F.coalesce(F.col("datetime.$date"), F.lit("0"))
    return alerts.where(text.isNotNull()).select(
        F.lit("alert").alias("log_type"),
        F.coalesce(F.col("source"), F.lit("alert")).alias("unit"),
        F.coalesce(F.col("level"), F.lit("WARNING")).alias("priority"),
        F.coalesce(F.timestamp_millis(raw.try_cast("bigint")), _day_start(day)).alias("timestamp"),
        text.alias("message"),
    )


def build_logs(journal: DataFrame, alerts: DataFrame, day: AsOf) -> DataFrame:
    """Both log kinds in one table, with display text and id.

    The id hashes the text alone, so a repeated message keeps its id: not a key to deduplicate by.
    """
    content = F.concat(F.lit("["), "unit", F.lit("] "), "priority", F.lit(": "), "message")
    rows = journal.unionByName(alerts).withColumn("content", content)
    return with_source_date(rows.withColumn("id", F.md5("content")), day).withColumn(
        "ingested_at", F.current_timestamp()
    )


def typed(df: DataFrame, shape: T.StructType) -> DataFrame:
    """Cast to a contract by name: unreadable values become NULL, absent columns too."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in present else F.lit(None).cast(f.dataType)).alias(
                f.name
            )
            for f in shape.fields
        ]
    )


def land(payload: DataFrame, shape: T.StructType, day: AsOf, column: str = "value") -> DataFrame:
    """JSON objects, one per row, to a typed table stamped with its day.

    Fields are first read as text, so one bad value costs that value and not the row.
    """
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in shape.fields])
    rows = payload.select(F.from_json(F.col(column), as_text).alias("r")).where(
        F.col("r").isNotNull()
    )
    return with_source_date(typed(rows.select("r.*"), shape), day)


def utterance(columns: list[str]) -> Column:
    """Spoken text of a voice export: first non-blank of the known fields."""
    known = ("utteranceText", "utterance", "query", "text", "description")
    return first_nonblank(*[F.col(f"`{c}`") for c in known if c in columns])


def union_files(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Record sets whose columns differ, matched by name."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
