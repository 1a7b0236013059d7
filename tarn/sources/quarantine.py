"""Payload files with broken parts: what can be read lands, the rest is kept apart with its place and the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.session import cut_lineage
from tarn.sources.landing import typed

FILE, PLACE, RAW, REASON = "_file", "_place", "_raw", "_reason"

# Reasons why a part of a file is kept apart.
NO_JSON, NO_OBJECT, NO_MATCH = "not JSON", "not an object", "unreadable values"


def _pieces(spark: SparkSession, folder: str, lines: bool, files: str) -> DataFrame:
    """Every non-blank line of every file (or every file as a whole) with its file and its number in it, from 0."""
    reader = spark.read.option("pathGlobFilter", files).option("recursiveFileLookup", True)
    text = reader.text(folder, wholetext=True)
    text = text.select(F.col("_metadata.file_path").alias(FILE), "value")
    if not lines:
        return text.select(FILE, F.lit(0).alias(PLACE), F.col("value").alias(RAW)).where(F.trim(RAW) != "")
    cut = text.select(FILE, F.posexplode(F.split("value", "\r?\n")).alias(PLACE, RAW))
    return cut.where(F.trim(RAW) != "")


def _value(raw: Column) -> Column:
    """The JSON value that a text is, null if it is none or has anything behind it.

    A parser stops behind the first value, so the text is looked at within a list and within an object: only a
    single whole value fits into both.
    """
    listed = F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<variant>")
    named = F.try_parse_json(F.concat(F.lit('{"v":'), raw, F.lit("}")))
    return F.when(named.isNotNull() & (F.size(listed) == 1), F.get(listed, F.lit(0)))


def _unreadable(record: Column, read: Column, shape: T.StructType) -> Column:
    """Fields that have a value which their type cannot take, by name."""
    fields = [
        F.when(record.getField(f.name).isNotNull() & read.getField(f.name).isNull(), F.lit(f.name)) for f in shape.fields
    ]
    return F.array_compact(F.array(*fields))


def read_json_parts(
    spark: SparkSession, folder: str, shape: T.StructType, lines: bool = True, files: str = "*.json*"
) -> tuple[DataFrame, DataFrame]:
    """Rows of ``shape`` and, apart, what could not be read: ``_file, _place, _reason, _raw``.

    ``lines``: a JSON object per line, else a file is an object or an array of objects. A part is kept apart if it is no JSON, is no object, or has
    fields whose values their type cannot take (their names are in the reason); the place is the line of the file, or the place in
    its array. Blank lines are nothing. Good rows carry ``_file`` and ``_place`` too, so every part of every file is in just one of both.

    Parts are staged once, so good and bad come from one read. A file is one task's: payload files are exports of a day.
    """
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in shape.fields])
    pieces = _pieces(spark, folder, lines, files)
    found = pieces.withColumn("_value", _value(F.col(RAW)))
    if not lines:
        is_list = F.startswith(F.schema_of_variant("_value"), F.lit("ARRAY"))
        items = F.transform(F.from_json(F.col(RAW), "array<variant>"), lambda v: F.to_json(v))
        items = F.when(F.coalesce(is_list, F.lit(False)), items).otherwise(F.array(RAW))
        found = found.select(FILE, F.posexplode(items).alias(PLACE, RAW)).withColumn("_value", _value(F.col(RAW)))
    kind = F.schema_of_variant("_value")
    reason = F.when(F.col("_value").isNull(), NO_JSON).when(~F.startswith(kind, F.lit("OBJECT")), NO_OBJECT)
    record = F.when(reason.isNull(), F.from_json(RAW, as_text))
    parts = found.withColumn("_record", record).withColumn(REASON, reason).drop("_value")
    good_shape = typed(parts.select("_record.*"), shape)
    casts = F.struct(*[F.col(f"_record.`{f.name}`").try_cast(f.dataType).alias(f.name) for f in good_shape.schema.fields])
    wrong = _unreadable(F.col("_record"), F.col("_read"), shape)
    parts = parts.withColumn("_read", casts).withColumn("_wrong", F.when(F.col(REASON).isNull(), wrong))
    said = F.when(F.size("_wrong") > 0, F.concat(F.lit(f"{NO_MATCH}: "), F.array_join("_wrong", ", ")))
    parts = cut_lineage(parts.withColumn(REASON, F.coalesce(REASON, said)).drop("_record", "_wrong"))
    good = parts.where(F.col(REASON).isNull()).select(FILE, PLACE, "_read.*")
    return good, parts.where(F.col(REASON).isNotNull()).select(FILE, PLACE, REASON, RAW)


def land_json(
    spark: SparkSession, folder: str, shape: T.StructType, root: str, quarantine: str, lines: bool = True, files: str = "*.json*"
) -> dict[str, int]:
    """Write the readable rows of a folder to ``root`` and the others to ``quarantine``; returns how many went where.

    Both are replaced, so a folder that was repaired is landed again as a whole.
    """
    good, bad = read_json_parts(spark, folder, shape, lines, files)
    good.drop(FILE, PLACE).write.mode("overwrite").parquet(root)
    bad.write.mode("overwrite").parquet(quarantine)
    return {"landed": spark.read.parquet(root).count(), "kept_apart": spark.read.parquet(quarantine).count()}
