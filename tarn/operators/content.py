"""Rows to text, ids and vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions.moments import AsOf, parse_day
from tarn.functions.text import join_nonblank, nonblank, one_decimal, strip
from tarn.functions.vectors import DEFAULT_DIM, VECTOR, hashed_vector, once
from tarn.sources.landing import utterance

# A rule sees the frame's columns and answers with the text of a row.
ContentRule = Callable[[DataFrame], Column]

GIB = float(1024**3)

# The texts that the rules below build.


def _text(df: DataFrame, name: str, default: str = "") -> Column:
    """A column as text, or the default when it is absent or null."""
    if name not in df.columns:
        return F.lit(default)
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(default))


def _number(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(0.0)
    return F.coalesce(F.col(f"`{name}`").cast("double"), F.lit(0.0))


def _columns(df: DataFrame, *names: str) -> list[Column]:
    return [F.col(f"`{n}`") for n in names if n in df.columns]


def media_activity(df: DataFrame) -> Column:
    parts = _columns(df, "Name", "Type", "ShortOverview")
    return F.coalesce(join_nonblank(*parts), F.lit("Jellyfin activity"))


def storage_pool(df: DataFrame) -> Column:
    return F.concat(
        F.lit("Pool "),
        _text(df, "name", "unknown"),
        F.lit(": "),
        _text(df, "status", "unknown"),
        F.lit(", "),
        one_decimal(_number(df, "allocated") / GIB),
        F.lit("GB used, "),
        one_decimal(_number(df, "free") / GIB),
        F.lit("GB free"),
    )


def weather(df: DataFrame) -> Column:
    return F.concat(
        F.lit("Weather "),
        _text(df, "timestamp"),
        F.lit(": "),
        _text(df, "temperature_2m"),
        F.lit("F apparent "),
        _text(df, "apparent_temperature"),
        F.lit("F, "),
        _text(df, "relative_humidity_2m"),
        F.lit("% humidity, "),
        _text(df, "precipitation", "0"),
        F.lit("in precip, "),
        _text(df, "wind_speed_10m"),
        F.lit("mph wind"),
    )


def voice_export(df: DataFrame) -> Column:
    """Spoken text; else all non-blank text columns."""
    strings = [F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    present = F.filter(F.array(*[nonblank(c) for c in strings]), lambda v: v.isNotNull())
    fallback = F.nullif(F.concat_ws(" | ", present), F.lit(""))
    return F.coalesce(utterance(df.columns), fallback, F.lit("Alexa activity"))


def log_entry(df: DataFrame) -> Column:
    return F.coalesce(F.nullif(strip(_text(df, "content")), F.lit("")), F.lit("TrueNAS log entry"))


# Rules by source name; add one with register_content.
CONTENT_RULES: dict[str, ContentRule] = {
    "jellyfin": media_activity,
    "truenas": storage_pool,
    "weather": weather,
    "alexa": voice_export,
    "truenas_logs": log_entry,
}


def register_content(source: str, rule: ContentRule) -> None:
    CONTENT_RULES[source] = rule


def build_content(df: DataFrame, source: str) -> DataFrame:
    """Add the display text of each row."""
    return df.withColumn("content", CONTENT_RULES[source](df))


def with_record_id(df: DataFrame) -> DataFrame:
    """``id`` as text: an existing id column, else the md5 of the content."""
    present = set(df.columns)
    name = next((c for c in ("id", "Id", "ID") if c in present), None)
    record_id = F.col(f"`{name}`").cast("string") if name else F.md5("content")
    if name and name != "id":
        df = df.withColumnRenamed(name, "_record_id")
        record_id = F.col("_record_id").cast("string")
    return df.withColumn("id", record_id).drop("_record_id")


class Embedder(Protocol):
    """An external embedding model, called inside Spark tasks with up to ``batch`` texts."""

    dim: int
    batch: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def embed(
    df: DataFrame,
    embedder: Embedder | None = None,
    dim: int = DEFAULT_DIM,
    text: str = "content",
    name: str = "embedding",
) -> DataFrame:
    """Add a vector per row. Without a model, hashed token counts are used.

    Only the text column crosses to Python, whatever else the frame carries.
    """
    if embedder is None:
        return df.withColumn(name, hashed_vector(F.col(text), dim))
    model, width, size = embedder, embedder.dim, embedder.batch

    @F.pandas_udf(VECTOR)
    def call_model(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values: list[list[float]] = []
            for start in range(0, len(texts), size):
                values += model.embed(texts.iloc[start : start + size].fillna("").tolist())
            if any(len(v) != width for v in values):
                raise ValueError(f"the model must return {width} values per text")
            yield pd.Series(values, index=texts.index)

    return df.withColumn(name, once(call_model)(F.col(text)))


def embedding_rows(
    df: DataFrame,
    source: str,
    day: AsOf,
    embedder: Embedder | None = None,
    dim: int = DEFAULT_DIM,
) -> DataFrame:
    """Raw rows of one source and day to rows of the embedding table."""
    rows = with_record_id(build_content(df, source)).select("id", "content")
    return (
        embed(rows, embedder, dim)
        .withColumns(
            {
                "source": F.lit(source),
                "source_date": F.lit(parse_day(day)).cast("date"),
                "ingested_at": F.current_timestamp(),
            }
        )
        .select("id", "source", "content", "embedding", "source_date", "ingested_at")
    )
