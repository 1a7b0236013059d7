"""Anchor dates. Reports never read a clock: the caller says what "now" is."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AsOf = date | datetime | str


def as_text(as_of: AsOf) -> str:
    """Wall-clock text in the session's time zone, which is UTC.

    Text means the same in Spark whatever zone the driver's machine is in; a naive ``datetime``
    handed to Spark would be read in the machine's zone.
    """
    if isinstance(as_of, datetime):
        if as_of.tzinfo is not None:
            as_of = as_of.astimezone(timezone.utc).replace(tzinfo=None)
        return as_of.isoformat(sep=" ")
    return as_of.isoformat() if isinstance(as_of, date) else str(as_of)


def instant(as_of: AsOf) -> Column:
    """``as_of`` as a timestamp literal."""
    return F.lit(as_text(as_of)).cast("timestamp")


def newest(df: DataFrame, column: str) -> datetime:
    """Largest value of a timestamp column, as one wall-clock scalar for use as an anchor."""
    return df.agg(F.max(column).cast("timestamp_ntz")).first()[0]


def like_column(df: DataFrame, column: str, value: object) -> Column:
    """A value as a literal of a column's type.

    Comparing a column with a literal of its own type keeps the filter free of casts, so it is
    pushed down to the Parquet reader.
    """
    plain = as_text(value) if isinstance(value, date) else value
    return F.lit(plain).cast(df.schema[column].dataType)


def moment(df: DataFrame, column: str, as_of: AsOf) -> Column:
    """``as_of`` in the type of a date or timestamp column."""
    return like_column(df, column, as_text(as_of))


def day_start(as_of: AsOf) -> str:
    """ISO day of an anchor; midnight when read as a timestamp."""
    return as_text(as_of)[:10]


def parse_day(day: AsOf) -> str:
    """ISO day string, or ``ValueError``."""
    text = day_start(day)
    date.fromisoformat(text)
    return text


def day_or_today(day: AsOf | None) -> str:
    """The day to load for; today when the caller names none."""
    return date.today().isoformat() if day is None else parse_day(day)


def seconds_between(later: Column, earlier: Column) -> Column:
    """Difference of two timestamps in seconds, exact to the microsecond."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return micros / F.lit(1_000_000.0)


def days_between(later: Column, earlier: Column) -> Column:
    return seconds_between(later, earlier) / F.lit(86_400.0)
