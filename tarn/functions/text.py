"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size units, base 1024.
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")


# Whitespace in the Unicode sense, as the inside of a character class.
SPACE = r"\s\x1c-\x1f\x85\p{Z}"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def nonblank(column: Column) -> Column:
    """The value as text, NULL when empty or whitespace only."""
    text = column.cast("string")
    return F.when(text.rlike(rf"[^{SPACE}]"), text)


def first_nonblank(*columns: Column) -> Column:
    return F.coalesce(*[nonblank(c) for c in columns], F.lit(None).cast("string"))


def join_nonblank(*columns: Column, sep: str = " | ") -> Column:
    """Non-blank values joined; NULL when there is none."""
    return F.nullif(F.concat_ws(sep, *[nonblank(c) for c in columns]), F.lit(""))


def one_decimal(value: Column) -> Column:
    """One decimal, ties to even, as C printf does it for sizes in powers of two."""
    return F.format_string("%.1f", F.bround(value.cast("double"), 1))


def human_size(num_bytes: Column) -> Column:
    """``1536`` -> ``1.5 KB``; nothing above TB."""
    size = num_bytes.cast("double")
    exponent = F.least(F.floor(F.log(1024.0, size)), F.lit(len(SIZE_UNITS) - 1)).cast("int")
    units = F.array(*[F.lit(u) for u in SIZE_UNITS])
    text = F.concat(
        one_decimal(size / F.pow(F.lit(1024.0), exponent)),
        F.lit(" "),
        F.element_at(units, exponent + 1),
    )
    return F.when(num_bytes == 0, F.lit("0 B")).otherwise(text)


def slugify(name: Column) -> Column:
    """Lower case, symbols dropped, runs of space, underscore and hyphen to one hyphen."""
    kept = F.regexp_replace(F.lower(name), rf"[^\p{{L}}\p{{N}}_{SPACE}-]", "")
    hyphens = F.regexp_replace(kept, rf"[{SPACE}_-]+", "-")
    slug = F.regexp_replace(hyphens, r"^-+|-+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("item"))


def timestamp_label(at: Column, missing: str) -> Column:
    """``2025-05-27 14:32 UTC``, or a placeholder."""
    return F.coalesce(F.date_format(at.cast("timestamp"), "yyyy-MM-dd HH:mm 'UTC'"), F.lit(missing))


def segments(key: Column, count: int) -> Column:
    """The first ``count`` path segments of a key."""
    return F.concat_ws("/", F.slice(F.split(key, "/"), 1, count))


def freshness(last_modified: Column, as_of: Column) -> Column:
    """green up to 25 hours, yellow up to 48, else red; red also when there is no object."""
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(last_modified.cast("timestamp"))
    hour = 3_600_000_000
    return (
        F.when(age <= 25 * hour, "green").when(age <= 48 * hour, "yellow").otherwise("red")
    )


def same_name(left: Column, right: Column) -> Column:
    """Names compared without regard to case."""
    return F.lower(left) == F.lower(right)
