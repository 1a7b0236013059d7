"""Where lake tables live."""

from __future__ import annotations

from tarn.functions.moments import AsOf, parse_day

GLOB = "/**/*.parquet"
PARTITIONS = ("year", "month", "day")


def root_of(pattern: str) -> str:
    """Folder behind a path pattern: ``s3a://b/raw/x/**/*.parquet`` -> ``s3a://b/raw/x``.

    Everything from the first path segment holding a wildcard is dropped.
    """
    segments = pattern.split("/")
    for position, segment in enumerate(segments):
        if "*" in segment:
            segments = segments[:position]
            break
    return "/".join(segments).rstrip("/")


def pattern_of(root: str) -> str:
    return root.rstrip("/") + GLOB


def table_root(
    lake_root: str,
    *,
    source: str | None = None,
    catalog: str | None = None,
    schema: str | None = None,
    table: str | None = None,
    area: str = "raw",
) -> str:
    """``<lake>/<catalog>/<schema>/<table>``, or ``<lake>/<area>/<source>`` for a plain source."""
    base = lake_root.rstrip("/")
    if catalog and schema and table:
        return f"{base}/{catalog}/{schema}/{table}"
    if source:
        return f"{base}/{area}/{source}"
    raise ValueError("name a source, or all of catalog, schema and table")


def day_parts(day: AsOf) -> dict[str, str]:
    """Partition values of an ISO day, zero-padded."""
    year, month, dom = parse_day(day).split("-")
    return {"year": year, "month": month, "day": dom}
