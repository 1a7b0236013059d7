"""Analytics on a Parquet lake, written with the Spark DataFrame API."""

from tarn.session import build_session, configure

__all__ = ["build_session", "configure"]
