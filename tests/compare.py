"""Run registered queries in Spark and their SQL in DuckDB, and compare the rows."""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        files = f"{path}/*.parquet" if path.is_dir() else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{files}')")
    return con


def _plain(value):
    if isinstance(value, float):
        # Zero has one value, whatever its sign.
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


#: Queries whose order of rows is part of the answer, and is complete.
ORDERED = frozenset(
    """recent_charges top_products daily_revenue monthly_churn top_products_net signups_vs_won orders_by_weather
    preview_rows newest_events visible_catalogs""".split()
)


def _plain_rows(columns, rows, ordered):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], plain if ordered else sorted(plain)


def spark_rows(df, ordered=False):
    return _plain_rows(df.columns, [tuple(r) for r in df.collect()], ordered)


def oracle_rows(con, sql, ordered=False):
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    return _plain_rows(columns, rel.fetchall(), ordered)


def difference(spark_side, oracle_side) -> str | None:
    if spark_side[0] != oracle_side[0]:
        return f"columns {spark_side[0]} != {oracle_side[0]}"
    if len(spark_side[1]) != len(oracle_side[1]):
        return f"{len(spark_side[1])} rows != {len(oracle_side[1])} rows"
    wrong = [(a, b) for a, b in zip(spark_side[1], oracle_side[1]) if a != b]
    if wrong:
        return f"{len(wrong)} rows differ, first: {str(wrong[0])[:1500]}"
    return None


def main(names: list[str], sf_dir: str) -> int:
    import __spark_entry__ as entry

    from tarn import build_session

    spark = build_session(
        "compare",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        start = time.time()
        try:
            ordered = name in ORDERED
            got = spark_rows(queries[name](spark, sf_dir), ordered)
            took = time.time() - start
            problem = difference(got, oracle_rows(con, oracle[name], ordered)) if name in oracle else None
        except Exception:
            problem, took, got = traceback.format_exc(limit=3)[-2500:], time.time() - start, ([], [])
        failed += problem is not None
        label = "FAIL" if problem else ("ok" if name in oracle else "rows")
        print(f"{label:5}{name:28}{len(got[1]):>8} rows {took:7.2f}s {problem or ''}", flush=True)
    spark.stop()
    return failed


if __name__ == "__main__":
    where = "/root/testdata/sf0.01"
    args = sys.argv[1:]
    if args and args[0].startswith("/"):
        where = args.pop(0)
    sys.exit(1 if main(args, where) else 0)
