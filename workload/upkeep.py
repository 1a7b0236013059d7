"""Stored tables kept up to date from the fixture tables: silver merges, incremental loads."""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators import layers, purging
from tarn.session import scratch_path
from tarn.sources.contracts import contract
from tarn.sources.lake import Lake
from tarn.sources.paths import table_root
from tarn.sources.quarantine import read_json_parts
from tarn.sources.results import store_result
from tarn.sources.upserts import load_increment, stored_rows
from tarn.sources.widening import read_widened
from workload.tables import table

LINE = contract(
    "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_returnflag string, "
    "l_comment string, version int, source_date date"
)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    quarter = F.trunc("l_shipdate", "quarter").alias("source_date")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", quarter
    )


def silver_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items land twice: the second batch has new orders, returns of old ones, older versions that change nothing, and lines that moved.

    Then both batches land again.
    """
    lake = Lake(spark, scratch_path(spark, "silver"))
    lines = _lines(spark, sf_dir)
    first = lines.where("l_orderkey % 4 <> 3").withColumn("version", F.lit(2))
    moved = F.when(F.col("l_linenumber") == 2, F.add_months("source_date", 6)).otherwise(F.col("source_date"))
    late = lines.where("l_orderkey % 4 >= 2").withColumns(
        {
            "version": F.when(F.col("l_partkey") % 3 == 0, 1).otherwise(3),
            "l_quantity": F.col("l_quantity") + 100,
            "l_returnflag": F.lit("late"),
            "source_date": moved,
        }
    )
    for batch in (first, late, first, late):
        layers.merge_silver(batch, lake, "shop", "lines", ["l_orderkey", "l_linenumber"], ["version"], LINE, {"l_comment": "none"})
    return lake.table("shop.silver.lines").select(*[f.name for f in LINE.fields], "year", "month", "day")


def incremental_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in three loads: each source has more rows, also more of those on the last mark of the load before."""
    base = scratch_path(spark, "loads")
    orders = table(spark, sf_dir, "orders").withColumn("source_date", F.to_date(F.trunc("o_orderdate", "quarter")))
    stamp = lambda text: F.lit(text).cast(orders.schema["o_orderdate"].dataType)
    day = F.col("o_orderdate")
    for seen in (
        (day < stamp("1997-03-01")) | ((day == stamp("1997-03-01")) & (F.col("o_orderkey") % 2 == 0)),
        (day < stamp("1999-12-31")) | ((day == stamp("1999-12-31")) & (F.col("o_orderkey") % 2 == 1)),
        F.lit(True),
    ):
        load_increment(orders.where(seen), base, "orders", ["o_orderkey"], "o_orderdate")
    return stored_rows(spark, table_root(base, source="orders")).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "year", "month", "day"
    )


def _stubborn(uri: str) -> None:
    """Stands in for a store that refuses two tables of every seventh catalog."""
    catalog, table_ = re.search(r"/c(\d+)/silver/t(\d+)$", uri).groups()
    if int(catalog) % 7 == 0 and table_ in ("1", "4"):
        raise PermissionError("refused")


def _line_plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every part is a due catalog; each of its line numbers is a table, line 7 one that has to be left alone."""
    items = table(spark, sf_dir, "lineitem")
    folder = F.concat_ws("/", F.concat(F.lit("c"), "l_partkey"), F.lit("silver"), F.concat(F.lit("t"), "l_linenumber"))
    tables = items.select(
        F.col("l_partkey").cast("string").alias("catalog_id"),
        F.concat_ws("-", "l_partkey", "l_linenumber").alias("table_id"),
        folder.alias("prefix"),
        F.lit(True).alias("usable"),
        ((F.col("l_linenumber") == 7) & (F.col("l_partkey") % 5 == 0)).alias("overlaps"),
    )
    return tables.distinct(), tables.select("catalog_id").distinct()


def _purged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """A journal over all tables of all catalogs: the plan is written, the folders are deleted in two rounds, some of them fail."""
    journal = scratch_path(spark, "journal")
    plan, due = _line_plan(spark, sf_dir)
    half = max(1, plan.count() // 2 + 1)
    run = purging.run_purge(plan, due, journal, "s3a://lake", remove=_stubborn, tries=2, round_size=half)
    return purging.read_journal(spark, journal), run


def purge_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every planned folder."""
    return purging.folder_states(*_purged(spark, sf_dir))


def purge_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every due catalog: how many of its folders were deleted, and its own state."""
    told, run = _purged(spark, sf_dir)
    folders = purging.folder_states(told, run)
    owner = F.regexp_extract("prefix", "^c([0-9]+)/", 1).alias("catalog_id")
    counts = folders.groupBy(owner).agg(F.count("*").alias("folders"), F.count_if(F.col("step") == "deleted").alias("deleted"))
    zero = F.lit(0).cast("bigint")
    return purging.catalog_states(told, run).join(counts, "catalog_id", "left").select(
        "catalog_id", "step", F.coalesce("folders", zero).alias("folders"), F.coalesce("deleted", zero).alias("deleted")
    )


def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by price, stored once: the first page, the eighth, the last, and one behind it."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    order = [("o_totalprice", False), ("o_orderkey", True)]
    result = store_result(orders, scratch_path(spark, "result"), order, page_rows=100, block_rows=1000)
    wanted = (0, 7, result.pages - 1, result.pages)
    pages = [result.page(n).withColumns({"page": F.lit(n), "row_count": F.lit(result.row_count)}) for n in wanted]
    return functools.reduce(DataFrame.unionByName, pages)


def union_widening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stored in three folders, each with other types and columns, read as one table."""
    base = scratch_path(spark, "shapes")
    orders = table(spark, sf_dir, "orders")
    day, price = F.col("o_orderdate"), F.col("o_totalprice")
    shapes = (
        {"o_orderkey": F.col("o_orderkey").cast("int"), "price": price.cast("decimal(12,2)"), "customer": F.col("o_custkey").cast("int")},
        {"o_orderkey": F.col("o_orderkey"), "price": price, "customer": F.col("o_custkey"), "placed": F.to_date(day)},
        {"o_orderkey": F.col("o_orderkey").cast("int"), "customer": F.concat(F.lit("c"), "o_custkey"), "placed": day.cast("timestamp")},
    )
    for part, shape in enumerate(shapes):
        rows = orders.where(F.col("o_orderkey") % 3 == part)
        rows.select(*[c.alias(n) for n, c in shape.items()]).write.parquet(f"{base}/{part}")
    return read_widened(spark, [f"{base}/{part}" for part in range(3)])


def json_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines, some cut off, some no objects, some with a text for a number: what lands and what is kept apart."""
    base = scratch_path(spark, "payloads")
    events, key = table(spark, sf_dir, "events"), F.col("event_id")
    user = F.when(key % 91 == 0, '"n/a"').otherwise(F.col("user_id").cast("string"))
    line = F.format_string('{"event_id": %d, "user_id": %s, "event_type": "%s"}', key, user, F.col("event_type"))
    planted = F.when(key % 50 == 0, F.substring(line, 1, 24)).when(key % 77 == 0, F.concat(F.lit("["), key, F.lit("]"))).otherwise(line)
    events.select(planted).write.text(f"{base}/lines")
    shape = contract("event_id bigint, user_id bigint, event_type string")
    good, bad = read_json_parts(spark, f"{base}/lines", shape, files="*.txt")
    apart = bad.select(F.col("_reason").alias("reason"), F.col("_raw").alias("raw"))
    return good.drop("_file", "_place").unionByName(apart, allowMissingColumns=True)


QUERIES = {
    "result_pages": result_pages,
    "union_widening": union_widening,
    "json_quarantine": json_quarantine,
    "silver_upsert": silver_upsert,
    "incremental_load": incremental_load,
    "purge_journal": purge_journal,
    "purge_catalogs": purge_catalogs,
}

_LINES = """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag,
           CAST(date_trunc('quarter', l_shipdate) AS DATE) AS source_date FROM lineitem
"""

_PURGED = """
    WITH folders AS (
        SELECT DISTINCT l_partkey, 'c' || l_partkey || '/silver/t' || l_linenumber AS prefix,
               CASE WHEN l_linenumber = 7 AND l_partkey % 5 = 0 THEN 'withheld'
                    WHEN l_partkey % 7 = 0 AND l_linenumber IN (1, 4) THEN 'failed' ELSE 'deleted' END AS step
        FROM lineitem
    )
"""

ORACLE = {
    "result_pages": """
        WITH numbered AS (
            SELECT o_orderkey, o_totalprice, o_orderpriority, CAST((row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1) // 100 AS INTEGER) AS page,
                   CAST(count(*) OVER () AS INTEGER) AS row_count
            FROM orders
        )
        SELECT * FROM numbered WHERE page IN (0, 7, (row_count - 1) // 100)
    """,
    "union_widening": """
        SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS DOUBLE) WHEN 1 THEN o_totalprice END AS price,
               CASE WHEN o_orderkey % 3 = 2 THEN 'c' ELSE '' END || o_custkey AS customer,
               CASE o_orderkey % 3 WHEN 1 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) WHEN 2 THEN CAST(o_orderdate AS TIMESTAMP) END AS placed
        FROM orders
    """,
    "json_quarantine": """
        WITH lines AS (
            SELECT event_id, user_id, event_type, '{"event_id": ' || event_id || ', "user_id": ' ||
                   CASE WHEN event_id % 91 = 0 THEN '"n/a"' ELSE CAST(user_id AS VARCHAR) END || ', "event_type": "' || event_type || '"}' AS line
            FROM events
        ),
        judged AS (
            SELECT *, CASE WHEN event_id % 50 = 0 THEN 'not JSON' WHEN event_id % 77 = 0 THEN 'not an object'
                           WHEN event_id % 91 = 0 THEN 'unreadable values: user_id' END AS reason,
                   CASE WHEN event_id % 50 = 0 THEN substr(line, 1, 24) WHEN event_id % 77 = 0 THEN '[' || event_id || ']' ELSE line END AS raw
            FROM lines
        )
        SELECT CASE WHEN reason IS NULL THEN event_id END AS event_id, CASE WHEN reason IS NULL THEN user_id END AS user_id,
               CASE WHEN reason IS NULL THEN event_type END AS event_type, reason, CASE WHEN reason IS NOT NULL THEN raw END AS raw
        FROM judged
    """,
    "silver_upsert": f"""
        WITH lines AS ({_LINES}),
        batches AS (
            SELECT 1 AS batch, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, 2 AS version, source_date
            FROM lines WHERE l_orderkey % 4 <> 3
            UNION ALL
            SELECT 2, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity + 100, 'late',
                   CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 3 END,
                   CASE WHEN l_linenumber = 2 THEN CAST(source_date + INTERVAL 6 MONTH AS DATE) ELSE source_date END
            FROM lines WHERE l_orderkey % 4 >= 2
        )
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, 'none' AS l_comment, version, source_date,
               strftime(source_date, '%Y') AS year, strftime(source_date, '%m') AS month, strftime(source_date, '%d') AS day
        FROM batches
        QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
            ORDER BY version DESC, batch, l_partkey, l_suppkey, l_quantity, l_returnflag, source_date) = 1
    """,
    "purge_journal": f"""
        {_PURGED} SELECT prefix, step, CASE step WHEN 'failed' THEN 2 ELSE 1 END AS attempts,
                         CASE step WHEN 'failed' THEN 'PermissionError: refused' END AS error
        FROM folders WHERE step <> 'withheld'
    """,
    "purge_catalogs": f"""
        {_PURGED} SELECT CAST(l_partkey AS VARCHAR) AS catalog_id,
               CASE WHEN bool_or(step = 'withheld') THEN 'withheld' WHEN bool_or(step = 'failed') THEN 'waiting' ELSE 'dropped' END AS step,
               count(*) FILTER (WHERE step <> 'withheld') AS folders, count(*) FILTER (WHERE step = 'deleted') AS deleted
        FROM folders GROUP BY l_partkey
    """,
    "incremental_load": """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, strftime(date_trunc('quarter', o_orderdate), '%Y') AS year,
               strftime(date_trunc('quarter', o_orderdate), '%m') AS month, '01' AS day
        FROM orders
    """,
}
