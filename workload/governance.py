"""Layers, drift, storage, retention and access, on metadata derived from the fixture tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import text
from tarn.functions.moments import newest
from tarn.operators import access, layers, retention, schema_drift, storage
from tarn.operators.column_history import column_history
from tarn.sources.contracts import contract
from workload.tables import table

# Names of sources.
SOURCES = ("stripe", "shopify", "hubspot", "postgres", "weather")
PURGE_AS_OF = "1998-03-28 00:00:00"
LAKE = "s3a://lake"


# Layers


def silver_line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    shape = contract(
        "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity int, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp, l_comment string"
    )
    key = ["l_orderkey", "l_linenumber"]
    # The key has real duplicates; all other columns make the choice repeatable.
    others = [F.col(f.name) for f in shape.fields if f.name not in (*key, "l_shipdate", "l_comment")]
    return layers.to_silver(items, key, [F.col("l_shipdate").desc(), *others], shape, {"l_comment": "none"})


# Schema drift


def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "lineitem").where("l_shipdate < '1999-01-01'")
    return old.groupBy(
        F.col("l_suppkey").cast("string").alias("table_id"),
        F.concat(F.lit("c"), F.col("l_partkey").cast("string")).alias("name"),
    ).agg(
        F.min("l_linenumber").alias("pos"),
        F.min("l_returnflag").alias("type"),
        F.concat(F.lit("seen "), F.max("l_linenumber")).alias("description"),
        (F.max("l_discount") >= 0.08).alias("deprecated"),
    )


def _inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "lineitem").where("l_shipdate >= '1998-01-01'")
    return new.groupBy(
        F.col("l_suppkey").cast("string").alias("table_id"),
        F.concat(F.lit("c"), F.col("l_partkey").cast("string")).alias("name"),
    ).agg(F.min("l_linenumber").alias("pos"), F.max("l_returnflag").alias("type"))


def schema_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.merge_columns(_recorded(spark, sf_dir), _inferred(spark, sf_dir))


def schema_drift_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.table_drift(schema_merge(spark, sf_dir))


# Storage


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as an object listing."""
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    area = F.when(flag == "R", "raw").when(flag == "A", "embeddings").otherwise("prod/silver")
    source = (
        F.when(line == 1, "stripe_charges")
        .when(line == 2, "stripe_subscriptions")
        .when(line == 3, "shopify")
        .when(line == 4, "hubspot_deals")
        .when(line == 5, "weather")
        .otherwise("misc")
    )
    name = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws(
            "/", area, source, F.date_format("l_shipdate", "'year='yyyy"), F.concat(name, F.lit(".parquet"))
        ).alias("key"),
        (F.col("l_extendedprice") * 1000).cast("bigint").alias("size"),
        F.col("l_shipdate").cast("timestamp").alias("last_modified"),
    )


def storage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.storage_totals(_objects(spark, sf_dir))


def storage_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.storage_inventory(_objects(spark, sf_dir))


def dataset_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.dataset_listing(_objects(spark, sf_dir), LAKE)


def source_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = _objects(spark, sf_dir)
    sources = spark.createDataFrame([(s,) for s in SOURCES], "source string")
    as_of = newest(objects, "last_modified") + timedelta(hours=30)
    return storage.source_freshness(objects, sources, as_of)


def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id",
        text.human_size(F.length("html")).alias("size"),
        text.human_size(F.pow(F.length("html").cast("double"), F.lit(3)).cast("bigint")).alias("cubed"),
    )


def page_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.slugify(F.col("url")).alias("slug"))


# Retention and access metadata


def _workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    inactive = F.col("s_acctbal") < 0
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("workspace_id"),
        F.col("s_name").alias("name"),
        F.when(inactive, "inactive").otherwise("active").alias("status"),
        F.when(
            inactive,
            F.lit("1998-03-15").cast("timestamp") + F.make_dt_interval(F.col("s_nationkey")),
        ).alias("scheduled_purge_at"),
    )


def _catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as catalogs, owned by the first supplier that ships them."""
    owners = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("owner_workspace_id"))
    created = F.lit("1998-01-01").cast("timestamp") + F.make_dt_interval(F.col("p_size"))
    deleted = F.when(F.col("p_size") > 40, created + F.expr("INTERVAL 10 DAYS"))
    brand = F.col("p_brand")
    name = F.when(brand == "Brand#1", "Default").when(brand == "Brand#2", "DEFAULT").otherwise(F.col("p_name"))
    return (
        table(spark, sf_dir, "part")
        .join(owners, F.col("p_partkey") == F.col("l_partkey"))
        .select(
            F.col("p_partkey").alias("catalog_id"),
            name.alias("name"),
            "owner_workspace_id",
            created.alias("created_at"),
            deleted.alias("deleted_at"),
            retention.purge_date(deleted).alias("scheduled_purge_at"),
        )
    )


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("c_acctbal") > 9000, access.SUPERUSER).otherwise("user")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), role.alias("role"))


def _bought(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return items.join(orders, items.l_orderkey == orders.o_orderkey)


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _bought(spark, sf_dir)
        .select(F.col("l_suppkey").alias("workspace_id"), F.col("o_custkey").alias("user_id"))
        .distinct()
    )


def _schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("catalog_id"), "l_returnflag").distinct()


def _grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("catalog_id"), F.col("l_suppkey").alias("workspace_id"))
        .agg(
            F.min("l_returnflag").alias("flag"),
            F.max("l_quantity").alias("quantity"),
            F.max("l_discount").alias("discount"),
            F.min("l_shipdate").alias("requested_at"),
        )
        .select(
            F.concat_ws("-", "catalog_id", "workspace_id").alias("access_id"),
            "catalog_id",
            "workspace_id",
            F.when(F.col("quantity") > 25, "write").otherwise("read").alias("mode"),
            F.when(F.col("flag") == "A", "approved")
            .when(F.col("flag") == "N", "pending")
            .otherwise("rejected")
            .alias("status"),
            (F.col("discount") >= 0.09).alias("suspended"),
            "requested_at",
        )
    )


def purge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    # All catalogs put their seventh table into one folder: a purge must leave it alone.
    folder = F.when(F.col("l_linenumber") == 7, "shared/silver/t7").otherwise(
        F.concat_ws("/", F.concat(F.lit("c"), "l_partkey"), F.lit("silver"), F.concat(F.lit("t"), "l_linenumber"))
    )
    objects = items.select(
        F.concat_ws("/", folder, F.concat(F.col("l_orderkey").cast("string"), F.lit(".parquet"))).alias("key"),
        F.col("l_quantity").cast("bigint").alias("size"),
        F.col("l_shipdate").cast("timestamp").alias("last_modified"),
    )
    tables = items.select(
        F.col("l_partkey").alias("catalog_id"),
        folder.alias("table_id"),
        F.concat(F.lit(LAKE + "/"), folder, F.lit("/**/*.parquet")).alias("path_pattern"),
    ).distinct()
    due = retention.due_catalogs(_catalogs(spark, sf_dir), PURGE_AS_OF, _workspaces(spark, sf_dir))
    return retention.purge_plan(retention.due_prefixes(due, tables, LAKE), objects)


def effective_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access of every customer to every part they ever bought."""
    asked = _bought(spark, sf_dir).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("catalog_id"))
    return access.effective_access(
        asked, _users(spark, sf_dir), _members(spark, sf_dir), _catalogs(spark, sf_dir), _grants(spark, sf_dir)
    )


def workspace_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.workspace_catalogs(_catalogs(spark, sf_dir), _grants(spark, sf_dir))


def visible_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = access.visible_catalogs(
        5, _users(spark, sf_dir), _members(spark, sf_dir), _catalogs(spark, sf_dir), _grants(spark, sf_dir)
    )
    return seen.select("catalog_id", "name", "owner_workspace_id", "created_at")


def visible_catalogs_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.visible_catalogs_of_all(
        _users(spark, sf_dir), _members(spark, sf_dir), _catalogs(spark, sf_dir), _grants(spark, sf_dir)
    )


def catalog_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.catalog_directory(
        7, _catalogs(spark, sf_dir), _workspaces(spark, sf_dir), _schemas(spark, sf_dir), _grants(spark, sf_dir)
    ).fillna({"access_id": "-"})


def catalog_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directories of all workspaces at once."""
    return access.catalog_directories(
        _catalogs(spark, sf_dir), _workspaces(spark, sf_dir), _schemas(spark, sf_dir), _grants(spark, sf_dir)
    ).fillna({"access_id": "-", "workspace_id": -1})


def access_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access of every customer to every part they bought, on the day the order was placed and a year later.

    Membership lasts 300 days from each purchase, grants as long as the quantity says; some of both are open.
    """
    bought = _bought(spark, sf_dir).withColumn("shipped", F.to_date("l_shipdate"))
    day = F.to_date("o_orderdate")
    asked = bought.select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("catalog_id"), F.explode(F.array(day, F.date_add(day, 365))).alias("day")
    )
    members = bought.select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_suppkey").alias("workspace_id"),
        F.when(F.col("l_linenumber") > 1, F.col("shipped")).alias("valid_from"),
        F.when(F.col("l_linenumber") < 6, F.date_add("shipped", 300)).alias("valid_to"),
    )
    grants = bought.select(
        F.col("l_partkey").alias("catalog_id"),
        F.col("l_suppkey").alias("workspace_id"),
        F.when(F.col("l_discount") > 0.05, "write").otherwise("read").alias("mode"),
        F.when(F.col("l_returnflag") == "R", "rejected").otherwise("approved").alias("status"),
        (F.col("l_tax") >= 0.08).alias("suspended"),
        F.date_sub("shipped", 100).alias("valid_from"),
        F.when(F.col("l_quantity") < 45, F.date_add("shipped", F.col("l_quantity").cast("int") * 10)).alias("valid_to"),
    )
    return access.access_as_of(asked, _users(spark, sf_dir), _catalogs(spark, sf_dir), members, grants)


def schema_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten refreshes of a table per supplier: columns come and go, and change their type, with the line items."""
    observed = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").alias("table_id"),
        (F.col("l_orderkey") % 10).cast("int").alias("refresh"),
        F.concat(F.lit("c"), F.col("l_partkey") % 12).alias("name"),
    ).agg(F.min("l_linenumber").alias("pos"), F.min("l_linestatus").alias("type"))
    return column_history(observed.where("refresh <> 4 OR table_id % 2 = 0"))


def pending_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.pending_requests(_catalogs(spark, sf_dir), _workspaces(spark, sf_dir), _grants(spark, sf_dir))


def workspace_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.workspace_usage(_workspaces(spark, sf_dir), _members(spark, sf_dir), _catalogs(spark, sf_dir))


def default_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.default_catalogs(_catalogs(spark, sf_dir)).select("catalog_id", "name", "owner_workspace_id")


def owned_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.owned_catalogs(_catalogs(spark, sf_dir)).select(
        "owner_workspace_id", F.col("deleted_at").isNull().alias("live"), "name", "catalog_id"
    )


QUERIES = {
    "silver_line_items": silver_line_items,
    "schema_merge": schema_merge,
    "schema_drift_flags": schema_drift_flags,
    "storage_totals": storage_totals,
    "storage_inventory": storage_inventory,
    "dataset_listing": dataset_listing,
    "source_freshness": source_freshness,
    "page_sizes": page_sizes,
    "page_slugs": page_slugs,
    "purge_plan": purge_plan,
    "effective_access": effective_access,
    "workspace_catalogs": workspace_catalogs,
    "visible_catalogs": visible_catalogs,
    "visible_catalogs_of_all": visible_catalogs_of_all,
    "catalog_directory": catalog_directory,
    "catalog_directories": catalog_directories,
    "access_as_of": access_as_of,
    "schema_history": schema_history,
    "pending_requests": pending_requests,
    "workspace_usage": workspace_usage,
    "default_catalogs": default_catalogs,
    "owned_catalogs": owned_catalogs,
}

_MERGE = """
    WITH o AS (
        SELECT CAST(l_suppkey AS VARCHAR) AS table_id, 'c' || l_partkey AS name, min(l_linenumber) AS pos,
               min(l_returnflag) AS type, 'seen ' || max(l_linenumber) AS description,
               max(l_discount) >= 0.08 AS deprecated
        FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01' GROUP BY 1, 2
    ),
    n AS (
        SELECT CAST(l_suppkey AS VARCHAR) AS table_id, 'c' || l_partkey AS name, min(l_linenumber) AS pos,
               max(l_returnflag) AS type
        FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY 1, 2
    ),
    merged AS (
        SELECT coalesce(n.table_id, o.table_id) AS table_id, coalesce(n.name, o.name) AS name,
               coalesce(n.type, o.type) AS type, o.description, n.name IS NULL AS deprecated,
               n.name IS NOT NULL AS in_files, coalesce(n.pos, o.pos) AS pos,
               CASE WHEN n.name IS NULL THEN NOT o.deprecated
                    WHEN o.name IS NULL THEN true
                    ELSE o.deprecated OR o.type <> n.type END AS changed
        FROM (SELECT * FROM o WHERE table_id IN (SELECT table_id FROM n)) o
        FULL OUTER JOIN n ON o.table_id = n.table_id AND o.name = n.name
    )
"""

_OBJECTS = """
    SELECT CASE l_returnflag WHEN 'R' THEN 'raw' WHEN 'A' THEN 'embeddings' ELSE 'prod/silver' END || '/' ||
           CASE l_linenumber WHEN 1 THEN 'stripe_charges' WHEN 2 THEN 'stripe_subscriptions' WHEN 3 THEN 'shopify'
                WHEN 4 THEN 'hubspot_deals' WHEN 5 THEN 'weather' ELSE 'misc' END || '/year=' ||
           strftime(l_shipdate, '%Y') || '/' || l_orderkey || '-' || l_linenumber || '-' || l_partkey ||
           '.parquet' AS key,
           CAST(trunc(l_extendedprice * 1000) AS BIGINT) AS size, l_shipdate AS last_modified
    FROM lineitem
"""


def _human(size: str) -> str:
    exponent = f"least(floor(ln(CAST({size} AS DOUBLE)) / ln(1024)), 4)"
    return (
        f"CASE WHEN {size} = 0 THEN '0 B' ELSE printf('%.1f', CAST({size} AS DOUBLE) / pow(1024, {exponent})) "
        f"|| ' ' || (['B', 'KB', 'MB', 'GB', 'TB'])[CAST({exponent} AS INTEGER) + 1] END"
    )


_META = """
    WITH workspaces AS (
        SELECT s_suppkey AS workspace_id, s_name AS name,
               CASE WHEN s_acctbal < 0 THEN 'inactive' ELSE 'active' END AS status,
               CASE WHEN s_acctbal < 0 THEN TIMESTAMP '1998-03-15' + to_days(s_nationkey) END
                   AS scheduled_purge_at
        FROM supplier
    ),
    catalogs AS (
        SELECT p_partkey AS catalog_id,
               CASE p_brand WHEN 'Brand#1' THEN 'Default' WHEN 'Brand#2' THEN 'DEFAULT' ELSE p_name END AS name,
               owner_workspace_id, TIMESTAMP '1998-01-01' + to_days(p_size) AS created_at,
               CASE WHEN p_size > 40 THEN TIMESTAMP '1998-01-11' + to_days(p_size) END AS deleted_at,
               CASE WHEN p_size > 40 THEN TIMESTAMP '1998-02-10' + to_days(p_size) END AS scheduled_purge_at
        FROM part JOIN (SELECT l_partkey, min(l_suppkey) AS owner_workspace_id FROM lineitem GROUP BY 1)
            ON p_partkey = l_partkey
    ),
    users AS (
        SELECT c_custkey AS user_id, CASE WHEN c_acctbal > 9000 THEN 'superadmin' ELSE 'user' END AS role
        FROM customer
    ),
    bought AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    members AS (
        SELECT DISTINCT l_suppkey AS workspace_id, o_custkey AS user_id FROM bought
    ),
    grants AS (
        SELECT l_partkey || '-' || l_suppkey AS access_id, l_partkey AS catalog_id, l_suppkey AS workspace_id,
               CASE WHEN max(l_quantity) > 25 THEN 'write' ELSE 'read' END AS mode,
               CASE min(l_returnflag) WHEN 'A' THEN 'approved' WHEN 'N' THEN 'pending' ELSE 'rejected' END AS status,
               max(l_discount) >= 0.09 AS suspended, min(l_shipdate) AS requested_at
        FROM lineitem GROUP BY l_partkey, l_suppkey
    ),
    live AS (SELECT * FROM catalogs WHERE deleted_at IS NULL),
    in_force AS (SELECT * FROM grants WHERE status = 'approved' AND NOT suspended)
"""

ORACLE = {
    "silver_line_items": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER) AS l_quantity,
               l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate, 'none' AS l_comment
        FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
            ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
                     l_returnflag, l_linestatus) = 1
    """,
    "schema_merge": f"{_MERGE} SELECT * FROM merged",
    "schema_drift_flags": f"""
        {_MERGE}
        SELECT table_id, count(*) AS columns, count(*) FILTER (WHERE deprecated) AS deprecated,
               count(*) FILTER (WHERE changed) AS changes, bool_or(changed) AS schema_drift
        FROM merged GROUP BY 1
    """,
    "storage_totals": f"""
        SELECT count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes, {_human('sum(size)')} AS size
        FROM ({_OBJECTS})
    """,
    "storage_inventory": f"""
        WITH u AS (
            SELECT split_part(key, '/', 1) AS prefix, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes,
                   max(last_modified) AS last_modified
            FROM ({_OBJECTS}) GROUP BY 1
        )
        SELECT *, {_human('bytes')} AS size, strftime(last_modified, '%Y-%m-%d %H:%M UTC') AS last_modified_str
        FROM u
    """,
    "dataset_listing": f"""
        WITH u AS (
            SELECT split_part(key, '/', 1) || '/' || split_part(key, '/', 2) AS prefix, count(*) AS objects,
                   CAST(sum(size) AS BIGINT) AS bytes, max(last_modified) AS lm
            FROM ({_OBJECTS}) GROUP BY 1
        )
        SELECT prefix, objects, bytes, {_human('bytes')} AS size,
               strftime(lm, '%Y-%m-%d %H:%M UTC') AS last_modified,
               's3a://lake/' || prefix || '/**/*.parquet' AS path
        FROM u ORDER BY prefix
    """,
    "source_freshness": f"""
        WITH obj AS ({_OBJECTS}),
        now AS (SELECT max(last_modified) + INTERVAL 30 HOURS AS as_of FROM obj),
        newest AS (
            SELECT source, (SELECT max(last_modified) FROM obj
                            WHERE contains(key, '/' || source || '/') OR contains(key, '/' || source || '_')
                               OR starts_with(key, source || '/') OR starts_with(key, source || '_'))
                   AS last_modified
            FROM (VALUES ('stripe'), ('shopify'), ('hubspot'), ('postgres'), ('weather')) AS s(source)
        )
        SELECT source, last_modified,
               coalesce(strftime(last_modified, '%Y-%m-%d %H:%M UTC'), 'Never') AS last_modified_str,
               CASE WHEN as_of - last_modified <= INTERVAL 25 HOURS THEN 'green'
                    WHEN as_of - last_modified <= INTERVAL 48 HOURS THEN 'yellow' ELSE 'red' END AS status,
               last_modified IS NULL AS never
        FROM newest CROSS JOIN now
    """,
    "page_sizes": f"""
        SELECT page_id, {_human('length(html)')} AS size,
               {_human('CAST(pow(CAST(length(html) AS DOUBLE), 3) AS BIGINT)')} AS cubed
        FROM pages
    """,
    "page_slugs": r"""
        SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(lower(url), '[^\p{L}\p{N}_\s-]', '', 'g'),
               '[\s_-]+', '-', 'g'), '-'), ''), 'item') AS slug
        FROM pages
    """,
    "purge_plan": f"""
        {_META},
        due AS (
            SELECT catalog_id FROM catalogs
            WHERE deleted_at IS NOT NULL AND scheduled_purge_at <= TIMESTAMP '{PURGE_AS_OF}'
            UNION
            SELECT catalog_id FROM catalogs JOIN workspaces w ON owner_workspace_id = w.workspace_id
            WHERE w.status = 'inactive' AND w.scheduled_purge_at <= TIMESTAMP '{PURGE_AS_OF}'
        ),
        items AS (
            SELECT l_partkey AS catalog_id, l_quantity,
                   CASE l_linenumber WHEN 7 THEN 'shared/silver/t7'
                        ELSE 'c' || l_partkey || '/silver/t' || l_linenumber END AS prefix
            FROM lineitem
        ),
        usage AS (SELECT prefix, count(*) AS objects, CAST(sum(l_quantity) AS BIGINT) AS bytes FROM items GROUP BY 1)
        SELECT DISTINCT catalog_id, prefix AS table_id, prefix, objects, bytes, true AS usable,
               prefix IN (SELECT prefix FROM items WHERE catalog_id NOT IN (SELECT catalog_id FROM due)) AS overlaps
        FROM items JOIN usage USING (prefix) WHERE catalog_id IN (SELECT catalog_id FROM due)
    """,
    "effective_access": f"""
        {_META},
        pairs AS (SELECT DISTINCT o_custkey AS user_id, l_partkey AS catalog_id FROM bought),
        rules AS (
            SELECT p.user_id, p.catalog_id, 3 AS level FROM pairs p JOIN users USING (user_id)
            WHERE role = 'superadmin'
            UNION ALL
            SELECT p.user_id, p.catalog_id, 3 FROM pairs p JOIN catalogs c USING (catalog_id)
            JOIN members m ON m.user_id = p.user_id AND m.workspace_id = c.owner_workspace_id
            UNION ALL
            SELECT p.user_id, p.catalog_id, CASE mode WHEN 'write' THEN 2 ELSE 1 END FROM pairs p
            JOIN in_force g USING (catalog_id)
            JOIN members m ON m.user_id = p.user_id AND m.workspace_id = g.workspace_id
        )
        SELECT user_id, catalog_id,
               CASE max(level) WHEN 3 THEN 'owner' WHEN 2 THEN 'write' WHEN 1 THEN 'read' END AS access
        FROM pairs LEFT JOIN rules USING (user_id, catalog_id) GROUP BY 1, 2
    """,
    "workspace_catalogs": f"""
        {_META}
        SELECT catalog_id, workspace_id, name, created_at
        FROM (SELECT owner_workspace_id AS workspace_id, catalog_id FROM live
              UNION SELECT workspace_id, catalog_id FROM in_force)
        JOIN live USING (catalog_id)
    """,
    "visible_catalogs": f"""
        {_META}
        SELECT catalog_id, name, owner_workspace_id, created_at FROM live
        WHERE (SELECT role FROM users WHERE user_id = 5) = 'superadmin'
           OR owner_workspace_id IN (SELECT workspace_id FROM members WHERE user_id = 5)
           OR catalog_id IN (SELECT catalog_id FROM in_force WHERE workspace_id IN
                             (SELECT workspace_id FROM members WHERE user_id = 5))
        ORDER BY created_at, catalog_id
    """,
    "visible_catalogs_of_all": f"""
        {_META},
        pairs AS (
            SELECT workspace_id, catalog_id FROM live JOIN members ON owner_workspace_id = workspace_id
            UNION SELECT workspace_id, catalog_id FROM in_force WHERE catalog_id IN (SELECT catalog_id FROM live)
        )
        SELECT DISTINCT m.user_id, p.catalog_id FROM members m JOIN pairs p USING (workspace_id)
        WHERE m.user_id NOT IN (SELECT user_id FROM users WHERE role = 'superadmin')
        UNION ALL SELECT user_id, NULL FROM users WHERE role = 'superadmin'
    """,
    "catalog_directory": f"""
        {_META}
        SELECT c.catalog_id, c.name, owner_workspace_id, w.name AS owner_workspace_name,
               (SELECT count(DISTINCT l_returnflag) FROM lineitem WHERE l_partkey = c.catalog_id) AS schema_count,
               CASE WHEN g.status IN ('approved', 'pending') THEN g.status ELSE 'none' END AS access_status,
               coalesce(access_id, '-') AS access_id
        FROM live c LEFT JOIN grants g ON g.catalog_id = c.catalog_id AND g.workspace_id = 7
        LEFT JOIN workspaces w ON w.workspace_id = owner_workspace_id
        WHERE owner_workspace_id <> 7
    """,
    "catalog_directories": f"""
        {_META},
        counted AS (SELECT l_partkey AS catalog_id, count(DISTINCT l_returnflag) AS schema_count FROM lineitem GROUP BY 1),
        asked AS (SELECT workspace_id, catalog_id, access_id, status FROM grants
                  UNION ALL SELECT -1, catalog_id, '-', NULL FROM live)
        SELECT g.workspace_id, c.catalog_id, c.name, c.owner_workspace_id, w.name AS owner_workspace_name,
               coalesce(schema_count, 0) AS schema_count,
               CASE WHEN g.status IN ('approved', 'pending') THEN g.status ELSE 'none' END AS access_status, access_id
        FROM live c JOIN asked g USING (catalog_id) LEFT JOIN counted USING (catalog_id)
        LEFT JOIN workspaces w ON w.workspace_id = c.owner_workspace_id
        WHERE g.workspace_id <> c.owner_workspace_id
    """,
    "access_as_of": f"""
        {_META},
        b AS (SELECT l.*, o_custkey, CAST(o_orderdate AS DATE) AS placed, CAST(l_shipdate AS DATE) AS shipped
              FROM lineitem l JOIN orders ON l_orderkey = o_orderkey),
        asked AS (SELECT o_custkey AS user_id, l_partkey AS catalog_id, placed AS day FROM b
                  UNION SELECT o_custkey, l_partkey, placed + 365 FROM b),
        m AS (SELECT o_custkey AS user_id, l_suppkey AS workspace_id, CASE WHEN l_linenumber > 1 THEN shipped END AS valid_from,
                     CASE WHEN l_linenumber < 6 THEN shipped + 300 END AS valid_to FROM b),
        g AS (SELECT l_partkey AS catalog_id, l_suppkey AS workspace_id, CASE WHEN l_discount > 0.05 THEN 2 ELSE 1 END AS level,
                     shipped - 100 AS valid_from, CASE WHEN l_quantity < 45 THEN shipped + CAST(l_quantity AS INTEGER) * 10 END AS valid_to
              FROM b WHERE l_returnflag <> 'R' AND l_tax < 0.08),
        was AS (SELECT DISTINCT a.*, workspace_id FROM asked a JOIN m USING (user_id)
                WHERE (valid_from IS NULL OR valid_from <= day) AND (valid_to IS NULL OR day < valid_to)),
        rules AS (
            SELECT a.*, 3 AS level FROM asked a JOIN users USING (user_id) WHERE role = 'superadmin'
            UNION ALL
            SELECT user_id, w.catalog_id, day, 3 FROM was w JOIN catalogs c ON c.catalog_id = w.catalog_id AND c.owner_workspace_id = workspace_id
            UNION ALL
            SELECT user_id, w.catalog_id, day, level FROM was w JOIN g ON g.catalog_id = w.catalog_id AND g.workspace_id = w.workspace_id
            WHERE (valid_from IS NULL OR valid_from <= day) AND (valid_to IS NULL OR day < valid_to)
        )
        SELECT user_id, catalog_id, day, CASE max(level) WHEN 3 THEN 'owner' WHEN 2 THEN 'write' WHEN 1 THEN 'read' END AS access
        FROM asked LEFT JOIN rules USING (user_id, catalog_id, day) GROUP BY 1, 2, 3
    """,
    "schema_history": """
        WITH o AS (
            SELECT * FROM (
                SELECT l_suppkey AS table_id, CAST(l_orderkey % 10 AS INTEGER) AS refresh, 'c' || l_partkey % 12 AS name,
                       min(l_linenumber) AS pos, min(l_linestatus) AS type
                FROM lineitem GROUP BY 1, 2, 3
            ) WHERE refresh <> 4 OR table_id % 2 = 0
        ),
        r AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY refresh) AS n FROM (SELECT DISTINCT table_id, refresh FROM o)),
        born AS (SELECT table_id, name, min(n) AS first FROM o JOIN r USING (table_id, refresh) GROUP BY 1, 2),
        grid AS (
            SELECT b.table_id, b.name, r.n, o.pos, o.type, coalesce(o.type, '-') AS state
            FROM born b JOIN r ON r.table_id = b.table_id AND r.n >= b.first
            LEFT JOIN o ON o.table_id = b.table_id AND o.name = b.name AND o.refresh = r.refresh
        ),
        marked AS (SELECT *, lag(state) OVER (PARTITION BY table_id, name ORDER BY n) AS before FROM grid),
        folded AS (SELECT *, sum(CASE WHEN before = state THEN 0 ELSE 1 END) OVER (PARTITION BY table_id, name ORDER BY n) AS island FROM marked),
        i AS (
            SELECT table_id, name, island, min(n) AS first, max(n) AS last, min(state) AS state, arg_min(pos, n) AS pos, arg_min(type, n) AS type
            FROM folded GROUP BY 1, 2, 3
        ),
        told AS (
            SELECT table_id, name, first, last, state = '-' AS deprecated,
                   coalesce(pos, lag(pos) OVER w) AS pos, coalesce(type, lag(type) OVER w) AS type,
                   CASE WHEN state = '-' THEN 'deprecated' WHEN island = 1 AND first = 1 THEN 'initial' WHEN island = 1 THEN 'added'
                        WHEN lag(state) OVER w = '-' THEN 'restored' ELSE 'retyped' END AS change
            FROM i WINDOW w AS (PARTITION BY table_id, name ORDER BY island)
        )
        SELECT t.table_id, t.name, t.pos, t.type, t.deprecated, s.refresh AS since, u.refresh AS until, t.change,
               CASE WHEN t.change = 'added' THEN (SELECT min(d.name) FROM told d WHERE d.deprecated AND d.table_id = t.table_id
                    AND d.first = t.first AND d.pos = t.pos AND d.type = t.type) END AS renamed_from
        FROM told t JOIN r s ON s.table_id = t.table_id AND s.n = t.first
        LEFT JOIN r u ON u.table_id = t.table_id AND u.n = t.last + 1
    """,
    "pending_requests": f"""
        {_META}
        SELECT owner_workspace_id, access_id, g.catalog_id, c.name AS catalog_name,
               g.workspace_id AS requesting_workspace_id, w.name AS requesting_workspace_name, mode, requested_at
        FROM grants g JOIN live c ON c.catalog_id = g.catalog_id
        LEFT JOIN workspaces w ON w.workspace_id = g.workspace_id
        WHERE g.status = 'pending'
    """,
    "workspace_usage": f"""
        {_META}
        SELECT workspace_id, name,
               (SELECT count(*) FROM members m WHERE m.workspace_id = w.workspace_id) AS member_count,
               (SELECT count(*) FROM live WHERE owner_workspace_id = w.workspace_id) AS owned_catalog_count
        FROM workspaces w
    """,
    "default_catalogs": f"""
        {_META}
        SELECT catalog_id, name, owner_workspace_id FROM catalogs WHERE lower(name) = 'default'
        QUALIFY row_number() OVER (PARTITION BY owner_workspace_id ORDER BY created_at, catalog_id) = 1
    """,
    "owned_catalogs": f"""
        {_META}
        SELECT owner_workspace_id, deleted_at IS NULL AS live, name, catalog_id FROM catalogs
    """,
}
