from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tarn.operators import layers, schema_drift
from tarn.plans import reports
from tarn.session import cut_lineage
from tarn.sources import lake
from tarn.sources.contracts import CONTRACTS
from tarn.sources.paths import day_parts, root_of, table_root
from tests.conftest import rows


def test_paths():
    assert root_of("s3a://b/raw/x/**/*.parquet") == "s3a://b/raw/x"
    assert root_of("/b/raw/x/") == "/b/raw/x"
    assert root_of("/b/one.parquet") == "/b/one.parquet"
    assert table_root("/l/", source="s") == "/l/raw/s"
    assert table_root("/l", catalog="c", schema="s", table="t") == "/l/c/s/t"
    assert day_parts("2025-05-07") == {"year": "2025", "month": "05", "day": "07"}
    for wrong in ("2025-13-01", "yesterday"):
        with pytest.raises(ValueError):
            day_parts(wrong)
    with pytest.raises(ValueError):
        table_root("/l", catalog="c", schema="s")


def test_day_write_replaces_one_day(spark, tmp_path):
    root = str(tmp_path)

    def day(n, d):
        df = spark.range(n).withColumn("v", F.lit(d))
        lake.write_day(lake.with_source_date(df, d), root, d, source="s")

    day(3, "2025-05-06")
    day(4, "2025-05-07")
    day(2, "2025-05-07")
    path = f"{root}/raw/s/**/*.parquet"
    assert lake.read_table(spark, path).count() == 5
    got = lake.read_day(spark, path, "2025-05-07")
    assert got.count() == 2 and rows(got.select("month", "day").distinct()) == [("05", "07")]
    assert (tmp_path / "raw/s/year=2025/month=05/day=06").is_dir()
    # Nothing to write leaves the day as it is.
    lake.write_day(lake.with_source_date(spark.range(0).withColumn("v", F.lit("")), "2025-05-07"), root, "2025-05-07", source="s")
    assert lake.read_day(spark, path, "2025-05-07").count() == 2


def test_day_defaults_to_today(spark, tmp_path):
    root = lake.write_day(lake.with_source_date(spark.range(2)), str(tmp_path), source="s")
    assert lake.read_day(spark, root, date.today()).count() == 2


def test_day_read_opens_one_folder(spark, tmp_path):
    df = spark.range(30).withColumn("source_date", F.date_add(F.lit("2025-05-01").cast("date"), F.col("id").cast("int")))
    root = lake.write_days(df, str(tmp_path), source="s")
    got = lake.read_day(spark, root, "2025-05-09")
    assert all("/year=2025/month=05/day=09/" in f for f in got.inputFiles())
    assert "EqualTo(source_date,2025-05-09)" in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got, "id", "year", "month", "day") == [(8, "2025", "05", "09")]
    # No such day, or files that are not kept by day.
    assert lake.read_day(spark, root, "2024-01-01").isEmpty()
    df.coalesce(1).write.parquet(str(tmp_path / "flat"))
    assert rows(lake.read_day(spark, str(tmp_path / "flat"), "2025-05-09"), "id") == [(8,)]


def test_partition_names_are_reserved(spark, tmp_path):
    with pytest.raises(ValueError):
        lake.write_day(spark.range(1).withColumn("day", F.lit(1)), str(tmp_path), "2025-05-01", source="s")


def test_files_with_different_columns(spark, tmp_path):
    root = str(tmp_path)
    lake.write_day(spark.range(1).withColumn("a", F.lit(1)), root, "2025-05-01", source="s")
    lake.write_day(spark.range(1).withColumn("b", F.lit("x")), root, "2025-05-02", source="s")
    merged = lake.read_table(spark, f"{root}/raw/s", merge_schema=True)
    assert rows(merged, "a", "b") == [(1, None), (None, "x")]


def test_folder_of_several_tables(spark, tmp_path):
    for name in ("a", "b"):
        lake.write_day(spark.range(2).withColumn("source", F.lit(name)), str(tmp_path), "2025-05-01", source=name)
    everything = lake.read_table(spark, f"{tmp_path}/raw/**/*.parquet")
    assert everything.columns == ["id", "source"] and everything.count() == 4


def test_result_envelope(spark):
    got = lake.collect_result(spark.range(5000), page=2000)
    assert (got["ok"], got["columns"], got["row_count"]) == (True, ["id"], 5000)
    pages = list(got["pages"])
    assert [len(p) for p in pages] == [2000, 2000, 1000]
    assert sorted(r[0] for p in pages for r in p) == list(range(5000))
    broken = spark.range(1).select(F.raise_error(F.lit("boom")).cast("string").alias("x")).where("x = 'y'")
    failed = lake.collect_result(broken)
    assert not failed["ok"] and "boom" in failed["error"]


def test_sql_finds_tables_in_the_parsed_query(spark, tmp_path):
    lk = lake.Lake(spark, str(tmp_path))
    for name in ("orders", "more"):
        lk.register(f"shop.sales.{name}")
        lake.write_day(spark.range(4), str(tmp_path), "2025-05-01", catalog="shop", schema="sales", table=name)
    assert lk.sql("SELECT 'see shop.sales.orders now' AS t, \"read_parquet('x')\" AS u").first() == (
        "see shop.sales.orders now",
        "read_parquet('x')",
    )
    nested = "SELECT count(*) AS n FROM shop.sales.orders WHERE id IN (SELECT max(id) FROM shop.sales.more)"
    assert lk.sql(nested).first().n == 1
    both = [lk.patterns["shop.sales.orders"], lk.patterns["shop.sales.more"]]
    listed = f"SELECT count(*) AS n FROM read_parquet(['{both[0]}', \"{both[1]}\"], union_by_name = true)"
    assert lk.sql(listed).first().n == 8
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("lake_")]
    spark.range(3).createOrReplaceTempView("private")
    for text in ("SELECT * FROM private", "SELECT * FROM shop.sales.more", f"SELECT * FROM parquet.`{tmp_path}`", nested):
        with pytest.raises(PermissionError):
            lk.sql(text, names=["shop.sales.orders"])
    with_cte = "WITH x AS (SELECT * FROM shop.sales.orders) SELECT count(*) AS n FROM x"
    assert lk.sql(with_cte, names=["shop.sales.orders"]).first().n == 4
    with pytest.raises(ValueError):
        lk.sql("SELECT * FROM read_parquet(1)")


def test_registry_is_a_table(spark, tmp_path):
    lk = lake.Lake(spark, str(tmp_path))
    lk.register("a.b.c", "s3a://x/y/**/*.parquet")
    lk.register("a.b.d")
    lk.save_registry(f"{tmp_path}/registry")
    again = lake.Lake(spark, str(tmp_path))
    again.load_registry(spark.read.parquet(f"{tmp_path}/registry"))
    assert again.patterns == lk.patterns


def test_a_broken_file_skips_its_table_only(spark, tmp_path):
    lk = lake.Lake(spark, str(tmp_path))
    for name in ("c.s.good", "c.s.bad", "c.s.none"):
        lk.register(name)
    lake.write_day(spark.range(1), str(tmp_path), "2025-05-01", catalog="c", schema="s", table="good")
    folder = tmp_path / "c/s/bad/year=2025/month=05/day=01"
    folder.mkdir(parents=True)
    (folder / "x.parquet").write_bytes(b"this is no parquet file at all")
    assert list(lk.schemas()) == ["c.s.good"]


def test_lake_names_and_sql(spark, tmp_path):
    lk = lake.Lake(spark, str(tmp_path))
    assert lk.register("shop.sales.orders") == f"{tmp_path}/shop/sales/orders/**/*.parquet"
    lk.register("shop.sales.later")
    lake.write_day(spark.range(7), str(tmp_path), "2025-05-01", catalog="shop", schema="sales", table="orders")
    assert lk.table("shop.sales.orders").count() == 7
    assert lk.sql("SELECT count(*) AS n FROM shop.sales.orders").first().n == 7
    pattern = lk.patterns["shop.sales.orders"]
    assert lk.sql(f"SELECT max(id) AS m FROM read_parquet('{pattern}');").first().m == 6
    assert lk.preview("shop.sales.orders", 3).count() == 3
    assert rows(lk.describe_table("shop.sales.orders"))[0] == (0, "id", "bigint")
    assert lk.create_views() == ["shop.sales.orders"]
    with pytest.raises(PermissionError):
        lk.sql(f"SELECT * FROM read_parquet('{pattern}')", names=[])
    with pytest.raises(ValueError):
        lk.register("orders")
    with pytest.raises(KeyError):
        lk.table("shop.sales.none")


# What console users write: file functions, ordinals, filtered aggregates, plural intervals, casts.
DIALECT_SQL = {
    "filtered aggregates": (
        """SELECT status, count(*) FILTER (WHERE dispute) AS disputed, max(amount_usd)::INT AS top
           FROM read_parquet('{root}/raw/charges/**/*.parquet')
           WHERE created_at >= current_date - INTERVAL 30000 DAYS GROUP BY 1 ORDER BY 2 DESC LIMIT 5;""",
        [("failed", 0, 4), ("succeeded", 1, 10)],
    ),
    "periods": (
        """select count(distinct date_trunc('week', created_at)) weeks, min(date_trunc('quarter', created_at)) q
           from READ_PARQUET('{root}/raw/shop_orders/**/*.parquet')
           where created_at < now() - interval 48 hours and fulfillment_status is null""",
        [(1, datetime(2025, 4, 1))],
    ),
    "join using": (
        """SELECT a.order_id, round(b.total_usd * 2, 1) AS twice
           FROM read_parquet('{root}/raw/shop_orders/**/*.parquet') a
           JOIN read_parquet('{root}/raw/shop_orders/**/*.parquet') b USING (order_id)
           WHERE b.total_usd IS NOT NULL AND a.order_id NOT IN ('9')""",
        [("1", 10.0)],
    ),
    "left join with a condition": (
        """SELECT s.plan_name, count(c.status) AS n FROM raw.sources.subscriptions s
           LEFT JOIN raw.sources.charges c ON c.amount_usd = s.amount_usd AND c.status = 'succeeded'
           GROUP BY 1""",
        [("Basic", 1), ("Pro", 0)],
    ),
}


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("shop"))
    at = datetime(2025, 5, 26, 10)

    def put(name, data):
        names = [f.name for f in CONTRACTS[name].fields]
        full = [tuple(r.get(n) for n in names) for r in data]
        lake.write_day(spark.createDataFrame(full, CONTRACTS[name]), root, "2025-05-27", source=name)

    put("subscriptions", [
        {"plan_name": "Pro", "amount_usd": 99.0, "status": "active"},
        {"plan_name": "Pro", "amount_usd": 0.1, "status": "active"},
        {"plan_name": "Basic", "amount_usd": 10.0, "status": "canceled"},
    ])
    put("charges", [
        {"amount_usd": 10.0, "status": "succeeded", "refunded": False, "dispute": True, "created_at": at},
        {"amount_usd": 4.0, "status": "failed", "refunded": None, "dispute": False, "created_at": at},
    ])
    put("shop_orders", [
        {"order_id": "1", "financial_status": "paid", "created_at": at, "total_usd": 5.0},
        {"order_id": "2", "financial_status": "paid", "fulfillment_status": "done", "created_at": at},
        {"order_id": "3", "financial_status": "paid", "created_at": datetime(2025, 5, 26, 13)},
    ])
    return lake.Lake(spark, root)


@pytest.mark.parametrize("name", sorted(DIALECT_SQL))
def test_console_sql(shop, name):
    text, expected = DIALECT_SQL[name]
    for source in ("charges", "subscriptions"):
        shop.register_source(source)
    assert rows(shop.sql(text.format(root=shop.root))) == expected


def test_tables_of_visible_catalogs(shop):
    shop.register("other.s.t")
    seen = shop.tables_of(["raw"])
    assert seen and all(n.startswith("raw.sources.") for n in seen)
    assert shop.sql("SELECT count(*) AS n FROM raw.sources.charges", names=seen).first().n == 2
    with pytest.raises(Exception):
        shop.sql("SELECT count(*) AS n FROM raw.sources.charges", names=[])


def test_reports_on_contract_tables(spark, shop):
    def read(name):
        return lake.read_table(spark, f"{shop.root}/raw/{name}")

    assert rows(reports.mrr_by_plan(read("subscriptions"))) == [("Pro", 2, 99.1)]
    # No refunded row: the sum is unknown, not zero; the count is zero.
    assert rows(reports.daily_revenue(read("charges"), "2025-05-27")) == [(datetime(2025, 5, 26), 10.0, None, 1)]
    late = reports.stale_unfulfilled(read("shop_orders"), datetime(2025, 5, 28, 12))
    assert rows(late, "order_id") == [("1",)]


def test_empty_reports(spark):
    deals = spark.createDataFrame([], CONTRACTS["deals"])
    assert reports.win_rate(deals).count() == 0
    assert reports.open_deals(deals).count() == 0


def registry(spark, columns):
    return spark.createDataFrame(
        [("t", [tuple(c) for c in columns], False)],
        f"table_id string, column_defs {schema_drift.COLUMN_DEFS}, schema_drift boolean",
    )


def merged(spark, recorded, found):
    inferred = spark.createDataFrame([("t", i, n, k) for i, (n, k) in enumerate(found)], schema_drift.INFERRED)
    old = schema_drift.registry_columns(registry(spark, recorded))
    out = schema_drift.column_lists(schema_drift.merge_columns(old, inferred)).first()
    return [tuple(c) for c in out.column_defs], out.schema_drift


@pytest.mark.parametrize(
    "recorded, found, expected, drift",
    [
        ([], [("a", "int")], [("a", "int", None, False)], True),
        ([("a", "int", "x", False)], [("a", "int")], [("a", "int", "x", False)], False),
        ([("a", "int", "x", False)], [("a", "bigint")], [("a", "bigint", "x", False)], True),
        ([("a", "int", "x", True)], [("a", "int")], [("a", "int", "x", False)], True),
        (
            [("b", "int", "x", False), ("a", "int", None, False)],
            [("a", "int")],
            [("a", "int", None, False), ("b", "int", "x", True)],
            True,
        ),
        (
            [("b", "int", "x", True), ("a", "int", None, False)],
            [("a", "int")],
            [("a", "int", None, False), ("b", "int", "x", True)],
            False,
        ),
    ],
)
def test_schema_transitions(spark, recorded, found, expected, drift):
    assert merged(spark, recorded, found) == (expected, drift)


def test_refresh_leaves_unreadable_tables_alone(spark, tmp_path):
    lk = lake.Lake(spark, str(tmp_path))
    for name in ("c.s.here", "c.s.empty"):
        lk.register(name)
    lake.write_day(spark.range(1), str(tmp_path), "2025-05-01", catalog="c", schema="s", table="here")
    known = [("x", "int", "planned", False)]
    entries = spark.createDataFrame(
        [("c.s.here", [], False), ("c.s.empty", known, False)],
        f"table_id string, column_defs {schema_drift.COLUMN_DEFS}, schema_drift boolean",
    )
    fresh = {r.table_id: r for r in schema_drift.refresh_catalog(lk, entries).collect()}
    assert [tuple(c) for c in fresh["c.s.empty"].column_defs] == known
    assert not fresh["c.s.empty"].schema_drift
    assert [c.name for c in fresh["c.s.here"].column_defs] == ["id", "year", "month", "day"]
    assert fresh["c.s.here"].schema_drift
    again = schema_drift.refresh_catalog(lk, schema_drift.refresh_catalog(lk, entries))
    assert not any(r.schema_drift for r in again.collect())


def test_changed_type_is_drift_and_stays_readable(spark, tmp_path):
    lk = lake.Lake(spark, str(tmp_path))
    lk.register("c.s.t")
    target = {"catalog": "c", "schema": "s", "table": "t"}
    lake.write_day(spark.range(2).selectExpr("CAST(id AS INT) AS id", "'x' AS old"), lk.root, "2025-05-01", **target)
    before = schema_drift.refresh_catalog(lk, registry(spark, []).withColumn("table_id", F.lit("c.s.t")))
    before = cut_lineage(before)
    lake.write_day(spark.range(3), lk.root, "2025-05-02", **target)
    after = schema_drift.refresh_catalog(lk, before).first()
    types = {c.name: (c.type, c.deprecated) for c in after.column_defs}
    assert after.schema_drift and types["id"] == ("bigint", False) and types["old"] == ("string", True)
    wide = lake.table_schema(spark, lk.patterns["c.s.t"])
    assert lk.table("c.s.t", schema=wide).agg(F.sum("id")).first()[0] == 4


def test_silver_and_layers(spark):
    df = spark.createDataFrame(
        [("1", "5", "2025-05-01"), ("1", "x", "2025-05-02"), ("2", "7", "2025-05-01")],
        "id string, qty string, at string",
    )
    shape = layers.T.StructType.fromDDL("id int, qty int, at date, note string")
    silver = layers.to_silver(df, ["id"], [F.col("at").desc()], shape, {"qty": 0, "note": "-"})
    assert rows(silver) == [(1, 0, date(2025, 5, 2), "-"), (2, 7, date(2025, 5, 1), "-")]
    assert layers.layer_of("silver") == "silver" and layers.layer_of("revenue") == "custom"


def test_cosine_in_sql(spark, tmp_path):
    """Pairs are multiplied in batches; conditions of outer joins, which take no Python function, get the same numbers."""
    made = [(1, [3.0, 4.0]), (2, [4.0, 3.0]), (3, [0.0, 0.0]), (4, [1.0]), (5, None), (6, [1.0, None]), (7, [])]
    lk = lake.Lake(spark, str(tmp_path))
    spark.createDataFrame(made, "i int, v array<float>").write.parquet(f"{tmp_path}/v.parquet")
    lk.register("a.b.v", f"{tmp_path}/v.parquet")
    pairs = lk.sql("SELECT p.i, q.i AS j, cosine(p.v, q.v) AS c FROM a.b.v p JOIN a.b.v q")
    assert "ArrowEvalPython" in pairs._jdf.queryExecution().executedPlan().toString()
    got = {(r.i, r.j): r.c for r in pairs.collect()}
    assert {k: round(c, 12) for k, c in got.items() if c is not None} == {(1, 1): 1.0, (2, 2): 1.0, (1, 2): 0.96, (2, 1): 0.96, (4, 4): 1.0}
    outer = lk.sql("SELECT p.i, q.i AS j FROM a.b.v p LEFT JOIN a.b.v q ON p.i <> q.i AND cosine(p.v, q.v) > 0.9")
    assert rows(outer) == sorted([(1, 2), (2, 1), *((i, None) for i in (3, 4, 5, 6, 7))], key=repr)
    assert lk.sql("SELECT cosine(array(3, 4), array(4.0, 3.0)) AS c").first().c == pytest.approx(0.96)


def test_sql_over_all_pairs_is_dealt_to_tasks(spark, tmp_path, monkeypatch):
    """A table of vectors in one file is cut into blocks where every row meets every other, and nowhere else."""
    monkeypatch.setattr(lake, "BLOCK_ROWS", 200, raising=False)
    made = spark.range(600).select("id", F.array(F.col("id") + 1.0, F.lit(1.0)).cast("array<float>").alias("v"))
    made.coalesce(1).write.parquet(f"{tmp_path}/v.parquet")
    lk = lake.Lake(spark, str(tmp_path))
    lk.register("a.b.v", f"{tmp_path}/v.parquet")
    pairs = lk.sql("SELECT p.id, q.id AS j, cosine(p.v, q.v) AS c FROM a.b.v p JOIN a.b.v q ON q.id % 20 = 0")
    assert pairs.rdd.getNumPartitions() >= 3
    found = pairs.where("j = 40")
    assert pairs.count() == 600 * 30 and found.count() == 600
    assert found.where("id = 40").first().c == pytest.approx(1.0) and found.where("id = 0").first().c == pytest.approx(42 / (2 * (41**2 + 1)) ** 0.5)
    alone = lk.sql("SELECT p.id FROM a.b.v p JOIN a.b.v q ON p.id = q.id WHERE cosine(p.v, q.v) > 0.5")
    assert "RoundRobin" not in alone._jdf.queryExecution().executedPlan().toString() and alone.count() == 600
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("lake_")]
