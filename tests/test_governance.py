from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tarn.operators import access, retention, storage
from tarn.sources.lake import write_day
from tarn.sources.objects import list_objects
from tests.conftest import rows
from tests.test_jobs import shuffled_rows

OBJECTS = "key string, size long, last_modified timestamp"


def listing(spark, *entries):
    return spark.createDataFrame(list(entries), OBJECTS)


def test_rollups(spark):
    t1, t2 = datetime(2025, 5, 1, 8), datetime(2025, 5, 2, 9, 30)
    objects = listing(spark, ("raw/a/x.parquet", 1024, t1), ("raw/b/y.parquet", 512, t2), ("top.txt", 0, t1))
    assert rows(storage.storage_totals(objects)) == [(3, 1536, "1.5 KB")]
    assert rows(storage.storage_inventory(objects), "prefix", "objects", "size", "last_modified_str") == [
        ("raw", 2, "1.5 KB", "2025-05-02 09:30 UTC"),
        ("top.txt", 1, "0 B", "2025-05-01 08:00 UTC"),
    ]
    assert rows(storage.dataset_listing(objects, "s3a://l/"), "prefix", "path") == [
        ("raw/a", "s3a://l/raw/a/**/*.parquet"),
        ("raw/b", "s3a://l/raw/b/**/*.parquet"),
        ("top.txt", "s3a://l/top.txt/**/*.parquet"),
    ]
    assert rows(storage.storage_totals(objects.limit(0))) == [(0, 0, "0 B")]


def test_freshness_of_sources(spark):
    now = datetime(2025, 5, 10)
    objects = listing(
        spark,
        ("raw/stripe_charges/year=2025/a.parquet", 1, datetime(2025, 5, 8, 23)),
        ("raw/stripe_charges/year=2025/b.parquet", 1, datetime(2025, 5, 7)),
        ("shopify/a.parquet", 1, datetime(2025, 5, 8)),
        ("raw/hubspotter/a.parquet", 1, now),
        ("raw/x/postgres", 1, now),
        ("raw/weather/a.parquet", 1, datetime(2025, 5, 1)),
    )
    sources = spark.createDataFrame([(s,) for s in ("stripe", "shopify", "hubspot", "postgres", "weather")], "source string")
    got = rows(storage.source_freshness(objects, sources, now), "source", "status", "last_modified_str", "never")
    assert got == [
        ("hubspot", "red", "Never", True),
        ("postgres", "red", "Never", True),
        ("shopify", "yellow", "2025-05-08 00:00 UTC", False),
        ("stripe", "green", "2025-05-08 23:00 UTC", False),
        ("weather", "red", "2025-05-01 00:00 UTC", False),
    ]


def test_listing_reads_no_contents(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "one.bin").write_bytes(b"12345")
    (tmp_path / "two.bin").write_bytes(b"1")
    df = list_objects(spark, str(tmp_path))
    assert rows(df, "key", "size") == [("a/b/one.bin", 5), ("two.bin", 1)]
    assert "content" not in df._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]


def test_prefixes_never_cover_too_much(spark):
    cases = {
        "s3a://lake/prod/x/t/**/*.parquet": "prod/x/t",
        "s3a://lake/prod/x/t/": "prod/x/t",
        "s3a://lake/prod/x/t/part-*.parquet": "prod/x/t",
        "s3a://lake/**/*.parquet": "",
        "s3a://lake/": "",
        "s3a://other/prod/t/**": "",
        "s3a://lakes/prod/t/**": "",
        "s3a://lake/*/t/**": "",
    }
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    got = df.select("p", retention.dataset_prefix(F.col("p"), "s3a://lake").alias("x")).collect()
    assert {r.p: r.x for r in got} == cases


@pytest.fixture(scope="module")
def metadata(spark):
    at = datetime(2025, 5, 1)
    catalogs = spark.createDataFrame(
        [
            (1, "alpha", 10, at, None, None),
            (2, "beta", 20, at, at, datetime(2025, 5, 31)),
            (3, "Default", 20, datetime(2025, 5, 3), None, None),
            (4, "default", 20, datetime(2025, 5, 2), None, None),
            (5, "gamma", 30, at, None, None),
        ],
        "catalog_id int, name string, owner_workspace_id int, created_at timestamp, deleted_at timestamp, scheduled_purge_at timestamp",
    )
    workspaces = spark.createDataFrame(
        [(10, "A", "active", None), (20, "B", "active", None), (30, "C", "inactive", datetime(2025, 5, 20))],
        "workspace_id int, name string, status string, scheduled_purge_at timestamp",
    )
    users = spark.createDataFrame([(100, "superadmin"), (101, "user"), (102, "user"), (103, "user")], "user_id int, role string")
    members = spark.createDataFrame([(10, 101, "admin"), (20, 101, "user"), (20, 102, "user")], "workspace_id int, user_id int, role string")
    grants = spark.createDataFrame(
        [
            ("g1", 1, 20, "read", "approved", False, at),
            ("g2", 5, 10, "read", "approved", False, at),
            ("g3", 5, 20, "write", "approved", False, at),
            ("g4", 4, 10, "write", "pending", False, at),
            ("g5", 3, 10, "write", "rejected", False, at),
            ("g6", 1, 30, "write", "approved", True, at),
            ("g7", 2, 10, "write", "pending", False, at),
        ],
        "access_id string, catalog_id int, workspace_id int, mode string, status string, suspended boolean, requested_at timestamp",
    )
    return {"catalogs": catalogs, "workspaces": workspaces, "users": users, "members": members, "grants": grants}


def test_effective_access(spark, metadata):
    asked = spark.createDataFrame(
        [(100, 5), (101, 1), (101, 5), (102, 1), (102, 5), (103, 1), (101, 4), (101, 5), (999, 1), (101, 77)],
        "user_id int, catalog_id int",
    )
    got = access.effective_access(asked, metadata["users"], metadata["members"], metadata["catalogs"], metadata["grants"])
    assert {(r.user_id, r.catalog_id): r.access for r in got.collect()} == {
        (100, 5): "owner",
        (101, 1): "owner",
        (101, 4): "owner",
        (101, 5): "write",
        (102, 1): "read",
        (102, 5): "write",
        (103, 1): None,
        (999, 1): None,
        (101, 77): None,
    }
    levels = got.where("user_id = 102 AND catalog_id = 1").select(
        access.allowed(F.col("access"), "read"), access.allowed(F.col("access"), "write")
    )
    assert rows(levels) == [(True, False)]


def test_suspended_grants_give_nothing(spark, metadata):
    member = spark.createDataFrame([(30, 103, "user")], "workspace_id int, user_id int, role string")
    asked = spark.createDataFrame([(103, 1)], "user_id int, catalog_id int")
    got = access.effective_access(asked, metadata["users"], member, metadata["catalogs"], metadata["grants"])
    assert got.first().access is None


def test_visible_catalogs(metadata):
    def seen(user):
        df = access.visible_catalogs(user, metadata["users"], metadata["members"], metadata["catalogs"], metadata["grants"])
        return [r.catalog_id for r in df.collect()]

    assert seen(100) == [1, 5, 4, 3]
    assert seen(102) == [1, 5, 4, 3]
    assert seen(103) == []
    by_workspace = access.workspace_catalogs(metadata["catalogs"], metadata["grants"])
    assert rows(by_workspace.where("workspace_id = 10"), "catalog_id") == [(1,), (5,)]
    assert by_workspace.where("catalog_id = 2").isEmpty()


def test_directory_requests_usage(spark, metadata):
    schemas = spark.createDataFrame([("s1", 4), ("s2", 4), ("s3", 5)], "schema_id string, catalog_id int")
    directory = access.catalog_directory(10, metadata["catalogs"], metadata["workspaces"], schemas, metadata["grants"])
    assert rows(directory, "catalog_id", "schema_count", "access_status", "owner_workspace_name") == [
        (3, 0, "none", "B"),
        (4, 2, "pending", "B"),
        (5, 1, "approved", "C"),
    ]
    pending = access.pending_requests(metadata["catalogs"], metadata["workspaces"], metadata["grants"])
    assert rows(pending, "owner_workspace_id", "access_id", "requesting_workspace_name") == [(20, "g4", "A")]
    usage = access.workspace_usage(metadata["workspaces"], metadata["members"], metadata["catalogs"])
    assert rows(usage, "workspace_id", "member_count", "owned_catalog_count") == [(10, 1, 1), (20, 2, 2), (30, 0, 1)]
    assert rows(access.default_catalogs(metadata["catalogs"]), "catalog_id") == [(4,)]
    owned = access.owned_catalogs(metadata["catalogs"]).where("owner_workspace_id = 20").collect()
    assert [r.name for r in owned] == ["Default", "default", "beta"]


def test_purge(spark, tmp_path, metadata):
    root = str(tmp_path)
    tables = []
    for catalog, name in ((1, "alpha"), (2, "beta"), (5, "gamma")):
        write_day(spark.range(10), root, "2025-05-01", catalog=name, schema="s", table="t")
        tables.append((catalog, f"{name}.s.t", f"{root}/{name}/s/t/**/*.parquet"))
    # A neighbour whose name only starts alike.
    write_day(spark.range(5), root, "2025-05-01", catalog="beta", schema="s", table="t2")
    tables.append((2, "beta.s.none", f"{root}/beta/s/none/**/*.parquet"))
    tables.append((2, "beta.all", f"{root}/**/*.parquet"))
    tables = spark.createDataFrame(tables, "catalog_id int, table_id string, path_pattern string")

    def due_at(as_of):
        return retention.due_catalogs(metadata["catalogs"], as_of, metadata["workspaces"])

    def plan(as_of):
        return retention.purge_plan(retention.due_prefixes(due_at(as_of), tables, root), list_objects(spark, root))

    assert plan("2025-05-19").count() == 0
    assert rows(plan("2025-05-20"), "table_id") == [("gamma.s.t",)]
    due = plan("2025-06-01")
    files = {r.table_id: r.objects for r in due.collect()}
    assert set(files) == {"beta.s.t", "beta.s.none", "beta.all", "gamma.s.t"}
    assert files["beta.s.none"] == 0 and files["beta.s.t"] > 0
    assert rows(retention.withheld(due), "catalog_id", "reason") == [(2, "no folder in the pattern")]
    left = retention.purge_apply(due, root, metadata["catalogs"], due_at("2025-06-01"))
    # A catalog with a pattern that names no folder stays, as data may remain.
    assert rows(left, "catalog_id") == [(1,), (2,), (3,), (4,)]
    assert not (tmp_path / "beta/s/t").exists() and not (tmp_path / "gamma/s/t").exists()
    assert (tmp_path / "beta/s/t2").exists() and (tmp_path / "alpha/s/t").exists()


@pytest.mark.parametrize(
    "mine, live, refused",
    [
        ("shared/**", "shared/s/t/**/*.parquet", True),
        ("shared/s/t/**", "shared/**/*.parquet", True),
        ("shared/s/t/**", "shared/s/t/**", True),
        ("shared/s/t/**", "shared/s/t2/**", False),
        ("shared/s/t/**", "**/*.parquet", True),
    ],
)
def test_purge_leaves_live_data_alone(spark, tmp_path, mine, live, refused):
    root = str(tmp_path)
    for name in ("t", "t2"):
        write_day(spark.range(3), root, "2025-05-01", catalog="shared", schema="s", table=name)
    tables = spark.createDataFrame(
        [(1, "mine", f"{root}/{mine}"), (2, "live", f"{root}/{live}")], "catalog_id int, table_id string, path_pattern string"
    )
    catalogs = spark.createDataFrame([(1,), (2,), (3,)], "catalog_id int")
    due = spark.createDataFrame([(1,), (3,)], "catalog_id int")
    plan = retention.purge_plan(retention.due_prefixes(due, tables, root), list_objects(spark, root))
    assert [r.overlaps for r in plan.collect()] == [refused]
    left = retention.purge_apply(plan, root, catalogs, due)
    # The due catalog without tables leaves the metadata in any case.
    assert rows(left) == ([(1,), (2,)] if refused else [(2,)])
    assert (tmp_path / "shared/s/t").exists() == refused and (tmp_path / "shared/s/t2").exists()


def test_grace_period(spark):
    at = F.lit("2025-05-01").cast("timestamp")
    assert spark.range(1).select(retention.purge_date(at).alias("x")).first().x == datetime(2025, 5, 31)
    with pytest.raises(ValueError):
        retention.purge_date(at, 366)


@pytest.mark.parametrize("most", [0, 3, 256])
def test_visible_catalogs_of_all_at_the_first_workspace(spark, monkeypatch, most):
    """A catalog seen through several workspaces comes once, whether the lists of workspaces are short or too long to carry."""
    monkeypatch.setattr(access, "MOST_LISTED", most)
    users = [(u, access.SUPERUSER if u == 3 else "user") for u in range(8)]
    members = [(u, w) for u in [*range(7), None] for w in range(12) if u is None or (u * w) % 5 < 2] * 2 + [(2, None)]
    catalogs = [(c, f"c{c}", c % 4, None if c % 6 else date(2024, 1, 1)) for c in range(30)]
    grants = [(c, w, "read", "approved" if w % 3 else "pending", c == w) for c in range(30) for w in range(12) if (c + w) % 3 == 0 or c == 1]
    frames = (
        spark.createDataFrame(users, "user_id long, role string"),
        spark.createDataFrame(members, "user_id long, workspace_id long"),
        spark.createDataFrame(catalogs, "catalog_id long, name string, owner_workspace_id long, created_at date").withColumn(
            "deleted_at", F.when(F.col("created_at").isNotNull(), F.lit("2024-02-01").cast("timestamp"))
        ),
        spark.createDataFrame(grants, "catalog_id long, workspace_id long, mode string, status string, suspended boolean"),
    )
    live = {c for c, *_, made in catalogs if made is None}
    sees = {(w, c) for c, _, w, _ in catalogs if c in live} | {(w, c) for c, w, _, s, held in grants if c in live and s == "approved" and not held}
    expected = {(u, c) for u, w in members if u != 3 for v, c in sees if v == w} | {(3, None)}
    got = access.visible_catalogs_of_all(*frames)
    assert rows(got, "user_id", "catalog_id") == sorted(expected, key=repr)


@pytest.mark.parametrize("carried, listed", [(64, 256), (2, 256), (64, 3), (0, 0)])
def test_effective_access_with_and_without_lists(spark, monkeypatch, carried, listed):
    """Users and catalogs that come twice or are null, grants of all kinds, and no row per pair and workspace where lists are short."""
    monkeypatch.setattr(access, "MOST_CARRIED", carried)
    monkeypatch.setattr(access, "MOST_LISTED", listed)
    users = [(u, access.SUPERUSER if u == 3 else "user") for u in range(40)] + [(5, "user"), (6, access.SUPERUSER), (6, None), (None, access.SUPERUSER)]
    members = [(u, w) for u in [*range(35), None] for w in range(20) if (u or 0) % 9 == 4 or (u or 0) * w % 7 < 3] * 2 + [(2, None)]
    catalogs = [(c, c % 11 if c % 5 else None) for c in range(30)] + [(7, 1), (None, 2)]
    modes, states = ["read", "write", "owner", "other", None], ["approved", "approved", "pending"]
    grants = [(c, w, modes[(c + w * w) % 5], states[(c * w) % 3], w % 8 == 7) for c in range(33) for w in range(20) if (c + w) % 2 or c == 1] + [(4, None, "write", "approved", False)]
    asked = [(u, c) for u in [*range(42), None] for c in [*range(34), None]]
    frames = (
        spark.createDataFrame(asked + asked[:50], "user_id long, catalog_id long"),
        spark.createDataFrame(users, "user_id long, role string"),
        spark.createDataFrame(members, "user_id long, workspace_id long"),
        spark.createDataFrame(catalogs, "catalog_id long, owner_workspace_id long"),
        spark.createDataFrame(grants, "catalog_id long, workspace_id long, mode string, status string, suspended boolean"),
    )
    levels = {(c, w, 3) for c, w in catalogs} | {(c, w, access.RANKS.get(m)) for c, w, m, s, held in grants if s == "approved" and not held}
    names, expected = {n: mode for mode, n in access.RANKS.items()}, {}
    for u, c in asked:
        mine = {w for v, w in members if v == u and w is not None}
        best = max([3] * (u in (3, 6)) + [n for k, w, n in levels if k == c and w in mine and n and u is not None and c is not None], default=None)
        expected[u, c] = names.get(best)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(access.effective_access(*frames)) == sorted(((*k, v) for k, v in expected.items()), key=repr)
        if carried == 64 and listed == 256:
            monkeypatch.setattr(access, "cut_lineage", lambda df: df)
            assert max(shuffled_rows(access.effective_access(*frames))) <= len(asked) + 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
