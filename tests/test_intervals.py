import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tarn.operators import access
from tarn.operators.column_history import column_history
from tarn.operators.intervals import at_day
from tests.conftest import rows
from tests.test_jobs import shuffled_rows

DAY0 = date(2020, 1, 1)


def day(n):
    return None if n is None else DAY0 + timedelta(days=n)


def test_point_joins_equal_a_comparison_of_all_pairs(spark):
    rng = random.Random(3)
    points = [(rng.randrange(6), rng.choice([None, *range(-50, 400), 20_000, -20_000])) for _ in range(200)]
    ends = lambda: rng.choice([None, None, *range(-60, 500)])
    spans = [(rng.randrange(7), i, ends(), ends()) for i in range(150)]
    spans += [(0, 1000, 7, 8), (0, 1001, 8, 8), (0, 1002, 9, 3), (1, 1003, -(10**4), 10**4), (2, 1004, 0, 4096), (2, 1005, 0, 4097)]
    left = spark.createDataFrame([(k, i, day(d)) for i, (k, d) in enumerate(points)], "k int, p int, d date")
    right = spark.createDataFrame([(k, i, day(a), day(b)) for k, i, a, b in spans], "k int, i int, a date, b date")
    expected = [
        (p, i)
        for p, (k, d) in enumerate(points)
        for k2, i, a, b in spans
        if k == k2 and d is not None and (a is None or a <= d) and (b is None or d < b)
    ]
    assert rows(at_day(left, right, ["k"], "d", "a", "b"), "p", "i") == sorted(expected, key=repr)


def test_a_key_with_very_many_intervals_is_spread_by_time(spark):
    spans = spark.range(3000).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.date_add(F.lit(DAY0), F.col("id").cast("int")).alias("a"))
    spans = spans.withColumn("b", F.date_add("a", 1))
    points = spark.range(3000).select(F.lit(1).alias("k"), F.date_add(F.lit(DAY0), F.col("id").cast("int")).alias("d"))
    assert at_day(points, spans, ["k"], "d", "a", "b").count() == 3000


def test_access_as_of_a_day(spark):
    users = spark.createDataFrame([(1, "user"), (2, access.SUPERUSER), (3, "user")], "user_id int, role string")
    catalogs = spark.createDataFrame([(10, 100), (11, 101)], "catalog_id int, owner_workspace_id int")
    members = spark.createDataFrame(
        [(1, 100, day(0), day(10)), (1, 200, day(5), None), (3, 200, None, day(3))],
        "user_id int, workspace_id int, valid_from date, valid_to date",
    )
    grants = spark.createDataFrame(
        [
            (10, 200, "read", "approved", False, day(0), None), (10, 200, "write", "approved", False, day(20), day(30)),
            (11, 200, "write", "approved", True, None, None), (11, 200, "write", "rejected", False, None, None),
        ],
        "catalog_id int, workspace_id int, mode string, status string, suspended boolean, valid_from date, valid_to date",
    )
    cases = {
        (1, 10, 0): "owner", (1, 10, 9): "owner", (1, 10, 10): "read", (1, 10, 19): "read", (1, 10, 20): "write", (1, 10, 30): "read",
        (1, 10, -1): None, (1, 11, 7): None, (2, 11, -99): "owner", (3, 10, 2): "read", (3, 10, 3): None, (9, 10, 5): None,
    }
    asked = spark.createDataFrame([(u, c, day(d)) for u, c, d in [*cases, *cases]], "user_id int, catalog_id int, day date")
    got = access.access_as_of(asked, users, catalogs, members, grants).collect()
    assert {(r.user_id, r.catalog_id, (r.day - DAY0).days): r.access for r in got} == cases and len(got) == len(cases)


def history(spark, *refreshes, read=None):
    data = [("t", n, pos, name, kind) for n, columns in enumerate(refreshes) for pos, (name, kind) in enumerate(columns)]
    observed = spark.createDataFrame(data, "table_id string, refresh int, pos int, name string, type string")
    told = None if read is None else spark.createDataFrame([("t", n) for n in read], "table_id string, refresh int")
    return rows(column_history(observed, told), "name", "type", "deprecated", "since", "until", "change", "renamed_from")


def test_a_type_that_flips_back_gives_three_intervals(spark):
    assert history(spark, [("a", "int")], [("a", "int")], [("a", "text")], [("a", "int")]) == [
        ("a", "int", False, 0, 2, "initial", None), ("a", "int", False, 3, None, "retyped", None), ("a", "text", False, 2, 3, "retyped", None)]


def test_columns_go_and_come_back_and_are_renamed(spark):
    got = history(spark, [("a", "int"), ("b", "int")], [("a", "int"), ("c", "int")], [("a", "int"), ("c", "int"), ("b", "text")])
    assert got == sorted([
        ("a", "int", False, 0, None, "initial", None),
        ("b", "int", False, 0, 1, "initial", None), ("b", "int", True, 1, 2, "deprecated", None), ("b", "text", False, 2, None, "restored", None),
        ("c", "int", False, 1, None, "added", "b"),
    ], key=repr)


def test_a_refresh_that_could_not_read_a_table_says_nothing(spark):
    flat = [("a", "int")]
    assert history(spark, flat, [], flat, read=[0, 2]) == [("a", "int", False, 0, None, "initial", None)]
    assert history(spark, flat, [], flat, read=[0, 1, 2])[1] == ("a", "int", False, 2, None, "restored", None)


def test_a_column_listed_twice_counts_once(spark):
    assert history(spark, [("a", "int"), ("a", "text")]) == [("a", "int", False, 0, None, "initial", None)]


def test_few_intervals_of_a_key_meet_their_days_uncut(spark):
    """Keys with a handful of intervals are joined as they are, not by blocks of every length."""
    points = spark.range(500).select((F.col("id") % 50).alias("k"), F.date_add(F.lit(DAY0), F.col("id").cast("int")).alias("d"))
    spans = spark.range(100).select((F.col("id") % 50).alias("k"), F.lit(DAY0).alias("a"), F.lit(None).cast("date").alias("b"))
    found = at_day(points, spans, ["k"], "d", "a", "b")
    assert found.count() == 1000
    crowded = spans.unionByName(spark.range(40).select(F.lit(7).cast("long").alias("k"), F.lit(DAY0).alias("a"), F.lit(DAY0).alias("b")))
    assert at_day(points, crowded, ["k"], "d", "a", "b").count() == 1000


def test_access_as_of_looks_at_common_workspaces_only(spark, monkeypatch):
    """A user of many workspaces is followed into those that the catalog has too, and into no others."""
    seen = []
    found = access.at_day

    def counted(points, *rest):
        seen.append(points.count())
        return found(points, *rest)

    monkeypatch.setattr(access, "at_day", counted)
    asked = spark.createDataFrame([(1, c, DAY0) for c in range(10)], "user_id long, catalog_id long, day date")
    users = spark.createDataFrame([(1, "user")], "user_id long, role string")
    catalogs = spark.createDataFrame([(c, c) for c in range(10)], "catalog_id long, owner_workspace_id long")
    ends = "valid_from date, valid_to date"
    members = spark.createDataFrame([(1, w, None, None) for w in range(5, 200)], f"user_id long, workspace_id long, {ends}")
    grants = spark.createDataFrame(
        [(0, 100, "write", "approved", False, None, None)], f"catalog_id long, workspace_id long, mode string, status string, suspended boolean, {ends}"
    )
    got = access.access_as_of(asked, users, catalogs, members, grants)
    assert rows(got, "catalog_id", "access") == sorted([(0, "write"), *((c, None if c < 5 else "owner") for c in range(1, 10))], key=repr)
    assert seen == [6, 6]


@pytest.mark.parametrize("carried, listed", [(64, 256), (6, 256), (64, 6), (0, 0)])
def test_access_as_of_with_and_without_lists(spark, monkeypatch, carried, listed):
    """Rows that come twice or have nulls, grants of all kinds; no row per asked day and workspace where lists are short."""
    monkeypatch.setattr(access, "MOST_CARRIED", carried)
    monkeypatch.setattr(access, "MOST_LISTED", listed)
    rng = random.Random(11)
    modes, states = ["read", "write", "owner", "other", None], ["approved", "approved", "approved", "pending"]

    def ends(longest):
        first = rng.randrange(900)
        return [rng.choice([first] * 9 + [None]), rng.choice([first + rng.randrange(longest)] * 9 + [None])]

    users = [(u, access.SUPERUSER if u == 3 else "user") for u in range(30)] + [(5, "user"), (6, access.SUPERUSER), (6, None), (None, access.SUPERUSER)]
    members = [(u, w, *ends(60)) for u in [*range(25), None] for w in range(20) if u != 9 or w < 4] + [(2, None, None, None)]
    members += rng.sample(members, 40) + [(u, w, *ends(60)) for u, w, *_ in rng.sample(members, 60)]
    catalogs = [(c, 20 + c % 5 if c % 3 else c % 7) for c in range(18)] + [(7, 1), (None, 2), (8, None)]
    grants = [(c, w, rng.choice(modes), rng.choice(states), rng.random() < 0.1, *ends(40)) for c in range(20) for w in range(20) if c != 5 or w < 3]
    grants += rng.sample(grants, 40) + [(4, None, "write", "approved", False, None, None)]
    asked = [(u, c, rng.choice([*range(960), None])) for u in [*range(32), None] for c in [*range(22), None] for _ in range(3)]
    asked += asked[:50]
    dates = lambda data, n: [(*r[:-n], *map(day, r[-n:])) for r in data]
    frames = (
        spark.createDataFrame(dates(asked, 1), "user_id long, catalog_id long, day date"),
        spark.createDataFrame(users, "user_id long, role string"),
        spark.createDataFrame(catalogs, "catalog_id long, owner_workspace_id long"),
        spark.createDataFrame(dates(members, 2), "user_id long, workspace_id int, valid_from date, valid_to date"),
        spark.createDataFrame(
            dates(grants, 2), "catalog_id long, workspace_id long, mode string, status string, suspended boolean, valid_from date, valid_to date"
        ),
    )
    holds = lambda a, b, d: (a is None or a <= d) and (b is None or d < b)
    names, expected = {n: mode for mode, n in access.RANKS.items()}, {}
    for u, c, d in asked:
        levels = []
        if None not in (u, c, d):
            mine = {w for v, w, a, b in members if v == u and w is not None and holds(a, b, d)}
            levels += [3] * (u in (3, 6)) + [3 for k, w in catalogs if k == c and w in mine]
            levels += [access.RANKS.get(m, 0) for k, w, m, s, held, a, b in grants if k == c and w in mine and s == "approved" and not held and holds(a, b, d)]
        expected[u, c, d] = names.get(max(levels, default=0))
    assert set(expected.values()) == {None, "read", "write", "owner"}
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = access.access_as_of(*frames)
        assert rows(got) == sorted(((u, c, day(d), mode) for (u, c, d), mode in expected.items()), key=repr)
        if (carried, listed) == (64, 256):
            monkeypatch.setattr(access, "cut_lineage", lambda df: df)
            assert max(shuffled_rows(access.access_as_of(*frames))) < 1.5 * len(asked)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
