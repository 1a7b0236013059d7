import random
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tarn.operators import layers
from tarn.session import scratch_folder
from tarn.sources import upserts
from tarn.sources.contracts import contract
from tarn.sources.lake import Lake
from tests.conftest import rows

SHAPE = "k long, v int, name string, source_date date"
DAY = date(2024, 1, 30)


def frame(spark, data):
    return spark.createDataFrame(data, SHAPE)


def at(n):
    return DAY + timedelta(days=n)


def put(spark, root, data, **options):
    return upserts.upsert_days(frame(spark, data), root, ["k"], ["v"], **options)


def stored(spark, root):
    return rows(upserts.stored_rows(spark, root), "k", "v", "name", "source_date")


def parquet_files(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}


def folders(root):
    return sorted(str(p.relative_to(root)) for p in Path(root).glob("*/*/*"))


def test_untouched_days_keep_their_files_and_a_rerun_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    assert put(spark, root, [(i, 1, "a", at(i % 3)) for i in range(30)]) == ["2024-01-30", "2024-01-31", "2024-02-01"]
    before = parquet_files(root)
    batch = [(1, 2, "b", at(1)), (40, 1, "c", at(1)), (2, 1, "tie", at(2)), (3, 0, "old", at(0))]
    assert put(spark, root, batch) == ["2024-01-31"]
    after = parquet_files(root)
    assert {f for f in before if "day=31" not in f} == {f for f in after if "day=31" not in f}
    assert all(after[f] == t for f, t in before.items() if f in after)
    assert put(spark, root, batch) == [] and parquet_files(root) == after
    expected = [(i, 1, "a", at(i % 3)) for i in range(30) if i != 1] + [batch[0], batch[1]]
    assert stored(spark, root) == sorted(expected, key=repr)


def test_moved_rows_leave_their_day_and_an_empty_day_goes(spark, tmp_path):
    root = str(tmp_path / "t")
    put(spark, root, [(1, 1, "a", at(0)), (2, 1, "b", at(5)), (3, 1, "c", None), (None, 1, "n", at(0))])
    assert len(folders(root)) == 3
    assert put(spark, root, [(2, 2, "b", at(0)), (3, 2, "c", at(9)), (None, 5, "m", at(0))]) == ["", "2024-01-30", "2024-02-04", "2024-02-08"]
    assert folders(root) == ["year=2024/month=01/day=30", "year=2024/month=02/day=08"]
    assert stored(spark, root) == sorted([(1, 1, "a", at(0)), (2, 2, "b", at(0)), (3, 2, "c", at(9)), (None, 5, "m", at(0))], key=repr)
    assert not (tmp_path / "t" / upserts.STAGED).exists()


def test_random_batches_equal_a_dictionary(spark, tmp_path):
    rng, root, expected = random.Random(7), str(tmp_path / "t"), {}
    for _ in range(5):
        batch = [(rng.choice([None, *range(25)]), rng.choice([None, 1, 2, 3, 4]), rng.choice("xyz"), rng.choice([None, *map(at, range(6))])) for _ in range(30)]
        put(spark, root, batch)
        low = lambda v: -1 if v is None else v
        best = {}
        for r in sorted(batch, key=lambda r: (-low(r[1]), r[2], r[3] is not None, r[3] or DAY)):
            best.setdefault(r[0], r)
        for k, r in best.items():
            if k not in expected or low(r[1]) > low(expected[k][1]):
                expected[k] = r
        assert stored(spark, root) == sorted(expected.values(), key=repr)


def test_only_the_batch_days_are_looked_at_where_the_key_has_the_day(spark, tmp_path):
    root = str(tmp_path / "t")
    options = {"key": ["k", "source_date"], "version": ["v"], "day_of_key": True}
    upserts.upsert_days(frame(spark, [(1, 1, "a", at(0)), (1, 1, "b", at(1))]), root, **options)
    broken = next(Path(root).glob("year=2024/month=01/day=31/*.parquet"))
    broken.write_bytes(b"no parquet")
    # The first file's footer gives the columns.
    assert upserts.upsert_days(frame(spark, [(1, 2, "c", at(0)), (2, 1, "d", at(0))]), root, **options) == ["2024-01-30"]


def test_a_key_with_a_third_of_the_batch(spark, tmp_path):
    root = str(tmp_path / "t")
    n = 3000
    df = spark.range(n, numPartitions=5).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"),
        F.col("id").cast("int").alias("v"), F.lit("x").alias("name"), F.lit(DAY).alias("source_date"))
    upserts.upsert_days(df, root, ["k"], ["v"])
    got = upserts.stored_rows(spark, root)
    assert got.count() == 1 + n - n // 3 and got.where("k = -1").first().v == n - 3


def test_an_empty_batch_and_an_empty_table(spark, tmp_path):
    root = str(tmp_path / "t")
    assert put(spark, root, []) == [] and upserts.stored_rows(spark, root) is None
    put(spark, root, [(1, 1, "a", at(0))])
    assert put(spark, root, []) == [] and stored(spark, root) == [(1, 1, "a", at(0))]


def test_a_run_that_dies_before_all_days_are_written_leaves_no_trace(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    put(spark, root, [(1, 1, "a", at(0))])
    real = upserts._files

    def dies(spark, path):
        if path.endswith(upserts.READY) and (tmp_path / "t" / upserts.STAGED / "rows").exists():
            raise RuntimeError("lost")
        return real(spark, path)

    monkeypatch.setattr(upserts, "_files", dies)
    with pytest.raises(RuntimeError):
        put(spark, root, [(1, 2, "b", at(0))])
    monkeypatch.setattr(upserts, "_files", real)
    assert stored(spark, root) == [(1, 1, "a", at(0))]
    assert put(spark, root, []) == []
    assert stored(spark, root) == [(1, 1, "a", at(0))] and not (tmp_path / "t" / upserts.STAGED).exists()


def test_a_run_that_dies_while_days_move_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    put(spark, root, [(i, 1, "a", at(i)) for i in range(6)])
    real, calls = upserts._folder, []

    def dies(base, day):
        calls.append(day)
        if len(calls) > 5:
            raise RuntimeError("lost")
        return real(base, day)

    monkeypatch.setattr(upserts, "_folder", dies)
    monkeypatch.setattr(upserts, "THREADS", 1)
    batch = [(i, 2, "b", at(i)) for i in range(5)] + [(5, 2, "b", at(0))]
    with pytest.raises(RuntimeError):
        put(spark, root, batch)
    monkeypatch.setattr(upserts, "_folder", real)
    assert stored(spark, root) != sorted(batch, key=repr)
    assert upserts.recover(spark, root) and not upserts.recover(spark, root)
    assert stored(spark, root) == sorted(batch, key=repr)
    assert len(folders(root)) == 5


def test_silver_is_typed_filled_and_registered(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    shape = contract("k bigint, v int, name string, source_date date")
    df = spark.createDataFrame([("1", "1", None, "2024-01-30"), ("x", "2", "bad key", "2024-01-30")], "k string, v string, name string, source_date string")
    merge = lambda df: layers.merge_silver(df, lake, "c", "t", ["k"], ["v"], shape, {"name": "none"})
    merge(df)
    merge(spark.createDataFrame([("1", "3", "new", "2024-01-31")], df.schema))
    got = lake.table("c.silver.t")
    assert rows(got, "k", "v", "name") == sorted([(1, 3, "new"), (None, 2, "bad key")], key=repr)


ORDERS = "k long, changed timestamp, amount double, source_date date"


def orders(spark, *data):
    start = datetime(2024, 3, 1)
    return spark.createDataFrame([(k, start + timedelta(hours=h), float(a), (start + timedelta(hours=h)).date()) for k, h, a in data], ORDERS)


def loaded(spark, base):
    return rows(upserts.stored_rows(spark, f"{base}/raw/o"), "k", "amount")


def load(source, base, **options):
    return upserts.load_increment(source, base, "o", ["k"], "changed", **options)


def test_loads_go_on_from_the_mark_and_read_equal_marks_again(spark, tmp_path):
    base = str(tmp_path)
    first = [(1, 1, 10), (2, 30, 20), (3, 30, 30)]
    assert load(orders(spark, *first), base) == 3
    assert upserts.last_mark(spark, base, "o") == (1, datetime(2024, 3, 2, 6))
    # Number 4 appears at the mark of the last load, number 5 behind it.
    more = [*first, (4, 30, 40), (5, 50, 50)]
    assert load(orders(spark, *more), base) == 4
    assert load(orders(spark, *more), base) == 1
    assert loaded(spark, base) == [(k, float(10 * k)) for k in range(1, 6)]
    assert upserts.last_mark(spark, base, "o")[0] == 2
    assert load(orders(spark), base) == 0


def test_a_load_killed_between_data_and_mark_loses_and_doubles_nothing(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    load(orders(spark, (1, 1, 10)), base)
    real = upserts.write_mark

    def killed(*args):
        raise RuntimeError("killed")

    monkeypatch.setattr(upserts, "write_mark", killed)
    with pytest.raises(RuntimeError):
        load(orders(spark, (1, 1, 10), (2, 2, 20), (3, 30, 30)), base)
    monkeypatch.setattr(upserts, "write_mark", real)
    assert upserts.last_mark(spark, base, "o")[0] == 1 and len(loaded(spark, base)) == 3
    assert load(orders(spark, (1, 1, 10), (2, 2, 20), (3, 30, 30), (4, 40, 40)), base) == 4
    assert loaded(spark, base) == [(k, float(10 * k)) for k in range(1, 5)]


def test_versions_or_the_latest_row_of_a_key(spark, tmp_path):
    steps = [[(1, 1, 10), (2, 1, 20)], [(1, 60, 11), (2, 1, 20)]]
    for latest, expected in ((False, [(1, 10.0), (1, 11.0), (2, 20.0)]), (True, [(1, 11.0), (2, 20.0)])):
        base = str(tmp_path / str(latest))
        for step in steps:
            load(orders(spark, *step), base, latest=latest)
        assert loaded(spark, base) == expected


def test_overlap_finds_rows_that_became_visible_late(spark, tmp_path):
    base = str(tmp_path)
    load(orders(spark, (1, 1, 10), (2, 9, 20)), base)
    late = orders(spark, (1, 1, 10), (2, 9, 20), (3, 8, 30))
    load(late, base)
    assert len(loaded(spark, base)) == 2
    load(late, base, overlap="2 hours")
    assert loaded(spark, base) == [(1, 10.0), (2, 20.0), (3, 30.0)]


def test_a_batch_that_changes_nothing_stores_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(upserts, "SMALL_BATCH", 0, raising=False)
    root, n = str(tmp_path / "t"), 20000
    df = spark.range(n, numPartitions=4).select(
        F.col("id").alias("k"), F.lit(1).alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("name"), F.lit(DAY).alias("source_date")
    )
    upserts.upsert_days(df, root, ["k"], ["v"])
    kept = lambda: sum(p.stat().st_size for p in Path(scratch_folder(spark).removeprefix("file:")).rglob("*.parquet"))
    before = kept()
    assert upserts.upsert_days(df, root, ["k"], ["v"]) == []
    assert kept() - before < 64 * n / 10


@pytest.mark.parametrize("small", [0, 2**62])
def test_small_and_large_batches_give_the_same(spark, tmp_path, monkeypatch, small):
    """No broadcasts, days cut into many parts, a key that is stored on two days, null keys."""
    monkeypatch.setattr(upserts, "SMALL_BATCH", small)
    monkeypatch.setattr(upserts, "PART_BYTES", 300)
    root, threshold = str(tmp_path / "t"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        put(spark, root, [(i, 1, "a", at(i % 3)) for i in range(40)] + [(None, 1, "n", None)])
        write = frame(spark, [(5, 2, "twice", at(1)), (50, 7, "new", at(1))]).withColumns({"year": F.lit("2024"), "month": F.lit("01"), "day": F.lit("31")})
        write.write.mode("append").partitionBy("year", "month", "day").parquet(root)
        batch = [(5, 2, "no", at(0)), (6, 2, "b", at(8)), (None, 2, "m", at(0)), (70, None, "c", None)]
        assert put(spark, root, batch) == ["", "2024-01-30", "2024-02-07"]
        assert put(spark, root, [(5, 3, "b", at(0))]) == ["2024-01-30", "2024-01-31", "2024-02-01"]
        assert put(spark, root, batch) == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    expected = [(i, 1, "a", at(i % 3)) for i in range(40) if i not in (5, 6)]
    expected += [(5, 3, "b", at(0)), (6, 2, "b", at(8)), (None, 2, "m", at(0)), (70, None, "c", None), (50, 7, "new", at(1))]
    assert stored(spark, root) == sorted(expected, key=repr)
