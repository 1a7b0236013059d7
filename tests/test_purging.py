from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tarn.operators import purging
from tests.conftest import rows


@pytest.fixture
def lake(spark, tmp_path):
    """Catalogs a, b and c are due; b has a table that overlaps with live data, c none at all; d is not due."""
    tables = [("a", "a1", "a/x"), ("a", "a2", "a/y"), ("b", "b1", "b/x"), ("b", "b2", "shared"), ("d", "d1", "d/x")]
    root = tmp_path / "lake"
    for _, _, prefix in tables:
        (root / prefix / "year=2024").mkdir(parents=True)
        (root / prefix / "year=2024" / "part.parquet").write_text("x")
    plan = spark.createDataFrame(
        [(c, t, p, True, p == "shared") for c, t, p in tables if c != "d"],
        "catalog_id string, table_id string, prefix string, usable boolean, overlaps boolean",
    )
    due = spark.createDataFrame([("a",), ("b",), ("c",)], "catalog_id string")
    return str(root), plan, due, str(tmp_path / "journal")


def folders(spark, journal, run=1):
    return {r.prefix: (r.step, r.attempts) for r in purging.folder_states(purging.read_journal(spark, journal), run).collect()}


def catalogs(spark, journal, run=1):
    return {r.catalog_id: r.step for r in purging.catalog_states(purging.read_journal(spark, journal), run).collect()}


def there(root):
    return sorted(str(p.relative_to(root)) for p in Path(root).rglob("*.parquet"))


def test_a_whole_run(spark, lake):
    root, plan, due, journal = lake
    assert purging.run_purge(plan, due, journal, root) == 1
    assert there(root) == ["d/x/year=2024/part.parquet", "shared/year=2024/part.parquet"]
    assert folders(spark, journal) == {"a/x": ("deleted", 1), "a/y": ("deleted", 1), "b/x": ("deleted", 1)}
    assert catalogs(spark, journal) == {"a": "dropped", "b": "withheld", "c": "dropped"}
    left = purging.remaining_catalogs(spark.createDataFrame([("a",), ("b",), ("d",)], "catalog_id string"), journal)
    assert rows(left) == [("b",), ("d",)]
    assert not purging.is_open(spark, journal)
    assert purging.run_purge(plan.where("catalog_id = 'b'"), due.where("catalog_id = 'b'"), journal, root) == 2


def test_a_run_that_dies_halfway_is_continued(spark, lake, monkeypatch):
    root, plan, due, journal = lake
    real, rounds = purging._outcomes, []

    def dies(folders, *args):
        rounds.append(1)
        if len(rounds) == 2:
            raise RuntimeError("driver lost")
        return real(folders, *args)

    monkeypatch.setattr(purging, "_outcomes", dies)
    with pytest.raises(RuntimeError):
        purging.run_purge(plan, due, journal, root, round_size=1)
    monkeypatch.setattr(purging, "_outcomes", real)
    states = folders(spark, journal)
    assert sorted(s for s, _ in states.values()) == ["deleted", "planned", "planned"] and len(there(root)) == 4
    assert purging.is_open(spark, journal) and catalogs(spark, journal) == {"a": "waiting", "b": "withheld", "c": "ready"}
    # The plan of the open run counts, whatever is planned now.
    assert purging.run_purge(plan.limit(0), due.limit(0), journal, root) == 1
    assert {s for s, _ in folders(spark, journal).values()} == {"deleted"}
    assert all(n == 1 for _, n in folders(spark, journal).values())
    assert catalogs(spark, journal) == {"a": "dropped", "b": "withheld", "c": "dropped"}


def test_a_death_between_deleting_and_dropping(spark, lake, monkeypatch):
    root, plan, due, journal = lake
    real = purging.catalog_states

    def dies(*args):
        raise RuntimeError("driver lost")

    monkeypatch.setattr(purging, "catalog_states", dies)
    with pytest.raises(RuntimeError):
        purging.run_purge(plan, due, journal, root)
    monkeypatch.setattr(purging, "catalog_states", real)
    assert purging.is_open(spark, journal)
    assert purging.run_purge(plan, due, journal, root) == 1
    assert catalogs(spark, journal)["a"] == "dropped" and not purging.is_open(spark, journal)


def test_a_plan_that_was_not_written_whole_is_not_carried_out(spark, lake, monkeypatch):
    root, plan, due, journal = lake
    real = purging._append

    def dies(df, journal, run, kind, *args):
        if kind == "run":
            raise RuntimeError("driver lost")
        return real(df, journal, run, kind, *args)

    monkeypatch.setattr(purging, "_append", dies)
    with pytest.raises(RuntimeError):
        purging.run_purge(plan, due, journal, root)
    monkeypatch.setattr(purging, "_append", real)
    assert purging.resume_run(spark, journal, root) == 0 and len(there(root)) == 5
    assert purging.run_purge(plan, due, journal, root) == 2
    assert catalogs(spark, journal, 2)["a"] == "dropped"


def test_failures_are_tried_again_a_bounded_number_of_times(spark, lake, tmp_path):
    root, plan, due, journal = lake
    flag = str(tmp_path / "flag")

    def moody(uri):
        if uri.endswith("a/x") and not Path(flag).exists():
            raise OSError("busy")
        if uri.endswith("a/y"):
            with open(f"{flag}-y", "a") as f:
                f.write("x")
            if len(Path(f"{flag}-y").read_text()) == 1:
                raise OSError("once")
        purging.remove_folder(uri)

    purging.run_purge(plan, due, journal, root, remove=moody, tries=2)
    assert folders(spark, journal) == {"a/x": ("failed", 2), "a/y": ("deleted", 2), "b/x": ("deleted", 1)}
    assert catalogs(spark, journal)["a"] == "waiting" and not purging.is_open(spark, journal)
    error = purging.folder_states(purging.read_journal(spark, journal), 1).where("prefix = 'a/x'").first().error
    assert error == "OSError: busy"
    Path(flag).touch()
    assert purging.resume_run(spark, journal, root, remove=moody) == 1
    assert folders(spark, journal)["a/x"] == ("deleted", 3) and catalogs(spark, journal)["a"] == "dropped"


def test_folders_are_dealt_to_tasks(spark, lake, tmp_path):
    root, _, _, journal = lake
    plan = spark.range(200).select(
        F.lit("z").alias("catalog_id"), F.col("id").cast("string").alias("table_id"),
        F.concat(F.lit("z/"), "id").alias("prefix"), F.lit(True).alias("usable"), F.lit(False).alias("overlaps"))
    seen = str(tmp_path / "seen")
    Path(seen).mkdir()

    def note(uri):
        from pyspark import TaskContext

        (Path(seen) / str(TaskContext.get().partitionId())).touch()

    purging.run_purge(plan, plan.select("catalog_id"), journal, root, remove=note, tasks=8)
    assert len(list(Path(seen).iterdir())) == 8
    assert {v for v in folders(spark, journal).values()} == {("deleted", 1)}


def test_missing_folders_and_files(tmp_path):
    (tmp_path / "file").write_text("x")
    purging.remove_folder(str(tmp_path / "file"))
    purging.remove_folder(f"file://{tmp_path}/nothing")
    assert not (tmp_path / "file").exists()
