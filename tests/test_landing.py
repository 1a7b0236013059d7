import json
from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.sources import landing
from tarn.sources.contracts import ALERT, CONTRACTS, contract
from tarn.sources.jdbc import incremental, jdbc_options
from tests.conftest import rows

DAY = "2025-05-27"


def lines(spark, *entries):
    return spark.createDataFrame([(e if isinstance(e, str) else json.dumps(e),) for e in entries], "value string")


def test_journal_lines(spark):
    micros = 1748300000123456
    df = lines(
        spark,
        {"PRIORITY": "3", "_SYSTEMD_UNIT": "smartd.service", "MESSAGE": "disk", "__REALTIME_TIMESTAMP": str(micros)},
        {"MESSAGE": "no unit", "__REALTIME_TIMESTAMP": "soon"},
        {"PRIORITY": "6", "_SYSTEMD_UNIT": "", "SYSLOG_IDENTIFIER": "cron", "MESSAGE": "info"},
        {"PRIORITY": 4, "MESSAGE": ""},
        {"PRIORITY": "1"},
        "{broken",
        "",
    )
    got = rows(landing.normalize_journal(df, DAY), "unit", "priority", "timestamp", "message")
    at = datetime(2025, 5, 26, 22, 53, 20, 123456)
    start = datetime(2025, 5, 27)
    assert got == [
        ("cron", "6", start, "info"),
        ("kernel", "WARNING", start, "no unit"),
        ("smartd", "ERROR", at, "disk"),
    ]


def test_journal_window_is_half_open_and_cuts_by_level(spark):
    def entry(second, level):
        at = int(datetime(2025, 5, 27).timestamp() * 1e6) + second * 1_000_000
        return {"PRIORITY": level, "MESSAGE": f"{second}", "__REALTIME_TIMESTAMP": str(at)}

    df = lines(spark, entry(-1, "3"), entry(0, "4"), entry(5, "5"), entry(86399, "0"), entry(86400, "0"))
    kept = landing.normalize_journal(landing.journal_window(df, DAY), DAY)
    assert rows(kept, "message") == [("0",), ("86399",)]


def test_alerts(spark):
    payload = lines(
        spark,
        {"formatted": "pool degraded", "text": "x", "datetime": {"$date": 1748300000123}, "source": "zfs", "level": "CRITICAL"},
        {"formatted": "", "text": "low space", "datetime": {"$date": "never"}},
        {"args": "[]"},
        {"formatted": None, "text": ""},
    )
    alerts = payload.select(F.from_json("value", ALERT).alias("a")).select("a.*")
    got = rows(landing.normalize_alerts(alerts, DAY), "unit", "priority", "timestamp", "message")
    assert got == [
        ("alert", "WARNING", datetime(1970, 1, 1), "[]"),
        ("alert", "WARNING", datetime(2025, 5, 27), "low space"),
        ("zfs", "CRITICAL", datetime(2025, 5, 26, 22, 53, 20, 123000), "pool degraded"),
    ]


def test_logs_share_ids_between_equal_messages(spark):
    journal = landing.normalize_journal(
        lines(spark, {"MESSAGE": "again"}, {"MESSAGE": "again", "__REALTIME_TIMESTAMP": "1"}), DAY
    )
    alerts = landing.normalize_alerts(spark.createDataFrame([], ALERT), DAY)
    logs = landing.build_logs(journal, alerts, DAY)
    assert logs.count() == 2 and logs.select("id").distinct().count() == 1
    assert rows(logs.select("content").distinct()) == [("[kernel] WARNING: again",)]
    assert landing.build_logs(alerts, alerts, DAY).isEmpty()


def test_json_folder_takes_objects_and_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"q": 1, "s": {"x": 1}}, {"q": 2, "s": {"x": 2}}]))
    (tmp_path / "b.json").write_text(json.dumps({"q": 3, "s": {"x": 3}, "late": "new"}))
    (tmp_path / "c.txt").write_text("no json")
    flat = landing.flatten_struct(landing.read_json_folder(spark, str(tmp_path)))
    assert set(flat.columns) == {"q", "s.x", "late"}
    assert rows(flat.select("q", F.col("`s.x`"))) == [(1, 1), (2, 2), (3, 3)]


def test_items_missing_list_gives_no_rows(spark):
    shape = contract("Id string")
    empty = spark.createDataFrame([(1,)], "other int")
    assert landing.explode_items(empty, shape).count() == 0
    payload = T.StructType().add("Items", T.ArrayType(shape))
    filled = spark.createDataFrame([([("a",), ("b",)],), ([],), (None,)], payload)
    assert rows(landing.explode_items(filled, shape)) == [("a",), ("b",)]


def test_disks_get_defaults(spark):
    df = spark.createDataFrame([("sda", None)], "devname string, size int")
    assert rows(landing.normalize_disks(df)) == [("sda", "", "", 0, None, "")]


def test_land_keeps_rows_with_bad_values(spark):
    df = lines(
        spark,
        {"charge_id": "c1", "amount_usd": 9.5, "refunded": True, "created_at": "2025-05-27 14:32:00"},
        {"charge_id": "c2", "amount_usd": "lots", "refunded": "maybe"},
        "nothing",
    )
    got = landing.land(df, CONTRACTS["charges"], DAY)
    assert got.schema["amount_usd"].dataType == T.DoubleType()
    assert rows(got.where("charge_id IS NOT NULL"), "charge_id", "amount_usd", "refunded", "created_at") == [
        ("c1", 9.5, True, datetime(2025, 5, 27, 14, 32)),
        ("c2", None, None, None),
    ]


def test_union_of_drifting_files(spark):
    a = spark.createDataFrame([(1, "x")], "id int, old string")
    b = spark.createDataFrame([(2, 5.0)], "id int, new double")
    assert rows(landing.union_files(a, b)) == [(1, "x", None), (2, None, 5.0)]


def test_incremental_load(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "id long")
    assert incremental(df, "id", None).count() == 5
    assert rows(incremental(df, "id", 2)) == [(3,), (4,)]


def test_jdbc_options():
    options = jdbc_options(
        "jdbc:postgresql://h/d", "SELECT * FROM t", split_column="id", bounds=(1, 9), partitions=4, user="u"
    )
    assert options["dbtable"] == "(SELECT * FROM t) AS snapshot"
    assert (options["partitionColumn"], options["lowerBound"], options["numPartitions"]) == ("id", "1", "4")
    assert options["user"] == "u"
