import json
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tarn.sources.contracts import contract
from tarn.sources.lake import read_table
from tarn.streaming.landing import late_rows, stream_land
from tests.conftest import rows

PAYLOAD = contract("id bigint, at string, message string")


def typed(df):
    at = F.col("at").cast("timestamp")
    return df.withColumns({"ts": at, "source_date": F.to_date(at)}).drop("at")


class Landing:
    """A folder with deliveries, and a stream that lands them."""

    def __init__(self, spark, base, **options):
        self.spark, self.base, self.options, self.n = spark, base, options, 0
        (base / "landing").mkdir()

    def deliver(self, *records):
        self.n += 1
        lines = [json.dumps({"id": i, "at": at, "message": message}) for i, at, message in records]
        (self.base / "landing" / f"{self.n}.json").write_text("\n".join(lines) + "\n")

    def run(self, normalise=typed, **options):
        options = {"record_key": ["id"], **self.options, **options}
        at = str(self.base)
        query = stream_land(self.spark, f"{at}/landing", PAYLOAD, normalise, f"{at}/raw", f"{at}/checkpoint", **options)
        query.awaitTermination()

    def landed(self):
        return rows(read_table(self.spark, f"{self.base}/raw"), "id", "message", "day")


@pytest.fixture
def landing(spark, tmp_path):
    return lambda **options: Landing(spark, tmp_path, **options)


D1, D2 = "2024-05-01 10:00:00", "2024-05-02 10:00:00"


def test_a_record_lands_once_over_files_triggers_and_restarts(landing):
    at = landing()
    at.deliver((1, D1, "a"), (1, D1, "a"), (2, D2, "b"))
    at.deliver((2, D2, "b"), (3, D2, "c"))
    at.run()
    at.deliver((1, D1, "a"), (4, D1, "late day"))
    at.run()
    at.run()
    at.deliver((4, D1, "late day"), (5, D2, "e"))
    at.run(files_per_batch=1)
    assert at.landed() == [(1, "a", "01"), (2, "b", "02"), (3, "c", "02"), (4, "late day", "01"), (5, "e", "02")]


def test_records_without_a_key_all_land(landing):
    at = landing()
    at.deliver((None, D1, "x"), (None, D1, "x"), (1, D1, "y"))
    at.run()
    at.deliver((None, D1, "x"), (1, D1, "y"))
    at.run()
    assert [r[1] for r in at.landed()].count("x") == 3 and len(at.landed()) == 4


def test_a_trigger_that_fails_is_run_again_without_loss_or_repeat(landing, tmp_path, monkeypatch):
    from tarn.streaming import landing as module

    at = landing()
    at.deliver((1, D1, "a"), (2, D1, "b"))
    at.run()
    at.deliver((2, D1, "b"), (3, D1, "c"))
    real = module.append_batch

    def dies(df, batch, root):
        real(df, batch, root)
        raise RuntimeError("lost after the write")

    monkeypatch.setattr(module, "append_batch", dies)
    with pytest.raises(Exception, match="lost after the write"):
        at.run()
    monkeypatch.setattr(module, "append_batch", real)
    at.run()
    assert at.landed() == [(1, "a", "01"), (2, "b", "01"), (3, "c", "01")]


def test_keys_are_forgotten_after_their_time(landing):
    at = landing(remember="1 second")
    at.deliver((1, D1, "a"))
    at.run()
    for n in (2, 3):  # the first of these moves the watermark, the second meets an empty memory
        time.sleep(2)
        at.deliver((n, D1, "b"))
        at.run()
    at.deliver((1, D1, "a"))
    at.run()
    assert [r[0] for r in at.landed()].count(1) == 2


def test_late_rows_are_kept_and_counted(spark, landing):
    at = landing()
    today = datetime.now().strftime("%Y-%m-%d 00:00:01")
    at.deliver((1, D1, "old"), (2, D1, "old too"), (3, today, "fresh"))
    at.run()
    got = late_rows(read_table(spark, f"{at.base}/raw")).orderBy("source_date").collect()
    assert [(r.rows, r.late) for r in got] == [(2, 2), (1, 0)]


def test_snapshots_take_no_record_key(landing):
    at = landing()
    with pytest.raises(ValueError, match="snapshot"):
        at.run(mode="snapshot")
