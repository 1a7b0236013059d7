"""Streaming landing of payload files that Spark writes from the fixture tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.session import scratch_path
from tarn.sources.lake import read_table
from tarn.sources.contracts import contract
from tarn.streaming.landing import stream_land
from workload.tables import table

PAYLOAD = contract("event_id bigint, at string, event_type string, value double, props string")


def _typed(batch: DataFrame) -> DataFrame:
    at = F.col("at").cast("timestamp")
    return batch.withColumn("ts", at).withColumn("source_date", F.to_date(at)).drop("at")


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arrive in two deliveries; each run of the stream lands what is new."""
    base = scratch_path(spark, "stream")
    landing, root = f"{base}/landing", f"{base}/raw/events"
    events = table(spark, sf_dir, "events")
    payload = events.select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "event_type", "value", "props"
    )
    for delivery in (payload.where("event_type = 'view'"), payload.where("event_type <> 'view'")):
        delivery.write.mode("append").json(landing)
        stream_land(spark, landing, PAYLOAD, _typed, root, f"{base}/checkpoint").awaitTermination()
    return read_table(spark, root).select("event_id", "ts", "event_type", "value", "props", "year", "month", "day")


def stream_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three deliveries of each day's state, the oldest last: every day keeps the newest payload."""
    base = scratch_path(spark, "snapshot")
    landing, root = f"{base}/landing", f"{base}/raw/state"
    events = table(spark, sf_dir, "events")
    state = events.select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "event_type", "value", "props"
    )
    day = F.substring("at", 1, 10)
    files = spark._jvm.org.apache.hadoop.fs.Path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    for hours, kind in ((10, "view"), (20, "click"), (1, "signup")):
        folder = f"{base}/{kind}"
        state.where(F.col("event_type") == kind).repartition(4, day).write.json(folder)
        for found in files.listStatus(spark._jvm.org.apache.hadoop.fs.Path(folder)):
            path, name = found.getPath(), found.getPath().getName()
            if name.endswith(".json"):
                target = spark._jvm.org.apache.hadoop.fs.Path(f"{landing}/{kind}-{name}")
                files.mkdirs(target.getParent())
                files.rename(path, target)
                files.setTimes(target, 1_700_000_000_000 + hours * 3_600_000, -1)
        stream_land(spark, landing, PAYLOAD, _typed, root, f"{base}/checkpoint", mode="snapshot").awaitTermination()
    return read_table(spark, root).select("event_id", "ts", "event_type", "value", "props", "year", "month", "day")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries that repeat records of the same file, of the same trigger and of earlier ones; each record lands once."""
    base = scratch_path(spark, "dedup")
    landing, root = f"{base}/landing", f"{base}/raw/events"
    events = table(spark, sf_dir, "events")
    payload = events.select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "event_type", "value", "props"
    )
    views, third = payload.where("event_type = 'view'"), payload.where("event_id % 3 = 0")
    for delivery in (views.unionAll(views.where("event_id % 2 = 0")), third.unionAll(views), payload, third):
        delivery.write.mode("append").json(landing)
        stream = stream_land(spark, landing, PAYLOAD, _typed, root, f"{base}/checkpoint", record_key=["event_id"])
        stream.awaitTermination()
    return read_table(spark, root).select("event_id", "ts", "event_type", "value", "props", "year", "month", "day")


QUERIES = {"stream_events": stream_events, "stream_snapshot": stream_snapshot, "stream_dedup": stream_dedup}

ORACLE = {
    "stream_snapshot": """
        WITH kinds AS (
            SELECT *, CASE event_type WHEN 'click' THEN 3 WHEN 'view' THEN 2 WHEN 'signup' THEN 1 END AS age,
                   max(CASE event_type WHEN 'click' THEN 3 WHEN 'view' THEN 2 WHEN 'signup' THEN 1 END)
                       OVER (PARTITION BY date_trunc('day', ts)) AS newest
            FROM events
        )
        SELECT event_id, ts, event_type, value, props, strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month,
               strftime(ts, '%d') AS day
        FROM kinds WHERE age = newest
    """,
    "stream_dedup": """
        SELECT event_id, ts, event_type, value, props, strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month,
               strftime(ts, '%d') AS day
        FROM events
    """,
    "stream_events": """
        SELECT event_id, ts, event_type, value, props, strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month,
               strftime(ts, '%d') AS day
        FROM events
    """,
}
