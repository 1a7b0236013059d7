"""Polling ingest: payload files to day partitions, each file once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tarn.session import cut_lineage
from tarn.sources.lake import is_absent, read_table
from tarn.sources.paths import PARTITIONS

BATCH = "landing_batch"
ARRIVED = "arrived_at"


def _with_day(df: DataFrame) -> DataFrame:
    for name, fmt in zip(PARTITIONS, ("yyyy", "MM", "dd")):
        df = df.withColumn(name, F.date_format("source_date", fmt))
    return df


def _overwrite(df: DataFrame, root: str, *partitions: str) -> None:
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .parquet(root)
    )


def without_repeats(rows: DataFrame, key: Sequence[str], remember: str = "1 day") -> DataFrame:
    """A stream's rows without those whose ``key`` came before, in this trigger or within ``remember`` before it.

    The keys are state of the stream: a restart goes on with them, and each is forgotten ``remember`` after it first arrived, so the
    state holds the keys of that time and no more. Time is when a row arrives (``arrived_at``, added here), not what it says: a row from an
    old day is as good as any and is never dropped as late; :func:`late_rows` counts these. Rows without a whole key repeat
    nothing. The number of state partitions is that of ``spark.sql.shuffle.partitions`` at the first start.
    """
    unkeyed = F.greatest(*[F.isnull(c) for c in key], F.lit(False))
    return (
        rows.withColumn(ARRIVED, F.current_timestamp())
        .withWatermark(ARRIVED, remember)
        .withColumn("_unkeyed", F.when(unkeyed, F.uuid()))
        .dropDuplicatesWithinWatermark([*key, "_unkeyed"])
        .drop("_unkeyed")
    )


def late_rows(table: DataFrame, after: str = "1 day") -> DataFrame:
    """Per ``source_date``: how many rows there are, and how many of them arrived more than ``after`` past its end."""
    end = F.col("source_date").cast("timestamp") + F.expr("INTERVAL 1 DAY") + F.expr(f"INTERVAL {after}")
    return table.groupBy("source_date").agg(F.count("*").alias("rows"), F.count_if(F.col(ARRIVED) > end).alias("late"))


def append_batch(df: DataFrame, batch: str, root: str) -> None:
    """Log sources: keep all rows. A batch that is run again replaces its own folders."""
    _overwrite(_with_day(df).withColumn(BATCH, F.lit(batch)), root, *PARTITIONS, BATCH)


def _landed(spark: SparkSession, root: str, days: DataFrame) -> DataFrame:
    """When the payload a day holds was delivered, for the given days of a table that may not exist.

    The batch's days (one row per day) become literals of the partition columns, so that only their folders are read.
    """
    try:
        table = read_table(spark, root)
    except AnalysisException as problem:
        if not is_absent(problem):
            raise
        return days.select("source_date", F.lit(None).cast("timestamp").alias("_landed")).limit(0)
    wanted = _with_day(days.select("source_date").distinct()).collect()
    for name in PARTITIONS:
        table = table.where(F.col(name).isin(sorted({row[name] for row in wanted if row[name] is not None})))
    table = table.where(F.col("source_date").isin([row.source_date for row in wanted]))
    return table.groupBy("source_date").agg(F.max("landed_at").alias("_landed"))


def replace_days(df: DataFrame, root: str) -> None:
    """Snapshot sources: each day holds its newest payload, also when an older one arrives late.

    The newest file per day is found from one small row per file and day; rows are then filtered by
    an equality join with it. ``landed_at`` keeps the time of the payload a day came from.
    """
    files = df.groupBy("source_date", "_file").agg(F.max("_file_time").alias("_time"))
    latest = F.row_number().over(
        W.partitionBy("source_date").orderBy(F.col("_time").desc(), F.col("_file").desc())
    )
    # Stored: one row per day, needed to look up the table and again after the table is replaced.
    newest = cut_lineage(files.withColumn("_n", latest).where("_n = 1").select("source_date", "_file", "_time"))
    current = newest.join(_landed(df.sparkSession, root, newest), "source_date", "left")
    current = cut_lineage(current.where(F.col("_landed").isNull() | (F.col("_time") >= F.col("_landed"))))
    rows = df.join(current.select("source_date", "_file"), ["source_date", "_file"], "left_semi")
    rows = rows.withColumnRenamed("_file_time", "landed_at").drop("_file")
    _overwrite(_with_day(rows), root, *PARTITIONS)


def stream_land(
    spark: SparkSession,
    landing: str,
    schema: T.StructType,
    normalise: Callable[[DataFrame], DataFrame],
    root: str,
    checkpoint: str,
    mode: str = "append",
    text_lines: bool = False,
    files_per_batch: int = 1000,
    record_key: Sequence[str] | None = None,
    remember: str = "1 day",
) -> StreamingQuery:
    """Process the files that arrived since the last run, then stop.

    ``normalise`` turns payload rows into table rows with a ``source_date``. ``mode`` is ``append``
    for logs or ``snapshot`` for current-state payloads; in snapshot mode ``normalise`` must keep the
    columns ``_file`` and ``_file_time``. With ``record_key`` (columns of the normalised rows) a log record that
    is delivered again within ``remember`` lands once (see ``without_repeats``); ``normalise`` then works on the stream itself.
    """
    if mode not in ("append", "snapshot"):
        raise ValueError(f"unknown mode {mode!r}")
    if record_key is not None and mode != "append":
        raise ValueError("a snapshot replaces its day; record keys are for logs")
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    files = reader.text(landing) if text_lines else reader.schema(schema).json(landing)
    if mode == "snapshot":
        files = files.withColumns(
            {
                "_file": F.col("_metadata.file_path"),
                "_file_time": F.col("_metadata.file_modification_time"),
            }
        )

    if record_key is not None:
        files = without_repeats(normalise(files), record_key, remember)

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = batch if record_key is not None else normalise(batch)
        if mode == "append":
            # Batch numbers start over with a new checkpoint; the query's id does not repeat.
            query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
            append_batch(rows, f"{query}-{batch_id}", root)
        else:
            replace_days(rows, root)

    return (
        files.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
