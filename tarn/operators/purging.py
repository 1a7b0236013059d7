"""Purges that keep a journal: planned, deleted, dropped. A run that dies is continued from it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators.retention import withheld
from tarn.session import cut_lineage
from tarn.sources.lake import is_absent

#: A journal row. ``kind`` run: the plan of the run is complete. table, catalog: what was planned, and for catalogs what was dropped.
#: folder: an outcome of deleting a prefix.
JOURNAL = "run int, kind string, catalog_id string, table_id string, prefix string, step string, attempts int, error string, call string"

Remove = Callable[[str], None]


def remove_folder(uri: str) -> None:
    """Delete a folder or file from within a task; one that is gone already is fine.

    For every store that Arrow can open. Others need a function of their own.
    """
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri else f"file://{uri}")
    kind = files.get_file_info(path).type
    if kind == fs.FileType.Directory:
        files.delete_dir(path)
    elif kind == fs.FileType.File:
        files.delete_file(path)


def read_journal(spark: SparkSession, journal: str) -> DataFrame:
    try:
        return spark.read.schema(JOURNAL).parquet(journal)
    except AnalysisException as problem:
        if not is_absent(problem):
            raise
        return spark.createDataFrame([], JOURNAL)


def _append(rows: DataFrame, journal: str, run: int, kind: str, step: str, call: str | None = None) -> None:
    """Write rows that have some of the journal's columns; the others are null."""
    shape = rows.sparkSession.createDataFrame([], JOURNAL).schema
    given = {"run": F.lit(run), "kind": F.lit(kind), "call": F.lit(call)} | ({"step": F.lit(step)} if "step" not in rows.columns else {})
    rows = rows.withColumns(given)
    columns = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape.fields]
    rows.select(*columns).write.mode("append").parquet(journal)


def current_run(spark: SparkSession, journal: str) -> int:
    """Number of the last run whose plan is complete, 0 before the first."""
    return read_journal(spark, journal).where("kind = 'run'").agg(F.coalesce(F.max("run"), F.lit(0))).first()[0]


def plan_run(plan: DataFrame, due: DataFrame, journal: str) -> int:
    """Write a plan (of ``purge_plan``) and the due catalogs as a new run; returns its number.

    The row that opens the run comes last, so a plan that was not written whole is never carried out.
    """
    spark = plan.sparkSession
    run = 1 + read_journal(spark, journal).agg(F.coalesce(F.max("run"), F.lit(0))).first()[0]
    plan = cut_lineage(plan.select("catalog_id", "table_id", "prefix", "usable", "overlaps"))
    _append(plan.where("usable AND NOT overlaps").select("catalog_id", "table_id", "prefix"), journal, run, "table", "planned")
    kept = withheld(plan).select("catalog_id", "table_id", "prefix", F.col("reason").alias("error"))
    _append(kept, journal, run, "table", "withheld")
    _append(due.select("catalog_id").distinct(), journal, run, "catalog", "planned")
    _append(spark.range(1).select(), journal, run, "run", "planned")
    return run


def folder_states(journal: DataFrame, run: int) -> DataFrame:
    """``prefix, step, attempts, error`` of all planned folders: ``planned`` (not tried yet), ``failed`` or ``deleted``."""
    own = journal.where(F.col("run") == run)
    planned = own.where("kind = 'table' AND step = 'planned'").select("prefix").distinct()
    outcomes = (
        own.where("kind = 'folder'")
        .groupBy("prefix")
        .agg(F.max(F.col("step") == "deleted").alias("gone"), F.sum("attempts").alias("attempts"), F.max("error").alias("error"))
    )
    step = F.when(F.col("gone").isNull(), "planned").when(F.col("gone"), "deleted").otherwise("failed")
    return planned.join(outcomes, "prefix", "left").select(
        "prefix", step.alias("step"), F.coalesce("attempts", F.lit(0)).cast("long").alias("attempts"), F.when(~F.col("gone"), F.col("error")).alias("error")
    )


def catalog_states(journal: DataFrame, run: int) -> DataFrame:
    """``catalog_id, step`` of all due catalogs: ``dropped``, ``withheld`` (a table of it is left alone), ``ready`` or ``waiting``."""
    own = journal.where(F.col("run") == run)
    mine = own.where("kind = 'catalog'").groupBy("catalog_id").agg(F.max(F.col("step") == "dropped").alias("dropped"))
    kept = own.where("kind = 'table' AND step = 'withheld'").select("catalog_id", F.lit(True).alias("kept")).distinct()
    tables = own.where("kind = 'table' AND step = 'planned'").select("catalog_id", "prefix")
    open_folders = folder_states(journal, run).where("step <> 'deleted'").select("prefix")
    held = tables.join(open_folders, "prefix", "left_semi").select("catalog_id", F.lit(True).alias("held")).distinct()
    step = (
        F.when(F.col("dropped"), "dropped").when(F.col("kept"), "withheld").when(F.col("held"), "waiting").otherwise("ready")
    )
    return mine.join(kept, "catalog_id", "left").join(held, "catalog_id", "left").select("catalog_id", step.alias("step"))


def _outcomes(folders: DataFrame, lake_root: str, remove: Remove, tries: int, tasks: int) -> DataFrame:
    """Delete the folders in ``tasks`` tasks; ``prefix, step, attempts, error``. An error ends a folder's tries, not the task."""
    root = lake_root.rstrip("/")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for prefix in batch.column(0).to_pylist():
                error, attempt = None, 0
                for attempt in range(1, tries + 1):
                    try:
                        remove(f"{root}/{prefix}")
                        error = None
                        break
                    except Exception as problem:  # noqa: BLE001  whatever the store raises goes into the journal
                        error = f"{type(problem).__name__}: {problem}"[:500]
                rows.append((prefix, "deleted" if error is None else "failed", attempt, error))
            columns = list(zip(*rows)) or [()] * 4
            types = (pa.string(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["prefix", "step", "attempts", "error"])

    return folders.repartition(tasks, "prefix").mapInArrow(work, "prefix string, step string, attempts int, error string")


def resume_run(
    spark: SparkSession,
    journal: str,
    lake_root: str,
    remove: Remove = remove_folder,
    tries: int = 3,
    round_size: int = 10_000,
    tasks: int | None = None,
) -> int:
    """Carry on the last run of ``journal`` until every folder is deleted or has failed ``tries`` times, then drop catalogs.

    Folders are dealt to tasks in rounds of ``round_size``; each round's outcomes are in the journal before the next begins, so a run that
    dies repeats one round at most, and deleting a folder that is gone is no error. A catalog is dropped once all its folders are deleted; one with
    a failed or withheld table stays. Another call tries failed folders again. Returns the number of the run.
    """
    run, call = current_run(spark, journal), uuid.uuid4().hex
    tasks = tasks or spark.sparkContext.defaultParallelism
    while run:
        told = read_journal(spark, journal)
        tried = told.where((F.col("run") == run) & (F.col("kind") == "folder") & (F.col("call") == call)).select("prefix")
        todo = folder_states(told, run).where("step <> 'deleted'").select("prefix").join(tried, "prefix", "left_anti")
        todo = cut_lineage(todo.limit(round_size))
        if todo.isEmpty():
            break
        _append(_outcomes(todo, lake_root, remove, tries, tasks), journal, run, "folder", "", call)
    ready = catalog_states(read_journal(spark, journal), run).where("step = 'ready'").select("catalog_id")
    _append(cut_lineage(ready), journal, run, "catalog", "dropped", call)
    return run


def is_open(spark: SparkSession, journal: str) -> bool:
    """Whether the last run has folders that were never tried, or catalogs that are ready to be dropped."""
    run = current_run(spark, journal)
    told = read_journal(spark, journal)
    untried = folder_states(told, run).where("step = 'planned'")
    return bool(run) and not (untried.isEmpty() and catalog_states(told, run).where("step = 'ready'").isEmpty())


def run_purge(plan: DataFrame, due: DataFrame, journal: str, lake_root: str, **options) -> int:
    """Finish the run that is open in ``journal``, or else plan and carry out a new one; returns its number."""
    spark = plan.sparkSession
    if not is_open(spark, journal):
        plan_run(plan, due, journal)
    return resume_run(spark, journal, lake_root, **options)


def remaining_catalogs(catalogs: DataFrame, journal: str) -> DataFrame:
    """``catalogs`` without those that any run dropped."""
    told = read_journal(catalogs.sparkSession, journal)
    gone = told.where("kind = 'catalog' AND step = 'dropped'").select(F.col("catalog_id").alias("_gone")).distinct()
    return catalogs.join(gone, F.col("catalog_id").cast("string") == F.col("_gone"), "left_anti")
