"""Spark session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings every operator relies on; all of them can be changed on a live session.
RUNTIME_CONF = {
    # Epochs and day boundaries mean the same on every executor.
    "spark.sql.session.timeZone": "UTC",
    # Keep month=05 a padded string.
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    # Writing one day replaces that day only.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Batches to and from Python are cut by bytes; long texts would make ten thousand rows very large.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    # Ranked rows are cut in each task before the shuffle, whatever the limit.
    "spark.sql.optimizer.windowGroupLimitThreshold": str(2**31 - 1),
}


_shipped: set[str] = set()
_cleared_at_exit: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application.

    Functions that run in tasks import it by name. The archive travels through the shared folder;
    a cluster without one needs ``--py-files``.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    try:
        folder = shared_folder(spark)
    except RuntimeError:
        return
    package = Path(__file__).resolve().parent
    bundle = io.BytesIO()
    with zipfile.ZipFile(bundle, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    target = f"{folder}/code-{context.applicationId}/{package.name}.zip"
    path = context._jvm.org.apache.hadoop.fs.Path(target)
    stream = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path, True)
    stream.write(bundle.getvalue())
    stream.close()
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def build_session(app: str = "tarn", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the lake settings; on a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as named in ``spark.checkpoint.dir``.

    Only where driver and tasks are one process (local mode, as in tests) is it set here if it is unset.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="tarn-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_folder(spark)}/tarn-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, there until ``clear_scratch`` or the end of the application."""
    context = spark.sparkContext
    if context.applicationId not in _cleared_at_exit:
        _cleared_at_exit.add(context.applicationId)
        atexit.register(_clear_quietly, spark)
    return f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove all staged tables of this application. Frames that read them can no longer be used."""
    remove_path(spark, scratch_folder(spark))


def remove_path(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _clear_quietly(spark: SparkSession) -> None:
    """At exit the session may be gone already; then its folder stays, as after a crash."""
    with contextlib.suppress(Exception):
        clear_scratch(spark)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store ``df`` in the shared folder and go on from there: a lost executor never replays its inputs.

    A Parquet table, so that later passes read only the columns they use and Spark knows its size.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
