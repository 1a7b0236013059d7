"""Object listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_objects(spark: SparkSession, root: str) -> DataFrame:
    """``key, size, last_modified`` of every file under a root; file contents are not read.

    Spark lists the files on the driver. Rollups and purges of large buckets should read a stored inventory with
    these columns instead (``read_table``); this is for folders of a size one process can list.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString()
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select(
            F.substring(F.col("path"), F.lit(len(base.rstrip("/")) + 2), F.length("path")).alias("key"),
            F.col("length").alias("size"),
            F.col("modificationTime").alias("last_modified"),
        )
    )


def subfolders(spark: SparkSession, root: str) -> list[str]:
    """The folders right below a root, such as the tables of an area."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = base.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(base)
    names = sorted(str(f.getPath().getName()) for f in found if f.isDirectory())
    return [f"{root.rstrip('/')}/{name}" for name in names if not name.startswith(("_", "."))]
