"""Results of a query, stored once and served page by page."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.session import cut_lineage, remove_path

NUMBER, BLOCK = "_number", "_block"
#: Rows of one folder of a stored result.
BLOCK_ROWS = 1_000_000


@dataclass
class StoredResult:
    """What a console shows: columns, the number of rows, and any page of them. An error's text in place of rows."""

    spark: SparkSession
    path: str
    page_rows: int
    row_count: int = 0
    columns: list[str] = field(default_factory=list)
    block_rows: int = BLOCK_ROWS
    error: str | None = None
    schema: T.StructType | None = None

    @property
    def ok(self) -> bool:
        return self.error is None

    @property
    def pages(self) -> int:
        return -(-self.row_count // self.page_rows)

    def page(self, n: int) -> DataFrame:
        """Rows of page ``n`` (from 0), in order; only the folders that hold them are opened. No rows beyond the last page."""
        first, end = n * self.page_rows, min((n + 1) * self.page_rows, self.row_count)
        blocks = list(range(first // self.block_rows, max(first, end - 1) // self.block_rows + 1))
        if self.schema is None:
            raise ValueError(self.error or "nothing was stored")
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows").where(F.col(BLOCK).cast("long").isin(blocks))
        rows = rows.where((F.col(NUMBER) >= first) & (F.col(NUMBER) < end))
        return rows.orderBy(NUMBER).select(*[F.col(f"`{c}`") for c in self.columns])

    def drop(self) -> None:
        remove_path(self.spark, self.path)


def store_result(
    df: DataFrame, path: str, order: Sequence[tuple[str, bool]] = (), page_rows: int = 1000, block_rows: int = BLOCK_ROWS
) -> StoredResult:
    """Run a query once, store its rows numbered from 0 by ``(column, ascending)`` pairs, nulls last, and return the result.

    Without an order rows are numbered as they come. Numbering needs no task that sees all rows: the stored rows are cut into ranges of the order, each is
    sorted by itself, and the counts of the ranges before it give its first number. Rows that are equal in the order are told apart
    by a number of their own, so very many equal ones are cut too. Pages therefore never disagree with the count or with each
    other. A query that fails gives a result with the error's text. Column names that Spark cannot store twice are an error as well.
    """
    spark = df.sparkSession
    try:
        ran = cut_lineage(df.withColumn(NUMBER, F.monotonically_increasing_id()))
    except Exception as problem:  # noqa: BLE001  the console shows it, whatever it is
        return StoredResult(spark, path, page_rows, error=str(problem))
    by = [F.col(f"`{c}`").asc_nulls_last() if up else F.col(f"`{c}`").desc_nulls_last() for c, up in order]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = ran.repartitionByRange(parts, *by, F.col(NUMBER)).sortWithinPartitions(*by, NUMBER)
    placed = cut_lineage(ranged.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    # One number per range.
    counts = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}
    before = dict(zip(sorted(counts), accumulate([0, *[counts[p] for p in sorted(counts)]])))
    starts = spark.createDataFrame([(p, n) for p, n in before.items()], "_part int, _start long")
    rows = placed.join(F.broadcast(starts), "_part").withColumn(NUMBER, F.col("_start") + F.col("_place"))
    rows = rows.withColumn(BLOCK, F.floor(F.col(NUMBER) / block_rows).cast("long")).drop("_part", "_place", "_start")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(BLOCK).parquet(f"{path}/rows")
    return StoredResult(spark, path, page_rows, sum(counts.values()), list(df.columns), block_rows, schema=rows.schema)
