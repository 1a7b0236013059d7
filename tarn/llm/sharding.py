"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tarn.llm.common import free_name, table
from tarn.session import scratch_path

#: Text that one bucket should hold, in bytes: a task keeps one bucket in memory.
BUCKET_BYTES = 16 << 20


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard of a key, from the key and the number of shards alone.

    Each shard draws a number for the key and the highest wins, so that one more shard takes keys only into itself.
    """
    draws = [F.struct(F.xxhash64(key, F.lit(seed), F.lit(i)).alias("draw"), F.lit(i).alias("shard")) for i in range(shards)]
    best = draws[0] if shards == 1 else F.greatest(*draws)
    return best.getField("shard")


def text_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def write_shards(
    df: DataFrame,
    path: str,
    shards: int = 8,
    key: str = "doc_id",
    text: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
    seed: int = 11,
) -> DataFrame:
    """Write the rows of ``df`` as randomly ordered shards under ``path`` and return the written table.

    The table has ``shard``, ``slot`` (the row's place in its shard, without gaps from 0) and all columns of ``df``;
    columns of ``df`` with those names are left out. The law is ``key``: shard and bucket depend on the key.

    First pass: seeded hashes scatter the rows of every shard uniformly over buckets of about ``bucket_bytes``
    of text; their number follows from the size of the table. Second pass: each bucket is shuffled in memory
    (``shuffle`` is a Fisher-Yates shuffle) and written. Counts of buckets give the slots. A bucket is made
    and written by one task, so a lost executor repeats whole buckets only.

    Null keys share a shard, null texts count one byte, and a table without rows gives an empty table. Repeated
    rows are kept; rows that repeat a key go to the shard of the key and are spread over its buckets by text.
    """
    out = df.drop("shard", "slot")
    total = df.agg(F.sum(text_bytes(F.col(text)))).first()[0] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    bucket, rows, order, at = (free_name(out, n) for n in ("bucket", "rows", "order", "at"))
    placed = out.withColumn("shard", shard_of(F.col(key), shards, seed)).withColumn(
        bucket, F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key), F.col(text)), F.lit(buckets)).cast("long")
    )
    starts = (
        placed.groupBy("shard", bucket)
        .agg(F.count("*").alias(at))
        .withColumn(
            at,
            F.coalesce(F.sum(at).over(W.partitionBy("shard").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        )
    )
    scattered = (
        placed.withColumn(order, F.xxhash64(F.lit(seed + 2), F.col(key), F.col(text)))
        .repartition("shard", bucket)
        .sortWithinPartitions("shard", bucket, order)
    )
    shuffled = (
        scattered.groupBy("shard", bucket)
        .agg(F.collect_list(F.struct(*out.columns)).alias(rows))
        .join(starts, ["shard", bucket])
        .select("shard", at, F.posexplode(F.shuffle(F.col(rows), seed)).alias("slot", rows))
        .select("shard", (F.col(at) + F.col("slot")).cast("long").alias("slot"), f"{rows}.*")
    )
    shuffled.write.partitionBy("shard").parquet(path)
    schema = T.StructType(
        [T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType()), *out.schema.fields]
    )
    return df.sparkSession.read.schema(schema).parquet(path)


def op9_shuffle_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    written = write_shards(docs, scratch_path(spark, "shards"), shards=8, seed=11)
    return written.select(
        "doc_id",
        text_bytes(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        shard_of(F.col("doc_id"), 9, 11).alias("grown_shard"),
    )


QUERIES = {"op9_shuffle_shards": op9_shuffle_shards}
ORACLE: dict[str, str] = {}
