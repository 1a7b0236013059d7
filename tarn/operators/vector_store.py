"""Vectors by content: a text is embedded once, however often and on whatever day it comes back."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions.moments import AsOf, parse_day
from tarn.functions.vectors import DEFAULT_DIM, VECTOR
from tarn.operators.content import Embedder, build_content, embed, with_record_id
from tarn.session import cut_lineage
from tarn.sources.lake import is_absent

STORED = T.StructType([T.StructField("content_key", T.StringType()), T.StructField("embedding", VECTOR), T.StructField("first_day", T.DateType())])


def stored_vectors(spark: SparkSession, store: str) -> DataFrame:
    """``content_key`` (md5 of the text), ``embedding`` and ``first_day``; one row per text."""
    try:
        return spark.read.schema(STORED).parquet(store)
    except AnalysisException as problem:
        if not is_absent(problem):
            raise
        return spark.createDataFrame([], STORED)


def add_missing(texts: DataFrame, store: str, day: AsOf, embedder: Embedder | None = None, dim: int = DEFAULT_DIM, text: str = "content") -> int:
    """Embed the texts that ``store`` does not have yet, each distinct one once, and add them; returns how many.

    Keys alone decide: the store's vectors are not read. Equal texts are one before the shuffle, so a text that a third of all rows share is one
    row per task. New texts are staged and counted before the model is called, and spread evenly over tasks, as calls are the cost. What is
    added is one write: a run that dies before its end adds nothing, and one that dies after finds its texts the next time.
    """
    spark = texts.sparkSession
    keyed = texts.where(F.col(text).isNotNull()).select(F.md5(text).alias("content_key"), F.col(text).alias("content"))
    distinct = keyed.groupBy("content_key").agg(F.min("content").alias("content"))
    new = cut_lineage(distinct.join(stored_vectors(spark, store).select("content_key"), "content_key", "left_anti"))
    count = new.count()
    if count:
        rows = embed(new.repartition(spark.sparkContext.defaultParallelism), embedder, dim)
        rows = rows.withColumn("first_day", F.lit(parse_day(day)).cast("date"))
        rows.select(*[f.name for f in STORED.fields]).write.mode("append").parquet(store)
    return count


def embed_changed(
    rows: DataFrame, store: str, day: AsOf, embedder: Embedder | None = None, dim: int = DEFAULT_DIM, text: str = "content"
) -> DataFrame:
    """``rows`` with ``embedding``, and ``first_day``, when their text was embedded; only new texts go to the model.

    Known vectors are copied from ``store`` by an equality join on the text's md5; Spark splits a text that very many rows share. A null text has no vector. A store belongs to
    one model: another model needs another one, as its vectors differ. Columns with these names are replaced.
    """
    add_missing(rows, store, day, embedder, dim, text)
    kept = rows.drop("embedding", "first_day", "content_key").withColumn("content_key", F.md5(text))
    return kept.join(stored_vectors(rows.sparkSession, store), "content_key", "left").drop("content_key")


def changed_embedding_rows(
    df: DataFrame, source: str, day: AsOf, store: str, embedder: Embedder | None = None, dim: int = DEFAULT_DIM
) -> DataFrame:
    """Raw rows of one source and day to rows of the embedding table, with ``first_day`` beside its six columns."""
    rows = cut_lineage(with_record_id(build_content(df, source)).select("id", "content"))
    return (
        embed_changed(rows, store, day, embedder, dim)
        .withColumns(
            {
                "source": F.lit(source),
                "source_date": F.lit(parse_day(day)).cast("date"),
                "ingested_at": F.current_timestamp(),
            }
        )
        .select("id", "source", "content", "embedding", "source_date", "ingested_at", "first_day")
    )
