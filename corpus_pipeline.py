"""From raw documents to packed training windows: five stages, each stored before the next one reads it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import mixing, ngram_join, packing, quality, toxicity
from tarn.llm.common import SPACE, stage, table, word_count
from tarn.session import configure, scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier gives less than even odds of being toxic."""
    return toxicity.score_documents(spark, docs.select(COLUMNS), sf_dir).where(F.col("score") < 0.5).select(COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at least even odds of being good, by their text, their path and their host."""
    return quality.score_documents(spark, docs.select(COLUMNS), sf_dir).where(F.col("score") >= 0.5).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id, rows without an id last.

    Rows count by themselves, whatever their ids: of rows that repeat an id those with other texts stay, and equal rows without an
    id are one group. Rows without words are copies of nothing.
    """
    rows = stage(docs.select(COLUMNS).withColumn("row", F.monotonically_increasing_id()))
    classes = ngram_join.jaccard_components(rows, identity="row").select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first")
    kept = classes.join(rows.select("row", "doc_id"), "row").groupBy("group").agg(first).select("first.row")
    return rows.join(kept, "row", "left_semi").select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them whole, and the first words of one that it takes in part."""
    text = F.col("text")
    sized = docs.select(
        *COLUMNS, word_count(text).alias("size"), mixing.quality_of(text).alias("quality"), mixing.digest_of(text).alias("digest")
    )
    mixed = mixing.mix(sized, identity=("doc_id", "digest")).where(F.col("taken") > 0)
    copies, part = F.floor(F.col("taken") / F.col("size")), F.col("taken") % F.col("size")
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    cut = F.when(part > 0, F.array_join(F.slice(words, F.lit(1), part.cast("int")), " "))
    rows = mixed.select(
        *[c for c in COLUMNS if c not in ("text", "n_chars")],
        F.explode(F.concat(F.array_repeat(text, copies.cast("int")), F.filter(F.array(cut), lambda t: t.isNotNull()))).alias("text"),
    )
    return rows.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, each with its sequence and place."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Trained models, a similarity join and differencing are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; the result is a stored table, so reading it repeats nothing."""
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        path = scratch_path(spark, name)
        apply(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
