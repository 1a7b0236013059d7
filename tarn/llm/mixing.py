"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.llm.common import free_name, number_repeats, stage, table, word_count

#: Rows that one window of the running sums should hold.
BUCKET_ROWS = 4096
SYMBOLS = "#*$%&|<>"


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """Words to take from each source. ``sizes``: source, source_size, ... (one row per source).

    Sources in code point order (null last) weigh ``weights``, repeating, and share the sum of all sizes.
    A target stops at ``max_epochs`` times its source, and what is above goes to the others by weight.
    That has a closed form: by growing size per weight, a source stops if its limit is below its share
    of what the sources before it left over. One row per source is ordered in one place; the rows of
    the corpus are not.
    """
    every = W.partitionBy()
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    pattern = F.array(*[F.lit(int(w)) for w in weights])
    limit = max_epochs * F.col("source_size")
    before = every.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        W.unboundedPreceding, -1
    )
    return (
        sizes.withColumn("weight", F.element_at(pattern, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1))
        .withColumns(
            {
                "rest": F.sum("source_size").over(every) - F.coalesce(F.sum(limit).over(before), F.lit(0)),
                "rest_weight": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
            }
        )
        .withColumn("stopped", limit * F.col("rest_weight") < F.col("weight") * F.col("rest"))
        .withColumns(
            {
                "left": F.sum("source_size").over(every) - F.sum(F.when(F.col("stopped"), limit).otherwise(0)).over(every),
                "left_weight": F.sum(F.when(F.col("stopped"), 0).otherwise(F.col("weight"))).over(every),
            }
        )
        .withColumn(
            "target",
            F.when(F.col("stopped"), limit.cast("double")).otherwise(
                F.col("weight") * (F.col("left").cast("double") / F.col("left_weight"))
            ),
        )
        .drop("rest", "rest_weight", "left", "left_weight", "stopped", "weight")
    )


def sampling_key(identity: Sequence[Column], quality: Column, seed: int) -> Column:
    """An exponential variable with rate ``quality``, fixed by ``identity`` and the seed."""
    parts = [F.coalesce(c.cast("string"), F.lit("null")) for c in identity]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
    uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.ln(uniform) / quality


def mix(
    df: DataFrame,
    size: str = "size",
    quality: str = "quality",
    source: str = "source",
    identity: Sequence[str] | str = "doc_id",
    weights: Sequence[int] = (1, 2, 3),
    max_epochs: int = 3,
    seed: int = 7,
) -> DataFrame:
    """``df`` with ``source_size``, ``target`` and ``taken``: the words the mix takes of each row.

    Every source gives its whole number of epochs from each row. The fraction of an epoch that is left goes
    to its rows in the order of exponential keys with the rows' ``quality`` as rate (a weighted sample
    without replacement): rows are taken whole until the words left run out, the last one in part, so
    that a source gives exactly its target, rounded down. Equal keys go by identity.

    Running sums are formed in buckets of about ``BUCKET_ROWS`` rows: keys are cut at fixed points, and
    sums of buckets are carried forward. A source with a third of all rows is so spread like any other.
    Null sources form a source of their own, a null or negative size counts as 0, rows of size 0 give
    nothing, and a quality that is null or not positive counts as 1e-3. An empty table gives an empty table.
    """
    names = {wish: free_name(df, wish) for wish in ("key", "bucket", "rows", "rate", "upto", "base", "count", "match", "turn")}
    key, bucket, count, match = (F.col(names[n]) for n in ("key", "bucket", "count", "match"))
    out = df.drop("source_size", "target", "taken")
    identity = [identity] if isinstance(identity, str) else list(identity)
    numbered = number_repeats(out, [*identity, source], names["turn"])
    drawn_by = [*[F.col(c) for c in identity], F.col(names["turn"])]
    amount = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")
    rate = F.greatest(F.coalesce(F.col(quality).cast("double"), F.lit(0.0)), F.lit(1e-3))
    same = F.struct(F.col(source).isNull(), F.coalesce(F.col(source).cast("string"), F.lit("")))
    stats = (
        df.groupBy(F.col(source).alias("source"))
        .agg(F.sum(amount).alias("source_size"), F.count("*").alias("n_rows"), F.avg(rate).alias("mean_rate"))
    )
    # Stored, so that Spark knows its size and does not shuffle the rows by source to join it.
    targets = stage(source_targets(stats, weights, max_epochs).select(
        F.struct(F.col("source").isNull(), F.coalesce(F.col("source").cast("string"), F.lit(""))).alias(names["match"]),
        "source_size",
        "target",
        F.ceil(F.col("n_rows") / BUCKET_ROWS).alias(names["count"]),
        F.col("mean_rate").alias(names["rate"]),
    ))
    keyed = (
        numbered.withColumn(names["match"], same)
        .withColumn(names["key"], sampling_key(drawn_by, rate, seed))
        .join(targets, names["match"])
        .withColumn(
            names["bucket"],
            F.least(F.floor((1 - F.exp(-key * F.col(names["rate"]))) * count), count - 1),
        )
    )
    sums = keyed.groupBy(match, bucket).agg(F.sum(amount).alias(names["upto"]))
    earlier = W.partitionBy(match).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select(match, bucket, F.coalesce(F.sum(names["upto"]).over(earlier), F.lit(0)).alias(names["base"]))
    ahead = W.partitionBy(match, bucket).orderBy(key, *drawn_by).rowsBetween(W.unboundedPreceding, -1)
    # Whole words that the source gives, its whole epochs, and what is left for the sample.
    words = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0)
    left = words - epochs * F.col("source_size")
    start = F.col(names["base"]) + F.coalesce(F.sum(amount).over(ahead), F.lit(0))
    return (
        keyed.join(bases, [names["match"], names["bucket"]])
        .withColumn(names["upto"], start)
        .withColumn(
            "taken",
            (epochs * amount + F.least(amount, F.greatest(left - F.col(names["upto"]), F.lit(0)))).cast("long"),
        )
        .select(*out.columns, "source_size", "target", "taken")
    )


def digest_of(text: Column) -> Column:
    """Tells texts apart, null and empty ones not."""
    return F.md5(F.coalesce(text, F.lit("")))


def quality_of(text: Column) -> Column:
    """A rate from 0.5 to 1: half of it falls away with the share of markup symbols."""
    chars = F.greatest(F.char_length(text), F.lit(1))
    plain = F.char_length(F.translate(text, SYMBOLS, ""))
    return F.coalesce(F.lit(0.5) + F.lit(0.5) * (plain / chars), F.lit(0.5))


def op3_mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sized = stage(
        docs.select(
            "doc_id",
            "source",
            word_count(F.col("text")).alias("size"),
            quality_of(F.col("text")).alias("quality"),
            digest_of(F.col("text")).alias("digest"),
        )
    )
    return mix(sized, identity=("doc_id", "digest")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    coalesce(0.5::DOUBLE + 0.5::DOUBLE
      * (length(translate(text, '#*$%&|<>', ''))::DOUBLE / greatest(length(text), 1)::DOUBLE), 0.5::DOUBLE) AS quality,
    (('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, '')) || ':' ||
        (row_number() OVER (PARTITION BY doc_id, source, md5(coalesce(text, ''))) - 1)), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE)
      / 4503599627370496::DOUBLE AS u
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, sum(source_size) OVER ()::BIGINT AS total
  FROM sizes
), ordered AS (
  SELECT *,
    total - coalesce(sum(3 * source_size) OVER before, 0)::BIGINT AS rest,
    (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::BIGINT AS rest_weight
  FROM weighed
  WINDOW before AS (ORDER BY source_size::DOUBLE / weight::DOUBLE, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), stopped AS (
  SELECT *, 3 * source_size * rest_weight < weight * rest AS stopped FROM ordered
), targets AS (
  SELECT source, source_size,
    CASE WHEN stopped THEN (3 * source_size)::DOUBLE
      ELSE weight::DOUBLE * ((total - sum(CASE WHEN stopped THEN 3 * source_size ELSE 0 END) OVER ())::BIGINT::DOUBLE
        / (sum(CASE WHEN stopped THEN 0 ELSE weight END) OVER ())::BIGINT::DOUBLE) END AS target
  FROM stopped
), keyed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.source, u, -ln(u) / quality AS k,
    floor(target)::BIGINT AS words,
    CASE WHEN t.source_size > 0 THEN floor(target)::BIGINT // t.source_size ELSE 0 END AS epochs
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (epochs * size + least(size, greatest(words - epochs * source_size - coalesce(sum(size) OVER (
    PARTITION BY source ORDER BY k, doc_id, u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT, 0)))::BIGINT AS taken
FROM keyed
"""

QUERIES = {"op3_mix_sources": op3_mix_sources}
ORACLE = {"op3_mix_sources": ORACLE_SQL}
