"""Document fingerprints: threshold-scaled sketches of word shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.llm.common import SPACE, free_name, let, stage, table

SHINGLE_WORDS = 5
#: One shingle hash in so many is kept.
SCALE = 16
#: Short texts keep at least so many of their smallest hashes.
LEAST_KEPT = 64
#: Neighbouring ids that one window holds, as a power of two.
BLOCK_BITS = 8
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def limit_of(scale: int) -> int:
    """Signed 64-bit hashes below this are one in ``scale``."""
    return LOWEST + (1 << 64) // scale


def shingle_hashes(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """64-bit hashes of all runs of ``words`` lower-case words; a shorter text is one shingle, an empty one has none."""
    parts = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")
    hashed = F.transform(parts, lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        n = F.size(h)
        starts = F.slice(h, F.lit(1), n - (words - 1))
        many = F.transform(starts, lambda first, i: F.xxhash64(first, *[F.get(h, i + k) for k in range(1, words)]))
        return F.when(n >= words, many).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return let(hashed, runs)


def sketch(text: Column, scale: int = SCALE, least: int = LEAST_KEPT) -> Column:
    """``limit`` and ``hashes``: all distinct shingle hashes of the text below the limit, sorted.

    The limit is the same fraction of all hashes for every text, so sketches of very unequal texts compare. A text with fewer than
    ``least`` hashes below it keeps its ``least`` smallest ones, or all it has; its limit is then higher, and the sketch says so.
    """

    def struct(limit: Column, hashes: Column) -> Column:
        return F.struct(limit.alias("limit"), hashes.alias("hashes"))

    def smallest(hashes: Column) -> Column:
        # Below the next hash there are just so many.
        cut = struct(F.get(hashes, F.lit(least)), F.slice(hashes, 1, least))
        return F.when(F.size(hashes) <= least, struct(F.lit(HIGHEST), hashes)).otherwise(cut)

    def keep(hashes: Column) -> Column:
        # Only what is kept is sorted; all hashes are for short texts alone.
        below = F.sort_array(F.filter(hashes, lambda h: h < F.lit(limit_of(scale))))
        short = let(F.sort_array(hashes), smallest)
        return let(below, lambda b: F.when(F.size(b) >= least, struct(F.lit(limit_of(scale)), b)).otherwise(short))

    return let(F.array_distinct(shingle_hashes(text)), keep)


def _below(s: Column, limit: Column) -> Column:
    return F.filter(s["hashes"], lambda h: h < limit)


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of the smaller text's shingles that the other has too, 0 to 1; equal sketches give 1.

    Each sketch has all hashes below its limit, so below the lower of the two limits both are complete; only those are counted. A
    sketch without any hash there, of an empty text or of a very short one beside a long one, is like an equal one only.
    """

    def both(x: Column, y: Column) -> Column:
        limit = F.least(x["limit"], y["limit"])
        return let(
            F.struct(_below(x, limit).alias("l"), _below(y, limit).alias("r")),
            lambda p: F.when(x == y, F.lit(1.0))
            .when(F.least(F.size(p["l"]), F.size(p["r"])) == 0, F.lit(0.0))
            .otherwise(F.size(F.array_intersect(p["l"], p["r"])) / F.least(F.size(p["l"]), F.size(p["r"]))),
        )

    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: both(p["a"], p["b"]))


def merge(a: Column, b: Column) -> Column:
    """The sketch of two texts together: complete below the lower of both limits."""

    def both(x: Column, y: Column) -> Column:
        limit = F.least(x["limit"], y["limit"])
        hashes = F.sort_array(F.array_union(_below(x, limit), _below(y, limit)))
        return F.struct(limit.alias("limit"), hashes.alias("hashes"))

    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: both(p["a"], p["b"]))


def as_text(s: Column) -> Column:
    """A sketch as hexadecimal numbers of 16 digits, joined: the limit, then the hashes."""
    return F.array_join(F.transform(F.concat(F.array(s["limit"]), s["hashes"]), lambda h: F.lpad(F.hex(h), 16, "0")), "")


def with_next(
    df: DataFrame, columns: dict[str, str], prepare=lambda d: d, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Each row with ``columns`` (new name -> column) of the row after it, by descending ``key``; after the last: the first.

    ``prepare`` adds columns once rows are in their place. Blocks of 2**BLOCK_BITS neighbouring keys are put in order
    by themselves, so the table is shuffled once and no task orders it all. Each block also gets a copy of the row
    that follows its last one. Which row that is comes from the keys alone, found block by block and level by level:
    each level has a row for every block of the one below. Null keys come last; rows with the same key are ordered
    by a hash of their text. A single row follows itself; an empty table stays empty.
    """
    at, tie, ghost, block, wanted = (free_name(df, n) for n in ("at", "tie", "ghost", "block", "wanted"))
    placed = df.withColumns(
        {
            at: F.coalesce(F.col(key).cast("long"), F.lit(LOWEST)),
            tie: F.xxhash64(F.coalesce(F.col(text), F.lit(""))),
            ghost: F.lit(0),
        }
    ).withColumn(block, F.shiftright(at, BLOCK_BITS))
    follows = _next_blocks(placed.select(F.col(at).alias("top"))).select(F.col("top").alias(at), F.col("block").alias(wanted))
    # Stored, so that Spark knows its size: as long as it fits a broadcast, the texts are not shuffled to find the copies.
    follows = stage(follows)
    copies = placed.join(follows, at).withColumns({block: F.col(wanted), ghost: F.lit(1)}).drop(wanted)
    order = W.partitionBy(block).orderBy(ghost, F.col(at).desc(), F.col(tie).desc())
    return (
        prepare(placed.unionByName(copies).repartition(block))
        .withColumns({new: F.lead(old).over(order) for new, old in columns.items()})
        .where(F.col(ghost) == 0)
        .drop(at, tie, ghost, block)
    )


def _next_blocks(keys: DataFrame) -> DataFrame:
    """For each ``block``, the ``top`` key of the next lower block that has rows; for the lowest, of the highest."""
    span = keys.agg(F.min("top"), F.max("top")).first()
    low, high = (0, 0) if span[0] is None else span
    level = keys.groupBy(F.shiftright("top", BLOCK_BITS).alias("block")).agg(F.max("top").alias("top"))
    level = level.withColumn("place", F.col("block"))
    found, bits = None, BLOCK_BITS
    while True:
        bits += BLOCK_BITS
        alone = bits > 63 or high >> bits == low >> bits
        group = F.lit(0).cast("long") if alone else F.shiftright("place", BLOCK_BITS)
        level = level.withColumn("span", group)
        lower = F.lead("top").over(W.partitionBy("span").orderBy(F.col("place").desc()))
        linked = level.select("block", F.coalesce(lower, F.lit(high)).alias("top") if alone else lower.alias("top"))
        linked = linked.where(F.col("top").isNotNull())
        found = linked if found is None else found.unionByName(linked)
        if alone:
            return found
        # A group goes up with its highest key, and with its lowest block, which still looks for a follower.
        level = level.groupBy("span").agg(F.min_by("block", "place").alias("block"), F.max("top").alias("top"))
        level = level.withColumnRenamed("span", "place")


def op1_scaled_sketch(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    paired = with_next(
        docs,
        {"next_text": "text", "next_sketch": "own"},
        prepare=lambda rows: rows.withColumn("own", sketch(F.col("text"))),
    )
    n_chars = F.char_length("text")
    half = F.floor(n_chars / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n_chars - half), F.substring(F.col("next_text"), F.lit(1), half))
    made = paired.select(
        "doc_id", n_chars.cast("long").alias("n_chars"), "own", "next_sketch", edited.alias("edited")
    ).withColumn("changed", sketch(F.col("edited")))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_sketch")).alias("near_next"),
    )


QUERIES = {"op1_scaled_sketch": op1_scaled_sketch}
ORACLE: dict[str, str] = {}
