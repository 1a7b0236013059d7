"""Point-in-interval joins by equality: intervals as a few blocks of doubling length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks of up to 2**LEVELS days; longer and open intervals take more blocks of that length.
LEVELS = 12
#: Days since 1970 that stand for "ever before" and "ever after".
FIRST_DAY, LAST_DAY = -(1 << 16), 1 << 16


def _blocks(start: Column, end: Column) -> Column:
    """The blocks (level, number) that make up the days from ``start`` to before ``end``, two of each length at most."""
    entry = "array<struct<level:int,block:bigint>>"
    block = lambda level, n: F.array(F.struct(level.cast("int").alias("level"), n.alias("block"))).cast(entry)
    none = F.array().cast(entry)

    def step(state: Column, level: Column) -> Column:
        a, b, out = state["a"], state["b"], state["out"]
        low, high = (a < b) & (a % 2 != 0), (a < b) & (b % 2 != 0)
        first = F.when(low, block(level, a)).otherwise(none)
        last = F.when(high & ~(low & (a + 1 == b)), block(level, b - 1)).otherwise(none)
        up = F.when(low, a + 1).otherwise(a), F.when(high, b - 1).otherwise(b)
        return F.struct(F.shiftright(up[0], 1).alias("a"), F.shiftright(up[1], 1).alias("b"), F.concat(out, first, last).alias("out"))

    begin = F.struct(start.cast("bigint").alias("a"), F.greatest(start, end).cast("bigint").alias("b"), none.alias("out"))
    rest = F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), begin, step)
    top = F.when(
        rest["a"] < rest["b"],
        F.transform(F.sequence(rest["a"], rest["b"] - 1), lambda n: F.struct(F.lit(LEVELS).cast("int").alias("level"), n.alias("block"))),
    ).otherwise(none)
    return F.concat(rest["out"], top.cast(entry))


def at_day(points: DataFrame, intervals: DataFrame, keys: Sequence[str], day: str, start: str, end: str) -> DataFrame:
    """``points`` joined with the ``intervals`` of the same ``keys`` that hold on their ``day``: ``start <= day < end``.

    ``start`` and ``end`` are dates; a null one means since ever or for ever. Every interval is cut into blocks of 1, 2, 4 ... days,
    about twice as many as its length has binary digits, and every day lies in one block of each length. So the join is by equality of keys, length
    and block: a key with very many intervals is spread by time, and no pair is formed that does not hold. A day is met in just one
    block of an interval, so nothing comes up twice. Days without a value meet nothing. Keys with no more intervals than there are lengths
    are not cut: their days meet each of the intervals, which are fewer rows than a day by each length.
    """
    number = lambda c: F.unix_date(F.col(c).cast("date"))
    blocks = _blocks(F.coalesce(number(start), F.lit(FIRST_DAY)), F.coalesce(number(end), F.lit(LAST_DAY)))
    counts = intervals.groupBy(*keys).agg(F.count("*").alias("_n"))
    few = F.col("_n") <= LEVELS + 1
    # Points whose keys have no interval are not multiplied by the lengths.
    known = points.where(F.col(day).isNotNull()).join(counts, list(keys))
    at = F.col(day).cast("date")
    holds = (F.col(start).isNull() | (F.col(start).cast("date") <= at)) & (F.col(end).isNull() | (at < F.col(end).cast("date")))
    whole = known.where(few).drop("_n").join(intervals, list(keys)).where(holds)
    crowded = intervals.join(counts.where(~few).drop("_n"), list(keys), "left_semi")
    cut = crowded.withColumn("_b", F.explode(blocks)).withColumns({"_level": F.col("_b.level"), "_block": F.col("_b.block")}).drop("_b")
    levels = F.sequence(F.lit(0), F.lit(LEVELS))
    block = F.call_function("shiftright", number(day).cast("bigint"), F.col("_level"))
    asked = known.where(~few).drop("_n").withColumn("_level", F.explode(levels)).withColumn("_block", block)
    spread = asked.join(cut, [*keys, "_level", "_block"]).drop("_level", "_block")
    return whole.unionByName(spread.select(*whole.columns))
