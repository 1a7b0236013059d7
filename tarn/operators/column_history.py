"""What became of every column of every table, over all refreshes of the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.operators.ranking import first_per_key


def column_history(observed: DataFrame, refreshes: DataFrame | None = None) -> DataFrame:
    """Intervals of equal state per table and column, from successive refreshes.

    ``observed``: ``table_id, refresh, pos, name, type``, a row for each column that a refresh found; ``refresh`` is anything that
    can be ordered. ``refreshes``: ``table_id, refresh`` of all refreshes that could read the table; by default those that
    found a column. A refresh that could not read a table says nothing about it.

    Result: ``table_id, name, pos, type, deprecated, since, until, change, renamed_from``. ``since`` is the refresh that brought the
    state, ``until`` the one that ended it (null: it holds). ``change``: ``initial`` (there at the table's first refresh), ``added``,
    ``retyped``, ``deprecated`` (missing from here on, type as last seen), ``restored``. A type that flips and flips back gives three intervals. A column
    that appears in the refresh in which another of the same place and type goes missing is ``renamed_from`` it.

    Columns are folded as islands of consecutive refreshes with one type: one shuffle by table and column, and no row for a
    refresh that changes nothing. A column found twice in a refresh counts at its first place.
    """
    told = observed.select("table_id", "refresh") if refreshes is None else refreshes.select("table_id", "refresh")
    by_table = W.partitionBy("table_id").orderBy("refresh")
    numbered = told.distinct().withColumn("n", F.row_number().over(by_table))
    seen = first_per_key(observed.select("table_id", "refresh", "pos", "name", "type"), ["table_id", "refresh", "name"], [F.col("pos"), F.col("type")])
    seen = seen.join(numbered, ["table_id", "refresh"])
    total = numbered.groupBy("table_id").agg(F.max("n").alias("total"))

    by_column = W.partitionBy("table_id", "name").orderBy("n")
    before, kind = F.lag("n").over(by_column), F.lag("type").over(by_column)
    fresh = before.isNull() | (F.col("n") != before + 1) | ~F.col("type").eqNullSafe(kind)
    islands = (
        seen.withColumn("fresh", fresh.cast("int"))
        .withColumn("island", F.sum("fresh").over(by_column))
        .groupBy("table_id", "name", "island")
        .agg(F.min("n").alias("first"), F.max("n").alias("last"), F.min_by("pos", "n").alias("pos"), F.min_by("type", "n").alias("type"))
    )
    order = W.partitionBy("table_id", "name").orderBy("first")
    islands = islands.join(total, "table_id").withColumns(
        {"previous": F.lag("last").over(order), "following": F.coalesce(F.lead("first").over(order), F.col("total") + 1)}
    )
    came = (
        F.when(F.col("previous").isNull(), F.when(F.col("first") == 1, "initial").otherwise("added"))
        .when(F.col("previous") + 1 == F.col("first"), "retyped")
        .otherwise("restored")
    )
    state = lambda deprecated, change, first, last: F.struct(
        F.lit(deprecated).alias("deprecated"), change.alias("change"), first.alias("first"), last.alias("last")
    )
    there = state(False, came, F.col("first"), F.col("last"))
    gone = state(True, F.lit("deprecated"), F.col("last") + 1, F.col("following") - 1)
    states = F.when(F.col("last") + 1 < F.col("following"), F.array(there, gone)).otherwise(F.array(there))
    intervals = islands.select("table_id", "name", "pos", "type", F.inline(states))

    lost = intervals.where("deprecated").select(
        "table_id", "first", "pos", F.col("type").alias("kind"), F.col("name").alias("renamed_from"), F.lit(False).alias("deprecated")
    )
    lost = first_per_key(lost, ["table_id", "first", "pos", "kind"], [F.col("renamed_from")])
    new = F.col("i.change") == "added"
    same = [F.col(f"i.{c}") == F.col(f"l.{c}") for c in ("table_id", "first", "pos")]
    met = intervals.alias("i").join(lost.alias("l"), [*same, F.col("i.type") == F.col("l.kind"), new], "left")
    rows = met.select("i.*", "l.renamed_from")
    since = numbered.select("table_id", F.col("n").alias("first"), F.col("refresh").alias("since"))
    until = numbered.select("table_id", (F.col("n") - 1).alias("last"), F.col("refresh").alias("until"))
    return (
        rows.join(since, ["table_id", "first"])
        .join(until, ["table_id", "last"], "left")
        .select("table_id", "name", "pos", "type", "deprecated", "since", "until", "change", "renamed_from")
    )
