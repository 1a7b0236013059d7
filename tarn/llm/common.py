"""What the operators share: fixture tables, word counts, staged tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.session import configure, cut_lineage

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` does not have, in any spelling of case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish


def stage(df: DataFrame) -> DataFrame:
    """Store ``df`` in the shared folder, so that neither later passes nor lost executors compute it again."""
    return cut_lineage(df)


def drop_stage(df: DataFrame) -> None:
    """Remove the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def number_repeats(df: DataFrame, columns: list[str], name: str, slice_rows: int = 1 << 17) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2 ... among the rows that are equal in ``columns``, nulls equal to each other.

    Which of them gets which number is open. Rows that occur once, mostly all, are not moved for it. Others are numbered within slices of at most
    ``slice_rows`` rows, and slices are counted, so a third of all rows may be equal and no task sees them together.
    """
    high, low, at, part, start = (free_name(df, n) for n in ("high", "low", "at", "part", "start"))
    known = [F.isnull(F.col(f"`{c}`")) for c in columns]
    hashes = {n: F.xxhash64(F.lit(seed), *known, *[F.col(f"`{c}`") for c in columns]) for n, seed in ((high, 41), (low, 42))}
    keyed = df.withColumns(hashes)
    many = stage(keyed.select(high, low).groupBy(high, low).count().where("count > 1").select(high, low))
    if many.isEmpty():
        return df.withColumn(name, F.lit(0).cast("long"))
    once = keyed.join(many, [high, low], "left_anti").withColumn(name, F.lit(0).cast("long"))
    again = stage(keyed.join(many, [high, low], "left_semi").withColumn(at, F.monotonically_increasing_id()))
    again = again.withColumn(part, F.floor(F.col(at) / slice_rows).cast("long"))
    earlier = W.partitionBy(high, low).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    starts = again.groupBy(high, low, part).agg(F.count("*").alias(start))
    starts = starts.withColumn(start, F.coalesce(F.sum(start).over(earlier), F.lit(0)))
    place = F.row_number().over(W.partitionBy(high, low, part).orderBy(at)) - 1
    numbered = again.withColumn(name, place).join(starts, [high, low, part]).withColumn(name, F.col(name) + F.col(start))
    return once.select(*df.columns, name).unionByName(numbered.select(*df.columns, name))


def drawn(share: float, seed: int, *columns: Column) -> Column:
    """Whether a row is in a sample of ``share``: 53 bits of a hash of ``columns``, exact as a double, decide."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double")
    return bits < F.lit(float(share) * 2.0**53)


def labelled_texts(
    df: DataFrame, labelled: DataFrame, text: str, identity: str, label: str, sample: int, seed: int = 17
) -> tuple[DataFrame, float]:
    """About ``sample`` labelled texts as ``text`` and ``label``, and the share of label 1 among all labelled rows.

    A hash of the identity picks them. ``sample`` bounds the labels that are broadcast and the texts that are stored.
    A sample without any text of a table that has rows is an error.
    """
    usable = labelled.where(F.col(label).isNotNull() & F.col(identity).isNotNull())
    n, prior = usable.agg(F.count("*"), F.avg(F.col(label).cast("double"))).first()
    share = min(1.0, sample / max(n, 1))
    chosen = usable.select(F.col(identity).alias("labelled_id"), F.col(label).cast("int").alias("label")).where(
        drawn(share, seed, F.col("labelled_id"))
    )
    texts = df.select(F.col(identity).alias("labelled_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "labelled_id")
    found = stage(texts.select("text", "label"))
    if share < 1 and found.isEmpty() and not df.isEmpty():
        raise ValueError(f"none of about {sample} rows drawn from {n} labelled ones is in the table")
    return found, 0.1 if prior is None else float(prior)
