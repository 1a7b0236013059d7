"""Line dedup: lines that many documents share stay in one of them only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import free_name, let, stage, table

#: Lines whose key has fewer code points always stay.
LEAST_CHARS = 20
#: Lines found in at least so many documents stay in one of them.
LEAST_DOCS = 3
#: What is cut off at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    """The lines of a text, cut at every line feed; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, with A to Z in lower case and all other letters as they are."""
    bare = F.btrim(line, F.lit(BLANKS))
    # Only where all letters are ASCII does lower() change A to Z alone; it is the faster one.
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def digest(*columns: Column) -> list[Column]:
    """128 bits of ``columns`` as two longs; a null differs from every value."""
    known = [F.isnull(c) for c in columns]
    return [F.xxhash64(F.lit(seed), *known, *columns) for seed in (31, 32)]


def dedup_lines(
    df: DataFrame, text: str = "text", key: str = "doc_id", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS
) -> DataFrame:
    """``df`` with shared lines taken out of ``text``, and ``n_lines`` (before) and ``n_dropped``, both long.

    Lines are equal if their keys are (see ``line_key``). A key of at least ``least_chars`` code points that at least
    ``least_docs`` documents have loses all its lines but those of the document with the largest ``key``. The other lines stay
    as they are and in order, joined by line feeds.

    Rows with one ``key`` are one document: they count once, and all of them keep the lines that it keeps. Rows
    without a key are one document too, below all others. Null and empty texts are one empty line, which stays;
    a null text becomes an empty one. Rows are neither lost nor added; columns of ``df`` named like results are replaced.

    Lines travel as 128-bit hashes. Documents are counted per hash in two steps, first each pair of hash and document
    once, then the pairs, so that a line which a third of all documents have is counted where these lie. Each hash over the threshold is
    one row of a stored table, which a join takes to its lines; Spark splits these where one key has very many. What is to be dropped from a text is found once for
    equal rows, as the set of its line numbers, so the text itself is shuffled once.
    """
    names = ("n_lines", "n_dropped")
    left, right, high, low, at, drop = (free_name(df, n) for n in ("left", "right", "high", "low", "at", "drop"))
    rows = df.drop(*[c for c in df.columns if c.lower() in names])
    own = dict(zip((left, right), digest(F.col(key), F.col(text))))
    # Texts are hashed below the explode, once, and not for each of their lines.
    whole = rows.select(
        F.col(key).alias("doc"), *[c.alias(n) for n, c in own.items()], F.transform(lines_of(F.col(text)), line_key).alias("keys")
    )
    lines = (
        whole.select("doc", left, right, F.posexplode("keys").alias(at, "line"))
        .where(F.char_length("line") >= least_chars)
        .select("doc", left, right, at, *[c.alias(n) for n, c in zip((high, low), digest(F.col("line")))])
    )
    shared = (
        lines.select(high, low, "doc")
        .distinct()
        .groupBy(high, low)
        .agg(F.count("*").alias("n"), F.max("doc").alias("keeper"))
        .where(F.col("n") >= least_docs)
        .select(high, low, "keeper")
    )
    # Stored, so that the join below deals both sides anew and Spark can split the lines of a common key over tasks.
    shared = stage(shared)
    # The sets of equal rows are equal, and a set holds a line number once.
    dropped = (
        lines.join(shared, [high, low])
        .where(~F.col("doc").eqNullSafe(F.col("keeper")))
        .groupBy(left, right)
        .agg(F.collect_set(at).alias(drop))
    )

    def without(parts: Column, gone: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
        return F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")

    body = F.coalesce(F.col(text), F.lit(""))
    cut = let(
        F.struct(lines_of(F.col(text)).alias("parts"), F.col(drop).alias("gone")),
        lambda p: without(p.getField("parts"), p.getField("gone")),
    )
    return (
        rows.withColumns(own)
        .join(dropped, [left, right], "left")
        .withColumns(
            {
                "n_lines": F.size(lines_of(F.col(text))).cast("long"),
                "n_dropped": F.coalesce(F.size(drop), F.lit(0)).cast("long"),
                text: F.when(F.col(drop).isNull(), body).otherwise(cut),
            }
        )
        .select(*rows.columns, *names)
    )


def op11_line_dedup(spark, sf_dir):
    """All documents without the lines that another document keeps."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = """
WITH rows AS (
    SELECT doc_id, row_number() OVER () AS row_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
),
lines AS (
    SELECT doc_id, row_id, unnest(parts) AS line, unnest(range(len(parts))) AS place FROM rows
),
keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM lines
),
shared AS (
    SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
    GROUP BY k HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 3
),
judged AS (
    SELECT a.*, s.k IS NOT NULL AND a.doc_id IS DISTINCT FROM s.keeper AS gone
    FROM keyed a LEFT JOIN shared s ON a.k = s.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY row_id, doc_id
"""

QUERIES = {"op11_line_dedup": op11_line_dedup}
ORACLE = {"op11_line_dedup": SQL}
