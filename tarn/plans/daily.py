"""The daily jobs over a lake: embed, digest, outliers, questions."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions.moments import AsOf, parse_day
from tarn.functions.vectors import DEFAULT_DIM
from tarn.operators.content import Embedder, embed, embedding_rows
from tarn.operators.generation import Generator, anomaly_report, daily_digest, rag_answer, rag_context
from tarn.operators.outliers import isolation_forest
from tarn.operators.similarity import cosine_topk
from tarn.operators.vector_store import changed_embedding_rows
from tarn.session import cut_lineage
from tarn.sources.lake import Lake, is_absent, read_day, read_table, with_source_date, write_day
from tarn.sources.objects import subfolders
from tarn.sources.paths import pattern_of, table_root

# Sources that are embedded, and the digest's text column per source.
EMBED_SOURCES = ("jellyfin", "truenas", "weather", "truenas_logs", "alexa")
DIGEST_COLUMNS = {"jellyfin": "Name", "truenas": "name", "weather": "temperature_2m"}


def raw_day(lake: Lake, source: str, day: AsOf) -> DataFrame | None:
    """One day of a raw source, or None when the source was never loaded."""
    try:
        return read_day(lake.spark, pattern_of(table_root(lake.root, source=source)), day, merge_schema=True)
    except AnalysisException as problem:
        if not is_absent(problem):
            raise
        return None


def embed_source(
    lake: Lake,
    source: str,
    day: AsOf,
    embedder: Embedder | None = None,
    dim: int = DEFAULT_DIM,
    model: str | None = None,
) -> str | None:
    """Embed one day of a source into ``embeddings/<source>``.

    With the name of a ``model``, texts that any source had on any day before keep the vector they got then
    (in ``vectors/<model>``), and only new ones are embedded.
    """
    rows = raw_day(lake, source, day)
    if rows is None:
        return None
    # Partition columns are no content.
    rows = rows.drop("year", "month", "day")
    if model is None:
        made = embedding_rows(rows, source, day, embedder, dim)
    else:
        store = table_root(lake.root, source=model, area="vectors")
        made = changed_embedding_rows(rows, source, day, store, embedder, dim).drop("first_day")
    return write_day(made, lake.root, day, source=source, area="embeddings")


def embed_sources(
    lake: Lake,
    day: AsOf,
    sources: Iterable[str] = EMBED_SOURCES,
    embedder: Embedder | None = None,
    dim: int = DEFAULT_DIM,
    model: str | None = None,
) -> dict[str, str]:
    """Embed all sources that have data, one after the other."""
    written = {s: embed_source(lake, s, day, embedder, dim, model) for s in sources}
    return {s: root for s, root in written.items() if root}


def embeddings(lake: Lake, source: str | None = None) -> DataFrame:
    """Stored vectors of one source, or of all, with their day partitions."""
    if source is not None:
        return read_table(lake.spark, pattern_of(table_root(lake.root, source=source, area="embeddings")))
    tables = [read_table(lake.spark, folder) for folder in subfolders(lake.spark, f"{lake.root}/embeddings")]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def digest_sources(
    lake: Lake,
    day: AsOf,
    columns: Mapping[str, str] = DIGEST_COLUMNS,
    generator: Generator | None = None,
) -> dict[str, str]:
    """Write a summary per source and day to ``raw/summaries/<source>``."""
    written = {}
    for source, column in columns.items():
        rows = raw_day(lake, source, day)
        if rows is None:
            continue
        texts = rows.select(F.lit(source).alias("source"), F.col(column).cast("string").alias("text"))
        digest = daily_digest(texts, day, "text", ["text"], generator)
        written[source] = write_day(digest, lake.root, day, source=f"summaries/{source}")
    return written


def flag_outliers(
    lake: Lake,
    source: str,
    day: AsOf,
    contamination: float = 0.05,
    newest: int | None = None,
    generator: Generator | None = None,
) -> DataFrame:
    """Score the vectors of a source; the day's scores go to ``anomalies/<source>``, the report to ``anomaly_reports/<source>``.

    All rows (or the ``newest``) make up the forest and the report, but each day stores the scores of its own rows only, so
    that what is stored grows with the table. Returns the stored report.
    """
    rows = embeddings(lake, source).select("id", "content", "embedding", "source_date")
    flagged = isolation_forest(
        rows,
        "embedding",
        ["id", "source_date"],
        contamination,
        newest=None if newest is None else ("source_date", newest),
    )
    flagged = cut_lineage(flagged)
    own = flagged.where(F.col("source_date") == F.lit(parse_day(day)).cast("date"))
    write_day(own, lake.root, day, source=source, area="anomalies")
    report = anomaly_report(flagged, source, ["source_date", "id"], generator)
    root = write_day(with_source_date(report, day), lake.root, day, source=source, area="anomaly_reports")
    return read_day(lake.spark, pattern_of(root), day).select("source", "report")


def ask(
    lake: Lake,
    questions: DataFrame,
    k: int = 10,
    style: str = "plain",
    embedder: Embedder | None = None,
    generator: Generator | None = None,
    dim: int = DEFAULT_DIM,
) -> DataFrame:
    """Answer questions (``query_id, question``) from the nearest stored rows."""
    asked = embed(questions, embedder, dim, text="question").select("query_id", "embedding")
    rows = embeddings(lake).select("id", "source", "content", "embedding", "source_date", "ingested_at")
    hits = cosine_topk(rows, asked, k, embedder.dim if embedder else dim, ties=("id", "source", "source_date"))
    return rag_answer(questions, rag_context(hits, style), generator, style)
