"""Answers, digests and outlier notes: context, prompt, generated text; long texts are folded chunk by chunk."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.moments import AsOf, parse_day
from tarn.functions.text import nonblank
from tarn.functions.vectors import once
from tarn.operators.ranking import joined_text
from tarn.session import cut_lineage

# Prompt texts and the message for an empty report.
HOME_PROMPT = "You are an assistant that answers questions about home data.\n\nContext from data lake:\n"
ANALYST_PROMPT = (
    "You are an analyst for a business datalakehouse. "
    "Answer the following question using the context snippets below. "
    "Be concise and cite which data sources support your answer.\n\nQuestion: "
)
DIGEST_PROMPT = ("Summarize the following ", " activity from ", " in 3-5 bullet points:\n\n")
OUTLIER_PROMPT = ("The following ", " entries were flagged as anomalies. Summarize what's unusual about them:\n\n")
NO_ANOMALIES = "No anomalies detected."

#: Text that one call of a model is given, and summaries that one call combines.
CHUNK_BYTES = 32 << 10
COMBINED = 64


class Generator(Protocol):
    """An external text model, called inside Spark tasks with up to ``batch`` prompts."""

    batch: int

    def generate(self, prompts: list[str]) -> list[str]: ...


def lines_of(text: Column) -> Column:
    """Lines of a text that hold something."""
    return F.filter(F.split(text, "\n"), lambda line: nonblank(line).isNotNull())


def extract(context: Column) -> Column:
    """Offline stand-in for a model: the lines of the context as bullets."""
    return F.concat_ws("\n", F.transform(lines_of(context), lambda line: F.concat(F.lit("- "), line)))


def generated(prompt: Column, generator: Generator) -> Column:
    """Model output for a prompt."""
    model, size = generator, generator.batch

    @F.pandas_udf("string")
    def call_model(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            texts: list[str] = []
            for start in range(0, len(prompts), size):
                texts += model.generate(prompts.iloc[start : start + size].tolist())
            yield pd.Series(texts, index=prompts.index)

    return once(call_model)(prompt)


def _pieces(rows: DataFrame, order: Sequence[str], most: int) -> DataFrame:
    """Rows with ``_place``, a hash of the order columns, and long texts as several rows, numbered by ``_piece``."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order]))
    rows = rows.withColumn("_place", F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"))
    chars = max(1, most // 4)  # a character takes four bytes at most
    cut = F.transform(
        F.sequence(F.lit(0), F.floor((F.char_length("_text") - 1) / chars).cast("int")),
        lambda i: F.substring(F.col("_text"), i * chars + 1, F.lit(chars)),
    )
    pieces = F.when(F.octet_length("_text") > most, cut).otherwise(F.array("_text"))
    return rows.select(*[c for c in rows.columns if c != "_text"], F.posexplode(pieces).alias("_piece", "_text"))


def folded(
    df: DataFrame,
    key: str,
    text: str,
    order: Sequence[str],
    prompt: tuple[Column, Column],
    generator: Generator | None = None,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """One summary per ``key`` of all its texts: ``key, summary``.

    A hash of the ``order`` columns, which should identify a row, deals a key's rows into chunks of about
    ``chunk_bytes``; a chunk's texts are joined in that order and summarized, and summaries are combined in
    rounds until one is left. A key with a third of all rows is so spread like any other. Equal texts of a chunk are one line
    with the number of times, counted before the shuffle, and a text of more than ``chunk_bytes`` is cut into pieces that are dealt
    one by one; so no prompt grows with repeats or with a single text. ``prompt`` goes
    before and after the key, and the texts follow it. Offline, a chunk's summary is its first line and its
    number of rows, and the last line counts them all. Rows without a text are left out.
    """
    rows = df.select(key, *[c for c in dict.fromkeys(order) if c not in (key, text)], F.col(text).cast("string").alias("_text"))
    rows = rows.where(F.col("_text").isNotNull())
    order = [("_text" if c == text else c) for c in order]
    rows = _pieces(rows, order, chunk_bytes)
    # One row per key, stored so that Spark knows how small it is.
    sizes = cut_lineage(
        rows.groupBy(F.col(key).alias("_key")).agg(
            F.greatest(F.lit(1), F.ceil(F.sum(F.octet_length("_text")) / chunk_bytes)).cast("bigint").alias("_chunks")
        )
    )
    place = F.col("_place") + F.col("_piece")
    times = F.when(F.col("_n") > 1, F.concat(F.lit(" ("), F.col("_n"), F.lit(" times)"))).otherwise("")
    said = F.col("_text") if generator is None else F.concat("_text", times)
    chunks = (
        rows.join(sizes, F.col(key).eqNullSafe(F.col("_key")))
        .withColumn("_part", F.pmod(place, F.col("_chunks")))
        .groupBy(key, "_part", "_text")
        .agg(F.min(F.struct(*order, "_piece")).alias("_first"), F.count("*").alias("_n"), F.count_if(F.col("_piece") == 0).alias("_rows"))
        .groupBy(key, "_part")
        .agg(
            F.concat_ws(
                "\n", F.array_sort(F.collect_list(F.struct("_first", said.alias("_said")))).getField("_said")
            ).alias("_texts"),
            F.sum("_rows").alias("_rows"),
        )
    )
    before, after = prompt

    def summarized(parts: DataFrame) -> DataFrame:
        if generator is not None:
            asked = F.concat(before, F.coalesce(F.col(key).cast("string"), F.lit("")), after, F.col("_texts"))
            return parts.withColumn("_texts", generated(asked, generator))
        first = F.coalesce(F.get(lines_of(F.col("_texts")), F.lit(0)), F.lit(""))
        first = F.regexp_replace(first, r"^- | \(\d+ rows\)$", "")
        return parts.withColumn("_texts", F.concat(F.lit("- "), first, F.lit(" ("), F.col("_rows"), F.lit(" rows)")))

    def joined(parts: DataFrame, part: Column) -> DataFrame:
        return parts.groupBy(key, part.alias("_part")).agg(
            F.concat_ws("\n", F.array_sort(F.collect_list(F.struct("_part", "_texts"))).getField("_texts")).alias("_texts"),
            F.sum("_rows").alias("_rows"),
            F.count("*").alias("_joined"),
        )

    found = cut_lineage(summarized(chunks))
    most = sizes.agg(F.max("_chunks")).first()[0] or 0
    while most > COMBINED:
        found = cut_lineage(summarized(joined(found, F.floor(F.col("_part") / COMBINED))).drop("_joined"))
        most = -(-most // COMBINED)
    final = joined(found, F.lit(0))
    if generator is not None:
        alone, several = final.where("_joined = 1"), final.where("_joined > 1")
        return alone.unionByName(summarized(several)).select(key, F.col("_texts").alias("summary"))
    return final.select(key, F.concat("_texts", F.lit("\n"), F.col("_rows"), F.lit(" rows")).alias("summary"))


def python_float(value: Column, digits: int) -> Column:
    """A rounded number without padding: ``0.5``, ``0.0001``, ``1.0``."""
    fixed = F.format_string(f"%.{digits}f", F.round(value, digits))
    return F.regexp_replace(fixed, r"(\.\d+?)0+$", "$1")


def python_timestamp(at: Column) -> Column:
    """``2025-05-27 14:32:00``, with microseconds only when there are any."""
    whole = F.date_format(at, "yyyy-MM-dd HH:mm:ss")
    has_fraction = F.pmod(F.unix_micros(at), F.lit(1_000_000)) != 0
    return F.when(has_fraction, F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS")).otherwise(whole)


def rag_context(hits: DataFrame, style: str = "plain") -> DataFrame:
    """Ranked hits of each question as one text.

    ``plain`` gives ``[source] content`` lines, ``cited`` gives blocks with time and score.
    """
    if style == "plain":
        line, sep = F.concat(F.lit("["), "source", F.lit("] "), "content"), "\n"
    elif style == "cited":
        line = F.concat(
            F.lit("["),
            "source",
            F.lit(" @ "),
            python_timestamp(F.col("ingested_at").cast("timestamp")),
            F.lit(" (score="),
            python_float(F.col("score"), 4),
            F.lit(")]:\n"),
            "content",
        )
        sep = "\n\n"
    else:
        raise ValueError(f"unknown style {style!r}")
    return joined_text(hits.withColumn("_line", line), ["query_id"], "rank", "_line", sep)


def rag_prompt(question: Column, context: Column, style: str = "plain") -> Column:
    if style == "plain":
        return F.concat(F.lit(HOME_PROMPT), context, F.lit("\n\nQuestion: "), question)
    return F.concat(F.lit(ANALYST_PROMPT), question, F.lit("\n\nContext:\n"), context)


def rag_answer(
    questions: DataFrame,
    contexts: DataFrame,
    generator: Generator | None = None,
    style: str = "plain",
) -> DataFrame:
    """``query_id, question, prompt, answer`` for questions with a context; offline the answer is all of the context."""
    prompt = rag_prompt(F.col("question"), F.col("context"), style)
    answer = extract(F.col("context")) if generator is None else generated(F.col("prompt"), generator)
    return (
        questions.select("query_id", "question")
        .join(contexts, "query_id")
        .withColumn("prompt", prompt)
        .withColumn("answer", answer)
        .drop("context")
    )


def daily_digest(
    df: DataFrame,
    day: AsOf,
    text: str,
    order: Sequence[str],
    generator: Generator | None = None,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """One summary per source of all its rows of a day; ``df`` has a ``source`` column."""
    date = parse_day(day)
    head, middle, tail = DIGEST_PROMPT
    found = folded(df, "source", text, order, (F.lit(head), F.lit(f"{middle}{date}{tail}")), generator, chunk_bytes)
    return found.select("source", F.lit(date).cast("date").alias("date"), "summary")


def anomaly_report(
    flagged: DataFrame,
    source: str,
    order: Sequence[str],
    generator: Generator | None = None,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """One row ``source, report`` about all anomalies."""
    rows = flagged.where("is_anomaly").withColumn("_source", F.lit(source))
    prompt = tuple(F.lit(part) for part in OUTLIER_PROMPT)
    found = folded(rows, "_source", "content", order, prompt, generator, chunk_bytes)
    report = F.coalesce(F.max("summary"), F.lit(NO_ANOMALIES))
    return found.agg(report.alias("report")).select(F.lit(source).alias("source"), "report")
