"""Quality by hierarchical empirical Bayes: a document classifier, shrunken rates of hosts and of paths."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import free_name, labelled_texts, stage, table
from tarn.llm.linear import fit_logistic
from tarn.llm.toxicity import held_out
from tarn.llm.words import Texts, passes

#: Labelled rows that the classifier is fitted on, about.
SAMPLE_ROWS = 12_000
#: Shrinkage of a rate counts as so many documents at least and at most.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1e6


def features(texts: Texts) -> np.ndarray:
    """Shares of kinds of characters and words, one row per text."""
    data = texts.data
    kinds = np.zeros((256, 7), bool)
    for column, members in enumerate((range(65, 91), range(48, 58), b".,;:", b"#*$%&|<>", b"|", b"!", b"\n")):
        kinds[list(members), column] = True
    size = np.maximum(np.diff(texts.bounds), 1)
    shares = [texts.totals(kinds[:, k][data]) / size for k in range(7)]
    words = texts.words()
    n = words.counts()
    most = np.maximum(n, 1)
    h, owner = words.hashes, words.owner

    def repeated(gap: int) -> np.ndarray:
        same = (h[gap:] == h[:-gap]) & (owner[gap:] == owner[:-gap])
        return np.bincount(owner[gap:][same], minlength=len(texts)) / most

    order = np.lexsort((h, owner))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][fresh], minlength=len(texts)) / most
    spread = distinct * np.sqrt(np.log1p(n))
    length = np.bincount(owner, weights=words.ends - words.starts, minlength=len(texts)) / most
    columns = [*shares, repeated(1), repeated(2), distinct, spread, np.minimum(length, 40) / 10, np.log1p(n), np.minimum(n, 60) / 60]
    return np.stack(columns, axis=1) if len(texts) else np.zeros((0, 14))


@dataclass
class Evidence:
    """Log odds of a text from its standardized features and their squares."""

    middle: np.ndarray
    width: np.ndarray
    weights: np.ndarray
    bias: float

    @staticmethod
    def expand(x: np.ndarray) -> np.ndarray:
        x = np.clip(x, -6, 6)
        return np.hstack([x, x * x / 6])

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Evidence:
        middle = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        width = np.maximum(x.std(axis=0), 1e-3) if len(x) else np.ones(x.shape[1])
        weights, bias = fit_logistic(cls.expand((x - middle) / width), y, l2=1.0, rounds=30)
        return cls(middle, width, weights, bias)

    def __call__(self, texts: Texts) -> np.ndarray:
        z = self.expand((features(texts) - self.middle) / self.width) @ self.weights + self.bias
        return np.clip(z, -12, 12)


def with_evidence(df: DataFrame, text: str, name: str, evidence: Evidence) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])
    at = df.columns.index(text)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [evidence(texts) for _, texts in passes(batch.column(at))]
            column = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(column)], names=schema.names)

    return df.mapInArrow(judge, schema)


def fit_evidence(labelled: DataFrame) -> Evidence:
    """Fit to a bounded table of ``text`` and ``label``; the driver sees its features only."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in passes(batch.column(0)):
                x = features(texts)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([flat, batch.column(1).slice(at, len(texts))], names=["x", "label"])

    rows = labelled.select("text", "label").mapInArrow(measure, "x array<double>, label int").toArrow()
    y = np.asarray(rows.column("label")).astype(float)
    x = np.asarray(rows.column("x").combine_chunks().flatten()).reshape(len(y), -1) if len(y) else np.zeros((0, 14))
    if not len(y) or y.min() == y.max():
        x, y = x[:0], y[:0]
    return Evidence.fit(x, y)


def strength(groups: DataFrame, n: str, mean: str, centre: str, within: float) -> float:
    """How many documents the shrinkage towards ``centre`` counts as, by the method of moments.

    What group means vary beyond the sampling of their documents is the true variance between groups; the
    strength is the variance within one document's rate over it.
    """
    one = groups.agg(
        F.count("*").alias("groups"),
        F.sum(n).alias("n"),
        F.sum(F.col(n) * F.col(n)).alias("squares"),
        F.sum(F.col(n) * (F.col(mean) - F.col(centre)) ** 2).alias("scatter"),
    ).first()
    if not one.groups or one.groups < 2:
        return MOST_STRENGTH
    spread = one.n - one.squares / one.n
    between = max(0.0, one.scatter - (one.groups - 1) * within) / spread if spread > 0 else 0.0
    return float(min(max(within / between if between > 0 else MOST_STRENGTH, LEAST_STRENGTH), MOST_STRENGTH))


def site_rates(scored: DataFrame, host: str, path: str, share: str) -> tuple[DataFrame, float]:
    """Posterior rates by (``host``, ``path``), and the global rate: sums by path, then by host, then over all.

    A host's rate is its documents' mean share, drawn towards the global rate; a path's is drawn towards its host's.
    The fewer documents, the stronger the pull.
    """
    paths = stage(
        scored.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(
            F.count("*").cast("double").alias("n"), F.sum(share).alias("total"), F.sum(F.col(share) ** 2).alias("squares")
        )
    )
    n, total, squares = paths.agg(F.sum("n"), F.sum("total"), F.sum("squares")).first()
    centre = total / n if n else 0.5
    within = max(squares / n - centre * centre, 1e-6) if n else 0.25
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("total").alias("host_total"))
    hosts = hosts.withColumns({"mean": F.col("host_total") / F.col("host_n"), "centre": F.lit(centre)})
    k = strength(hosts, "host_n", "mean", "centre", within)
    hosts = hosts.select(
        F.col("host").alias("of"), ((F.col("host_total") + k * F.lit(centre)) / (F.col("host_n") + k)).alias("host_rate")
    )
    sites = paths.join(hosts, F.col("host").eqNullSafe(F.col("of")))
    j = strength(sites.withColumn("mean", F.col("total") / F.col("n")), "n", "mean", "host_rate", within)
    rate = (F.col("total") + j * F.col("host_rate")) / (F.col("n") + j)
    return sites.select("host", "path", "host_rate", rate.alias("path_rate")), float(centre)


def log_odds(share: Column) -> Column:
    inner = F.least(F.greatest(share, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(inner / (1 - inner))


def quality_scores(
    df: DataFrame,
    labelled: DataFrame,
    host: str = "source",
    path: str = "lang",
    text: str = "text",
    identity: str = "doc_id",
    label: str = "quality",
    sample: int = SAMPLE_ROWS,
) -> DataFrame:
    """``df`` with ``evidence`` (the text's log odds), ``host_rate``, ``path_rate`` and ``score`` (0 to 1, good above 0.5).

    ``labelled``: identity and 0/1 label of rows that may be learned from; about ``sample`` of them, picked by a hash,
    fit the classifier. The classifier's shares are summed by path and host over all rows; rates are shrunk (see
    ``site_rates``), and a text's log odds move by those of its path against the global rate. Null hosts and paths
    are sites of their own; null and empty texts are scored as texts without words. Without labels of both kinds
    all texts have even odds. Columns of ``df`` with the names of results are replaced. The corpus is not shuffled as
    long as the table of paths fits a broadcast.
    """
    names = ("evidence", "host_rate", "path_rate", "score")
    out = df.select(*[c for c in df.columns if c.lower() not in names])
    evidence = fit_evidence(labelled_texts(df, labelled, text, identity, label, sample)[0])
    own = free_name(out, "share")
    sites = [c for c in dict.fromkeys([host, path]) if c != text]
    scored = with_evidence(out.select(*sites, text), text, own, evidence).withColumn(own, 1 / (1 + F.exp(-F.col(own))))
    rates, centre = site_rates(scored, host, path, own)
    rates = stage(rates.select(_site(F.col("host"), F.col("path")).alias(own), "host_rate", "path_rate"))
    score = 1 / (1 + F.exp(-(F.col("evidence") + log_odds(F.col("path_rate")) - log_odds(F.lit(centre)))))
    return (
        with_evidence(out, text, "evidence", evidence)
        .withColumn(own, _site(F.col(host), F.col(path)))
        .join(rates, own)
        .withColumn("score", score)
        .select(*out.columns, *names)
    )


def _site(host: Column, path: Column) -> Column:
    """A key that is never null."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")) for c in (host, path)]
    return F.struct(parts[0].alias("host"), parts[1].alias("path"))


def score_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return quality_scores(docs, labels)


def op5_empirical_bayes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return score_documents(spark, docs, sf_dir).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "evidence",
        "host_rate",
        "path_rate",
        "score",
        (F.col("score") >= 0.5).alias("kept"),
    )


QUERIES = {"op5_empirical_bayes": op5_empirical_bayes}
ORACLE: dict[str, str] = {}
