"""Toxicity by weak supervision: a generative model of many voters labels the texts that a linear classifier learns from."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import drawn, labelled_texts, table
from tarn.llm.linear import fit_logistic, sigmoid
from tarn.llm.words import Texts, Words, hashes_of, passes

#: Texts that the classifier is fitted on, and labelled rows that prefixes are mined from, about. All texts enter
#: the label model, and all are scored.
SAMPLE_ROWS = 12_000
#: Words that the classifier may use besides the voters, and prefixes of words that become voters.
WORD_FEATURES = 192
PREFIXES = 32
PREFIX_LENGTHS = (3, 4, 5, 7)
SEED = 17

# Insults, by language. Each word is a voter of its own.
LEXICON = tuple(
    """
    idiot moron stupid dumb imbecile fool dimwit halfwit cretin brainless clown loser failure worthless pathetic
    useless pitiful disgusting trash garbage scum filth filthy vermin scumbag lowlife degenerate parasite coward
    liar creep pig rat freak bastard bitch asshole crap bullshit fuck fucking shit damn hate despise
    dummkopf vollidiot trottel depp schwachkopf versager abschaum dreckig erbärmlich widerlich wertlos arschloch scheiße
    imbécile crétin abruti débile connard salaud ordure minable dégoûtant pathétique raté merde
    imbécil estúpido tonto basura escoria patético asqueroso inútil payaso perdedor mierda cabrón
    """.split()
)
PATTERNS = ("shouting", "urging", "you_are", "sentences", "list_or_table", "long_text")


@dataclass
class Voters:
    """The lexicon and the mined prefixes as sorted hashes with their columns, for tasks."""

    lexicon: np.ndarray
    prefixes: dict[int, np.ndarray]

    @property
    def mined(self) -> int:
        return sum(map(len, self.prefixes.values()))

    @property
    def terms(self) -> int:
        """Voters that speak for toxicity if for anything; the patterns come after them."""
        return len(self.lexicon) + 3 * (self.mined + 1)

    @property
    def count(self) -> int:
        return self.terms + len(PATTERNS)

    def nested(self) -> np.ndarray:
        """Pairs of voters of which one implies the other: rates of one prefix, and the prefixes together with each."""
        m, step, first = self.count, self.mined + 1, len(self.lexicon)
        pairs = np.zeros((m, m), bool)
        which = np.arange(3 * step) % step
        together = which == self.mined
        same = (which[:, None] == which[None, :]) | together[:, None] | together[None, :]
        pairs[first : self.terms, first : self.terms] = same
        return pairs & ~np.eye(m, dtype=bool)


def prefix_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first ``size`` characters of all words that are longer, and which words those are."""
    data = words.texts.data
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    at = np.searchsorted(lead, words.starts) + size
    longer = at < len(lead)
    ends = lead[np.minimum(at, len(lead) - 1)] if len(lead) else at
    longer &= ends < words.ends
    return words.texts.span_hashes(words.starts[longer], ends[longer], lower=True), np.flatnonzero(longer)


def _found(table_: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which ``hashes`` are in ``table_``, and the place in it of those."""
    if not len(table_) or not len(hashes):
        return np.zeros(len(hashes), bool), np.zeros(0, np.int64)
    rank = np.argsort(table_)
    at = np.minimum(np.searchsorted(table_[rank], hashes), len(table_) - 1)
    hit = table_[rank][at] == hashes
    return hit, rank[at[hit]]


def votes_of(texts: Texts, voters: Voters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Votes (texts x voters, 0 or 1), and the distinct lower-case letter runs of each text: owners and hashes.

    A voter fires or abstains. Each lexicon word fires where it occurs; each prefix, and all of them together, fire at
    three rates of words that begin so. What a vote means, also of the patterns, which may speak
    for either side, is left to the label model.
    """
    words = texts.words(letters=True)
    n_words = np.maximum(words.counts(), 1)
    order = np.lexsort((words.hashes, words.owner))
    hashes, owner = words.hashes[order], words.owner[order]
    if len(hashes):
        fresh = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])
        hashes, owner = hashes[fresh], owner[fresh]
    votes = np.zeros((len(texts), voters.count), np.uint8)
    hit, column = _found(voters.lexicon, hashes)
    votes[owner[hit], column] = 1

    begun = np.zeros((len(texts), voters.mined + 1), np.int64)
    base = 0
    for size, mined in voters.prefixes.items():
        starts, of = prefix_hashes(words, size)
        hit, column = _found(mined, starts)
        np.add.at(begun, (words.owner[of[hit]], base + column), 1)
        base += len(mined)
    begun[:, -1] = begun[:, :-1].sum(axis=1)
    seldom, often = begun * 250 > n_words[:, None], begun * 90 > n_words[:, None]
    votes[:, len(voters.lexicon) : voters.terms] = np.hstack([seldom, seldom & (begun > 1), often & (begun > 1)])

    data, sizes = texts.data, np.maximum(np.diff(texts.bounds), 1)
    count = lambda b: texts.totals(data == b)
    capitals = texts.totals((data >= 65) & (data <= 90))
    pairs = np.zeros(len(texts), np.int64)
    you, are = hashes_of(["you", "are"])
    follows = np.flatnonzero((words.hashes[:-1] == you) & (words.hashes[1:] == are) & (words.owner[:-1] == words.owner[1:]))
    np.add.at(pairs, words.owner[follows], 1)
    shown = (
        capitals * 3 > sizes,
        count(0x21) * 100 > sizes,
        pairs > 0,
        count(0x2E) * 40 > sizes,
        count(0x7C) * 100 > sizes,
        sizes > 4000,
    )
    votes[:, voters.terms :] = np.stack(shown, axis=1)
    return votes, owner, hashes


def mine_prefixes(labelled: DataFrame, text: str, label: str) -> Voters:
    """Voters with the beginnings of words that labelled toxic texts have more often than others, beyond chance.

    ``labelled`` should be bounded. Counts per prefix are summed by Spark; the driver sees the best only.
    Of two prefixes of which one begins the other, the better one is taken.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.asarray(batch.column(1).cast(pa.int8()).fill_null(0))
            for at, texts in passes(batch.column(0)):
                words, labels = texts.words(letters=True), toxic[at : at + len(texts)]
                n_words = np.maximum(words.counts(), 1)
                parent = np.zeros(len(words.starts), np.uint64)
                for size in PREFIX_LENGTHS:
                    hashes, of = prefix_hashes(words, size)
                    if not len(hashes):
                        continue
                    order = np.lexsort((hashes, words.owner[of]))
                    keys, own = hashes[order], words.owner[of][order]
                    starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])]))
                    times = np.diff(np.append(starts, len(keys)))
                    enough = starts[times * 250 > n_words[own[starts]]]
                    is_toxic = labels[own[enough]].astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(enough), size), pa.int32()),
                            pa.array(keys[enough].view(np.int64)),
                            pa.array(parent[of][order][enough].view(np.int64)),
                            pa.array(is_toxic),
                            pa.array(1 - is_toxic),
                        ],
                        names=["size", "prefix", "parent", "toxic", "clean"],
                    )
                    parent = np.zeros(len(words.starts), np.uint64)
                    parent[of] = hashes

    sums = labelled.agg(F.sum(F.col(label).cast("long")), F.count("*")).first()
    n_toxic, n_clean = max(sums[0] or 0, 1), max((sums[1] or 0) - (sums[0] or 0), 1)
    share = (F.col("toxic") + F.col("clean")) / F.lit(n_toxic + n_clean)
    score = (F.col("toxic") / n_toxic - F.col("clean") / n_clean) / F.sqrt(
        F.greatest(share * (1 - share), F.lit(1e-4)) * F.lit(1 / n_toxic + 1 / n_clean)
    )
    best = (
        labelled.select(text, F.col(label).cast("int").alias("label"))
        .mapInArrow(tally, "size int, prefix long, parent long, toxic long, clean long")
        .groupBy("size", "prefix")
        .agg(F.max("parent").alias("parent"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where(F.col("toxic") >= F.lit(max(4, n_toxic // 100)))
        .withColumn("score", score)
        .where((F.col("score") > 6) & (F.col("toxic") / n_toxic > 8 * F.col("clean") / n_clean))
        .orderBy(F.col("score").desc(), F.col("size").desc(), "prefix")
        .limit(8 * PREFIXES)
        .collect()
    )
    parents, taken, begun = {r.prefix: r.parent for r in best}, [], set()
    for r in best:
        line, up = [r.prefix], r.parent
        while up:
            line, up = [*line, up], parents.get(up, 0)
        if len(taken) < PREFIXES and r.prefix not in begun and not any(p == t.prefix for p in line for t in taken):
            taken.append(r)
            begun.update(line)
    best = taken
    prefixes = {n: np.array([r.prefix for r in best if r["size"] == n], np.int64).view(np.uint64) for n in PREFIX_LENGTHS}
    return Voters(hashes_of(list(LEXICON)), prefixes)


@dataclass
class LabelModel:
    """``weights`` and ``bias`` give a text's log odds from its votes; ``dependent`` marks pairs of correlated voters."""

    hits: np.ndarray
    misses: np.ndarray
    dependent: np.ndarray
    weights: np.ndarray
    bias: float


def moments(df: DataFrame, text: str, voters: Voters) -> tuple[int, np.ndarray]:
    """Number of texts, and for each pair of voters the number of texts that both vote on. One pass over all texts."""
    m = voters.count

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((m, m), np.int64)
        rows = 0
        for batch in batches:
            for _, texts in passes(batch.column(0)):
                votes = votes_of(texts, voters)[0].astype(np.float32)
                both += (votes.T @ votes).astype(np.int64)
                rows += len(texts)
        i, j = np.nonzero(np.triu(both))
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *i], pa.int32()), pa.array([-1, *j], pa.int32()), pa.array([rows, *both[i, j]], pa.int64())],
            names=["i", "j", "n"],
        )

    pairs = df.select(text).mapInArrow(tally, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    both, rows = np.zeros((m, m)), 0
    for i, j, n in pairs.collect():  # at most a row for each pair of voters
        if i < 0:
            rows = n
        else:
            both[i, j] = both[j, i] = n
    return rows, both


def fit_label_model(rows: int, both: np.ndarray, voters: Voters, prior: float) -> LabelModel:
    """Accuracies and correlations of the voters from how often they vote together, without any label.

    Given the class, voters are taken as independent, so the correlation of two is the product of two factors, one of
    each; the factors are fitted to all pairs. Pairs that agree far more than that, and terms that exclude each
    other (of different languages, say), are dependent, as are nested voters and twins: they leave the fit, and votes
    that go together count less. With ``prior``, the share of toxic texts, a voter's factor and its frequency give how often it
    fires on either class. Silence is an abstention and says nothing.
    """
    m = len(both)
    rate = np.diag(both) / max(rows, 1)
    cov = both / max(rows, 1) - np.outer(rate, rate)
    spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-12))
    live = np.diag(both) >= 5
    use = np.outer(live, live) & ~np.eye(m, dtype=bool)
    corr = np.where(use, cov / np.outer(spread, spread), 0.0)
    noise = 1 / np.sqrt(max(rows, 1))
    term = np.arange(m) < voters.terms
    apart = use & np.outer(term, term) & (corr < 3 * noise)
    either = np.add.outer(np.diag(both), np.diag(both)) - both
    nested = use & (voters.nested() | (both > 0.8 * either))
    dependent = nested
    for _ in range(4):
        kept = (use & ~dependent & ~apart).astype(float)
        factor = np.where(live & term, 0.3, 0.0)
        for _ in range(200):
            factor = np.clip((kept * corr) @ factor / np.maximum(kept @ factor**2, 1e-9), -0.98, 0.98)
        residual = corr - np.outer(factor, factor)
        dependent = nested | (use & ~apart & (np.abs(residual) > max(0.3, 6 * noise)))
    gap = np.where(live, factor * spread / np.sqrt(prior * (1 - prior)), 0.0)
    low, high = 1e-4, 1 - 1e-4
    misses = np.clip(rate - prior * gap, low, high)
    hits = np.clip(misses + gap, low, high)
    share = 1 + (np.abs(corr) * dependent).sum(axis=1)
    weights = np.where(live, np.log(hits / misses) / share, 0.0)
    return LabelModel(hits, misses, dependent | apart, weights, float(np.log(prior / (1 - prior))))


@dataclass
class Classifier:
    """A linear score over the voters and over chosen words (sorted hashes)."""

    voters: np.ndarray
    words: np.ndarray
    word_weights: np.ndarray
    bias: float

    def score(self, votes: np.ndarray, owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        total = votes @ self.voters + self.bias
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            hit = self.words[at] == hashes
            total += np.bincount(owner[hit], weights=self.word_weights[at[hit]], minlength=len(total))
        return sigmoid(total)


def fit_classifier(
    df: DataFrame, text: str, identity: str, rows: int, voters: Voters, model: LabelModel, sample: int = SAMPLE_ROWS
) -> Classifier:
    """Fit to the label model's posteriors on about ``sample`` texts that a hash of identity and text picks."""
    share = min(1.0, sample / max(rows, 1))
    pick = drawn(share, SEED, F.col(identity), F.col(text))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in passes(batch.column(0)):
                votes, owner, hashes = votes_of(texts, voters)
                at = np.searchsorted(owner, np.arange(len(texts) + 1))
                words = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v.tobytes() for v in votes], pa.binary()), words], names=["votes", "words"]
                )

    chosen = df.where(pick).select(text) if share < 1 else df.select(text)
    found = chosen.mapInArrow(label, "votes binary, words array<bigint>").toArrow()
    m = voters.count
    votes = np.frombuffer(b"".join(found.column("votes").to_pylist()), np.uint8).reshape(-1, m)
    if rows and not len(votes):
        raise ValueError(f"none of {rows} texts is in the sample of about {sample}")
    lists = found.column("words").combine_chunks()
    hashes = np.asarray(lists.flatten()).view(np.uint64)
    owner = np.repeat(np.arange(len(votes)), np.asarray(lists.value_lengths()))
    soft = sigmoid(votes @ model.weights + model.bias)

    # Words that go with the posterior beyond chance, in enough texts.
    unique, slot = np.unique(hashes, return_inverse=True)
    n = np.bincount(slot, minlength=len(unique)).astype(float)
    toxic = np.bincount(slot, weights=soft[owner], minlength=len(unique))
    base = soft.mean() if len(soft) else 0.0
    z = (toxic - n * base) / np.sqrt(np.maximum(n * base * (1 - base), 1e-9))
    z[(n < 20) | np.isin(unique, voters.lexicon)] = 0
    best = np.argsort(-np.abs(z), kind="stable")[:WORD_FEATURES]
    best = np.sort(best[np.abs(z[best]) > 6])
    column = np.full(len(unique), -1)
    column[best] = np.arange(len(best))
    x = np.zeros((len(votes), m + len(best)), np.float32)
    x[:, :m] = votes
    hit = column[slot] >= 0
    x[owner[hit], m + column[slot][hit]] = 1
    # A lexicon word that the sample never shows still speaks for its class.
    centre = np.zeros(m + len(best))
    centre[: len(voters.lexicon)] = 3.0
    weights, bias = fit_logistic(x, soft, l2=2.0, centre=centre)
    return Classifier(weights[:m], unique[best], weights[m:], bias)


def toxicity_scores(
    df: DataFrame,
    labelled: DataFrame,
    text: str = "text",
    identity: str = "doc_id",
    label: str = "toxic",
    train: Column | None = None,
    sample: int = SAMPLE_ROWS,
) -> DataFrame:
    """``df`` with ``score``, 0 to 1: the classifier's probability that the text is toxic.

    ``labelled``: identity and 0/1 label of rows that may be learned from; about ``sample`` of them, picked by a
    hash, give the class balance, the mined prefixes and the final calibration. ``train``: which rows of ``df`` may
    train; default all. Votes of all training rows are counted in one pass; the classifier is fitted on about ``sample``
    of them; a last pass scores whole texts, without a shuffle.

    Null and empty texts get the score of a text without votes. A column ``score`` of ``df`` is replaced.
    Without labels the class balance is 0.1 and nothing is mined or calibrated. An empty table stays empty.
    """
    seen = df if train is None else df.where(train)
    picked, prior = labelled_texts(seen, labelled, text, identity, label, sample)
    voters = mine_prefixes(picked, "text", "label")
    rows, both = moments(seen, text, voters)
    model = fit_label_model(rows, both, voters, min(max(prior, 1e-3), 0.5))
    classifier = fit_classifier(seen, text, identity, rows, voters, model, sample)
    kept = [c for c in df.columns if c.lower() != "score"]
    slope, shift = calibrate(with_score(picked, "text", voters, classifier).select("label", "score"))
    out = with_score(df.select(*kept), text, voters, classifier)
    odds = F.ln(F.col("score") / (1 - F.col("score")))
    return out.withColumn("score", 1 / (1 + F.exp(-(F.lit(slope) * odds + F.lit(shift)))))


def with_score(df: DataFrame, text: str, voters: Voters, classifier: Classifier) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())])
    at = df.columns.index(text)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [classifier.score(*votes_of(texts, voters)) for _, texts in passes(batch.column(at))]
            column = np.clip(np.concatenate(scores) if scores else np.zeros(0), 1e-12, 1 - 1e-12)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(column)], names=schema.names)

    return df.mapInArrow(judge, schema)


def calibrate(scored: DataFrame) -> tuple[float, float]:
    """Slope and shift of the log odds that fit a bounded sample of labelled scores; (1, 0) without both labels."""
    rows = scored.toArrow()
    y, p = np.asarray(rows.column("label")).astype(float), np.asarray(rows.column("score"))
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    weights, bias = fit_logistic(np.log(p / (1 - p))[:, None], y, l2=1e-2, centre=np.ones(1), rounds=40)
    return (float(weights[0]), bias) if weights[0] > 0.1 else (1.0, 0.0)


def held_out(identity: Column) -> Column:
    return F.coalesce(F.crc32(identity.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return toxicity_scores(docs, labels, train=~held_out(F.col("doc_id")))


def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(spark, docs, sf_dir).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLE: dict[str, str] = {}
