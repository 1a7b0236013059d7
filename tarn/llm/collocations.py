"""Phrase collocations, counted over a prefix-free parse of the corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import stage, table
from tarn.llm.words import Texts, Words, mix, passes
from tarn.operators.ranking import top_n_per_group

#: Candidates have two to so many words, and occur at least so often.
MOST_WORDS = 4
LEAST_COUNT = 30
#: Phrases per language.
TOP = 2000
#: A candidate goes if a longer one has at least so many percent of its occurrences.
COVERED_PERCENT = 80
SCALE = 2_000_000
#: One window of words in so many begins a chunk.
MODULUS = 16
#: A sieve has 2**SIEVE_BITS bits (8 MB), however many phrases are frequent.
SIEVE_BITS = 26
UNKNOWN = "und"

_BREAKS = np.zeros(256, bool)
_BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_INSIDE = ~_BREAKS
_INSIDE[[0x20, 0x09]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def pieces(texts: Texts) -> tuple[Words, np.ndarray]:
    """The lower-case words of texts, and where each piece (words between two breaks) begins, with the end."""
    low = Texts(_LOWER[texts.data], texts.bounds)
    inside = _INSIDE[low.data]
    edge = np.zeros(len(inside) + 1, bool)
    edge[low.bounds] = True
    before, after = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    owner = np.searchsorted(low.bounds[1:], starts, side="right")
    breaks = np.cumsum(_BREAKS[low.data])[starts]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (breaks[1:] != breaks[:-1]) | (owner[1:] != owner[:-1])
    words = Words(low, starts, ends, owner, low.span_hashes(starts, ends, lower=False), inside)
    return words, np.append(np.flatnonzero(fresh), len(starts))


def spans(words: Words, first: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """For each of ``first``, the run of ``sizes`` words from there, joined by one space."""
    ends = np.cumsum(sizes)
    index = np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
    lengths = words.ends[index] - words.starts[index] + 1
    last = ends - 1
    lengths[last] -= 1
    to = np.cumsum(lengths)
    total = int(to[-1]) if len(to) else 0
    at = np.repeat(words.starts[index] - to + lengths, lengths) + np.arange(total)
    out = words.texts.data[np.minimum(at, max(len(words.texts.data) - 1, 0))]
    spaces = np.delete(to, last) - 1
    out[spaces] = 0x20
    offsets = np.concatenate([[0], to[last]]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def parse(df: DataFrame, text: str, lang: str, overlap: int, modulus: int = MODULUS) -> DataFrame:
    """The dictionary of a prefix-free parse: distinct ``chunk`` by ``lang`` with ``times``, its frequency in the parse.

    A chunk begins with each piece, and with each window of ``overlap`` words in it whose hash is divisible by
    ``modulus``; it reaches to the end of the next chunk's first window. So where a text is cut depends on the words there alone, and passages
    that repeat give the same chunks wherever they stand. Each run of up to ``overlap + 1`` words begins in the first ``owned``
    words of just one chunk and lies in it whole: all words of the last chunk of a piece are owned, of others
    all but the overlap.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0)
            for at, texts in passes(batch.column(1)):
                words, bounds = pieces(texts)
                n = len(words.starts)
                piece = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                hashes, first = Words(None, None, None, piece, words.hashes, None).windows(overlap)
                cuts = np.zeros(n + 1, bool)
                cuts[first[hashes % np.uint64(modulus) == 0]] = True
                cuts[bounds] = True
                starts = np.flatnonzero(cuts)
                starts, following = starts[:-1], starts[1:]
                ends = np.minimum(following + overlap, bounds[1:][piece[starts]])
                whole = np.isin(following, bounds)
                ends[whole] = following[whole]
                yield pa.RecordBatch.from_arrays(
                    [
                        langs.take(pa.array(at + words.owner[starts])),
                        spans(words, starts, ends - starts),
                        pa.array(following - starts, pa.int32()),
                    ],
                    names=["lang", "chunk", "owned"],
                )

    rows = df.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("string").alias("text"))
    chunks = rows.mapInArrow(cut, "lang string, chunk string, owned int")
    return chunks.groupBy("lang", "chunk", "owned").agg(F.count("*").alias("times"))


class Sieve:
    """Which 64-bit keys may be frequent: one of ``marks``' bits for all keys that begin with the same bits."""

    def __init__(self, marks: np.ndarray):
        self.bits = marks
        self.unused = np.uint64(64 - (64 * len(marks) - 1).bit_length())

    def passed(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> self.unused
        return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def sieve_of(counts: DataFrame, least: int, size: int) -> Sieve:
    """The sieve of all ``key`` with ``n`` of at least ``least``: 2**size bits reach the driver at most, as longs."""
    at = F.shiftrightunsigned("key", 64 - size)
    marked = (
        counts.where(F.col("n") >= least)
        .groupBy(F.shiftright(at, 6).alias("slot"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - size}) & 63 as int))")).alias("bits"))
        .toArrow()
    )
    bits = np.zeros(1 << (size - 6), np.uint64)
    bits[np.asarray(marked.column("slot"))] = np.asarray(marked.column("bits")).view(np.uint64)
    return Sieve(bits)


class Grams:
    """The runs of words that the chunks of a batch own, by size: first words, keys (a hash of language and words)."""

    def __init__(self, texts: Texts, tongues: np.ndarray, owned: np.ndarray):
        self.words = texts.words(lower=False)
        owner = self.words.owner
        counts = self.words.counts()
        self.place = np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]
        self.owned, self.tongues = owned[owner], tongues[owner]

    def all(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Key and first word of every run, owned or not."""
        hashes, first = self.words.windows(size)
        return mix(hashes ^ self.tongues[first]), first

    def likely(self, size: int, sieves: list[Sieve]) -> tuple[np.ndarray, np.ndarray]:
        """Key and first word of the owned runs that pass: a frequent run passes its own sieve, or those of its parts."""
        keys, first = self.all(size)
        good = self.place[first] < self.owned[first]
        if size <= len(sieves):
            good &= sieves[size - 1].passed(keys)
        elif size > 1:
            shorter, begin = self.all(size - 1)
            passed = np.zeros(len(self.place), bool)
            passed[begin] = sieves[size - 2].passed(shorter)
            good &= passed[first] & passed[first + 1]
        return keys[good], first[good]


def grams_of(batch: pa.RecordBatch) -> Iterator[tuple[slice, Grams]]:
    """The runs of a batch of lang, chunk, owned, times; a pass at a time."""
    encoded = batch.column(0).dictionary_encode()
    digests = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in encoded.dictionary.to_pylist()]
    tongues = np.array(digests, np.uint64)[np.asarray(encoded.indices)]
    owned = np.asarray(batch.column(2)).astype(np.int64)
    for at, texts in passes(batch.column(1)):
        own = slice(at, at + len(texts))
        yield own, Grams(texts, tongues[own], owned[own])


def key_counts(chunks: DataFrame, size: int, sieves: list[Sieve]) -> DataFrame:
    """``key`` and ``n``, how often it occurs, of the runs of ``size`` words whose parts are frequent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times = np.asarray(batch.column(3))
            for own, grams in grams_of(batch):
                keys, first = grams.likely(size, sieves)
                order = np.argsort(keys)
                keys, n = keys[order], times[own][grams.words.owner[first[order]]]
                starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
                sums = np.add.reduceat(n, starts) if len(keys) else n
                yield pa.RecordBatch.from_arrays([pa.array(keys[starts].view(np.int64)), pa.array(sums, pa.int64())], names=["key", "n"])

    return chunks.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def phrase_counts(chunks: DataFrame, most: int, least: int, sieve_bits: int = SIEVE_BITS) -> DataFrame:
    """``lang``, ``size``, ``phrase`` and ``n`` of all runs of one to ``most`` words that occur at least ``least`` times.

    Size by size: a run can be frequent only if both its parts that are one word shorter are. Keys are counted first, and a
    sieve of the frequent ones, of fixed size, keeps the others out of the next round. Keys that fall together only let
    more through; what passes is counted by its words in the end, so counts are exact.
    """
    sieves: list[Sieve] = []
    for size in range(1, most):
        sieves.append(sieve_of(key_counts(chunks, size, sieves), least, sieve_bits))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, grams in grams_of(batch):
                part = batch.slice(own.start, own.stop - own.start)
                for size in range(1, most + 1):
                    _, first = grams.likely(size, sieves)
                    rows = pa.array(grams.words.owner[first])
                    found = pa.table(
                        {
                            "lang": part.column(0).take(rows),
                            "phrase": spans(grams.words, first, np.full(len(first), size)),
                            "n": part.column(3).take(rows),
                        }
                    )
                    sums = found.group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")])
                    columns = [sums.column(name).combine_chunks() for name in ("lang", "phrase", "n_sum")]
                    columns.insert(1, pa.array(np.full(len(sums), size), pa.int32()))
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "size", "phrase", "n"])

    spelled = chunks.mapInArrow(spell, "lang string, size int, phrase string, n long")
    return spelled.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _exact(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("decimal(20,0)")


def scored(counts: DataFrame) -> DataFrame:
    """All candidates with a, l, r and score: of their cuts in two the one with the lowest score, the first of equals."""
    parts = F.split("phrase", " ")
    candidates = counts.where("size > 1").withColumnRenamed("n", "a")
    cut = lambda k: F.struct(
        k.alias("k"),
        F.array_join(F.slice(parts, F.lit(1), k), " ").alias("head"),
        F.array_join(F.slice(parts, k + 1, F.size(parts)), " ").alias("tail"),
    )
    cuts = candidates.select("lang", "size", "phrase", "a", F.inline(F.transform(F.sequence(F.lit(1), F.col("size") - 1), cut)))
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    # Decimals: the product may pass 64 bits. Integer division of decimals gives a long.
    rows = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    rows = rows.withColumns({"top": _exact("a") * F.lit(SCALE).cast("decimal(7,0)"), "sides": _exact("l") + _exact("r")})
    best = F.min(F.struct(F.expr("top div sides").alias("score"), "k", "l", "r")).alias("best")
    return rows.groupBy("lang", "size", "phrase", "a").agg(best).select("lang", "size", "phrase", "a", "best.l", "best.r", "best.score")


def uncovered(candidates: DataFrame, percent: int) -> DataFrame:
    """Candidates whose words do not lie within a longer one that has ``percent`` of their occurrences or more."""
    parts = F.split("phrase", " ")
    size = F.col("size")
    inner = F.transform(
        F.sequence(F.lit(2), size - 1),
        lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(parts, i, n), " ")),
    )
    longer = candidates.where("size > 2").select("lang", "a", F.explode(F.array_distinct(F.flatten(inner))).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    covered = _exact("most") * F.lit(100) >= _exact("a") * F.lit(percent)
    return candidates.join(most, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False))).drop("most")


def collocations(
    df: DataFrame,
    text: str = "text",
    lang: str = "lang",
    most_words: int = MOST_WORDS,
    least_count: int = LEAST_COUNT,
    top: int = TOP,
    percent: int = COVERED_PERCENT,
    modulus: int = MODULUS,
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank (from 1), phrase, a, l, r, n and score.

    Texts, A to Z in lower case, are cut at ``.,;:!?`` and line ends into pieces, and these at blanks and tabs into words. ``n``:
    words of the language. A candidate is a phrase of 2 to ``most_words`` words that occurs a >= ``least_count`` times within
    pieces, overlaps included. Cut in two after its first k words, whose parts occur l and r times, it scores
    floor(2000000 a / (l + r)); its lowest cut counts, the smallest k of equals. Candidates within a longer one that occurs at least
    ``percent`` / 100 as often are dropped. Order: score, then a, descending, then phrase by its bytes.

    Occurrences are counted in the distinct chunks of a prefix-free parse, times their frequency (see ``parse``), so
    repeated rows and shared passages cost one chunk. Rows without a language belong to ``und``; null, empty and blank
    texts have no words; a language without candidates has no rows. Other columns are not read. Counts are exact at every size.
    """
    # Stored, as every round reads it.
    chunks = stage(parse(df, text, lang, most_words - 1, modulus))
    counts = stage(phrase_counts(chunks, most_words, least_count))
    totals = chunks.groupBy("lang").agg(F.sum(F.col("owned") * F.col("times")).alias("n"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # In two rounds, as all tasks may have candidates of one language.
    ranked = top_n_per_group(uncovered(scored(counts), percent), ["lang"], order, top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir):
    """The first 2000 phrases of each language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
),
worded AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces
),
places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM worded),
grams AS (
    SELECT lang, s AS size, array_to_string(ws[i:i + s - 1], ' ') AS phrase
    FROM places, (VALUES (1), (2), (3), (4)) v(s) WHERE i + s - 1 <= len(ws)
),
freq AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM freq WHERE size > 1),
cuts AS (
    SELECT c.*, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:size], ' ') AS tail
    FROM candidates c, (VALUES (1), (2), (3)) t(k) WHERE k < size
),
best AS (
    SELECT c.lang, c.size, c.phrase, c.a, h.f AS l, t.f AS r,
           CAST(CAST(2000000 AS HUGEINT) * c.a // (h.f + t.f) AS BIGINT) AS score
    FROM cuts c JOIN freq h ON h.lang = c.lang AND h.phrase = c.head JOIN freq t ON t.lang = c.lang AND t.phrase = c.tail
    QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1
),
covers AS (
    SELECT lang, array_to_string(ws[i:i + s - 1], ' ') AS phrase, max(a) AS most
    FROM candidates, (VALUES (2), (3)) v(s), (VALUES (1), (2), (3)) w(i) WHERE s < size AND i + s - 1 <= size GROUP BY ALL
),
ranked AS (
    SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
    FROM best b LEFT JOIN covers c ON b.lang = c.lang AND b.phrase = c.phrase WHERE most IS NULL OR 100 * most < 80 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

QUERIES = {"op12_collocations": op12_collocations}
ORACLE = {"op12_collocations": SQL}
