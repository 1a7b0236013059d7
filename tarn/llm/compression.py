"""Quality rules: compression bands of whole documents and fixed chunks, whatever script they are written in."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import free_name, stage, table
from tarn.llm.words import Texts, passes

#: Bytes of a chunk, and the largest share of a document's chunks that may lie outside their band; one alone never decides.
CHUNK_BYTES = 2048
MOST_ODD_CHUNKS = 1 / 3
#: Classes of length in an octave; rows that a class takes its statistics from if it can, and over how many classes on
#: each side it looks for them at least and at most; rows that the fixed bands count for.
STEPS, WANTED_ROWS, NEAR, FAR, BAND_ROWS = 16, 200, 4, 16, 20
#: Code points below this are ranked by a table, which is faster than sorting.
SMALL_POINTS = 0x3000
#: Spreads that a ratio may lie below and above the centre of its class. Names, keys and rare words push
#: honest texts up; nothing honest packs far better than its neighbours.
BELOW, ABOVE, CHUNK_BELOW, CHUNK_ABOVE = 4.5, 6.0, 4.0, 6.0
#: Width of the ratio bins that are counted, and the least spread.
BIN, LEAST_SPREAD = 1 / 2000, 0.002
WHOLE, FULL, REST = range(3)
LEVEL = 3
SYMBOLS = b"#*$%&|<>"
WINDOW = 3

# Documents of at least so many bytes, least ratio, greatest ratio. Short texts compress badly whatever
# they say, long ones better and better; a ratio below its band is repetition, one above it noise. These hold for every
# table; the limits that its own rows give (``learn_limits``) lie inside.
BANDS = (
    (0, 0.0, 99.0),
    (64, 0.40, 1.45),
    (128, 0.34, 1.20),
    (256, 0.30, 1.05),
    (512, 0.27, 0.95),
    (1024, 0.25, 0.90),
    (4096, 0.22, 0.85),
    (16384, 0.18, 0.82),
    (65536, 0.15, 0.80),
)

FIELDS = (
    ("n_words", T.LongType()),
    ("word_chars", T.LongType()),
    ("n_symbols", T.LongType()),
    ("n_dup_lines", T.LongType()),
    ("n_repeat_words", T.LongType()),
    ("ratio", T.DoubleType()),
    ("odd_chunks", T.DoubleType()),
    ("base_failed", T.BooleanType()),
    ("kept", T.BooleanType()),
)


def band(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest ratio of the fixed bands for numbers of bytes."""
    limits = np.array(BANDS)
    row = np.searchsorted(limits[:, 0], sizes, side="right") - 1
    return limits[row, 1], limits[row, 2]


def in_band(sizes: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Whether each ratio lies in the band for its number of bytes."""
    low, high = band(sizes)
    return (ratios >= low) & (ratios <= high)


def own_alphabet(points: np.ndarray) -> bytes:
    """Code points as numbers of the text's own alphabet, one byte each, or two where it has more than 256 letters.

    How many bytes UTF-8 gives to a letter says nothing about a text; a text written in other letters, one for one, gives the same
    bytes up to the order of its alphabet.
    """
    most = int(points.max(initial=0))
    if most < SMALL_POINTS:
        used = np.zeros(most + 1, bool)
        used[points] = True
        ranks, letters = (np.cumsum(used) - 1)[points], int(used.sum())
    else:
        alphabet, ranks = np.unique(points, return_inverse=True)
        letters = len(alphabet)
    return ranks.astype("u1" if letters <= 256 else "<u2" if letters <= 1 << 16 else "<u4").tobytes()


def repeats(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once in their text, and which have occurred before in it."""
    order = np.lexsort((keys, owner))
    same = (keys[order][1:] == keys[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    again, first = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:]] = same  # lexsort is stable: the earliest comes first
    first[order[:-1]] = same
    return again | first, again


def base_counts(texts: Texts) -> dict[str, np.ndarray]:
    """Counts of words, of code points in words, of symbols, of repeated lines, and of words in repeated windows."""
    words = texts.words(lower=False)
    lead = (texts.data & 0xC0) != 0x80
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    hashes, first = words.windows(WINDOW)
    twice, _ = repeats(hashes, words.owner[first])
    covered = np.zeros(len(words.hashes), bool)
    for k in range(WINDOW):
        covered[first[twice] + k] = True

    # A line lies between line breaks or ends of its text.
    breaks = np.flatnonzero(texts.data == 0x0A)
    starts = np.sort(np.concatenate([texts.bounds[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([texts.bounds[1:], breaks]), kind="stable")
    filled = np.zeros(len(words.inside) + 1, np.int64)
    np.cumsum(words.inside, out=filled[1:])
    kept = (ends > starts) & (filled[ends] > filled[starts])
    starts, ends = starts[kept], ends[kept]
    line_owner = np.searchsorted(texts.bounds[1:], starts, side="right")
    _, again = repeats(texts.span_hashes(starts, ends, lower=False), line_owner)
    return {
        "n_words": words.counts(),
        "word_chars": texts.totals(lead & words.inside),
        "n_symbols": texts.totals(symbol[texts.data]),
        "n_dup_lines": np.bincount(line_owner[again], minlength=len(texts)),
        "n_repeat_words": np.bincount(words.owner[covered], minlength=len(texts)),
    }


def compression(texts: Texts, compressor: zstandard.ZstdCompressor) -> tuple[np.ndarray, np.ndarray, list[list[float]]]:
    """Sizes in bytes, ratios of whole texts, and the ratios of the chunks of each text that is longer than one.

    All of texts in their own alphabets (see ``own_alphabet``).
    """
    points = np.frombuffer(texts.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum((texts.data & 0xC0) != 0x80, out=lead[1:])
    bounds = lead[texts.bounds].tolist()
    sizes, ratios, chunks = np.zeros(len(texts), np.int64), np.zeros(len(texts)), []
    for i, (start, end) in enumerate(zip(bounds, bounds[1:])):
        parts = []
        view = memoryview(own_alphabet(points[start:end]))
        size = sizes[i] = len(view)
        if size:
            ratios[i] = len(compressor.compress(view)) / size
        if size > CHUNK_BYTES:
            cuts = [(a, min(a + CHUNK_BYTES, size)) for a in range(0, size, CHUNK_BYTES)]
            parts = [len(compressor.compress(view[a:b])) / (b - a) for a, b in cuts]
        chunks.append(parts)
    return sizes, ratios, chunks


@dataclass
class Limits:
    """Least and greatest ratio by class of length, as far as rows have about that length."""

    classes: np.ndarray
    least: np.ndarray
    greatest: np.ndarray

    def inside(self, sizes: np.ndarray, ratios: np.ndarray) -> np.ndarray:
        """Whether each ratio lies in the fixed band and, where rows have its length, in their limits."""
        good = in_band(sizes, ratios)
        if len(self.classes) and len(sizes):
            at = np.log2(np.maximum(sizes, 1)) * STEPS
            known = (at >= self.classes[0]) & (at < self.classes[-1] + 1)
            low, high = (np.interp(at - 0.5, self.classes, x) for x in (self.least, self.greatest))
            good &= ~known | ((ratios >= low) & (ratios <= high))
        return good


def _quantiles(values: np.ndarray, weights: np.ndarray, *shares: float) -> np.ndarray:
    order = np.argsort(values, kind="stable")
    passed = np.cumsum(weights[order])
    at = np.searchsorted(passed, np.array(shares) * passed[-1])
    return values[order][np.minimum(at, len(values) - 1)]


def fit_limits(classes: np.ndarray, ratios: np.ndarray, counts: np.ndarray, below: float, above: float) -> Limits:
    """Limits from the number of rows by class and ratio.

    A class looks at its neighbours until it sees enough rows, and takes out how the ratio falls with length there (a line
    through the medians of the shorter and of the longer half). Centre and spread are the median and the quartile
    range of what is left, so a quarter of the rows may be junk without moving them far. These limits and those of the fixed band are
    averaged, the band counting like ``BAND_ROWS`` rows: with few rows the band decides, with many they do.
    """
    order = np.argsort(classes, kind="stable")
    classes, ratios, counts = classes[order], ratios[order], counts[order]
    found = []
    for k in np.unique(classes).tolist():
        for reach in range(NEAR, FAR + 1):
            near = slice(*np.searchsorted(classes, [k - reach, k + reach + 1]))
            if counts[near].sum() >= WANTED_ROWS:
                break
        x, y, n = classes[near] - k, ratios[near], counts[near]
        shorter = x <= _quantiles(x, n, 0.5)[0]
        slope = 0.0
        if not shorter.all():
            x0, x1 = (np.average(x[half], weights=n[half]) for half in (shorter, ~shorter))
            y0, y1 = (_quantiles(y[half], n[half], 0.5)[0] for half in (shorter, ~shorter))
            slope = min(0.0, (y1 - y0) / (x1 - x0))
        low, centre, high = _quantiles(y - slope * x, n, 0.25, 0.5, 0.75)
        spread = max((high - low) / 1.349, LEAST_SPREAD)
        share = n.sum() / (n.sum() + BAND_ROWS)
        least, greatest = (float(v) for v in band(np.array(2.0 ** ((k + 0.5) / STEPS))))
        found.append((k, share * (centre - below * spread) + (1 - share) * least, share * (centre + above * spread) + (1 - share) * greatest))
    table_ = np.array(found, float).reshape(-1, 3)
    return Limits(table_[:, 0], table_[:, 1], table_[:, 2])


def learn_limits(measured: DataFrame, digest: str, size: str, chunks: str) -> list[Limits]:
    """Limits of whole texts, of chunks of full length and of last chunks, from all rows that pass the base rules.

    Equal texts count once. The driver sees a count for each class of length and bin of ratios.
    """
    full = F.floor(F.col(size) / CHUNK_BYTES)
    part = lambda kind, n, r: F.struct(F.lit(kind).alias("kind"), n.cast("long").alias("n"), r.alias("ratio"))
    parts = F.transform(
        F.col(chunks),
        lambda r, i: F.when(i < full, part(FULL, F.lit(CHUNK_BYTES), r)).otherwise(part(REST, F.col(size) % CHUNK_BYTES, r)),
    )
    texts = measured.where(~F.col("base_failed")).select(digest, size, "ratio", chunks).distinct()
    counts = (
        texts.select(F.inline(F.concat(F.array(part(WHOLE, F.col(size), F.col("ratio"))), parts)))
        .groupBy("kind", F.floor(F.log2("n") * STEPS).alias("class"), F.floor(F.col("ratio") / BIN).alias("bin"))
        .agg(F.count("*").alias("n"))
        .collect()
    )
    rows = np.array([tuple(r) for r in counts], np.int64).reshape(-1, 4)
    kinds = [rows[rows[:, 0] == kind] for kind in (WHOLE, FULL, REST)]
    spreads = ((BELOW, ABOVE), (CHUNK_BELOW, CHUNK_ABOVE), (CHUNK_BELOW, CHUNK_ABOVE))
    return [fit_limits(k[:, 1], (k[:, 2] + 0.5) * BIN, k[:, 3], *s) for k, s in zip(kinds, spreads)]


def odd_chunks(sizes: np.ndarray, chunks: pa.Array, limits: list[Limits]) -> tuple[np.ndarray, np.ndarray]:
    """For each text, how many of its chunks lie outside their limits, and how many it has."""
    ratios, many = np.asarray(chunks.flatten()), np.asarray(chunks.value_lengths()).astype(np.int64)
    owner = np.repeat(np.arange(len(many)), many)
    place = np.arange(len(ratios)) - np.repeat(np.cumsum(many) - many, many)
    lengths = np.minimum(sizes[owner] - place * CHUNK_BYTES, CHUNK_BYTES)
    odd = np.where(lengths == CHUNK_BYTES, ~limits[FULL].inside(lengths, ratios), ~limits[REST].inside(lengths, ratios))
    return np.bincount(owner[odd], minlength=len(many)), many


def quality_rules(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without its text, with the counts of ``base_counts``, both compression figures, and the verdict.

    ``base_failed``: fewer than 50 words, or more than half of the words in windows of three that occur twice
    or more. ``kept``: not so, and the zstandard ratio of the whole text and of enough of its chunks of
    ``CHUNK_BYTES`` bytes lie within the limits for their length: the fixed bands, and what the ratios of all rows
    say (see ``learn_limits``). Null and empty texts have no words and are not kept. Columns of ``df`` with the names
    of results are left out. Texts are read once; their figures are stored, and judged in a second pass.
    """
    names = [n for n, _ in FIELDS]
    keep = [c for c in df.columns if c != text and c.lower() not in names]
    body, size, digest, chunks = (free_name(df, n) for n in ("body", "size", "digest", "chunks"))
    rows = df.select(*keep, F.col(text).cast("string").alias(body))
    own = [f for f in rows.schema.fields if f.name != body]
    schema = T.StructType(own + [T.StructField(n, t) for n, t in FIELDS])
    first = [T.StructField(n, t) for n, t in FIELDS if n not in ("odd_chunks", "kept")]
    inner = [(size, T.LongType()), (digest, T.LongType()), (chunks, T.ArrayType(T.DoubleType()))]
    figures = T.StructType(own + first + [T.StructField(n, t) for n, t in inner])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for at, texts in passes(batch.column(body)):
                found = base_counts(texts)
                sizes, ratios, packed = compression(texts, compressor)
                n, repeated = found["n_words"], found["n_repeat_words"]
                found |= {"ratio": ratios, "base_failed": (n < 50) | (100 * repeated > 50 * n)}
                hashes = texts.span_hashes(texts.bounds[:-1], texts.bounds[1:], lower=False)
                columns = [pa.array(found[f.name]) for f in first]
                columns += [pa.array(sizes, pa.int64()), pa.array(hashes.view(np.int64)), pa.array(packed, pa.list_(pa.float64()))]
                part = batch.slice(at, len(texts)).select([f.name for f in own])
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=figures.names)

    measured = stage(rows.mapInArrow(measure, figures))
    limits = learn_limits(measured, digest, size, chunks)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column(size))
            odd, many = odd_chunks(sizes, batch.column(chunks), limits)
            share = odd / np.maximum(many, 1)
            good = ~np.asarray(batch.column("base_failed").to_numpy(zero_copy_only=False))
            good &= limits[WHOLE].inside(sizes, np.asarray(batch.column("ratio")))
            good &= (share <= MOST_ODD_CHUNKS) | (odd < 2)
            found = {"odd_chunks": pa.array(share, pa.float64()), "kept": pa.array(good)}
            columns = [found[f.name] if f.name in found else batch.column(f.name) for f in schema.fields]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return measured.mapInArrow(judge, schema)


def op10_compression_bands(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


QUERIES = {"op10_compression_bands": op10_compression_bands}
ORACLE: dict[str, str] = {}
