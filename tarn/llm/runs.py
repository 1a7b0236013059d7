"""Periodic runs of words, by enumerating maximal pairs over an LCP-interval tree."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import free_name, table
from tarn.llm.words import Words, mix, passes

#: A run has at least so many words, and is at least so many periods long.
LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Words whose bytes are put side by side at a time.
BLOCK_WORDS = 1 << 17

RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def shared_words(least: int, periods: int) -> int:
    """The fewest words that two places one period apart in a run have in common."""
    return min(max(least - q, (periods - 1) * q) for q in range(1, least + 1))


def apart(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """``values`` such that equal ones of different texts differ."""
    return mix(values ^ mix(owner.astype(np.uint64) + np.uint64(1)))


def dense(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of equal keys, in the order of the keys, and how many there are."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    fresh = np.concatenate([[0], (ordered[1:] != ordered[:-1]).cumsum()])
    ranks = np.empty(len(keys), np.int32)
    ranks[order] = fresh
    return ranks, int(fresh[-1]) + 1 if len(keys) else 0


def suffix_order(symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of all texts in order, and how many words each shares with the one before it.

    Texts are ``symbols[bounds[k]:bounds[k + 1]]``; suffixes of different texts share nothing. Ranks of runs of 1, 2, 4 ...
    words come from those of half the length, until all differ; the ranks of every length then give the shared words.
    """
    n = len(symbols)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    room = bounds[1:][owner] - np.arange(n)
    ranks, found = dense(apart(symbols, owner))
    levels, size = [ranks], 1
    while found < n:
        second = np.zeros(n, np.int64)
        inside = np.flatnonzero(room > size)
        second[inside] = levels[-1][inside + size].astype(np.int64) + 1
        ranks, found = dense(levels[-1].astype(np.int64) * (n + 1) + second)
        levels.append(ranks)
        size *= 2
    order = np.argsort(levels[-1], kind="stable")
    common = np.zeros(n, np.int64)
    left, right = order[:-1], order[1:]
    for ranks in reversed(levels[:-1]):
        size //= 2
        # Equal ranks lie in one text, and neither run of words reaches beyond its end.
        padded = np.append(ranks, -1)
        same = padded[left + common[1:]] == padded[right + common[1:]]
        common[1:][same] += size
    return order, common


def blocks_of(keys: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``positions`` by ascending key, and where each block of one key begins (with the end)."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return positions[order], np.append(starts, len(keys))


def mixed(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which blocks have more than one value."""
    sizes = np.diff(starts)
    if not len(sizes):
        return np.zeros(0, bool)
    return np.add.reduceat(values != np.repeat(values[starts[:-1]], sizes), starts[:-1]) > 0


def maximal_pairs(places: list[int], common: list[int], left: dict[int, int], least: int, periods: int) -> Iterator[tuple[int, int, int]]:
    """Start, length and distance of the maximal pairs of one block whose distance a run allows.

    ``places`` are suffixes in order, ``common[k]`` the words that the k-th shares with the one before it, ``left`` the
    class of each place: the word before it. LCP intervals are closed bottom-up. Each holds the places below it in the order of the
    text, and their class if they have only one. Two places of different children share exactly as many words as the
    interval says, so they cannot be extended to the right; of different classes, they cannot to the left. Children of one and the
    same class are joined without a look.

    If two places lie within reach (the distance times ``periods - 1`` is at most the shared words) and a third one of the interval between
    them, then both distances are multiples of a shorter period. So the pair at a run's own period is one of
    neighbours, and neighbours are all that is compared: a child is merged into a larger one place by place.
    """
    reach = periods - 1

    def merge(depth: int, a: tuple[list[int], int | None], b: tuple[list[int], int | None]):
        (large, one), (small, other) = (a, b) if len(a[0]) >= len(b[0]) else (b, a)
        alike = one is not None and one == other
        if not alike:
            for p in small:
                at = bisect_left(large, p)
                for q in large[max(at - 1, 0) : at + 1]:
                    distance = abs(p - q)
                    if reach * distance <= depth and distance + depth >= least and left[p] != left[q]:
                        found.append((min(p, q), distance + depth, distance))
        if small[0] > large[-1]:
            large.extend(small)
        elif 8 * len(small) > len(large):
            large.extend(small)
            large.sort()
        else:
            for p in small:
                large.insert(bisect_left(large, p), p)
        return large, one if alike else None

    found: list[tuple[int, int, int]] = []
    node = [places[0]], left[places[0]]
    opened: list[tuple[int, tuple]] = []
    for place, depth in zip(places[1:], common[1:]):
        while opened and opened[-1][0] > depth:
            node = merge(*opened.pop(), node)
        if opened and opened[-1][0] == depth:
            node = merge(*opened.pop(), node)
        opened.append((depth, node))
        node = [place], left[place]
    while opened:
        node = merge(*opened.pop(), node)
    return iter(found)


def find_runs(symbols: np.ndarray, bounds: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> np.ndarray:
    """All runs of all texts as rows of text, start, length and period, in this order.

    Two words are equal if their 64-bit ``symbols`` are. A run shares words with itself one period on, so only texts in which
    a stretch of ``shared_words`` occurs twice, after different words, are put in suffix order, and only blocks of suffixes with
    that much in common, different words before them and two places within reach become trees.
    """
    shared = shared_words(least, periods)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    nothing = np.zeros((0, 4), np.int64)
    if len(symbols) < shared + 1:
        return nothing
    before = np.concatenate([[0], symbols[:-1]]).astype(np.uint64)
    before[bounds[:-1][np.diff(bounds) > 0]] = 0
    hashes, first = Words(None, None, None, owner, symbols, None).windows(shared)
    ordered, starts = blocks_of(apart(hashes, owner[first]), first)
    live = np.unique(owner[ordered[starts[:-1][mixed(before[ordered], starts)]]])
    if not len(live):
        return nothing

    sizes = np.diff(bounds)[live]
    inner = np.concatenate([[0], np.cumsum(sizes)])
    index = np.repeat(bounds[live] - inner[:-1], sizes) + np.arange(inner[-1])
    order, common = suffix_order(symbols[index], inner)
    class_of = before[index]
    deep = common >= shared
    block = np.cumsum(~deep) - 1
    many = np.bincount(block)
    starts = np.concatenate([[0], np.cumsum(many)])
    wanted = (many > 1) & mixed(class_of[order], starts)
    by_place = order[np.lexsort((order, block))]
    gaps = np.append(np.diff(by_place), np.iinfo(np.int64).max)
    gaps[starts[1:] - 1] = np.iinfo(np.int64).max
    nearest = np.minimum.reduceat(gaps, starts[:-1])
    deepest = np.maximum.reduceat(np.where(deep, common, 0), starts[:-1])
    wanted &= nearest <= deepest // (periods - 1)

    found: dict[tuple[int, int], int] = {}
    for k in np.flatnonzero(wanted):
        own = slice(starts[k], starts[k + 1])
        places = order[own].tolist()
        classes = dict(zip(places, class_of[order[own]].tolist()))
        for start, length, period in maximal_pairs(places, common[own].tolist(), classes, least, periods):
            # A run comes up at multiples of its period too.
            found[start, length] = min(period, found.get((start, length), period))
    if not found:
        return nothing
    rows = np.array([(s, n, q) for (s, n), q in found.items()], np.int64)
    text = np.searchsorted(inner[1:], rows[:, 0], side="right")
    rows = np.column_stack([live[text], rows[:, 0] - inner[text], rows[:, 1:]])
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def edited(counts: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """For each word the word that takes its place, as indices into the words of all texts.

    A text of n words whose number h is divisible by ten repeats its first p words from word a on, where g = h // 10, a = g % n and
    p = 1 + (n - a) // (3 + g % 8). Other texts stay.
    """
    index = np.arange(counts.sum())
    starts = np.cumsum(counts) - counts
    for k in np.flatnonzero((numbers >= 0) & (numbers % 10 == 0) & (counts > 0)):
        n, g = int(counts[k]), int(numbers[k]) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        index[starts[k] + a : starts[k] + n] = starts[k] + a + np.arange(n - a) % p
    return index


def joined(words: Words, index: np.ndarray, texts: np.ndarray, many: int) -> list[bytes]:
    """The words that ``index`` names, joined by one space, for each of ``many`` texts; ``texts`` says whose each is."""
    data = np.append(words.texts.data, np.uint8(0x20))
    parts, sizes = [], words.ends[index] - words.starts[index] + 1
    for at in range(0, len(index), BLOCK_WORDS):
        own = sizes[at : at + BLOCK_WORDS]
        ends = np.cumsum(own)
        out = data[np.repeat(words.starts[index[at : at + BLOCK_WORDS]] - ends + own, own) + np.arange(ends[-1])]
        out[ends - 1] = 0x20
        parts.append(out.tobytes())
    whole = b"".join(parts)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(texts, weights=sizes, minlength=many).astype(np.int64))]).tolist()
    return [whole[a : max(a, b - 1)] for a, b in zip(bounds, bounds[1:])]


def repeated(counts: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Which words lie in a run behind its first period."""
    starts = (np.cumsum(counts) - counts)[runs[:, 0]] + runs[:, 1]
    steps = np.zeros(counts.sum() + 1, np.int64)
    np.add.at(steps, starts + runs[:, 3], 1)
    np.add.at(steps, starts + runs[:, 2], -1)
    return steps.cumsum()[:-1] > 0


def periodic_runs(
    df: DataFrame, text: str = "text", edit: str | None = None, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS
) -> DataFrame:
    """``df`` without its text, with ``n_words``, ``runs`` (start, length, period) and ``collapsed``.

    Words are runs of characters other than ASCII white space, counted from 0, and equal if their bytes are. A run is a stretch of words with smallest
    period q (words q apart are identical) of at least ``least`` words and ``periods`` periods that no neighbouring word extends.
    ``runs`` has them all, by start, then period. ``collapsed`` is the text without the words that lie in any run behind its first q words, the
    others joined by one space. ``edit`` names a column of numbers by which texts are changed before (see ``edited``; a null changes nothing).

    Null, empty and blank texts have no words, no runs and an empty ``collapsed``. Columns of ``df`` named like results are left
    out; all other rows and columns stay, repeated ones too. Whole texts are read, a megabyte of them at a time and
    a longer text by itself, within tasks and without a shuffle.
    """
    names = ("n_words", "runs", "collapsed")
    body, number = free_name(df, "body"), free_name(df, "number")
    kept = [c for c in df.columns if c != text and c.lower() not in names]
    change = F.lit(-1) if edit is None else F.coalesce(F.col(edit), F.lit(-1))
    rows = df.select(*kept, F.col(text).cast("string").alias(body), change.cast("long").alias(number))
    own = rows.schema.fields[: len(kept)]
    schema = T.StructType([*own, T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    struct = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = np.asarray(batch.column(len(kept) + 1))
            for at, texts in passes(batch.column(len(kept))):
                many, words = len(texts), texts.words(lower=False)
                counts = words.counts()
                index = edited(counts, numbers[at : at + many])
                found = find_runs(words.hashes[index], np.concatenate([[0], np.cumsum(counts)]), least, periods)
                stays = ~repeated(counts, found)
                owner = np.repeat(np.arange(many), counts)
                collapsed = joined(words, index[stays], owner[stays], many)
                ends = np.concatenate([[0], np.cumsum(np.bincount(found[:, 0], minlength=many))])
                values = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in (1, 2, 3)], fields=list(struct))
                columns = [
                    pa.array(counts, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                ]
                part = batch.slice(at, many).select(list(range(len(kept))))
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=schema.names)

    return rows.mapInArrow(search, schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest length by period, the first of equals; null without any."""
    none = F.lit(None).cast(RUNS.elementType)
    more = lambda a, b: a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"])
    return F.aggregate(runs, none, lambda a, b: F.when(more(a, b), b).otherwise(a))


def op13_periodic_runs(spark, sf_dir):
    """Runs in all documents, one in ten of them with a repeated tail."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("number", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    found = periodic_runs(docs, edit="number").withColumn("best", strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
ORACLE: dict[str, str] = {}
