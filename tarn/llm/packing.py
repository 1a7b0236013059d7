"""Packing token sequences into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import functools
import heapq
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import free_name, stage, table
from tarn.llm.words import Texts, Words, passes

WINDOW = 4096
#: What is left of a document after whole windows is cut into pieces of at most so many tokens.
PIECE = 1024
#: Windows that one differencing balances.
BATCH_WINDOWS = 128
END_ID = 2
#: Words that a worker process remembers the tokens of, at about 40 bytes each.
CACHE_WORDS = 700_000

#: ASCII punctuation without the apostrophe: the tokenizer cuts it off a word's letters.
_MARKS = np.isin(np.arange(256), np.frombuffer(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8))
_LETTERS = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])


class WordTokens:
    """Token ids of words, as one array, with the 64-bit hashes of the words in order to find them.

    The tokenizer never joins words across ASCII white space, lowers case and cuts punctuation off. So each distinct word
    of a pass is looked up, then its lower-case letters, and only what is new is encoded. Beyond ``CACHE_WORDS`` words the half
    that was used last stays.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # Tasks share the cores already.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.hashes, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.used, self.ids, self.turn = np.zeros(0, np.int32), np.zeros(0, "<u4"), 0

    def _store(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encode words; where the ids of each begin, and how many there are."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int32, len(found))
        starts = len(self.ids) + np.cumsum(sizes, dtype=np.int64) - sizes
        self.ids = np.concatenate([self.ids, np.array([i for ids in found for i in ids], "<u4")])
        return starts, sizes

    def _add(self, hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.starts = np.insert(self.hashes, at, hashes), np.insert(self.starts, at, starts)
        self.sizes, self.used = np.insert(self.sizes, at, sizes), np.insert(self.used, at, self.turn)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each word, -1 for a new one."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def _learn(self, words: Words, fresh: np.ndarray, hashes: np.ndarray) -> None:
        """Add the words number ``fresh``, whose hashes are ``hashes``, in their order.

        A word of plain letters, with or without punctuation behind it, has the ids of its lower-case letters and of its punctuation.
        Beyond Latin letters lower case may depend on neighbours, so other words are encoded as they are.
        """
        texts, starts, ends = words.texts, words.starts[fresh], words.ends[fresh]
        data, bare = texts.data, ends.copy()
        while (trailing := (bare > starts) & _MARKS[data[bare - 1]]).any():
            bare -= trailing
        odd = np.zeros(len(data) + 1, np.int64)
        np.cumsum(~_plain(data), out=odd[1:])
        plain = (bare > starts) & (odd[bare] == odd[starts])
        begin, size = np.zeros(len(fresh), np.int64), np.zeros(len(fresh), np.int32)
        spelled = lambda a, b: [data[i:j].tobytes().decode() for i, j in zip(a.tolist(), b.tolist())]
        begin[~plain], size[~plain] = self._store(spelled(starts[~plain], ends[~plain]))

        cores = texts.span_hashes(starts[plain], bare[plain], lower=True)
        distinct, first, which = np.unique(cores, return_index=True, return_inverse=True)
        new = self._find(distinct) < 0
        at = np.flatnonzero(plain)[first[new]]
        own = self._store([w.lower() for w in spelled(starts[at], bare[at])])
        self._add(distinct[new], *own)
        place = self._find(distinct)[which]
        begin[plain], size[plain] = self.starts[place], self.sizes[place]

        both = np.flatnonzero(plain & (bare < ends))
        marks, first, which = np.unique(texts.span_hashes(bare[both], ends[both], lower=False), return_index=True, return_inverse=True)
        mark_begin, mark_size = self._store(spelled(bare[both][first], ends[both][first]))
        pairs = np.stack([begin[both], mark_begin[which]], axis=1).ravel(), np.stack([size[both], mark_size[which]], axis=1).ravel()
        size[both] += mark_size[which]
        begin[both] = len(self.ids) + np.cumsum(size[both], dtype=np.int64) - size[both]
        self.ids = np.concatenate([self.ids, self.ids[_ranges(*pairs)]])
        unknown = self._find(hashes) < 0
        self._add(hashes[unknown], begin[unknown], size[unknown])

    def _forget(self) -> None:
        stays = self.used > np.median(self.used)
        sizes = self.sizes[stays]
        self.ids = self.ids[_ranges(self.starts[stays], sizes)]
        self.hashes, self.used, self.sizes = self.hashes[stays], self.used[stays], sizes
        self.starts = np.cumsum(sizes, dtype=np.int64) - sizes

    def encode_all(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts side by side, and where each text's begin, with the end."""
        self.turn += 1
        words = texts.words(lower=False)
        distinct, first, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        new = self._find(distinct) < 0
        if new.any():
            self._learn(words, first[new], distinct[new])
        at = self._find(distinct)
        self.used[at] = self.turn
        place = at[which]
        sizes = self.sizes[place]
        ids = self.ids[_ranges(self.starts[place], sizes)]
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.bincount(words.owner, weights=sizes, minlength=len(texts)).astype(np.int64), out=bounds[1:])
        if len(self.hashes) > CACHE_WORDS:
            self._forget()
        return ids, bounds

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        return b"".join(self.encode_all(part)[0].tobytes() for _, part in passes(pa.array([text], pa.string())))


def _plain(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to ASCII letters or to the letters from À to ÿ."""
    latin = np.zeros(len(data) + 1, bool)
    latin[:-2] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    out = _LETTERS[data] | latin[:-1]
    out[1:] |= latin[:-2]
    return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``sizes`` of them, side by side."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


@functools.cache
def word_tokens(path: str) -> WordTokens:
    """One per worker process: what a task has looked up serves the next one."""
    return WordTokens(path)


def cuts(tokens: int, window: int, piece: int) -> Iterator[tuple[int, int]]:
    """Start and length of a document's pieces: whole windows, then pieces of at most ``piece``."""
    whole = tokens - tokens % window
    for start in range(0, whole, window):
        yield start, window
    for start in range(whole, tokens, piece):
        yield start, min(piece, tokens - start)


def differencing(sizes: np.ndarray, ways: int) -> np.ndarray:
    """Near-equal partition of items into ``ways`` parts; returns each item's part.

    Karmarkar and Karp: a partial partition starts as one item and empty parts. Again and again the two with the
    greatest imbalance merge, the largest parts of one joined with the smallest parts of the other.
    """
    start = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(start)
    first = np.zeros(ways, np.int64)
    partial: dict[int, tuple[np.ndarray, list[list[int]]]] = {}

    def opened(i: int) -> tuple[np.ndarray, list[list[int]]]:
        if i in partial:
            return partial.pop(i)
        sums = first.copy()
        sums[0] = sizes[i]
        return sums, [[i], *[[] for _ in range(ways - 1)]]

    following = len(sizes)
    while len(start) > 1:
        (_, a), (_, b) = heapq.heappop(start), heapq.heappop(start)
        (left, left_items), (right, right_items) = opened(a), opened(b)
        sums = left + right[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        right_items.reverse()
        partial[following] = sums, [left_items[k] + right_items[k] for k in order.tolist()]
        heapq.heappush(start, (-int(sums[0] - sums[-1]), following))
        following += 1
    part = np.zeros(len(sizes), np.int64)
    if start:
        for k, items in enumerate(opened(start[0][1])[1]):
            part[items] = k
    return part


def windows_for(sizes: np.ndarray, window: int) -> np.ndarray:
    """Each item's window: as few as the sum allows, and one more whenever a window would overflow."""
    ways = max(1, -(-int(sizes.sum()) // window))
    while True:
        part = differencing(sizes, ways)
        if np.bincount(part, weights=sizes, minlength=ways).max() <= window:
            return part
        ways += 1


def cut_documents(
    df: DataFrame, tokenizer: str, text: str = "text", window: int = WINDOW, piece: int = PIECE, end_id: int = END_ID, ids: bool = True
) -> DataFrame:
    """Pieces of tokenized documents: all columns but the text, and start, length, ids_crc32, doc_tokens and, if asked, ids."""
    body = free_name(df, "body")
    names = ("start", "length", "ids_crc32", "doc_tokens", "ids")
    rows = df.select(*[c for c in df.columns if c != text and c.lower() not in names], F.coalesce(F.col(text), F.lit("")).alias(body))
    added = [T.StructField(n, T.LongType()) for n in names[:4]] + [T.StructField("ids", T.BinaryType())] * ids
    keeps_ids = ids
    schema = T.StructType([*rows.schema.fields[:-1], *added])
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(tokenizer)
        for batch in batches:
            for at, texts in passes(batch.column(batch.num_columns - 1)):
                part = batch.slice(at, len(texts))
                ids, bounds = words.encode_all(texts)
                row, found = [], ([], [], [], [], [])
                for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
                    packed = ids[a:b].tobytes() + end
                    for start, length in cuts(len(packed) // 4, window, piece):
                        own = packed[4 * start : 4 * (start + length)]
                        row.append(i)
                        for column, value in zip(found, (start, length, zlib.crc32(own), len(packed) // 4, own)):
                            column.append(value)
                kept = part.select(list(range(part.num_columns - 1))).take(pa.array(row, pa.int64()))
                columns = [pa.array(c, pa.int64()) for c in found[:4]] + [pa.array(found[4], pa.binary())] * keeps_ids
                yield pa.RecordBatch.from_arrays([*kept.columns, *columns], names=schema.names)

    return rows.mapInArrow(cut, schema)


def pack(pieces: DataFrame, window: int = WINDOW, batch_windows: int = BATCH_WINDOWS, seed: int = 23) -> DataFrame:
    """``pieces`` (each with a ``length`` of at most ``window``) with ``sequence_id`` and ``offset``.

    A seeded hash deals the pieces into batches of about ``batch_windows`` windows; their number follows from
    the sum of all lengths. Each batch is balanced by differencing, in one task. ``pieces`` should be a
    stored table, as it is read twice.
    """
    total = pieces.agg(F.sum("length")).first()[0] or 0
    batches = max(1, round(total / (batch_windows * window)))
    batch = free_name(pieces, "batch")
    out = pieces.drop("sequence_id", "offset")
    deal = F.pmod(F.xxhash64(F.lit(seed), *[c for c in out.columns if out.schema[c].dataType != T.BinaryType()]), F.lit(batches))
    schema = T.StructType(
        [*out.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )

    def balance(key: tuple, rows: pa.Table) -> pa.Table:
        # Equal pieces are alike, so this order makes a batch's result independent of the order of arrival.
        rows = rows.combine_chunks()
        lengths = rows.column("length").to_numpy()
        order = np.lexsort((rows.column("ids_crc32").to_numpy(), lengths)) if "ids_crc32" in rows.column_names else np.argsort(lengths)
        rows, lengths = rows.take(order), lengths[order]
        full = lengths >= window
        part = np.zeros(len(lengths), np.int64)
        loose = np.flatnonzero(~full)
        if len(loose):
            part[loose] = windows_for(lengths[loose], window)
        part[full] = (part[loose].max() + 1 if len(loose) else 0) + np.arange(full.sum())
        by = np.argsort(part, kind="stable")
        rows, lengths, part = rows.take(by), lengths[by], part[by]
        before = np.cumsum(lengths) - lengths
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        offsets = before - np.repeat(before[starts], np.diff(np.append(starts, len(part))))
        sequence = (key[0].as_py() << 24) + part
        return rows.drop_columns([batch]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets))

    return out.withColumn(batch, deal).groupBy(batch).applyInArrow(balance, schema)


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """Training rows: ``sequence_id``, ``n_tokens``, and ``ids``, padded to the window unless it ends at a power of two.

    ``packed`` needs its pieces' ``ids``. A sequence is at most a window long, so a group stays small.
    """

    def joined(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("offset")
        ids = np.frombuffer(b"".join(rows.column("ids").to_pylist()), "<u4").astype(np.int32)
        padded = len(ids) if len(ids) & (len(ids) - 1) == 0 else window
        full = np.full(padded, pad_id, np.int32)
        full[: len(ids)] = ids
        return pa.table({"sequence_id": [key[0].as_py()], "n_tokens": [len(ids)], "ids": [full]})

    return (
        packed.select("sequence_id", "offset", "ids")
        .groupBy("sequence_id")
        .applyInArrow(joined, "sequence_id long, n_tokens long, ids array<int>")
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame) -> DataFrame:
    pieces = stage(cut_documents(docs.select("doc_id", "text"), tokenizer_path(), ids=False))
    return pack(pieces)


def op7_pack_windows(spark, sf_dir):
    """All documents in windows of 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


QUERIES = {"op7_pack_windows": op7_pack_windows}
ORACLE: dict[str, str] = {}
