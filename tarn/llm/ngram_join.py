"""N-gram Jaccard join: candidates must share prefix tokens under several global orders of the tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import stage, table
from tarn.llm.components import components
from tarn.llm.words import mix, passes

SHINGLE_WORDS = 5
#: Two sets link when 100 * intersection >= 75 * union.
SIMILAR = 75
#: Text that a task indexes at a time, and documents at most (their place in it takes 16 bits).
CHUNK_BYTES, CHUNK_DOCS = 8 << 20, 0xFFFF
#: Index entries that one group of the inverted index should hold.
GROUP_TOKENS = 1_000_000
#: A token in so many documents of a chunk is counted there; its documents stay with the chunk.
COMMON = 16
#: Members of one group that are compared with each other in one task; larger groups are cut.
MEMBERS = 1000
#: Seeds of the orders. The first is the tokens' own.
ORDERS = (0, 0x51ED27, 0x2C1B3C6D)
TOKEN_BITS = 48
_TOKEN = np.uint64((1 << TOKEN_BITS) - 1)
_SHIFT = np.uint64(TOKEN_BITS)
CLASSES, CELLS = 4, 32


# ---- numbers as bytes ------------------------------------------------------------------------------------------


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes, without the planes that are all zero."""
    values = np.ascontiguousarray(values, "<u8")
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unsqueeze(packed: bytes, count: int) -> np.ndarray:
    planes = np.zeros((count, 8), np.uint8)
    planes[:, : packed[0]] = np.frombuffer(packed, np.uint8, offset=1).reshape(packed[0], count).T
    return planes.reshape(-1).view("<u8").astype(np.uint64, copy=False)


def _rising(values: np.ndarray) -> bytes:
    """Sorted numbers by their differences."""
    return squeeze(np.diff(values, prepend=np.uint64(0)))


def _risen(packed: bytes, count: int) -> np.ndarray:
    return np.cumsum(unsqueeze(packed, count), dtype=np.uint64)


# ---- the inverted index ----------------------------------------------------------------------------------------
#
# A task cuts its documents into chunks and sends the tokens of a chunk, each with the places of its documents, to the
# groups of the index, which see every document of a token. They return the tokens that more than one document has to
# the chunk they came from. What needs no counting (documents, and who has a common token) passes a group of its own.

_INDEX = "part long, chunk long, kind int, n long, tokens binary, places binary, extra binary"
_ENTRIES, _DOCS, _COMMONS = 0, 1, 2


def _signature(tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """128 bits of each document's set, as two columns."""
    halves = []
    for seed in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        sums = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(mix(tokens ^ np.uint64(seed)), out=sums[1:])
        halves.append(mix(sums[starts + sizes] - sums[starts] + sizes.astype(np.uint64)))
    return np.stack(halves, axis=1)


class _Chunk:
    def __init__(self, parts: int):
        self.parts, self.bytes, self.docs = parts, 0, 0
        self.ids: list = []
        self.sizes, self.signs, self.keys = [], [], []

    def add(self, ids: list, texts, words: int) -> None:
        hashes, owner = texts.words().shingles(words)
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[new], owner[new]
        sizes = np.bincount(owner, minlength=len(texts))
        self.signs.append(_signature(hashes, np.cumsum(sizes) - sizes, sizes))
        self.sizes.append(sizes)
        self.keys.append(hashes >> np.uint64(16) << np.uint64(16) | (owner + self.docs).astype(np.uint64))
        self.ids += ids
        self.bytes += len(texts.data)
        self.docs += len(texts)

    def signatures(self) -> bytes:
        return np.concatenate(self.signs).tobytes()

    def rows(self, chunk: int) -> pa.RecordBatch:
        keys = np.concatenate(self.keys)
        keys.sort()
        tokens, places = keys >> np.uint64(16), keys & np.uint64(0xFFFF)
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
        times = np.diff(np.append(starts, len(tokens)))
        common = np.repeat(times >= COMMON, times)
        out: list[tuple] = [
            (-1 - chunk, chunk, _DOCS, self.docs, squeeze(np.concatenate(self.sizes)), self.signatures(), _ids(self.ids)),
            (-1 - chunk, chunk, _COMMONS, int(common.sum()), _rising(tokens[common]), squeeze(places[common]), b""),
        ]
        counted = starts[times >= COMMON]
        tokens = np.concatenate([tokens[~common], tokens[counted]])
        places = np.concatenate([places[~common], np.full(len(counted), CHUNK_DOCS, np.uint64)])
        count = np.concatenate([np.zeros(int((~common).sum()), np.uint64), times[times >= COMMON].astype(np.uint64)])
        order = np.argsort(tokens, kind="stable")
        tokens, places, count = tokens[order], places[order], count[order]
        width = (1 << TOKEN_BITS) // self.parts + 1
        part = (tokens // np.uint64(width)).astype(np.int64)
        edges = np.searchsorted(part, np.arange(self.parts + 1))
        for i in np.flatnonzero(np.diff(edges)).tolist():
            at = slice(edges[i], edges[i + 1])
            own = _rising(tokens[at] - np.uint64(i * width))
            out.append((i, chunk, _ENTRIES, edges[i + 1] - edges[i], own, squeeze(places[at]), squeeze(count[at][count[at] > 0])))
        names = ["part", "chunk", "kind", "n", "tokens", "places", "extra"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def _ids(ids: list) -> bytes:
    known = np.array([i is not None for i in ids], np.uint8)
    return known.tobytes() + np.array([i or 0 for i in ids], "<i8").tobytes()


def _index(df: DataFrame, words: int, parts: int) -> DataFrame:
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        chunk = _Chunk(parts)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, texts in passes(batch.column(1)):
                if chunk.docs and (chunk.bytes + len(texts.data) > CHUNK_BYTES or chunk.docs + len(texts) >= CHUNK_DOCS):
                    yield chunk.rows(first + made)
                    chunk, made = _Chunk(parts), made + 1
                chunk.add(ids[at : at + len(texts)], texts, words)
        if chunk.docs:
            yield chunk.rows(first + made)

    return df.mapInArrow(index, _INDEX)


def _count(parts: int):
    width = (1 << TOKEN_BITS) // parts + 1

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        """Tokens that more than one document has, back to their chunks, with the logarithm of how many have them."""
        part = key[0].as_py()
        if part < 0:
            return rows
        chunks, sizes = rows.column("chunk").to_pylist(), rows.column("n").to_numpy()
        tokens, places, times = [], [], []
        for n, t, p, e in zip(sizes.tolist(), *(rows.column(c).to_pylist() for c in ("tokens", "places", "extra"))):
            tokens.append(_risen(t, n))
            places.append(unsqueeze(p, n))
            many = places[-1] == CHUNK_DOCS
            times.append(np.ones(n, np.int64))
            times[-1][many] = unsqueeze(e, int(many.sum()))
        tokens, places, times = np.concatenate(tokens), np.concatenate(places), np.concatenate(times)
        order = np.argsort(tokens)
        starts = np.flatnonzero(np.concatenate([[True], tokens[order][1:] != tokens[order][:-1]]))
        shared_by = np.empty(len(tokens), np.int64)
        shared_by[order] = np.repeat(np.add.reduceat(times[order], starts), np.diff(np.append(starts, len(tokens))))
        shared, level = shared_by > 1, np.minimum(4 * np.log2(shared_by), 255).astype(np.uint8)
        out, at = [], 0
        for chunk, n in zip(chunks, sizes.tolist()):
            own = slice(at, at + n)
            keep = shared[own]
            at += n
            if keep.any():
                found = tokens[own][keep] + np.uint64(part * width)
                out.append((part, chunk, _ENTRIES, len(found), _rising(found), squeeze(places[own][keep]), level[own][keep].tobytes()))
        return pa.Table.from_arrays(
            [pa.array([r[i] for r in out], f.type) for i, f in enumerate(rows.schema)], schema=rows.schema
        )

    return count


_SETS = "doc_id long, n_shingles long, sign binary, n_shared long, marks binary"


def _assemble(key: tuple, rows: pa.Table) -> pa.Table:
    """The documents of a chunk: set size and signature, and the shared tokens of those that may have a partner.

    A mark is a token below its level, so that sorted marks are in the first global order: the rarest first.
    Tokens of one document only come before all of them in every order. A document whose prefix consists of such
    tokens links with nothing and has no marks.
    """
    entries, commons = [], (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    for kind, n, tokens, places, extra in zip(*(rows.column(c).to_pylist() for c in ("kind", "n", "tokens", "places", "extra"))):
        if kind == _DOCS:
            sizes = unsqueeze(tokens, n).astype(np.int64)
            signs = np.frombuffer(places, np.uint8).reshape(n, 16)
            known, ids = np.frombuffer(extra, np.uint8, n).astype(bool), np.frombuffer(extra, "<i8", n, n)
        elif kind == _COMMONS:
            commons = _risen(tokens, n), unsqueeze(places, n)
        else:
            entries.append((_risen(tokens, n), unsqueeze(places, n), np.frombuffer(extra, np.uint8)))
    empty = np.zeros(0, np.uint64)
    tokens, places, levels = (np.concatenate([e[i] for e in entries]) if entries else empty for i in range(3))
    many = places == CHUNK_DOCS
    order = np.argsort(tokens[many])
    named, named_level = tokens[many][order], levels[many][order]
    common_level = named_level[np.searchsorted(named, commons[0])] if len(named) else empty
    tokens = np.concatenate([tokens[~many], commons[0]])
    places = np.concatenate([places[~many], commons[1]]).astype(np.int64)
    levels = np.concatenate([levels[~many], common_level]).astype(np.uint64)
    marks = levels << _SHIFT | tokens
    order = np.lexsort((marks, places))
    marks = marks[order]
    shared = np.bincount(places, minlength=len(sizes))
    ends = np.cumsum(shared)
    may_link = (sizes > 0) & (sizes - shared < prefix_size(sizes))
    packed = [squeeze(marks[e - s : e]) if ok else None for e, s, ok in zip(ends.tolist(), shared.tolist(), may_link.tolist())]
    return pa.table(
        [
            pa.array(ids, mask=~known),
            pa.array(sizes),
            pa.array([s.tobytes() for s in signs], pa.binary()),
            pa.array(shared.astype(np.int64)),
            pa.array(packed, pa.binary()),
        ],
        names=["doc_id", "n_shingles", "sign", "n_shared", "marks"],
    )


def prefix_size(sizes):
    """How many first tokens of a set, in any order, hold the first common token with every similar set."""
    return sizes - (SIMILAR * sizes + 99) // 100 + 1


def needed(a, b):
    """The least intersection of two similar sets of these sizes."""
    return -(-SIMILAR * (a + b) // (100 + SIMILAR))


def shingle_sets(df: DataFrame, text: str, identity: str, words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``sign``, ``n_shared``, ``marks`` (see ``_assemble``)."""
    rows = df.select(F.col(identity).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, size // (6 * GROUP_TOKENS))
    counted = _index(rows, words, parts).groupBy("part").applyInArrow(_count(parts), _INDEX)
    return counted.groupBy("chunk").applyInArrow(_assemble, _SETS)


# ---- nodes: distinct sets --------------------------------------------------------------------------------------

_NODES = (
    "doc_id long, n long, n_shared long, marks binary, keys array<long>, prefix array<long>, masks binary, cells binary"
)


def _order(marks: np.ndarray, seed: int) -> np.ndarray:
    """Places of the marks by level, then by the order's own hash."""
    return np.lexsort((mix((marks & _TOKEN) ^ np.uint64(seed)), marks >> _SHIFT)) if seed else np.arange(len(marks))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What filters need of each set: prefix tokens in the first order, bits of the prefixes in the others, counts by cell."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, n, shared, packed = (batch.column(i).to_pylist() for i in range(4))
        out: list[list] = [[], [], [], []]
        for size, count, squeezed in zip(n, shared, packed):
            marks = unsqueeze(squeezed, count)
            tokens, level = marks & _TOKEN, marks >> _SHIFT
            first = prefix_size(size) - (size - count)
            bits = np.zeros((len(ORDERS) - 1, 256), bool)
            for i, seed in enumerate(ORDERS[1:]):
                bits[i, (mix(tokens[_order(marks, seed)[:first]]) & np.uint64(255)).astype(np.int64)] = True
            cell = np.minimum(level // np.uint64(8), np.uint64(CLASSES - 1)) * np.uint64(CELLS) + (mix(tokens) >> np.uint64(59))
            out[0].append([int(mix(tokens ^ np.uint64(s + 1)).min().view(np.int64)) for s in ORDERS[1:]])
            out[1].append(tokens[:first].view(np.int64))
            out[2].append(np.packbits(bits).tobytes())
            out[3].append(np.minimum(np.bincount(cell.astype(np.int64), minlength=CLASSES * CELLS), 65535).astype("<u2").tobytes())
        types = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())
        arrays = [pa.array(o, t) for o, t in zip(out, types)]
        names = ["doc_id", "n", "n_shared", "marks", "keys", "prefix", "masks", "cells"]
        yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=names)


def _groups(rows: pa.Table, *keys: str) -> Iterator[np.ndarray]:
    """Row numbers of each group of two or more rows with equal keys."""
    columns = [rows.column(k).to_numpy() for k in keys]
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for column in columns:
        new[1:] |= column[order][1:] != column[order][:-1]
    for group in np.split(order, np.flatnonzero(new)):
        if len(group) > 1:
            yield group


def _near_first(key: tuple, rows: pa.Table) -> pa.Table:
    """Links among sets that have a first token in common. Each set is compared with every set that starts a cluster."""
    node, n = rows.column("node").to_numpy(), rows.column("n").to_numpy()
    packed, shared = rows.column("marks").to_pylist(), rows.column("n_shared").to_pylist()
    left, right = [], []
    for group in _groups(rows, "order", "key", "part"):
        group = group[np.argsort(node[group])]
        sets = [unsqueeze(packed[i], shared[i]) for i in group.tolist()]
        flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
        starts = np.cumsum(sizes) - sizes
        free, cluster = np.ones(len(group), bool), np.arange(len(group))
        for i, head in enumerate(sets):
            if not free[i]:
                continue
            at = np.minimum(np.searchsorted(head, flat), len(head) - 1)
            common = np.add.reduceat((head[at] == flat).astype(np.int64), starts)
            linked = common >= needed(n[group[i]], n[group])
            linked[: i + 1] = False
            free[linked] = False
            # One link to each cluster that is not known to be connected is enough.
            met, first = np.unique(cluster[linked], return_index=True)
            hits = np.flatnonzero(linked)[first[met != cluster[i]]]
            left += [node[group[i]]] * len(hits)
            right += node[group[hits]].tolist()
            cluster[np.isin(cluster, met)] = cluster[i]
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


def _first_links(nodes: DataFrame) -> DataFrame:
    """Verified links between sets with a common first token in one of the other orders.

    They join most of each group of near copies at a cost that grows with its size, not with its square: large groups
    are cut at random, in each order in another way. Small ones share a task's call.
    """
    keyed = nodes.select("node", "n", "n_shared", "marks", F.posexplode("keys").alias("order", "key"))
    large = stage(
        keyed.groupBy("order", "key").agg(F.count("*").alias("members")).where(F.col("members") > MEMBERS)
    )
    calls = max(1, nodes.count() * (len(ORDERS) - 1) // MEMBERS)
    part = F.coalesce(F.pmod(F.xxhash64("node", "order"), F.ceil(F.col("members") / MEMBERS)), F.lit(0))
    return (
        keyed.join(large, ["order", "key"], "left")
        .withColumn("part", part)
        .withColumn("call", F.pmod(F.xxhash64("order", "key", "part"), F.lit(calls)))
        .drop("members")
        .groupBy("call")
        .applyInArrow(_near_first, "a long, b long")
    )


def _candidates(key: tuple, rows: pa.Table) -> pa.Table:
    """Pairs of sets with a common prefix token in the first order that pass every filter.

    Beyond the common token of the first order, both must have a prefix token in common in each other order (as far
    as 256 bits tell), be similar in size, and have enough tokens in the same cells. Pairs of one component
    are linked already.
    """
    node, comp, n = (rows.column(c).to_numpy() for c in ("node", "comp", "n"))
    first = rows.column("first").to_numpy(zero_copy_only=False).astype(bool)
    masks = np.frombuffer(b"".join(rows.column("masks").to_pylist()), np.uint64).reshape(len(node), len(ORDERS) - 1, -1)
    cells = np.frombuffer(b"".join(rows.column("cells").to_pylist()), "<u2").reshape(len(node), -1).astype(np.int32)
    left, right = [], []
    for group in _groups(rows, "token", "i", "j"):
        # Two blocks meet: members of one against those of the other. A block by itself: every pair once.
        one, two = group[first[group]], group[~first[group]]
        for k, a in enumerate(one.tolist()):
            others = two if len(two) else one[k + 1 :]
            others = others[comp[others] != comp[a]]
            others = others[100 * np.minimum(n[others], n[a]) >= SIMILAR * np.maximum(n[others], n[a])]
            others = others[(masks[others] & masks[a]).any(axis=2).all(axis=1)]
            # A full cell may hold more than it tells.
            enough = np.minimum(cells[others], cells[a]).sum(axis=1) >= needed(n[others], n[a])
            others = others[enough | (cells[others] == 65535).any(axis=1)]
            left += [node[a]] * len(others)
            right += node[others].tolist()
    low, high = np.minimum(left, right), np.maximum(left, right)
    return pa.table({"a": pa.array(low.astype(np.int64)), "b": pa.array(high.astype(np.int64))})


def _other_links(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """All remaining links: between sets of different components that share a prefix token in every order.

    A token of more than ``MEMBERS`` sets is cut into blocks, and each pair of blocks is a group of its own.
    """
    placed = nodes.join(labels, "node").withColumnRenamed("label", "comp")
    tokens = placed.select("node", "comp", F.explode("prefix").alias("token"))
    mixed = stage(
        tokens.groupBy("token")
        .agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("members"))
        .where(F.col("low") < F.col("high"))
        .select("token", "members", F.ceil(F.col("members") / MEMBERS).alias("blocks"))
    )
    rows = mixed.agg(F.sum(F.col("members") * F.col("blocks"))).first()[0] or 0
    calls = max(1, rows // (2 * MEMBERS))
    member = tokens.join(mixed, "token").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    # A block meets itself and every other block once.
    met = member.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select(
        "node",
        "token",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        (F.col("block") <= F.col("other")).alias("first"),
        F.pmod(F.xxhash64("token", F.least("block", "other"), F.greatest("block", "other")), F.lit(calls)).alias("call"),
    )
    pairs = (
        met.join(placed.select("node", "comp", "n", "masks", "cells"), "node")
        .groupBy("call")
        .applyInArrow(_candidates, "a long, b long")
        .distinct()
    )
    own = nodes.select("node", "n", "n_shared", "marks")
    sides = [own.select(*[F.col(c).alias(f"{side}_{c}") for c in own.columns]) for side in "ab"]
    full = stage(pairs).join(sides[0], F.col("a") == F.col("a_node")).join(sides[1], F.col("b") == F.col("b_node"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            columns = (batch.column(c).to_pylist() for c in range(2, 8))
            for i, (n, s, m, o, t, k) in enumerate(zip(*columns)):
                common = len(np.intersect1d(unsqueeze(m, s), unsqueeze(k, t), assume_unique=True))
                if common >= needed(n, o):
                    kept.append(i)
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    return full.select("a", "b", *[f"{side}_{c}" for side in "ab" for c in ("n", "n_shared", "marks")]).mapInArrow(
        verify, "a long, b long"
    )


def jaccard_components(df: DataFrame, text: str = "text", identity: str = "doc_id", words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    A document's set holds its runs of ``words`` lower-case words; a shorter text is one run, an empty or null one has
    none and links with nothing. Two documents link when 100 * intersection >= 75 * union. Repeated rows and equal
    sets are one node. Null ids are kept and never name a component; an empty table gives an empty one.

    The index counts in how many documents each token occurs. Rarest first, and among equals by three seeded hashes, that
    gives three global orders. In each, similar sets share a token among their first ones. A pair is verified if
    that holds in all orders and simple counts allow it. No pairs are formed within a group that is known to be
    connected: sets with a common first token are joined into components beforehand. ``df`` should be a stored table, so
    that a task that runs again reads the same rows in the same order.
    """
    sets = stage(shingle_sets(df, text, identity, words))
    linkable = sets.where(F.col("marks").isNotNull())
    distinct = linkable.groupBy("sign").agg(
        F.min("doc_id").alias("doc_id"),
        F.first("n_shingles").alias("n"),
        F.first("n_shared").alias("n_shared"),
        F.first("marks").alias("marks"),
    )
    described = distinct.select("sign", F.struct("doc_id", "n", "n_shared", "marks").alias("set"))
    nodes = stage(
        described.select("set.*", "sign")
        .mapInArrow(_with_sign, _NODES + ", sign binary")
        .withColumn("node", F.monotonically_increasing_id())
    )
    labels = components(nodes.select("node"), _first_links(nodes))
    # The remaining links connect components, and there are few of them.
    others = stage(_other_links(nodes, labels))
    for side in "ab":
        of = labels.select(F.col("node").alias(side), F.col("label").alias("_label"))
        others = others.join(of, side).withColumn(side, F.col("_label")).drop("_label")
    joined = components(others.select(F.explode(F.array("a", "b")).alias("node")).distinct(), others)
    joined = joined.select(F.col("node").alias("of"), F.col("label").alias("end"))
    labels = labels.join(joined, F.col("label") == F.col("of"), "left").select("node", F.coalesce("end", "label").alias("label"))
    named = nodes.select("node", "sign", "doc_id").join(labels, "node")
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    by_sign = named.join(smallest, "label").select("sign", "component_id")
    found = linkable.join(by_sign, "sign").select("doc_id", "n_shingles", "component_id")
    alone = sets.where(F.col("marks").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone)


def _with_sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sign = batch.column(4)
        for described in _describe(iter([batch.select(list(range(4)))])):
            yield pa.RecordBatch.from_arrays([*described.columns, sign], names=[*described.schema.names, "sign"])


def op2_jaccard_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {"op2_jaccard_join": op2_jaccard_join}
ORACLE: dict[str, str] = {}
