"""Words of Arrow text columns as numpy arrays: many texts at a time, straight from their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes of text that one pass holds; a longer text gets a pass of its own.
PASS_BYTES = 1 << 20
_SEED = 0x5DEECE66D
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


@cache
def _byte_values(lower: bool) -> np.ndarray:
    values = np.random.default_rng(_SEED).integers(0, 1 << 64, 256, dtype=np.uint64)
    if lower:
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


@cache
def _inside(letters: bool) -> np.ndarray:
    """Bytes that belong to words: all but ASCII white space, or letters only (all beyond ASCII count as such)."""
    found = np.ones(256, bool)
    if letters:
        found[:128] = [chr(b).isalpha() for b in range(128)]
    found[[0x20, *range(0x09, 0x0E)]] = False
    return found


_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, size: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < size:
        size = max(size, PASS_BYTES + 1)
        have = np.full(size, base & _MASK, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * PASS_BYTES:
            _powers[name] = have
    return have


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a finalizer: one to one)."""
    out = values.astype(np.uint64, copy=True)
    out ^= out >> np.uint64(33)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(33)
    out *= np.uint64(0xC4CEB9FE1A85EC53)
    out ^= out >> np.uint64(33)
    return out


class Texts:
    """A run of whole texts: their bytes side by side and where each begins and ends."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()

    def totals(self, flags: np.ndarray) -> np.ndarray:
        """Per text, the sum of a per-byte array."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
        """64-bit hashes of byte spans."""
        inverse = pow(_BASE, -1, 1 << 64)
        values = _byte_values(lower)[self.data]
        values *= _power("up", _BASE, len(values))[: len(values)]
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        hashes = sums[ends] - sums[starts]
        hashes *= _power("down", inverse, len(values) + 1)[starts]
        hashes += (ends - starts).astype(np.uint64)
        return mix(hashes)

    def words(self, lower: bool = True, letters: bool = False) -> Words:
        inside = _inside(letters)[self.data]
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.bounds] = True
        before = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        after = np.zeros(len(inside), bool)
        after[:-1] = inside[1:]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        owner = np.searchsorted(self.bounds[1:], starts, side="right")
        return Words(self, starts, ends, owner, self.span_hashes(starts, ends, lower), inside)


class Words:
    """Words in order: byte spans, the text each belongs to, and hashes."""

    def __init__(self, texts: Texts, starts, ends, owner, hashes, inside):
        self.texts, self.starts, self.ends, self.owner, self.hashes, self.inside = texts, starts, ends, owner, hashes, inside

    def counts(self) -> np.ndarray:
        return np.bincount(self.owner, minlength=len(self.texts))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``size`` words of one text, and the index of each run's first word."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        first = np.flatnonzero(self.owner[:n] == self.owner[size - 1 :])
        return _joined([self.hashes[first + k] for k in range(size)]), first

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Like ``windows`` with each run's text; a text with fewer words is one run of all its words."""
        hashes, first = self.windows(size)
        owner = self.owner[first]
        counts = self.counts()
        at = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=at[1:])
        for n in range(1, size):
            short = np.flatnonzero(counts == n)
            if len(short):
                whole = _joined([self.hashes[at[short] + k] for k in range(n)])
                hashes, owner = np.concatenate([hashes, whole]), np.concatenate([owner, short])
        return hashes, owner


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    out = np.full(len(parts[0]), len(parts), np.uint64)
    for part in parts:
        out *= np.uint64(_BASE)
        out += part
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return mix(out)


def hashes_of(words: list[str]) -> np.ndarray:
    """The hashes that these words have in a text of lower-case words."""
    return np.concatenate([t.words().hashes for _, t in passes(pa.array(words))])


def passes(texts: pa.Array, limit: int = PASS_BYTES) -> Iterator[tuple[int, Texts]]:
    """Cut a text column (null: empty) into runs of about ``limit`` bytes; yields each run's first row too."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    texts = texts.fill_null("") if texts.null_count else texts
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), len(texts))
        yield at, Texts(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
        at = to
