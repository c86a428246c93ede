"""Vectorised text kernels that run inside Spark tasks on Arrow batches.

Everything works on the raw UTF-8 bytes of a slice of documents, so that a task
never holds more than a few megabytes of intermediate arrays however long the
batch or a single text is.  Fingerprints are 64 bits wide and depend on content
only, so any task on any executor computes the same value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text whose intermediate arrays are held at once.
SLICE_BYTES = 1 << 20

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX1, _MIX2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)

#: Bytes 0x20 and 0x09 to 0x0D separate words.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> U(30))) * _MIX1
    h = (h ^ (h >> U(27))) * _MIX2
    return h ^ (h >> U(31))


def _byte_values(seed: int) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=U) * U(_BASE) + U(seed))
    values[IS_SPACE] = 0
    return values


BYTE_VALUES, OTHER_VALUES = _byte_values(17), _byte_values(0xC2B2AE3D27D4EB4F)
_ALL_BYTES = mix(np.arange(1, 257, dtype=U) * U(_BASE) + U(99))


class _Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << int(n - 1).bit_length()
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                p = np.full(size, U(base))
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=U))
        return self.up[:n], self.down[:n]


POWERS = _Powers()


def text_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at.astype(np.int64)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes; a longer document is a range of its own."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


class Words:
    """The words of documents ``lo`` to ``hi``: where they lie, how many each has, and their fingerprints."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, lower: bool = False, space: np.ndarray = IS_SPACE):
        base = int(offsets[lo])
        b = data[base : int(offsets[hi])]
        self.bytes = LOWER[b] if lower else b
        self.docs = hi - lo
        at = offsets[lo : hi + 1] - base
        self.solid = solid = ~space[b]
        first = solid.copy()
        last = solid.copy()
        if len(b):
            first[1:] &= ~solid[:-1]
            last[:-1] &= ~solid[1:]
            cuts = at[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < len(b))]
            first[cuts] = solid[cuts]
            last[cuts - 1] = solid[cuts - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        #: Word numbers at which each document begins, and the end.
        self.at = np.searchsorted(self.start, at)
        self.byte_at = at

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), self.counts)

    def hashes(self, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
        """A fingerprint of each word; another table of byte values gives another, independent one."""
        if not len(self.start):
            return np.zeros(0, U)
        up, down = POWERS.get(len(self.bytes))
        sums = np.add.reduceat(values[self.bytes] * up * self.solid, self.start)
        return mix(sums * down[self.start] + (self.end - self.start).astype(U))

    def prefix_hashes(self, n: int, of: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Fingerprints of the first ``n`` bytes of each word, or of the words numbered ``of``."""
        start, end = self.start[of], self.end[of]
        h = np.zeros(len(start), U)
        for k in range(n):
            at = start + k
            there = at < end
            h = h * U(_BASE) + np.where(there, _ALL_BYTES[self.bytes[np.minimum(at, len(self.bytes) - 1)]], U(0)) if len(h) else h
        return mix(h)

    def room(self) -> np.ndarray:
        """For each word, how many words its document has from it on."""
        return np.repeat(self.at[1:], self.counts) - np.arange(len(self.start))


def grams(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Fingerprints of each ``n`` consecutive values, one for each start (documents are not told apart)."""
    if len(h) < n:
        return np.zeros(0, U)
    base, total, shift = U((_BASE * 3 + 2 * salt) & 0xFFFFFFFFFFFFFFFF | 1), None, 1
    # doubling: spans of 1, 2, 4, ... values, joined by the bits of n
    span, size, done = h, 1, 0
    while True:
        if n & size:
            part = span[done : done + len(h) - n + 1]
            total = part if total is None else mix(total * base + part + U(size))
            done += size
        size *= 2
        if size > n:
            return mix(total + U(n))
        span = mix(span[:-shift] * base + span[shift:])
        shift *= 2


def byte_grams(b: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of each ``n`` consecutive bytes: polynomials by doubling, mixed once."""
    if len(b) < n:
        return np.zeros(0, U)
    span, size, total, done = _ALL_BYTES[b], 1, None, 0
    while True:
        if n & size:
            part = span[done : done + len(b) - n + 1]
            total = part.copy() if total is None else total * U(pow(_BASE, size, 1 << 64)) + part
            done += size
        if size * 2 > n:
            return mix(total)
        span = span[:-size] * U(pow(_BASE, size, 1 << 64)) + span[size:]
        size *= 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    out, size = x, 1
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    if size < width:
        rest = width - size
        out = np.minimum(out[: len(x) - width + 1], out[rest : rest + len(x) - width + 1])
    return out


def anchors(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of ``width`` values that share one sampled value, the least of the window.

    Returns (place of the sampled value, first window, last window).  Equal
    windows sample at the same offset (the leftmost least value), wherever they
    stand; so equal windows always share their sampled value.
    """
    if len(values) < width:
        none = np.zeros(0, np.int64)
        return none, none, none
    # Of equal values the leftmost must win, whatever stands around it.
    least = sliding_min(values, width)
    is_place = _is_a_minimum(values, least, width)
    places = np.flatnonzero(is_place)
    # the leftmost place of each window: the first place at or after its start with the window's least value
    first = (np.cumsum(is_place) - is_place)[: len(least)]
    place = places[first]
    wrong = np.flatnonzero(values[place] != least)
    while len(wrong):
        first[wrong] += 1
        place[wrong] = places[first[wrong]]
        wrong = wrong[values[place[wrong]] != least[wrong]]
    begin = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    end = np.concatenate((begin[1:], [len(place)])) - 1
    return place[begin], begin, end


def _is_a_minimum(values: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """Whether a value is the least of any window that holds it."""
    n = len(values)
    pad = np.zeros(n + width - 1, U)
    pad[width - 1 : width - 1 + len(least)] = least
    # the greatest least value over the windows that hold a place
    best, size = pad, 1
    while size * 2 <= width:
        best = np.maximum(best[:-size], best[size:])
        size *= 2
    if size < width:
        rest = width - size
        best = np.maximum(best[: len(pad) - width + 1], best[rest : rest + len(pad) - width + 1])
    return values == best[:n]


def spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends (exclusive) of the runs of true values."""
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def signed(h: np.ndarray) -> np.ndarray:
    """Spark has signed 64-bit integers only."""
    return h.view(np.int64)
