"""Texts of an Arrow batch as byte arrays: words, their hashes and shingles, without Python loops.

Words are runs of bytes other than space and the characters 9 to 13; these are ASCII, so a word
of a UTF-8 text is the same in bytes and in code points.  Work is cut into parts of half a
megabyte, whole rows each, so memory doesn't depend on the size of a batch; a single longer text
is a part by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PART_BYTES = 512 << 10

IS_WHITE = np.zeros(256, bool)
IS_WHITE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RANDOM = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHINGLE_CODES = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of an odd number modulo 2**64, as many as were asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.values = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.values) < n:
            step = np.uint64(pow(self.base, len(self.values), 1 << 64))
            self.values = np.concatenate([self.values, self.values * step])
        return self.values[:n]


_POWERS, _INVERSES = _Powers(_BASE), _Powers(_INVERSE)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Texts:
    """Bytes of some texts, one after the other; ``bounds`` has where each starts, and the end."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray) -> None:
        self.data, self.bounds = data, bounds

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def words(self, lower: bool = True) -> Words:
        return Words(LOWER[self.data] if lower else self.data, self.bounds)


class Words:
    """Places of the words: ``starts`` and ``stops`` in ``data``; row r has words first[r]:first[r+1]."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray) -> None:
        self.data, self.bounds, self._ranges = data, bounds, None
        solid = ~IS_WHITE[data]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        inner = bounds[:-1][np.diff(bounds) > 0]
        begins[inner] = solid[inner]
        ends = solid.copy()
        ends[:-1] &= ~solid[1:]
        last = bounds[1:][np.diff(bounds) > 0] - 1
        ends[last] = solid[last]
        self.starts = np.flatnonzero(begins)
        self.stops = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, bounds)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word."""
        return self.ranges().of(self.starts, self.stops)

    def ranges(self) -> RangeHashes:
        if self._ranges is None:
            self._ranges = RangeHashes(self.data)
        return self._ranges


class RangeHashes:
    """64-bit hashes of ranges of bytes or code points, as differences of one running polynomial."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        codes = BYTE_CODES[data] if data.dtype == np.uint8 else mixed(data.astype(np.uint64)) | np.uint64(1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * _POWERS.upto(n), out=self.sums[1:])
        self.inverses = _INVERSES.upto(n + 1)

    def of(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        value = (self.sums[stops] - self.sums[starts]) * self.inverses[starts]
        return mixed(value + (stops - starts).astype(np.uint64) * np.uint64(_BASE))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` neighbouring words from each place on; one for the whole where it is shorter."""
    if len(hashes) == 0:
        return hashes
    n = min(size, len(hashes))
    out = np.full(len(hashes) - n + 1, np.uint64(n), np.uint64)
    for i in range(n):
        out += hashes[i : len(hashes) - n + 1 + i] * SHINGLE_CODES[i]
    return mixed(out)


def parts(column: pa.Array, most: int = PART_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(from row, to row, texts) over a column of strings; null counts as empty."""
    texts = column.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if n == 0:
        return
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64, count=n + 1, offset=8 * texts.offset)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + most, "right")) - 1)
        stop = min(stop, n)
        yield row, stop, Texts(raw[bounds[row] : bounds[stop]], bounds[row : stop + 1] - bounds[row])
        row = stop
