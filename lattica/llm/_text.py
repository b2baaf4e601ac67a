"""Vectorised text kernels on Arrow string columns: words, rolling hashes and per-document reductions.

All kernels work on the UTF-8 bytes of a run of whole documents at once. A word is a maximal run of
bytes outside ``\\x20 \\x09-\\x0D``; hashes are 64 bits wide and mixed, so that equal hashes stand for
equal words or shingles (the chance that two different ones meet is 2^-64 a pair).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Documents are taken in runs of about this many bytes (one document at least).
RUN_BYTES = 1 << 18

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_P = int(_rng.integers(1, 2**62)) * 2 + 1
_P_INV = pow(_P, -1, 2**64)
#: One odd factor for each place in a shingle.
PLACES = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... mod 2^64, at least n of them."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, RUN_BYTES + 65536), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have


def drop_powers() -> None:
    """Forget the tables of powers; they are as long as the longest run was."""
    _powers.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def runs(offsets: np.ndarray, size: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive (first, last) rows of about ``size`` bytes."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


class Words:
    """Words of a run of documents.

    ``start``/``end``: byte places in ``data``; ``hash``: of each word; ``bounds``: document d has
    the words bounds[d]:bounds[d+1].
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        base, stop = int(offsets[0]), int(offsets[-1])
        self.offsets = np.asarray(offsets, np.int64) - base
        data = data[base:stop]
        self.data = data = LOWER[data] if lower else data
        solid = ~IS_SPACE[data]
        self.solid = solid
        edges = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        first[edges] |= solid[edges]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        last[edges[1:] - 1] |= solid[edges[1:] - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.bounds)
        self._sums: np.ndarray | None = None

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes start:end, whatever place they stand at."""
        if self._sums is None:
            n = len(self.data)
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * _power(_P, n)[:n], out=self._sums[1:])
        inverse = _power(_P_INV, len(self.data) + 1)
        raw = (self._sums[end] - self._sums[start]) * inverse[start]
        return mix(raw + (end - start).astype(np.uint64) * U(0x9E3779B97F4A7C15))

    @property
    def hash(self) -> np.ndarray:
        if not hasattr(self, "_hash"):
            self._hash = self.span_hash(self.start, self.end)
        return self._hash

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each window of k words, document bounds, index of its first word)."""
        h, n = self.hash, len(self.hash)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(len(self.counts) + 1, np.int64), np.zeros(0, np.int64)
        total = h[: n - k + 1] * PLACES[0]
        for j in range(1, k):
            total += h[j : n - k + 1 + j] * PLACES[j]
        keep = np.zeros(n + 1, np.int64)
        whole = np.maximum(self.counts - k + 1, 0)
        np.add.at(keep, self.bounds[:-1][whole > 0], 1)
        np.add.at(keep, (self.bounds[:-1] + whole)[whole > 0], -1)
        at = np.flatnonzero(np.cumsum(keep[:-1])[: n - k + 1] > 0)
        return mix(total[at]), np.concatenate([[0], np.cumsum(whole)]), at


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes) of each document's k-word shingles, A-Z lower-cased.

    A document of fewer than k words has its whole word sequence as its one shingle; without words
    the set is empty.
    """
    for a, b in runs(offsets):
        w = Words(data, offsets[a : b + 1], lower=True)
        grams, bounds, _ = w.grams(k)
        for d in range(b - a):
            n = int(w.counts[d])
            if n >= k:
                yield a + d, distinct(grams[bounds[d] : bounds[d + 1]])
            elif n:
                h = w.hash[w.bounds[d] : w.bounds[d + 1]]
                yield a + d, mix(np.array([(h * PLACES[8 : 8 + n]).sum(dtype=np.uint64) + U(n)], np.uint64))
            else:
                yield a + d, np.zeros(0, np.uint64)


def sums_by_bounds(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[d]:bounds[d+1]] for each d."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]
