"""Words of whole Arrow batches as NumPy arrays: bounds and 64-bit hashes, with no Python loop over words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
#: Bytes of text handled at once; a longer document is handled alone.
CHUNK_BYTES = 2 << 20
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def release() -> None:
    """Gives freed memory back to the system at the end of a task: workers are kept and would hold on to their largest batch."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, in place."""
    h ^= h >> U(33)
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(29)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(32)
    return h


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        for k, base in (("p", _BASE), ("i", _INVERSE)):
            x = np.full(n, base, U)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers["p"][:n], _powers["i"][:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes; null is empty."""
    a = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return offsets - (offsets[0] if len(offsets) else 0), data[offsets[0] : offsets[-1]] if len(offsets) else data


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, of one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of the rows i to j of a text column."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, i: int, j: int, lower: bool = False, separator: np.ndarray = _SEPARATOR):
        self.docs = offsets[i : j + 1] - offsets[i]
        self.data = data[offsets[i] : offsets[j]]
        if lower:
            self.data = _LOWER[self.data]
        n = len(self.data)
        inside = ~separator[self.data]
        first, last = inside.copy(), inside.copy()
        if n:
            edges = self.docs[:-1][self.docs[:-1] < n]
            first[1:] &= ~inside[:-1]
            first[edges] = inside[edges]
            last[:-1] &= ~inside[1:]
            edges = self.docs[1:][self.docs[1:] > 0] - 1
            last[edges] = inside[edges]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: offsets of each document's words
        self.words = np.searchsorted(self.start, self.docs)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes: a polynomial from prefix sums, then mixed with the length."""
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def window_hashes(h: np.ndarray, words: np.ndarray, k: int, salt: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words and the offsets of each document's windows; those that cross a document's end are left out."""
    n = len(h)
    counts = np.maximum(np.diff(words) - (k - 1), 0)
    out = np.concatenate([[0], np.cumsum(counts)])
    if n < k or not out[-1]:
        return np.zeros(0, U), out
    total, c = np.zeros(n - k + 1, U), U(0x9E3779B97F4A7C15 ^ (salt * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF) | 1)
    if k <= 8:
        m = U(1)
        for d in range(k):
            m = U((int(m) * int(c)) & 0xFFFFFFFFFFFFFFFF)
            total += h[d : n - k + 1 + d] * m
    else:
        inv = np.full(n, pow(int(c), -1, 1 << 64), U)
        inv[0] = 1
        inv = np.multiply.accumulate(inv)
        up = np.full(n, c, U)
        up[0] = 1
        up = np.multiply.accumulate(up)
        s = np.zeros(n + 1, U)
        np.cumsum(h * up, out=s[1:])
        total = (s[k:] - s[:-k]) * inv[: n - k + 1]
    keep = np.repeat(words[:-1], counts) + ranges(counts)
    return mix(total[keep]), out


def ranges(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... counts[0]-1, 0, 1, ..."""
    if not len(counts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column from one buffer and the byte offsets of its rows."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
