"""Ids of repeated spans of bytes: each distinct span is encoded once, then gathered for all its places."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .words import ranges


def gather(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows `which` of a ragged array, end to end, and the length of each."""
    counts = offsets[which + 1] - offsets[which]
    return flat[np.repeat(offsets[which], counts) + ranges(counts)], counts


def _find(keys: np.ndarray, at: np.ndarray, wanted: np.ndarray, into: np.ndarray) -> None:
    """Writes the places of the wanted keys that a sorted table has."""
    if len(keys):
        spot = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[spot] == wanted
        into[hit] = at[spot[hit]]


class TokenCache:
    """Hash of a span to its ids. New spans go to a small sorted table, which joins the large one now and then.

    Beyond `most` spans it starts anew from the batch at hand."""

    SMALL = 150_000

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], most: int = 1_500_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.tables = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * 2  # large, small
        self.flat, self.size = np.zeros(1 << 16, np.uint32), 0
        self.offsets, self.n = np.zeros(1 << 16, np.int64), 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        """The array with room for n entries, doubled so that growth costs little."""
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def _add(self, keys: np.ndarray, ids: list[list[int]]) -> np.ndarray:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(sizes.sum())
        self.flat = self._room(self.flat, self.size + total)
        self.flat[self.size : self.size + total] = np.fromiter((x for r in ids for x in r), np.uint32, total)
        self.offsets = self._room(self.offsets, self.n + len(ids) + 1)
        self.offsets[self.n + 1 : self.n + 1 + len(ids)] = self.size + np.cumsum(sizes)
        at = self.n + np.arange(len(ids))
        self.size, self.n = self.size + total, self.n + len(ids)
        level = 1 if len(self.tables[1][0]) + len(keys) <= self.SMALL else 0
        parts = [(keys, at), self.tables[1]] + ([self.tables[0]] if level == 0 else [])
        k, v = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(k, kind="stable")
        self.tables[level] = (k[order], v[order])
        if level == 0:
            self.tables[1] = (keys[:0], at[:0])
        return at

    def ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the spans in order, end to end, and how many each has."""
        if not len(hashes):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if self.n > self.most:
            self.clear()
        place = np.full(len(distinct), -1, np.int64)
        for keys, at in self.tables:
            _find(keys, at, distinct, place)
        new = place < 0
        if new.any():
            raw, spot = data.tobytes(), first[new]
            place[new] = self._add(distinct[new], self.encode([raw[a:b] for a, b in zip(start[spot].tolist(), end[spot].tolist(), strict=True)]))
        return gather(self.flat, self.offsets, place[inverse])
