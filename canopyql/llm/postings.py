"""Postings (hash, document, position) in blobs: one row carries many, so that a shuffle moves few rows, and each task
sends at most one posting of a hash for each flush, however frequent the hash is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Postings that a task gathers before they go out: so many, or PER_BLOB for each bucket, up to MOST_HELD (some 100 MB).
FLUSH, PER_BLOB, MOST_HELD = 1_000_000, 64, 4_000_000
MARKS = "part int, ids binary, tags binary, counts binary, positions binary"


def flush_size(buckets: int, least: int | None = None) -> int:
    """A flush that leaves a blob of some dozens of postings in each row as long as memory allows."""
    return min(max(least or FLUSH, PER_BLOB * buckets), MOST_HELD)


def part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    """The part of documents that a document stands in; parts is odd. `part_column` is the same for Spark."""
    x = ids.astype(np.int64)
    return ((x ^ (x.view(np.uint64) >> np.uint64(15)).view(np.int64)) % parts).astype(np.int32)


def part_column(ids: Column, parts: int) -> Column:
    return F.pmod(ids.bitwiseXOR(F.shiftrightunsigned(ids, 15)), F.lit(parts)).cast("int")


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of runs of equal rows."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def pack_rows(key: np.ndarray, ids: np.ndarray, tags: np.ndarray, positions: np.ndarray, hashes: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """One row for each key; postings sorted by key, document and position."""
    if not len(key):
        return
    order = np.lexsort((positions, tags, ids, key))
    key, ids, tags, positions = key[order], ids[order], tags[order], positions[order]
    hashes = hashes[order] if hashes is not None else None
    doc = _runs(key, ids, tags)
    counts = np.diff(np.append(doc, len(key))).astype(np.uint32)
    at = np.append(_runs(key), len(key))
    doc_at = np.searchsorted(doc, at)
    cut = lambda a, where: [a[x:y].tobytes() for x, y in zip(where[:-1], where[1:], strict=True)]
    columns = [pa.array(key[at[:-1]], pa.int32())]
    columns += [pa.array(cut(a, doc_at), pa.binary()) for a in (ids[doc].astype(np.int64), tags[doc].astype(np.uint32), counts)]
    names = ["bucket" if hashes is not None else "part", "ids", "tags", "counts"]
    if hashes is not None:
        columns.append(pa.array(cut(hashes, at), pa.binary()))
        names.append("hashes")
    columns.append(pa.array(cut(positions.astype(np.int32), at), pa.binary()))
    yield pa.RecordBatch.from_arrays(columns, [*names, "positions"])


def unpack(table: pa.Table) -> dict[str, np.ndarray]:
    """All postings of a table of blobs, with the document of each repeated."""
    kinds = {"ids": np.int64, "tags": np.uint32, "counts": np.uint32, "hashes": np.uint64, "positions": np.int32}
    out = {n: np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table[n]] or [np.zeros(0, t)]) for n, t in kinds.items() if n in table.column_names}
    counts = out.pop("counts").astype(np.int64)
    return out | {n: np.repeat(out[n], counts) for n in ("ids", "tags")}


def by_hash(p: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Sorted by hash and document; starts of the groups of a hash; the group of each posting."""
    order = np.lexsort((p["positions"], p["tags"], p["ids"], p["hashes"]))
    p = {k: v[order] for k, v in p.items()}
    starts = _runs(p["hashes"])
    return p, starts, np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))


class Collector:
    """Gathers the postings of a task; every `flush` of them go out as blobs."""

    def __init__(self, flush: int = FLUSH):
        self.flush = flush
        self.kept: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, hashes: np.ndarray, ids: np.ndarray, tags: np.ndarray, positions: np.ndarray) -> bool:
        if len(hashes):
            self.kept.append((hashes, ids, tags, positions.astype(np.int32)))
            self.n += len(hashes)
        return self.n >= self.flush

    def take(self) -> dict[str, np.ndarray]:
        names, kinds = ("hashes", "ids", "tags", "positions"), (np.uint64, np.int64, np.uint32, np.int32)
        out = {n: np.concatenate([k[i] for k in self.kept] or [np.zeros(0, t)]) for i, (n, t) in enumerate(zip(names, kinds, strict=True))}
        self.kept, self.n = [], 0
        return out
