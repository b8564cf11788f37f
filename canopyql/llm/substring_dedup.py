"""Removal of passages of 50 words that an earlier document holds, by difference-cover anchors.

Positions whose remainder modulo 31 lies in a difference cover (6 of 31) carry an anchor: the hash of the 20 words from
there. Two equal windows of 50 words, wherever they start, have such a position in common within their first 31, so they
share an aligned anchor. Anchors found in two documents mark the windows around them; only those are hashed whole (this
extends an anchor to each window that holds it), and a window is removed where a document with a smaller id has it too.

Both searches send blobs of postings (postings.py). A flush settles among its own rows what it can: all but the
first document of a hash are settled there, and one posting for the hash goes on. So neither a hot passage nor a group
of copies gathers in one task. Texts move twice: to meet their marks, and, if marked, to meet their removed windows.

Cases: null text has no words; with fewer than 50 words nothing is removed; rows with equal doc_id are one document, none
is "smaller" than another, and each row keeps its own positions (a tag of its words tells them apart); a row without a doc_id is neither smaller
nor larger than another, so it loses nothing and makes nobody lose anything; an empty
table gives no rows; extra columns are dropped by ``report`` and kept by ``filter_documents``. A very long text is handled alone, in memory of some 60 bytes for
each of its own. Window hashes have 64 bits and meet only under equal anchors' marks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .postings import MARKS, Collector, by_hash, flush_size, pack_rows, part_column, part_of, unpack
from .storage import Scratch
from .words import Words, chunks, ranges, release, text_buffer, window_hashes

PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Text bytes for each bucket of postings and for each part of documents.
BUCKET_BYTES, PART_BYTES = 16 << 20, 6 << 20


def is_cover(period: int, cover: tuple[int, ...]) -> bool:
    return len({(a - b) % period for a in cover for b in cover}) == period


def _tags(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """32 bits of the word sequence of each document."""
    weight = ranges(np.diff(words)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * weight, dtype=np.uint64)])
    return ((total[words[1:]] - total[words[:-1]]) >> np.uint64(32)).astype(np.uint32)


def _settle(p: dict[str, np.ndarray], only_later: bool) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Of one flush: the postings to send on (the first of each hash) and which postings are settled.

    only_later: a posting is settled if a smaller document has its hash; else if any other document has it.
    """
    p, starts, group = by_hash(p)
    if not len(starts):
        return p, np.zeros(0, bool)
    least, most = p["ids"][starts], p["ids"][np.append(starts[1:], len(group)) - 1]
    later = p["ids"] > least[group]
    return p, later if only_later else (least < most)[group]


def _blobs(p: dict[str, np.ndarray], settled: np.ndarray, buckets: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows of one flush for the union of both schemas: settled marks and the postings that go on."""
    pick = lambda m: (p["ids"][m], p["tags"][m], p["positions"][m])
    for b in pack_rows(part_of(p["ids"][settled], parts), *pick(settled)):
        yield pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int32()), *b.columns[:4], pa.nulls(b.num_rows, pa.binary()), b.columns[4]], ["bucket", "part", "ids", "tags", "counts", "hashes", "positions"])
    send = np.zeros(len(settled), bool)
    if len(settled):
        first = np.ones(len(settled), bool)
        first[1:] = p["hashes"][1:] != p["hashes"][:-1]
        # what a flush can't settle are the postings of the first document of a hash; one of a settled hash goes on too, so that others learn of it
        send = ~settled | first
    for b in pack_rows((p["hashes"][send] % np.uint64(buckets)).astype(np.int32), *pick(send), p["hashes"][send]):
        yield pa.RecordBatch.from_arrays([b.columns[0], pa.nulls(b.num_rows, pa.int32()), *b.columns[1:]], ["bucket", "part", "ids", "tags", "counts", "hashes", "positions"])


FLUSHED = "bucket int, part int, ids binary, tags binary, counts binary, hashes binary, positions binary"


def _marks(flushed: DataFrame, parts: int, only_later: bool) -> DataFrame:
    """Marks by part of documents: those settled at once and those settled where all postings of a hash meet."""

    def meet(table: pa.Table) -> pa.Table:
        p, settled = _settle(unpack(table), only_later)
        rows = list(pack_rows(part_of(p["ids"][settled], parts), p["ids"][settled], p["tags"][settled], p["positions"][settled]))
        del p, settled
        release()
        return pa.Table.from_batches(rows) if rows else pa.table([[]] * 5, names=["part", "ids", "tags", "counts", "positions"]).cast(pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("ids", "tags", "counts", "positions"))]))

    sent = flushed.filter("bucket is not null").select("bucket", "ids", "tags", "counts", "hashes", "positions")
    met = sent.groupBy("bucket").applyInArrow(meet, MARKS)
    return flushed.filter("part is not null").select("part", "ids", "tags", "counts", "positions").unionByName(met)


class _Marked:
    """Marks of a part of documents, found by document and tag."""

    def __init__(self, table: pa.Table):
        p = unpack(table)
        order = np.lexsort((p["positions"], p["tags"], p["ids"]))
        self.ids, self.tags, self.positions = p["ids"][order], p["tags"][order], p["positions"][order]

    def of(self, doc: int, tag: int) -> np.ndarray:
        a, b = np.searchsorted(self.ids, doc, "left"), np.searchsorted(self.ids, doc, "right")
        i, j = a + np.searchsorted(self.tags[a:b], tag, "left"), a + np.searchsorted(self.tags[a:b], tag, "right")
        return self.positions[i:j]


def _within(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in [s, s + length) of a start s."""
    d = np.zeros(n + length + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + length, -1)
    return np.cumsum(d)[:n] > 0


def _joined(w: Words, a: int, b: int, keep: np.ndarray | None) -> bytes:
    """Words a to b of a chunk, or those of them to keep, joined by one blank."""
    s, e = w.start[a:b], w.end[a:b]
    if keep is not None:
        s, e = s[keep], e[keep]
    if not len(s):
        return b""
    sizes = e - s
    out = np.full(int(sizes.sum()) + len(s) - 1, 0x20, np.uint8)
    out[np.repeat(np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]), sizes) + ranges(sizes)] = w.data[np.repeat(s, sizes) + ranges(sizes)]
    return out.tobytes()


def _empty(schema: pa.Schema) -> pa.Table:
    return schema.empty_table()


def removed_windows(docs: DataFrame, scratch: Scratch, window: int = 50, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> tuple[DataFrame, DataFrame, int]:
    """(documents with a mark, whole, and the counts of the rest; marks of the windows to remove; number of parts)."""
    anchor = window - period + 1
    if anchor < 1 or not is_cover(period, cover):
        raise ValueError("the cover doesn't fit the window")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets, parts = max(24, math.ceil(size / BUCKET_BYTES)), max(25, math.ceil(size / PART_BYTES) | 1)
    at_cover = np.isin(np.arange(period), cover)

    def flush(c: Collector, only_later: bool) -> Iterator[pa.RecordBatch]:
        p, settled = _settle(c.take(), only_later)
        yield from _blobs(p, settled, buckets, parts)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Collector(flush_size(buckets))
        for batch in batches:
            ids, (offsets, data) = batch.column(0).to_numpy(zero_copy_only=False), text_buffer(batch.column(1))
            for i, j in chunks(offsets):
                w = Words(offsets, data, i, j)
                h = w.hashes()
                tags = _tags(h, w.words)
                a, at = window_hashes(h, w.words, anchor)
                counts = np.diff(at)
                place = ranges(counts)
                # windows need `window` words: an anchor counts only in a document that has so many
                use = at_cover[place % period] & np.repeat(np.diff(w.words) >= window, counts)
                row = np.repeat(np.arange(j - i), counts)[use]
                if c.add(a[use], ids[i:j][row], tags[row], place[use]):
                    yield from flush(c, False)
        yield from flush(c, False)
        release()

    def candidates(key: tuple, texts: pa.Table, marks: pa.Table) -> pa.Table:
        marked = _Marked(marks)
        texts = texts.combine_chunks()
        if not texts.num_rows:
            return _empty(kept_schema)
        column, named = texts["text"].combine_chunks(), texts["doc_id"].combine_chunks()
        has_id, ids = named.is_valid().to_numpy(zero_copy_only=False), named.fill_null(0).to_numpy()
        offsets, data = text_buffer(column)
        n_words, sha, spans = [], [], []
        for i, j in chunks(offsets):
            w = Words(offsets, data, i, j)
            tags = _tags(w.hashes(), w.words)
            for k in range(j - i):
                a, b = int(w.words[k]), int(w.words[k + 1])
                n_words.append(b - a)
                x = marked.of(int(ids[i + k]), int(tags[k])) if b - a >= window and has_id[i + k] else ()
                if len(x):
                    first = np.maximum(x - (period - 1), 0)
                    d = np.zeros(b - a - window + 2, np.int32)
                    last = np.minimum(x, b - a - window)
                    ok = last >= first
                    np.add.at(d, first[ok], 1)
                    np.add.at(d, last[ok] + 1, -1)
                    spans.append(np.packbits(np.cumsum(d)[:-1] > 0).tobytes())
                    sha.append(None)
                else:
                    spans.append(None)
                    sha.append(hashlib.sha256(_joined(w, a, b, None)).hexdigest())
        release()
        hit = pa.array([s is not None for s in spans])
        text = pa.compute.if_else(hit, column, pa.scalar(None, column.type))
        return pa.table([texts["part"].combine_chunks(), named, pa.array(n_words, pa.int64()), pa.array(sha, pa.string()), text, pa.array(spans, pa.binary())], schema=kept_schema)

    kept_schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()), ("text", pa.string()), ("spans", pa.binary())])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Collector(flush_size(buckets))
        for batch in batches:
            ids, (offsets, data), spans = batch.column(0).to_numpy(zero_copy_only=False), text_buffer(batch.column(1)), batch.column(2)
            for i, j in chunks(offsets):
                w = Words(offsets, data, i, j)
                h = w.hashes()
                tags = _tags(h, w.words)
                a, at = window_hashes(h, w.words, window, salt=7)
                use = np.concatenate([np.unpackbits(np.frombuffer(spans[i + k].as_buffer(), np.uint8), count=n) for k, n in enumerate(np.diff(at).tolist())] or [np.zeros(0, np.uint8)]).astype(bool)
                row = np.repeat(np.arange(j - i), np.diff(at))[use]
                if c.add(a[use], ids[i:j][row], tags[row], ranges(np.diff(at))[use]):
                    yield from flush(c, True)
        yield from flush(c, True)
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    flushed = scratch.save(rows.filter("doc_id is not null").mapInArrow(anchors, FLUSHED))
    marks = scratch.save(_marks(flushed, parts, False))
    scratch.drop(flushed)
    whole = rows.select(part_column(F.coalesce("doc_id", F.xxhash64("text")), parts).alias("part"), "doc_id", "text").groupBy("part")
    kept = scratch.save(whole.cogroup(marks.groupBy("part")).applyInArrow(candidates, "part int, doc_id long, n_words long, sha string, text string, spans binary"))
    scratch.drop(marks)
    flushed = scratch.save(kept.filter("spans is not null").select("doc_id", "text", "spans").mapInArrow(windows, FLUSHED))
    marks = scratch.save(_marks(flushed, parts, True))
    scratch.drop(flushed)
    return kept, marks, parts


def _with_removed(kept: DataFrame, marks: DataFrame, window: int, texts: bool) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept_text", pa.string()), ("was", pa.int64())] * texts)

    def finish(key: tuple, rows: pa.Table, marks: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _empty(schema)
        marked, rows = _Marked(marks), rows.combine_chunks()
        ids, column = rows["doc_id"].to_numpy(), rows["text"].combine_chunks()
        offsets, data = text_buffer(column)
        was = rows["was"].combine_chunks() if texts else None
        out: list[list] = [[], [], [], [], []]
        for i, j in chunks(offsets):
            w = Words(offsets, data, i, j)
            tags = _tags(w.hashes(), w.words)
            for k in range(j - i):
                a, b = int(w.words[k]), int(w.words[k + 1])
                x = marked.of(int(ids[i + k]), int(tags[k]))
                keep = ~_within(x, window, b - a) if len(x) else None
                joined = _joined(w, a, b, keep)
                out[0].append(b - a)
                out[1].append(int((~keep).sum()) if keep is not None else 0)
                out[2].append(hashlib.sha256(joined).hexdigest())
                if texts:
                    out[3].append(joined.decode("utf-8", "replace") if len(x) else column[i + k].as_py())
                    out[4].append(was[i + k].as_py())
        release()
        return pa.table([pa.array(ids), *(pa.array(x, t) for x, t in zip(out[: 3 + 2 * texts], (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=False))], schema=schema)

    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string, was long" * texts
    columns = ["part", "doc_id", "text", *([F.xxhash64("text").alias("was")] if texts else [])]
    return kept.select(*columns).groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(finish, ddl)


def report(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    scratch = Scratch(docs.sparkSession)
    kept, marks, _ = removed_windows(docs, scratch, window)
    plain = kept.filter("spans is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    return plain.unionByName(_with_removed(kept.filter("spans is not null"), marks, window, False))


def filter_documents(docs: DataFrame, window: int = 50) -> DataFrame:
    """The documents without removed words, with all their columns; n_chars, where there is one, is that of the new text.

    Texts that lose no word stay as they are; of others the kept words are joined by one blank."""
    scratch = Scratch(docs.sparkSession)
    kept, marks, _ = removed_windows(docs, scratch, window)
    changed = _with_removed(kept.filter("spans is not null"), marks, window, True).filter("n_removed > 0")
    # rows of one doc_id are told apart by a checksum of their whole text; the input's columns travel as one struct, so that no name clashes
    changed = changed.select(F.col("doc_id").alias("c_id"), F.col("was").alias("c_was"), F.col("kept_text").alias("c_text")).dropDuplicates(["c_id", "c_was"])
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"))
    rows = rows.select("d", F.col("d.doc_id").cast("long").alias("d_id"), F.xxhash64(F.coalesce("d.text", F.lit(""))).alias("d_was"))
    joined = rows.join(changed, (F.col("d_id") == F.col("c_id")) & (F.col("d_was") == F.col("c_was")), "left")
    out = {c: F.col("d")[c] for c in docs.columns}
    out["text"] = F.coalesce("c_text", "d.text")
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("c_text").isNotNull(), F.length("c_text").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return joined.select(*(v.alias(c) for c, v in out.items()))
