"""Exact Jaccard self-join of word shingles by universe partition.

Size bands. Two sets of s <= t shingles with Jaccard similarity r or more differ in at most H = (1-r)/(1+r) * (s+t)
shingles and s >= r*t. A set is indexed in its own band and in each larger band in which a partner may stand.

Segments. In a band the universe is hashed into m > H segments, so a pair agrees on m-H segments at least. A document posts
the hash of its subset in each segment that isn't empty. An allocation by cost picks m: more segments leave more
slack for empty ones but make more postings. A document whose empty segments exceed the slack is deficient; a pair can only be
lost if both are. Deficient documents post their one-deletion neighbourhoods as well (of two whose non-empty segments all
differ, one differs by one shingle, unless most segments are empty; those few documents repeat the whole scheme with
another hash, until none is left).

Frequent subsets. A hash of more than HOT documents (a common passage, a large group of near copies) is hot. A document
may go without its hot postings as long as they fit into its slack: every partner then shares a posting that isn't hot.
Only documents with more hot postings than slack stay in hot groups. Each is compared with its group's smallest; a group that
then lies within one component is settled, and its postings no longer count. What is still beyond its slack (documents that
share much of their text without linking) is indexed by its rarest shingles, of which two that link must share one. That
makes families, which are compared in blocks without emitting pairs.

Verification. Sizes and odd sketches (parities of hashed shingles, which bound the difference from below) exclude pairs
that can't link; of the rest both sets are computed again from the texts and compared whole. Equal sets (by a digest of 128 bits) are one: copies that meet in a
task post once, and only the smallest id of all copies is compared.

Cases: null or empty texts have no shingles and link with nothing; fewer than k words are one shingle; rows with equal doc_id are
one node of the components, each text of them with its own links; a row with a null doc_id is a node by its text, and a component of
such rows only has a null id; only components come out, not links: in large groups not every link is computed; an empty table gives no rows; extra columns are ignored. A very long text is handled alone, in memory of some 100 bytes for each of its own. Postings travel in blobs (one row carries many), at
most HOT of a hash from one flush.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .postings import flush_size, part_column
from .storage import Scratch
from .words import U, Words, binary_array, chunks, mix, ranges, release, text_buffer, window_hashes

#: More documents than this make a posting's hash hot.
HOT = 8
RESERVE = 1.0
#: Documents and shingles of a block of a family, two of which meet in one task.
FAMILY_BLOCK, FAMILY_SHINGLES = 1024, 1_000_000
FLUSH = 400_000
#: Text bytes of a bucket of postings (more of them beyond BUCKETS buckets, up to four times), and of a part of documents.
BUCKET_BYTES, BUCKETS, PART_BYTES = 4 << 20, 2048, 3 << 20
BAND_GROWTH = 1.5
POSTING, HOT_MARK, DOCUMENT, PAIR, HOT_MEMBER, SKETCH = range(6)
#: Segments up to which the cost of an allocation is tried beyond the least.
TRIALS = 40


class Bands:
    """Bounds of the size bands and the allocation of each, for a similarity of percent / 100."""

    def __init__(self, percent: int):
        self.percent, self.edges = percent, [1]

    def _grow(self, size: int) -> None:
        while self.edges[-1] <= size:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * BAND_GROWTH)))

    def of(self, sizes: np.ndarray) -> np.ndarray:
        self._grow(int(sizes.max(initial=1)))
        return np.searchsorted(np.array(self.edges), sizes, "right") - 1

    def least_size(self, band: int) -> int:
        """Smallest size that may have a partner in the band."""
        while len(self.edges) < band + 2:
            self._grow(self.edges[-1])
        return -(-self.edges[band] * self.percent // 100)

    @functools.cache  # noqa: B019  a few dozen bands
    def allocation(self, band: int) -> tuple[int, int]:
        """(m, H): the number of segments of least expected postings, and the largest difference."""
        self.least_size(band)
        top = self.edges[band + 1] - 1
        h = (100 - self.percent) * 2 * top // (100 + self.percent)
        size = (self.least_size(band) + top) / 2
        step = max(1, h // 100)
        return min((h + 1 + x * step for x in range(TRIALS)), key=lambda m: self._cost(m, h, size)), h

    @staticmethod
    def _cost(m: int, h: int, size: float) -> float:
        """Postings of the subsets, and of the deletions if the empty segments exceed the slack (a normal tail).

        A reserve of slack pays for the hot postings that a document may go without."""
        empty = m * math.exp(-size / m)
        slack = m - h - 1 - empty - RESERVE * (4 + 0.1 * h)
        deficient = 0.5 * math.erfc((slack + 0.5) / math.sqrt(2 * max(empty, 0.05)))
        return m - empty + deficient * size


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each document, and the offsets of the documents."""
    h = w.hashes()
    counts = np.diff(w.words)
    s, at = window_hashes(h, w.words, k)
    row = np.repeat(np.arange(len(counts)), np.diff(at))
    short = np.flatnonzero((counts > 0) & (counts < k))
    extra = np.zeros(len(short), U)
    for n in range(1, k):
        own = short[counts[short] == n]
        total = np.full(len(own), n * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF, U)
        for d in range(n):
            total = mix(total * U(0x9E3779B97F4A7C15) + h[w.words[own] + d])
        extra[counts[short] == n] = total
    s, row = np.concatenate([s, extra]), np.concatenate([row, short])
    order = np.lexsort((s, row))
    s, row = s[order], row[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    s, row = s[new], row[new]
    return s, np.searchsorted(row, np.arange(len(counts) + 1))


def signatures(s: np.ndarray, at: np.ndarray, bands: Bands) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, row, info) of all postings of a chunk; info: band * 65536 + how many postings the document may go without."""
    sizes = np.diff(at)
    own = bands.of(sizes)
    element = mix(s * U(0x9E3779B97F4A7C15) + U(0x1F83D9ABFB41BD6B))
    bits = [(element & U(0x1FFFFF)).astype(np.float64), (element >> U(21) & U(0x1FFFFF)).astype(np.float64), (element >> U(42)).astype(np.float64)]
    for up in range(4):
        band = own + up
        distinct = np.unique(band[sizes > 0])
        least = np.zeros(int(band.max(initial=0)) + 1, np.int64)
        segments, differ = least.copy(), least.copy()
        for b in distinct.tolist():
            least[b] = bands.least_size(b)
            segments[b], differ[b] = bands.allocation(b)
        rows = np.flatnonzero((sizes > 0) & (sizes >= least[band]))
        seed = 0
        while len(rows):
            m, h = segments[band[rows]], differ[band[rows]]
            n = sizes[rows]
            pick = np.repeat(at[rows], n) + ranges(n)
            local = np.repeat(np.arange(len(rows)), n)
            base = np.concatenate([[0], np.cumsum(m)])
            spread = mix(s[pick] ^ U((seed + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)) >> U(32)
            key = base[local] + ((spread * m[local].astype(U)) >> U(32)).astype(np.int64)
            many = np.bincount(key, minlength=base[-1])
            low, mid, high = (np.bincount(key, b[pick], base[-1]).astype(np.int64).view(U) for b in bits)
            total = low + (mid << U(21)) + (high << U(42))
            full = np.flatnonzero(many)
            owner = np.searchsorted(base, full, "right") - 1
            empty = m - np.bincount(owner, minlength=len(rows))
            slack = m - h - 1 - empty
            info = (band[rows] << 16) + np.clip(slack, 0, 65535)
            name = mix((full - base[owner]).astype(U) * U(0xA0761D6478BD642F) + band[rows][owner].astype(U) * U(0xE7037ED1A0B428DB) + U(seed))
            yield mix(total[full] ^ name), rows[owner], info[owner]
            poor = slack < 0
            if poor.any():
                each = np.flatnonzero(poor[local] & (many[key] > 1))
                names = np.zeros(base[-1], U)
                names[full] = name
                yield mix((total[key[each]] - element[pick[each]]) ^ names[key[each]]), rows[local[each]], info[local[each]]
            rows = rows[2 * empty >= 2 * m - h]  # each round leaves a tiny share, so this ends
            rows = rows[sizes[rows] > 1]
            seed += 1


def odd_sketches(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parities of the shingles that fall on each bit: at least as many bits as shingles, 64 times a power of two, as words of 64.

    Two sketches differ in at most as many bits as their sets in shingles; a longer one folds onto a shorter one."""
    sizes = np.diff(at)
    words = 1 << np.ceil(np.log2(np.maximum(-(-sizes // 64), 1))).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(words)])
    spot = mix(s ^ U(0x3C79AC492BA7B653)) & np.repeat((words * 64 - 1).astype(U), sizes)
    odd = np.bincount(np.repeat(base[:-1] * 64, sizes) + spot.astype(np.int64), minlength=int(base[-1]) * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(U), words


def _fold(x: np.ndarray, n: int) -> np.ndarray:
    return np.bitwise_xor.reduce(x.reshape(-1, n), axis=0)


def _table(rows: list[tuple]) -> pa.Table:
    """kind, a, b, info and sketch from arrays; of a sketch or digest, a is the document and b the number of its shingles."""
    kinds = [np.full(len(a), k, np.int32) for k, a, _, _ in rows]
    cat = lambda i, t: np.concatenate([np.asarray(r[i]).astype(t) for r in rows] or [np.zeros(0, t)])
    kind = np.concatenate(kinds or [np.zeros(0, np.int32)])
    sketch = pa.nulls(len(kind), pa.binary())
    return pa.table({"kind": kind, "a": cat(1, np.int64), "b": cat(2, np.int64), "info": cat(3, np.int32), "sketch": sketch})


def candidates(docs: DataFrame, k: int, percent: int, buckets: int) -> DataFrame:
    """(kind, a, b, info, sketch): documents with their sizes and digests, sketches, candidate pairs and members of hot groups."""

    def blobs(key: np.ndarray, kind: int, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        order = np.argsort(key, kind="stable")
        key, x, y, z = key[order], x[order], y[order], z[order]
        at = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        cut = lambda a, t: pa.array([a[i:j].astype(t).tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(key[at[:-1]], pa.int32()), pa.array([kind] * (len(at) - 1), pa.int32()), cut(x, np.uint64), cut(y, np.int64), cut(z, np.int32)], ["bucket", "kind", "x", "y", "z"])

    def spread(n: int, first: int) -> np.ndarray:
        return ((np.arange(n) // 4096 + first) % buckets).astype(np.int32)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, kept, held, turn, limit = Bands(percent), [], 0, 0, flush_size(buckets, FLUSH)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal kept, held, turn
            if not kept:
                return
            x, y, z = (np.concatenate([r[i] for r in kept]) for i in range(3))
            kept, held = [], 0
            order = np.argsort(x)
            starts = np.flatnonzero(np.concatenate([[True], x[order][1:] != x[order][:-1]]))
            sizes = np.diff(np.append(starts, len(x)))
            hot = np.zeros(len(x), bool)
            hot[order] = np.repeat(sizes > HOT, sizes)
            marks = x[order[starts[sizes > HOT]]]
            none = np.zeros(len(marks), np.int64)
            yield from blobs((x[~hot] % U(buckets)).astype(np.int32), POSTING, x[~hot], y[~hot], z[~hot])
            yield from blobs((marks % U(buckets)).astype(np.int32), HOT_MARK, marks, none, none)
            turn += 7
            yield from blobs(spread(int(hot.sum()), turn), HOT_MEMBER, x[hot], y[hot], z[hot])

        for batch in batches:
            ids, (offsets, data) = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), text_buffer(batch.column(1))
            for i, j in chunks(offsets):
                w = Words(offsets, data, i, j, lower=True)
                s, at = shingle_sets(w, k)
                sizes, own = np.diff(at), ids[i:j]
                turn += 1
                odd, count = odd_sketches(s, at)
                first = np.full(len(odd), -1)
                first[np.cumsum(count) - count] = sizes
                b = np.full(len(odd) + 2 * len(own), turn % buckets, np.int32)
                yield from blobs(b[: len(odd)], SKETCH, odd, np.repeat(own, count), first)
                # copies within the chunk: the first stands for all
                e = np.concatenate([np.zeros(1, U), np.cumsum(mix(s ^ U(0x5851F42D4C957F2D)), dtype=U)])
                f = np.concatenate([np.zeros(1, U), np.cumsum(mix(s + U(0x14057B7EF767814F)), dtype=U)])
                one, two = e[at[1:]] - e[at[:-1]], f[at[1:]] - f[at[:-1]]
                digest = np.stack([one, two], 1).ravel()
                yield from blobs(b[: len(digest)], DOCUMENT, digest, np.repeat(own, 2), np.stack([sizes, np.full(len(own), -1)], 1).ravel())
                order = np.lexsort((own, two, one, sizes))
                same = np.zeros(len(own), bool)
                same[1:] = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1]) & (sizes[order][1:] == sizes[order][:-1]) & (sizes[order][1:] > 0)
                copies = order[same]
                alone = np.setdiff1d(np.arange(len(own)), copies)
                n = sizes[alone]
                at2 = np.concatenate([[0], np.cumsum(n)])
                for x, row, info in signatures(s[np.repeat(at[alone], n) + ranges(n)], at2, bands):
                    kept.append((x, own[alone[row]], info.astype(np.int32)))
                    held += len(x)
                if held >= limit:
                    yield from flush()
        yield from flush()
        release()

    def meet(table: pa.Table) -> pa.Table:
        by: dict[int, list] = {}
        for r in table.select(["kind", "x", "y", "z"]).to_batches():
            for kind, x, y, z in zip(r.column(0).to_pylist(), r.column(1), r.column(2), r.column(3), strict=True):
                by.setdefault(kind, []).append((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.int64), np.frombuffer(z.as_buffer(), np.int32)))
        get = lambda kind: [np.concatenate([r[i] for r in by.get(kind, [])] or [np.zeros(0, t)]) for i, t in enumerate((np.uint64, np.int64, np.int32))]
        out = []
        x, y, z = get(HOT_MEMBER)
        out.append((HOT_MEMBER, x.view(np.int64), y, z))
        sketches = [_sketch_rows(kind, *r) for kind in (DOCUMENT, SKETCH) for r in by.get(kind, [])]
        marks = get(HOT_MARK)[0]
        x, y, z = get(POSTING)
        by.clear()
        order = np.lexsort((y, x))
        x, y, z = x[order], y[order], z[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        x, y, z = x[new], y[new], z[new]
        starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(x)))
        hot = (sizes > HOT) | np.isin(x[starts], marks)
        member = np.repeat(hot, sizes)
        out.append((HOT_MEMBER, x[member].view(np.int64), y[member], z[member]))
        first, second = [], []
        for g in np.unique(sizes[~hot]).tolist():
            if g > 1:
                at = starts[~hot & (sizes == g)]
                i, j = np.triu_indices(g, 1)
                pairs = np.unique(np.stack([y[at[:, None] + i].ravel(), y[at[:, None] + j].ravel()]), axis=1)
                first.append(pairs[0])
                second.append(pairs[1])
        if first:
            pairs = np.unique(np.stack([np.concatenate(first), np.concatenate(second)]), axis=1)
            out.append((PAIR, pairs[0], pairs[1], np.zeros(pairs.shape[1])))
        del x, y, z, order
        release()
        return pa.concat_tables([_table(out), *sketches])

    posted = docs.select("doc_id", "text").mapInArrow(post, "bucket int, kind int, x binary, y binary, z binary")
    return posted.groupBy("bucket").applyInArrow(meet, "kind int, a long, b long, info int, sketch binary")


def _sketch_rows(kind: int, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> pa.Table:
    """Rows of one blob of sketches or digests; z is a document's size at the first of its words of 64 bits, else -1."""
    at = np.append(np.flatnonzero(z >= 0), len(y))
    n = len(at) - 1
    return pa.table({"kind": np.full(n, kind, np.int32), "a": y[at[:-1]], "b": z[at[:-1]].astype(np.int64), "info": np.zeros(n, np.int32), "sketch": binary_array(x, at * 8)})


def plausible(pairs: DataFrame, sketches: DataFrame, parts: int, percent: int) -> DataFrame:
    """Of distinct pairs (a, b) those that sizes and sketches can't exclude; no pair that links is lost.

    sketches: (doc_id, n, sketch). Of repeated ids with several sketches any may speak for the pair."""

    def compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        own: dict[int, list] = {}
        for d, n, x in zip(right["doc_id"].to_pylist(), right["n"].to_pylist(), right["sketch"].to_pylist(), strict=True):
            own.setdefault(d, []).append((n, np.frombuffer(x, U)))
        keep = []
        for b, n, x in zip(left["b"].to_pylist(), left["n_a"].to_pylist(), left["sketch_a"].to_pylist(), strict=True):
            x, fits = np.frombuffer(x, U), False
            for m, y in own.get(b, ()):
                if 100 * min(n, m) >= percent * max(n, m):
                    w = min(len(x), len(y))
                    fits = fits or int(np.bitwise_count(_fold(x, w) ^ _fold(y, w)).sum()) * (100 + percent) <= (100 - percent) * (n + m)
            keep.append(fits)
        keep = np.array(keep, bool)
        del own
        release()
        return pa.table({"a": left["a"].to_numpy()[keep], "b": left["b"].to_numpy()[keep]}, schema=schema)

    own = sketches.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    carried = pairs.join(own, "a").select(part_column(F.col("b"), parts).alias("part"), "a", "b", "n_a", "sketch_a")
    whole = sketches.select(part_column(F.col("doc_id"), parts).alias("part"), "doc_id", "n", "sketch")
    return carried.groupBy("part").cogroup(whole.groupBy("part")).applyInArrow(compare, "a long, b long").distinct()


def family_links(own: DataFrame, rare: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Links (a, b) between documents of different components that share a rare shingle, directly or through others.

    Such documents form families, often large ones of near misses. A family is dealt out as pairs of blocks of bounded size;
    in a task all intersections are products of incidence matrices, and only links come out, never pairs. Blocks hold sizes of one band, and
    meet those of the same band and of the next. own: (doc, c, s) with the set of each document; rare: (gid, doc, n, inner)."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        doc, c, block = (table[n].to_numpy() for n in ("doc", "c", "block"))
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        lists = table["s"].combine_chunks()
        sizes = np.asarray(pc.list_value_length(lists))
        token, row = pc.list_flatten(lists).to_numpy(), np.repeat(np.arange(len(doc)), sizes)
        distinct, column, n = np.unique(token, return_inverse=True, return_counts=True)
        use = n[column] > 1
        row, column = row[use], np.unique(column[use], return_inverse=True)[1]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        place = np.zeros(len(doc), np.int64)
        inner = np.zeros((len(left), len(right)), np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for first in range(0, int(column.max(initial=-1)) + 1, 4096):
            x, y = np.searchsorted(column, [first, first + 4096])
            halves = []
            for half in (left, right):
                place[:] = -1
                place[half] = np.arange(len(half))
                at = place[row[x:y]]
                m = np.zeros((len(half), 4096), np.float32)
                m[at[at >= 0], column[x:y][at >= 0] - first] = 1
                halves.append(m)
            inner += halves[0] @ halves[1].T
        union = sizes[left][:, None] + sizes[right][None, :] - inner
        linked = (100 * inner >= percent * union) & (c[left][:, None] != c[right][None, :])
        p, q = np.nonzero(linked)
        release()
        return pa.table({"a": doc[left[p]], "b": doc[right[q]]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    # a shingle that stands in nobody's inner prefix brings no pair; neither do documents smaller than all whose inner prefix holds it
    of = rare.groupBy("gid").agg(F.min(F.when(F.col("inner"), F.col("n"))).alias("least"))
    use = scratch.save(rare.join(of, "gid").filter(F.col("n") >= F.col("least")).select("gid", "doc"))
    star = use.join(use.groupBy("gid").agg(F.min("doc").alias("a")), "gid").filter("a < doc").select("a", F.col("doc").alias("b")).distinct()
    family = components(star, scratch)
    # bands of sizes a factor of 100 / percent apart: partners stand in the same band or the next
    band = F.floor(F.log(F.size("s").cast("double")) / math.log(100 / percent) + 1e-9).cast("int")
    member = own.join(family, F.col("doc") == F.col("node")).select("doc", "c", "s", F.col("component").alias("family"), band.alias("band"))
    room = member.groupBy("family", "band").agg(F.greatest(F.ceil(F.sum(F.size("s")) / FAMILY_SHINGLES), F.ceil(F.count("*") / FAMILY_BLOCK)).cast("int").alias("blocks"))
    above = room.select("family", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    below = room.select("family", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    room = scratch.save(room.join(above, ["family", "band"], "left").join(below, ["family", "band"], "left").fillna(0, ["above", "below"]))
    m = member.join(room, ["family", "band"]).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    inside = m.select("family", "doc", "c", "s", "band", F.lit(0).alias("next"), "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    inside = inside.select("family", "doc", "c", "s", "band", "next", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    # across two bands: i is a block of the lower, -1 - j one of the upper
    lower = m.filter("above > 0").select("family", "doc", "c", "s", "band", F.lit(1).alias("next"), "block", F.col("block").alias("i"), F.explode(F.sequence(F.lit(-1), -F.col("above"))).alias("j"))
    upper = m.filter("below > 0").select("family", "doc", "c", "s", (F.col("band") - 1).alias("band"), F.lit(1).alias("next"), (-1 - F.col("block")).alias("block"), F.explode(F.sequence(F.lit(0), F.col("below") - 1)).alias("i"), (-1 - F.col("block")).alias("j"))
    m = inside.unionByName(lower).unionByName(upper)
    return m.groupBy("family", "band", "next", "i", "j").applyInArrow(compare, "a long, b long").filter("a <> b").distinct()


def sets_of(texts: DataFrame, rest: DataFrame, k: int) -> DataFrame:
    """(doc, c, s): the shingles of the documents of rest (doc, c)."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffer(batch.column(2))
            for i, j in chunks(offsets):
                s, at = shingle_sets(Words(offsets, data, i, j, lower=True), k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(s.view(np.int64)))], ["doc", "c", "s"])
        release()

    return texts.join(rest, texts["doc_id"] == rest["doc"]).select("doc", "c", "text").mapInArrow(shingles, "doc long, c long, s array<long>")


def rarest_shingles(own: DataFrame, percent: int) -> DataFrame:
    """(gid, doc, n, inner): of each document of n shingles its rarest ones.

    In one order of all shingles by rarity, the first that two linked sets share stands within the first n - ceil(r n) + 1 of the larger (r is the
    similarity) and, as they share 2 r / (1 + r) of the smaller's n at least, within the first n - ceil(2 r n / (1 + r)) + 1 of the smaller: its inner prefix.
    A shingle that only one of them has comes first and needs no row, so a passage that all of them hold is hardly ever reached."""
    each = own.select("doc", "c", F.size("s").alias("n"), F.explode("s").alias("gid"))
    often = each.groupBy("gid").agg(F.count("*").alias("often")).filter("often > 1")
    shared = each.join(often, "gid")
    by_doc = Window.partitionBy("doc", "n")
    alone = F.col("n") - F.count("*").over(by_doc)
    prefix = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    inner = F.col("n") - F.ceil(F.lit(2 * percent) * F.col("n") / (100 + percent)) + 1
    ranked = shared.select("gid", "doc", "n", (F.row_number().over(by_doc.orderBy("often", "gid")) + alone).alias("rank"))
    return ranked.filter(F.col("rank") <= prefix).select("gid", "doc", "n", (F.col("rank") <= inner).alias("inner")).distinct()


def verified(pairs: DataFrame, texts: DataFrame, parts: int, k: int, percent: int) -> DataFrame:
    """Of distinct pairs (a, b) those that link. The text of a travels to the part of b."""

    def compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()

        def sets(ids: np.ndarray, column: pa.ChunkedArray) -> dict[int, np.ndarray]:
            first = np.unique(ids, return_index=True)[1]
            offsets, data = text_buffer(column.take(pa.array(first)).combine_chunks())
            out = {}
            for i, j in chunks(offsets):
                s, at = shingle_sets(Words(offsets, data, i, j, lower=True), k)
                out |= {int(ids[first[i + n]]): s[at[n] : at[n + 1]] for n in range(j - i)}
            return out

        a, b = left["a"].to_numpy(), left["b"].to_numpy()
        these, those = sets(a, left["text_a"]), sets(right["doc_id"].to_numpy(), right["text"])
        keep = []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = these[x], those.get(y, these[x][:0])
            inner = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(inner > 0 and 100 * inner >= percent * (len(p) + len(q) - inner))
        keep = np.array(keep)
        del these, those
        release()
        return pa.table({"a": a[keep], "b": b[keep]}, schema=schema)

    carried = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select(part_column(F.col("b"), parts).alias("part"), "a", "b", "text_a")
    whole = texts.select(part_column(F.col("doc_id"), parts).alias("part"), "doc_id", "text")
    return carried.groupBy("part").cogroup(whole.groupBy("part")).applyInArrow(compare, "a long, b long")


def numbered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """docs with __node, equal for rows of equal id and text only, and the (node, id) of those whose node is not their id, if any.

    The node is the id; where that is null or has several texts, a hash of 64 bits of id and text."""
    i, text = F.col("doc_id").cast("long"), F.xxhash64(F.col("text").isNull(), "text")
    # most tables have no such id, and texts are read for this only where one has
    again = scratch.save(docs.groupBy(i.alias("__id")).agg(F.count("*").alias("rows")).filter("rows > 1 or __id is null").select("__id"))
    if not again.limit(1).count():
        return docs.withColumn("__node", i), None
    rows = docs.select(i.alias("__id"), text.alias("x")).join(again, "__id", "left_semi")
    several = scratch.save(rows.groupBy("__id").agg(F.min("x").alias("x"), F.max("x").alias("y")).filter("x <> y").select("__id"))
    out = docs.join(several, i == F.col("__id"), "left")
    hashed = i.isNull() | F.col("__id").isNotNull()
    out = out.withColumn("__node", F.when(hashed, F.xxhash64(i.isNull(), i, F.col("text").isNull(), "text")).otherwise(i))
    names = scratch.save(out.filter(hashed).select(F.col("__node").alias("node"), i.alias("id")).distinct())
    return out.drop("__id"), names if names.limit(1).count() else None


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    scratch = Scratch(docs.sparkSession)
    rows, names = numbered(docs, scratch)
    if names is None:
        return _components(rows, scratch, None, k, percent).select(F.col("node").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
    known = names.filter("id is not null")
    ties = known.join(known.groupBy("id").agg(F.min("node").alias("a")), "id").select("a", F.col("node").alias("b")).filter("a <> b")
    out = scratch.save(_with_ids(_components(rows, scratch, ties, k, percent), names))
    least = out.groupBy("component").agg(F.min("id").alias("component_id"))
    return out.join(least, "component").select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def _with_ids(nodes: DataFrame, names: DataFrame) -> DataFrame:
    found = names.select("node", "id", F.lit(True).alias("hashed"))
    return nodes.join(found, "node", "left").withColumn("id", F.when(F.col("hashed"), F.col("id")).otherwise(F.col("node"))).drop("hashed")


def _components(docs: DataFrame, scratch: Scratch, ties: DataFrame | None, k: int, percent: int) -> DataFrame:
    """node, n_shingles and component of every row of docs (__node, text); ties: further links (a, b)."""
    docs = docs.select(F.col("__node").alias("doc_id"), "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    per_bucket = min(max(BUCKET_BYTES, size / BUCKETS), 4 * BUCKET_BYTES)
    found = scratch.save(candidates(docs, k, percent, max(24, math.ceil(size / per_bucket))))
    of = lambda kind: found.filter(F.col("kind") == kind)
    sketches = of(SKETCH).select(F.col("a").alias("doc_id"), F.col("b").alias("n"), "sketch")
    parts = max(25, math.ceil(size / PART_BYTES) | 1)
    hot = of(HOT_MEMBER).select(F.col("a").alias("gid"), F.col("b").alias("doc"), "info")
    band = F.shiftright("info", 16)
    over = hot.groupBy("doc", band.alias("band")).agg(F.count("*").alias("n"), F.min(F.col("info").bitwiseAND(65535)).alias("slack")).filter("n > slack").select("doc", "band", "slack")
    # equal sets are one: the smallest id stands for all, and only it is compared
    same = of(DOCUMENT).filter("b > 0")
    same = same.join(same.groupBy(F.col("b").alias("n"), F.col("sketch").alias("digest")).agg(F.min("a").alias("first"), F.count("*").alias("copies")).filter("copies > 1"), (F.col("b") == F.col("n")) & (F.col("sketch") == F.col("digest")))
    copies = scratch.save(same.filter("a <> first").select(F.col("first").alias("a"), F.col("a").alias("b")))
    gone = copies.select(F.col("b").alias("gone"))
    single = lambda df, c: df.join(gone, F.col(c) == F.col("gone"), "left_anti")
    hot = scratch.save(single(hot.select("gid", "doc", band.alias("band")), "doc").join(over, ["doc", "band"]).distinct())
    star = hot.join(hot.groupBy("gid").agg(F.min("doc").alias("a")), "gid").filter("a < doc").select("a", F.col("doc").alias("b"))
    pairs = scratch.save(plausible(single(single(of(PAIR).select("a", "b"), "a"), "b").union(star).distinct(), sketches, parts, percent))
    named = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).union(hot.select("doc")).distinct()
    texts = scratch.save(docs.join(named, "doc_id", "left_semi"))
    links = copies.union(verified(pairs, texts, parts, k, percent))
    links = scratch.save(links if ties is None else links.union(ties))
    label = components(links, scratch)
    # a group within one component is settled: its postings no longer count against a document's slack
    member = hot.join(label, hot["doc"] == label["node"], "left").select("gid", "doc", "band", "slack", F.coalesce("component", "doc").alias("c"))
    split = member.join(member.groupBy("gid").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x < y").select("gid"), "gid", "left_semi")
    rest = scratch.save(split.groupBy("doc", "band", "c").agg(F.count("*").alias("n"), F.min("slack").alias("s")).filter("n > s").select("doc", "c").distinct())
    if rest.limit(1).count():
        own = sets_of(texts, rest, k)
        rare = scratch.save(rarest_shingles(own, percent))
        found_links = scratch.save(family_links(own, rare, scratch, percent))
        if found_links.limit(1).count():
            label = components(links.union(found_links), scratch)
    sizes = of(DOCUMENT).select(F.col("a").alias("doc"), F.col("b").alias("n_shingles"))
    return sizes.join(label, sizes["doc"] == label["node"], "left").select(F.col("doc").alias("node"), "n_shingles", F.coalesce("component", "doc").alias("component"))


def first_of_each(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """Of each group of near duplicates one document, with all its columns: that of the smallest id, one without an id only if no other has one.

    Rows of equal id stand each for its own text; of rows of equal id and text one stays."""
    scratch = Scratch(docs.sparkSession)
    rows, names = numbered(docs, scratch)
    nodes = _components(rows, scratch, None, k, percent).groupBy("node", "component").agg(F.count("*").alias("rows"))
    if names is None:
        first = nodes.filter("node = component")
    else:
        nodes = scratch.save(_with_ids(nodes, names))
        least = nodes.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("node"))).alias("x")).select(F.col("x.node").alias("node"))
        first = nodes.join(least, "node", "left_semi")
    # rows without words are in no group, so each of them stays unless id and text are equal
    first = scratch.save(first.select(F.col("node").alias("__node"), "rows"))
    of = lambda condition: rows.join(first.filter(condition), "__node", "left_semi")
    out = of("rows = 1")
    if first.filter("rows > 1").limit(1).count():
        out = out.unionByName(of("rows > 1").dropDuplicates(["__node"]))
    return out.select(*docs.columns)
