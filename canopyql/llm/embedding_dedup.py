"""Near-duplicate vectors of a label by NN-descent.

Equal vectors are one class, so a vector that a third of all rows share is one node. The descent moves ids and codes only: ``BITS`` signs of
random projections, whose differences estimate the angle. A first neighbour graph comes from blocks of nodes that follow each other
in several orders of the codes. Then rounds of neighbours-of-neighbours joins refine it: a node goes to each of its neighbours, where it meets
the nodes that came there and that neighbour's own list. Only pairs with an edge that is new since the last round are compared, and only
what betters a list comes back. A full list of possible links is saturated: it doubles, up to ``LONGEST``. The rounds end when few entries are new.
Vectors travel once, to verify list entries that may be links: those of cosine >= ``threshold`` in double precision are links.

Lists that stay saturated may hide more, also outside their group. Such nodes are gathered in groups, each with a pivot; by the triangle
inequality of angles a node's links stand within the angle of the threshold of its own, so each group is compared exactly with the nodes so near
to its pivot, in blocks of bounded size. Only counts and a spanning forest of links leave a task, never pairs.

Recall is audited in each label of each length of vectors: samples that grow with it, of all nodes and of those with links, are compared with all
of it. Where less than ``least_recall`` of their links was found, the descent goes on with lists twice as long; a label that fails to the last is
compared exactly as a whole. The figures are logged.

Cases: null labels, and vectors that are null, zero or hold null or non-finite components link with nothing; vectors of different lengths
are not compared; equal vectors link with each other; rows with equal vec_id are counted each, in one component if both are in some; of a
null vec_id the component is null unless its group has ids; ties of distance go to the smaller id, a cosine equal to the threshold links; an empty table
gives no rows; extra columns are ignored; vectors may be long, a block holds about ``SEARCH_BYTES``. A node that many have as a neighbour is met
in blocks of about ``BLOCK``.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .postings import part_column
from .storage import Scratch
from .words import U, binary_array, ranges

log = logging.getLogger(__name__)
BITS = 256
WORDS = BITS // 64
BLOCK = 512
#: Longest list of a descent; what it can't hold is searched exactly.
LONGEST = 96
#: Bytes of vectors of a block of the exact search, two of which meet in one task.
SEARCH_BYTES = 1 << 20
#: Standard deviations by which a code may mislead before a link is overlooked.
DOUBT = 5.5
#: Nodes of a label whose recall is audited, at least; 8 times the root of its size are added.
AUDITED = 128
#: Descents, each with lists twice as long, before a label whose recall stays low is compared exactly.
ATTEMPTS = 3
_FAR = 1 << 15
_FOUND = "cid long, ids binary, codes binary, dists binary"
_STATE = "part int, cid long, code binary, room int, news int, most int, nbrs array<long>, fresh array<boolean>, codes binary, dists binary"


def valid(embedding: Column, label: Column) -> Column:
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _unit(vectors: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), np.float32).astype(np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def within(threshold: float) -> int:
    """Differing bits up to which two vectors may be of that cosine or more."""
    p = math.acos(min(max(threshold, -1.0), 1.0)) / math.pi
    return min(BITS, math.ceil(BITS * p + DOUBT * math.sqrt(BITS * p * (1 - p))))


def _raw(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _differences(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of each row of x and each of y."""
    return np.bitwise_count(x[:, None] ^ y[None]).sum(2, dtype=np.int32)


def _found(cid: np.ndarray, near: np.ndarray, codes: np.ndarray, dists: np.ndarray) -> pa.Table:
    """One row for each cid: the candidates found for it."""
    order = np.argsort(cid, kind="stable")
    cid, near, codes, dists = cid[order], near[order], codes[order], dists[order]
    at = np.append(np.flatnonzero(np.concatenate([[True], cid[1:] != cid[:-1]])), len(cid)) if len(cid) else np.zeros(1, np.int64)
    columns = [pa.array(cid[at[:-1]], pa.int64()), binary_array(near.astype(np.int64), at * 8), binary_array(codes, at * 8 * WORDS), binary_array(dists.astype(np.uint16), at * 2)]
    return pa.Table.from_arrays(columns, ["cid", "ids", "codes", "dists"])


def with_codes(classes: DataFrame) -> DataFrame:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            vectors = b.column(3).to_pylist()
            codes: list[bytes] = [b""] * len(vectors)
            sizes = np.array([len(v) for v in vectors])
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                if size not in planes:
                    planes[size] = np.random.default_rng(size).standard_normal((size // 4, BITS))
                for s in range(0, len(rows), 1024):
                    own = rows[s : s + 1024]
                    for r, c in zip(own.tolist(), np.packbits(_unit([vectors[k] for k in own]) @ planes[size] > 0, axis=1), strict=True):
                        codes[r] = c.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes, pa.binary())], [*b.schema.names, "code"])

    return classes.select("cid", "label", "copies", "vec").mapInArrow(code, "cid long, label int, copies long, vec binary, code binary")


def first_lists(nodes: DataFrame, k: int, n: int, orders: int) -> DataFrame:
    """Candidates from blocks of neighbours in several orders, each by another run of 64 bits; a tie of codes is spread by a hash of the id."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, codes = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if len(ids) > 1:
                own, x = np.array(ids), np.frombuffer(b"".join(codes), U).reshape(-1, WORDS)
                d = _differences(x, x)
                np.fill_diagonal(d, _FAR)
                m = min(k, len(own) - 1)
                best = np.argpartition(d, m - 1, axis=1)[:, :m]
                yield from _found(np.repeat(own, m), own[best].ravel(), x[best].reshape(-1, WORDS), np.take_along_axis(d, best, 1).ravel()).to_batches()

        for b in batches:
            for label, run_, cid, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if key != (label, run_) or len(ids) >= BLOCK:
                    yield from flush()
                    key, ids, codes = (label, run_), [], []
                ids.append(cid)
                codes.append(c)
        yield from flush()

    # all orders in one pass, each row once for each order
    each = nodes.select("label", "bytes", "cid", "code", F.explode(F.sequence(F.lit(0), F.lit(orders - 1))).alias("t"))
    order = ["label", "bytes", "t", F.expr(f"substring(concat(code, code), 1 + pmod(11 * t, {BITS // 8}), 8)"), F.xxhash64("cid", "t")]
    dealt = each.repartitionByRange(max(6, -(-orders * n // 8192)), *order).sortWithinPartitions(*order)
    return dealt.select("label", (F.col("bytes") * orders + F.col("t")).alias("run"), "cid", "code").mapInArrow(meet, _FOUND)


def _merge(k: int, may: int):
    """Lists with the candidates found; of each node the nearest stay, as many as it has room for."""

    def merge(key: tuple, state: pa.Table, found: pa.Table) -> pa.Table:
        n = state.num_rows
        ids, room = state["cid"].to_numpy(), state["room"].to_numpy().copy()
        order = np.argsort(ids)
        lists = state["nbrs"].combine_chunks()
        sizes = np.asarray(lists.value_lengths()).astype(np.int64) if n else np.zeros(0, np.int64)
        owner, near, codes, dists = [np.repeat(np.arange(n), sizes)], [lists.flatten().to_numpy()], [_raw(state["codes"], U)], [_raw(state["dists"], np.uint16)]
        if n and found.num_rows:
            many = np.array([len(x) // 8 for x in found["ids"].to_pylist()])
            owner.append(np.repeat(order[np.minimum(np.searchsorted(ids[order], found["cid"].to_numpy()), n - 1)], many))
            near.append(_raw(found["ids"], np.int64))
            codes.append(_raw(found["codes"], U))
            dists.append(_raw(found["dists"], np.uint16))
        new = np.concatenate([np.zeros(len(owner[0]), bool), np.ones(len(owner[1]) if len(owner) > 1 else 0, bool)])
        o, v, d, c = np.concatenate(owner), np.concatenate(near), np.concatenate(dists), np.concatenate(codes).reshape(-1, WORDS)
        by = np.lexsort((new, v, o))  # an entry that the list has already comes first
        first = np.ones(len(by), bool)
        first[1:] = (o[by][1:] != o[by][:-1]) | (v[by][1:] != v[by][:-1])
        by = by[first]
        by = by[np.lexsort((v[by], d[by], o[by]))]
        rank = ranges(np.bincount(o[by], minlength=n)) if n else np.zeros(0, np.int64)
        most = np.full(n, _FAR)
        while True:
            inside = by[rank < room[o[by]]]
            size = np.bincount(o[inside], minlength=n)
            worst = np.zeros(n, np.int64)
            np.maximum.at(worst, o[inside], d[inside].astype(np.int64))
            grow = (size >= room) & (worst <= may) & (room < LONGEST)
            if not grow.any():
                break
            room[grow] = np.minimum(room[grow] * 2, LONGEST)
        most[size >= room] = worst[size >= room]
        fresh = new[inside] | (room > state["room"].to_numpy())[o[inside]]
        at = np.concatenate([[0], np.cumsum(size)])
        columns = [state["part"], state["cid"], state["code"], pa.array(room, pa.int32()), pa.array(np.bincount(o[inside], fresh, n).astype(np.int32)), pa.array(most.astype(np.int32))]
        columns += [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x)) for x in (v[inside], fresh)]
        columns += [binary_array(c[inside], at * 8 * WORDS), binary_array(d[inside], at * 2)]
        return pa.Table.from_arrays(columns, ["part", "cid", "code", "room", "news", "most", "nbrs", "fresh", "codes", "dists"])

    return merge


def merged(state: DataFrame, found: DataFrame, parts: int, k: int, may: int) -> DataFrame:
    right = found.select(part_column(F.col("cid"), parts).alias("part"), "cid", "ids", "codes", "dists")
    return state.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(_merge(k, may), _STATE)


def descend(state: DataFrame, parts: int, turn: int) -> DataFrame:
    """Candidates found where nodes meet at a common neighbour: those that have it in their lists, itself, and its own list."""

    def meet(key: tuple, state: pa.Table, sent: pa.Table) -> pa.Table:
        ids = state["cid"].to_numpy()
        lists = state["nbrs"].combine_chunks()
        sizes = np.asarray(lists.value_lengths()).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        near, fresh = lists.flatten().to_numpy(), lists_of_bool(state["fresh"])
        codes, code, most = _raw(state["codes"], U).reshape(-1, WORDS), _raw(state["code"], U).reshape(-1, WORDS), state["most"].to_numpy()
        place = {x: i for i, x in enumerate(ids.tolist())}
        x, salt, u = sent["x"].to_numpy(), sent["salt"].to_numpy(), sent["u"].to_numpy()
        s_code, s_most, s_fresh = _raw(sent["code"], U).reshape(-1, WORDS), sent["most"].to_numpy(), sent["fresh"].to_numpy()
        order = np.lexsort((u, salt, x))
        cuts = np.append(np.flatnonzero(np.concatenate([[True], (x[order][1:] != x[order][:-1]) | (salt[order][1:] != salt[order][:-1])])), len(x)) if len(x) else np.zeros(1, np.int64)
        groups = {(int(x[order[i]]), int(salt[order[i]])): order[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)}
        groups |= {(c, 0): order[:0] for c, i in place.items() if (c, 0) not in groups and fresh[at[i] : at[i + 1]].any()}
        out = []
        for (c, z), come in groups.items():
            for b in range(0, max(len(come), 1), BLOCK):
                who = come[b : b + BLOCK]
                m_id, m_code, m_most, m_fresh = u[who], s_code[who], s_most[who], s_fresh[who]
                t_id, t_code, t_fresh = m_id, m_code, m_fresh
                if not z and not b and c in place:
                    i = place[c]
                    own = slice(at[i], at[i + 1])
                    m_id, m_code, m_most, m_fresh = np.append(m_id, c), np.concatenate([m_code, code[i : i + 1]]), np.append(m_most, most[i]), np.append(m_fresh, False)
                    t_id, t_code, t_fresh = np.concatenate([m_id, near[own]]), np.concatenate([m_code, codes[own]]), np.concatenate([m_fresh, fresh[own]])
                if not t_fresh.any():
                    continue
                d = _differences(m_code, t_code)
                good = (d < m_most[:, None]) & (m_fresh[:, None] | t_fresh[None]) & (m_id[:, None] != t_id[None])
                p, q = np.nonzero(good)
                if len(p):
                    out.append((m_id[p], t_id[q], t_code[q], d[p, q]))
        if not out:
            return _found(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, WORDS), U), np.zeros(0, np.uint16))
        cid, v, c, d = (np.concatenate([r[i] for r in out]) for i in range(4))
        # of one task's finds each node gets the nearest, no more than a list may hold
        by = np.lexsort((v, cid))
        first = np.ones(len(by), bool)
        first[1:] = (cid[by][1:] != cid[by][:-1]) | (v[by][1:] != v[by][:-1])
        by = by[first]
        by = by[np.lexsort((v[by], d[by], cid[by]))]
        starts = np.flatnonzero(np.concatenate([[True], cid[by][1:] != cid[by][:-1]]))
        by = by[ranges(np.diff(np.append(starts, len(by)))) < LONGEST]
        return _found(cid[by], v[by], c[by], d[by])

    sent = state.select(F.explode(F.arrays_zip("nbrs", "fresh")).alias("e"), F.col("cid").alias("u"), F.col("code").alias("code"), F.col("most").alias("most")).select(F.col("e.nbrs").alias("x"), "u", "code", "most", F.col("e.fresh").alias("fresh"))
    busy = sent.groupBy(F.col("x").alias("h")).count().filter(F.col("count") > BLOCK).select("h", F.ceil(F.col("count") / BLOCK).alias("salts"))
    salt = F.pmod(F.xxhash64("u", F.lit(turn)), F.coalesce("salts", F.lit(1))).cast("int")
    keyed = sent.join(busy, F.col("x") == F.col("h"), "left").withColumn("salt", salt)
    # the rest of a hub's visitors meet elsewhere
    where = part_column(F.when(F.col("salt") == 0, F.col("x")).otherwise(F.xxhash64("x", "salt")), parts)
    keyed = keyed.select(where.alias("part"), "salt", "x", "u", "code", "most", "fresh")
    own = state.select("part", "cid", "code", "most", "nbrs", "fresh", "codes")
    return own.groupBy("part").cogroup(keyed.groupBy("part")).applyInArrow(meet, _FOUND)


def lists_of_bool(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(bool)


def _entries(state: DataFrame) -> DataFrame:
    """(cid, v, d): every entry of the lists, with its differing bits."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.asarray(b.column(1).value_lengths()).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), sizes)), pa.array(b.column(1).flatten().to_numpy()), pa.array(np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint16).astype(np.int32))], ["cid", "v", "d"])

    return state.select("cid", "nbrs", "dists").mapInArrow(flat, "cid long, v long, d int")


def verified(pairs: DataFrame, nodes: DataFrame, parts: int, threshold: float) -> DataFrame:
    """Of distinct pairs (a, b) the links. The vector of a travels to the part of b."""

    def compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        ids = right["cid"].to_numpy()
        order = np.argsort(ids)
        b = left["b"].to_numpy()
        spot = order[np.minimum(np.searchsorted(ids[order], b), len(ids) - 1)]
        x, y = left["vec"].to_pylist(), right["vec"].to_pylist()
        keep = np.zeros(len(b), bool)
        fits = np.array([ids[s] == c and len(v) == len(y[s]) for v, s, c in zip(x, spot.tolist(), b.tolist(), strict=True)])
        sizes = np.array([len(v) for v in x])
        for size in np.unique(sizes[fits]).tolist():
            rows = np.flatnonzero(fits & (sizes == size))
            step = max(1, (4 << 20) // size)
            for s in range(0, len(rows), step):
                own = rows[s : s + step]
                keep[own] = np.einsum("ij,ij->i", _unit([x[i] for i in own]), _unit([y[spot[i]] for i in own])) >= threshold
        return pa.table({"a": left["a"].to_numpy()[keep], "b": b[keep]}, schema=schema)

    carried = pairs.join(nodes.select(F.col("cid").alias("a"), F.col("vec").alias("vec")), "a").select(part_column(F.col("b"), parts).alias("part"), "a", "b", "vec")
    whole = nodes.select(part_column(F.col("cid"), parts).alias("part"), "cid", "vec")
    return carried.groupBy("part").cogroup(whole.groupBy("part")).applyInArrow(compare, "a long, b long")


def found_links(state: DataFrame, full: DataFrame, nodes: DataFrame, parts: int, threshold: float) -> DataFrame:
    """(a, b): links among the lists' entries, but for those of two saturated nodes."""
    near = _entries(state).filter(F.col("d") <= within(threshold))
    pairs = near.join(full.select(F.col("cid").alias("f")), F.col("cid") == F.col("f"), "left").join(full.select(F.col("cid").alias("g")), F.col("v") == F.col("g"), "left")
    pairs = pairs.filter("f is null or g is null").select(F.least("cid", "v").alias("a"), F.greatest("cid", "v").alias("b")).distinct()
    return verified(pairs, nodes, parts, threshold)


def saturated(state: DataFrame, threshold: float) -> DataFrame:
    """(cid, nbrs) of the nodes whose longest lists hold nothing but possible links."""
    return state.filter((F.col("room") >= LONGEST) & (F.col("most") <= within(threshold))).select("cid", "nbrs")


def audit(nodes: DataFrame, links: DataFrame, full: DataFrame, threshold: float) -> DataFrame:
    """(label, bytes, links, recall): the sampled nodes' links, and the share of them that was found, for each label and length of vectors.

    Two samples that grow with the label, one of all nodes and one of those with a link; the lesser share counts. Saturated
    nodes are in neither: `exact_search` finds their links. Without a link there is no row."""
    group = ["label", "bytes"]
    held = links.select(F.col("a").alias("cid")).union(links.select("b")).groupBy("cid").agg(F.count("*").alias("held"))
    rest = nodes.select(*group, "cid", "vec").join(full.select("cid"), "cid", "left_anti").join(held, "cid", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    sizes = rest.groupBy(*group).agg(F.count("*").alias("size"), F.count_if(F.col("held") > 0).alias("linked"))
    # a node's place in [0, 1) by a hash of its id
    place = F.pmod(F.xxhash64("cid", F.lit(97)), F.lit(1 << 30)) / (1 << 30)
    want = AUDITED + 8 * F.sqrt("size")
    sample = rest.join(sizes, group).withColumns({"any": place * F.col("size") < want, "some": (F.col("held") > 0) & (place * F.col("linked") < want)}).filter("any or some").select(*group, "cid", "held", "any", "some")
    asking = nodes.join(sample.select("cid", F.lit(True).alias("ask")), "cid", "left").join(sizes.select(*group), group, "left_semi")
    asking = asking.select(*group, F.lit(-1).cast("long").alias("g"), "cid", F.lit(1).cast("long").alias("copies"), "vec", F.coalesce("ask", F.lit(False)).alias("ask"), F.lit(True).alias("counts"))
    true = exact_search(asking, threshold, joins=False).groupBy("cid").agg(F.sum("n").alias("true"))
    total = lambda c, s: F.sum(F.when(F.col(s), F.col(c)))
    return sample.join(true, "cid").groupBy(*group).agg(total("true", "any").alias("links"), F.least(*(total("held", s) / total("true", s) for s in ("any", "some"))).alias("recall"))


def near_pivots(nodes: DataFrame, full: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """The saturated nodes' groups as `exact_search` takes them: of each pivot its own nodes, which ask, and all that may link with one of them."""
    group = ["label", "bytes"]
    # a node's pivot is the least of its list's least node's list; any grouping is right, this one gathers near nodes
    first = full.select("cid", F.least("cid", F.array_min("nbrs")).alias("g"))
    second = first.select(F.col("cid").alias("g"), F.col("g").alias("h"))
    pivot_of = scratch.save(first.join(second, "g", "left").select("cid", F.coalesce("h", "g").alias("g")))
    asked = nodes.join(pivot_of, "cid")
    pivots = nodes.join(pivot_of.select(F.col("g").alias("cid")).distinct(), "cid", "left_semi").select(F.col("cid").alias("g"), F.col("vec").alias("p"))

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cut = lambda k, b=b: [x[: 4 * (len(x) // 4)] for x in b.column(k).to_pylist()]
                x, p = cut(1), cut(2)
                angle = [float(np.arccos(np.clip((_unit([v]) @ _unit([w]).T)[0, 0], -1, 1))) if len(v) == len(w) else 0.0 for v, w in zip(x, p, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(angle)], ["g", "angle"])

    wide = asked.select("g", "vec").join(pivots, "g").select("g", "vec", "p").mapInArrow(angles, "g long, angle double").groupBy("g").agg(F.max("angle").alias("wide"))
    pivots = scratch.save(pivots.join(wide, "g").join(nodes.select(F.col("cid").alias("g"), *group), "g"))
    blocks = lambda df, c: df.groupBy(*group).agg(F.ceil(F.count("*") * F.col("bytes") / SEARCH_BYTES).cast("int").alias(c))
    room = blocks(pivots, "pivots").join(blocks(nodes, "others"), group)
    spread = lambda df, c, own, other: df.join(room, group).withColumns({own: F.pmod(F.xxhash64(c), F.col(own)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col(other) - 1))})
    left = spread(pivots.select(*group, "g", "p", "wide"), "g", "pivots", "others").withColumnsRenamed({"pivots": "i", "others": "j"})
    right = spread(nodes.select(*group, "cid", "copies", "vec"), "cid", "others", "pivots").withColumnsRenamed({"pivots": "i", "others": "j"})
    reach = math.acos(threshold) + 1e-6

    def near(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("g", pa.int64()), ("cid", pa.int64()), ("copies", pa.int64()), ("vec", pa.binary())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        right = right.select(["cid", "copies", "vec"]).combine_chunks()
        x, p, g = _unit(right["vec"].to_pylist()), _unit(left["p"].to_pylist()), left["g"].to_numpy()
        least = np.cos(np.minimum(left["wide"].to_numpy() + reach, math.pi)) - 1e-9
        a, b = np.nonzero(x @ p.T >= least)
        return right.take(pa.array(a)).add_column(0, "g", pa.array(g[b])).cast(schema)

    met = left.groupBy(*group, "i", "j").cogroup(right.groupBy(*group, "i", "j")).applyInArrow(near, "g long, cid long, copies long, vec binary")
    met = met.join(pivot_of.select("cid", F.col("g").alias("own")), "cid", "left").join(pivots.select("g", *group), "g")
    ask = F.coalesce(F.col("own") == F.col("g"), F.lit(False))
    return met.select(*group, "g", "cid", "copies", "vec", ask.alias("ask"), (ask | F.col("own").isNull()).alias("counts"))


def exact_search(nodes: DataFrame, threshold: float, joins: bool = True) -> DataFrame:
    """All linked pairs of a group with an end that asks, by pairs of blocks. nodes: (label, bytes, g, cid, copies, vec, ask, counts).

    Rows (cid, n, a, b), never pairs: n linked vectors of cid, where it counts, in one pair of blocks; or a link (a, b). Of a task's links only
    a spanning forest comes back, without joins none."""
    group = ["label", "bytes", "g"]

    def compare(table: pa.Table) -> pa.Table:
        x, ids, copies, counts = _unit(table["vec"].to_pylist()), table["cid"].to_numpy(), table["copies"].to_numpy(), table["counts"].to_numpy()
        block, i, j = table["block"].to_numpy(), table["i"][0].as_py(), table["j"][0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        root, n = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        step = max(1, (1 << 21) // max(1, len(right)))
        for s in range(0, len(left), step):
            rows = left[s : s + step]
            near = x[rows] @ x[right].T >= threshold
            if i == j:
                near &= np.arange(len(right)) > np.arange(s, s + len(rows))[:, None]
            p, q = np.nonzero(near)
            p, q = rows[p], right[q]
            n += np.bincount(p, copies[q], len(ids)).astype(np.int64) + np.bincount(q, copies[p], len(ids)).astype(np.int64)
            if joins:
                _join(root, p, q)
        some, joined = np.flatnonzero((n > 0) & counts), np.flatnonzero(root != np.arange(len(root)))
        none = lambda k: pa.nulls(k, pa.int64())
        columns = [(pa.array(ids[some]), none(len(joined))), (pa.array(n[some]), none(len(joined))), (none(len(some)), pa.array(ids[joined])), (none(len(some)), pa.array(ids[root[joined]]))]
        return pa.table({k: pa.chunked_array(v, pa.int64()) for k, v in zip(("cid", "n", "a", "b"), columns, strict=True)})

    of = lambda ask: F.ceil(F.count_if(F.col("ask") == ask) * F.col("bytes") / SEARCH_BYTES).cast("int")
    sizes = nodes.groupBy(*group).agg(of(True).alias("asking"), of(False).alias("others")).filter("asking > 0")
    m = nodes.join(sizes, group)
    # blocks of those that ask come first and meet all blocks; the others meet them only
    m = m.withColumn("block", F.when(F.col("ask"), F.pmod(F.xxhash64("cid"), F.col("asking"))).otherwise(F.col("asking") + F.pmod(F.xxhash64("cid"), F.greatest("others", F.lit(1)))).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("ask"), F.col("asking") + F.col("others")).otherwise(F.col("asking")) - 1)))
    m = m.select(*group, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cid", "copies", "vec", "counts")
    return m.groupBy(*group, "i", "j").applyInArrow(compare, "cid long, n long, a long, b long")


def _join(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Let the linked u and v have one root, the least."""
    while True:
        x, y = root[u], root[v]
        differ = x != y
        if not differ.any():
            return
        u, v, x, y = u[differ], v[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root[:] = root[root]


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, k: int = 12, rounds: int = 8, least_recall: float = 0.97) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("e"), F.col("label").cast("int").alias("label"))
    fit = rows.filter(valid(F.col("e"), F.col("label")))
    # a class is named by its smallest vec_id; by a hash of the vector where it has none or shares it with another class
    classes = scratch.save(fit.groupBy("label", "e").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")))
    twice = classes.groupBy(F.col("id").alias("t")).count().filter("count > 1 and t is not null").select("t")
    classes = classes.join(twice, F.col("id") == F.col("t"), "left")
    name = F.when(F.col("id").isNull() | F.col("t").isNotNull(), F.xxhash64("label", "e")).otherwise(F.col("id"))
    classes = scratch.save(classes.select(name.alias("cid"), "id", "label", "copies", "e"))
    pack = lambda batches: (pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([np.array(x, np.float32).tobytes() for x in b.column(3).to_pylist()], pa.binary())], ["cid", "label", "copies", "vec"]) for b in batches)
    nodes = with_codes(classes.select("cid", "label", "copies", "e").mapInArrow(pack, "cid long, label int, copies long, vec binary"))
    nodes = scratch.save(nodes.withColumn("bytes", F.length("vec")))
    group = ["label", "bytes"]
    n, largest = nodes.groupBy(*group).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    parts, may = max(25, -(-n // 2048) | 1), within(threshold)
    empty = F.array()
    start = nodes.select(part_column(F.col("cid"), parts).alias("part"), "cid", "code", F.lit(k).alias("room"), F.lit(0).alias("news"), F.lit(_FAR).alias("most"), empty.cast("array<long>").alias("nbrs"), empty.cast("array<boolean>").alias("fresh"), F.lit(b"").alias("codes"), F.lit(b"").alias("dists"))
    # the more blocks a label has, the less often two links share one
    orders = 3 + max(0, math.ceil(math.log2(max(largest, 1) / BLOCK))) // 2
    state = scratch.save(merged(start, first_lists(nodes, k, n, orders), parts, k, may))
    failed = links = full = None
    for attempt in range(ATTEMPTS):
        for turn in range(rounds):
            if (state.agg(F.sum("news")).first()[0] or 0) <= 0.003 * n * k:
                break
            now = scratch.save(merged(state, descend(state, parts, rounds * attempt + turn), parts, k, may))
            scratch.drop(state)
            state = now
        full = scratch.save(saturated(state, threshold))
        links = scratch.save(found_links(state, full, nodes, parts, threshold))
        audited = scratch.save(audit(nodes, links, full, threshold))
        figures = audited.agg(F.count("*"), F.sum("links"), F.min("recall")).first()
        log.info("recall audited in %s labels over %s links: %s at least", *figures)
        failed = scratch.save(audited.filter(F.col("recall") < least_recall).select(*group))
        if attempt == ATTEMPTS - 1 or not failed.limit(1).count():
            break
        again = nodes.join(failed, group, "left_semi").select(F.col("cid").alias("w"))
        wider = state.join(again, F.col("cid") == F.col("w"), "left").withColumns({"room": F.when(F.col("w").isNotNull(), F.least(F.col("room") * 2, F.lit(LONGEST))).otherwise(F.col("room")), "fresh": F.transform("fresh", lambda x: x | F.col("w").isNotNull())})
        wider = wider.withColumns({"news": F.size(F.filter("fresh", lambda x: x)), "most": F.when(F.col("w").isNotNull(), _FAR).otherwise(F.col("most"))})
        state = scratch.save(wider.drop("w"))
    # exactly compared: whole labels that failed the audit, and saturated nodes of the others
    whole = nodes.join(failed, group, "left_semi")
    full = scratch.save(full.join(whole.select("cid"), "cid", "left_anti"))
    yes = F.lit(True)
    asking = whole.select(*group, F.lit(-1).cast("long").alias("g"), "cid", "copies", "vec", yes.alias("ask"), yes.alias("counts"))
    if full.limit(1).count():
        asking = asking.unionByName(near_pivots(nodes.join(failed, group, "left_anti"), full, threshold, scratch))
    found = scratch.save(exact_search(scratch.save(asking), threshold))
    label = components(links.unionByName(found.filter("a is not null").select("a", "b")), scratch)
    asked = scratch.save(whole.select(F.col("cid").alias("asked")).union(full.select("cid")))
    both = links.join(asked, F.col("a") == F.col("asked"), "left_anti").join(asked, F.col("b") == F.col("asked"), "left_anti")
    both = both.union(both.select("b", "a"))
    listed = both.join(nodes.select(F.col("cid").alias("b"), "copies"), "b").select(F.col("a").alias("cid"), F.col("copies").alias("n"))
    counts = found.filter("cid is not null").select("cid", "n").unionByName(listed).groupBy("cid").agg(F.sum("n").alias("n"))
    per_class = classes.join(counts, "cid", "left").join(label, F.col("cid") == F.col("node"), "left").withColumn("c", F.coalesce("component", "cid"))
    per_class = scratch.save(per_class.select("cid", "id", "label", "e", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "c"))
    # classes that share an id, by rows of equal vec_id, keep components of their own; a component is named by its smallest id
    least = per_class.groupBy("c").agg(F.min("id").alias("component_id"))
    per_class = per_class.join(least, "c").select("label", "e", "n_links", "component_id")
    named = rows.withColumn("ok", valid(F.col("e"), F.col("label"))).alias("r").join(per_class.alias("k"), F.col("r.ok") & (F.col("r.label") == F.col("k.label")) & (F.col("r.e") == F.col("k.e")), "left")
    out = named.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("vec_id")))
