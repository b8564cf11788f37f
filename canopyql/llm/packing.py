"""Packing by power-of-two decomposition.

A document's ids, with one end id, are cut into as many full sequences as fit and then into the binary digits of the rest,
so that every piece's length is a power of two. A piece is a sequence of its own: nothing is padded, no sequence crosses
documents, and equal lengths stand in one bucket (``bucket`` = log2 of the length), from which a trainer draws batches of
one shape. No row moves between partitions.

Texts are cut before each run of blanks into spans that the tokenizer treats independently of each other; a distinct span
is encoded once and gathered for all its places. A document with other Unicode white space is encoded whole, and so is every
document where the tokenizer doesn't cut at blanks itself (`_cuts_at_blanks`). The tokenizer is used as its file says: a special token's
string in a text gives that token's id.

Cases: a null or empty text gives one piece, the end id; repeated rows give their pieces each, in sequences of their own;
an empty table gives no rows; extra columns are ignored. Memory: one Arrow batch and the ids of about 2 MB of text.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_cache import TokenCache
from .words import Words, chunks, span_hashes, text_buffer

#: White space beyond ASCII, in UTF-8.
WIDE_BLANK = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    encode = lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    return encode, TokenCache(lambda spans: encode([s.decode("utf-8", "replace") for s in spans])), _cuts_at_blanks(json.loads(t.to_str()))


def _cuts_at_blanks(spec: dict) -> bool:
    """Whether ids of a span don't depend on its neighbours: byte-level words, no normaliser, no added token that looks at or holds blanks."""
    words = spec.get("pre_tokenizer") or {}
    plain = words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space") and not spec.get("normalizer")
    return plain and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or re.search(r"\s", a["content"]) for a in spec["added_tokens"])


def document_ids(path: str, offsets: np.ndarray, data: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the rows i to j, end to end, and the offsets of each document."""
    encode, cache, cuts = _tokenizer(path)
    if not cuts:
        rows = encode([data[a:b].tobytes().decode() for a, b in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist(), strict=True)])
        return np.array([x for r in rows for x in r], np.uint32), np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)])
    w = Words(offsets, data, i, j)
    docs = w.docs
    first = w.words[:-1][np.diff(w.words) > 0]
    start = np.concatenate([[0], w.end[:-1]]) if len(w.end) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(j - i), np.diff(w.words))
    start[first] = docs[owner[first]]
    last_end = docs[:-1].copy()
    has = np.flatnonzero(np.diff(w.words))
    last_end[has] = w.end[w.words[has + 1] - 1]
    tail = np.flatnonzero(last_end < docs[1:])
    start, end = np.concatenate([start, last_end[tail]]), np.concatenate([w.end, docs[tail + 1]])
    owner = np.concatenate([owner, tail])
    order = np.argsort(end, kind="stable")
    start, end, owner = start[order], end[order], owner[order]
    ids, counts = cache.ids(w.data, start, end, span_hashes(w.data, start, end))
    sizes = np.bincount(owner, counts, j - i).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    raw = w.data.tobytes()
    if WIDE_BLANK.search(raw):
        rows = [ids[at[k] : at[k + 1]] for k in range(j - i)]
        for k in range(j - i):
            if WIDE_BLANK.search(text := raw[docs[k] : docs[k + 1]]):
                rows[k] = np.array(encode([text.decode()])[0], np.uint32)
        at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        ids = np.concatenate(rows) if rows else ids
    return ids, at


def piece_lengths(n: int, most: int) -> list[int]:
    """Lengths of the pieces of n ids: full ones, then the binary digits of the rest from the largest."""
    full, rest = divmod(n, most)
    return [most] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, most: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece; with_ids adds the ids themselves. `most` is a power of two. Sequence ids are unique, not dense."""
    if most < 1 or most & (most - 1):
        raise ValueError("most must be a power of two")
    fields = SCHEMA + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, (offsets, data) = batch.column(0), text_buffer(batch.column(1))
            for i, j in chunks(offsets):
                ids, at = document_ids(tokenizer, offsets, data, i, j)
                owner, start, length, crc, total, kept = [], [], [], [], [], []
                for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    own = np.append(ids[a:b], end_id).astype("<u4")
                    view, s = memoryview(own).cast("B"), 0
                    for n in piece_lengths(len(own), most):
                        owner.append(i + k)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(view[4 * s : 4 * (s + n)]))
                        total.append(len(own))
                        if with_ids:
                            kept.append(own[s : s + n].astype(np.int32))
                        s += n
                out = [keys.take(pa.array(owner, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    out.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, fields)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.round(F.log2("length")).cast("int")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Parquet with one folder for each length."""
    pieces.write.mode("overwrite").partitionBy("bucket").parquet(path)
