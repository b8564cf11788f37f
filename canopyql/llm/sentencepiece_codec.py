"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

Blanks become marks and one mark stands before the text; each run of marks with what follows it is a marked word, which no
piece crosses. The distinct marked words of a batch are sorted, which walks their trie depth first: a word keeps the
forward states of the prefix that it shares with the one before it and computes only the rest.

The vocabulary at hand is of kind BPE, so the forward state of a prefix is not a sum of scores but the last piece of the
prefix's own encoding: the one suffix in the vocabulary that stays apart from the state before it when the two are merged
by score. This is unique, so the pass gives the library's own ids (tests compare them). For a unigram vocabulary the state
is the best sum of scores, as usual. Characters outside the vocabulary become byte ids.

Cases: a null or empty text has no ids and decodes to the empty text; a literal mark decodes to a blank, as in the
library; repeated rows are encoded each; an empty table gives no rows; extra columns are ignored. Encoding is linear in
the text; memory is one Arrow batch, a cache of at most a million words and the states of one word.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .token_cache import TokenCache, gather
from .words import chunks, span_hashes, text_buffer

MARK = "▁"
NORMAL, USER_DEFINED, BYTE, BPE = 1, 4, 6, 2
SCHEMA = "doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean"


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, model: bytes, pairs: int = 2_000_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only identity normalisation with a leading mark is supported")
        self.bpe = proto.trainer_spec.model_type == BPE
        self.byte_id = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        usable = [(i, p.piece, p.score) for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER_DEFINED)]
        if any(MARK in p.lstrip(MARK) for _, p, _ in usable):
            raise ValueError("a piece crosses words")
        self.score = {p: s for _, p, s in usable}
        self.id = {p: i for i, p, _ in usable}
        self.longest = max((len(p) for p in self.id), default=1)
        self.pairs, self._apart = pairs, {}
        text = [bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else p.piece.replace(MARK, " ").encode() if p.type in (NORMAL, USER_DEFINED) else b"" for p in proto.pieces]
        self.flat = np.frombuffer(b"".join(text), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in text])])
        self.is_byte = np.array([p.type == BYTE for p in proto.pieces])
        self.reachable = {p for p in self.id if self._merge(p) == [p]} if self.bpe else set(self.id)

    def _merge(self, text: str) -> list[str]:
        """Merges by score, the leftmost first among equals: the definition, for one or two pieces."""
        parts, score = list(text), self.score
        while True:
            found = [(-score[x], k) for k in range(len(parts) - 1) if (x := parts[k] + parts[k + 1]) in score]
            if not found:
                return parts
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def apart(self, a: str, b: str) -> bool:
        """Do two pieces stay two when they are merged together?"""
        key = (a, b)
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) >= self.pairs:
                self._apart.clear()
            known = self._apart[key] = self._merge(a + b) == [a, b]
        return known

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of marked words, in the order given; the words are visited in sorted order."""
        out: list[list[int]] = [[]] * len(words)
        size: list[int] = []  # of the last piece of each prefix
        piece: list[str | None] = []  # that piece; None: a character outside the vocabulary
        best: list[float] = [0.0]
        before = ""
        for w in sorted(range(len(words)), key=words.__getitem__):
            word, k = words[w], 0
            most = min(len(word), len(before))
            if word[:most] == before[:most]:
                k = most
            else:
                while word[k] == before[k]:
                    k += 1
            del size[k:], piece[k:], best[k + 1 :]
            self._extend(word, k, size, piece, best)
            ids, p = [], len(word)
            while p:
                s = piece[p - 1]
                if s is None:
                    raw = word[p - 1].encode("utf-8", "replace")
                    ids += [self.byte_id.get(x, self.unknown) for x in reversed(raw)] if self.byte_id else [self.unknown]
                else:
                    ids.append(self.id[s])
                p -= size[p - 1]
            out[w] = ids[::-1]
            before = word
        return out

    def _extend(self, word: str, k: int, size: list, piece: list, best: list) -> None:
        vocabulary, apart = self.reachable, self.apart
        for p in range(k + 1, len(word) + 1):
            top, pick = float("-inf"), None
            for n in range(min(p, self.longest), 0, -1):
                s = word[p - n : p]
                if s not in vocabulary:
                    continue
                if self.bpe:
                    last = piece[p - n - 1] if p > n else None
                    if last is None or apart(last, s):
                        pick = s
                        break
                elif (v := best[p - n] + self.score[s]) > top:
                    top, pick = v, s
            piece.append(pick)
            size.append(len(pick) if pick else 1)
            best.append(top if pick else best[p - 1] - 100.0)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text of each row of ids as UTF-8, end to end, and the offsets; the leading mark's blank is dropped."""
        raw, sizes = gather(self.flat, self.offsets, ids.astype(np.int64))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = ends[np.concatenate([[0], np.cumsum(counts)])]
        first = at[:-1][np.diff(at) > 0]
        return np.delete(raw, first), at - np.concatenate([[0], np.cumsum(np.diff(at) > 0)])


@functools.cache
def _codec(path: str) -> tuple[Codec, TokenCache]:
    with open(path, "rb") as f:
        c = Codec(f.read())
    return c, TokenCache(lambda spans: c.encode_words([s.decode("utf-8", "replace").replace(" ", MARK) for s in spans]))


def batch_ids(path: str, offsets: np.ndarray, data: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the rows i to j and how many each row has."""
    docs = offsets[i : j + 1] - offsets[i]
    full = np.diff(docs) > 0
    data = np.insert(data[offsets[i] : offsets[j]], docs[:-1][full], 0x20)
    docs = docs + np.concatenate([[0], np.cumsum(full)])
    blank = data == 0x20
    opens = blank.copy()
    opens[1:] &= ~blank[:-1]
    opens[docs[:-1][full]] = True
    start = np.flatnonzero(opens)
    end = np.append(start[1:], len(data))
    ids, counts = _codec(path)[1].ids(data, start, end, span_hashes(data, start, end))
    upto = np.concatenate([[0], np.cumsum(counts)])
    return ids, np.diff(upto[np.searchsorted(start, docs)])


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffer(pc.replace_substring(batch.column(1), MARK, " "))
            for i, j in chunks(offsets):
                ids, counts = batch_ids(model, offsets, data, i, j)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows of ids; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array(x.as_py() or [], np.int64) for x in batch.column(1)]
            counts = np.array([len(r) for r in rows], np.int64)
            raw, at = _codec(model)[0].decode(np.concatenate([*rows, np.zeros(0, np.int64)]), counts)
            texts = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def report(docs: DataFrame, model: str) -> DataFrame:
    """Counts and checksum of each document's ids, and what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffer(pc.replace_substring(batch.column(1), MARK, " "))
            for i, j in chunks(offsets):
                codec = _codec(model)[0]
                ids, counts = batch_ids(model, offsets, data, i, j)
                raw, at = codec.decode(ids, counts)
                upto = np.concatenate([[0], np.cumsum(counts)])
                n_byte = np.diff(np.concatenate([[0], np.cumsum(codec.is_byte[ids])])[upto])
                own, text, source = memoryview(ids.astype("<u4")).cast("B") if len(ids) else b"", raw.tobytes(), data[offsets[i] : offsets[j]].tobytes()
                crc = [zlib.crc32(own[4 * a : 4 * b]) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
                spans = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
                sha = [hashlib.sha256(text[a:b]).hexdigest() for a, b in spans]
                was = (offsets[i : j + 1] - offsets[i]).tolist()
                same = [text[a:b] == source[c:d] for (a, b), c, d in zip(spans, was[:-1], was[1:], strict=True)]
                out = [batch.column(0).slice(i, j - i), pa.array(counts, pa.int64()), pa.array(n_byte, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha), pa.array(same)]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "decoded_sha256", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
