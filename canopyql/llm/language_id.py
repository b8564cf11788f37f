"""Language identification, words first.

A word (a run of letters, lower-cased) that the training rows know is scored by its log frequency in each language. An
unseen word falls back to character n-grams: of the longest order, from 5 down to 1, of which it holds a known one, with marks at its
ends. A document's language has the largest sum; the score is its share under a softmax of the mean of at most 20 words' weight.

Training counts words of at most ``MOST_ROWS`` rows of each language (those whose hash falls under a threshold) that are not held out, so that a rare language
is learned at any size of the corpus, and of the ``MOST_LANGS`` languages of the most rows; the model keeps the most frequent ``MOST_WORDS`` words and ``MOST_GRAMS`` n-grams of each order, fewer where
``MOST_CELLS`` over the number of languages is less, which bounds what the driver gets and sends. Whole texts are counted and scored; one beyond 2 MB in parts.

Cases: null texts and texts without a letter are ``und`` with score 0, as is everything if there is no training row; ties go to the
language that sorts first; repeated rows are judged each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Scratch
from .words import CHUNK_BYTES, span_hashes

ORDERS = (5, 4, 3, 2, 1)
#: Training rows of a language, and words and n-grams of an order that the model keeps, at most.
MOST_ROWS, MOST_WORDS, MOST_GRAMS = 2_000, 200_000, 100_000
#: Languages that are learned at most, those of the most rows.
MOST_LANGS = 1_000
#: Frequencies of an order that the model keeps, at most, over all languages.
MOST_CELLS = 4_000_000
#: Words that a document's total is spread over at most, for the softmax.
WEIGHT = 20
_letters: dict[str, np.ndarray] = {}
_SPACE = re.compile(r"\s+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def _letter_table() -> np.ndarray:
    if not len(_letters):
        _letters["t"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters["t"]


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, starts and ends of their words, and the offsets of each text's words."""
    low = [(t or "").lower() for t in texts]
    points = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _letter_table()[points]
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    at = np.cumsum([0, *(len(t) + 1 for t in low)])
    return points, start, end, np.searchsorted(start, at)


def grams(points: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of words with a mark at each end, and the word of each."""
    sizes = end - start + 2
    at = np.concatenate([[0], np.cumsum(sizes)])
    buffer = np.zeros(at[-1], np.uint32)
    word = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(at[-1]) - at[word]
    inner = (place > 0) & (place < sizes[word] - 1)
    buffer[inner] = points[(start[word] + place - 1)[inner]]
    first = np.flatnonzero(place + n <= sizes[word])
    return span_hashes(buffer, first, first + n), word[first]


@dataclass
class Model:
    langs: list[str]
    words: np.ndarray  # sorted hashes
    word_logs: np.ndarray  # one row for each
    gram_hashes: dict[int, np.ndarray]
    gram_logs: dict[int, np.ndarray]

    def word_scores(self, points: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Log frequencies of distinct words."""
        out = np.zeros((len(hashes), len(self.langs)))
        spot = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        known = self.words[spot] == hashes
        out[known] = self.word_logs[spot[known]]
        rest = np.flatnonzero(~known)
        for n in ORDERS:
            if not len(rest):
                break
            table = self.gram_hashes[n]
            if not len(table):
                continue
            h, word = grams(points, start[rest], end[rest], n)
            spot = np.minimum(np.searchsorted(table, h), len(table) - 1)
            hit = table[spot] == h
            count = np.bincount(word[hit], minlength=len(rest))
            logs = self.gram_logs[n][spot[hit]]
            total = np.stack([np.bincount(word[hit], logs[:, k], len(rest)) for k in range(len(self.langs))], 1)
            found = count > 0
            out[rest[found]] = total[found] / count[found, None]
            rest = rest[~found]
        return out


def _logs(rows: pa.Table, totals: np.ndarray, distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and their log frequency by language, with add-half smoothing over all hashes of the order."""
    hashes = rows["hash"].to_numpy().view(np.uint64)
    table = np.zeros((len(hashes), len(totals)))
    cells = rows["cells"].combine_chunks()
    flat = cells.flatten()
    table[np.repeat(np.arange(len(hashes)), np.asarray(cells.value_lengths())), flat.field("lang").to_numpy()] = flat.field("n").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], np.log((table[order] + 0.5) / (totals + 0.5 * distinct)).astype(np.float32)


def _pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Texts in groups of about CHUNK_BYTES code points with the row of each; a longer text is cut at white space, which no word spans."""
    rows, texts, size = [], [], 0
    for i, t in enumerate(column):
        t = t.as_py() or ""
        at = 0
        while at < len(t) or not at:
            end = len(t)
            if end - at > CHUNK_BYTES:
                cut = _SPACE.search(t, at + CHUNK_BYTES)
                end = cut.end() if cut else end
            if texts and size + end - at > CHUNK_BYTES:
                yield np.array(rows), texts
                rows, texts, size = [], [], 0
            rows.append(i)
            texts.append(t[at:end])
            size, at = size + end - at, max(end, 1)
    if texts:
        yield np.array(rows), texts


def sample(docs: DataFrame, most_rows: int) -> DataFrame:
    """(text, lang): of each language all usable rows, or those whose hash falls below a threshold that lets at most `most_rows` through.

    The threshold is a real number for each language, six standard deviations below the bound, so no size makes it vanish and nothing
    but the languages' sizes is shuffled. Rows of equal id and text go together."""
    usable = docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # the limit is the proven bound of what is broadcast; without it the join would move every text
    sizes = F.broadcast(usable.groupBy("lang").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "lang").limit(MOST_LANGS))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 62)) / float(1 << 62)
    share = F.when(F.col("size") <= most_rows, 1.0).otherwise(F.lit(max(1.0, most_rows - 6.0 * most_rows**0.5)) / F.col("size"))
    return usable.join(sizes, "lang").filter(place < share).select("text", "lang")


def fit(docs: DataFrame, most_rows: int = MOST_ROWS, most_words: int = MOST_WORDS, most_grams: int = MOST_GRAMS) -> Model | None:
    """Counts in Spark; the driver gets the kept words and n-grams only. Words seen once are left to their n-grams."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(1).to_pylist()
            for rows, texts in _pieces(batch.column(0)):
                points, start, end, at = words_of(texts)
                h = span_hashes(points, start, end)
                names = sorted({lang[i] for i in rows})
                own = np.repeat(np.array([names.index(lang[i]) for i in rows], np.int64), np.diff(at))
                order = np.lexsort((h, own))
                new = np.ones(len(h), bool)
                new[1:] = (h[order][1:] != h[order][:-1]) | (own[order][1:] != own[order][:-1])
                first, sizes = order[new], np.diff(np.append(np.flatnonzero(new), len(h)))
                raw = points.tobytes()
                words = [raw[4 * a : 4 * b].decode("utf-32-le", "replace") for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([names[k] for k in own[first]], pa.string()), pa.array(sizes, pa.int64())], ["word", "lang", "n"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 20_000):
                part = batch.slice(i, 20_000)
                points, start, end, _ = words_of(part.column(0).to_pylist())
                every = [(0, span_hashes(points, start, end), np.arange(len(start)))] + [(n, *grams(points, start, end, n)) for n in ORDERS]
                for n, h, word in every:
                    lang, size = part.column(1).take(pa.array(word)), part.column(2).take(pa.array(word))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), n, np.int32)), pa.array(h.view(np.int64)), lang, size], ["gram", "hash", "lang", "n"])

    scratch = Scratch(docs.sparkSession)
    counted = sample(docs, most_rows).mapInArrow(count, "word string, lang string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    counted = scratch.save(counted)
    langs = sorted(r[0] for r in counted.select("lang").distinct().collect())
    if not langs:
        return None
    index = F.array_position(F.lit(langs), F.col("lang")).cast("int") - 1
    each = counted.mapInArrow(hashed, "gram int, hash long, lang string, n long").groupBy("gram", "hash", index.alias("lang")).agg(F.sum("n").alias("n"))
    each = each.groupBy("gram", "hash").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("cells"))
    each = scratch.save(each)
    often = F.when((F.col("gram") > 0) | (F.col("total") > 1), 1)
    sums = {(r.gram, r.lang): r for r in each.select("gram", often.alias("often"), F.explode("cells").alias("c")).groupBy("gram", F.col("c.lang").alias("lang")).agg(F.sum(F.col("c.n")).alias("all"), F.sum(F.col("c.n") * F.col("often")).alias("many")).collect()}
    sizes = {r.gram: r for r in each.groupBy("gram").agg(F.count("*").alias("all"), F.count(often).alias("many")).collect()}
    cells = max(1, MOST_CELLS // len(langs))
    found = {}
    for n in (0, *ORDERS):
        # words seen once count only where no word was seen twice
        field = "many" if n in sizes and sizes[n].many else "all"
        kept = each.filter(F.col("gram") == n) if field == "all" else each.filter((F.col("gram") == n) & often.isNotNull())
        rows = kept.orderBy(F.desc("total"), "hash").limit(min(cells, most_words if n == 0 else most_grams)).select("hash", "cells").toArrow()
        totals = np.array([getattr(sums[n, k], field) or 0 if (n, k) in sums else 0 for k in range(len(langs))], float)
        found[n] = _logs(rows, totals, getattr(sizes[n], field) if n in sizes else 0)
    return Model(langs, *found[0], {n: found[n][0] for n in ORDERS}, {n: found[n][1] for n in ORDERS})


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            n = batch.num_rows
            lang, score = np.full(n, "und", object), np.zeros(n)
            total, counts = np.zeros((n, len(m.langs) if m else 1)), np.zeros(n, np.int64)
            for rows, texts in _pieces(batch.column(1)) if m else ():
                points, start, end, at = words_of(texts)
                if len(start):
                    distinct, first, inverse = np.unique(span_hashes(points, start, end), return_index=True, return_inverse=True)
                    s = m.word_scores(points, start[first], end[first], distinct)
                    has = np.flatnonzero(np.diff(at))
                    np.add.at(total, rows[has], np.add.reduceat(s[inverse], at[has], axis=0))
                    np.add.at(counts, rows, np.diff(at))
            has = np.flatnonzero(counts)
            if len(has):
                mean = total[has] * (np.minimum(counts[has], WEIGHT) / counts[has])[:, None]
                score[has] = 1 / np.exp(mean - mean.max(1, keepdims=True)).sum(1)
                lang[has] = np.array(m.langs, object)[mean.argmax(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def report(docs: DataFrame) -> DataFrame:
    out = predict(docs, fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
