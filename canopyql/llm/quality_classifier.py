"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Words are the runs between blanks. Two streams of words give n-grams of one and two: the words themselves, and their
shapes (runs of capitals, letters, digits or one other sign, each as one; a word equal to the one before it is a shape of its own), so
that unseen words still say something. A feature's value is its share of the document's n-grams; a score is one sparse dot product over the
whole text, computed as a gather of weights and a sum, with no table of features.

Training takes at most ``most`` labelled rows, chosen by a hash of doc_id among rows that are not held out; that bound
makes the broadcast of the chosen labels and the one training task safe. Scoring reads every document once and moves no row.

Cases: null and empty texts have the score of the bias alone; documents without a label are scored all the same; of
labels that contradict each other the smaller counts; repeated rows are scored each; with no label at all every score is 0.5; an
empty table gives no rows; extra columns pass through ``filter_documents`` and are ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import U, Words, chunks, mix, release, span_hashes, text_buffer

BITS = 18
FEATURES = 1 << BITS
STREAMS = 4
#: Labelled rows that a model is fitted on at most.
MOST_LABELS = 12_000
THRESHOLD = 0.7
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[0x80:] = ord("a")
_CLASS[ord("0") : ord("9") + 1] = ord("0")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def _shapes(w: Words) -> np.ndarray:
    """Hash of each word's shape."""
    c = _CLASS[w.data]
    keep = np.ones(len(c), bool)
    keep[1:] = c[1:] != c[:-1]
    keep[w.start] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return span_hashes(c[keep], at[w.start], at[w.end])


def features(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each stream: a feature for each place, and the offsets of the documents."""
    h, shape = w.hashes(), _shapes(w)
    first = np.zeros(len(h), bool)
    first[w.words[:-1][np.diff(w.words) > 0]] = True
    if len(h):
        shape[1:][(h[1:] == h[:-1]) & ~first[1:]] = U(0x5AFE5AFE5AFE5AFE)
    out = []
    for k, x in enumerate((h, shape)):
        salt = U(0xC2B2AE3D27D4EB4F * (k + 1) & 0xFFFFFFFFFFFFFFFF)
        out.append(((mix(x ^ salt) >> U(64 - BITS)).astype(np.int32), w.words))
        pair = x.copy()
        if len(x):
            pair[1:] = x[1:] * U(0x9FB21C651E98DF25) + x[:-1]
            pair[first] = x[first] * U(0x9FB21C651E98DF25) + U(1)
        out.append(((mix(pair ^ ~salt) >> U(64 - BITS)).astype(np.int32), w.words))
    return out


def document_features(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct features of each document and their shares; streams share one table of weights."""
    streams = features(w)
    for d in range(len(w.words) - 1):
        x = np.concatenate([f[at[d] : at[d + 1]] for f, at in streams])
        index, n = np.unique(x, return_counts=True)
        yield index, (n * (STREAMS / max(len(x), 1))).astype(np.float32)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 4, alpha: float = 0.5, beta: float = 0.1, l1: float = 1e-4, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """FTRL-proximal over rows of (label, features, values), in the order given; the weights and the bias."""
    z, n = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    for _ in range(epochs):
        for label, index, value in rows:
            i, x = np.append(index, FEATURES), np.append(value, 1.0)
            zi, ni = z[i], n[i]
            w = np.where(np.abs(zi) > l1, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2), 0.0)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[i] = ni + g * g
    w = np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    return w[:-1].astype(np.float32), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> tuple[np.ndarray, float]:
    """Weights and bias from at most `most` labelled documents that are not held out."""
    known = labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("__label"))
    # the limit is the proven bound of what is broadcast
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffer(batch.column(2))
            for i, j in chunks(offsets):
                pairs = list(document_features(Words(offsets, data, i, j)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *(pa.array([p[k].astype(t).tobytes() for p in pairs], pa.binary()) for k, t in ((0, np.int32), (1, np.float32)))], ["doc_id", "label", "index", "value"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for label, index, value in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                rows.append((label, np.frombuffer(index.as_buffer(), np.int32), np.frombuffer(value.as_buffer(), np.float32)))
        if rows:
            weights, bias = train(rows)
            rows.clear()
            release()
            yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], ["weights", "bias"])

    described = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "__label", "text").mapInArrow(describe, "doc_id long, label int, index binary, value binary")
    one = described.dropDuplicates(["doc_id"]).repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    model = one.mapInArrow(learn, "weights binary, bias double").first()
    return (np.frombuffer(model[0], np.float32), model[1]) if model else (np.zeros(FEATURES, np.float32), 0.0)


def with_score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", into: str = "score", pass_columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named and the score of every text. The model has a fixed size (1 MB) and goes out as a broadcast variable."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*pass_columns).withColumn(into, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        weights = weights.astype(np.float64)
        for batch in batches:
            offsets, data = text_buffer(batch.column(batch.num_columns - 1))
            score = np.zeros(batch.num_rows)
            for i, j in chunks(offsets):
                w = Words(offsets, data, i, j)
                total, places = np.zeros(j - i), STREAMS * np.maximum(np.diff(w.words), 1)
                for f, at in features(w):
                    upto = np.concatenate([[0.0], np.cumsum(weights[f])])
                    total += upto[at[1:]] - upto[at[:-1]]
                score[i:j] = 1 / (1 + np.exp(-np.clip(bias + STREAMS * total / places, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], [*pass_columns, into])
        release()

    return docs.select(*pass_columns, F.col(text).alias("__text")).mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def filter_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns; each text passes once, beside its own score."""
    model = fit(docs, labels)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d")).select("d", F.col("d.text").alias("text"))
    return with_score(rows, model, pass_columns=("d",)).filter(F.col("score") >= threshold).select("d.*")
