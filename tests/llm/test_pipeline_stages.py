"""Each stage of the pipeline, and all of them, on a table of odd rows against versions in plain Python."""

import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from canopyql.llm import quality_classifier, quality_rules

from .test_text_operators import WORD, components_by_force, packed_by_force, removed_by_force, shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d string, __label int, score double, part int, __node long, c_id long"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(21)
    good = ["river", "stone", "window", "letter", "garden", "summer", "paper", "market", "silver", "winter", "corner", "bridge"]
    bad = ["click", "WIN", "$$$", "free", "###", "casino", "now!!!"]
    say = lambda words, n: " ".join(r.choice(words) + str(r.randrange(400)) for _ in range(n))
    passage = say(good, 70)
    texts = [None, "", " \n\t", "one two", "word " * 40, say(good, 20_000)]
    texts += [say(good, r.randint(30, 120)) for _ in range(60)] + [say(bad, r.randint(30, 90)) for _ in range(60)]
    texts += [texts[6], texts[6], texts[7] + " more", say(good, 20) + " " + passage + " " + say(good, 25), say(good, 30) + "\n" + passage, passage + " " + say(good, 12)]
    out = [(i, t, r.choice(["en", "de", None]), r.choice(["web", None]), len(t) if t else None) for i, t in enumerate(texts)]
    out += [(8, texts[8], "en", "web", 1), (8, say(good, 50), None, None, None), (None, texts[9], "en", "web", None), (None, say(good, 60), None, "web", None), (None, None, None, None, None)]
    return [(*x, "clash", 1, 0.5, n, 2, 3) for n, x in enumerate(out)]


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{d}/documents.parquet")
    labels = [(x[0], int("$$$" not in x[1] and "casino" not in x[1]), 0) for x in rows[:120] if x[1] and x[0] is not None] + [(1, None, None), (None, 1, 0), (999, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def near_by_force(rows):
    """Of each group of near duplicates the row of the smallest id; rows of equal id and text are one."""
    rows = list({(x[0], x[1]) if WORD.search(x[1] or "") else n: x for n, x in reversed(list(enumerate(rows)))}.values())
    group = components_by_force([shingles(x[1]) for x in rows])
    best = {}
    for x, g in zip(rows, group, strict=True):
        best[g] = min(best.get(g, x), x, key=lambda x: (x[0] is None, x[0] if x[0] is not None else 0))
    return [(x[0], x[1]) for x in best.values()]


def passages_by_force(rows):
    """Words of windows that a row of a smaller id holds are removed; rows without an id take no part."""
    named = sorted((x for x in rows if x[0] is not None), key=lambda x: x[0])
    first: dict = {}
    for i, t in named:
        w = WORD.findall(t or "")
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    out = [x for x in rows if x[0] is None]
    for i, t in named:
        w = WORD.findall(t or "")
        gone = {y for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for y in range(k, k + 50)}
        out.append((i, " ".join(x for y, x in enumerate(w) if y not in gone) if gone else t))
    return out


def scores_by_force(spark, docs, labels):
    """The report's scores with the model's own weights, text by text."""
    weights, bias = quality_classifier.fit(docs, labels)
    from canopyql.llm.words import Words, text_buffer
    import pyarrow as pa

    out = {}
    for (text,) in {(r.text,) for r in docs.select("text").collect()}:
        offsets, data = text_buffer(pa.array([text], pa.string()))
        index, value = next(iter(quality_classifier.document_features(Words(offsets, data, 0, 1))))
        out[text] = 1 / (1 + np.exp(-(bias + float((weights[index].astype(float) * value).sum()))))
    return out


def pairs_of(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages(spark, rows, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = {r.part for r in quality_rules.quality_report(docs.withColumn("doc_id", F.col("part").cast("long"))).filter("kept").withColumnRenamed("doc_id", "part").collect()}
    now = docs
    wanted = None
    for name, stage in corpus_pipeline.STAGES:
        before = now.collect()
        out = stage(spark, now, sf_dir)
        if name == "quality_rules":
            want = Counter((x.doc_id, x.text) for x in before if x.part in kept)
        elif name == "quality_classifier":
            score = scores_by_force(spark, now, labels)
            sure = Counter((x.doc_id, x.text) for x in before if score[x.text] >= 0.7 + 1e-6)
            want = pairs_of(out)
            assert not sure - want and all(score[t] >= 0.7 - 1e-6 for _, t in want)
            assert len(want) > 20 and not any("$$$" in (t or "") for _, t in want)
        elif name == "ngram_jaccard_join":
            want = Counter(near_by_force([(x.doc_id, x.text) for x in before]))
        elif name == "substring_dedup":
            want = Counter(passages_by_force([(x.doc_id, x.text) for x in before]))
        else:
            wanted = [(x.doc_id, x.text) for x in before]
            break
        assert out.columns == docs.columns, name
        assert pairs_of(out) == want, name
        now = spark.createDataFrame(out.collect(), docs.schema)
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.fspath(public_tokenizers.path("byte_bpe_50k.json")))
    lengths = Counter((i, len(packed_by_force(t, x, 2048))) for i, x in wanted)
    for run in (out, corpus_pipeline.run(spark, sf_dir)):
        pieces = run.collect()
        assert Counter((p.doc_id, p.doc_tokens) for p in pieces if p.start == 0) == lengths
        assert sum(p.length for p in pieces) == sum(n * k for (_, n), k in lengths.items())


def test_stages_of_an_empty_table(spark, rows, sf_dir, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_classifier_like_plain_python(spark):
    """FTRL with dictionaries gives the weights and scores of the operator: words, pairs, shapes and pairs of shapes, hashed to 18 bits."""
    from canopyql.llm.words import Words, text_buffer
    import pyarrow as pa

    texts = ["a b a", "x1 Y2 y3", "", "b a b a b", "Zz zZ 11 11", "a"]
    marks = [1, 0, 1, 1, 0, 1]
    offsets, data = text_buffer(pa.array(texts, pa.string()))
    described = list(quality_classifier.document_features(Words(offsets, data, 0, len(texts))))
    weights, bias = quality_classifier.train([(m, i, v) for m, (i, v) in zip(marks, described, strict=True)])
    z, n, alpha, beta, l1, l2 = {}, {}, 0.5, 0.1, 1e-4, 1e-3

    def weight(k):
        s = z.get(k, 0.0)
        return 0.0 if abs(s) <= l1 else (np.sign(s) * l1 - s) / ((beta + n.get(k, 0.0) ** 0.5) / alpha + l2)

    for _ in range(4):
        for m, (index, value) in zip(marks, described, strict=True):
            x = dict(zip(index.tolist(), value.tolist(), strict=True)) | {"bias": 1.0}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + np.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - m) * v
                z[k] = z.get(k, 0.0) + g - ((n.get(k, 0.0) + g * g) ** 0.5 - n.get(k, 0.0) ** 0.5) / alpha * w[k]
                n[k] = n.get(k, 0.0) + g * g
    assert bias == pytest.approx(weight("bias"), rel=1e-6)
    assert {k: pytest.approx(weight(k), rel=1e-5, abs=1e-7) for k in z if k != "bias"} == {k: float(weights[k]) for k in z if k != "bias"}
    # each document's values are its shares of four streams
    assert [round(float(v.sum()), 5) for _, v in described] == [4.0 if re.search(r"\S", t) else 0.0 for t in texts]
