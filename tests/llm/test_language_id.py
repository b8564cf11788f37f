"""Language identification against a version in plain Python, and its sample."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from canopyql.llm import language_id

ALPHABETS = {"de": "abcdehiklnorstuü", "en": "abdefghilnorstwy", "fr": "acdeéilmnoprstuv", "xx": "жзийклмно"}


def vocabulary(r: random.Random, lang: str, n: int = 120) -> list[str]:
    return ["".join(r.choice(ALPHABETS[lang]) for _ in range(r.randint(1, 9))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    words = {k: vocabulary(r, k) for k in ALPHABETS}
    say = lambda k, n: " ".join(r.choice(words[k]) + r.choice(["", ",", "3", "'s", "."]) for _ in range(n)).capitalize()
    out = [(i, say(k := r.choice(["de", "en", "en", "fr"]), r.randint(1, 60)), k) for i in range(400)]
    out += [(1000 + i, say("xx", 20), "xx") for i in range(4)]
    out += [(2000, None, "de"), (2001, "", "en"), (2002, " 12 .. ", None), (2003, "ÜBER zzzqqq unseenword", None), (2004, say("en", 30), None), (None, say("fr", 9), "fr"), (2005, "\n".join(say("de", 700) for _ in range(30)), None), (2006, "a" * 5000, None), (5, out[5][1], out[5][2])]
    return out


def words_in(text: str | None) -> list[str]:
    return re.findall(r"[^\W\d_]+", "".join(c if c.isalpha() else " " for c in (text or "").lower()))


def by_force(rows: list[tuple], train: list[tuple]) -> dict:
    """Dictionaries only: counts, smoothed logs, backing off from words to n-grams of 5 to 1."""
    langs = sorted({k for _, _, k in train if k})
    words, grams = defaultdict(Counter), {n: defaultdict(Counter) for n in (5, 4, 3, 2, 1)}
    cut = lambda w, n: [f"\0{w}\0"[i : i + n] for i in range(len(w) + 3 - n)]
    for _, text, lang in train:
        for w in words_in(text):
            words[w][lang] += 1
            for n, table in grams.items():
                for g in cut(w, n):
                    table[g][lang] += 1
    words = {w: c for w, c in words.items() if c.total() > 1}

    def logs(table):
        total = {k: sum(c[k] for c in table.values()) for k in langs}
        return {x: [math.log((c[k] + 0.5) / (total[k] + 0.5 * len(table))) for k in langs] for x, c in table.items()}

    known, parts = logs(words), {n: logs(t) for n, t in grams.items()}

    def score(w):
        if w in known:
            return known[w]
        for n in (5, 4, 3, 2, 1):
            if found := [parts[n][g] for g in cut(w, n) if g in parts[n]]:
                return [sum(x) / len(found) for x in zip(*found, strict=True)]
        return [0.0] * len(langs)

    out = {}
    for i, text, _ in rows:
        each = [score(w) for w in words_in(text)]
        if not each:
            out[i, text] = ("und", 0.0)
            continue
        mean = [sum(x) / len(each) * min(len(each), 20) for x in zip(*each, strict=True)]
        top = max(mean)
        out[i, text] = (langs[mean.index(top)], 1 / sum(math.exp(x - top) for x in mean))
    return out


def test_like_plain_python(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("word", F.lit("clash")).withColumn("place", F.lit(1)).repartition(3)
    held = {r.doc_id for r in docs.select("doc_id", language_id.held_out(F.col("doc_id")).alias("h")).collect() if r.h}
    train = [(i, t, k) for i, t, k in rows if i not in held and k and t]
    want, got = by_force(rows, train), language_id.report(docs).collect()
    assert len(got) == len(rows)
    texts = {(i, t) for i, t, _ in rows}
    for r in got:
        lang, score = next(want[x] for x in texts if x[0] == r.doc_id)
        assert r.held_out == (r.doc_id in held) and r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-4), r


def test_long_texts_in_parts(spark, rows, monkeypatch):
    """Parts of a text give what the whole gives."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    whole = sorted((str(r.doc_id), r.lang_pred, round(r.score, 9)) for r in language_id.predict(docs, model).collect())
    texts = [t for _, t, _ in rows if t]
    monkeypatch.setattr(language_id, "CHUNK_BYTES", 100)
    import pyarrow as pa

    pieces = [(i, t) for at, group in language_id._pieces(pa.array([*texts, None, ""])) for i, t in zip(at.tolist(), group, strict=True)]
    assert ["".join(t for k, t in pieces if k == i) for i in range(len(texts) + 2)] == [*texts, "", ""]
    assert max(len(t) for _, t in pieces if " " in t) < 300 and len(whole) == len(rows)


def test_sample_holds_each_language(spark):
    """A rare language keeps all rows, a common one no more than the bound; the same rows each time."""
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.when(F.col("id") % 5000 == 0, "rare").when(F.col("id") % 3 == 0, "some").otherwise("many").alias("lang"))
    n = {r.lang: r["count"] for r in language_id.sample(rows, 400).groupBy("lang").count().collect()}
    rare = rows.filter("lang = 'rare'").filter(~language_id.held_out(F.col("doc_id"))).count()
    assert n["rare"] == rare > 0 and 200 < n["some"] <= 400 and 200 < n["many"] <= 400
    first, second = ({r.text for r in language_id.sample(x, 400).collect()} for x in (rows, rows.repartition(7)))
    assert first == second


def test_threshold_never_rounds_away():
    """At 10 to the 13 rows of a language the threshold still holds many of the 2 to the 62 hashes."""
    share = (language_id.MOST_ROWS - 6 * language_id.MOST_ROWS**0.5) / 1e13
    assert share * 2**62 > 1e8


def test_no_model(spark, rows):
    docs = spark.createDataFrame([(i, t, None) for i, t, _ in rows], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language_id.report(docs).collect()} == {("und", 0.0)}
    assert language_id.report(docs.limit(0)).collect() == []
