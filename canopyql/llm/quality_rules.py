"""Quality rules with adaptive thresholds (native: DataFrame functions only).

Each document gets counts; three shares of them go, in thousandths, into a mergeable quantile sketch per language and
source: a count for each log-linear bucket (1,024 exact values, then 9 significant bits). Buckets add up, so the same
sketch serves a language or the whole corpus where a source is too small. Thresholds are the quartiles widened by
``spread`` interquartile ranges; the thresholds table joins back to the documents.

Cases: a null or empty text has counts of 0 and fails the base rule (fewer than 10 words); null lang or source is a group
of its own; repeated rows are judged alike, each; an empty table gives no rows; where even the whole corpus has fewer than
``least`` documents there is no threshold, and the base rule alone decides. Extra columns of the input pass through
``filter_documents`` as one struct, so that no name of theirs clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch

SEPARATORS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: metric: (numerator, denominator, least interquartile range in thousandths, is there a lower bound too)
METRICS = {
    "symbols": ("n_symbols", "n_words", 20, False),
    "length": ("word_chars", "n_words", 500, True),
    "lines": ("n_dup_lines", "n_lines", 200, False),
}
#: A two-sided bound widens by this many times its half width over n_words: the mean of few words is noisy.
NOISE = 10


def with_counts(docs: DataFrame, text: str = "text", into: str = "__quality") -> DataFrame:
    """Adds the struct of counts. Only repeated windows are sorted: most documents end at the distinct count."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumn(into, F.struct(F.array_remove(F.split(t, SEPARATORS), "").alias("w"), lines.alias("l")))
    w = F.col(f"{into}.w")
    n = F.size(w)
    windows = F.when(n < 5, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*(F.get(w, i + d) for d in range(5))))
    )
    df = df.withColumn(f"{into}_h", windows)
    h = F.col(f"{into}_h")
    repeats = F.size(F.array_distinct(h)) < F.size(h)
    df = df.withColumn(f"{into}_s", F.when(repeats, F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col(f"{into}_s")

    def same(x: Column, i: Column) -> Column:
        near = lambda j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return near(i - 1) | near(i + 1)

    df = df.withColumn(f"{into}_p", F.array_sort(F.transform(F.filter(s, same), lambda x: x["i"])))
    p = F.col(f"{into}_p")
    covered = F.aggregate(
        p,
        F.struct(F.lit(0).alias("n"), F.lit(-5).alias("at")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(5), x - a["at"])).alias("n"), x.alias("at")),
        lambda a: a["n"],
    )
    counts = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.translate(t, BLANK, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(f"{into}.l") - F.size(F.array_distinct(f"{into}.l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(f"{into}.l").cast("long").alias("n_lines"),
    )
    return df.withColumn(into, counts).drop(f"{into}_h", f"{into}_s", f"{into}_p")


def _share(metric: str, of: str) -> Column:
    top, bottom, _, _ = METRICS[metric]
    return F.when(F.col(f"{of}.{bottom}") > 0, F.floor(F.col(f"{of}.{top}") * 1000 / F.col(f"{of}.{bottom}")).cast("long"))


def bucket(v: Column) -> Column:
    """Lower end of the log-linear bucket of a whole number of 0 or more."""
    e = F.greatest(F.length(F.bin(v)) - 10, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, e), e)


def base_failed(of: str) -> Column:
    return (F.col(f"{of}.n_words") < 10) | (100 * F.col(f"{of}.n_repeat_words") > 20 * F.col(f"{of}.n_words"))


def sketches(counted: DataFrame, of: str = "__quality") -> DataFrame:
    """Bucket counts per lang, source and metric, of the documents that pass the base rule."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), bucket(_share(m, of)).alias("key")) for m in METRICS)))
    rows = counted.filter(~base_failed(of)).select("lang", "source", each.alias("x")).select("lang", "source", "x.*")
    return rows.filter("key is not null").groupBy("lang", "source", "metric", "key").agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame, spread: float = 3.0, least: int = 200) -> DataFrame:
    """One row per lang and source: lower and upper bound of each metric, from the narrowest group of ``least`` documents."""
    keys = sketch.select("lang", "source").distinct()
    parts = []
    for level, by in (("source", ["lang", "source"]), ("lang", ["lang"]), ("all", [])):
        b = sketch.groupBy(*by, "metric", "key").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*by, "metric")
        b = b.select(*by, "metric", "key", F.sum("n").over(w.orderBy("key")).alias("upto"), F.sum("n").over(w).alias("total"))
        q = lambda f: F.min(F.when(F.col("upto") >= F.ceil(F.lit(f) * F.col("total")), F.col("key")))
        b = b.groupBy(*by, "metric").agg(F.max("total").alias("total"), q(0.25).alias("q1"), q(0.75).alias("q3")).filter(F.col("total") >= least)
        floor = F.create_map(*(x for m in METRICS for x in (F.lit(m), F.lit(METRICS[m][2]))))[F.col("metric")]
        wide = F.lit(spread) * F.greatest(F.col("q3") - F.col("q1"), floor)
        b = b.select(*by, "metric", (F.col("q1") - wide).alias("low"), (F.col("q3") + wide).alias("high"))
        parts.append(b.groupBy(*by).agg(*(F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{level}_{m}_{c}") for m in METRICS for c in ("low", "high"))))
    a, b, c = parts
    out = keys.alias("k")
    out = out.join(a.alias("a"), F.col("k.lang").eqNullSafe(F.col("a.lang")) & F.col("k.source").eqNullSafe(F.col("a.source")), "left")
    out = out.join(b.alias("b"), F.col("k.lang").eqNullSafe(F.col("b.lang")), "left").join(c.withColumn("one", F.lit(1)), F.lit(1) == F.col("one"), "left")
    pick = lambda m, x: F.coalesce(*(F.col(f"{level}_{m}_{x}") for level in ("source", "lang", "all"))).alias(f"{m}_{x}")
    return out.select(F.col("k.lang").alias("__lang"), F.col("k.source").alias("__source"), *(pick(m, x) for m in METRICS for x in ("low", "high")))


def judged(counted: DataFrame, bounds: DataFrame, of: str = "__quality") -> DataFrame:
    """Adds __kept. The bounds have a row for each lang and source; AQE broadcasts them only when they are measured to be small."""
    inside = F.lit(True)
    for m, (_, _, _, both) in METRICS.items():
        v, low, high = _share(m, of), F.col(f"{m}_low"), F.col(f"{m}_high")
        if both:
            n, slack = 2 * F.col(f"{of}.n_words"), NOISE * (high - low)
            inside = inside & F.coalesce((v * n <= high * n + slack) & (v * n >= low * n - slack), F.lit(True))
        else:
            inside = inside & F.coalesce(v <= high, F.lit(True))
    joined = counted.join(bounds, counted["lang"].eqNullSafe(bounds["__lang"]) & counted["source"].eqNullSafe(bounds["__source"]), "left")
    return joined.withColumn("__kept", ~base_failed(of) & inside).drop(*bounds.columns)


def quality_report(docs: DataFrame, spread: float = 3.0, least: int = 200) -> DataFrame:
    """doc_id, counts, base_failed and kept of every document."""
    scratch = Scratch(docs.sparkSession)
    counted = scratch.save(with_counts(docs.select("doc_id", "lang", "source", "text")).drop("text"))
    out = judged(counted, thresholds(sketches(counted), spread, least))
    return out.select("doc_id", *(F.col(f"__quality.{c}").alias(c) for c in COUNTS), base_failed("__quality").alias("base_failed"), F.col("__kept").alias("kept"))


def filter_documents(docs: DataFrame, spread: float = 3.0, least: int = 200) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    The counts are written beside the texts, so they are computed once and the texts are never shuffled."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d")).select("d", "d.text", "d.lang", "d.source")
    counted = scratch.save(with_counts(rows).drop("text"))
    bounds = scratch.save(thresholds(sketches(counted), spread, least))
    return judged(counted, bounds).filter("__kept").select("d.*")
