"""License scan by ordered signature rules (native: DataFrame functions only).

A text is lower-cased (A-Z) and cut into words of letters, digits and non-ASCII characters; every regular expression sees
the words joined by single blanks, so line breaks and punctuation never hide a notice. A document that holds none of the
gate stems costs a few substring searches. Of the others, rules are looked up by keyword, and only those whose keywords occur are run; every match of a rule
holds its keywords and a stem, so neither hides a match. Each match is an
interval of words with a priority; one that lies inside another of at least its priority is suppressed. Rules of the highest priority deny a grant: what
they hold is suppressed, and they have no label. Sentences of license texts, headers and notices stand in `license_notices`, written by hand; names and
identifiers of `LICENSES` are looked for in the settings of `SETTINGS`, identifiers also as operands of SPDX expressions.

Cases: null text is empty; no detection gives empty label strings, null positions and a score of 0; repeated rows are
scanned each; an empty table gives no rows; extra columns are ignored. Work is linear in the words of a text, of any length.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_notices import notices

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The base phrases, always reported.
BASE = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}
#: Fixed values. label: (name in words as a regular expression, SPDX identifier in words). Facts about licenses, in no order of weight.
LICENSES = {
    "mit": (r"mit(?: x11)?|x11 mit|expat", r"mit"),
    "apache-1.1": (r"apache(?: software)?(?: license)?(?: version| v)? ?1 1", r"apache 1 1"),
    "apache-2": (r"apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?|asl ?2(?: 0)?", r"apache 2 0"),
    "bsd-2-clause": (r"bsd 2 clause|2 clause bsd|simplified bsd|freebsd|two clause bsd", r"bsd 2 clause"),
    "bsd-3-clause": (r"bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd|three clause bsd", r"bsd 3 clause"),
    "bsd-4-clause": (r"bsd 4 clause|4 clause bsd|original bsd|four clause bsd", r"bsd 4 clause"),
    "bsd-0-clause": (r"0bsd|zero clause bsd", r"0bsd"),
    "gpl-1": (r"(?:gnu )?(?:general public license|gpl)(?: version| v)? ?1(?: 0)?|gplv1", r"gpl 1 0(?: only| or later)?"),
    "gpl-2": (r"(?:gnu )?(?:general public license|gpl)(?: version| v)? ?2(?: 0)?|gplv2", r"gpl 2 0(?: only| or later)?"),
    "gpl-3": (r"(?:gnu )?(?:general public license|gpl)(?: version| v)? ?3(?: 0)?|gplv3", r"gpl 3 0(?: only| or later)?"),
    "lgpl-2": (r"(?:gnu )?(?:library|lesser) general public license(?: version| v)? ?2(?: 0)?|lgpl ?v?2(?: 0)?", r"lgpl 2 0(?: only| or later)?"),
    "lgpl-2.1": (r"(?:gnu )?(?:lesser general public license|lgpl)(?: version| v)? ?2 1|lgplv2 1", r"lgpl 2 1(?: only| or later)?"),
    "lgpl-3": (r"(?:gnu )?(?:lesser general public license|lgpl)(?: version| v)? ?3(?: 0)?|lgplv3", r"lgpl 3 0(?: only| or later)?"),
    "agpl-3": (r"(?:gnu )?(?:affero general public license|agpl)(?: version| v)? ?3(?: 0)?|agplv3", r"agpl 3 0(?: only| or later)?"),
    "gfdl-1.3": (r"(?:gnu )?(?:free documentation license|fdl|gfdl)(?: version| v)? ?1 3", r"gfdl 1 3(?: only| or later)?"),
    "gpl": (r"gnu general public license|gnu gpl|gpl", r"gpl"),
    "lgpl": (r"gnu (?:lesser|library) general public license|gnu lgpl|lgpl", r"lgpl"),
    "agpl": (r"gnu affero general public license|gnu agpl|agpl", r"agpl"),
    "mpl-1.1": (r"(?:mozilla public license|mpl)(?: version| v)? ?1 1", r"mpl 1 1"),
    "mpl-2": (r"(?:mozilla public license|mpl)(?: version| v)? ?2(?: 0)?", r"mpl 2 0"),
    "epl-1": (r"(?:eclipse public license|epl)(?: version| v)? ?1(?: 0)?", r"epl 1 0"),
    "epl-2": (r"(?:eclipse public license|epl)(?: version| v)? ?2(?: 0)?", r"epl 2 0"),
    "cddl-1": (r"(?:common development and distribution license|cddl)(?: version| v)? ?1(?: 0)?", r"cddl 1 0"),
    "cpl-1": (r"common public license(?: version| v)? ?1(?: 0)?", r"cpl 1 0"),
    "eupl-1.2": (r"(?:european union public licen[cs]e|eupl)(?: version| v)? ?1 2", r"eupl 1 2"),
    "isc": (r"isc", r"isc"),
    "zlib": (r"zlib(?: libpng)?", r"zlib"),
    "libpng": (r"libpng", r"libpng(?: 2 0)?"),
    "boost-1": (r"boost(?: software license)?(?: version| v)? ?1(?: 0)?|boost software", r"bsl 1 0"),
    "unlicense": (r"unlicense", r"unlicense"),
    "wtfpl": (r"wtfpl", r"wtfpl"),
    "artistic-1": (r"artistic license(?: version)? 1(?: 0)?", r"artistic 1 0"),
    "artistic-2": (r"artistic license(?: version)? 2(?: 0)?", r"artistic 2 0"),
    "python-2": (r"python software foundation(?: license)?(?: version)?(?: 2)?|psf", r"(?:psf|python) 2 0"),
    "ruby": (r"ruby", r"ruby"),
    "php-3": (r"php license(?: version)? 3(?: 0?1)?", r"php 3 0?1?"),
    "openssl": (r"openssl", r"openssl"),
    "postgresql": (r"postgresql", r"postgresql"),
    "ofl-1.1": (r"(?:sil )?open font license(?: version)? 1 1|ofl 1 1", r"ofl 1 1"),
    "odbl-1": (r"open data(?:base)? (?:commons )?(?:open database )?license(?: version)?(?: 1(?: 0)?)?|odbl", r"odbl 1 0"),
    "cc0-1": (r"cc0(?: 1 0)?(?: universal)?", r"cc0 1 0"),
    "cc-by": (r"creative commons attribution(?: license)?|cc by", r"cc by [1-4] [05]"),
    "cc-by-sa": (r"creative commons attribution share ?alike|cc by sa", r"cc by sa [1-4] [05]"),
    "cc-by-nd": (r"creative commons attribution no ?deriv(?:ative)?s|cc by nd", r"cc by nd [1-4] [05]"),
    "cc-by-nc": (r"creative commons attribution non ?commercial|cc by nc", r"cc by nc [1-4] [05]"),
    "cc-by-nc-sa": (r"creative commons attribution non ?commercial share ?alike|cc by nc sa", r"cc by nc sa [1-4] [05]"),
    "cc-by-nc-nd": (r"creative commons attribution non ?commercial no ?deriv(?:ative)?s|cc by nc nd", r"cc by nc nd [1-4] [05]"),
    "ms-pl": (r"microsoft public", r"ms pl"),
    "ms-rl": (r"microsoft reciprocal", r"ms rl"),
    "bsl-1.1": (r"business source license(?: 1 1)?", r"busl 1 1"),
    "sspl-1": (r"server side public license(?: version)?(?: 1)?", r"sspl 1 0"),
}
#: Where a name stands: (priority, what the text must hold, pattern around it). 3: a declaration by identifier, 2: a grant, 1: a mention.
SETTINGS = (
    (3, "spdx", r"spdx licen[cs]e identifier (?:{spdx})"),
    # a later operand of an expression; the interval is that of the operand alone, so that it doesn't hide the first
    (3, "spdx", r"(?:{spdx})(?<=spdx licen[cs]e identifier [a-z0-9 ]{1,100} (?:or|and) (?:{spdx}))"),
    (3, "licen", r"licen[cs]ed? (?:is )?(?:{spdx})(?: only| or later)"),
    (2, "ed under", r"(?:licen[cs]ed|released|distributed|published|provided|redistributed) under (?:the )?(?:terms of )?(?:the )?(?:{name})(?: international| unported)?(?: licen[cs]e)?"),
    (2, "available under", r"available under (?:the )?(?:terms of )?(?:the )?(?:{name})(?: international| unported)?(?: licen[cs]e)?"),
    (2, "licen", r"under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{name})(?: licen[cs]e)"),
    (1, "licen", r"(?:{name})(?: [1-4] 0)?(?: international| unported)? licen[cs]ed?"),
    (1, "licen", r"licen[cs]es? (?:the )?(?:{name})"),
)
#: Labels of the highest priority, which deny, are no result.
DENIES = 4
LEVEL_SCORE = {1: 0.5, 2: 0.9, 3: 1.0}


def _alternatives(rx: str) -> list[str]:
    """The expression as alternatives: those outside groups, and those of groups that must match."""
    each = re.split(r"\|(?![^(]*\))", rx)
    if len(each) > 1:
        return [y for x in each for y in _alternatives(x)]
    if m := re.search(r"\(\?:([^()]*\|[^()]*)\)(?![?*+{])", rx):
        return [y for x in m[1].split("|") for y in _alternatives(rx[: m.start()] + x + rx[m.end() :])]
    return [rx]


def _required(rx: str) -> str:
    """The longest string that each match of an expression without alternatives holds."""
    before = None
    while before != rx:
        before, rx = rx, re.sub(r"\(\?:[^()]*\)|\[[^\]]*\]|[^\0]\?(?!:)", "\0", rx)
    return max((x.strip() for x in re.split(r"\0|\{[^}]*\}|[?*+]", rx)), key=len)


def _by_keyword(rx: str) -> list[tuple[str, str]]:
    """(keyword, expression): the alternatives, those of one keyword together."""
    found: dict[str, list[str]] = {}
    for a in _alternatives(rx):
        found.setdefault(_required(a), []).append(a)
    return [(k, "|".join(v)) for k, v in found.items()]


@functools.cache
def rules() -> tuple[tuple[int, str, str, str, str], ...]:
    """(priority, first keyword, second keyword, regular expression over words, label), in order of priority."""
    out = [(p, k, k, x, label) for p, label, rx in notices() for k, x in _by_keyword(rx)]
    for label, (name, spdx) in LICENSES.items():
        for p, what, rx in SETTINGS:
            field = "name" if "{name}" in rx else "spdx"
            out += [(p, what, k, rx.replace("{" + field + "}", x), label) for k, x in _by_keyword(name if field == "name" else spdx)]
        # a name that says license needs nothing around it
        out += [(1, k, k, a, label) for a in _alternatives(name) if re.search("licen[cs]e", k := _required(a))]
    return tuple(sorted(out, key=lambda r: (-r[0], r[4], r[3])))


@functools.cache
def gate() -> tuple[str, ...]:
    """Stems of which a text must hold one to hold a rule's first keyword."""
    out = ["licen", "spdx", "ed under", "available under", "copyright", "warrant", "this software", "public domain", "cc by", "noncommercial", "non commercial"]
    return (*out, *sorted({r[1] for r in rules() if not any(x in r[1] for x in out)}))


def _base_label(x: Column, i: Column, w: Column) -> Column:
    out = None
    for label, phrase in BASE.items():
        first, *rest = phrase.split()
        cond = x == first
        for d, word in enumerate(rest, 1):
            cond = cond & F.coalesce(F.get(w, i + d) == word, F.lit(False))
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


def _rule_array() -> Column:
    """(keyword, rules that need it)."""
    by: dict[str, list] = {}
    for p, first, second, rx, label in rules():
        by.setdefault(second, []).append((p, first, rf"(?<![^ ])(?:{rx})(?![^ ])", label))
    each = lambda spec: F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("priority", "k1", "rx", "label"), r, strict=True))) for r in spec))
    return F.array(*(F.struct(F.lit(k).alias("key"), each(v).alias("rules")) for k, v in by.items()))


def scan(docs: DataFrame, text: str = "text", into: str = "__scan") -> DataFrame:
    """Adds a struct: n_words, base (places of base phrases), detections (kept intervals of words)."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df = docs.withColumn(into, F.array_remove(F.split(lowered, NOT_WORD), ""))
    w = F.col(into)
    df = df.withColumn(f"{into}_t", F.array_join(w, " "))
    t = F.col(f"{into}_t")
    holds = lambda words: functools.reduce(Column.__or__, (F.contains(t, F.lit(x)) for x in words))
    df = df.withColumn(f"{into}_g", holds(gate()))
    g = F.col(f"{into}_g")
    hits = F.filter(F.transform(w, lambda x, i: F.struct(i.alias("at"), _base_label(x, i, w).alias("label"))), lambda h: h["label"].isNotNull())
    df = df.withColumn(f"{into}_b", F.when(holds(BASE.values()), hits))

    def intervals(r: Column) -> Column:
        marked = F.split(F.regexp_replace(t, r["rx"], F.lit("\u0001$0\u0002")), " ")
        at = lambda mark: F.filter(F.transform(marked, lambda x, i: F.when(F.contains(x, F.lit(mark)), i)), lambda x: x.isNotNull())
        pair = F.arrays_zip(at("\u0001").alias("a"), at("\u0002").alias("b"))
        return F.transform(pair, lambda p: F.struct(p["a"].alias("start"), (-p["b"]).alias("neg_end"), (-r["priority"]).alias("neg_priority"), r["label"].alias("label")))

    some = F.filter(_rule_array(), lambda r: F.contains(t, r["key"]))
    fit = F.filter(F.flatten(F.transform(some, lambda r: r["rules"])), lambda r: F.contains(t, r["k1"]))
    found = F.array_sort(F.flatten(F.transform(fit, intervals)))
    df = df.withColumn(f"{into}_f", F.when(g, found))
    kind = "array<struct<start:int,neg_end:int,neg_priority:int,label:string>>"

    def step(a: Column, x: Column) -> Column:
        """e_k: the largest end so far of a kept interval of priority k or more. Starts only rise, so an end within e_k is containment."""
        end, p = -x["neg_end"], -x["neg_priority"]
        inside = end <= F.when(p == 1, a["e1"]).when(p == 2, a["e2"]).when(p == 3, a["e3"]).otherwise(a["e4"])
        up = lambda k: F.when(~inside & (p >= k), F.greatest(a[f"e{k}"], end)).otherwise(a[f"e{k}"]).alias(f"e{k}")
        return F.struct(F.when(inside, a["kept"]).otherwise(F.concat(a["kept"], F.array(x))).alias("kept"), up(1), up(2), up(3), up(4))

    start = F.struct(F.array().cast(kind).alias("kept"), *(F.lit(-1).alias(f"e{k}") for k in (1, 2, 3, 4)))
    kept = F.aggregate(F.col(f"{into}_f"), start, step, lambda a: F.filter(a["kept"], lambda x: x["neg_priority"] != -DENIES))
    df = df.withColumn(f"{into}_k", kept)
    out = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.coalesce(F.col(f"{into}_b"), F.array().cast("array<struct<at:int,label:string>>")).alias("base"),
        F.coalesce(F.col(f"{into}_k"), F.array().cast(kind)).alias("detections"),
    )
    return df.withColumn(into, out).drop(*(f"{into}_{x}" for x in "tgbfk"))


def report(docs: DataFrame) -> DataFrame:
    """The digest of each document: counts, first and last base place, labels, and the score of the strongest detection."""
    df = scan(docs.select("doc_id", "text")).drop("text")
    s = lambda f: F.col(f"__scan.{f}")
    base, kept = s("base"), s("detections")
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    strongest = F.array_max(F.transform(kept, lambda x: -x["neg_priority"]))
    score = F.when(F.size(base) > 0, 1.0)
    for p, v in LEVEL_SCORE.items():
        score = score.when(strongest == p, v)
    return df.select(
        "doc_id",
        s("n_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base["at"]).cast("long").alias("first_word"),
        F.array_max(base["at"]).cast("long").alias("last_word"),
        names(base["label"]).alias("base_labels"),
        names(F.concat(base["label"], kept["label"])).alias("labels"),
        score.otherwise(0.0).alias("score"),
    )
