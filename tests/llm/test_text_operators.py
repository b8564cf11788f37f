"""The dealt operators on small tables against brute force; nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import functools
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from canopyql.llm import jaccard_join, language_id, license_scan, packing, quality_classifier, quality_rules, sentencepiece_codec, substring_dedup
from canopyql.llm.words import Words, text_buffer, window_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, __text string"


def corpus(seed: int = 1) -> list[str | None]:
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 7))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, base = say(70), [say(r.randint(30, 200)) for _ in range(25)]
    out: list[str | None] = [None, "", " \n\t ", "one", "one two three", "ONE two three", "same same same same same same same same same same same same", say(4000)]
    for b in base:
        out.append(b)
        for _ in range(r.randint(0, 3)):
            w = b.split()
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            out.append("  ".join(w) if r.random() < 0.3 else " ".join(w))
    out += [say(20) + " " + passage + "\n" + say(20) for _ in range(15)] + [base[0]] * 12 + [passage + " " + passage]
    near = say(150).split()
    for _ in range(60):
        w = list(near)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if i % 7 == 0 else "en" if i % 2 else "de", None if i % 5 == 0 else f"s{i % 3}", len(t or ""), i, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components_by_force(sets):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def test_windows_equal_iff_words_equal(texts):
    import pyarrow as pa

    offsets, data = text_buffer(pa.array(texts))
    w = Words(offsets, data, 0, len(texts))
    for k in (5, 20):
        h, at = window_hashes(w.hashes(), w.words, k)
        want = [tuple(x[i : i + k]) for t in texts for x in [WORD.findall(t or "")] for i in range(len(x) - k + 1)]
        assert len(h) == len(want) == at[-1]
        assert len(set(zip(h.tolist(), want, strict=True))) == len(set(h.tolist())) == len(set(want))


@pytest.mark.parametrize("hot", [1, 3, 8])
def test_jaccard(docs, texts, hot, monkeypatch):
    """With a low bound nearly every group is hot, so that families are needed."""
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    sets = [shingles(t) for t in texts]
    want = components_by_force(sets)
    got = {r.doc_id: r for r in jaccard_join.jaccard_components(docs).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]


def test_jaccard_families_in_blocks(docs, texts, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT", 1)
    monkeypatch.setattr(jaccard_join, "RESERVE", -10.0)
    monkeypatch.setattr(jaccard_join, "FAMILY_BLOCK", 7)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
    assert [got[i] for i in range(len(texts))] == components_by_force([shingles(t) for t in texts])


@pytest.mark.parametrize("block", [5, 1024])
def test_family_links_are_all_links(spark, block, monkeypatch):
    """Rare shingles, inner prefixes and bands of sizes lose no link and make none up, though templates are shared by all."""
    from canopyql.llm.storage import Scratch

    monkeypatch.setattr(jaccard_join, "FAMILY_BLOCK", block)
    r = random.Random(block)
    templates = [r.sample(range(10**6), n) for n in (3, 8, 20, 45, 60)]
    sets = []
    for _ in range(260):
        t = r.choice(templates)
        own = set(t[: r.randint(len(t) // 2, len(t))]) | {r.randrange(10**6) for _ in range(r.randint(0, len(t) // 2 + 1))}
        sets.append(sorted(own))
        if r.random() < 0.4:
            sets.append(sorted(set(own) - set(r.sample(sorted(own), r.randint(0, len(own) // 4))) | {r.randrange(10**6) for _ in range(r.randint(0, len(own) // 4))}))
    want = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(set(sets[i]) & set(sets[j])) >= 75 * len(set(sets[i]) | set(sets[j]))}
    own = spark.createDataFrame([(i, i, x) for i, x in enumerate(sets)], "doc long, c long, s array<long>")
    rare = jaccard_join.rarest_shingles(own, 75)
    got = {(max(x.a, x.b), min(x.a, x.b)) for x in jaccard_join.family_links(own, rare, Scratch(spark), 75).collect()}
    assert got == want and len(want) > 30


@pytest.mark.parametrize("percent", [75, 90])
def test_signatures_lose_no_pair(percent):
    """Pairs at the threshold share a posting, whatever their sizes; tiny sets leave many segments empty."""
    r, bands = np.random.default_rng(3), jaccard_join.Bands(percent)
    for n in [1, 2, 3, 4, 5, 7, 8, 11, 16, 30, 61, 150, 400]:
        for _ in range(40):
            a = r.integers(0, 2**63, n).astype(np.uint64)
            keep = a[: max(1, int(np.ceil(n * 2 * percent / (100 + percent))))]
            b = np.concatenate([keep, r.integers(0, 2**63, n).astype(np.uint64)[: int((100 * len(keep) // percent) - n)]]) if n > 1 else a
            inner, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            if 100 * inner < percent * union:
                continue
            s = np.concatenate([np.sort(np.unique(a)), np.sort(np.unique(b))])
            at = np.array([0, len(np.unique(a)), len(s)])
            found = [set(), set()]
            for x, row, _ in jaccard_join.signatures(s, at, bands):
                for h, k in zip(x.tolist(), row.tolist(), strict=True):
                    found[k].add(h)
            assert found[0] & found[1], (n, len(a), len(b))


def removed_by_force(texts):
    words, first = [WORD.findall(t or "") for t in texts], {}
    for d, w in enumerate(words):
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    out = []
    for d, w in enumerate(words):
        gone = {x for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d for x in range(i, i + 50)}
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("flush", [50, 1_000_000])
def test_substring_dedup(docs, texts, flush, monkeypatch):
    from canopyql.llm import postings

    monkeypatch.setattr(postings, "FLUSH", flush)
    monkeypatch.setattr(postings, "PER_BLOB", 1)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.report(docs).collect()}
    assert [got[i] for i in range(len(texts))] == removed_by_force(texts)


def test_substring_filter_keeps_columns(docs, texts):
    out = substring_dedup.filter_documents(docs)
    assert out.columns == docs.columns
    want = removed_by_force(texts)
    for r in out.collect():
        assert hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest() == want[r.doc_id][2]
        assert r.n_chars == len(r.text or "")
        if not want[r.doc_id][1]:
            assert r.text == texts[r.doc_id]


def test_repeated_rows(spark):
    t = " ".join(f"w{i}" for i in range(60))
    d = spark.createDataFrame([(5, t), (5, t), (5, "other words here"), (7, t)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substring_dedup.report(d).collect()) == [(5, 0), (5, 0), (5, 0), (7, 60)]
    assert sorted((r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(d).collect()) == [(5, 5)] * 3 + [(7, 5)]


def test_substring_dedup_without_ids(spark):
    """A row without an id is neither smaller nor larger than another; a true -1 is an id like any."""
    t = " ".join(f"w{i}" for i in range(60))
    d = spark.createDataFrame([(None, t), (None, t), (3, t), (-1, t + " x"), (None, None)], "doc_id long, text string")
    assert Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.report(d).collect()) == Counter([(None, 60, 0), (None, 60, 0), (None, 0, 0), (3, 60, 60), (-1, 61, 0)])
    assert Counter((r.doc_id, r.text) for r in substring_dedup.filter_documents(d).collect()) == Counter([(None, t), (None, t), (None, None), (3, ""), (-1, t + " x")])


def test_null_and_repeated_ids(spark):
    r = random.Random(11)
    say = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(80))
    a, b, c, d, e, f = (say() for _ in range(6))
    rows = [(None, a), (3, a + " x"), (None, b), (None, b), (None, b + " y"), (None, c), (4, d), (5, e), (5, d + " z"), (6, e + " u"), (7, f), (7, f), (None, None)]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, row int")
    kept = {x.row for x in jaccard_join.first_of_each(docs).collect()}
    # a and its copy: the one with an id; b: one of three; c: alone; d: 4 and not 5's second text; e: 5 and not 6; f: one of two equal rows
    assert {1, 5, 6, 7, 12} <= kept and not kept & {0, 8, 9}
    assert len(kept & {2, 3, 4}) == 1 and len(kept & {10, 11}) == 1 and len(kept) == 7
    got = Counter((x.doc_id, x.component_id) for x in jaccard_join.jaccard_components(docs).collect())
    # 5 is one node of the components, so d and e are one
    assert got == Counter([(3, 3), (None, 3), *[(None, None)] * 5, (4, 4), (5, 4), (5, 4), (6, 4), (7, 7), (7, 7)])


def rules_by_force(text):
    t, lines = text or "", [x for x in (text or "").split("\n") if WORD.search(x)]
    w = WORD.findall(t)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {x for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for x in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)


def test_quality_rules(docs, texts, spark):
    extra = ["a\nb\na\n\n\na\n b", "# $ % x & | <y> *", "a b c d e a b c d e f"]
    all_texts = texts + extra
    d = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(all_texts)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules.quality_report(d, least=5).collect()}
    for i, t in enumerate(all_texts):
        want = rules_by_force(t)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want
        assert got[i].base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (got[i].base_failed and got[i].kept)


def test_quality_rules_reject_the_odd_one(spark):
    r = random.Random(2)
    say = lambda: " ".join("".join(r.choice("abcdef") for _ in range(r.randint(2, 8))) for _ in range(60))
    rows = [(i, say(), "en", "s") for i in range(300)] + [(300 + i, " ".join(w + "***" for w in say().split()), "en", "s") for i in range(3)]
    kept = {x.doc_id for x in quality_rules.filter_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert kept == set(range(300))


def packed_by_force(tokenizer, text, most):
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
    return ids


def test_packing(docs, texts, spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(str(path))
    end = "<|endoftext|>"
    odd = ["a  b \n\nc", "it's we'll", f"{end} hi", f"hi {end}", f"{end}{end}", f"{end} {end}\n{end}", f"a{end}b c  {end}  d", f"x\u3000{end} y", "<|endoftext", "🙂 a\u3000b", "   \n", "日本語"]
    r = random.Random(5)
    odd += ["".join(r.choice([" ", "  ", "\n", "\t", "\u00a0", "ab", "'s", "é", "9", ".", end]) for _ in range(r.randint(1, 30))) for _ in range(300)]
    rows = [(i, x) for i, x in enumerate([*texts, *odd])]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), str(path), most=64, with_ids=True).collect()
    assert len({r.sequence_id for r in out}) == len(out)
    for i, x in rows:
        pieces = sorted((r for r in out if r.doc_id == i), key=lambda r: r.start)
        ids = packed_by_force(t, x, 64)
        assert [y for r in pieces for y in r.ids] == ids
        assert all(r.length & (r.length - 1) == 0 and r.length <= 64 and r.offset == 0 and r.doc_tokens == len(ids) for r in pieces)
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in pieces)
    assert packing.piece_lengths(2048 * 2 + 5, 2048) == [2048, 2048, 4, 1]
    assert t.encode(f"{end} hi", add_special_tokens=False).ids == [50256, 23105]
    with pytest.raises(ValueError):
        packing.pack(docs, str(path), most=100)


def test_packing_with_a_tokenizer_that_joins_spans(spark):
    """A tokenizer that doesn't cut at blanks itself sees whole texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    t = Tokenizer.from_file(path)
    rows = list(enumerate(["Hello  World", None, "", "a<|endoftext|> b\n c"]))
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), path, with_ids=True).collect()
    for i, x in rows:
        assert [y for r in sorted((r for r in out if r.doc_id == i), key=lambda r: r.start) for y in r.ids] == [*t.encode(x or "", add_special_tokens=False).ids, 1]


def test_sentencepiece(texts, spark):
    import public_tokenizers
    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = ["  two  blanks ", "a ▁b", "▁", "日本 🙂 ́x", "aaaaaaa aaaaaaaaaaaa", "\n\t\n", "x" * 300]
    rows = [(i, x) for i, x in enumerate([*texts, *odd])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    enc = sentencepiece_codec.encode_documents(d, path)
    ids = {r.doc_id: r.ids for r in enc.collect()}
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode_documents(enc, path).collect()}
    rep = {r.doc_id: r for r in sentencepiece_codec.report(d, path).collect()}
    for i, x in rows:
        want = sp.encode(x or "")
        assert ids[i] == want and back[i] == sp.decode(want) and rep[i].n_ids == len(want) and rep[i].round_trip
        assert rep[i].ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())


def test_unigram_states():
    """A unigram vocabulary made by hand: the pass finds the best of all segmentations."""
    from itertools import product

    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.trainer_spec.model_type = 1
    proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.escape_whitespaces = True, False, True
    vocabulary = {"▁": -3.0, "a": -2.0, "b": -2.5, "c": -3.5, "ab": -3.1, "▁a": -3.2, "bc": -4.2, "abc": -6.9, "▁ab": -4.0}
    for i, (p, s) in enumerate([("<unk>", 0.0), *vocabulary.items()]):
        x = proto.pieces.add()
        x.piece, x.score, x.type = p, s, 2 if i == 0 else 1
    c = sentencepiece_codec.Codec(proto.SerializeToString())

    def best(w):
        options = []
        for cuts in product([0, 1], repeat=len(w) - 1):
            parts, last = [], 0
            for i, cut in enumerate((*cuts, 1), 1):
                if cut:
                    parts.append(w[last:i])
                    last = i
            if all(p in vocabulary for p in parts):
                options.append(sum(vocabulary[p] for p in parts))
        return max(options)

    words = ["▁" + "".join(p) for n in (1, 2, 3, 4) for p in product("abc", repeat=n)]
    for w, ids in zip(words, c.encode_words(words), strict=True):
        parts = [proto.pieces[i].piece for i in ids]
        assert "".join(parts) == w and abs(sum(vocabulary[p] for p in parts) - best(w)) < 1e-5


@functools.cache
def compiled_rules():
    return [(p, a, b, regex.compile(rf"(?<![^ ])(?:{rx})(?![^ ])"), label) for p, a, b, rx, label in license_scan.rules()]


def license_by_force(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for label, p in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    joined, found = " ".join(w), []
    for p, k1, k2, rx, label in compiled_rules():
        if k1 in joined and k2 in joined and any(g in joined for g in license_scan.gate()):
            for m in rx.finditer(joined):
                a, b = joined[: m.start()].count(" "), joined[: m.end()].count(" ")
                found.append((a, b, p, label))
    kept = [x for x in found if not any(y is not x and y[0] <= x[0] and y[1] >= x[1] and y[2] >= x[2] and (y[:3] != x[:3] or y[3] < x[3]) for y in found)]
    labels = {x for _, x in places} | {x[3] for x in kept if x[2] < 4}
    return len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels))


def test_license_scan(spark):
    texts = [None, "", "Released under the MIT License. Released under the\nMIT license", "Licensed under the Apache License, Version 2.0. All rights reserved.", "CC BY-NC 4.0 and cc by-nc-sa", "SPDX-License-Identifier: GPL-3.0-or-later", "licensed under the GNU General Public License, version 3.", "This is under the BSD 3-Clause license, copyleft", "no words of law", "under the mit " * 50 + "license", "dual MIT license and Mozilla Public License 2.0 licensed"]
    got = {r.doc_id: r for r in license_scan.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == license_by_force(t), t
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    assert got[5].labels == "gpl-3" and got[6].labels == "gpl-3" and len(license_scan.rules()) > 200


def labels_without_gates(text):
    """Labels when every rule runs, whatever its keywords."""
    joined = " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()))
    found = [(m.start(), m.end(), p, label) for p, _, _, rx, label in compiled_rules() for m in rx.finditer(joined)]
    kept = [x for x in found if not any(y is not x and y[0] <= x[0] and y[1] >= x[1] and y[2] >= x[2] and (y[:3] != x[:3] or y[3] < x[3]) for y in found)]
    words = f" {joined} "
    return ",".join(sorted({x[3] for x in kept if x[2] < 4} | {label for label, p in license_scan.BASE.items() if f" {p} " in words}))


def test_license_gates_hide_no_match(spark):
    want = {
        "Released under MIT": "mit",
        "Distributed under Apache 2.0": "apache-2",
        "Published under MPL 2.0": "mpl-2",
        "available under the ASL 2.0": "apache-2",
        "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
        "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
        "SPDX-License-Identifier: BSL-1.0": "boost-1",
        "SPDX-License-Identifier: BUSL-1.1": "bsl-1.1",
        "SPDX-License-Identifier: MS-PL": "ms-pl",
        "SPDX-License-Identifier: MS-RL": "ms-rl",
        "SPDX-License-Identifier: SSPL-1.0": "sspl-1",
        "SPDX-License-Identifier: CPL-1.0": "cpl-1",
        "SPDX-License-Identifier: ODbL-1.0": "odbl-1",
        "the Expat license": "mit",
        "zero clause BSD license": "bsd-0-clause",
        "released under the PSF": "python-2",
        "released under CC BY-SA": "cc-by-sa",
        "published under Creative Commons Attribution": "cc-by",
        "Licensed under the Expat license.": "mit",
        "Licensed under ODbL": "odbl-1",
    }
    # each name and identifier of each license in each setting, with and without the optional parts
    for names in license_scan.LICENSES.values():
        for setting in [rx for _, _, rx in license_scan.SETTINGS if "(?<=" not in rx]:
            for a in re.split(r"\|(?![^(]*\))", names[0] if "{name}" in setting else names[1]):
                for least in (True, False):
                    t = re.sub(r"\{\w+\}", lambda _: a, setting)
                    while t != (u := re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)(\?)?", lambda m: "" if m[2] and least else m[1], t)):
                        t = u
                    t = re.sub(r"(.)\?", "" if least else r"\1", re.sub(r"\[(.)[^\]]*\]", r"\1", t))
                    if t.split(" ") == t.split():
                        want.setdefault(t, None)
    texts = list(want)
    got = {r.doc_id: r.labels for r in license_scan.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(got[i] for i in range(len(texts)))
    for i, t in enumerate(texts):
        assert got[i] == labels_without_gates(t), t
        assert want[t] is None or want[t] in got[i].split(","), t


#: Texts as they stand in files, and all their labels, given by hand.
LICENSED = {
    "Released under CC BY-SA 4.0": "cc-by-sa",
    "Text: CC BY-SA 4.0": "cc-by-sa",
    "Mozilla Public License Version 2.0": "mpl-2",
    "You should have received a copy of the GNU Lesser General Public\n# License along with this library": "lgpl",
    "SPDX-License-Identifier: MIT OR Apache-2.0": "apache-2,mit",
    "// SPDX-License-Identifier: BSD-3-Clause AND CC-BY-SA-4.0": "bsd-3-clause,cc-by-sa",
    "SPDX-License-Identifier: (GPL-2.0-only OR MIT) AND Zlib": "gpl-2,mit,zlib",
    "GPL-2.0-only WITH Classpath-exception-2.0": "gpl-classpath-exception",
    "Redistributions of source code must retain the above copyright notice, this list": "bsd",
    "* Redistributions in binary form must reproduce the above copyright notice": "bsd",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products": "bsd-3-clause",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY': "mit",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "This is not licensed under the MIT license": "mit",  # the base phrase stays
    "This code is not licensed under the Zlib license": "",
    "It is no longer available under the BSD 2-Clause license": "",
    "not a library, licensed under the Zlib license": "zlib",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS": "apache-2",
    "see https://www.apache.org/licenses/LICENSE-2.0": "apache-2",
    "https://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.": "zlib",
    "The Software shall be used for Good, not Evil.": "json",
    "Proprietary and confidential. All rights reserved": "all-rights-reserved,proprietary",
    "for non-commercial use only": "noncommercial",
    "we drove under the bridge and took a licence plate": "",
    "he is a software engineer with a permit": "",
}


def test_licenses_as_they_stand(spark):
    texts = list(LICENSED)
    got = {r.doc_id: r.labels for r in license_scan.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("__scan_t", F.lit("x"))).collect()}
    assert {t: got[i] for i, t in enumerate(texts)} == LICENSED


def test_each_notice_is_found(spark):
    """Every hand-written line, with and without its optional parts, gives its own label unless a wider match holds it."""
    from canopyql.llm.license_notices import notices

    texts = []
    for p, label, rx in notices():
        for a in license_scan._alternatives(rx):
            for least in (True, False):
                t = re.sub(r"\(\?:\[a-z0-9\]\+ \)\{1,\d+\}\??", "some words ", a)
                while t != (u := re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)(\?)?", lambda m: "" if m[2] and least else m[1], t)):
                    t = u
                t = re.sub(r"(.)\?", "" if least else r"\1", re.sub(r"\[(.)[^\]]*\]\+?", r"\1", t))
                texts.append((" ".join(t.split()), p, label))
    got = {r.doc_id: r.labels for r in license_scan.report(spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(texts)], "doc_id long, text string")).collect()}
    for i, (t, p, label) in enumerate(texts):
        assert got[i] == labels_without_gates(t), t
        assert p == 4 or got[i], t
    assert sum(label in got[i].split(",") for i, (_, p, label) in enumerate(texts) if p < 4) > 0.9 * sum(p < 4 for _, p, _ in texts)
    assert len(notices()) > 150


def test_classifier_and_language(spark):
    r = random.Random(4)
    words = {"en": ["the", "and", "of", "ther", "ingo"], "fr": ["le", "la", "ément", "queau", "des"]}
    rows, labels = [], []
    for i in range(400):
        lang = "en" if i % 2 else "fr"
        w = [r.choice(words[lang]) + r.choice(["", "", "s"]) for _ in range(60)]
        good = i % 5 > 0
        rows.append((i, " ".join(w if good else [x.upper() + "!!" for x in w]), lang, "s"))
        labels.append((i, int(good), 0))
    rows += [(900, None, None, "s"), (901, "", None, "s"), (902, "123 !!", None, None)]
    d, l = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame([*labels, (5000, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality_classifier.report(d, l).collect()}
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) and x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got.values()) and len(got) == len(rows)
    held = [i for i in range(400) if got[i].held_out]
    assert sum(got[i].predicted == int(i % 5 > 0) for i in held) > 0.95 * len(held)
    assert {x.doc_id for x in quality_classifier.filter_documents(d, l).collect()} == {i for i, x in got.items() if x.score >= 0.7}
    lang = {x.doc_id: x for x in language_id.report(d).collect()}
    held = [i for i in range(400) if lang[i].held_out and i % 5]
    assert all(lang[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(400))
    assert sum(lang[i].lang_pred == ("en" if i % 2 else "fr") for i in held) > 0.95 * len(held)
    assert all(lang[i].lang_pred == "und" and lang[i].score == 0 for i in (900, 901, 902))


def test_empty_tables(none, spark):
    import public_tokenizers

    bpe, model = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    outs = [jaccard_join.jaccard_components(none), quality_classifier.report(none, labels), language_id.report(none), substring_dedup.report(none), quality_rules.quality_report(none), packing.pack(none, bpe), license_scan.report(none), sentencepiece_codec.report(none, model), quality_rules.filter_documents(none), substring_dedup.filter_documents(none), jaccard_join.first_of_each(none)]
    assert [o.count() for o in outs] == [0] * len(outs)


def test_no_labels(docs, spark):
    out = quality_classifier.report(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert out.filter("score <> 0.5").count() == 0
    assert language_id.report(docs.withColumn("lang", F.lit(None).cast("string"))).filter("lang_pred <> 'und'").count() == 0
