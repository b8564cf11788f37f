"""Near-duplicate vectors against brute force, HTML text, and the pipeline's stages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyql.llm import embedding_dedup
from canopyql.llm.components import components
from canopyql.llm.html_text import extract, page_text
from canopyql.llm.storage import Scratch


def roots(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    r = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 560)]
    got = {x.node: x.component for x in components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark)).collect()}
    want = roots(600, pairs)
    assert all(got.get(i, i) == want[i] for i in range(600))
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


@pytest.mark.parametrize("k", [3, 12])
def test_vectors(spark, k):
    r = np.random.default_rng(6)
    base = r.standard_normal((120, 16))
    rows = [(v.astype(np.float32).tolist(), int(i % 3)) for i, v in enumerate(base)]
    rows += [((base[0] + 0.02 * r.standard_normal(16)).astype(np.float32).tolist(), 0) for _ in range(40)]
    rows += [(rows[1][0], 1)] * 9 + [((2 * base[4]).astype(np.float32).tolist(), 1), (rows[4][0], 2)]
    rows += [(None, 1), ([0.0] * 16, 1), ([float("nan")] * 16, 1), ([None] * 16, 1), (rows[0][0], None), ([1.0, 0.0], 1), ([float("inf")] * 16, 1)]
    d = spark.createDataFrame([(i, v, label, "x") for i, (v, label) in enumerate(rows)], "vec_id long, embedding array<float>, label int, cid string").withColumns({"vec": F.lit(1), "n": F.lit(2)})
    got = {x.vec_id: x for x in embedding_dedup.near_duplicates(d, k=k).collect()}
    pairs = []
    fine = [i for i, (v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for i in fine:
        for j in fine:
            if i < j and rows[i][1] == rows[j][1] and len(rows[i][0]) == len(rows[j][0]):
                a, b = np.array(rows[i][0], float), np.array(rows[j][0], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                    pairs.append((i, j))
    links = np.bincount(np.array(pairs).ravel(), minlength=len(rows))
    assert len(got) == len(rows)
    assert [got[i].n_links for i in range(len(rows))] == links.tolist()
    assert [got[i].component_id for i in range(len(rows))] == roots(len(rows), pairs)
    assert all(x.kept == (x.component_id == x.vec_id) for x in got.values())


def vectors_by_force(rows):
    x = np.array([v for v, _ in rows], np.float32).astype(float)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    label = np.array([y for _, y in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    return near.sum(1).tolist(), roots(len(rows), np.argwhere(np.triu(near)).tolist())


def found_vectors(spark, rows, **options):
    d = spark.createDataFrame([(i, v, y) for i, (v, y) in enumerate(rows)], "vec_id long, embedding array<float>, label int")
    got = {x.vec_id: x for x in embedding_dedup.near_duplicates(d, **options).collect()}
    return [got[i].n_links for i in range(len(rows))], [got[i].component_id for i in range(len(rows))]


@pytest.mark.parametrize("size", [1 << 14, 1 << 20])
def test_full_lists_hide_another_group(spark, size, monkeypatch):
    """Two groups of near copies whose lists hold their own group only, though most pairs across link."""
    monkeypatch.setattr(embedding_dedup, "SEARCH_BYTES", size)
    monkeypatch.setattr(embedding_dedup, "LONGEST", 24)
    r = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    a = unit(r.standard_normal(64))
    o = r.standard_normal(64)
    centres = [a, unit(a + 0.25 * unit(o - (o @ a) * a))]
    rows = [(unit(c + 0.175 * unit(r.standard_normal(64))).astype(np.float32).tolist(), 0) for c in centres for _ in range(150)]
    rows += [(r.standard_normal(64).astype(np.float32).tolist(), int(i % 2)) for i in range(100)]
    links, component = vectors_by_force(rows)
    assert component[150] == 0 and min(links[:300]) > 150
    assert found_vectors(spark, rows) == (links, component)


def planted(share: float, n: int = 6000, dims: int = 32):
    """n vectors of one label and a share of them in groups of near copies of 2 to 60, and a group that chains."""
    r = np.random.default_rng(int(1000 * share))
    rows, left = list(r.standard_normal((n - int(share * n), dims))), int(share * n)
    while left > 1:
        size = min(left, int(r.choice([2, 2, 2, 3, 5, 12, 13, 14, 30, 60])))
        base = r.standard_normal(dims)
        rows += [base + 0.1 * r.standard_normal(dims) for _ in range(size)]
        left -= size
    x, step = r.standard_normal(dims), r.standard_normal(dims)
    rows += [x + 0.25 * i * step for i in range(12)]
    return [(rows[i].astype(np.float32).tolist(), 0) for i in r.permutation(len(rows))]


@pytest.mark.parametrize("share", [0.001, 0.05, 0.5])
def test_descent_finds_planted_links(spark, share, monkeypatch):
    """Recall of the lists alone: no audit fails and no list is searched exactly."""
    rows = planted(share)
    links, component = vectors_by_force(rows)
    monkeypatch.setattr(embedding_dedup, "LONGEST", 256)
    monkeypatch.setattr(embedding_dedup, "near_pivots", None)
    got, parts = found_vectors(spark, rows, least_recall=0.0)
    assert all(x <= y for x, y in zip(got, links, strict=True))
    assert sum(got) >= 0.97 * sum(links) > 10
    assert found_vectors(spark, rows[:1500])[1] == vectors_by_force(rows[:1500])[1] and len(parts) == len(component)


def rare_links():
    """2,000 vectors of one label, of which one in a hundred has a link, and a small label."""
    r = np.random.default_rng(9)
    rows = [(v.astype(np.float32).tolist(), 0) for v in r.standard_normal((2000, 32))]
    rows += [((np.array(rows[100 * i][0]) + 0.05 * r.standard_normal(32)).astype(np.float32).tolist(), 0) for i in range(20)]
    return rows + [(rows[0][0], 1), (rows[2000][0], 1)]


def test_failed_audit_compares_exactly(spark, monkeypatch):
    """A descent that finds nothing is noticed, though one vector in a hundred has a link, and made good."""
    rows = rare_links()
    want = vectors_by_force(rows)
    assert sum(want[0]) == 42
    monkeypatch.setattr(embedding_dedup, "ATTEMPTS", 2)
    nothing = lambda nodes, *_: nodes.limit(0).selectExpr("cid + 0 as cid", "cast('' as binary) ids", "cast('' as binary) codes", "cast('' as binary) dists")
    monkeypatch.setattr(embedding_dedup, "first_lists", nothing)
    monkeypatch.setattr(embedding_dedup, "descend", nothing)
    assert found_vectors(spark, rows) == want


def test_audit_by_label(spark):
    v = lambda *x: np.array(x, np.float32).tobytes()
    rows = [(1, 0, v(1, 0)), (2, 0, v(1, 0.01)), (5, 0, v(0, 1)), (3, 1, v(1, 0)), (4, 1, v(1, 0.01)), (6, 2, v(0, 1)), (7, 3, v(1, 1)), (8, 3, v(1, 1.01))]
    nodes = spark.createDataFrame(rows, "cid long, label int, vec binary").withColumn("bytes", F.length("vec"))
    links, full = spark.createDataFrame([(1, 2)], "a long, b long"), spark.createDataFrame([(7,), (8,)], "cid long")
    assert {x.label: (x.links, x.recall) for x in embedding_dedup.audit(nodes, links, full, 0.93).collect()} == {0: (2, 1.0), 1: (2, 0.0)}


def test_vectors_without_or_with_equal_ids(spark):
    x, y, z = [1.0, 0.0, 0.0], [1.0, 0.01, 0.0], [0.0, 1.0, 0.0]
    rows = [(None, x, 0), (None, y, 0), (None, z, 0), (7, x, 0), (8, z, 1), (8, y, 1), (9, x, 1), (None, None, None), (10, z, None)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    key = lambda r: tuple((v is None, v) for v in r)
    want = [(None, 2, 7, False), (None, 2, 7, False), (None, 0, None, True), (7, 2, 7, True), (8, 0, 8, True), (8, 1, 8, True), (9, 1, 8, False), (None, 0, None, True), (10, 0, 10, True)]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_vectors_of_an_empty_table(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


PAGES = {
    "<p>one<p>two": "one\n\ntwo",
    "<ul><li>a<li>b<ul><li>c</ul></ul><ol start=3><li>x<li>y</ol>": "- a\n- b\n  - c\n\n3. x\n4. y",
    "<table><tr><th>Name<th>Qty<tr><td>apple<td>3<tr><td>kiwi pie<td>12</table>": "Name      Qty\napple     3\nkiwi pie  12",
    "a<br>b &amp; &lt;c&gt; 1 < 2": "a\nb & <c> 1 < 2",
    "<head><title>t</title></head><body>x<script>var a='</p>';</script><style>p{}</style><!-- c --><div hidden>h</div><p style='display: none'>n</p>y</body>": "xy",
    "<pre> a\n   b</pre>": " a\n   b",
    "<dl><dt>t<dd>d</dl>": "t\n  d",
    "<div>a<div>b</div>c</div>": "a\nb\nc",
    "<h1>T</h1><p>a <b>b</b>  c</p>": "T\n\na b c",
    "plain text": "plain text",
    "</p></div><b>x": "x",
    "<html><head><title>t</title>Hello <b>world</b> text<p>para": "Hello world text\n\npara",
    "<head><meta charset=x> \n<span>a</span><title>t</title>b": "ab",
    "<div style='visibility:hidden'>a<b style='color:red; visibility: visible'>B</b>c<p>d</div>e": "B\n\ne",
    "<div style='display:none'>a<b style='visibility:visible'>B</b></div>c": "c",
    "<table><tr><td rowspan=2>A<td>B<tr><td>C</table>": "A  B\n   C",
    "<table><tr><td>a<td rowspan=2>b<td rowspan=3>c<tr><td>d<tr><td>e<td>f</table>": "a  b  c\nd\ne  f",
    "<table><tr><th colspan=2>ab<th>z<tr><td>1<td>22<td>3</table>": "ab      z\n1   22  3",
    "<select><option>one<option selected>two</select><math><mi>x</mi><annotation>tex</annotation></math>": "one\ntwo\nx",
    "<svg><title>no</title><text>yes</text><desc>nah</desc></svg>": "yes",
    "a <p title=\"q'> z</p> more": "a\n\nz\n\nmore",
    "x < y <b": "x < y",
    "": "",
}


@pytest.mark.parametrize("source", PAGES)
def test_page(source):
    assert page_text(source) == PAGES[source]


def test_all_visible_words_come_out(spark):
    """Every text node outside hidden elements is in the result, once."""
    import random

    r = random.Random(7)
    for _ in range(200):
        words, out = [f"w{i}" for i in range(30)], []
        for w in words:
            out += [r.choice(["<p>", "<div>", "<b>", "</b>", "</div>", "<li>", "<ul>", "</ul>", "<table><tr><td>", "</table>", "<br>", "<span>", "</p>", "<td>", "<tr>"]), w, " "]
        assert sorted(x for x in page_text("".join(out)).split() if x != "-") == sorted(words)


@pytest.mark.parametrize("unit", ["<a ", '<a x="', "<a x='\"", "<b><table><a>", "<ul><li>x", "<table><tr><td>x", "<td rowspan=9999>x<tr>", "<dl><dt><dd>y", "<p><i>", "<!-", "</p>", "&amp;<q "])
def test_hostile_pages_take_linear_time(unit):
    import time

    took = []
    for n in (20_000, 80_000):
        t = time.perf_counter()
        page_text(unit * n)
        took.append(time.perf_counter() - t)
    assert took[1] < 12 * took[0] + 0.5 and took[1] < 10


def random_page(r) -> tuple[str, str]:
    """A page of paragraphs, lists and tables with some end tags left out, and its text by a version of its own."""
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(1, 6)))
    end = lambda tag: f"</{tag}>" if r.random() < 0.5 else ""

    def paragraph():
        t = " ".join(word() for _ in range(r.randint(1, 5)))
        return f"<p>{t.replace(' ', r.choice([' ', '  ', chr(10), '<b> </b>']))}{end('p')}", [t]

    def listing(depth=0):
        kind, source, lines = r.choice(["ul", "ol"]), "", []
        for k in range(r.randint(1, 3)):
            w = word()
            source += f"<li>{w}"
            lines.append("  " * depth + (f"{k + 1}. " if kind == "ol" else "- ") + w)
            if depth < 2 and r.random() < 0.4:
                inner, more = listing(depth + 1)
                source, lines = source + inner, lines + more
            source += end("li")
        return f"<{kind}>{source}</{kind}>", lines

    def table():
        taken, cells, source = set(), {}, ""
        height = r.randint(1, 5)
        for y in range(height):
            source += "<tr>"
            x = 0
            for _ in range(r.randint(1, 4)):
                while (y, x) in taken:
                    x += 1
                w, across, down = word(), r.choice([1, 1, 1, 2, 3]), r.choice([1, 1, 1, 2, 3])
                source += f"<{r.choice(['td', 'th'])}{f' colspan={across}' if across > 1 else ''}{f' rowspan={down}' if down > 1 else ''}>{w}{end('td') if r.random() < 0.1 else ''}"
                cells[y, x] = w
                # a cell that reaches over another one's place lies under it
                taken |= {(y + j, x + i) for i in range(across) for j in range(down)}
                x += across
            source += end("tr")
        columns = sorted({x for _, x in cells})
        width = {x: max(len(w) for (_, k), w in cells.items() if k == x) for x in columns}
        lines = []
        for y in range(height):
            lines.append("  ".join(cells.get((y, x), "").ljust(width[x]) for x in columns).rstrip())
        return f"<table>{source}</table>", lines

    source, blocks = "", []
    for _ in range(r.randint(1, 6)):
        part, lines = r.choice([paragraph, listing, table])()
        source += part
        blocks.append("\n".join(lines))
    return source, "\n\n".join(blocks)


def test_random_pages_with_tables():
    import random

    r = random.Random(11)
    for _ in range(600):
        source, want = random_page(r)
        assert page_text(source) == want, source


def test_pages_table(spark):
    d = spark.createDataFrame([(1, None), (2, "<p>x"), (2, "<p>x"), (3, "<b>" * 2000 + "deep"), (None, "y")], "page_id int, html string")
    clash = d.withColumns({"text": F.lit("clash"), "n_lines": F.lit(None).cast("string")})
    assert sorted(((r.page_id, r.text) for r in extract(clash).collect()), key=lambda x: (x[0] is None, x)) == [(1, ""), (2, "x"), (2, "x"), (3, "deep"), (None, "y")]
    assert extract(d.limit(0)).count() == 0


def test_pipeline(spark):
    import os

    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables here")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "quality_classifier", "ngram_jaccard_join", "substring_dedup", "packing"]
    scratch = Scratch(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = scratch.save(stage(spark, docs, d))
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        docs = out
    assert corpus_pipeline.run(spark, d).agg({"length": "sum"}).first()[0] > 0
