"""Modules, documents in three formats, constraints and generators."""

import ast
import json
import xml.etree.ElementTree as ET

import pytest

from canopyql.catalog import generate
from canopyql.catalog.module import CircularImport, Loader, ModuleError
from canopyql.engine import Engine
from canopyql.operators import constraints
from canopyql.sources import files

MODEL = """<MODEL xmlns="http://example.org/model"><schema-name>Test</schema-name><short-name>t</short-name><schema-version>1</schema-version><namespace>http://example.org/ns</namespace>
<define-flag name="id" as-type="token"><constraint><allowed-values><enum value="doc-1"/><enum value="doc-2" deprecated="1.0"/></allowed-values></constraint></define-flag>
<define-flag name="key" as-type="token"/><define-field name="title"/><define-field name="size" as-type="integer"/>
<define-field name="note" as-type="markup-multiline"><json-key flag-ref="key"/><flag ref="key" required="yes"/></define-field>
<define-assembly name="document"><root-name>document</root-name><flag ref="id" required="yes"/>
<model><field ref="title" min-occurs="1"/><field ref="size"/><field ref="note" max-occurs="unbounded"><group-as name="notes" in-json="BY_KEY" in-xml="GROUPED"/></field>
<choice><field ref="title"><use-name>alias</use-name></field></choice>
<define-assembly name="part" max-occurs="unbounded"><group-as name="parts" in-json="SINGLETON_OR_ARRAY"/><define-flag name="n" as-type="integer"/></define-assembly></model>
<constraint><expect test="title" level="WARNING"/><has-cardinality target="part" max-occurs="1"/><is-unique target="part"><key-field target="@n"/></is-unique><matches target="title" regex="^[A-Z]"/></constraint></define-assembly></MODEL>"""
DOCS = [
    ("a.json", '{"document":{"id":"doc-1","title":"Hi","size":"x","other":1,"notes":{"k1":{"STRVALUE":"n"}},"parts":[{"n":1},{"n":1}]}}'),
    ("b.yaml", "document:\n  id: doc-2\n  title: low\n  size: 3\n---\nsecond: 1\n"),
    ("c.xml", '<document xmlns="http://example.org/ns" id="doc-3"><title>T &amp; U</title><notes><note key="q">some <b>x</b></note></notes><part n="4"/></document>'),
    ("d.json", "{bad"),
    ("e.json", '{"else": {}}'),
    ("f.json", None),
]


@pytest.fixture(scope="module")
def module():
    return Loader().parse(MODEL)


@pytest.fixture(scope="module")
def docs(spark, module):
    return files.read_documents(Engine(spark), spark.createDataFrame(DOCS, "path string, content string"), module, "document")


def test_documents(docs):
    rows = {r.path: r for r in docs.df.collect()}
    assert rows["a.json"].doc.title.STRVALUE == "Hi" and rows["a.json"].doc.size.STRVALUE is None and rows["a.json"].raw.size.STRVALUE == "x"
    assert rows["b.yaml"].doc.size.STRVALUE == 3
    assert rows["c.xml"].doc.note[0].STRVALUE == "some <b>x</b>"
    assert all(rows[p].error for p in ("d.json", "e.json", "f.json"))
    assert {r.path: r.value for r in docs.eval("sum((size, part/@n))").collect()}["c.xml"] == 4


@pytest.mark.parametrize("fmt", ["json", "xml", "yaml"])
def test_round_trip(docs, module, fmt):
    out = files.convert(docs, module, "document", fmt).filter("content is not null")
    back = files.read_documents(docs.engine, out, module, "document", fmt)
    raw = lambda d: sorted(str(r) for r in d.df.filter("raw is not null").select("path", "raw").collect())
    assert raw(docs) == raw(back)


def test_findings(docs, module):
    found = constraints.validate(docs, constraints.of_module(module, "document")).collect()
    kinds = {(r.doc, r.kind, r.severity) for r in found}
    assert {("a.json", "has-cardinality", "ERROR"), ("a.json", "is-unique", "ERROR"), ("b.yaml", "matches", "ERROR"), ("b.yaml", "allowed-values", "WARNING"), ("c.xml", "allowed-values", "ERROR")} == kinds
    assert [(r.doc, r.location) for r in constraints.type_findings(docs, module, "document").collect()] == [("a.json", "/document/size")]


def test_expect_errors_and_bad_patterns(docs):
    from canopyql.catalog.module import Constraint

    found = constraints.validate(docs, [(".", Constraint("expect", test="nope(.)")), (".", Constraint("matches", target="title", regex="[invalid(")), (".", Constraint("index-has-key", name="none", target="part", keys=[("@n", None)]))]).collect()
    assert any("Error evaluating" in r.message for r in found) and any("Invalid regex" in r.message for r in found) and any("not found" in r.message for r in found)


def test_generators(module):
    schema = json.loads(generate.json_schema(module))
    assert schema["$defs"]["assembly-document"]["required"] == ["id", "title"]
    ET.fromstring(generate.xsd(module).encode())
    ast.parse(generate.python_classes(module, frozen=True))
    assert "note:array<struct<key:string,STRVALUE:string>>" in generate.spark_schema(module.roots()["document"]).simpleString()


def test_imports():
    part = lambda body: f"<M><schema-name>x</schema-name>{body}</M>".encode()
    places = {"main": part('<import href="one"/><import href="two"/><define-assembly name="r"><root-name>r</root-name><flag ref="f"/><flag ref="hidden"/></define-assembly>'), "one": part('<define-flag name="f" as-type="string"/><define-flag name="hidden" scope="local"/>'), "two": part('<define-flag name="f" as-type="token"/>'), "a": part('<import href="b"/>'), "b": part('<import href="a"/>')}
    loader = Loader(places.__getitem__)
    m = loader.load("main")
    flags = m.definitions["assembly", "r"].flags
    assert flags[0].definition.datatype == "token" and flags[1].definition is None and loader.load("main") is m
    with pytest.raises(CircularImport) as e:
        loader.load("a")
    assert e.value.chain == ["a", "b", "a"]
    with pytest.raises(ModuleError):
        Loader().parse("<broken")


def test_recursive_model():
    m = Loader().parse('<M><define-assembly name="part"><root-name>part</root-name><model><assembly ref="part"/></model></define-assembly></M>')
    with pytest.raises(ModuleError):
        generate.spark_schema(m.roots()["part"])


def test_nodes_of_a_recursive_model(spark):
    from canopyql.operators.nodes import descendants

    m = Loader().parse('<M><define-flag name="n"/><define-assembly name="part"><root-name>part</root-name><flag ref="n"/><model><assembly ref="part" max-occurs="unbounded"><group-as name="parts"/></assembly></model></define-assembly></M>')
    text = '{"part": {"n": "a", "parts": [{"n": "b", "parts": [{"n": "c"}]}, {"n": "d"}]}}'
    nodes = files.read_nodes(Engine(spark), spark.createDataFrame([("x.json", text), ("y.json", "{")], "path string, content string"), m, "part")
    rows = sorted((r.pre, r.size, r.level, r.parent_pre, r.flags.get("n")) for r in nodes.collect())
    assert rows == [(0, 4, 0, None, None), (1, 3, 1, 0, "a"), (2, 1, 2, 1, "b"), (3, 0, 3, 2, "c"), (4, 0, 2, 1, "d")]
    assert descendants(nodes, ["path"]).count() == sum(r[1] for r in rows)


def test_command_line(tmp_path, capsys):
    from canopyql.__main__ import main

    p = tmp_path / "m.xml"
    p.write_text(MODEL)
    assert main(["validate-module", str(p)]) == 0 and main(["generate-schema", str(p), "--type", "xsd"]) == 0 and main(["generate-code", str(p)]) == 0
    assert main(["validate-module", str(tmp_path / "none.xml")]) == 1


def test_stream(spark, module, tmp_path):
    from canopyql.streaming.documents import document_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(DOCS[0][1])
    docs = document_stream(Engine(spark), str(tmp_path / "in"), module, "document")
    q = docs.eval("title").writeStream.format("memory").queryName("titles").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.value for r in spark.sql("select value from titles").collect()] == ["Hi"]


def test_single_value_rules_read_documents_once(spark):
    """However many constraints there are, orders and lines are read once; findings come in the order of their nodes."""
    from canopyql.engine import Engine
    from canopyql.operators.constraints import LEVELS, at_or_above, merged, ordered, validate
    from canopyql.catalog.module import Constraint
    from canopyql.sources import tables

    docs = tables.orders(Engine(spark), "/root/testdata/sf0.001")
    rules = [(".", Constraint("allowed-values", target="@orderstatus", values={"F": None})), (".", Constraint("has-cardinality", target="line", most=3, level="CRITICAL"))]
    rules += [("line", Constraint("expect", test=f"@quantity < {n}", level="WARNING")) for n in (10, 20, 30)]
    found = validate(docs, rules)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    both = ordered(merged(found, validate(docs, rules[:1]))).collect()
    assert [(r.doc, r.at) for r in both] == sorted((r.doc, r.at) for r in both)
    worst = at_or_above(found, "ERROR")
    assert {r.severity for r in worst.collect()} == {"ERROR", "CRITICAL"} and LEVELS.index("ERROR") == 3
    assert worst.count() == sum(r.severity in ("ERROR", "CRITICAL") for r in found.collect())
