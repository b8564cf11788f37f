"""XML, JSON and YAML documents: reading into rows of a model's struct, and writing back.

Reading parses each file in a Python worker (one Arrow batch of files at a time) into one canonical JSON text of strings, whose keys are
effective names; from_json and the type rules then make typed structs in the JVM. Unknown properties are dropped, and a value that breaks its
type is NULL with its text kept in ``raw``, so that a type check can report it."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog.generate import node_type, raw_name, spark_schema
from ..catalog.module import Definition, Instance, Module
from ..functions.datatypes import parsed


def detect_format(content: str, path: str = "") -> str:
    """By extension, else by content: the first sign that isn't blank."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    if ext in ("xml", "json", "yaml", "yml"):
        return "yaml" if ext == "yml" else ext
    head = content[:1024].lstrip("﻿ \t\r\n")
    return "xml" if head[:1] == "<" else "json" if head[:1] in ("{", "[") else "yaml"


def _scalar(v) -> str | None:
    return None if v is None else ("true" if v else "false") if isinstance(v, bool) else str(v)


def _from_data(d: Definition, v) -> dict | None:
    """A JSON or YAML value as a canonical node."""
    if d.kind == "field" and not isinstance(v, dict):
        return {raw_name(d): _scalar(v)}
    if not isinstance(v, dict):
        return None
    out: dict = {f.name: _scalar(v[f.name]) for f in d.flags if f.name in v}
    if d.kind == "field":
        out[raw_name(d)] = _scalar(v.get(raw_name(d)))
    for i in d.children():
        if not i.definition:
            continue
        key = i.group_as if i.group_as and i.group_as in v else i.name
        if key not in v:
            continue
        x = v[key]
        if i.in_json == "BY_KEY" and isinstance(x, dict) and i.definition.json_key:
            x = [(y if isinstance(y, dict) else {raw_name(i.definition): y}) | {i.definition.json_key: k} for k, y in x.items()]
        nodes = [n for y in (x if isinstance(x, list) else [x]) if (n := _from_data(i.definition, y)) is not None]
        if nodes:
            out[i.name] = nodes if i.many else nodes[0]
    return out


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _from_xml(d: Definition, e: ET.Element) -> dict:
    out: dict = {f.name: e.attrib[f.name] for f in d.flags if f.name in e.attrib}
    if d.kind == "field":
        inner = (e.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in e)
        inner = re.sub(r' xmlns:ns\d+="[^"]*"', "", re.sub(r"(</?)ns\d+:", r"\1", inner))
        out[raw_name(d)] = inner.strip() if d.datatype.startswith("markup") else (e.text or "")
    by_name = {i.name: i for i in d.children() if i.definition}
    grouped = {i.group_as: i for i in by_name.values() if i.group_as and i.in_xml == "GROUPED"}
    for c in e:
        tag = _local(c.tag)
        i = grouped.get(tag)
        for x in list(c) if i else [c]:
            j = i or by_name.get(tag)
            if j:
                node = _from_xml(j.definition, x)
                if j.many:
                    out.setdefault(j.name, []).append(node)
                else:
                    out[j.name] = node
    return out


def canonical(root: Definition, content: str, fmt: str) -> dict | None:
    """The canonical node of a document, None if it doesn't hold the root."""
    if fmt == "xml":
        e = ET.fromstring(content)
        return _from_xml(root, e) if _local(e.tag) == root.root_name else None
    if fmt == "yaml":
        import yaml

        v = next(iter(yaml.load_all(content, Loader=yaml.BaseLoader)), None)
    else:
        v = json.loads(content, parse_float=str, parse_int=str)
    return _from_data(root, v[root.root_name]) if isinstance(v, dict) and root.root_name in v else None


def typed(d: Definition, c: Column, schema: T.StructType) -> Column:
    """The struct of strings c with each value in its storage type."""
    out = [(parsed(f.definition.datatype, c[f.name]) if f.definition else c[f.name]).alias(f.name) for f in d.flags]
    if d.kind == "field":
        out.append(parsed(d.datatype, c[raw_name(d)]).alias(raw_name(d)))
    for i in d.children():
        if i.definition:
            out.append(_inner(i, c[i.name], schema[i.name].dataType).alias(i.name))
    return F.when(c.isNotNull(), F.struct(*out))


def _inner(i: Instance, c: Column, t: T.DataType) -> Column:
    if i.many:
        return F.transform(c, lambda y: typed(i.definition, y, t.elementType))
    return typed(i.definition, c, t)


def read_documents(engine, contents: DataFrame, module: Module, root: str, fmt: str | None = None):
    """Documents of rows (path, content)."""
    from ..session import reach_workers

    reach_workers(contents.sparkSession)
    d = module.roots()[root]
    raw = spark_schema(d, typed=False)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, errors = [], []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    node = canonical(d, content or "", fmt or detect_format(content or "", path or ""))
                    out.append(json.dumps(node) if node is not None else None)
                    errors.append(None if node is not None else f"no {root} in it")
                except Exception as e:  # noqa: BLE001  a document that can't be parsed is reported in its row
                    out.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(errors, pa.string())], ["path", "json", "error"])

    rows = contents.select("path", "content").mapInArrow(parse, "path string, json string, error string")
    rows = rows.withColumn("raw", F.from_json("json", raw)).withColumn("doc", typed(d, F.col("raw"), raw))
    return engine.docs(rows.select("path", "error", "raw", "doc"), ["path"], node_type(d))


def read_files(engine, path: str, module: Module, root: str, fmt: str | None = None):
    """Documents of files, through Spark's own reader."""
    files = engine.spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("content"))
    return read_documents(engine, files, module, root, fmt)


_NATIVE = frozenset("integer non-negative-integer positive-integer decimal boolean".split())


def _value(name: str, v: str | None):
    if v is None or name not in _NATIVE:
        return v
    if name == "boolean":
        return {"true": True, "1": True, "false": False, "0": False}.get(v.lower(), v)
    try:
        return int(v) if "integer" in name else float(v) if float(v) != int(float(v)) else int(float(v))
    except ValueError:
        return v


def to_data(d: Definition, node: dict):
    """The JSON or YAML shape of a canonical node: absent values are left out."""
    out = {f.name: _value(f.definition.datatype if f.definition else "string", node[f.name]) for f in d.flags if node.get(f.name) is not None}
    if d.kind == "field":
        v = _value(d.datatype, node.get(raw_name(d)))
        if not d.flags:
            return v
        out[raw_name(d)] = v
    for i in d.children():
        nodes = node.get(i.name) if i.definition else None
        if not nodes:
            continue
        items = [to_data(i.definition, x) for x in (nodes if i.many else [nodes])]
        key = i.group_as if i.many and i.group_as else i.name
        if i.many and i.in_json == "BY_KEY" and i.definition.json_key:
            out[key] = {x[i.definition.json_key]: {k: v for k, v in x.items() if k != i.definition.json_key} for x in items}
        else:
            out[key] = items if i.many and not (i.in_json == "SINGLETON_OR_ARRAY" and len(items) == 1) else items[0]
    return out


def to_xml(d: Definition, node: dict, name: str, ns: str = "", indent: int = 0) -> str:
    pad = "  " * indent
    flags = "".join(f" {f.name}={quoteattr(node[f.name])}" for f in d.flags if node.get(f.name) is not None)
    head = f"{pad}<{name}" + (f" xmlns={quoteattr(ns)}" if ns else "") + flags
    if d.kind == "field":
        v = node.get(raw_name(d)) or ""
        return f"{head}>{v if d.datatype.startswith('markup') else escape(v)}</{name}>"
    parts = []
    for i in d.children():
        nodes = node.get(i.name) if i.definition else None
        if not nodes:
            continue
        grouped = i.many and i.in_xml == "GROUPED" and i.group_as
        inner = [to_xml(i.definition, x, i.name, indent=indent + (2 if grouped else 1)) for x in (nodes if i.many else [nodes])]
        parts += [f"{pad}  <{i.group_as}>", *inner, f"{pad}  </{i.group_as}>"] if grouped else inner
    return "\n".join([head + ">", *parts, f"{pad}</{name}>"]) if parts else head + "/>"


def convert(docs, module: Module, root: str, fmt: str) -> DataFrame:
    """(path, content): each document in another format."""
    d = module.roots()[root]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                node = json.loads(text) if text else None
                if node is None:
                    out.append(None)
                elif fmt == "xml":
                    out.append(to_xml(d, node, root, module.namespace))
                elif fmt == "yaml":
                    import yaml

                    out.append(yaml.safe_dump({root: to_data(d, node)}, sort_keys=False, allow_unicode=True))
                else:
                    out.append(json.dumps({root: to_data(d, node)}, ensure_ascii=False, indent=2))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["path", "content"])

    return docs.df.select("path", F.to_json("raw").alias("json")).mapInArrow(write, "path string, content string")


NODES = "path string, pre long, size long, level int, parent_pre long, sib_ord int, kind string, name string, node_path string, raw string, type_name string, flags map<string,string>"


def _walk(d: Definition, node: dict, name: str) -> list[tuple]:
    """Node rows of a document in pre-order, with explicit stack, so that any depth and recursive models work."""
    rows: list[list] = [[0, 0, 0, None, 1, "document", name, f"/{name}", None, None, []]]
    stack = [(d, node, name, f"/{name}/{name}", 1, 0, 1)]
    open_rows: list[tuple[int, int]] = [(0, 0)]
    while stack:
        d, node, name, path, level, parent, order = stack.pop()
        pre = len(rows)
        while open_rows[-1][1] >= level:
            p, _ = open_rows.pop()
            rows[p][1] = pre - p - 1
        flags = [(f.name, node[f.name]) for f in d.flags if node.get(f.name) is not None]
        rows.append([pre, 0, level, parent, order, d.kind, name, path, node.get(raw_name(d)) if d.kind == "field" else None, d.datatype if d.kind == "field" else None, flags])
        open_rows.append((pre, level))
        below, n = [], 0
        for i in d.children():
            nodes = node.get(i.name) if i.definition else None
            for x in (nodes if isinstance(nodes, list) else [nodes] if nodes else []):
                n += 1
                below.append((i.definition, x, i.name, f"{path}/{i.name}", level + 1, pre, n))
        stack.extend(reversed(below))
    for p, _ in open_rows:
        rows[p][1] = len(rows) - p - 1
    return [tuple(r) for r in rows]


def read_nodes(engine, contents: DataFrame, module: Module, root: str, fmt: str | None = None) -> DataFrame:
    """The node table of rows (path, content), for any model, recursive ones included; documents that can't be parsed have no rows."""
    from ..session import reach_workers

    reach_workers(contents.sparkSession)
    d = module.roots()[root]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    node = canonical(d, content or "", fmt or detect_format(content or "", path or ""))
                except Exception:  # noqa: BLE001  read_documents reports it
                    node = None
                if node is None:
                    continue
                columns = list(zip(*_walk(d, node, root), strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), *[pa.string()] * 5, pa.map_(pa.string(), pa.string()))
                arrays = [pa.array([path] * len(columns[0]), pa.string()), *(pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, ["path", "pre", "size", "level", "parent_pre", "sib_ord", "kind", "name", "node_path", "raw", "type_name", "flags"])

    return contents.select("path", "content").mapInArrow(parse, NODES)
