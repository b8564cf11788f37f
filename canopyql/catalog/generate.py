"""What a model generates: node types, Spark schemas, JSON Schema, XSD and Python classes."""

from __future__ import annotations

import json
import keyword
import re
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import types as T

from ..functions.datatypes import ITEM_TYPE, PATTERN
from ..plans.model import Child, NodeType
from .module import Definition, Instance, Module, ModuleError

_SPARK = {"integer": T.LongType(), "decimal": T.DecimalType(38, 10), "double": T.DoubleType(), "boolean": T.BooleanType()}
VALUE = "STRVALUE"


def raw_name(d: Definition) -> str:
    return d.json_value_key or VALUE


def node_type(d: Definition, name: str | None = None, above: tuple = ()) -> NodeType:
    """The node type of a definition. A recursive one has none: its documents need the node table."""
    if id(d) in above:
        raise ModuleError(f"{d.name} is recursive")
    n = NodeType(name or d.root_name or d.use_name or d.name, d.kind)
    for f in d.flags:
        n.flags[f.name] = (ITEM_TYPE.get(f.definition.datatype if f.definition else "string", "string"), f.name)
    if d.kind == "field":
        n.value = (ITEM_TYPE.get(d.datatype, "string"), raw_name(d))
    for i in d.children():
        if i.definition:
            n.children.append(Child(node_type(i.definition, i.name, (*above, id(d))), i.name, i.many))
    return n


def spark_schema(d: Definition, typed: bool = True, above: tuple = ()) -> T.StructType:
    """One struct per node. typed: values in storage types; else strings, as they were read."""
    if id(d) in above:
        raise ModuleError(f"{d.name} is recursive")

    def scalar(name: str) -> T.DataType:
        t = ITEM_TYPE.get(name, "string")
        if not typed or t in ("string", "uri"):
            return T.StringType()
        composite = {
            "date": T.StructType([T.StructField("d", T.DateType()), T.StructField("tz", T.IntegerType())]),
            "dateTime": T.StructType([T.StructField("ts", T.TimestampNTZType()), T.StructField("tz", T.IntegerType())]),
            "duration": T.StructType([T.StructField("months", T.IntegerType()), T.StructField("us", T.LongType())]),
            "dayTimeDuration": T.LongType(),
        }
        return _SPARK.get(t) or composite[t]

    fields = [T.StructField(f.name, scalar(f.definition.datatype if f.definition else "string"), not f.required) for f in d.flags]
    if d.kind == "field":
        fields.append(T.StructField(raw_name(d), scalar(d.datatype)))
    for i in d.children():
        if i.definition:
            inner = spark_schema(i.definition, typed, (*above, id(d)))
            fields.append(T.StructField(i.name, T.ArrayType(inner) if i.many else inner, i.optional or i.least == 0, {"group-as": i.group_as or "", "min": i.least, "max": -1 if i.most is None else i.most}))
    return T.StructType(fields)


#: JSON type and format of scalar types whose values aren't plain strings.
JSON_TYPES = {
    "integer": {"type": "integer"}, "non-negative-integer": {"type": "integer", "minimum": 0}, "positive-integer": {"type": "integer", "minimum": 1}, "decimal": {"type": "number"}, "boolean": {"type": "boolean"},
    "date-time": {"type": "string", "format": "date-time"}, "date-time-with-timezone": {"type": "string", "format": "date-time"}, "date": {"type": "string", "format": "date"}, "date-with-timezone": {"type": "string", "format": "date"},
    "email-address": {"type": "string", "format": "email"}, "uri": {"type": "string", "format": "uri"}, "uri-reference": {"type": "string", "format": "uri-reference"}, "ip-v4-address": {"type": "string", "format": "ipv4"}, "ip-v6-address": {"type": "string", "format": "ipv6"},
    "base64": {"type": "string", "contentEncoding": "base64"},
}


def json_type(name: str) -> dict:
    if name in JSON_TYPES:
        return JSON_TYPES[name]
    return {"type": "string", "pattern": PATTERN[name]} if name in ("token", "uuid") else {"type": "string"}


def json_schema(m: Module) -> str:
    defs: dict = {}

    def about(d: Definition) -> dict:
        return {k: v for k, v in (("title", d.formal_name), ("description", d.description)) if v}

    def ref(i: Instance) -> dict:
        d = i.definition
        one = json_type(d.datatype) if d.kind == "field" and not d.flags else {"$ref": f"#/$defs/{d.kind}-{d.name}"}
        if not i.many:
            return one
        out = {"type": "array", "items": one, "minItems": max(i.least, 1)}
        return out | ({"maxItems": i.most} if i.most else {})

    for d in m.all_definitions():
        if d.kind == "flag":
            continue
        properties = {f.name: json_type(f.definition.datatype if f.definition else "string") | ({"default": f.definition.default} if f.definition and f.definition.default else {}) for f in d.flags}
        required = [f.name for f in d.flags if f.required]
        if d.kind == "field":
            if not d.flags:
                defs[f"field-{d.name}"] = about(d) | json_type(d.datatype)
                continue
            properties[raw_name(d)] = json_type(d.datatype)
            required.append(raw_name(d))
        for i in d.children():
            if i.definition:
                key = i.group_as if i.many and i.group_as else i.name
                properties[key] = ref(i)
                required += [key] if i.least > 0 and not i.optional else []
        defs[f"{d.kind}-{d.name}"] = about(d) | {"type": "object", "properties": properties, "additionalProperties": False} | ({"required": required} if required else {})
    roots = m.roots()
    schema = {"$schema": "https://json-schema.org/draft/2020-12/schema", "$id": m.json_base or m.namespace, "title": m.name, "type": "object", "properties": {n: {"$ref": f"#/$defs/assembly-{d.name}"} for n, d in roots.items()}, "additionalProperties": False, "$defs": defs}
    return json.dumps(schema, indent=2, ensure_ascii=False)


#: XSD built-in of scalar types; the others get a simple type with the pattern of the lexical rule.
XSD_TYPES = {
    "string": "xs:string", "integer": "xs:integer", "non-negative-integer": "xs:nonNegativeInteger", "positive-integer": "xs:positiveInteger", "decimal": "xs:decimal", "boolean": "xs:boolean", "uri": "xs:anyURI", "uri-reference": "xs:anyURI",
    "base64": "xs:base64Binary", "date": "xs:date", "date-time": "xs:dateTime", "token": "xs:NCName", "hostname": "xs:string", "markup-line": "xs:string", "markup-multiline": "xs:string", "year-month-duration": "xs:duration", "day-time-duration": "xs:duration",
}


def xsd(m: Module) -> str:
    used: set[str] = set()

    def kind(name: str) -> str:
        if name in XSD_TYPES:
            return XSD_TYPES[name]
        used.add(name)
        return f"{name}-type"

    def attribute(f: Instance) -> str:
        d = f.definition
        rest = ' use="required"' if f.required else f" default={quoteattr(d.default)}" if d and d.default else ""
        return f'<xs:attribute name="{f.name}" type="{kind(d.datatype if d else "string")}"{rest}/>'

    def element(i: Instance) -> str:
        d = i.definition
        t = kind(d.datatype) if d.kind == "field" and not d.flags else f"{d.kind}-{d.name}"
        occurs = (f' minOccurs="{0 if i.optional else i.least}"' if i.optional or i.least != 1 else "") + (f' maxOccurs="{"unbounded" if i.most is None else i.most}"' if i.most != 1 else "")
        if i.many and i.in_xml == "GROUPED" and i.group_as:
            return f'<xs:element name="{i.group_as}" minOccurs="0"><xs:complexType><xs:sequence><xs:element name="{i.name}" type="{t}"{occurs}/></xs:sequence></xs:complexType></xs:element>'
        return f'<xs:element name="{i.name}" type="{t}"{occurs}/>'

    body = [f'<xs:element name="{n}" type="assembly-{d.name}"/>' for n, d in m.roots().items()]
    for d in m.all_definitions():
        note = f"<xs:annotation><xs:documentation>{escape(d.description)}</xs:documentation></xs:annotation>" if d.description else ""
        flags = "".join(map(attribute, d.flags))
        if d.kind == "assembly":
            parts = ""
            for x in d.model:
                parts += "<xs:choice>" + "".join(element(i) for i in x if i.definition) + "</xs:choice>" if isinstance(x, list) else element(x) if x.definition else ""
            body.append(f'<xs:complexType name="assembly-{d.name}">{note}<xs:sequence>{parts}</xs:sequence>{flags}</xs:complexType>')
        elif d.kind == "field" and d.flags:
            body.append(f'<xs:complexType name="field-{d.name}">{note}<xs:simpleContent><xs:extension base="{kind(d.datatype)}">{flags}</xs:extension></xs:simpleContent></xs:complexType>')
    simple = []
    for n in sorted(used):
        pattern = re.sub(r"\(\?:|\(\?[a-z]+:", "(", PATTERN.get(n, ".*")).strip("^$")
        pattern = re.sub(r"\(\?=[^)]*\)", "", pattern)
        simple.append(f'<xs:simpleType name="{n}-type"><xs:restriction base="xs:string"><xs:pattern value={quoteattr(pattern)}/></xs:restriction></xs:simpleType>')
    ns = f' targetNamespace="{m.namespace}" xmlns="{m.namespace}"' if m.namespace else ""
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" elementFormDefault="qualified"{ns}>' + "".join(body + simple) + "</xs:schema>"


_PYTHON = {"integer": "int", "decimal": "Decimal", "double": "float", "boolean": "bool"}


def python_classes(m: Module, frozen: bool = False, prefix: str = "", suffix: str = "") -> str:
    """Dataclasses of all fields with flags and all assemblies, inner ones by name."""
    name = lambda d: prefix + "".join(w.capitalize() for w in re.split(r"[^0-9A-Za-z]+", d.use_name or d.name)) + suffix

    def attr(s: str) -> str:
        s = re.sub(r"\W", "_", s)
        return s + "_" if keyword.iskeyword(s) or s[:1].isdigit() else s

    out = ["from __future__ import annotations", "", "from dataclasses import dataclass, field", "from decimal import Decimal", ""]
    for d in m.all_definitions():
        if d.kind == "flag" or d.kind == "field" and not d.flags:
            continue
        needed, optional = [], []
        for f in d.flags:
            t = _PYTHON.get(ITEM_TYPE.get(f.definition.datatype if f.definition else "string", "string"), "str")
            (needed if f.required else optional).append(f"    {attr(f.name)}: {t}" if f.required else f"    {attr(f.name)}: {t} | None = None")
        if d.kind == "field":
            optional.append(f"    {attr(raw_name(d).lower())}: {_PYTHON.get(ITEM_TYPE.get(d.datatype, 'string'), 'str')} | None = None")
        for i in d.children():
            if i.definition:
                t = name(i.definition) if i.definition.kind == "assembly" or i.definition.flags else _PYTHON.get(ITEM_TYPE.get(i.definition.datatype, "string"), "str")
                optional.append(f"    {attr(i.group_as or i.name)}: list[{t}] = field(default_factory=list)" if i.many else f"    {attr(i.name)}: {t} | None = None")
        out += ["", f"@dataclass{'(frozen=True)' if frozen else ''}", f"class {name(d)}:"] + ([f'    """{d.description}"""', ""] if d.description else []) + (needed + optional or ["    pass"]) + [""]
    return "\n".join(out)
