"""Modules: XML files that define flags, fields, assemblies and constraints; loading with imports and name resolution."""

from __future__ import annotations

import os
import xml.etree.ElementTree as ET
from collections.abc import Callable
from dataclasses import dataclass, field


class ModuleError(ValueError):
    """A module that can't be loaded."""


class CircularImport(ModuleError):
    """Modules that import each other; chain holds their places."""

    def __init__(self, chain: list[str]):
        super().__init__(" -> ".join(chain))
        self.chain = chain


@dataclass
class Constraint:
    kind: str  # allowed-values, matches, expect, index, index-has-key, is-unique, has-cardinality
    id: str | None = None
    level: str = "ERROR"
    target: str = "."
    message: str | None = None
    values: dict[str, str | None] = field(default_factory=dict)  # value: version since which it is deprecated
    allow_other: bool = False
    regex: str | None = None
    datatype: str | None = None
    test: str | None = None
    name: str | None = None
    keys: list[tuple[str, str | None]] = field(default_factory=list)  # (target, regex)
    least: int | None = None
    most: int | None = None


@dataclass
class Definition:
    kind: str  # flag, field, assembly
    name: str
    datatype: str = "string"
    default: str | None = None
    use_name: str | None = None
    root_name: str | None = None
    formal_name: str | None = None
    description: str | None = None
    scope: str = "global"
    json_value_key: str | None = None
    json_key: str | None = None
    flags: list[Instance] = field(default_factory=list)
    model: list[Instance | list[Instance]] = field(default_factory=list)  # a list is a choice
    constraints: list[Constraint] = field(default_factory=list)

    def children(self) -> list[Instance]:
        """Field and assembly instances, those of choices included."""
        out: list[Instance] = []
        for x in self.model:
            out += x if isinstance(x, list) else [x]
        return out


@dataclass
class Instance:
    kind: str
    ref: str
    definition: Definition | None = None
    use_name: str | None = None
    required: bool = False
    least: int = 0
    most: int | None = 1
    group_as: str | None = None
    in_json: str = "ARRAY"
    in_xml: str = "UNGROUPED"
    optional: bool = False  # within a choice

    @property
    def name(self) -> str:
        return self.use_name or (self.definition and (self.definition.use_name or self.definition.name)) or self.ref

    @property
    def many(self) -> bool:
        return self.most is None or self.most > 1


@dataclass
class Module:
    location: str
    name: str = ""
    short_name: str = ""
    version: str = ""
    namespace: str = ""
    json_base: str = ""
    definitions: dict[tuple[str, str], Definition] = field(default_factory=dict)
    imports: list[Module] = field(default_factory=list)

    def find(self, kind: str, name: str) -> Definition | None:
        """Own definitions first, then global ones of direct imports, the last import first."""
        own = self.definitions.get((kind, name))
        if own:
            return own
        for m in reversed(self.imports):
            d = m.definitions.get((kind, name))
            if d and d.scope == "global":
                return d
        return None

    def roots(self) -> dict[str, Definition]:
        own = {d.root_name: d for d in self.definitions.values() if d.root_name}
        for m in self.imports:
            for n, d in m.roots().items():
                own.setdefault(n, d)
        return own

    def all_definitions(self) -> list[Definition]:
        seen: dict[int, Definition] = {}
        for m in [self, *self.imports]:
            for d in (m.definitions.values() if m is self else [x for x in m.all_definitions() if x.scope == "global"]):
                seen.setdefault(id(d), d)
        return list(seen.values())

    def stats(self) -> dict[str, int]:
        return {k: sum(d.kind == k for d in self.definitions.values()) for k in ("flag", "field", "assembly")} | {"imports": len(self.imports)}


def _local(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _text(e: ET.Element, name: str) -> str | None:
    for c in e:
        if _local(c) == name:
            return " ".join("".join(c.itertext()).split()) or None
    return None


def _count(v: str | None, default: int | None) -> int | None:
    return default if v is None else None if v == "unbounded" else int(v)


class Loader:
    """Loads modules by place, each once. open_ gives the bytes of a place; the default reads local files."""

    def __init__(self, open_: Callable[[str], bytes] | None = None):
        self.open = open_ or self._read
        self.cache: dict[str, Module] = {}
        self.loading: list[str] = []

    @staticmethod
    def _read(place: str) -> bytes:
        with open(place, "rb") as f:
            return f.read()

    def load(self, place: str) -> Module:
        place = os.path.normpath(place) if "://" not in place else place
        if place in self.cache:
            return self.cache[place]
        if place in self.loading:
            raise CircularImport([*self.loading[self.loading.index(place) :], place])
        self.loading.append(place)
        try:
            m = self.parse(self.open(place), place)
        finally:
            self.loading.pop()
        self.cache[place] = m
        return m

    def parse(self, source: bytes | str, place: str = "memory") -> Module:
        try:
            root = ET.fromstring(source)
        except ET.ParseError as e:
            raise ModuleError(f"{place}: {e}") from e
        m = Module(place, *(_text(root, n) or "" for n in ("schema-name", "short-name", "schema-version", "namespace", "json-base-uri")))
        for e in root:
            kind = _local(e)
            if kind == "import":
                href = e.get("href", "")
                m.imports.append(self.load(href if "://" in href else os.path.join(os.path.dirname(place), href)))
            elif kind.startswith("define-"):
                d = self.definition(e, kind[7:])
                m.definitions[d.kind, d.name] = d
        for d in list(m.definitions.values()):
            self.resolve(m, d)
        return m

    def definition(self, e: ET.Element, kind: str) -> Definition:
        name = e.get("name")
        if not name:
            raise ModuleError(f"a {kind} has no name")
        d = Definition(kind, name, e.get("as-type", "string"), e.get("default"), _text(e, "use-name"), _text(e, "root-name"), _text(e, "formal-name"), _text(e, "description"), e.get("scope", "global"))
        for c in e:
            tag = _local(c)
            if tag == "json-value-key":
                d.json_value_key = (c.text or "").strip() or None
            elif tag == "json-key":
                d.json_key = c.get("flag-ref") or c.get("flag-name")
            elif tag in ("flag", "define-flag"):
                d.flags.append(self.instance(c, "flag"))
            elif tag == "model":
                d.model = self.container(c)
            elif tag == "constraint":
                d.constraints += [self.constraint(x) for x in c]
        return d

    def container(self, e: ET.Element) -> list:
        out: list = []
        for c in e:
            tag = _local(c)
            if tag in ("field", "assembly", "define-field", "define-assembly"):
                out.append(self.instance(c, tag.removeprefix("define-")))
            elif tag in ("choice", "choice-group"):
                group = []
                for x in self.container(c):
                    group += x if isinstance(x, list) else [x]
                for i in group:
                    i.optional, i.least = True, 0
                out.append(group)
        return out

    def instance(self, e: ET.Element, kind: str) -> Instance:
        inline = _local(e).startswith("define-")
        i = Instance(kind, e.get("name" if inline else "ref", ""), self.definition(e, kind) if inline else None, None if inline else _text(e, "use-name"))
        i.required = e.get("required") == "yes"
        i.least, i.most = int(e.get("min-occurs", "0")), _count(e.get("max-occurs"), 1)
        for c in e:
            if _local(c) == "group-as":
                i.group_as, i.in_json, i.in_xml = c.get("name"), c.get("in-json", "ARRAY"), c.get("in-xml", "UNGROUPED")
        return i

    def constraint(self, e: ET.Element) -> Constraint:
        kind = _local(e)
        c = Constraint("is-unique" if kind in ("is-unique", "unique") else kind, e.get("id"), e.get("level", "ERROR"), e.get("target") or ".", _text(e, "message"))
        c.allow_other, c.regex, c.datatype, c.test, c.name = e.get("allow-other") == "yes", e.get("regex"), e.get("datatype"), e.get("test"), e.get("name")
        c.least, c.most = _count(e.get("min-occurs"), None), _count(e.get("max-occurs"), None)
        for x in e:
            if _local(x) == "enum":
                c.values[x.get("value", "")] = x.get("deprecated")
            elif _local(x) == "key-field":
                c.keys.append((x.get("target") or ".", x.get("pattern")))
        return c

    def resolve(self, m: Module, d: Definition, seen: set | None = None) -> None:
        for i in [*d.flags, *d.children()]:
            if i.definition is None:
                i.definition = m.find(i.kind, i.ref)
            elif (i.kind, i.ref) not in m.definitions or m.definitions[i.kind, i.ref] is not i.definition:
                self.resolve(m, i.definition)
