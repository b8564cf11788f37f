"""Static types: node types of a document view, and compiled values."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = ("integer", "decimal", "double")


class PathError(ValueError):
    """An expression that can't be compiled: unknown name, arity or type."""


@dataclass
class NodeType:
    """A document, assembly or field; flags and value map to (item type, struct field)."""

    name: str
    kind: str
    flags: dict[str, tuple[str, str]] = field(default_factory=dict)
    children: list[Child] = field(default_factory=list)
    value: tuple[str, str] | None = None


@dataclass
class Child:
    node: NodeType
    field: str
    many: bool = True


@dataclass
class Seg:
    """Nodes of one place in the model: an array of structs (k: document order, n0..nd: the path of values, v: of a flag).

    Nodes of several places stand in the order of `key`(node, place in the array), an array of integers; without one, in document order."""

    chain: list[NodeType]
    leaf: tuple[str, str] | None  # (flag name, item type)
    col: Column
    key: object = None

    def order(self, x: Column, i: Column) -> Column:
        return self.key(x, i) if self.key else x["k"]

    @property
    def name(self) -> str:
        return self.leaf[0] if self.leaf else self.chain[-1].name

    @property
    def kind(self) -> str:
        return "flag" if self.leaf else self.chain[-1].kind


@dataclass
class V:
    """A compiled sequence. Not many: a scalar column, NULL is the empty sequence. many: an array column."""

    t: str
    col: Column | None = None
    many: bool = False
    elem: str | None = None  # of an array or map
    segs: list[Seg] | None = None
    fn: object = None  # a function item, inlined where it is called


EMPTY = V("empty")
#: Storage types of items.
DDL = {
    "string": "string", "integer": "bigint", "decimal": "decimal(38,10)", "double": "double", "boolean": "boolean", "uri": "string", "empty": "string",
    "date": "struct<d:date,tz:int>", "dateTime": "struct<ts:timestamp_ntz,tz:int>", "time": "struct<us:bigint,tz:int>", "duration": "struct<months:int,us:bigint>",
    "dayTimeDuration": "bigint", "qname": "struct<prefix:string,ns:string,local:string>",
}


def none_of(t: str) -> Column:
    return F.slice(F.array(F.lit(None).cast(DDL[t])), 1, 0)


def or_none(c: Column | str) -> Column:
    """An array column, empty where it is NULL."""
    return F.flatten(F.filter(F.array(c), lambda x: x.isNotNull()))


def let(c: Column, f) -> Column:
    """f(c) with c evaluated, and analysed, once."""
    return F.get(F.transform(F.array(c), lambda x: f(x)), F.lit(0))


def listed(c: Column) -> Column:
    """An array of the scalar, empty if it is NULL."""
    return F.filter(F.array(c), lambda x: x.isNotNull())


def arr(v: V) -> Column:
    if v.t == "empty":
        return none_of("string")
    return v.col if v.many else listed(v.col)


def one(v: V) -> Column:
    """The first item as a scalar."""
    if v.t == "empty":
        return F.lit(None).cast("string")
    return F.get(v.col, F.lit(0)) if v.many else v.col


def count(v: V) -> Column:
    if v.t == "empty":
        return F.lit(0)
    if v.segs is not None:
        n = [F.size(s.col) if v.many else s.col.isNotNull().cast("int") for s in v.segs]
        out = n[0] if n else F.lit(0)
        for x in n[1:]:
            out = out + x
        return out
    return F.size(v.col) if v.many else v.col.isNotNull().cast("int")


def tz_text(tz: Column) -> Column:
    sign = F.when(tz < 0, "-").otherwise("+")
    a = F.abs(tz)
    return F.when(tz.isNull(), "").when(tz == 0, "Z").otherwise(F.concat(sign, F.lpad((a / 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((a % 60).cast("string"), 2, "0")))


def time_text(us: Column) -> Column:
    part = lambda div, mod: F.lpad(((us / F.lit(div)).cast("long") % mod).cast("string"), 2, "0")
    rest = us % 1_000_000
    frac = F.when(rest == 0, "").otherwise(F.concat(F.lit("."), F.regexp_replace(F.lpad(rest.cast("string"), 6, "0"), "0+$", "")))
    return F.concat(part(3_600_000_000, 24), F.lit(":"), part(60_000_000, 60), F.lit(":"), part(1_000_000, 60), frac)


def duration_text(months: Column, us: Column) -> Column:
    neg = (months < 0) | (us < 0)
    m, u = F.abs(months), F.abs(us)
    piece = lambda n, s: F.when(n > 0, F.concat(n.cast("string"), F.lit(s))).otherwise("")
    days, hours, minutes = (u / 86_400_000_000).cast("long"), (u / 3_600_000_000).cast("long") % 24, (u / 60_000_000).cast("long") % 60
    secs, rest = (u / 1_000_000).cast("long") % 60, u % 1_000_000
    sec = F.when((secs > 0) | (rest > 0), F.concat(secs.cast("string"), F.when(rest > 0, F.concat(F.lit("."), F.regexp_replace(F.lpad(rest.cast("string"), 6, "0"), "0+$", ""))).otherwise(""), F.lit("S"))).otherwise("")
    clock = F.concat(piece(hours, "H"), piece(minutes, "M"), sec)
    body = F.concat(piece((m / 12).cast("int"), "Y"), piece(m % 12, "M"), piece(days, "D"), F.when(clock != "", F.concat(F.lit("T"), clock)).otherwise(""))
    return F.concat(F.when(neg, "-").otherwise(""), F.lit("P"), F.when(body == "", "T0S").otherwise(body))


def text(t: str, c: Column) -> Column:
    """String value of an item."""
    if t == "double":
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        return F.when(F.isnan(c), "NaN").when(c == float("inf"), "INF").when(c == float("-inf"), "-INF").when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))
    if t == "decimal":
        return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    if t == "date":
        return F.concat(F.date_format(c["d"], "yyyy-MM-dd"), tz_text(c["tz"]))
    if t == "dateTime":
        micros = F.date_format(c["ts"], "SSSSSS")
        frac = F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), F.regexp_replace(micros, "0+$", "")))
        return F.concat(F.date_format(c["ts"], "yyyy-MM-dd'T'HH:mm:ss"), frac, tz_text(c["tz"]))
    if t == "time":
        return F.concat(time_text(c["us"]), tz_text(c["tz"]))
    if t == "duration":
        return duration_text(c["months"], c["us"])
    if t == "dayTimeDuration":
        return F.when(c.isNotNull(), duration_text(F.lit(0), c))
    if t == "qname":
        return F.when(F.coalesce(c["prefix"], F.lit("")) == "", c["local"]).otherwise(F.concat(c["prefix"], F.lit(":"), c["local"]))
    if t in ("array", "map"):
        return F.to_json(c)
    return c.cast("string")


def instant(t: str, c: Column) -> Column:
    """A number that orders items of a type of points in time or durations."""
    tz = lambda: F.coalesce(c["tz"], F.lit(0)).cast("long") * 60_000_000
    if t == "date":
        return F.unix_date(c["d"]).cast("long") * 86_400_000_000 - tz()
    if t == "dateTime":
        return _micros(c["ts"]) - tz()
    if t == "time":
        return c["us"] - tz()
    if t == "duration":
        return c["months"].cast("long") * 2_629_746_000_000 + c["us"]
    return c


def _micros(ts: Column) -> Column:
    return F.unix_date(ts.cast("date")).cast("long") * 86_400_000_000 + (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("long") * 1_000_000 + F.date_format(ts, "SSSSSS").cast("long")


def number(t: str, c: Column) -> Column:
    """Numeric view of an item as a column, NULL if it has none."""
    return c if t in NUMERIC else c.cast("string").try_cast("decimal(38,10)")
