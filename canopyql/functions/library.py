"""The function library: name to (least arguments, most arguments, builder). A builder turns compiled arguments into a compiled value."""

from __future__ import annotations

from dataclasses import replace
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..plans.model import EMPTY, NUMERIC, Seg, V, arr, count, let, listed, none_of, one, text

FUNCTIONS: dict[str, tuple] = {}
MANY = 99


def register(name: str, least: int, most: int | None = None):
    """Adds a function; a later one of the same name replaces it."""

    def keep(build):
        FUNCTIONS[name] = (least, least if most is None else most, build)
        return build

    return keep


def _string(c, args, env, i: int = 0) -> Column:
    """Argument i as a string, '' if empty; the context item if it is left out."""
    v = args[i] if len(args) > i else c.c(("context",), env)
    return F.coalesce(one(c.strings(v)), F.lit(""))


def _simple(name: str, n: int, build, t: str = "string"):
    register(name, n)(lambda c, args, env: V(t, build(*(_string(c, args, env, i) for i in range(n)))))


def _long(c, v: V) -> Column:
    v = c.numeric(v)
    return one(v).cast("long") if v.t != "empty" else F.lit(None).cast("long")


# Boolean

register("true", 0)(lambda c, a, env: V("boolean", F.lit(True)))
register("false", 0)(lambda c, a, env: V("boolean", F.lit(False)))
register("not", 1)(lambda c, a, env: V("boolean", ~c.ebv(a[0])))
register("boolean", 1)(lambda c, a, env: V("boolean", c.ebv(a[0])))

# Sequence

register("empty", 1)(lambda c, a, env: V("boolean", count(a[0]) == 0))
register("exists", 1)(lambda c, a, env: V("boolean", count(a[0]) > 0))
register("count", 1)(lambda c, a, env: V("integer", count(a[0]).cast("long")))


def _reshape(c, v: V, f) -> V:
    """Applies an array function to the items or nodes of a sequence."""
    if v.t == "empty":
        return v
    if v.segs is not None:
        if len(v.segs) > 1:
            return c.reshaped(v, f)
        return V("node", None, True, segs=[replace(s, col=f(s.col if v.many else listed(s.col))) for s in v.segs])
    return V(v.t, f(arr(v)), True, elem=v.elem)


register("head", 1)(lambda c, a, env: _reshape(c, a[0], lambda x: F.slice(x, 1, 1)))
register("tail", 1)(lambda c, a, env: _reshape(c, a[0], lambda x: F.slice(x, F.lit(2), F.greatest(F.size(x), F.lit(1)))))
register("reverse", 1)(lambda c, a, env: _reshape(c, a[0], F.reverse))
register("unordered", 1)(lambda c, a, env: a[0])
register("position", 0)(lambda c, a, env: V("integer", (env.pos if env.pos is not None else F.lit(1)).cast("long")))
register("last", 0)(lambda c, a, env: V("integer", (env.last if env.last is not None else F.lit(1)).cast("long")))
register("data", 0, 1)(lambda c, a, env: c.atoms(a[0] if a else c.c(("context",), env)))


@register("distinct-values", 1)
def _distinct(c, a, env):
    v = c.atoms(a[0])
    if v.t == "empty":
        return v
    if v.t in ("date", "dateTime", "time", "double"):
        keys = F.transform(arr(v), lambda x: text(v.t, x))
        return V(v.t, F.filter(arr(v), lambda x, i: F.array_position(keys, text(v.t, x)) == i + 1), True)
    return V(v.t, F.array_distinct(arr(v)), True)


@register("index-of", 2)
def _index_of(c, a, env):
    v, want = c.strings(a[0]), one(c.strings(a[1]))
    found = F.transform(arr(v), lambda x, i: F.when(x == want, (i + 1).cast("long")))
    return V("integer", F.filter(found, lambda x: x.isNotNull()), True)


@register("subsequence", 2, 3)
def _subsequence(c, a, env):
    start = F.greatest(F.coalesce(_long(c, a[1]), F.lit(1)), F.lit(1)).cast("int")
    length = F.greatest(_long(c, a[2]), F.lit(0)).cast("int") if len(a) > 2 else None
    return _reshape(c, a[0], lambda x: F.slice(x, start, length if length is not None else F.greatest(F.size(x), F.lit(0))))


@register("insert-before", 3)
def _insert(c, a, env):
    both = c.join([c.atoms(a[0]), c.atoms(a[2])])
    x, y = (c.cast_all(v, both.t) if v.t not in (both.t, "empty") else v for v in (c.atoms(a[0]), c.atoms(a[2])))
    x, y = (arr(v) if v.t != "empty" else none_of(both.t) for v in (x, y))
    at = F.least(F.greatest(_long(c, a[1]), F.lit(1)), F.size(x) + 1).cast("int")
    return V(both.t, F.concat(F.slice(x, F.lit(1), at - 1), y, F.slice(x, at, F.size(x))), True) if both.t != "empty" else EMPTY


@register("remove", 2)
def _remove(c, a, env):
    at = _long(c, a[1])
    return _reshape(c, a[0], lambda x: F.filter(x, lambda y, i: (i + 1) != at))


def _sized(name: str, ok, says: str):
    @register(name, 1)
    def build(c, a, env):
        good = ok(count(a[0]))
        stop = lambda x: F.when(good, x).otherwise(F.raise_error(F.lit(says)))
        if a[0].t == "empty":
            return V("string", F.when(good, F.lit(None).cast("string")).otherwise(F.raise_error(F.lit(says))))
        return _reshape(c, a[0], stop) if a[0].many or a[0].segs is not None else V(a[0].t, stop(a[0].col))


_sized("zero-or-one", lambda n: n <= 1, "more than one item")
_sized("one-or-more", lambda n: n >= 1, "no item")
_sized("exactly-one", lambda n: n == 1, "not exactly one item")


@register("deep-equal", 2)
def _deep(c, a, env):
    if all(v.segs is not None for v in a):
        value = lambda v: F.concat(*(F.transform(s.col if v.many else listed(s.col), lambda x: F.to_json(F.struct((x["v"] if s.leaf else x[f"n{len(s.chain) - 1}"]).alias("v")))) for s in v.segs))
        return V("boolean", F.coalesce(value(a[0]) == value(a[1]), F.lit(False)))
    x, y = (arr(c.strings(v)) for v in a)
    return V("boolean", x == y)


# String

register("string", 0, 1)(lambda c, a, env: V("string", _string(c, a, env)))
register("concat", 0, MANY)(lambda c, a, env: V("string", F.concat(F.lit(""), *(_string(c, a, env, i) for i in range(len(a))))))
register("string-length", 0, 1)(lambda c, a, env: V("integer", F.length(_string(c, a, env)).cast("long")))
register("normalize-space", 0, 1)(lambda c, a, env: V("string", F.trim(F.regexp_replace(_string(c, a, env), r"(?U)\s+", " "))))
_simple("contains", 2, lambda x, y: F.contains(x, y), "boolean")
_simple("starts-with", 2, lambda x, y: F.startswith(x, y), "boolean")
_simple("ends-with", 2, lambda x, y: F.endswith(x, y), "boolean")
_simple("upper-case", 1, F.upper)
_simple("lower-case", 1, F.lower)
_simple("substring-before", 2, lambda x, y: F.when((y != "") & F.contains(x, y), F.substring(x, F.lit(1), F.position(y, x) - 1)).otherwise(""))
_simple("substring-after", 2, lambda x, y: F.when(F.contains(x, y), F.substring(x, F.position(y, x) + F.length(y), F.length(x))).otherwise(""))
_simple("compare", 2, lambda x, y: F.when(x < y, F.lit(-1)).when(x > y, F.lit(1)).otherwise(F.lit(0)).cast("long"), "integer")
_simple("encode-for-uri", 1, lambda x: F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")))
_simple("mp:base64-encode", 1, lambda x: F.base64(F.encode(x, "UTF-8")))
_simple("mp:base64-decode", 1, lambda x: F.decode(F.to_binary(x, F.lit("base64")), "UTF-8"))


@register("substring", 2, 3)
def _substring(c, a, env):
    s, start = _string(c, a, env), F.greatest(F.coalesce(_long(c, a[1]), F.lit(1)), F.lit(1)).cast("int")
    length = F.greatest(F.coalesce(_long(c, a[2]), F.lit(0)), F.lit(0)).cast("int") if len(a) > 2 else F.length(s)
    return V("string", F.substring(s, start, length))


register("string-join", 1, 2)(lambda c, a, env: V("string", F.concat_ws("", F.array_join(arr(c.strings(a[0])), "")) if len(a) == 1 else F.aggregate(F.transform(arr(c.strings(a[0])), lambda x, i: F.concat(F.when(i > 0, _string(c, a, env, 1)).otherwise(""), x)), F.lit(""), lambda s, x: F.concat(s, x))))


@register("translate", 3)
def _translate(c, a, env):
    s, old, new = (_string(c, a, env, i) for i in range(3))
    return V("string", F.call_function("translate", s, old, new))


@register("codepoints-to-string", 1)
def _from_points(c, a, env):
    one_char = lambda x: F.decode(F.unhex(F.lpad(F.hex(x), 8, "0")), "UTF-32")
    return V("string", F.array_join(F.transform(arr(c.atoms(a[0])), one_char), ""))


@register("string-to-codepoints", 1)
def _to_points(c, a, env):
    s = _string(c, a, env)
    return V("integer", F.when(s == "", none_of("integer")).otherwise(F.transform(F.split(s, ""), lambda x: F.ascii(x).cast("long"))), True)


# Regular expressions


def _flagged(c, a, env, i: int, at: int) -> Column:
    """The pattern with the flags i, m, s and x before it; other flags are ignored."""
    p = _string(c, a, env, i)
    if len(a) <= at:
        return p
    flags = F.regexp_replace(_string(c, a, env, at), "[^imsx]", "")
    return F.when(flags == "", p).otherwise(F.concat(F.lit("(?"), flags, F.lit(")"), p))


register("matches", 2, 3)(lambda c, a, env: V("boolean", F.regexp_like(_string(c, a, env), _flagged(c, a, env, 1, 2))))


@register("replace", 3, 4)
def _replace(c, a, env):
    new = F.regexp_replace(F.regexp_replace(F.regexp_replace(_string(c, a, env, 2), r"\$\$", r"\\\\\\$"), r"\$&", r"\$0"), r"\$\{(\d+)\}", r"\$$1")
    return V("string", F.regexp_replace(_string(c, a, env), _flagged(c, a, env, 1, 3), new))


@register("tokenize", 1, 3)
def _tokenize(c, a, env):
    p = _flagged(c, a, env, 1, 2) if len(a) > 1 else F.lit(r"\s+")
    return V("string", F.filter(F.split(_string(c, a, env), p), lambda x: x != ""), True)


# Numeric


def _numeric_of(name: str, build):
    @register(name, 1)
    def made(c, a, env):
        v = c.atoms(a[0])
        return V(v.t, build(one(v), v.t)) if v.t in NUMERIC else EMPTY


_numeric_of("abs", lambda x, t: F.abs(x))
_numeric_of("round", lambda x, t: F.bround(x, 0).cast({"integer": "bigint", "decimal": "decimal(38,10)", "double": "double"}[t]))
_numeric_of("floor", lambda x, t: F.floor(x).cast({"integer": "bigint", "decimal": "decimal(38,10)", "double": "double"}[t]))
_numeric_of("ceiling", lambda x, t: F.ceil(x).cast({"integer": "bigint", "decimal": "decimal(38,10)", "double": "double"}[t]))


def _numbers(c, v: V) -> V:
    """Numeric items only; others are left out."""
    v = c.atoms(v)
    return v if v.t in NUMERIC else EMPTY


def _total(v: V) -> Column:
    """The sum, the same for every order of the items: doubles are added from the least on, with what rounding lost (Neumaier)."""
    if v.t != "double":
        kind = {"integer": "bigint", "decimal": "decimal(38,10)"}[v.t]
        return F.aggregate(arr(v), F.lit(0).cast(kind), lambda s, x: (s + x).cast(kind))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("lost"))

    def add(a: Column, x: Column) -> Column:
        t = a["s"] + x
        lost = F.when(F.abs(a["s"]) >= F.abs(x), (a["s"] - t) + x).otherwise((x - t) + a["s"])
        return F.struct(t.alias("s"), (a["lost"] + lost).alias("lost"))

    # infinities leave no number in what was lost
    return F.aggregate(F.sort_array(arr(v)), start, add, lambda a: F.when(F.isnan(a["lost"]), a["s"]).otherwise(a["s"] + a["lost"]))


@register("sum", 1)
def _sum(c, a, env):
    v = _numbers(c, a[0])
    return V("integer", F.lit(0).cast("long")) if v.t == "empty" else V(v.t, _total(v))


@register("avg", 1)
def _avg(c, a, env):
    v = _numbers(c, a[0])
    if v.t == "empty":
        return EMPTY
    n = F.size(arr(v))
    return V("double" if v.t == "double" else "decimal", F.when(n > 0, _total(v) / n if v.t == "double" else _total(v).cast("decimal(38,10)") / n))


register("min", 1)(lambda c, a, env: (lambda v: EMPTY if v.t == "empty" else V(v.t, F.array_min(arr(v))))(_numbers(c, a[0])))
register("max", 1)(lambda c, a, env: (lambda v: EMPTY if v.t == "empty" else V(v.t, F.array_max(arr(v))))(_numbers(c, a[0])))


@register("number", 0, 1)
def _number(c, a, env):
    v = c.atoms(a[0] if a else c.c(("context",), env))
    return V("double", F.lit(float("nan"))) if v.t == "empty" else V("double", F.coalesce((one(v) if v.t in NUMERIC else text(v.t, one(v))).try_cast("double"), F.lit(float("nan"))))


# Nodes


def _node(c, a, env) -> V:
    v = a[0] if a else c.c(("context",), env)
    if v.segs is None and v.t != "empty":
        raise ValueError("a node is needed")
    return v


def _per_node(name: str, t: str, build):
    @register(name, 0, 1)
    def made(c, a, env):
        v = _node(c, a, env)
        if v.t == "empty":
            return EMPTY
        out = [F.when(F.get(s.col, F.lit(0)).isNotNull() if v.many else s.col.isNotNull(), build(s, F.get(s.col, F.lit(0)) if v.many else s.col)) for s in v.segs]
        return V(t, F.coalesce(*out) if len(out) > 1 else out[0])


_per_node("path", "string", lambda s, x: F.lit("/" + "/".join([n.name for n in s.chain] + ([s.leaf[0]] if s.leaf else []))))
_per_node("local-name", "string", lambda s, x: F.lit(s.name.split(":")[-1]))
_per_node("name", "string", lambda s, x: F.lit(s.name))
_per_node("namespace-uri", "string", lambda s, x: F.lit(""))
_per_node("base-uri", "uri", lambda s, x: F.lit(None).cast("string"))
_per_node("document-uri", "uri", lambda s, x: F.lit(None).cast("string"))
_per_node("mp:recurse-depth", "integer", lambda s, x: F.lit(len(s.chain) - (0 if s.leaf else 1)).cast("long"))


@register("has-children", 0, 1)
def _has_children(c, a, env):
    v = _node(c, a, env)
    return V("boolean", F.lit(False)) if v.t == "empty" else V("boolean", count(c.over(v, lambda x, i, n: c.c(("step", "child", ("name", "*"), []), type(env)(ctx=x)))) > 0)


@register("root", 0, 1)
def _root(c, a, env):
    v = _node(c, a, env)
    return v if v.t == "empty" else c.sorted(c.over(v, lambda x, i, n: c.c(("root",), type(env)(ctx=x))))


def _keys(v: V) -> Column:
    return F.concat(*(F.transform(s.col, lambda x: x["k"]) for s in v.segs))


def _most(name: str, hides):
    @register(name, 1)
    def made(c, a, env):
        v = _node(c, a, env)
        if v.t == "empty":
            return v
        v = c.sorted(replace(v, segs=[replace(s, col=s.col if v.many else listed(s.col)) for s in v.segs], many=True))
        keys = _keys(v)
        return V("node", None, True, segs=[Seg(s.chain, s.leaf, let(keys, lambda all_keys: F.filter(s.col, lambda x: ~F.exists(all_keys, lambda k: hides(k, x["k"]))))) for s in v.segs])


_inside = lambda low, high: (F.size(low) > F.size(high)) & (F.slice(low, 1, F.size(high)) == high)
_most("innermost", lambda k, own: _inside(k, own))
_most("outermost", lambda k, own: _inside(own, k))

# QName and URI


@register("QName", 2)
def _qname(c, a, env):
    ns, q = _string(c, a, env), _string(c, a, env, 1)
    prefix = F.when(F.contains(q, F.lit(":")), F.substring_index(q, ":", 1)).otherwise("")
    return V("qname", F.struct(prefix.alias("prefix"), ns.alias("ns"), F.substring_index(q, ":", -1).alias("local")))


def _of_type(name: str, kinds: tuple[str, ...], t: str, build):
    """A function of items of some types; of any other it is empty."""

    @register(name, 1)
    def made(c, a, env):
        v = c.atoms(a[0])
        return V(t, build(one(v), v.t)) if v.t in kinds else EMPTY


_of_type("local-name-from-QName", ("qname",), "string", lambda x, t: x["local"])
_of_type("namespace-uri-from-QName", ("qname",), "uri", lambda x, t: F.coalesce(x["ns"], F.lit("")))
_of_type("prefix-from-QName", ("qname",), "string", lambda x, t: F.when(x["prefix"] != "", x["prefix"]))


@F.pandas_udf(StringType())
def _urljoin(relative: pd.Series, base: pd.Series) -> pd.Series:
    out = [None if r is None or (not b and "://" not in r) else urljoin(b or "", r) for r, b in zip(relative, base, strict=True)]
    return pd.Series(out, dtype="object")


register("resolve-uri", 1, 2)(lambda c, a, env: V("uri", _urljoin(_string(c, a, env), _string(c, a, env, 1) if len(a) > 1 else F.lit(c.base_uri or ""))))
register("static-base-uri", 0)(lambda c, a, env: V("uri", F.lit(c.base_uri)) if c.base_uri else EMPTY)
register("doc", 1)(lambda c, a, env: EMPTY)
register("doc-available", 1)(lambda c, a, env: V("boolean", F.array_contains(F.array(*(F.lit(u) for u in getattr(c, "documents", ())), F.lit("")), _string(c, a, env)) & (_string(c, a, env) != "")))

# Dates and times

_now = lambda: F.localtimestamp()
register("current-dateTime", 0)(lambda c, a, env: V("dateTime", F.struct(_now().alias("ts"), _session_offset().alias("tz"))))
register("current-date", 0)(lambda c, a, env: V("date", F.struct(F.current_date().alias("d"), _session_offset().alias("tz"))))
register("current-time", 0)(lambda c, a, env: V("time", F.struct(((F.hour(_now()) * 3600 + F.minute(_now()) * 60 + F.second(_now())).cast("long") * 1_000_000).alias("us"), _session_offset().alias("tz"))))


def _session_offset() -> Column:
    """Minutes of the session's time zone now."""
    z = F.date_format(F.current_timestamp(), "xxx")
    sign = F.when(z.startswith("-"), -1).otherwise(1)
    return (sign * (F.substring(z, 2, 2).cast("int") * 60 + F.substring(z, 5, 2).cast("int"))).cast("int")


register("implicit-timezone", 0)(lambda c, a, env: V("dayTimeDuration", _session_offset().cast("long") * 60_000_000))


@register("dateTime", 2)
def _date_time(c, a, env):
    d, t = (c.atoms(v) for v in a)
    if d.t != "date" or t.t != "time":
        return EMPTY
    x, y = one(d), one(t)
    whole = F.floor(y["us"] / 1_000_000).cast("int")
    ts = x["d"].cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), whole.cast("decimal(18,6)"))
    return V("dateTime", F.when(x.isNotNull() & y.isNotNull(), F.struct(ts.alias("ts"), F.coalesce(x["tz"], y["tz"], F.lit(0)).alias("tz"))))


for _unit, _f in (("year", F.year), ("month", F.month), ("day", F.dayofmonth)):
    _of_type(f"{_unit}-from-date", ("date",), "integer", lambda x, t, f=_f: f(x["d"]).cast("long"))
    _of_type(f"{_unit}-from-dateTime", ("dateTime",), "integer", lambda x, t, f=_f: f(x["ts"]).cast("long"))
for _unit, _f, _div, _mod in (("hours", F.hour, 3_600_000_000, 24), ("minutes", F.minute, 60_000_000, 60)):
    _of_type(f"{_unit}-from-dateTime", ("dateTime",), "integer", lambda x, t, f=_f: f(x["ts"]).cast("long"))
    _of_type(f"{_unit}-from-time", ("time",), "integer", lambda x, t, d=_div, m=_mod: F.floor(x["us"] / d).cast("long") % m)
_millis = lambda us: (F.floor((us % 60_000_000) / 1000).cast("long") / F.lit(1000)).cast("decimal(38,10)")
_of_type("seconds-from-dateTime", ("dateTime",), "decimal", lambda x, t: _millis(F.second(x["ts"]).cast("long") * 1_000_000 + F.date_format(x["ts"], "SSSSSS").cast("long")))
_of_type("seconds-from-time", ("time",), "decimal", lambda x, t: _millis(x["us"]))
for _unit in ("date", "dateTime", "time"):
    _of_type(f"timezone-from-{_unit}", (_unit,), "dayTimeDuration", lambda x, t: x["tz"].cast("long") * 60_000_000)
_us = lambda x, t: x if t == "dayTimeDuration" else x["us"]
_cut = lambda x, d: F.when(x < 0, F.ceil(x / d)).otherwise(F.floor(x / d)).cast("long")
_of_type("years-from-duration", ("duration",), "integer", lambda x, t: F.call_function("div", x["months"].cast("long"), F.lit(12).cast("long")))
_of_type("months-from-duration", ("duration",), "integer", lambda x, t: (x["months"] % 12).cast("long"))
_of_type("days-from-duration", ("duration", "dayTimeDuration"), "integer", lambda x, t: _cut(_us(x, t), 86_400_000_000))
_of_type("hours-from-duration", ("duration", "dayTimeDuration"), "integer", lambda x, t: _cut(_us(x, t), 3_600_000_000) % 24)
_of_type("minutes-from-duration", ("duration", "dayTimeDuration"), "integer", lambda x, t: _cut(_us(x, t), 60_000_000) % 60)
_of_type("seconds-from-duration", ("duration", "dayTimeDuration"), "decimal", lambda x, t: ((_us(x, t) % 60_000_000) / F.lit(1_000_000)).cast("decimal(38,10)"))


def _adjust(name: str, kind: str, body):
    @register(name, 1, 2)
    def made(c, a, env):
        v = c.atoms(a[0])
        if v.t != kind:
            return EMPTY
        zone = c.atoms(a[1]) if len(a) > 1 else None
        if zone is not None and zone.t != "dayTimeDuration":
            return v
        tz = (F.floor(one(zone) / 60_000_000) if zone is not None else _session_offset()).cast("int")
        x = one(v)
        return V(kind, F.when(x.isNotNull(), F.struct(*body(x, tz), tz.alias("tz"))))


_shift = lambda x, tz: x["ts"] + F.make_dt_interval(F.lit(0), F.lit(0), F.coalesce(tz - x["tz"], F.lit(0)))
_adjust("adjust-dateTime-to-timezone", "dateTime", lambda x, tz: [_shift(x, tz).alias("ts")])
_adjust("adjust-date-to-timezone", "date", lambda x, tz: [x["d"].alias("d")])
_adjust("adjust-time-to-timezone", "time", lambda x, tz: [x["us"].alias("us")])

# Arrays and maps


def _array(name: str, least: int, build, most: int | None = None):
    @register(f"array:{name}", least, most)
    def made(c, a, env):
        return build(c, a[0], a, env) if a[0].t == "array" else EMPTY


_same = lambda v, col: V("array", col, elem=v.elem)
_at = lambda c, a, i: _long(c, a[i]).cast("int")


def _item(c, v: V, new: V) -> Column:
    new = c.atoms(new)
    return one(new) if new.t == v.elem else text(new.t, one(new)).cast("string")


_array("size", 1, lambda c, v, a, env: V("integer", F.size(one(v)).cast("long")))
_array("get", 2, lambda c, v, a, env: V(v.elem, F.when(_at(c, a, 1) > 0, F.get(one(v), _at(c, a, 1) - 1))))
_array("put", 3, lambda c, v, a, env: _same(v, F.when((_at(c, a, 1) >= 1) & (_at(c, a, 1) <= F.size(one(v))), F.transform(one(v), lambda x, i: F.when(i + 1 == _at(c, a, 1), _item(c, v, a[2])).otherwise(x)))))
_array("append", 2, lambda c, v, a, env: _same(v, F.concat(one(v), F.array(_item(c, v, a[1])))))
_array("subarray", 2, lambda c, v, a, env: _same(v, F.when((_at(c, a, 1) >= 1) & (_at(c, a, 1) <= F.size(one(v)) + 1), F.slice(one(v), _at(c, a, 1), F.greatest(_at(c, a, 2), F.lit(0)) if len(a) > 2 else F.size(one(v)))).otherwise(F.slice(one(v), 1, 0))), 3)
_array("remove", 2, lambda c, v, a, env: _same(v, F.filter(one(v), lambda x, i: i + 1 != _at(c, a, 1))))


def _array_insert(c, v, a, env):
    at = F.least(F.greatest(_at(c, a, 1), F.lit(1)), F.size(one(v)) + 1)
    return _same(v, F.concat(F.slice(one(v), F.lit(1), at - 1), F.array(_item(c, v, a[2])), F.slice(one(v), at, F.size(one(v)))))


_array("insert-before", 3, _array_insert)
_array("head", 1, lambda c, v, a, env: V(v.elem, F.get(one(v), F.lit(0))))
_array("tail", 1, lambda c, v, a, env: _same(v, F.slice(one(v), F.lit(2), F.greatest(F.size(one(v)), F.lit(1)))))
_array("reverse", 1, lambda c, v, a, env: _same(v, F.reverse(one(v))))


@register("array:join", 1, MANY)
def _array_join(c, a, env):
    parts = [v for v in a if v.t == "array"]
    if not parts:
        return V("array", none_of("string"), elem="string")
    return _same(parts[0], F.flatten(parts[0].col) if parts[0].many else F.concat(*(one(v) for v in parts)))


_array("flatten", 1, lambda c, v, a, env: V(v.elem, one(v), True))


def _map(name: str, least: int, build, most: int | None = None):
    @register(f"map:{name}", least, most)
    def made(c, a, env):
        return build(c, a[0], a, env) if a[0].t == "map" else (a[0] if name == "remove" else EMPTY)


_mapped = lambda v, col: V("map", col, elem=v.elem)
_key = lambda c, a: one(c.strings(a[1]))
_without = lambda m, k: F.map_filter(m, lambda x, y: x != k)
_map("size", 1, lambda c, v, a, env: V("integer", F.size(one(v)).cast("long")))
_map("keys", 1, lambda c, v, a, env: V("string", F.map_keys(one(v)), True))
_map("contains", 2, lambda c, v, a, env: V("boolean", F.map_contains_key(one(v), _key(c, a))))
_map("get", 2, lambda c, v, a, env: V(v.elem, F.try_element_at(one(v), _key(c, a))))
_map("put", 3, lambda c, v, a, env: _mapped(v, F.map_concat(_without(one(v), _key(c, a)), F.create_map(_key(c, a), _item(c, v, a[2])))))
_map("remove", 2, lambda c, v, a, env: _mapped(v, _without(one(v), _key(c, a))))
register("map:entry", 2)(lambda c, a, env: (lambda v: V("map", F.create_map(one(c.strings(a[0])), one(v)), elem=v.t))(c.atoms(a[1])))


@register("map:merge", 1, 2)
def _merge(c, a, env):
    """Maps merged from the left; the last value of a key wins."""
    v = a[0]
    if v.t != "map":
        return EMPTY
    if not v.many:
        return v
    start = F.map_filter(F.get(v.col, F.lit(0)), lambda x, y: F.lit(False))
    return _mapped(v, F.aggregate(v.col, start, lambda m, n: F.map_concat(F.map_filter(m, lambda x, y: ~F.map_contains_key(n, x)), n)))
