"""The 23 scalar types: lexical rule, parsing and canonical form of each, as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TZ = r"(Z|[+-]\d{2}:\d{2})"
_DAY = r"-?\d{4}-\d{2}-\d{2}"
_CLOCK = r"\d{2}:\d{2}:\d{2}(?:\.\d+)?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_H = r"[0-9a-fA-F]{1,4}"
_IPV6 = "|".join([rf"(?:{_H}:){{7}}{_H}", *(rf"(?:{_H}:){{1,{n}}}(?::{_H}){{1,{7 - n}}}" for n in range(6, 0, -1)), rf"(?:{_H}:){{1,7}}:", rf":(?:(?::{_H}){{1,7}}|:)", rf"::(?:ffff:)?(?:{_OCTET}\.){{3}}{_OCTET}"])
#: type: lexical rule of the whole (sometimes trimmed) text.
PATTERN = {
    "string": r"^\S(?s:.*\S)?$",
    "token": r"^(?:\p{L}|_)(?:\p{L}|\p{N}|[.\-_])*$",
    "uri": r"^[a-zA-Z][a-zA-Z0-9+\-.]+:.+$",
    "uri-reference": r"^[^\s<>\\^`{|}]+$",
    "uuid": r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[45][0-9A-Fa-f]{3}-[89ABab][0-9A-Fa-f]{3}-[0-9A-Fa-f]{12}$",
    "email-address": r"^.+@.+$",
    "hostname": r"^\S(?s:.*\S)?$",
    "integer": r"^[+-]?\d+$",
    "non-negative-integer": r"^\+?\d+$",
    "positive-integer": r"^\+?0*[1-9]\d*$",
    "decimal": r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)$",
    "boolean": r"^(?i:true|false|1|0)$",
    "base64": r"^[0-9A-Za-z+/]+={0,2}$",
    "date": rf"^{_DAY}{_TZ}?$",
    "date-with-timezone": rf"^{_DAY}{_TZ}$",
    "date-time": rf"^{_DAY}T{_CLOCK}{_TZ}?$",
    "date-time-with-timezone": rf"^{_DAY}T{_CLOCK}{_TZ}$",
    "day-time-duration": r"^-?P(?=\d|T\d)(?:\d+D)?(?:T(?=\d)(?:\d+H)?(?:\d+M)?(?:\d+(?:\.\d+)?S)?)?$",
    "year-month-duration": r"^-?P(?=\d)(?:\d+Y)?(?:\d+M)?$",
    "ip-v4-address": rf"^(?:{_OCTET}\.){{3}}{_OCTET}$",
    "ip-v6-address": rf"^(?:{_IPV6})$",
    "markup-line": r"(?s).*",
    "markup-multiline": r"(?s).*",
}
TRIMMED = frozenset("hostname integer non-negative-integer positive-integer decimal boolean".split())
#: Item type of a scalar type, and of the names used in casts.
ITEM_TYPE = {
    **dict.fromkeys(PATTERN, "string"),
    "integer": "integer", "non-negative-integer": "integer", "positive-integer": "integer", "decimal": "decimal", "boolean": "boolean", "uri": "uri", "uri-reference": "uri",
    "date": "date", "date-with-timezone": "date", "date-time": "dateTime", "date-time-with-timezone": "dateTime", "day-time-duration": "dayTimeDuration", "year-month-duration": "duration",
    "double": "double", "float": "double", "int": "integer", "long": "integer", "dateTime": "dateTime", "time": "time", "duration": "duration", "dayTimeDuration": "dayTimeDuration", "yearMonthDuration": "duration", "anyURI": "uri", "anyAtomicType": "string",
}
_custom: dict[str, Callable[[Column], Column]] = {}


def register(name: str, valid: Callable[[Column], Column], item_type: str = "string") -> None:
    """Adds or replaces a scalar type."""
    _custom[name] = valid
    ITEM_TYPE[name] = item_type


def lexical(name: str, c: Column) -> Column:
    return F.trim(c) if name in TRIMMED else c


def is_valid(name: str, c: Column) -> Column:
    """Is the text a value of the type? NULL stays NULL. An unknown type takes any text."""
    if name in _custom:
        return _custom[name](c)
    if name not in PATTERN:
        return c.isNotNull()
    ok = lexical(name, c).rlike(PATTERN[name])
    if name in ("date", "date-with-timezone", "date-time", "date-time-with-timezone", "base64") or ITEM_TYPE[name] == "integer":
        extra = F.try_to_binary(c, F.lit("base64")).isNotNull() if name == "base64" else parsed(name, c).isNotNull()
        if name in ("non-negative-integer", "positive-integer"):
            extra = lexical(name, c).try_cast("decimal(20,0)") <= F.lit("18446744073709551615").cast("decimal(20,0)")
        ok = ok & F.coalesce(extra, F.lit(False))
    return ok


def offset(c: Column) -> Column:
    """Minutes of a time zone at the end of a text, NULL without one."""
    z = F.regexp_extract(c, rf"{_TZ}$", 1)
    minutes = F.substring(z, 2, 2).try_cast("int") * 60 + F.substring(z, 5, 2).try_cast("int")
    return F.when(z == "Z", 0).when(z == "", None).when(z.startswith("-"), -minutes).otherwise(minutes).cast("int")


def micros_of_clock(c: Column) -> Column:
    sec = F.regexp_extract(c, r"(\d{2}):(\d{2}):(\d{2}(?:\.\d+)?)", 3).try_cast("decimal(18,6)")
    part = lambda i: F.regexp_extract(c, r"(\d{2}):(\d{2}):(\d{2}(?:\.\d+)?)", i).try_cast("long")
    return part(1) * 3_600_000_000 + part(2) * 60_000_000 + (sec * 1_000_000).cast("long")


def parsed(name: str, c: Column) -> Column:
    """The value of a text, in the storage type of its item; NULL if it isn't one."""
    t = ITEM_TYPE.get(name, "string")
    c = lexical(name, c)
    guard = lambda out, p=PATTERN.get(name): F.when(c.rlike(p), out) if p else out
    if t == "integer":
        return guard(c.try_cast("bigint"))
    if t == "decimal":
        return guard(c.try_cast("decimal(38,10)"))
    if t == "double":
        return F.when(c == "INF", float("inf")).when(c == "-INF", float("-inf")).when(c == "NaN", float("nan")).otherwise(c.try_cast("double"))
    if t == "boolean":
        return F.when(F.lower(c).isin("true", "1"), True).when(F.lower(c).isin("false", "0"), False)
    if t == "date":
        d = F.substring(c, 1, 10).try_cast("date")
        return F.when(c.rlike(PATTERN["date-with-timezone" if name == "date-with-timezone" else "date"]) & d.isNotNull(), F.struct(d.alias("d"), offset(c).alias("tz")))
    if t == "dateTime":
        body = F.regexp_replace(c, rf"{_TZ}$", "")
        ts = body.try_cast("timestamp_ntz")
        return F.when(c.rlike(PATTERN["date-time-with-timezone" if name == "date-time-with-timezone" else "date-time"]) & ts.isNotNull(), F.struct(ts.alias("ts"), offset(c).alias("tz")))
    if t == "time":
        return F.when(c.rlike(rf"^{_CLOCK}{_TZ}?$"), F.struct(micros_of_clock(c).alias("us"), offset(c).alias("tz")))
    part = lambda unit, kind="long": F.coalesce(F.regexp_extract(c, rf"([\d.]+){unit}", 1).try_cast(kind), F.lit(0).cast(kind))
    sign = F.when(c.startswith("-"), -1).otherwise(1)
    clock = F.when(c.contains("T"), F.substring_index(c, "T", -1)).otherwise("")
    cpart = lambda unit, kind="long": F.coalesce(F.regexp_extract(clock, rf"([\d.]+){unit}", 1).try_cast(kind), F.lit(0).cast(kind))
    us = part("D") * 86_400_000_000 + cpart("H") * 3_600_000_000 + cpart("M") * 60_000_000 + (cpart("S", "decimal(18,6)") * 1_000_000).cast("long")
    if t == "dayTimeDuration":
        return F.when(c.rlike(PATTERN["day-time-duration"]), us * sign)
    if t == "duration":
        before = F.substring_index(c, "T", 1)
        m = F.coalesce(F.regexp_extract(before, r"(\d+)M", 1).try_cast("int"), F.lit(0))
        months = (part("Y", "int") * 12 + m) * sign
        ok = r"^-?P(?=\d|T\d)(?:\d+Y)?(?:\d+M)?(?:\d+D)?(?:T(?=\d)(?:\d+H)?(?:\d+M)?(?:\d+(?:\.\d+)?S)?)?$" if name == "duration" else PATTERN["year-month-duration"]
        return F.when(c.rlike(ok), F.struct(months.cast("int").alias("months"), (us * sign if name == "duration" else F.lit(0).cast("long")).alias("us")))
    return guard(F.lower(c) if name == "uuid" else c)
