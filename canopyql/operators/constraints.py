"""Declarative constraints as set-oriented Spark jobs; every finding is a row.

Each constraint is evaluated at every instance of its definition. Rules about single values and counts are evaluated in one pass over the
documents, however many there are: the targets of all of them are exploded at once, each row with the number of its constraint. For keys, targets are
exploded to rows (document, context node, position, value), and the rule is an aggregate or an anti-join over them. An index holds within its document, unless it is asked to hold
across all of them. Findings carry the place of their node in the document (``at``), by which `ordered` sorts them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog.module import Constraint
from ..engine import Documents
from ..functions.datatypes import is_valid
from ..plans.compiler import Env, member
from ..plans.model import PathError, V, count, listed, one

FINDINGS = "doc string, location string, severity string, constraint_id string, kind string, message string, at array<int>"
#: From the least to the most severe.
LEVELS = ("DEBUG", "INFORMATIONAL", "WARNING", "ERROR", "CRITICAL")


def _targets(docs: Documents, context: str, target: str, values: list[str] = ()) -> DataFrame:
    """Rows of the targets below each context node: doc, node (order key of the context), at (of the target), location, value, and more values."""
    c = docs.engine.compiler()
    env = Env(ctx=docs.context(), vars=docs.engine.variables)
    ctx = c.compile(context, env)
    doc = F.concat_ws("/", *(F.col(k).cast("string") for k in docs.keys))
    out = None
    for s in ctx.segs or []:
        nodes = docs.df.filter(F.col("doc").isNotNull()).select(doc.alias("__doc"), F.explode(s.col if ctx.many else listed(s.col)).alias("c")).withColumnRenamed("__doc", "doc")
        here = member(s, F.col("c"))
        found = c.compile(target, Env(ctx=here, vars=docs.engine.variables))
        if found.segs is None and found.t != "empty":
            found = here
        for g in found.segs or []:
            rows = nodes.select("doc", F.col("c.k").alias("node"), F.explode(g.col if found.many else listed(g.col)).alias("t"))
            own = member(g, F.col("t"))
            value = c.strings(own)
            extra = [_value(c, own, v, docs.engine.variables).alias(f"v{i}") for i, v in enumerate(values)]
            label = "/" + "/".join([n.name for n in g.chain] + ([g.leaf[0]] if g.leaf else []))
            part = rows.select("doc", "node", F.col("t.k").alias("at"), F.lit(label).alias("location"), one(value).alias("value"), *extra)
            out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.engine.spark.createDataFrame([], "doc string, node array<int>, at array<int>, location string, value string" + "".join(f", v{i} string" for i in range(len(values))))


def _value(c, own: V, expression: str, variables: dict) -> Column:
    return one(c.strings(c.compile(expression, Env(ctx=own, vars=variables))))


def _found(rows: DataFrame, k: Constraint, message: Column | str, severity: str | None = None) -> DataFrame:
    m = F.lit(k.message) if k.message else (message if isinstance(message, Column) else F.lit(message))
    return rows.select("doc", "location", F.lit(severity or k.level).alias("severity"), F.lit(k.id).cast("string").alias("constraint_id"), F.lit(k.kind).alias("kind"), m.alias("message"), "at")


def _keyed(docs: Documents, context: str, k: Constraint) -> DataFrame:
    rows = _targets(docs, context, k.target, [t for t, _ in k.keys])
    for i, (_, pattern) in enumerate(k.keys):
        if pattern:
            v = F.col(f"v{i}")
            group = F.regexp_extract(v, pattern, 1) if "(" in pattern else F.regexp_extract(v, pattern, 0)
            rows = rows.withColumn(f"v{i}", F.when(v.rlike(pattern), group).otherwise(v))
    return rows.withColumn("key", F.struct(*(F.col(f"v{i}") for i in range(len(k.keys)))))


_SAID = "array<struct<severity:string,message:string>>"


def _label(s) -> str:
    return "/" + "/".join([n.name for n in s.chain] + ([s.leaf[0]] if s.leaf else []))


def _cell(number: int, node: Column, at: Column, location: str, value: Column, vs: list[Column] = ()) -> Column:
    values = F.array(*vs).cast("array<string>") if vs else F.array().cast("array<string>")
    return F.struct(F.lit(number).alias("c"), node.alias("node"), at.alias("at"), F.lit(location).alias("location"), value.cast("string").alias("value"), values.alias("vs"))


def _rows(docs: Documents, context: str, k: Constraint, number: int) -> list[Column]:
    """Arrays of the targets of a constraint in a document; of a cardinality its context nodes with the number of targets."""
    c, seen = docs.engine.compiler(), docs.engine.variables
    ctx, out = c.compile(context, Env(ctx=docs.context(), vars=seen)), []
    at = lambda s, x, e: c.compile(e, Env(ctx=member(s, x), vars=seen))

    def counted(s):
        return lambda x: _cell(number, x["k"], x["k"], _label(s), count(at(s, x, k.target)))

    def targets(s, n: int, here: bool):
        def each(x: Column) -> Column:
            found = member(s, x) if here else at(s, x, k.target)
            h = found.segs[n]
            tests = [f"boolean({k.test})"] if k.kind == "expect" else []
            row = lambda t: _cell(number, x["k"], t["k"], _label(h), one(c.strings(member(h, t))), [_value(c, member(h, t), e, seen) for e in tests])
            return F.transform(h.col if found.many else listed(h.col), row)

        return each

    for s in ctx.segs or []:
        col = s.col if ctx.many else listed(s.col)
        if k.kind == "has-cardinality":
            out.append(F.transform(col, counted(s)))
            continue
        shape = at(s, F.col("__probe"), k.target)
        here = shape.segs is None and shape.t != "empty"  # a value of the context node itself
        out += [F.flatten(F.transform(col, targets(s, n, here))) for n in range(1 if here else len(shape.segs or []))]
    return out


def _said(docs: Documents, k: Constraint) -> Column:
    """What a constraint says of a row: none, one or two pairs of severity and message."""
    value, v0 = F.col("r.value"), F.get(F.col("r.vs"), F.lit(0))
    say = lambda bad, message, level=None: F.when(bad, F.struct(F.lit(level or k.level).alias("severity"), (F.lit(k.message) if k.message else message).alias("message")))
    quoted = lambda tail: F.concat(F.lit("Value '"), value, F.lit(tail))
    if k.kind == "allowed-values":
        wanted, old = list(k.values), [v for v, since in k.values.items() if since]
        shown = ", ".join(wanted[:5]) + (f"... ({len(wanted)} total)" if len(wanted) > 5 else "")
        out = [] if k.allow_other else [say(~value.isin(wanted), quoted(f"' is not one of: {shown}"))]
        out += [say(value.isin(old), quoted("' is deprecated"), "WARNING")] if old else []
    elif k.kind == "matches":
        ok = F.lit(True)
        if k.regex:
            try:
                docs.engine.spark.range(1).select(F.lit("").rlike(k.regex)).collect()
            except Exception:  # noqa: BLE001  the pattern is wrong, which is itself a finding
                return F.array(say(F.lit(True), F.lit(f"Invalid regex pattern: {k.regex}"))).cast(_SAID)
            ok = ok & value.rlike(k.regex)
        if k.datatype:
            ok = ok & F.coalesce(is_valid(k.datatype, value), F.lit(False))
        out = [say(~ok, quoted(f"' does not match {k.regex or k.datatype}"))]
    elif k.kind == "expect":
        out = [say(v0 != "true", F.lit(f"Expectation not met: {k.test}"))]
    else:
        n = value.cast("long")
        out = [say(n < k.least, F.concat(F.lit(f"At least {k.least} expected, found "), value))] if k.least is not None else []
        out += [say(n > k.most, F.concat(F.lit(f"At most {k.most} expected, found "), value))] if k.most is not None else []
    return F.filter(F.array(*out), lambda x: x.isNotNull()).cast(_SAID) if out else F.array().cast(_SAID)


def _single(docs: Documents, constraints: list[tuple[str, Constraint]]) -> DataFrame | None:
    """Findings of all rules about single values and counts, in one pass."""
    arrays, said = [], F.lit(None).cast(_SAID)
    for number, (path, k) in enumerate(constraints):
        says = _said(docs, k)
        try:
            arrays += _rows(docs, path, k, number)
        except (PathError, ValueError) as e:
            if k.kind != "expect":
                raise
            arrays += _rows(docs, path, replace(k, test="true()"), number)
            says = F.array(F.struct(F.lit("ERROR").alias("severity"), F.lit(k.message or f"Error evaluating {k.test}: {e}").alias("message"))).cast(_SAID)
        said = F.when(F.col("r.c") == number, says).otherwise(said)
    if not arrays:
        return None
    doc = F.concat_ws("/", *(F.col(x).cast("string") for x in docs.keys))
    rows = docs.df.filter(F.col("doc").isNotNull()).select(doc.alias("__doc"), F.explode(F.concat(*arrays)).alias("r")).withColumnRenamed("__doc", "doc")
    of = lambda field: F.element_at(F.array(*(F.lit(getattr(k, field)).cast("string") for _, k in constraints)), F.col("r.c") + 1)
    found = rows.select("doc", "r", F.explode(said).alias("s"))
    return found.select("doc", F.col("r.location").alias("location"), F.col("s.severity").alias("severity"), of("id").alias("constraint_id"), of("kind").alias("kind"), F.col("s.message").alias("message"), F.col("r.at").alias("at"))


def _by_key(docs: Documents, context: str, k: Constraint, indexes: dict[str, DataFrame], across: bool) -> DataFrame:
    """Findings of a constraint on keys."""
    rows = _keyed(docs, context, k)
    if k.kind == "index-has-key":
        if k.name not in indexes:
            return _found(rows, k, f"Index '{k.name}' not found", "ERROR")
        asked = rows.filter(" and ".join(f"v{i} is not null" for i in range(len(k.keys))))
        by = ["key"] if across else ["doc", "key"]
        missing = asked.join(indexes[k.name].select(*by).distinct(), by, "left_anti")
        return _found(missing, k, F.concat(F.lit(f"Key not found in index '{k.name}': "), F.to_json("key")))
    twice = rows.groupBy("doc", "node", "key").agg(F.count("*").alias("n"), F.min(F.struct("at", "location")).alias("first")).filter("n > 1").select("doc", "node", "key", F.col("first.at").alias("kept"))
    return _found(rows.join(twice, ["doc", "node", "key"]).filter("at <> kept"), k, F.concat(F.lit("Duplicate key: "), F.to_json("key")))


def validate(docs: Documents, constraints: list[tuple[str, Constraint]], across: bool = False) -> DataFrame:
    """Findings of all constraints, each with the path of its context nodes; indexes are built first. across: keys of one document satisfy another's."""
    known = ("allowed-values", "matches", "expect", "has-cardinality", "index", "index-has-key", "is-unique")
    for _, k in constraints:
        if k.kind not in known:
            raise ValueError(f"unknown constraint {k.kind}")
    indexes = {k.name: _keyed(docs, path, k) for path, k in constraints if k.kind == "index"}
    single = _single(docs, [x for x in constraints if x[1].kind in known[:4]])
    parts = [single] if single is not None else []
    parts += [_by_key(docs, path, k, indexes, across) for path, k in constraints if k.kind in known[5:]]
    return merged(*parts) if parts else docs.engine.spark.createDataFrame([], FINDINGS)


def of_module(module, root: str) -> list[tuple[str, Constraint]]:
    """The constraints of every instance below a root assembly, with the path of its instances."""
    out: list[tuple[str, Constraint]] = []

    def walk(d, path: str, above: tuple) -> None:
        out.extend((path, k) for k in d.constraints)
        for f in d.flags:
            if f.definition:
                out.extend((("" if path == "." else path + "/") + "@" + f.name, k) for k in f.definition.constraints)
        for i in d.children():
            if i.definition and id(i.definition) not in above:
                walk(i.definition, i.name if path == "." else f"{path}/{i.name}", (*above, id(i.definition)))

    d = module.roots()[root]
    walk(d, ".", (id(d),))
    return out


def type_findings(docs: Documents, module, root: str) -> DataFrame:
    """A finding for each text that is no value of its declared type; docs come from files and keep their raw texts."""
    d, out = module.roots()[root], docs.engine.spark.createDataFrame([], FINDINGS)

    def check(name: str, value: Column, rows: DataFrame, location: str) -> None:
        nonlocal out
        bad = rows.filter(value.isNotNull() & ~F.coalesce(is_valid(name, value), F.lit(False)))
        m = F.concat(F.lit("Value '"), value, F.lit(f"' is not a {name}"))
        out = out.unionByName(bad.select(F.col("path").alias("doc"), F.lit(location).alias("location"), F.lit("ERROR").alias("severity"), F.lit(None).cast("string").alias("constraint_id"), F.lit("type-check").alias("kind"), m.alias("message"), F.lit(None).cast("array<int>").alias("at")))

    def walk(d, rows: DataFrame, location: str) -> None:
        from ..catalog.generate import raw_name

        for f in d.flags:
            if f.definition:
                check(f.definition.datatype, F.col("x")[f.name], rows, f"{location}/@{f.name}")
        if d.kind == "field":
            check(d.datatype, F.col("x")[raw_name(d)], rows, location)
        for i in d.children():
            if i.definition:
                inner = F.col("x")[i.name]
                walk(i.definition, rows.select("path", F.explode(inner).alias("x")) if i.many else rows.select("path", inner.alias("x")), f"{location}/{i.name}")

    walk(d, docs.df.select("path", F.col("raw").alias("x")).filter("x is not null"), f"/{root}")
    return out


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").count()


def at_or_above(findings: DataFrame, level: str) -> DataFrame:
    """The findings of a severity or a greater one."""
    return findings.filter(F.col("severity").isin(*LEVELS[LEVELS.index(level) :]))


def merged(*results: DataFrame) -> DataFrame:
    """Several results as one."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def ordered(findings: DataFrame) -> DataFrame:
    """By document, then in the order of its nodes, then by severity from the greatest."""
    rank = F.array_position(F.lit(list(LEVELS)), F.col("severity"))
    return findings.orderBy("doc", F.asc_nulls_last("at"), rank.desc(), "kind", "message")


def is_valid_set(findings: DataFrame) -> bool:
    """No critical and no error finding."""
    return not at_or_above(findings, "ERROR").limit(1).count()
