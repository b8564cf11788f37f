"""Compiles a parsed expression to Column expressions over rows of documents.

A document is one row; its nodes are nested structs, so a path is a composition of array functions and never shuffles. A static
type and cardinality is known for every sub-expression. A node carries the values of its ancestors and its document-order key, so
that every axis, sorting and duplicate removal are array functions too."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .model import DDL, EMPTY, NUMERIC, Child, PathError, Seg, V, arr, count, instant, let, listed, none_of, number, one, or_none, text
from .parser import parse

FORWARD = ("child", "descendant", "descendant-or-self", "self", "flag", "following", "following-sibling")


@dataclass(frozen=True)
class Env:
    ctx: V | None = None
    pos: Column | None = None
    last: Column | None = None
    vars: dict = field(default_factory=dict)

    def bind(self, name: str, v: V) -> Env:
        return replace(self, vars=self.vars | {name: v})


def member(s: Seg, x: Column) -> V:
    return V("node", None, False, segs=[Seg(s.chain, s.leaf, x)])


def matches(test: tuple, name: str, kind: str) -> bool:
    if test[0] == "kind":
        return (test[1] == "node" or {"document-node": "document"}.get(test[1], test[1]) == kind) and test[2] in (None, "*", name)
    want = test[1]
    if want == "*":
        return True
    if want.endswith(":*"):
        return name.startswith(want[:-1])
    if want.startswith("*:"):
        return name.split(":")[-1] == want[2:]
    if want.startswith("Q{"):
        want = want[want.index("}") + 1 :]
        return want in ("*", name.split(":")[-1])
    return name == want


def up_to(x: Column, d: int, k: Column) -> Column:
    return F.struct(k.alias("k"), *(x[f"n{i}"].alias(f"n{i}") for i in range(d + 1)))


def children(s: Seg, x: Column, c: Child, i: int) -> Seg:
    d = len(s.chain) - 1
    value = x[f"n{d}"][c.field]
    items = or_none(value) if c.many else listed(value)
    make = lambda y, j: F.struct(F.concat(x["k"], F.array(F.lit(i + 1), (j + 1).cast("int"))).alias("k"), *(x[f"n{n}"].alias(f"n{n}") for n in range(d + 1)), y.alias(f"n{d + 1}"))
    return Seg([*s.chain, c.node], None, F.transform(items, make))


def axis(s: Seg, x: Column, name: str, test: tuple) -> list[Seg]:
    """Arrays of the nodes on an axis of x, in axis order within each place of the model."""
    d = len(s.chain) - 1
    fits = lambda g: matches(test, g.name, g.kind)
    if name == "self":
        return [Seg(s.chain, s.leaf, listed(x))] if fits(s) else []
    if name in ("parent", "ancestor", "ancestor-or-self"):
        out = axis(s, x, "self", test) if name == "ancestor-or-self" else []
        tops = list(range(d, -1, -1)) if s.leaf else list(range(d - 1, -1, -1))
        for step, top in enumerate(tops[:1] if name == "parent" else tops, 1):
            g = Seg(s.chain[: top + 1], None, F.array(up_to(x, top, F.slice(x["k"], 1, F.size(x["k"]) - 2 * step))))
            out += [g] if fits(g) else []
        return out
    if s.leaf:
        return axis(s, x, "self", test) if name == "descendant-or-self" else []
    if name == "flag":
        out = []
        for i, (flag, (t, f)) in enumerate(s.chain[-1].flags.items()):
            v = x[f"n{d}"][f]
            g = Seg(s.chain, (flag, t), F.filter(F.array(F.struct(F.concat(x["k"], F.array(F.lit(0), F.lit(i))).alias("k"), *(x[f"n{n}"].alias(f"n{n}") for n in range(d + 1)), v.alias("v"))), lambda y: y["v"].isNotNull()))
            out += [g] if fits(g) else []
        return out
    if name == "child":
        return [g for i, c in enumerate(s.chain[-1].children) if matches(test, c.node.name, c.node.kind) for g in [children(s, x, c, i)]]
    if name in ("descendant", "descendant-or-self"):
        out = axis(s, x, "self", test) if name == "descendant-or-self" else []
        for i, c in enumerate(s.chain[-1].children):
            if c.node in s.chain:
                raise PathError(f"{c.node.name} is recursive: use the node table")
            g = children(s, x, c, i)
            below = axis(Seg(g.chain, None, x), _probe(), "descendant", test)
            if fits(g):
                out.append(g)
            for n in range(len(below)):
                out.append(Seg(below[n].chain, below[n].leaf, F.flatten(F.transform(g.col, lambda y: axis(Seg(g.chain, None, y), y, "descendant", test)[n].col))))
        return out
    if name in ("following-sibling", "preceding-sibling"):
        if d == 0:
            return []
        p = Seg(s.chain[:-1], None, up_to(x, d - 1, F.slice(x["k"], 1, F.size(x["k"]) - 2)))
        found = axis(p, p.col, "child", test)
        if name[0] == "f":
            return [Seg(g.chain, g.leaf, F.filter(g.col, lambda y: y["k"] > x["k"])) for g in found]
        return [Seg(g.chain, g.leaf, F.reverse(F.filter(g.col, lambda y: y["k"] < x["k"]))) for g in found]
    root = Seg(s.chain[:1], None, up_to(x, 0, F.slice(x["k"], 1, 0)))
    found = axis(root, root.col, "descendant", test)
    if name == "following":
        return [Seg(g.chain, g.leaf, F.filter(g.col, lambda y: (y["k"] > x["k"]) & (F.slice(y["k"], 1, F.size(x["k"])) != x["k"]))) for g in found]
    return [Seg(g.chain, g.leaf, F.reverse(F.filter(g.col, lambda y: (y["k"] < x["k"]) & (F.slice(x["k"], 1, F.size(y["k"])) != y["k"])))) for g in found]


def ordinal(*parts: Column) -> Column:
    return F.array(*(p.cast("int") for p in parts))


def backwards(x: Column, i: Column) -> Column:
    """A key of reverse document order, in which what lies within a node comes before it."""
    return F.concat(F.transform(x["k"], lambda e: -e), ordinal(F.lit(2**31 - 1)))


def calls(e: object, *names: str) -> bool:
    """Whether a tree calls or names one of the functions."""
    if isinstance(e, (tuple, list)):
        if len(e) > 1 and e[0] in ("call", "ref") and isinstance(e[1], str) and e[1].rpartition(":")[2] in names:
            return True
        return any(calls(x, *names) for x in e)
    return False


def _probe() -> Column:
    return F.col("__probe")


class Compiler:
    def __init__(self, functions: dict, base_uri: str | None = None):
        self.functions, self.base_uri = functions, base_uri

    # values

    def atoms(self, v: V) -> V:
        """Typed atomisation: the values of nodes have their declared types."""
        if v.segs is None:
            return v
        parts = []
        for s in v.segs:
            if s.leaf:
                t, get = s.leaf[1], lambda x: x["v"]
            elif s.chain[-1].value:
                t, get = s.chain[-1].value[0], lambda x, s=s: x[f"n{len(s.chain) - 1}"][s.chain[-1].value[1]]
            else:
                t, get = "string", lambda x: F.lit("")
            if not v.many:
                return V(t, F.when(s.col.isNotNull(), get(s.col)))
            parts.append((t, s, get))
        if not parts:
            return EMPTY
        kinds = {t for t, _, _ in parts}
        t = kinds.pop() if len(kinds) == 1 else "string"
        if len(parts) == 1:
            _, s, get = parts[0]
            return V(t, F.filter(F.transform(s.col, lambda x: get(x)), lambda y: y.isNotNull()), True)
        cell = lambda n, u, s, get: lambda x, i: F.struct(s.order(x, i).alias("k"), F.lit(n).alias("s"), i.alias("i"), (get(x) if t == u else text(u, get(x))).cast(DDL[t]).alias("v"))
        both = F.concat(*(F.transform(s.col, cell(n, u, s, get)) for n, (u, s, get) in enumerate(parts)))
        return V(t, F.filter(F.transform(F.sort_array(both), lambda y: y["v"]), lambda y: y.isNotNull()), True)

    def ebv(self, v: V) -> Column:
        """Effective boolean value, never NULL."""
        if v.t == "empty":
            return F.lit(False)
        if v.segs is not None:
            return count(v) > 0
        rule = lambda c: F.coalesce(
            {"boolean": lambda: c, "string": lambda: c != "", "integer": lambda: c != 0, "decimal": lambda: c != 0, "double": lambda: (c != 0) & ~F.isnan(c), "duration": lambda: (c["months"] != 0) | (c["us"] != 0), "dayTimeDuration": lambda: c != 0, "array": lambda: F.size(c) > 0, "map": lambda: F.size(c) > 0}.get(
                v.t, lambda: c.isNotNull()
            )(),
            F.lit(False),
        )
        if not v.many:
            return rule(v.col)
        return F.when(F.size(v.col) > 1, F.raise_error(F.lit("effective boolean value of several items")).cast("boolean")).otherwise(rule(one(v)))

    def strings(self, v: V) -> V:
        v = self.atoms(v)
        if v.t in ("string", "empty"):
            return v
        return V("string", F.transform(v.col, lambda x: text(v.t, x)), True) if v.many else V("string", text(v.t, v.col))

    def numeric(self, v: V) -> V:
        v = self.atoms(v)
        if v.t in NUMERIC or v.t == "empty":
            return v
        return V("decimal", F.transform(v.col, lambda x: number(v.t, x)), True) if v.many else V("decimal", number(v.t, v.col))

    def join(self, parts: list[V]) -> V:
        """Concatenation; different atomic types become numbers if they can, else strings."""
        parts = [p for p in parts if p.t != "empty"]
        if not parts:
            return EMPTY
        if len(parts) == 1:
            return parts[0]
        if all(p.segs is not None for p in parts):
            # the parts one after the other; a part of one place in the order of its array
            key = lambda n, p, s: (lambda x, i: F.concat(ordinal(F.lit(n)), s.order(x, i)) if len(p.segs) > 1 else ordinal(F.lit(n), i))
            return V("node", None, True, segs=[replace(s, col=s.col if p.many else listed(s.col), key=key(n, p, s)) for n, p in enumerate(parts) for s in p.segs])
        parts = [self.atoms(p) for p in parts]
        parts = [p for p in parts if p.t != "empty"] or [EMPTY]
        kinds = {p.t for p in parts}
        if len(kinds) > 1:
            t = next(k for k in ("double", "decimal") if k in kinds) if kinds <= set(NUMERIC) else "string"
            parts = [self.cast_all(p, t) for p in parts]
        else:
            t = kinds.pop()
        return V(t, F.concat(*(arr(p) for p in parts)), True, elem=parts[0].elem)

    def cast_all(self, v: V, t: str) -> V:
        f = (lambda c: text(v.t, c)) if t == "string" else (lambda c: c.cast(DDL[t]))
        return V(t, F.transform(v.col, f), True) if v.many else V(t, f(v.col))

    def merged(self, v: V, f) -> Column:
        """f(nodes, tags): tags (k, s, i) are the places of all nodes in order, nodes(s, i) is the node at a place. All is evaluated once."""
        cols = F.struct(*((s.col if v.many else listed(s.col)).alias(f"s{n}") for n, s in enumerate(v.segs)))
        tag = lambda n, s: lambda x, i: F.struct(s.order(x, i).alias("k"), F.lit(n).alias("s"), i.alias("i"))

        def bound(c: Column) -> Column:
            tags = F.concat(*(F.transform(c[f"s{n}"], tag(n, s)) for n, s in enumerate(v.segs)))
            return let(F.sort_array(tags), lambda t: f(lambda n, i: F.get(c[f"s{n}"], i), t))

        return let(cols, bound)

    def reshaped(self, v: V, f) -> V:
        """The nodes of several places whose tags f returns, in the order of f's array."""

        def of(n: int) -> Column:
            pick = lambda nodes, tags: F.filter(F.transform(f(tags), lambda t, i: F.when(t["s"] == n, nodes(n, t["i"]).withField("o", ordinal(i)))), lambda x: x.isNotNull())
            return self.merged(v, pick)

        return V("node", None, True, segs=[Seg(s.chain, s.leaf, of(n), lambda x, i: x["o"]) for n, s in enumerate(v.segs)])

    def over(self, v: V, body, path: bool = False) -> V:
        """Evaluates body(item, position, last) for each item, in order, and puts the results together.

        path: the results are nodes whose order doesn't matter, since a path sorts them."""
        if v.t == "empty":
            return EMPTY
        v = v if v.many or v.segs is not None else V(v.t, listed(v.col), True, elem=v.elem)
        if v.segs is not None and len(v.segs) > 1:
            return self.over_places(v, body)
        s = v.segs[0] if v.segs is not None else None
        col = (s.col if v.many else listed(s.col)) if s else v.col
        item = (lambda x: member(s, x)) if s else (lambda x: V(v.t, x, elem=v.elem))
        shape = body(item(_probe()), F.lit(1), F.lit(1))
        if shape.t == "empty":
            return EMPTY
        each = lambda get: F.flatten(F.transform(col, lambda x, i: get(body(item(x), (i + 1).cast("long"), F.size(col).cast("long")), i)))
        if shape.segs is None:
            return V(shape.t, each(lambda r, i: arr(r)), True, elem=shape.elem)
        listing = lambda r, n: r.segs[n].col if r.many else listed(r.segs[n].col)
        if path or len(shape.segs) == 1:
            return V("node", None, True, segs=[Seg(g.chain, g.leaf, each(lambda r, i, n=n: listing(r, n))) for n, g in enumerate(shape.segs)])
        return V("node", None, True, segs=[Seg(g.chain, g.leaf, each(lambda r, i, n=n: self.placed(r.segs[n], listing(r, n), i)), lambda x, i: x["o"]) for n, g in enumerate(shape.segs)])

    @staticmethod
    def placed(s: Seg, col: Column, turn: Column, alone: bool = False) -> Column:
        """Nodes that remember in which turn, and where in it, they came."""
        return F.transform(col, lambda y, j: y.withField("o", ordinal(turn, j) if alone else F.concat(ordinal(turn), s.order(y, j))))

    def over_places(self, v: V, body) -> V:
        """`over` for nodes of several places of the model: all of them in one order, each with its own body."""
        shapes = [body(member(s, _probe()), F.lit(1), F.lit(1)) for s in v.segs]
        some = [x for x in shapes if x.t != "empty"]
        if not some:
            return EMPTY
        run = lambda n, nodes, t, i, tags: body(member(v.segs[n], nodes(n, t["i"])), (i + 1).cast("long"), F.size(tags).cast("long"))
        if all(x.segs is not None for x in some):
            out = []
            for n, shape in enumerate(shapes):
                for m, g in enumerate(shape.segs or []):
                    listing = lambda r, i, m=m: self.placed(r.segs[m], r.segs[m].col if r.many else listed(r.segs[m].col), i, len(r.segs) == 1)
                    turns = lambda nodes, tags, n=n, listing=listing: F.flatten(F.filter(F.transform(tags, lambda t, i: F.when(t["s"] == n, listing(run(n, nodes, t, i, tags), i))), lambda x: x.isNotNull()))
                    out.append(Seg(g.chain, g.leaf, self.merged(v, turns), lambda x, i: x["o"]))
            return V("node", None, True, segs=out)
        kinds = {self.atoms(x).t for x in some} - {"empty"}
        t = (kinds.copy().pop() if len(kinds) == 1 else next((k for k in ("double", "decimal") if k in kinds), "integer") if kinds <= set(NUMERIC) else "string") if kinds else "string"

        def values(r: V) -> Column:
            r = self.atoms(r)
            return none_of(t) if r.t == "empty" else arr(r if r.t == t else self.cast_all(r, t))

        def each(nodes, tags: Column) -> Column:
            def turn(x: Column, i: Column) -> Column:
                pick = None
                for n, shape in enumerate(shapes):
                    if shape.t != "empty":
                        found = values(run(n, nodes, x, i, tags))
                        pick = F.when(x["s"] == n, found) if pick is None else pick.when(x["s"] == n, found)
                return pick.otherwise(none_of(t) if t in DDL else F.lit(None))

            return F.flatten(F.transform(tags, turn))

        return V(t, self.merged(v, each), True, elem=some[0].elem)

    def sorted(self, v: V) -> V:
        """Nodes in document order without duplicates; places of the model that coincide become one."""
        by: dict[tuple, list[Seg]] = {}
        for s in v.segs:
            by.setdefault((tuple(id(c) for c in s.chain), s.leaf), []).append(s)
        segs = []
        for group in by.values():
            col = F.array_sort(F.concat(*(s.col for s in group)), lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
            segs.append(Seg(group[0].chain, group[0].leaf, let(col, lambda c: F.filter(c, lambda x, i: (i == 0) | (x["k"] != F.get(c, i - 1)["k"])))))
        return V("node", None, True, segs=segs)

    # expressions

    def compile(self, source: str | tuple, env: Env) -> V:
        return self.c(parse(source) if isinstance(source, str) else source, env)

    def c(self, e: tuple, env: Env) -> V:
        return getattr(self, "c_" + _METHODS.get(e[0], e[0].replace("-", "_")))(e, env)

    def c_lit(self, e, env):
        if e[1] == "decimal":
            return V("decimal", F.lit(Decimal(e[2])))
        return V(e[1], F.lit(e[2]).cast(DDL[e[1]]))

    def c_seq(self, e, env):
        return self.join([self.c(x, env) for x in e[1]])

    def c_paren(self, e, env):
        return self.c(e[1], env)

    def c_context(self, e, env):
        if env.ctx is None:
            raise PathError("no context item")
        return env.ctx

    def c_var(self, e, env):
        if e[1] not in env.vars:
            raise PathError(f"unknown variable ${e[1]}")
        return env.vars[e[1]]

    def c_root(self, e, env):
        s = self.node(env).segs[0]
        return V("node", None, True, segs=[Seg(s.chain[:1], None, F.array(up_to(s.col, 0, F.slice(s.col["k"], 1, 0))))])

    def node(self, env: Env) -> V:
        if env.ctx is None or env.ctx.segs is None:
            raise PathError("a step needs a context node")
        return env.ctx

    def c_step(self, e, env):
        _, name, test, preds = e
        s = self.node(env).segs[0]
        segs = axis(s, s.col, name, test)
        if name.startswith("ancestor") and preds and preds[0][:2] == ("lit", "integer"):
            segs, preds = segs[preds[0][2] - 1 : preds[0][2]], preds[1:]
        if not segs:
            return EMPTY
        back = backwards if name.startswith(("ancestor", "preceding", "parent")) else None
        v = self.filtered(V("node", None, True, segs=[replace(g, key=back) for g in segs]), preds, env)
        return v if v.t == "empty" else replace(v, segs=[replace(g, key=None) for g in v.segs])

    def filtered(self, v: V, preds: list[tuple], env: Env) -> V:
        for p in preds:
            if v.t == "empty":
                return EMPTY
            if v.segs is not None:
                if len(v.segs) > 1 and any(self.positional(p, member(s, _probe()), env) for s in v.segs):
                    v = self.filtered_places(v, p, env)
                    continue
                v = V("node", None, True, segs=[replace(s, col=self.keep(s.col if v.many else listed(s.col), lambda x, s=s: member(s, x), p, env)) for s in v.segs])
            else:
                v = V(v.t, self.keep(arr(v), lambda x, v=v: V(v.t, x, elem=v.elem), p, env), True, elem=v.elem)
        return v

    def positional(self, p: tuple, item: V, env: Env) -> bool:
        return calls(p, "position", "last") or self.c(p, replace(env, ctx=item, pos=F.lit(1), last=F.lit(1))).t in NUMERIC

    def test(self, p: tuple, item: V, at: Column, last: Column, env: Env) -> Column:
        r = self.c(p, replace(env, ctx=item, pos=at, last=last))
        return F.coalesce(at == one(r), F.lit(False)) if r.t in NUMERIC and not r.many else self.ebv(r)

    def keep(self, col: Column, item, p: tuple, env: Env) -> Column:
        if not calls(p, "last"):
            return F.filter(col, lambda x, i: self.test(p, item(x), (i + 1).cast("long"), F.lit(1), env))
        return let(col, lambda c: F.filter(c, lambda x, i: self.test(p, item(x), (i + 1).cast("long"), F.size(c).cast("long"), env)))

    def filtered_places(self, v: V, p: tuple, env: Env) -> V:
        """A predicate that counts positions among nodes of several places of the model."""

        def of(n: int, s: Seg) -> Column:
            fits = lambda nodes, tags: F.filter(
                F.transform(tags, lambda t, i: F.when((t["s"] == n) & self.test(p, member(s, nodes(n, t["i"])), (i + 1).cast("long"), F.size(tags).cast("long"), env), nodes(n, t["i"]).withField("o", s.order(nodes(n, t["i"]), t["i"])))),
                lambda x: x.isNotNull(),
            )
            return self.merged(v, fits)

        return V("node", None, True, segs=[Seg(s.chain, s.leaf, of(n, s), lambda x, i: x["o"]) for n, s in enumerate(v.segs)])

    def c_path(self, e, env):
        _, op, left, right = e
        v = self.c(left, env)
        if v.t == "empty":
            return EMPTY
        if v.segs is None:
            raise PathError("a step from an atomic value")
        if op == "//":
            if right[0] == "step" and right[1] == "child" and not right[3]:
                right = ("step", "descendant", right[2], right[3])
            else:
                v = self.sorted(self.over(v, lambda x, i, n: self.c(("step", "descendant-or-self", ("kind", "node", None), []), replace(env, ctx=x)), True))
        out = self.over(v, lambda x, i, n: self.c(right, replace(env, ctx=x, pos=i, last=n)), True)
        # one place, in order, without repeats
        simple = out.segs is not None and len(v.segs) == 1 and right[0] == "step" and (right[1] in ("child", "flag", "self") or right[1] == "descendant" and left[0] == "root")
        return out if out.segs is None or simple else self.sorted(out)

    def c_map(self, e, env):
        return self.over(self.c(e[1], env), lambda x, i, n: self.c(e[2], replace(env, ctx=x, pos=i, last=n)))

    def c_filter(self, e, env):
        return self.filtered(self.c(e[1], env), e[2], env)

    def c_for(self, e, env):
        (name, source), *rest = e[1]
        body = ("for", rest, e[2]) if rest else e[2]
        return self.over(self.c(source, env), lambda x, i, n: self.c(body, env.bind(name, x)))

    def c_let(self, e, env):
        for name, source in e[1]:
            env = env.bind(name, self.c(source, env))
        return self.c(e[2], env)

    def quantified(self, e, env, fold):
        (name, source), *rest = e[1]
        body = (e[0], rest, e[2]) if rest else e[2]
        v = self.c(source, env)
        test = lambda item: (one(self.c(body, env.bind(name, item))) if rest else self.ebv(self.c(body, env.bind(name, item))))
        if v.t == "empty":
            return [F.lit(e[0] == "every")]
        if v.segs is not None:
            return [fold(s.col if v.many else listed(s.col), lambda x: test(member(s, x))) for s in v.segs]
        return [fold(arr(v), lambda x: test(V(v.t, x, elem=v.elem)))]

    def c_some(self, e, env):
        out = self.quantified(e, env, F.exists)
        return V("boolean", F.coalesce(F.greatest(*out) if len(out) > 1 else out[0], F.lit(False)))

    def c_every(self, e, env):
        out = self.quantified(e, env, F.forall)
        return V("boolean", F.coalesce(F.least(*out) if len(out) > 1 else out[0], F.lit(True)))

    def c_if(self, e, env):
        test, a, b = self.ebv(self.c(e[1], env)), self.c(e[2], env), self.c(e[3], env)
        if a.segs is not None and b.segs is not None or a.segs is not None and b.t == "empty" or b.segs is not None and a.t == "empty":
            pick = lambda v, c: [replace(s, col=F.filter(s.col if v.many else listed(s.col), lambda x: c)) for s in v.segs or []]
            return V("node", None, True, segs=pick(a, test) + pick(b, ~test))  # one of them is empty
        a, b = self.atoms(a), self.atoms(b)
        if a.t == b.t == "empty":
            return EMPTY
        if a.t != b.t and "empty" not in (a.t, b.t):
            t = next((k for k in ("double", "decimal", "integer") if k in (a.t, b.t)), "string") if {a.t, b.t} <= set(NUMERIC) else "string"
            a, b = self.cast_all(a, t), self.cast_all(b, t)
        t = b.t if a.t == "empty" else a.t
        if a.many or b.many:
            return V(t, F.when(test, arr(a) if a.t != "empty" else none_of(t)).otherwise(arr(b) if b.t != "empty" else none_of(t)), True)
        col = lambda v: v.col if v.t != "empty" else F.lit(None).cast(DDL[t])
        return V(t, F.when(test, col(a)).otherwise(col(b)), elem=a.elem or b.elem)

    def c_or(self, e, env):
        return V("boolean", self.ebv(self.c(e[1], env)) | self.ebv(self.c(e[2], env)))

    def c_and(self, e, env):
        return V("boolean", self.ebv(self.c(e[1], env)) & self.ebv(self.c(e[2], env)))

    def compared(self, op: str, t: str, a: Column, u: str, b: Column) -> Column:
        """One pair: numbers as numbers, points in time as instants, else strings; strings that both parse as numbers as numbers."""
        do = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
        if t in NUMERIC and u in NUMERIC or t == u == "boolean":
            return do(a, b)
        if t == u and t in ("date", "dateTime", "time", "duration", "dayTimeDuration"):
            return do(instant(t, a), instant(u, b))
        x, y = (number(k, c if k in NUMERIC else text(k, c)) for k, c in ((t, a), (u, b)))
        return F.when(x.isNotNull() & y.isNotNull(), do(x, y)).otherwise(do(text(t, a), text(u, b)))

    def c_general(self, e, env):
        a, b = self.atoms(self.c(e[2], env)), self.atoms(self.c(e[3], env))
        if "empty" in (a.t, b.t):
            return V("boolean", F.lit(False))
        pair = lambda x, y: F.coalesce(self.compared(e[1], a.t, x, b.t, y), F.lit(False))
        if a.many and b.many:
            return V("boolean", F.exists(a.col, lambda x: F.exists(b.col, lambda y: pair(x, y))))
        if a.many:
            return V("boolean", F.exists(a.col, lambda x: pair(x, b.col)))
        return V("boolean", F.exists(b.col, lambda y: pair(a.col, y)) if b.many else pair(a.col, b.col))

    def c_value(self, e, env):
        a, b = self.atoms(self.c(e[2], env)), self.atoms(self.c(e[3], env))
        if "empty" in (a.t, b.t):
            return V("boolean", F.lit(False))
        single = (count(a) == 1) & (count(b) == 1)
        return V("boolean", F.coalesce(single & self.compared(e[1], a.t, one(a), b.t, one(b)), F.lit(False)))

    def c_order(self, e, env):
        a, b = self.c(e[2], env), self.c(e[3], env)
        if a.segs is None or b.segs is None:
            raise PathError("nodes are needed to compare their order")
        key = lambda v: F.get(F.concat(*(F.transform(s.col if v.many else listed(s.col), lambda x: x["k"]) for s in v.segs)), 0)
        x, y = key(a), key(b)
        return V("boolean", {"is": x == y, "<<": x < y, ">>": x > y}[e[1]])

    def arithmetic(self, e, env):
        op, a, b = e[0], self.numeric(self.c(e[1], env)), self.numeric(self.c(e[2], env))
        if "empty" in (a.t, b.t):
            return EMPTY
        x, y, kinds = one(a), one(b), {a.t, b.t}
        t = "double" if "double" in kinds else "decimal" if "decimal" in kinds else "integer"
        if op == "div":
            return V("double" if t == "double" else "decimal", x.cast("double") / y.cast("double") if t == "double" else x.cast("decimal(38,10)") / y.cast("decimal(38,10)"))
        if op == "idiv":
            q = x.cast("decimal(38,10)") / y.cast("decimal(38,10)") if t != "integer" else None
            return V("integer", F.call_function("div", x, y) if q is None else q.cast("bigint"))
        if t == "double":
            x, y = x.cast("double"), y.cast("double")
        return V(t, {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "mod": lambda: x % y}[op]())

    def c_neg(self, e, env):
        v = self.numeric(self.c(e[1], env))
        return v if v.t == "empty" else V(v.t, -one(v))

    def c_pos(self, e, env):
        return self.c(e[1], env)

    def c_concat(self, e, env):
        part = lambda x: F.coalesce(one(self.strings(self.c(x, env))), F.lit(""))
        return V("string", F.concat(part(e[1]), part(e[2])))

    def c_to(self, e, env):
        a, b = (self.numeric(self.c(x, env)) for x in e[1:])
        if "empty" in (a.t, b.t):
            return EMPTY
        x, y = one(a).cast("bigint"), one(b).cast("bigint")
        return V("integer", F.when(x <= y, F.sequence(x, y)).otherwise(none_of("integer")), True)

    def c_union(self, e, env):
        v = self.join([self.c(e[1], env), self.c(e[2], env)])
        if v.t == "empty":
            return v
        return self.sorted(v) if v.segs is not None else V(v.t, F.array_distinct(arr(v)), True)

    def within(self, e, env, keep: bool):
        a, b = self.c(e[1], env), self.c(e[2], env)
        if a.t == "empty" or b.t == "empty":
            return a if not keep else EMPTY
        if a.segs is not None and b.segs is not None:
            keys = F.concat(*(F.transform(s.col if b.many else listed(s.col), lambda x: x["k"]) for s in b.segs))
            test = lambda x: F.exists(keys, lambda k: k == x["k"])
            return self.sorted(V("node", None, True, segs=[Seg(s.chain, s.leaf, F.filter(s.col if a.many else listed(s.col), lambda x: test(x) if keep else ~test(x))) for s in a.segs]))
        a, right = self.atoms(a), arr(self.strings(b))
        test = lambda x: F.array_contains(right, text(a.t, x))
        return V(a.t, F.filter(arr(a), lambda x: test(x) if keep else ~test(x)), True)

    def c_intersect(self, e, env):
        return self.within(e, env, True)

    def c_except(self, e, env):
        return self.within(e, env, False)

    # types

    def c_cast(self, e, env):
        v = self.atoms(self.c(e[1], env))
        return EMPTY if v.t == "empty" else self.cast(v, e[2][0])

    def cast(self, v: V, name: str, strict: bool = True) -> V:
        from ..functions.datatypes import ITEM_TYPE, parsed

        name = name.split(":")[-1]
        if name not in ITEM_TYPE:
            raise PathError(f"unknown type {name}")
        t, x = ITEM_TYPE[name], one(v)
        if v.t in NUMERIC and t in NUMERIC:
            out = x.try_cast(DDL[t])
        elif t == "string" and name in ("string", "anyAtomicType"):
            out = text(v.t, x)
        elif v.t in NUMERIC and t == "boolean":
            out = x != 0
        else:
            out = parsed(name, text(v.t, x))
        if strict:
            out = F.when(x.isNotNull() & out.isNull(), F.raise_error(F.lit(f"not a {name}")).cast(DDL[t])).otherwise(out)
        return V(t, out)

    def c_castable(self, e, env):
        v = self.atoms(self.c(e[1], env))
        if v.t == "empty":
            return V("boolean", F.lit(e[2][1] == "?"))
        n = count(v)
        ok = (n == 1) & one(self.cast(v, e[2][0], strict=False)).isNotNull()
        return V("boolean", ok | ((n == 0) & F.lit(e[2][1] == "?")))

    def fits(self, v: V, name: str, many: str) -> Column:
        n, name = count(v), name.split(":")[-1]
        size = {"": n == 1, "?": n <= 1, "+": n >= 1, "*": F.lit(True)}[many]
        if name == "empty-sequence()":
            return n == 0
        kinds = {s.kind for s in v.segs} if v.segs is not None else {v.t}
        wide = {"item()": None, "anyAtomicType": set(DDL) - {"empty"}, "node()": {"document", "assembly", "field", "flag"}, "document-node()": {"document"}, "decimal": {"decimal", "integer"}, "numeric": set(NUMERIC), "map()": {"map"}, "array()": {"array"}, "function()": {"function"}}
        want = wide.get(name, {name.removesuffix("()")})
        return size & (F.lit(want is None or kinds <= want) | (n == 0))

    def c_instance(self, e, env):
        return V("boolean", self.fits(self.c(e[1], env), *e[2]))

    def c_treat(self, e, env):
        v = self.c(e[1], env)
        ok = self.fits(v, *e[2])
        if v.segs is not None or v.t == "empty":
            return v
        return replace(v, col=F.when(ok, v.col).otherwise(F.raise_error(F.lit(f"not a {e[2][0]}"))))

    # arrays, maps, functions

    def items(self, parts: list[V]) -> V:
        v = self.join([replace(p, segs=None) if p.segs is None else self.atoms(p) for p in parts])
        return V("array", arr(v), elem=v.t)

    def c_array(self, e, env):
        return self.items([self.c(x, env) for x in e[1]])

    def c_curly(self, e, env):
        return self.items([self.c(e[1], env)])

    def c_mapcon(self, e, env):
        pairs = [(one(self.strings(self.c(k, env))), self.atoms(self.c(v, env))) for k, v in e[1]]
        if not pairs:
            return V("map", F.create_map().cast("map<string,string>"), elem="string")
        kinds = {v.t for _, v in pairs} - {"empty"}
        t = kinds.pop() if len(kinds) == 1 else "string"
        cell = lambda v: F.lit(None).cast(DDL.get(t, "string")) if v.t == "empty" else one(v) if v.t == t else text(v.t, one(v))
        return V("map", F.create_map(*(x for k, v in pairs for x in (k, cell(v)))), elem=t)

    def c_lookup(self, e, env):
        v = self.c(e[1], env)
        if v.t not in ("array", "map"):
            return EMPTY
        if e[2] is None:
            return V(v.elem, one(v) if v.t == "array" else F.map_values(one(v)), True)
        k = self.c(e[2], env)
        return V(v.elem, F.try_element_at(one(v), one(k).cast("int") if v.t == "array" else one(self.strings(k))))

    def c_function(self, e, env):
        return V("function", fn=lambda args: self.c(e[2], replace(env, vars=env.vars | dict(zip(e[1], args, strict=True)))))

    def c_ref(self, e, env):
        return V("function", fn=lambda args: self.call(e[1], args, env))

    def c_dynamic(self, e, env):
        f = self.c(e[1], env)
        args = [self.c(a, env) for a in e[2]]
        if f.t in ("array", "map"):
            return V(f.elem, F.try_element_at(one(f), one(args[0]).cast("int") if f.t == "array" else one(self.strings(args[0]))))
        if f.fn is None:
            raise PathError("not a function")
        return f.fn(args)

    def c_call(self, e, env):
        return self.call(e[1], [self.c(a, env) for a in e[2]], env)

    def call(self, name: str, args: list[V], env: Env) -> V:
        prefix, _, local = name.rpartition(":")
        key = local if prefix in ("", "fn") or prefix == "mp" and f"mp:{local}" not in self.functions else name
        if prefix == "xs" and len(args) == 1:
            v = self.atoms(args[0])
            return EMPTY if v.t == "empty" else self.cast(v, local)
        found = self.functions.get(f"{key}#{len(args)}") or self.functions.get(key)
        if not found:
            if any(f.startswith(f"{key}#") for f in self.functions):
                raise PathError(f"{name} does not take {len(args)} arguments")
            raise PathError(f"unknown function {name}")
        least, most, build = found
        if not least <= len(args) <= most:
            raise PathError(f"{name} does not take {len(args)} arguments")
        return build(self, args, env)


_METHODS = {"||": "concat", "+": "arith", "-": "arith", "*": "arith", "div": "arith", "idiv": "arith", "mod": "arith"}
Compiler.c_arith = Compiler.arithmetic
