"""Hand-written lexer and recursive-descent parser of the path language: text to tuples (kind, ...)."""

from __future__ import annotations

import re


class PathSyntaxError(ValueError):
    """The text isn't an expression."""


_NAME = r"[^\W\d][\w\-.·]*"
_LEX = re.compile(
    rf"""(?P<space>\s+)|(?P<comment>\(:)|(?P<double>(?:\d+\.?\d*|\.\d+)[eE][+-]?\d+)|(?P<decimal>\d+\.\d*|\.\d+)|(?P<integer>\d+)
    |(?P<string>"(?:[^"]|"")*"|'(?:[^']|'')*')|(?P<uriname>Q\{{[^{{}}]*\}}(?:\*|{_NAME}))
    |(?P<name>{_NAME}(?::(?:\*|{_NAME})(?!:))?|\*:{_NAME})
    |(?P<op>::|//|!=|<=|>=|<<|>>|=>|\|\||:=|\.\.|[/()\[\]{{}},.@$|+\-*=<>!?#:])""",
    re.X,
)
AXES = frozenset("child descendant descendant-or-self self flag attribute parent ancestor ancestor-or-self following following-sibling preceding preceding-sibling".split())
KINDS = frozenset(["node", "document-node", "field", "assembly", "flag"])
#: Names that never start a function call.
RESERVED = KINDS | frozenset("if switch typeswitch item empty-sequence function map array".split())
_VALUE = {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise PathSyntaxError(f"unexpected {text[at]!r} at {at}")
        kind, at = m.lastgroup, m.end()
        if kind == "comment":
            depth = 1
            while depth:
                n = re.compile(r"\(:|:\)").search(text, at)
                if not n:
                    raise PathSyntaxError("unclosed comment")
                depth, at = depth + (1 if n[0] == "(:" else -1), n.end()
        elif kind != "space":
            out.append((kind, m[0]))
    return [*out, ("end", "")]


class Parser:
    def __init__(self, text: str):
        if not text or not text.strip():
            raise PathSyntaxError("empty expression")
        self.t, self.i = tokens(text), 0

    def peek(self, n: int = 0) -> str:
        return self.t[min(self.i + n, len(self.t) - 1)][1]

    def kind(self, n: int = 0) -> str:
        return self.t[min(self.i + n, len(self.t) - 1)][0]

    def take(self, *want: str) -> str | None:
        if self.kind() in ("op", "name") and self.peek() in want:
            self.i += 1
            return self.t[self.i - 1][1]
        return None

    def need(self, what: str) -> None:
        if not self.take(what):
            raise PathSyntaxError(f"expected {what!r}, found {self.peek()!r}")

    def name(self) -> str:
        if self.kind() not in ("name", "uriname"):
            raise PathSyntaxError(f"expected a name, found {self.peek()!r}")
        self.i += 1
        return self.t[self.i - 1][1]

    def whole(self) -> tuple:
        e = self.expr()
        if self.kind() != "end":
            raise PathSyntaxError(f"unexpected {self.peek()!r}")
        return e

    def expr(self) -> tuple:
        parts = [self.single()]
        while self.take(","):
            parts.append(self.single())
        return parts[0] if len(parts) == 1 else ("seq", parts)

    def bindings(self, sep: str) -> list[tuple[str, tuple]]:
        out = []
        while True:
            self.need("$")
            n = self.name()
            self.need(sep)
            out.append((n, self.single()))
            if not self.take(","):
                return out

    def single(self) -> tuple:
        word, nxt = self.peek(), self.peek(1)
        if self.kind() == "name" and nxt == "$" and word in ("for", "let", "some", "every"):
            self.i += 1
            b = self.bindings(":=" if word == "let" else "in")
            self.need("satisfies" if word in ("some", "every") else "return")
            return (word, b, self.single())
        if self.kind() == "name" and word == "if" and nxt == "(":
            self.i += 2
            c = self.expr()
            self.need(")")
            self.need("then")
            a = self.single()
            self.need("else")
            return ("if", c, a, self.single())
        return self.binary(0)

    LEVELS = (("or",), ("and",), ("=", "!=", "<", "<=", ">", ">=", *_VALUE, "is", "<<", ">>"), ("||",), ("to",), ("+", "-"), ("*", "div", "idiv", "mod"), ("union", "|"), ("intersect", "except"))

    def binary(self, level: int) -> tuple:
        if level == len(self.LEVELS):
            return self.typed()
        left = self.binary(level + 1)
        while op := self.take(*self.LEVELS[level]):
            right = self.binary(level + 1)
            if op in _VALUE:
                left = ("value", _VALUE[op], left, right)
            elif level == 2:
                left = ("general" if op not in ("is", "<<", ">>") else "order", op, left, right)
            else:
                left = ({"|": "union"}.get(op, op), left, right)
            if level in (2, 4):
                break
        return left

    def typed(self) -> tuple:
        e = self.arrow()
        for words, kind in ((("cast", "as"), "cast"), (("castable", "as"), "castable"), (("treat", "as"), "treat"), (("instance", "of"), "instance")):
            if self.kind() == "name" and (self.peek(), self.peek(1)) == words:
                self.i += 2
                e = (kind, e, self.sequence_type())
        return e

    def sequence_type(self) -> tuple[str, str]:
        n = self.name()
        if self.take("("):
            depth = 1
            while depth:
                if self.kind() == "end":
                    raise PathSyntaxError("unclosed type")
                depth += {"(": 1, ")": -1}.get(self.peek(), 0)
                self.i += 1
            n += "()"
        return n, self.take("?", "*", "+") or ""

    def arrow(self) -> tuple:
        e = self.unary()
        while self.take("=>"):
            n = self.name() if not self.take("$") else "$" + self.name()
            args = self.arguments()
            e = ("dynamic", ("var", n[1:]), [e, *args]) if n[0] == "$" else ("call", n, [e, *args])
        return e

    def arguments(self) -> list[tuple]:
        self.need("(")
        out = []
        if not self.take(")"):
            out.append(self.single())
            while self.take(","):
                out.append(self.single())
            self.need(")")
        return out

    def unary(self) -> tuple:
        if op := self.take("-", "+"):
            return ("neg", self.unary()) if op == "-" else ("pos", self.unary())
        e = self.path()
        while self.take("!"):
            e = ("map", e, self.path())
        return e

    def starts_step(self) -> bool:
        return self.kind() in ("name", "uriname", "integer", "decimal", "double", "string") or self.peek() in (".", "..", "@", "(", "$", "*", "[", "?")

    def path(self) -> tuple:
        if op := self.take("/", "//"):
            e = ("root",)
            if not self.starts_step():
                if op == "//":
                    raise PathSyntaxError("a step must follow //")
                return e
            e = ("path", op, e, self.step())
        else:
            e = self.step()
        while op := self.take("/", "//"):
            e = ("path", op, e, self.step())
        return e

    def predicates(self) -> list[tuple]:
        out = []
        while self.take("["):
            out.append(self.expr())
            self.need("]")
        return out

    def test(self) -> tuple:
        if self.take("*"):
            return ("name", "*")
        n = self.name()
        if n in KINDS and self.take("("):
            arg = None
            if not self.take(")"):
                arg = "*" if self.take("*") else self.name()
                if self.take(","):
                    self.name()
                self.need(")")
            return ("kind", n, arg)
        return ("name", n)

    def step(self) -> tuple:
        if self.take(".."):
            return ("step", "parent", ("kind", "node", None), self.predicates())
        if self.take("@"):
            return ("step", "flag", self.test(), self.predicates())
        if self.kind() == "name" and self.peek(1) == "::" and self.peek() in AXES:
            axis = self.name()
            self.i += 1
            return ("step", {"attribute": "flag"}.get(axis, axis), self.test(), self.predicates())
        is_call = self.kind() == "name" and self.peek(1) in ("(", "#") and self.peek() not in RESERVED
        opens = self.kind() == "name" and (self.peek(), self.peek(1)) in (("map", "{"), ("array", "{"), ("function", "("))
        if (self.kind() in ("name", "uriname") or self.peek() == "*") and not is_call and not opens:
            test = self.test()
            axis = "flag" if test[0] == "kind" and test[1] == "flag" else "child"
            return ("step", axis, test, self.predicates())
        return self.postfix()

    def postfix(self) -> tuple:
        e = self.primary()
        while True:
            if self.peek() == "[" and self.kind() == "op":
                e = ("filter", e, self.predicates())
            elif self.peek() == "(" and self.kind() == "op":
                e = ("dynamic", e, self.arguments())
            elif self.take("?"):
                e = ("lookup", e, self.key())
            else:
                return e

    def key(self) -> tuple | None:
        if self.take("*"):
            return None
        if self.kind() == "integer":
            self.i += 1
            return ("lit", "integer", int(self.t[self.i - 1][1]))
        if self.take("("):
            e = self.expr()
            self.need(")")
            return e
        return ("lit", "string", self.name())

    def primary(self) -> tuple:
        kind, text = self.t[self.i]
        if kind in ("integer", "decimal", "double"):
            self.i += 1
            if kind == "integer" and int(text) >= 1 << 63:
                return ("seq", [])
            return ("lit", kind, {"integer": int, "decimal": str, "double": float}[kind](text))
        if kind == "string":
            self.i += 1
            return ("lit", "string", text[1:-1].replace('""', '"').replace("''", "'"))
        if self.take("."):
            return ("context",)
        if self.take("$"):
            return ("var", self.name())
        if self.take("("):
            if self.take(")"):
                return ("seq", [])
            e = self.expr()
            self.need(")")
            return ("paren", e)
        if self.take("["):
            out = []
            if not self.take("]"):
                out.append(self.single())
                while self.take(","):
                    out.append(self.single())
                self.need("]")
            return ("array", out)
        if self.take("?"):
            return ("lookup", ("context",), self.key())
        if kind == "name" and self.peek(1) == "{" and text in ("map", "array"):
            self.i += 2
            if text == "array":
                e = ("seq", []) if self.peek() == "}" else self.expr()
                self.need("}")
                return ("curly", e)
            out = []
            while not self.take("}"):
                k = self.single()
                self.need(":")
                out.append((k, self.single()))
                if not self.take(","):
                    self.need("}")
                    break
            return ("mapcon", out)
        if kind == "name" and text == "function" and self.peek(1) == "(":
            self.i += 2
            params = []
            while not self.take(")"):
                self.need("$")
                params.append(self.name())
                if self.take("as"):
                    self.sequence_type()
                self.take(",")
            if self.take("as"):
                self.sequence_type()
            self.need("{")
            body = self.expr()
            self.need("}")
            return ("function", params, body)
        if kind == "name" and text not in RESERVED:
            self.i += 1
            if self.take("#"):
                n = self.t[self.i][1]
                self.i += 1
                return ("ref", text, int(n))
            return ("call", text, self.arguments())
        raise PathSyntaxError(f"unexpected {text!r}")


def parse(text: str) -> tuple:
    """The tree of an expression; PathSyntaxError if it isn't one."""
    return Parser(text).whole()


def flags_of(tree: tuple | list) -> set[str] | None:
    """Names of all flags that an expression reads, None if it may read any."""
    out: set[str] = set()
    if isinstance(tree, tuple) and tree[:2] == ("step", "flag"):
        if tree[2][0] != "name" or "*" in tree[2][1]:
            return None
        out.add(tree[2][1])
    if isinstance(tree, tuple) and tree[:2] == ("call", "deep-equal"):
        return None
    for x in tree:
        if isinstance(x, (tuple, list)):
            inner = flags_of(x)
            if inner is None:
                return None
            out |= inner
    return out
