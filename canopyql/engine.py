"""The public interface: compile expressions, evaluate them over documents, validate documents, convert and describe models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.library import FUNCTIONS
from .plans.compiler import Compiler, Env
from .plans.model import NUMERIC, Child, NodeType, PathError, Seg, V, arr, listed, none_of, text
from .plans.parser import parse


@dataclass
class Documents:
    """One row per document: the key columns, and the document as a struct column ``doc`` of the root's node type."""

    df: DataFrame
    keys: list[str]
    root: NodeType
    engine: Engine

    def context(self) -> V:
        """The root assembly, below a document node of the same name."""
        top = NodeType(self.root.name, "document", children=[Child(self.root, "root", many=False)])
        key = F.array(F.lit(1), F.lit(1))
        return V("node", segs=[Seg([top, self.root], None, F.struct(key.alias("k"), F.struct(F.col("doc").alias("root")).alias("n0"), F.col("doc").alias("n1")))])

    def compile(self, expression: str) -> V:
        return self.engine.compiler().compile(expression, Env(ctx=self.context(), vars=self.engine.variables))

    def eval(self, expression: str, name: str = "value") -> DataFrame:
        """Keys, 1-based position and item of each item of the sequence; atomised, in order."""
        c = self.engine.compiler()
        v = c.atoms(self.compile(expression))
        items = c.cast_all(v, "string") if v.t in ("duration", "time", "qname") else v
        return self.df.select(*self.keys, F.posexplode(arr(items)).alias("pos", name)).withColumn("pos", F.col("pos") + 1)

    def eval_single(self, expression: str, name: str = "value") -> DataFrame:
        """Keys and the one item, NULL if there is none; an error if there are several."""
        v = self.engine.compiler().atoms(self.compile(expression))
        col = F.when(F.size(v.col) > 1, F.raise_error(F.lit("several items")).cast("string")).otherwise(F.get(v.col, F.lit(0)).cast("string")) if v.many and v.t in ("string",) else (F.get(v.col, F.lit(0)) if v.many else v.col)
        return self.df.select(*self.keys, col.alias(name))

    def eval_boolean(self, expression: str, name: str = "value") -> DataFrame:
        return self.df.select(*self.keys, self.engine.compiler().ebv(self.compile(expression)).alias(name))

    def paths(self, expression: str) -> DataFrame:
        """Keys and path of each node."""
        v = self.compile(expression)
        out = None
        for s in v.segs or []:
            label = "/" + "/".join([n.name for n in s.chain] + ([s.leaf[0]] if s.leaf else []))
            part = self.df.select(*self.keys, F.explode(F.transform(s.col if v.many else listed(s.col), lambda x: x["k"])).alias("k")).select(*self.keys, F.lit(label).alias("path"))
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.df.select(*self.keys, F.lit(None).cast("string").alias("path")).limit(0)


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark, self.functions, self.variables, self.base_uri = spark, dict(FUNCTIONS), {}, None
        self.documents: list[str] = []

    def compiler(self) -> Compiler:
        c = Compiler(self.functions, self.base_uri)
        c.documents = self.documents
        return c

    def register_function(self, name: str, arity: int, build) -> None:
        """A function of the expression language: build takes string Columns and returns a Column. Other arities of the name stay."""
        self.functions[f"{name}#{arity}"] = (arity, arity, lambda c, args, env: V("string", build(*(F.coalesce(arr(c.strings(a))[0], F.lit("")) if a.many else c.strings(a).col for a in args))))

    def register_sequence_function(self, name: str, arity: int, build, takes: str = "string", gives: str = "string", many: bool = True) -> None:
        """A function of whole sequences: build takes an array Column of `takes` items for each argument and returns an array of `gives` items, or one (many=False).

        An aggregate takes arrays and gives one item; a generator gives an array."""

        def made(c, args, env):
            own = [c.atoms(a) for a in args]
            columns = [none_of(takes) if a.t == "empty" else arr(a if a.t == takes else c.strings(a) if takes == "string" else c.cast_all(a if a.t in NUMERIC else c.numeric(a), takes)) for a in own]
            return V(gives, build(*columns), many)

        self.functions[f"{name}#{arity}"] = (arity, arity, made)

    def check(self, expression: str) -> None:
        """Raises if the text isn't an expression."""
        parse(expression)

    def column(self, expression: str, t: str = "string", context: Column | None = None, /, **variables: Column) -> Column:
        """A Column of an expression over scalar columns: a string, or a pair of item type and Column, for each variable."""
        return self.value(expression, t, context, **variables).col

    def value(self, expression: str, t: str = "string", context: Column | None = None, /, **variables: Column | tuple) -> V:
        bound = {n: V(*(x if isinstance(x, tuple) else ("string", x))) for n, x in variables.items()}
        return self.compiler().atoms(self.compiler().compile(expression, Env(ctx=V(t, context) if context is not None else None, vars=bound)))

    def literal(self, expression: str) -> list[str]:
        """String values of a context-free expression."""
        v = self.value(expression)
        c = self.compiler()
        return self.spark.range(1).select(arr(c.strings(v)).alias("v")).first()[0] if v.t != "empty" else []

    def docs(self, df: DataFrame, keys: list[str], root: NodeType) -> Documents:
        return Documents(df, keys, root, self)


__all__ = ["Documents", "Engine", "PathError", "text"]
