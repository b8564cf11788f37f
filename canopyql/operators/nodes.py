"""The node table: one row per document, assembly and field node in pre-order (pre, size), for axes as joins and for generic queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..engine import Documents
from ..plans.compiler import Env, member
from ..plans.model import listed, one


def node_rows(docs: Documents) -> DataFrame:
    """Keys, pre, size, level, parent_pre, sib_ord, kind, name, path, value and flags. One shuffle, by document."""
    c = docs.engine.compiler()
    v = c.compile(("path", "/", ("root",), ("step", "descendant-or-self", ("kind", "node", None), [])), Env(ctx=docs.context()))
    out = None
    for s in v.segs:
        rows = docs.df.select(*docs.keys, F.explode(s.col if v.many else listed(s.col)).alias("x"))
        own = member(s, F.col("x"))
        flags = F.create_map(*(e for n, (t, f) in s.chain[-1].flags.items() for e in (F.lit(n), one(c.strings(c.compile(("step", "flag", ("name", n), []), Env(ctx=own))))))) if s.chain[-1].flags else F.create_map().cast("map<string,string>")
        part = rows.select(*docs.keys, F.col("x.k").alias("k"), F.lit(s.chain[-1].kind).alias("kind"), F.lit(s.chain[-1].name).alias("name"), F.lit("/" + "/".join(n.name for n in s.chain)).alias("path"), one(c.strings(own)).alias("value"), flags.alias("flags"))
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy(*docs.keys)
    out = out.withColumn("pre", F.row_number().over(w.orderBy("k")).cast("long") - 1).withColumn("level", F.floor(F.size("k") / 2).cast("long"))
    # the next node in pre-order that isn't deeper ends a subtree: a running minimum from the last node up, for each level of the model
    up = w.orderBy(F.desc("pre")).rowsBetween(Window.unboundedPreceding, -1)
    depth = max(len(s.chain) for s in v.segs)
    size = F.lit(None).cast("long")
    for n in range(depth):
        end = F.coalesce(F.min(F.when(F.col("level") <= n, F.col("pre"))).over(up), F.count("*").over(w))
        size = F.when(F.col("level") == n, end - F.col("pre") - 1).otherwise(size)
    parent = F.lit(None).cast("long")
    for n in range(1, depth):
        above = F.max(F.when(F.col("level") == n - 1, F.col("pre"))).over(w.orderBy("pre").rowsBetween(Window.unboundedPreceding, -1))
        parent = F.when(F.col("level") == n, above).otherwise(parent)
    return out.withColumns({"size": size, "parent_pre": parent, "sib_ord": F.coalesce(F.try_element_at("k", F.lit(-1)), F.lit(1))}).drop("k")


def descendants(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (ancestor pre, descendant pre): an equi-join on the document with a range on pre and size."""
    a, d = nodes.select(*keys, F.col("pre").alias("a_pre"), F.col("size").alias("a_size")), nodes.select(*keys, F.col("pre").alias("d_pre"))
    return a.join(d, keys).filter((F.col("d_pre") > F.col("a_pre")) & (F.col("d_pre") <= F.col("a_pre") + F.col("a_size"))).drop("a_size")
