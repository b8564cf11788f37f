"""Relational tables viewed as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Documents, Engine
from ..plans.model import Child, NodeType, or_none

LINE = NodeType("line", "assembly", {
    "linenumber": ("integer", "linenumber"), "partkey": ("integer", "partkey"), "suppkey": ("integer", "suppkey"), "quantity": ("double", "quantity"), "extendedprice": ("double", "extendedprice"),
    "discount": ("double", "discount"), "tax": ("double", "tax"), "returnflag": ("string", "returnflag"), "linestatus": ("string", "linestatus"), "shipdate": ("dateTime", "shipdate"),
})
ORDER = NodeType("order", "assembly", {
    "orderkey": ("integer", "orderkey"), "orderstatus": ("string", "orderstatus"), "totalprice": ("double", "totalprice"), "orderdate": ("dateTime", "orderdate"), "priority": ("string", "priority"),
}, [Child(LINE, "lines")])
CUSTOMER = NodeType("customer", "assembly", {
    "custkey": ("integer", "custkey"), "name": ("string", "name"), "nation": ("integer", "nation"), "segment": ("string", "segment"), "acctbal": ("double", "acctbal"),
}, [Child(ORDER, "orders")])
TURN = NodeType("turn", "field", {"turn": ("integer", "turn"), "role": ("string", "role")}, value=("string", "text"))
CONVERSATION = NodeType("conversation", "assembly", {"conv_id": ("integer", "conv_id")}, [Child(TURN, "turns")])
PROPS = NodeType("props", "assembly", {"k": ("integer", "k")})
EVENT = NodeType("event", "assembly", {"ts": ("dateTime", "ts"), "user": ("integer", "user"), "type": ("string", "type"), "value": ("double", "value")}, [Child(PROPS, "props", many=False)])
DOC = NodeType("doc", "field", {"id": ("integer", "id"), "lang": ("string", "lang"), "source": ("string", "source"), "n-chars": ("integer", "n_chars")}, value=("string", "text"))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _moment(c: str):
    return F.struct(F.col(c).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("int").alias("tz"))


def ordered(df: DataFrame, by: str, item, name: str) -> DataFrame:
    """One row per key with its items as a sorted array; the order is that of the struct's fields."""
    return df.groupBy(by).agg(F.sort_array(F.collect_list(item)).alias(name))


def _only(node: NodeType, flags: set[str] | None) -> NodeType:
    """The node type with some of its flags; None keeps all."""
    keep = {n: x for n, x in node.flags.items() if flags is None or n in flags}
    return NodeType(node.name, node.kind, keep, [Child(_only(c.node, flags), c.field, c.many) for c in node.children], node.value)


def _struct(node: NodeType, columns: dict, *more):
    """The flags of a node as a struct of columns, in the node's order."""
    return F.struct(*(columns[f].alias(f) for _, f in node.flags.values()), *more) if node.flags or more else F.struct(F.lit(1).alias("__"))


def _order_columns(eng: Engine, sf_dir: str, node: NodeType) -> tuple[DataFrame, dict]:
    """Orders with their lines. Only the columns of the flags that are kept are read."""
    line = node.children[0].node
    columns = {n: F.col(f"l_{n}") for n in ("linenumber", "partkey", "suppkey", "quantity", "extendedprice", "discount", "tax", "returnflag", "linestatus")} | {"shipdate": _moment("l_shipdate")}
    lines = ordered(_read(eng.spark, sf_dir, "lineitem").select("l_orderkey", _struct(line, columns).alias("x")), "l_orderkey", F.col("x"), "lines")
    df = _read(eng.spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return df, {"orderkey": F.col("o_orderkey"), "orderstatus": F.col("o_orderstatus"), "totalprice": F.col("o_totalprice"), "orderdate": _moment("o_orderdate"), "priority": F.col("o_orderpriority")}


def customers(eng: Engine, sf_dir: str, flags: set[str] | None = None) -> Documents:
    """View T: customer > order > line. Two shuffles, on the order key and on the customer key.

    flags: only these are read; lines that agree in all kept flags then have no order of their own."""
    node = _only(CUSTOMER, flags)
    order = node.children[0].node
    order.flags.setdefault("orderkey", ORDER.flags["orderkey"])
    order.flags = {n: order.flags[n] for n in ORDER.flags if n in order.flags}
    o, columns = _order_columns(eng, sf_dir, order)
    orders = ordered(o.select("o_custkey", _struct(order, columns, or_none("lines").alias("lines")).alias("x")), "o_custkey", F.col("x"), "orders")
    c = _read(eng.spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    own = {"custkey": F.col("c_custkey"), "name": F.col("c_name"), "nation": F.col("c_nationkey"), "segment": F.col("c_mktsegment"), "acctbal": F.col("c_acctbal")}
    return eng.docs(c.select("c_custkey", _struct(node, own, or_none("orders").alias("orders")).alias("doc")), ["c_custkey"], node)


def orders(eng: Engine, sf_dir: str, flags: set[str] | None = None) -> Documents:
    """Orders as documents of their own: order > line. flags as for customers."""
    node = _only(ORDER, flags)
    o, columns = _order_columns(eng, sf_dir, node)
    return eng.docs(o.select("o_orderkey", _struct(node, columns, or_none("lines").alias("lines")).alias("doc")), ["o_orderkey"], node)


def conversations(eng: Engine, sf_dir: str) -> Documents:
    """View C: conversation > turn."""
    t = _read(eng.spark, sf_dir, "conversations")
    turns = ordered(t.select("conv_id", F.struct("turn", "role", "text").alias("x")), "conv_id", F.col("x"), "turns")
    return eng.docs(turns.select("conv_id", F.struct("conv_id", "turns").alias("doc")), ["conv_id"], CONVERSATION)


def events(eng: Engine, sf_dir: str) -> Documents:
    """View E: event > props, parsed from JSON."""
    e = _read(eng.spark, sf_dir, "events")
    doc = F.struct(_moment("ts").alias("ts"), F.col("user_id").alias("user"), F.col("event_type").alias("type"), "value", F.from_json("props", "k bigint").alias("props"))
    return eng.docs(e.select("event_id", doc.alias("doc")), ["event_id"], EVENT)


def texts(eng: Engine, sf_dir: str) -> Documents:
    """View D: one field per document."""
    d = _read(eng.spark, sf_dir, "documents")
    return eng.docs(d.select("doc_id", F.struct(F.col("doc_id").alias("id"), "lang", "source", "n_chars", "text").alias("doc")), ["doc_id"], DOC)


def scalars(eng: Engine, df: DataFrame, key: str, **fields: tuple[str, str]) -> Documents:
    """Rows as documents without children: flag = (item type, column)."""
    node = NodeType("row", "assembly", {n: (t, n) for n, (t, _) in fields.items()})
    return eng.docs(df.select(key, F.struct(*(F.col(c).alias(n) for n, (_, c) in fields.items())).alias("doc")), [key], node)
