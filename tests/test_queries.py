"""Every query with an oracle against DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from canopyql import queries as core

DIR = "/root/testdata/sf0.001"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple(map(str, r)))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query(spark, duck, name):
    df = core.QUERIES[name](spark, DIR)
    want = duck.sql(core.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())


def test_axes_part_the_tree(spark):
    """self + ancestors + descendants + preceding + following are all nodes."""
    from canopyql.engine import Engine
    from canopyql.sources import tables

    docs = tables.conversations(Engine(spark), DIR)
    sizes = docs.eval("turn[2] ! (count(self::node()) + count(ancestor::node()) + count(descendant::node()) + count(preceding::node()) + count(following::node()))")
    every = {r.conv_id: r.value for r in docs.eval("count(turn) + 2").collect()}
    assert all(r.value == every[r.conv_id] for r in sizes.collect()) and sizes.count() > 0


def test_subtrees_nest(spark):
    from canopyql.engine import Engine
    from canopyql.operators.nodes import descendants, node_rows
    from canopyql.sources import tables

    nodes = node_rows(tables.conversations(Engine(spark), DIR))
    assert descendants(nodes, ["conv_id"]).count() == nodes.agg({"size": "sum"}).first()[0]
