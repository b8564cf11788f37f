"""Connected components of a table of links by alternating large-star and small-star steps (Kiveris et al., SoCC 2014).

Only minima and joins: no neighbour list is ever gathered, so a hub of any degree is a key with a map-side minimum and a
join that AQE may split. Each step's table is written, which cuts the lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links (u, v), u > v. large: seen from both ends, larger neighbours move to the least; else the smaller ones do."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    near = both.join(least, "u")
    if large:
        moved = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(node, component) of every node that has a link; the component is the smallest node reachable."""
    edges = scratch.save(links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).filter("u <> v").distinct())

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())

    before = state(edges)
    for _ in range(most):
        if not before[0]:
            break
        now = scratch.save(_star(_star(edges, True), False))
        scratch.drop(edges)
        edges, after = now, state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return scratch.save(found.unionByName(found.select(F.col("component").alias("node"), "component").distinct()))
