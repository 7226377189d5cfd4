"""Connected components of an edge table by alternating stars, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.llm.common import measured

#: Neighbours from which on a node's least neighbour is broadcast to them instead of meeting them in one task.
HEAVY = 256
#: Heavy nodes (about 50 bytes each) that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point each neighbour at the least one: larger neighbours of every node, or smaller neighbours and the node itself."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    if large:
        near = edges.unionByName(back)
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    least, seen = measured(least.select("a", F.least("a", "m").alias("m"), "n"), "least", heavy=F.count_if(F.col("n") > HEAVY))
    met = _met(near, least, seen["heavy"])
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _met(near: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """``a, b, m``: each neighbour with the least one.  The neighbours of the ``n`` heavy nodes stay where they are."""
    heavy = least.where(F.col("n") > HEAVY).select("a", "m")
    if not 0 < n <= BROADCAST_ROWS:
        return near.join(least.select("a", "m"), "a")
    light = near.join(F.broadcast(heavy.select("a")), "a", "left_anti").join(least.where(F.col("n") <= HEAVY).select("a", "m"), "a")
    return light.unionByName(near.join(F.broadcast(heavy), "a"))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of an edge ``a, b``; the root is the least node of the component.

    Nodes are of any type that has an order.  Least neighbours are found in the map tasks first, and those of nodes
    with very many neighbours are broadcast, so no such node is one task.  Each round is written to the shared folder.
    """
    mark = {"n": F.count("*"), "mark": F.bit_xor(F.xxhash64("a", "b"))}
    edges, seen = measured(edges.select("a", "b").where("a <> b").distinct(), "edges", **mark)
    before = None
    while seen != before and seen["n"]:
        before = seen
        edges, seen = measured(_star(_star(edges, True), False), "edges", **mark)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
