"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

# Every round at least halves the distance to the smallest node; a graph needs about the
# logarithm of its diameter, so this is a guard against a fault, not a limit.
MAX_ROUNDS = 60


def connected(edges: DataFrame, folder: str) -> DataFrame:
    """(node, component) for every node of an edge; component is its smallest node.

    ``edges`` has columns a, b and is read from files.  Every round links each neighbour of a node that is
    larger than it, and then each smaller one, to the smallest; the tables of a round are
    written to ``folder`` so that the next one starts from files.  A hot node never meets
    all its neighbours in one task: the smallest neighbour is an aggregate, joined back.
    The rounds end when every edge joins a node to the centre of its star.
    """
    most = edges.count()
    both = edges.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current = stored(both, f"{folder}/round-0", rows=most)
    for n in range(1, MAX_ROUNDS):
        # A round adds no edges: every edge of it comes from one of the round before.
        most = current.count()
        # Large star: larger neighbours of u point to the smallest of u and its neighbours.
        sides = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sides.groupBy("u").agg(F.min("v").alias("low"))
        large = (sides.join(low, "u").filter("v > u")
                 .select(F.col("v").alias("u"), F.least("u", "low").alias("v")).distinct())
        # Small star: smaller neighbours of u and u itself point to the smallest.
        large = stored(large, f"{folder}/large-{n}", rows=most)
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (large.join(low, "u").select(
            F.explode(F.array(F.struct("v", "low"), F.struct(F.col("u").alias("v"), "low"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.low").alias("v")).filter("u <> v").distinct())
        current = stored(small, f"{folder}/round-{n}", rows=2 * most)
        if _stars(current):
            break
    else:
        raise RuntimeError("connected components did not settle")
    top = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return top.unionByName(top.select(
        F.col("component").alias("node"), "component").distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one larger-to-smaller edge, to a node that has none."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
    return (ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
            .filter("up + down > 1").isEmpty())
