"""Connected components of a link table, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """``links``: undirected edges ``a``, ``b`` (long). Returns ``node``, ``component`` (the
    smallest node of its component) for every node of an edge between different nodes.

    Rounds of contraction: every node points to its smallest neighbour if that is smaller,
    pointers are followed twice, and edges move to where their ends point. Each round
    leaves at most half of the nodes that still have edges, so rounds grow with the
    logarithm of the longest chain. A hub is one row on the side that is looked up; only
    the other side of those joins can be skewed, which adaptive execution splits.
    """
    edges = written(links.filter("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    found = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select(
        "node", F.col("node").alias("component"))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy("a").agg(F.min("b").alias("least")).select(
            F.col("a").alias("node"), F.least("a", "least").alias("up")), "cc-up")
        one = up.select(F.col("node").alias("up"), F.col("up").alias("up1"))
        two = up.select(F.col("node").alias("up1"), F.col("up").alias("root"))
        roots = up.join(one, "up").join(two, "up1").select("node", "root")
        found = written(found.join(roots.withColumnRenamed("node", "component"), "component",
                                   "left")
                        .select("node", F.coalesce("root", "component").alias("component")),
                        "cc-found")
        a = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = written(edges.join(a, "a").join(b, "b").filter("ra <> rb").select(
            F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            "cc-edges")
    return found
