"""Connected components by repeated contraction, with each round in a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes in ``edges`` (a, b longs); root is the smallest node reachable.

    In a round every node moves to the smallest of itself and its neighbours, and the edges are
    rewritten between the new names. At least half of the nodes go, so rounds are logarithmic;
    counts and minima combine before they shuffle, so a node with very many edges is no hot spot.
    """
    edges = edges.select("a", "b").where("a <> b").distinct()
    maps = []
    while True:
        both = scratch(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
        if both.isEmpty():
            break
        to = scratch(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), "moves")
        maps.append(to)
        left = both.where("a < b").join(to, "a").select("b", F.col("to").alias("ta"))
        edges = left.join(to.select(F.col("a").alias("b"), F.col("to").alias("tb")), "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[0].select(F.col("a").alias("node"), F.col("to").alias("root"))
    for to in maps[1:]:
        out = out.join(to.select(F.col("a").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return out
