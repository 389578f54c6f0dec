"""Connected components of links, by stars that shrink until nothing moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pollwright.llm.common import cut


def smallest_reachable(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``: the smallest node reachable.

    Alternates two steps. Large star: each node's greater neighbours are linked to its smallest
    neighbour. Small star: a node's smaller neighbours, itself included, are linked to the
    smallest of them. Links never grow in number, and the rounds grow with the logarithm of the
    longest path. Every group is reduced to its minimum before the shuffle and joined back; no
    task holds the neighbours of a node.
    """
    edges = cut(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
    while True:
        both = edges.union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        lowest = both.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("n"), F.least("hi", "m").alias("m"))
        # An edge's higher end is a greater neighbour of its lower end.
        large = cut(edges.join(lowest, edges.lo == lowest.n).select("hi", F.col("m").alias("lo")).distinct())
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(lowest, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = cut(lowest.select("hi", F.col("m").alias("lo")).union(moved).distinct())
        # Done when each higher end has one centre and no centre is a higher end.
        twice = edges.groupBy("hi").count().where("count > 1")
        if twice.isEmpty() and edges.join(edges.select(F.col("hi").alias("lo")), "lo", "left_semi").isEmpty():
            break
    centres = edges.select("lo").distinct()
    return edges.toDF("node", "component").union(centres.select("lo", "lo"))
