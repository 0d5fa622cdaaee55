"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from jobtrail.llm.shared import join_places, places_of, written


def _summary(edges: DataFrame) -> tuple:
    """Count and an order-free sum: equal for equal sets of edges."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``); the root is the smallest node reachable.

    Large-star and small-star steps alternate: neighbours are tied to the
    smallest one until every node hangs on its root. Each step is a grouping
    and a join of the edges, which are written in between; a few steps do even
    for long chains. The edges of a node of many neighbours are dealt to several
    tasks for the join.
    """
    edges = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = written(edges, "edges")
    before = _summary(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"),
                                       places_of("b", F.expr("b > a")).alias("_places"))
        large = join_places(both.where("b > a"), least, "a", "b").select(F.col("low").alias("a"), "b").where("a <> b").distinct()
        # Every edge now points from the smaller to the larger node; tie the smaller ones together.
        lowest = large.groupBy("b").agg(F.min("a").alias("low"), places_of("a").alias("_places"))
        tied = join_places(large, lowest, "b", "a")
        small = tied.select(F.col("low").alias("a"), "b") \
            .unionByName(tied.select(F.col("low").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
        edges = written(small, "edges")
        after = _summary(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return nodes.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
