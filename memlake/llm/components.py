"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from memlake.llm.scratch import discard, written


def _lowest(edges: DataFrame) -> DataFrame:
    """``(u, m)``: the smallest neighbour of each node; counted with map-side combine."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for each node of the links ``(a, b)``; a component is its smallest node.

    Each step links nodes to the smallest node they know, until no link changes.
    Steps are written tables, so a lost executor costs one step, and links meet
    the smallest neighbours in a join that adaptive execution can split at a
    node with very many links.
    """
    pairs = written(edges.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct(), "links")
    while True:
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(_lowest(both).select("u", F.least("u", "m").alias("m")), "large-star")
        large = written(both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-links")
        discard(low, pairs)
        low = written(_lowest(large), "small-star")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(low, large)
        # Stars whose centres link to nothing smaller are final: then neither step changes a link.
        if after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty() and _one_parent(after):
            return after.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        pairs = after


def _one_parent(links: DataFrame) -> bool:
    return links.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
