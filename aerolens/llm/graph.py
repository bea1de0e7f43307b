"""Connected components by alternating large and small stars: each round is two grouped minima and two joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from aerolens.llm import common


def components(edges: DataFrame, what: str = "components") -> DataFrame:
    """(node, root) for every node of the edges (a, b), whole numbers; root is the smallest node that can be reached.

    The edges of a node are never gathered: its smallest neighbour is a map-side combined minimum, joined back from a
    written table. Rounds grow with the logarithm of the longest path.
    """
    edges = common.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), what)
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 998_244_353)).alias("mark")
    before = edges.agg(mark).first()[0]
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = common.stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), what)
        large = both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = common.stored(large.where("a <> b").distinct(), what)
        least = common.stored(edges.groupBy("a").agg(F.min("b").alias("m")), what)
        small = edges.join(least.hint("merge"), "a")
        edges = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = common.stored(edges.where("a <> b").distinct(), what)
        after = edges.agg(mark).first()[0]
        if after == before:
            break
        before = after
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
