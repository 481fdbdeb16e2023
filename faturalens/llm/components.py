"""Connected components of an edge table, by alternating large and small stars.

Each round is two joins and group-bys with map-side combining; a node with very many edges is
never gathered in one task: the least neighbours are written, so that the join that reads them has
plain shuffles on both sides, which adaptive execution splits. Rounds are written as well, to the
shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faturalens.llm import common


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b), root being the smallest node of its component."""
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current, before = common.written(pairs), None
    while (state := fingerprint(current)) != before:
        before = state
        current = common.written(small_star(large_star(current)))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least one of its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = common.written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    tied = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is tied to the least one."""
    least = common.written(edges.groupBy("u").agg(F.min("v").alias("m")))
    tied = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return tied.union(own).where("u <> v").distinct()


def fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.hash("u", "v")).alias("s")).first()
    return row["n"], row["x"], row["s"]
