"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.storage import stored


def _state(edges: DataFrame) -> tuple:
    part = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(part % 1_000_003), F.bit_xor(part)).first())


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node's smaller neighbours move to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b"))).where("a != b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours move to its smallest neighbour, or itself."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    moved = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes in the links (a, b); a component is named by its smallest node.

    Each round is written to the shared folder, so it starts from files. Rounds
    grow with the logarithm of a component's diameter. No node's neighbours are
    gathered: a round is minima and joins by node.
    """
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = stored(links.where("a != b").select(a, b).distinct(), "links")
    before = _state(edges)
    while before[0]:
        edges = stored(_large_star(_small_star(edges)), "stars")
        after = _state(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.union(roots)
