"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.sources.shared import materialise


def least_neighbour(edges: DataFrame) -> DataFrame:
    """(v, u, m) for edges (u, v): m is the least of u and all its neighbours.

    The minimum combines before the shuffle and comes back by an equi-join that
    adaptive execution can split, so a node with very many neighbours is no hot task.
    """
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return edges.join(least, "u")


def large_star(edges: DataFrame) -> DataFrame:
    both_ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = least_neighbour(both_ways).where(F.col("v") > F.col("u"))
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Edges have u > v; each smaller neighbour and u itself are tied to the least."""
    linked = least_neighbour(edges)
    kept = linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = linked.select("u", F.col("m").alias("v"))
    return kept.unionByName(own).where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node reachable.

    Every round is written to the shared folder, so lineage stays short and a lost
    executor costs a re-read. Self edges and repeats do no harm; nodes without an edge to
    another node do not appear. Only a row count and a checksum reach the driver.
    """
    current = materialise(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        name,
    )
    state = None
    while True:
        marks = current.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("u", "v"), 32))).first()
        if marks[0] == 0 or marks == state:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = marks
        current = materialise(small_star(large_star(current)), name)
