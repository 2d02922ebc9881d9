"""Connected components by alternating large-star and small-star, as joins over tables that are written after every step."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .frames import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked with the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    # at most one row per edge; rows that repeat go with the small-star's distinct
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lesser neighbours are linked with the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars around the least node of each component: every upper node has one edge, and no lower node is an upper one."""
    roles = edges.select(F.col("a").alias("node"), F.lit(1).alias("upper"), F.lit(0).alias("lower"))
    roles = roles.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("upper"), F.lit(1).alias("lower")))
    nodes = roles.groupBy("node").agg(F.sum("upper").alias("upper"), F.max("lower").alias("lower"))
    return nodes.where("upper > 1 or upper = 1 and lower = 1").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(doc_id, component) for every node of the edges (a, b) that isn't the least of its component. No component is gathered anywhere."""
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _settled(edges):
        edges = materialise(_small_star(_large_star(edges)), "stars")
    return edges.select(F.col("a").alias("doc_id"), F.col("b").alias("component"))
