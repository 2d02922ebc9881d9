"""Reachability over page links, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .keyed import materialise


def reachable(seeds: DataFrame, links: DataFrame, max_levels: int | None = None) -> DataFrame:
    """(node, level) of every node reachable from the seeds (column node) along links (src, dst).

    Every level is one semi join of the links with the frontier, a distinct, and an anti join with what was seen. A level is
    written once into the checkpoint folder, so the lineage does not grow and a lost executor repeats one level at most. The
    frontier holds one row per node; a node with very many links makes only the link side of the join heavy, and that side is
    what adaptive execution splits.
    """
    edges = materialise(links.select("src", "dst").where(F.col("src") != F.col("dst")).distinct(), "links")
    frontier = materialise(seeds.select("node").distinct().withColumn("level", F.lit(0)), "level")
    seen = frontier
    level = 0
    while (max_levels is None or level < max_levels) and not frontier.isEmpty():
        level += 1
        found = edges.join(frontier.select(F.col("node").alias("src")), "src", "left_semi")
        fresh = (
            found.select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        )
        frontier = materialise(fresh.withColumn("level", F.lit(level)), "level")
        seen = seen.unionByName(frontier)
    return seen


def leaves(nodes: DataFrame, leaf_links: DataFrame) -> DataFrame:
    """Distinct leaves (column leaf) linked from the nodes; leaf_links: (src, leaf)."""
    return (
        leaf_links.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").select("leaf").distinct()
    )
