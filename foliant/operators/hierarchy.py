"""Parent/child hierarchies and flagged edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_has_children(nodes: DataFrame) -> DataFrame:
    """Nodes (id, parent_id, …) with a flag telling whether anything hangs below them."""
    parents = nodes.select(F.col("parent_id").alias("id")).filter("id IS NOT NULL").distinct(
    ).withColumn("has_children", F.lit(True))
    return nodes.join(parents, "id", "left").withColumn(
        "has_children", F.coalesce("has_children", F.lit(False)))


def children(nodes: DataFrame, parent: str | None) -> DataFrame:
    """Direct children of a node; roots when no parent is named."""
    marked = with_has_children(nodes)
    if parent is None:
        return marked.filter("parent_id IS NULL")
    return marked.filter(F.col("parent_id") == parent)


def expand(nodes: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """Members below each root through sub-categories, down to ``max_depth``.

    One equi-join per level.  A frontier only holds nodes not met before, so a category
    cycle ends the walk early instead of repeating it.
    """
    edges = nodes.select(F.col("parent_id").alias("id"), F.col("id").alias("child"))
    frontier = roots.select(F.col("id").alias("root"), F.col("id"), F.lit(0).alias("depth"))
    reached = frontier
    for depth in range(1, max_depth + 1):
        step = frontier.join(edges, "id").select(
            "root", F.col("child").alias("id"), F.lit(depth).alias("depth")).distinct()
        frontier = step.join(reached.select("root", "id"), ["root", "id"], "left_anti")
        reached = reached.unionByName(frontier)
    return reached
