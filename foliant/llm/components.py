"""Connected components of a link table by contraction, one join per step.

Every node hooks to its smallest neighbour, the hooks are followed to their roots by pointer
doubling, and the links are rewritten to the roots.  Each round at least halves the nodes that
still have links, so the number of rounds is logarithmic.  Nothing but counts reaches the
driver, and each round is written to a table in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import written


def _roots(hooks: DataFrame) -> DataFrame:
    """Follow (node, label) hooks, each to a smaller node, until every label is a root."""
    while True:
        onward = hooks.select(F.col("node").alias("__at"), F.col("label").alias("__on"))
        stepped = written(hooks.join(onward, F.col("label") == F.col("__at"), "left").select(
            "node", F.coalesce("__on", "label").alias("label"),
            (F.col("__on").isNotNull() & (F.col("__on") != F.col("label"))).alias("moved")))
        hooks = stepped.select("node", "label")
        if stepped.filter("moved").isEmpty():
            return hooks


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the (a, b) links; label is the least node reachable.

    Nodes may be of any ordered type.  Loops, repeated and reversed links are allowed; rows
    with a null end are no links.  A node without a link to another node is not returned.
    """
    links = written(links.filter("a != b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not links.isEmpty():
        # An inner node hooks to its least neighbour if that is smaller, else it is a root.
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(
            links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        hooks = _roots(ends.groupBy("node").agg(F.min("other").alias("label")).select(
            "node", F.least("node", "label").alias("label")))
        if labels is None:
            labels = hooks
        else:
            onward = hooks.select(F.col("node").alias("__at"), F.col("label").alias("__on"))
            labels = written(
                labels.join(onward, F.col("label") == F.col("__at"), "left").select(
                    "node", F.coalesce("__on", "label").alias("label")))
        left = hooks.select(F.col("node").alias("a"), F.col("label").alias("__a"))
        right = hooks.select(F.col("node").alias("b"), F.col("label").alias("__b"))
        links = written(links.join(left, "a").join(right, "b").select(
            F.least("__a", "__b").alias("a"), F.greatest("__a", "__b").alias("b"))
            .filter("a != b").distinct())
    if labels is None:
        labels = links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
