"""Connected components of an edge table, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges(src, dst); component is the smallest node reachable.

    Each round takes the smallest label among the neighbours and then the label of that label. Only labels move; a hot
    node is folded by partial aggregation. Rows with a null end are ignored; repeated edges and loops do no harm.
    """
    links = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    links = cut(links.select("src", "dst").union(links.select("dst", "src")).distinct(), "links")
    held = labels = cut(links.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low")).select("node", F.least("node", "low").alias("component")), "labels")
    while True:
        told = links.join(labels, F.col("dst") == F.col("node")).groupBy(F.col("src").alias("node")).agg(F.min("component").alias("low"))
        lowered = labels.join(told, "node").select("node", F.least("component", "low").alias("at"), F.col("component").alias("was"))
        heads = labels.select(F.col("node").alias("at"), F.col("component").alias("next"))
        # A hot label is one row of heads: the join splits its many rows, not its one.
        after = cut(lowered.join(heads, "at").select("node", F.least("at", "next").alias("component"), (F.least("at", "next") != F.col("was")).alias("changed")), "labels", held)
        held, labels = after, after.select("node", "component")
        if after.where("changed").isEmpty():
            return labels


def forest_roots(parents: DataFrame) -> DataFrame:
    """(node, component) for the nodes of a forest, parents(node, parent) with one row a node that has a parent; component is
    the root. Pointers are halved in each round: no edge is doubled, and a hot root is one row of the side that is joined."""
    held = at = cut(parents.select("node", F.col("parent").alias("component")), "roots")
    while True:
        above = at.select(F.col("node").alias("component"), F.col("component").alias("next"))
        after = cut(at.join(above, "component", "left").select("node", F.coalesce("next", "component").alias("component"), F.col("next").isNotNull().alias("moved")), "roots", held)
        held = after
        if after.where("moved").isEmpty():
            return after.select("node", "component").union(after.select(F.col("component").alias("node"), "component").distinct())
        at = after.select("node", "component")
