"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gleaner.llm.common import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """``u``, ``v`` (long) to ``node``, ``root``: the same root for all nodes of a component.

    Each round hooks every node to its smallest neighbour if that is smaller, shortens the chains
    once, and replaces the ends of the edges; an edge inside a node goes away. Every node but a local
    minimum is hooked, so rounds are few. Nodes without an edge are not listed; an empty edge table
    has no components. Sums per node are combined before the shuffle, so a hub is no hot group.
    """
    edges = stage(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        lower = stage(edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("parent")), "parents")
        higher = lower.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        parents = stage(lower.join(higher, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent")), "parents")
        moved = lambda df, c: df.join(parents.withColumnRenamed("node", c), c, "left").withColumn(
            c, F.coalesce("parent", c)).drop("parent")
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("root"))
        else:  # nodes met before follow their root; new ones are roots no longer
            labels = moved(labels, "root").select("node", "root").unionByName(
                parents.join(labels, "node", "left_anti").select("node", F.col("parent").alias("root")))
        labels = stage(labels, "labels")
        ends = moved(moved(edges, "u"), "v")
        edges = stage(ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
