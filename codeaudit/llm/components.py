"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeaudit.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of edges(a, b).

    A round lets each node take the smallest root of its neighbours and then that
    root's own root, so paths halve.  Both joins are plain sort-merge joins of
    stored tables, whose hot keys Spark splits.  Rounds end when no root changes.
    """
    # Stored before they are turned round: a second evaluation might return other edges of the same components.
    edges = stored(edges.select("a", "b").distinct())
    both = stored(edges.union(edges.select("b", "a")).distinct())
    roots = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    while True:
        near = both.join(roots.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), "root")
        hop = stored(near.union(roots.select("node", "root")).groupBy("node").agg(F.min("root").alias("root")))
        up = hop.select(F.col("node").alias("root"), F.col("root").alias("upper"))
        jumped = hop.join(up, "root").select("node", F.col("upper").alias("root"))
        changed = jumped.join(roots.withColumnRenamed("root", "old"), "node")
        after = stored(changed.select("node", "root", (F.col("root") != F.col("old")).alias("moved")))
        roots = after.select("node", "root")
        if after.filter("moved").isEmpty():
            return roots
