"""Connected components by hooking to the smallest neighbour and pointer jumping, all in shuffles.

Steps cut their lineage with written tables: a checkpoint would hand on its plan's constraints, which multiply in loops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgauge.llm.common import written


def _roots(parents: DataFrame) -> DataFrame:
    """(node, root) from (node, parent), parent < node: pointers doubled until none changes."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        jumped = written(parents.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved")))
        parents = jumped.select("node", "parent")
        if jumped.where("moved").isEmpty():
            return parents.withColumnRenamed("parent", "root")


def smallest_reachable(links: DataFrame) -> DataFrame:
    """(node, root) of each node with a smaller reachable node; ``links`` has a, b. Others are their own roots.

    Each round hooks every node to its smallest neighbour, so a component at least halves its nodes; links then join roots.
    """
    edges = written(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi > lo").distinct())
    total = None
    while not edges.isEmpty():
        roots = written(_roots(written(edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("parent")))))
        onto = roots.select(F.col("node"), F.col("root"))
        if total is None:
            total = roots
        else:
            moved = total.join(onto.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left").select("node", F.coalesce("new", "root").alias("root"))
            total = written(moved.unionByName(roots.join(total, "node", "left_anti")))
        for end in ("hi", "lo"):
            edges = edges.join(onto.select(F.col("node").alias(end), "root"), end, "left").select(F.coalesce("root", end).alias(end), *[c for c in ("hi", "lo") if c != end])
        edges = written(edges.where("hi <> lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct())
    return total if total is not None else links.sparkSession.createDataFrame([], "node long, root long")
