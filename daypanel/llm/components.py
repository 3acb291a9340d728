"""Connected components of a graph given by its edges, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daypanel.llm.common import saved


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` of all nodes of ``edges``: the root is the smallest node of the component. In each round a node
    takes the smallest label among its neighbours' and then the label of its label, so the rounds grow with the
    logarithm of a component's width rather than with the width. Minima are taken before rows are shuffled, and saved
    tables leave a node with very many edges to be split by the adaptive planner."""
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("next"))
    both = saved(both.unionByName(both.select(F.col("next").alias("node"), F.col("node").alias("next"))).filter("node <> next").distinct())
    labels = saved(both.groupBy("node").agg(F.least(F.col("node"), F.min("next")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("next"), F.col("root").alias("_root")), "next").groupBy("node").agg(F.min("_root").alias("_near"))
        closer = saved(labels.join(near, "node").select("node", F.col("root").alias("_was"), F.least("root", "_near").alias("root")))
        jump = closer.select(F.col("node").alias("root"), F.col("root").alias("_far"))
        step = saved(closer.join(jump, "root").select("node", "_was", F.col("_far").alias("root")))
        labels = step.select("node", "root")
        if step.filter("_was <> root").isEmpty():
            return labels
