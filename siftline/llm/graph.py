"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): for every node of the edges (columns a, b) the smallest node
    it can reach. Each round hangs every node below its smallest neighbour, follows
    those links to their roots and contracts the graph to the roots."""
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels, n_nodes = None, 2 * edges.count()
    n = n_nodes
    while n:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select(
            "node", F.least("node", "low").alias("up")), "roots", n)
        while True:
            above = roots.select(F.col("node").alias("up"), F.col("up").alias("further"))
            jumped = written(roots.join(above, "up").select("node", F.col("further").alias("up"),
                                                            (F.col("further") != F.col("up")).alias("moved")), "roots", n)
            roots = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = roots.select("node", F.col("up").alias("comp"))
        else:
            to = roots.select(F.col("node").alias("comp"), "up")
            labels = written(labels.join(to, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")), "labels", n_nodes)
        to_a, to_b = roots.select(F.col("node").alias("a"), F.col("up").alias("ua")), roots.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        edges = written(edges.join(to_a, "a").join(to_b, "b").where("ua <> ub").select(
            F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "edges", n)
        n = 2 * edges.count()
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
