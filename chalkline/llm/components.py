"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.blocks import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge; the root is the same for all nodes of a component.

    Each round hooks a node to its smallest neighbour, follows the hooks a few steps, and carries
    the edges over to what they lead to. Edges inside a component vanish, and the number of rounds
    grows with the logarithm of the number of nodes. Only minima are taken per node, so a node with
    very many edges is reduced before the shuffle.
    """
    left = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    nodes = left.select(F.col("a").alias("node")).union(left.select(F.col("b").alias("node"))).distinct()
    labels = nodes.withColumn("root", F.col("node"))
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        hooks = both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p"))
        for _ in range(2):
            further = hooks.select(F.col("a").alias("p"), F.col("p").alias("q")).hint("merge")
            hooks = hooks.join(further, "p", "left").select("a", F.coalesce("q", "p").alias("p"))
        lead = lambda x, y: hooks.select(F.col("a").alias(x), F.col("p").alias(y)).hint("merge")
        moved = left.join(lead("a", "pa"), "a").join(lead("b", "pb"), "b").where("pa <> pb").select("pa", "pb").distinct()
        # hooks and the edges that are left in one table, so that a round is one checkpoint
        round_ = cut(hooks.select("a", "p", F.lit(True).alias("hook")).union(moved.select("pa", "pb", F.lit(False))))
        steps = round_.where("hook").select(F.col("a").alias("root"), "p").hint("merge")
        labels = labels.join(steps, "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        left = round_.where("not hook").select("a", F.col("p").alias("b"))
    return cut(labels)
