"""Connected components of a graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.functions.scale import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the root is one node of the component, the same for all.

    Every node hooks onto its smallest neighbour, links are then read between the nodes hooked onto, and those that have
    become loops vanish; a round at least halves the nodes that are left. At the end the rounds are followed
    one after the other. A node with very many links is one aggregate with map-side minima and joins Spark can split.
    """
    left = written(links.select("a", "b").where("a <> b").distinct(), "links")
    rounds = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root"))
        hooks = written(hooks.withColumnRenamed("a", "node"), "hooks")
        rounds.append(hooks)
        moved = (
            left.join(hooks.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
            .join(hooks.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        )
        left = written(moved.distinct(), "links")
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    result = rounds[0]
    for hooks in rounds[1:]:
        following = hooks.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        result = result.join(following, "root", "left").select("node", F.coalesce("_next", "root").alias("root"))
    return written(result, "components")
