"""Connected components by hooking and contraction, on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, persist


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node it reaches) for every node of edges (a, b).

    A round hooks every node to its least neighbour if that is smaller (partially aggregated before its shuffle, so
    a node with very many edges is no burden), follows the hooks to their roots by pointer jumping, and contracts
    the edges to edges between roots. A root without a node hooked to it has a smaller neighbour after that, so it is
    hooked in the next round: two rounds at least halve the roots that have edges, whatever the shape of the graph,
    and the loop ends with the last edge. Hooks only go to smaller nodes, so the last root is the smallest node.
    """
    spark = edges.sparkSession
    edges, at = persist(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels, old = None, None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks, mid = persist(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "hooks")
        while True:
            up = hooks.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
            step, new = persist(hooks.join(up, hooks["root"] == up["n2"]).select("node", F.col("root").alias("was"), F.col("r2").alias("root")), "hooks")
            changed = not step.where("was <> root").isEmpty()
            forget(spark, mid)
            hooks, mid = step.drop("was"), new
            if not changed:
                break
        if labels is None:
            labels, old = persist(hooks.withColumnRenamed("root", "component"), "labels")
        else:
            after, new = persist(labels.join(hooks, labels["component"] == hooks["node"], "left").select(labels["node"], F.coalesce("root", "component").alias("component")), "labels")
            forget(spark, old)
            labels, old = after, new
        to_a, to_b = (hooks.select(F.col("node").alias(f"n{c}"), F.col("root").alias(f"r{c}")) for c in "ab")
        left = edges.join(to_a, F.col("a") == F.col("na")).select("ra", "b").join(to_b, F.col("b") == F.col("nb")).where("ra <> rb")
        left, new = persist(left.select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), "edges")
        forget(spark, at)
        forget(spark, mid)
        edges, at = left, new
        if edges.isEmpty():
            return labels
