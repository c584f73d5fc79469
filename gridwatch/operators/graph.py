"""Connected components by minimum labels, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import kept


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component: the smallest node reachable.

    Each round hands every node the least label of its neighbours and of its own label, then jumps to
    that label's label; labels only fall, so an unchanged sum ends the rounds. Repeated edges, loops and
    both directions are fine; edges with a null end are dropped; no edges give no rows.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null")
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a", "b").count().drop("count")
    both = kept(both, "edges")
    labels = kept(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    total = None
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("node", "a"), "a").groupBy("b").agg(F.min("component").alias("m"))
        low = labels.join(near, labels.node == near.b).select("node", F.least("component", "m").alias("component"))
        low = kept(low, "low")
        up = low.select(F.col("node").alias("component"), F.col("component").alias("top"))
        labels = kept(low.join(up, "component").select("node", F.col("top").alias("component")), "labels")
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).first()
        if now == total:
            return labels
        total = now
    raise RuntimeError("labels still change after the last round")
