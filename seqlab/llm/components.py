"""Connected components of a graph in Spark, for node ids with an order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, hot_keys, materialize, repeated


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Per node of edges: node, component (its smallest node). Null ends, loops and repeated edges are harmless.

    Each round hands the smallest label over every edge and then shortcuts labels through their own labels, so paths
    shrink by doubling. Where labels meet edges or labels, a hub (a node or component that very many rows name) is
    joined by parts; where they are summed up, each task sums its own first. Rounds go on until nothing changes.
    """
    both = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    both = both.select(F.col(a).alias("u"), F.col(b).alias("v")).union(both.select(F.col(b), F.col(a)))
    both = materialize(both.distinct(), "edges")
    degrees = materialize(both.groupBy("v").agg(F.count("*").alias("n")), "degrees")
    hubs = materialize(hot_keys(degrees, ["v"], both.count()), "hubs")
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least("u", F.min("v")).alias("component")), "labels")
    nodes = labels.count()
    parts = dealt(both, hubs, ["v"], "u")
    while True:
        given = repeated(labels.select(F.col("node").alias("v"), "component"), hubs, ["v"])
        near = parts.join(given, ["v", "_salt"]).groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        passed = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        passed = materialize(passed, "passed")
        big = hot_keys(passed.groupBy("component").agg(F.count("*").alias("n")), ["component"], nodes)
        far = repeated(labels.select(F.col("node").alias("component"), F.col("component").alias("far")), big, ["component"])
        moved = dealt(passed, big, ["component"], "node").join(far, ["component", "_salt"]).select("node", "was", F.least("component", "far").alias("component"))
        moved = materialize(moved, "labels")
        labels = moved.select("node", "component")
        if not moved.where("was <> component").limit(1).count():
            return labels
