"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.session import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the component is the smallest node of the connected component.

    Every round points each node at the smallest of its neighbours and itself, follows that
    pointer twice more, renames the edges' ends and drops those that became loops, so hubs and
    chains shrink geometrically.  Each step is written as a table; joins are on nodes, and
    aggregates combine before the shuffle, so a hub with many edges is never gathered.
    Null ends are dropped; a node whose edges are all loops is its own component.
    """
    raw = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    # keyed by the larger end, so that a hub's edges are spread over its neighbours
    left = materialize(
        raw.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    labels = materialize(
        left.select(F.col("a").alias("node")).union(left.select(F.col("b").alias("node"))).distinct().select("node", F.col("node").alias("component")),
        "labels",
    )
    left = left.where("a <> b")
    while not left.isEmpty():
        pointer = materialize(
            left.select("a", "b").union(left.select("b", "a")).groupBy("a").agg(F.min("b").alias("m"))
            .select(F.col("a").alias("n"), F.least("a", "m").alias("m")),
            "pointers",
        )
        for _ in range(2):
            up = pointer.select(F.col("n").alias("m"), F.col("m").alias("mm"))
            pointer = materialize(
                pointer.join(up, "m", "left").select("n", F.coalesce("mm", "m").alias("m")), "pointers"
            )
        to_a = pointer.select(F.col("n").alias("a"), F.col("m").alias("na"))
        to_b = pointer.select(F.col("n").alias("b"), F.col("m").alias("nb"))
        left = materialize(
            left.join(to_a, "a").join(to_b, "b")
            .select(F.greatest("na", "nb").alias("a"), F.least("na", "nb").alias("b"))
            .where("a <> b").distinct(),
            "edges",
        )
        to_component = pointer.select(F.col("n").alias("component"), F.col("m").alias("nc"))
        labels = materialize(
            labels.join(to_component, "component", "left").select("node", F.coalesce("nc", "component").alias("component")),
            "labels",
        )
    return labels
