"""Connected components by min-label propagation with pointer jumping, on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, materialize


def connected_components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component) for edges (a, b) of strings; the component is its least node.

    Each round hangs every edge's larger root below the smaller one and halves
    the paths, so stars end at once and long chains within log-many rounds.
    Every round is written to the shared folder.
    """
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    label = materialize(
        edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("component", F.col("node")), "labels"
    )
    for _ in range(rounds):
        a = label.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        b = label.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        now = edges.join(a, "a").join(b, "b").filter("ca != cb")
        # Roots that see a smaller root take the least of them.
        moves = now.select(F.greatest("ca", "cb").alias("component"), F.least("ca", "cb").alias("to"))
        moves = materialize(moves.groupBy("component").agg(F.min("to").alias("to")), "moves")
        if moves.isEmpty():
            drop_tables(moves, edges)
            return label
        jumped = moves.alias("m").join(
            moves.select(F.col("component").alias("to"), F.col("to").alias("next")), "to", "left"
        ).select("component", F.coalesce("next", "to").alias("to"))
        new = label.join(jumped, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        new = materialize(new, "labels")
        drop_tables(moves, label)
        label = new
    raise RuntimeError("components did not settle")
