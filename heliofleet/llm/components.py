"""Connected components of an edge table, as rounds of joins and aggregates over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an edge; ``component`` is the smallest node reachable.

    Each round every node takes the smallest label among its neighbours' and then its label's label, so chains shrink by
    doubling. A hub's neighbours meet in a map-side minimum; nothing is collected but one count a round.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = stored(both.union(both.select("other", "node")).distinct(), "edges")
    labels = stored(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("other"), F.col("component").alias("theirs")), "other")
        best = seen.groupBy("node").agg(F.min("theirs").alias("theirs")).join(labels, "node").select(
            "node", "component", F.least("theirs", "component").alias("near"))
        up = labels.select(F.col("node").alias("near"), F.col("component").alias("far"))
        moved = stored(best.join(up, "near", "left").select(
            "node", F.least("near", F.coalesce("far", "near")).alias("component"), F.col("component").alias("was")), "labels")
        labels = moved.select("node", "component")
        if moved.filter("component <> was").isEmpty():
            return labels
