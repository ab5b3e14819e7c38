"""Connected components of an edge list, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import written


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of ``edges`` (a, b), the component's smallest id.

    Each round sends a vertex the smallest label among its neighbours and then jumps to
    that label's own label, so the rounds grow with the logarithm of the longest path.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        of_b = labels.select(F.col("id").alias("b"), F.col("component").alias("near"))
        near = both.join(of_b, "b").groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        best = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("far"))
        moved = best.join(jump, "next").select("id", F.least("next", "far").alias("component"), (F.least("next", "far") < F.col("component")).alias("moved"))
        moved = written(moved, "labels")
        labels = moved.select("id", "component")
        if moved.where("moved").isEmpty():
            return labels
