"""Connected components of an edge table whose hubs may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(v, label): the smallest id reachable from v over the undirected edges (a, b).

    Minimum labels spread along edges, then jump to their label's label, until nothing changes, so rounds grow with
    the logarithm of a component's diameter. Both sides of each join are written tables: no join follows an
    aggregation, and a hot hub's partition can be split.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).filter("u <> v").distinct()
    both = materialise(both, "cc-edges")
    labels = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("label")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("u"), "label"), "u").select("v", "label")
        spread = materialise(near.unionByName(labels).groupBy("v").agg(F.min("label").alias("label")), "cc-spread")
        up = spread.select(F.col("v").alias("label"), F.col("label").alias("above"))
        jumped = materialise(spread.join(up, "label", "left").select("v", F.least("label", F.coalesce("above", "label")).alias("label")), "cc-labels")
        now = jumped.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        before = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        labels = jumped
        if now == before:
            return labels
