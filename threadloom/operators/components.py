"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.storage import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b (any orderable type, neither null). Returns key, comp: the least key of each node's component.

    Every round maps a node to the least of itself and its neighbours, rewrites edges between the images and drops loops
    and repeats; the maps compose to the labels. Paths shorten as by doubling, and rounds end when no edge is left. All
    is done in joins and sums over the shrinking edges; each round ends in a written table.
    """
    edges = cut(edges.select("a", "b").where("a <> b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_n"), F.least("a", "_m").alias("_to")))
        if labels is None:
            labels = least.select(F.col("_n").alias("key"), F.col("_to").alias("comp"))
        else:
            labels = labels.join(least, labels["comp"] == least["_n"], "left").select("key", F.coalesce("_to", "comp").alias("comp"))
        labels = cut(labels)
        one = edges.join(least, edges["a"] == least["_n"]).select(F.col("_to").alias("a"), "b")
        two = one.join(least, one["b"] == least["_n"]).select("a", F.col("_to").alias("b")).where("a <> b")
        edges = cut(two.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if labels is None:
        labels = edges.select(F.col("a").alias("key"), F.col("b").alias("comp"))
    return labels
