"""Source ratings: lookups with defaults, link graphs and PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RatingDefaults
from ..functions.scalars import host_of
from ..schema import COUNTRIES
from ..storage import cut

_D = RatingDefaults()


def with_pagerank(docs: DataFrame, ratings: DataFrame, default: float = _D.pagerank) -> DataFrame:
    """ratings: host, rating. A rating per host is small beside the documents, and Spark broadcasts it where it is."""
    return docs.join(ratings.select("host", F.col("rating").alias("pagerank")), "host", "left").withColumn("pagerank", F.coalesce("pagerank", F.lit(default)))


def with_traffic(docs: DataFrame, traffic: DataFrame, default: float = _D.traffic) -> DataFrame:
    """traffic: host, rating, country map. Adds raw and a share per country code, 0 where unknown."""
    side = traffic.select("host", F.col("rating").alias("raw"), *[F.col("country")[c].alias(f"share_{c.lower()}") for c in COUNTRIES])
    out = docs.join(side, "host", "left").withColumn("raw", F.coalesce("raw", F.lit(default)))
    return out.withColumns({f"share_{c.lower()}": F.coalesce(f"share_{c.lower()}", F.lit(0.0)) for c in COUNTRIES})


def host_links(pages: DataFrame) -> DataFrame:
    """pages: url, links array<string>. Counted links between different known hosts: src, dst, n."""
    own = pages.select(host_of(F.col("url")).alias("src"), "links")
    known = own.select(F.col("src").alias("dst")).where("dst <> ''").distinct()
    out = own.select("src", F.explode("links").alias("link")).select("src", host_of(F.col("link")).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return out.join(known, "dst", "left_semi").groupBy("src", "dst").agg(F.count("*").alias("n"))


def pagerank(edges: DataFrame, damping: float = 0.7, rounds: int = 20, cut_every: int = 5) -> DataFrame:
    """edges: src, dst, n. Nodes are the sources; edges to others are dropped. Rows without edges left spread evenly.

    The even part is a sum over all nodes, which every round reads once: one row, so no join of nodes with nodes.
    """
    nodes = cut(edges.select(F.col("src").alias("host")).distinct())
    count = nodes.count()
    if not count:
        return nodes.select("host", F.lit(0.0).alias("rating"))
    inner = edges.join(nodes.select(F.col("host").alias("dst")), "dst", "left_semi")
    total = inner.groupBy("src").agg(F.sum("n").alias("_t"))
    moves = cut(inner.join(total, "src").select("src", "dst", (F.col("n") / F.col("_t")).alias("p")))
    nodes = cut(nodes.join(total.select(F.col("src").alias("host"), F.lit(True).alias("linked")), "host", "left").select("host", F.coalesce("linked", F.lit(False)).alias("linked")))
    rank = nodes.select("host", "linked", F.lit(1.0 / count).alias("rating"))
    for k in range(rounds):
        loose = rank.agg(F.sum(F.when(~F.col("linked"), F.col("rating")).otherwise(0.0)).alias("_loose"))
        moved = moves.join(rank.select(F.col("host").alias("src"), "rating"), "src").groupBy("dst").agg(F.sum(F.col("p") * F.col("rating")).alias("_in"))
        rank = (
            nodes.join(moved.select(F.col("dst").alias("host"), "_in"), "host", "left").join(F.broadcast(loose), F.lit(True))
            .select("host", "linked", (damping * (F.coalesce("_in", F.lit(0.0)) + F.col("_loose") / count) + (1 - damping) / count).alias("rating"))
        )
        if (k + 1) % cut_every == 0:
            rank = cut(rank)
    return rank.select("host", "rating")


def least_rating(ratings: DataFrame) -> DataFrame:
    """The lowest rating, for use as the unknown hosts' default."""
    return ratings.agg(F.min("rating").alias("rating"))
