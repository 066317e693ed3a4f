"""What is known of a thread: category, freshness, relevance of documents, headline, clocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import ITER_PERCENTILE
from ..functions.scalars import category_ordinal, dot, headline_weight, unit_vector
from .order import running_sum


def freshest(members: DataFrame) -> DataFrame:
    return members.groupBy("thread_id").agg(F.count("*").alias("size"), F.max("fetch_time").alias("freshest_ts"))


def category(members: DataFrame) -> DataFrame:
    """The most frequent one; ties go to the lowest ordinal."""
    counts = members.groupBy("thread_id", "category").agg(F.count("*").alias("n"))
    return counts.groupBy("thread_id").agg(F.min_by("category", F.struct(-F.col("n"), category_ordinal(F.col("category")))).alias("category"))


def relevance(members: DataFrame) -> DataFrame:
    """Adds relevance, the mean cosine to the thread's documents, itself included: one vector sum per thread, no pairs."""
    unit = members.withColumn("_u", unit_vector(F.col("vector")))
    parts = unit.select("thread_id", F.posexplode("_u").alias("_i", "_x")).groupBy("thread_id", "_i").agg(F.sum("_x").alias("_x"))
    sums = parts.groupBy("thread_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda p: p["_x"]).alias("_s"))
    sums = sums.join(members.groupBy("thread_id").agg(F.count("*").alias("_n")), "thread_id")
    return unit.join(sums, "thread_id").withColumn("relevance", dot(F.col("_u"), F.col("_s")) / F.col("_n")).drop("_u", "_s", "_n")


def headlines(members: DataFrame) -> DataFrame:
    """members with pagerank, relevance, nasty. Adds weight and pos within the thread: by weight (to six decimals), then
    title, then file name."""
    last = W.partitionBy("thread_id")
    rows = members.withColumn("_f", F.max("fetch_time").over(last))
    rows = rows.withColumn("weight", headline_weight(F.col("pagerank"), F.col("relevance"), F.col("fetch_time"), F.col("_f"), F.col("nasty"))).drop("_f")
    return rows.withColumn("pos", F.row_number().over(last.orderBy(F.round("weight", 6).desc(), "title", "file_name")))


def nth_timestamp(docs: DataFrame, p: float = ITER_PERCENTILE, over: str = "n") -> DataFrame:
    """The fetch time at index floor(p * n) of the sorted times (``over`` = "n - 1" counts to the last), clamped; no row
    without documents. Times are counted before they are ranked, so equal ones are one row."""
    counts = docs.groupBy("fetch_time").agg(F.count("*").alias("_c"))
    total = docs.agg(F.count("*").alias("n"))
    upto = running_sum(counts, ["fetch_time"], F.col("_c"), "_before").withColumn("_to", F.col("_before") + F.col("_c"))
    at = F.least(F.floor(F.lit(p) * F.expr(over)), F.col("n") - 1)
    return upto.join(F.broadcast(total), F.lit(True)).where(F.col("_to") > at).agg(F.min("fetch_time").alias("iter_ts")).where("iter_ts is not null")
