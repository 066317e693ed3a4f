"""Requests that load a service: puts of documents, deletes of earlier ones and queries for threads, in a fixed mixture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import running_sum

#: Bounds of times to live and of periods in seconds, and what queries choose from.
TTL, PERIOD = (300, 2_592_000), (300, 86_400)
LANGUAGES = ("ru", "en")
CATEGORIES = ("society", "economy", "technology", "sports", "entertainment", "science", "other")


def draw(key: Column, salt: str, n: int) -> Column:
    """A number from 0 to n - 1 by a digest of the salt and the key, the same on every run and in other engines."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}:"), key).cast("binary")), 1, 8), 16, 10).cast("long") % n


def requests(docs: DataFrame, mixed: bool = True, delete_share: float = 0.05, threads_share: float = 0.05) -> DataFrame:
    """docs: file_name, body. A row for each request: seq (order), method, target, cache_control, body. Documents are put in
    order of their names; after a put, a delete of the oldest name not yet deleted and a query may follow, each by its share."""
    key, million = F.col("file_name"), 1_000_000
    rows = running_sum(docs.select("file_name", "body"), ["file_name"], F.lit(1), "_i").withColumn("_delete", draw(key, "delete", million) < int(delete_share * million))
    pick = lambda salt, names: F.element_at(F.array(*[F.lit(x) for x in names]), (draw(key, salt, len(names)) + 1).cast("int"))
    none = F.lit(None).cast("string")
    seq = lambda n: (F.col("_i") * 3 + n).alias("seq")
    ttl = draw(key, "ttl", TTL[1] - TTL[0] + 1) + TTL[0]
    out = rows.select(seq(0), F.lit("PUT").alias("method"), F.concat(F.lit("/"), key).alias("target"), F.concat(F.lit("max-age="), ttl.cast("string")).alias("cache_control"), "body")
    if not mixed:
        return out
    # The k-th delete is of the k-th document put.
    deletes = running_sum(rows.where("_delete").select("_i"), ["_i"], F.lit(1), "_k")
    gone = deletes.join(rows.select(F.col("_i").alias("_k"), "file_name"), "_k")
    period = draw(key, "period", PERIOD[1] - PERIOD[0] + 1) + PERIOD[0]
    query = F.concat(F.lit("/threads?period="), period.cast("string"), F.lit("&lang_code="), pick("lang", LANGUAGES), F.lit("&category="), pick("category", CATEGORIES))
    asks = rows.where(draw(key, "threads", million) < int(threads_share * million))
    row = lambda df, n, method, target: df.select(seq(n), F.lit(method).alias("method"), target.alias("target"), none.alias("cache_control"), none.alias("body"))
    return out.unionByName(row(gone, 1, "DELETE", F.concat(F.lit("/"), F.col("file_name")))).unionByName(row(asks, 2, "GET", query))
