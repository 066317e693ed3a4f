"""Candidates and pools for crowd tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clean_text
from .order import previous, running_sum


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("first_url", "second_url").alias("_a"), F.greatest("first_url", "second_url").alias("_b")).distinct()


def new_pairs(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates not known in either order."""
    rows = candidates.withColumns({"_a": F.least("first_url", "second_url"), "_b": F.greatest("first_url", "second_url")})
    return rows.join(_both_ways(known), ["_a", "_b"], "left_anti").drop("_a", "_b")


def pair_candidates(members: DataFrame, known: DataFrame) -> DataFrame:
    """members: lang, thread_id, pos, url. Within a thread, each document with the first one (expected OK); and the first
    ones of neighbouring threads of a language (expected BAD); without known pairs."""
    heads = members.groupBy("lang", "thread_id").agg(F.min_by("url", "pos").alias("second_url"))
    inside = members.select("lang", "thread_id", "url").join(heads, ["lang", "thread_id"]).where("url <> second_url")
    inside = inside.select("lang", F.col("second_url").alias("first_url"), F.col("url").alias("second_url"), F.lit("OK").alias("expected"))
    across = previous(heads, ("lang",), ["thread_id"], "second_url", "first_url").where("first_url is not null")
    return new_pairs(inside.unionByName(across.select("lang", "first_url", "second_url", F.lit("BAD").alias("expected"))), known)


#: A pool holds all controls, so they are few; more are refused.
MOST_CONTROLS = 1000


def pools(rows: DataFrame, controls: DataFrame, size: int, seed: int = 1) -> DataFrame:
    """Rows with text and title dealt into pools of ``size``, every pool with all controls: pool, then the row's columns.
    The order is that of a seeded digest of the url, then the url. Positions come from sums over ranges of that order."""
    real = rows.where("coalesce(title, '') <> '' and coalesce(text, '') <> ''").withColumn("__digest", F.md5(F.concat(F.lit(f"{seed}:"), "url").cast("binary")))
    real = running_sum(real, ["__digest", "url"], F.lit(1), "__at").withColumn("pool", F.floor(F.col("__at") / size).cast("int")).drop("__digest", "__at")
    if controls.limit(MOST_CONTROLS + 1).count() > MOST_CONTROLS:
        raise ValueError(f"more than {MOST_CONTROLS} controls")
    # One row with the bounded list of controls beside every pool.
    listed = controls.agg(F.collect_list(F.struct(*controls.columns)).alias("__c"))
    own = real.select("pool").distinct().join(F.broadcast(listed), F.lit(True)).select("pool", F.explode("__c").alias("__c")).select("pool", "__c.*")
    return real.unionByName(own)


def previous_of_host(rows: DataFrame) -> DataFrame:
    """The document before each one on its host: a negative for pair training."""
    return previous(rows, ("host",), ["fetch_time", "file_name"], "file_name", "previous")


def map_tags(rows: DataFrame, by_pair: DataFrame, by_topic: DataFrame) -> DataFrame:
    """rows: topic, tag. by_topic: topic, category; by_pair: topic, tag, category. The topic's category first, then the
    pair's; rows with neither are dropped."""
    out = rows.join(by_topic.select("topic", F.col("category").alias("_c1")), "topic", "left")
    out = out.join(by_pair.select("topic", "tag", F.col("category").alias("_c2")), ["topic", "tag"], "left")
    return out.withColumn("category", F.coalesce("_c1", "_c2")).drop("_c1", "_c2").where("category is not null")


def restore_urls(rows: DataFrame, originals: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """rows: title, and what answers carry. Adds the url of the original with the same cleaned title (of several the last by
    url); rows without one are dropped, or keep their own url."""
    known = originals.groupBy(clean_text(F.col("title")).alias("_title")).agg(F.max("url").alias("_url"))
    out = rows.withColumn("_title", clean_text(F.col("title"))).join(known, "_title", "left" if keep_unknown else "inner").drop("_title")
    own = F.coalesce("_url", "url") if keep_unknown and "url" in rows.columns else F.col("_url")
    return out.withColumn("url", own).drop("_url")
