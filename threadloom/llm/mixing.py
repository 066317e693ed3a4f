"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key scaled by its quality weight (``-ln(u) / weight``); within a source, documents
sorted by key and prefix-summed up to the source's word budget are a weighted sample without replacement. A budget above
the source's own size is met by complete epochs first; only the rest is drawn. ``u`` comes from a hash of the id, so that
reruns and recomputed tasks agree.

Scale: a source may hold a third of all rows, so no source is sorted in one task. Keys are cut into ``bins`` slices; the
prefix sums over a source's slices are over at most ``bins`` rows, and rows are sorted within (source, slice) only.

Defined cases: null text or no words: size 0, nothing taken. Texts are counted whole at any length. Carried columns may have any
name; those named like a column of the result are left out. Null source: a source of its own, last in order. Null or
non-positive weight: 1. Equal keys: ordered by id, then size; repeated rows are separate documents. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table, unit, word_count

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
BINS = 4096
RESULT = ("doc_id", "source", "size", "source_size", "target", "epochs", "drawn", "taken")


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP, total: float = 1.0) -> DataFrame:
    """sizes: one row per source (_k, source, source_size). Adds the target by filling to a common level.

    A source's target is ``min(cap * size, level * weight)`` with the level at which targets sum to ``total`` of all
    sizes: the fixed point of resharing excess by weight. Sources are ordered by how early they reach their cap.
    """
    every = W.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("_i") - 1) % len(weights) + 1).cast("int"))
    by_cap = W.orderBy("_ratio", "_i")
    ranked = (
        sizes.withColumn("_i", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("_w", w)
        .withColumn("_cap", F.col("source_size") * cap)
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_all", F.sum("source_size").over(every) * total)
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_rest", F.sum("_w").over(by_cap.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("_level", (F.col("_all") - F.col("_capped")) / F.col("_rest"))
    )
    # The level is that of the first source that its own level does not fill to the cap.
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_i", "_level"))).over(every)["_level"]
    return ranked.withColumn("target", F.least(F.col("_cap"), F.coalesce(level * F.col("_w"), F.col("_cap")))).select("_k", "source_size", "target")


def mix(docs: DataFrame, size: Column, weight: Column, weights=WEIGHTS, cap: float = CAP, seed: int = 17, bins: int = BINS, carry: tuple = ()) -> DataFrame:
    """docs: doc_id, source and what ``size``, ``weight`` and ``carry`` name. Returns doc_id, source, size, source_size,
    target, epochs (complete ones), drawn (in the fractional selection too), taken, and the carried columns whose names are none of these."""
    w = F.when(F.col("_w") > 0, F.col("_w")).otherwise(1.0)
    base = cut(
        docs.select("doc_id", "source", F.struct(*carry).alias("_carry") if carry else F.lit(None).cast("boolean").alias("_carry"), size.cast("long").alias("size"), weight.cast("double").alias("_w"))
        .withColumn("_e", -F.log(unit(F.lit(seed), F.col("doc_id"), F.col("size"))) / w)
        .withColumn("_bin", F.least(F.floor((1 - F.exp(-F.col("_e"))) * bins), F.lit(bins - 1)).cast("int"))
        .withColumn("_k", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
        .drop("_w")
    )
    slices = base.groupBy("_k", "_bin").agg(F.sum("size").alias("_bin_size"), F.first("source").alias("source"))
    targets = source_targets(slices.groupBy("_k").agg(F.first("source").alias("source"), F.sum("_bin_size").alias("source_size")), weights, cap)
    before = W.partitionBy("_k").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = (
        slices.drop("source").withColumn("_before", F.coalesce(F.sum("_bin_size").over(before), F.lit(0)))
        .join(targets, "_k")
        .withColumn("epochs", whole)
        .withColumn("_budget", F.col("target") - F.col("epochs") * F.col("source_size"))
        .drop("_bin_size")
    )
    within = W.partitionBy("_k", "_bin").orderBy("_e", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    upto = F.col("_before") + F.col("_sum")
    # The document that crosses the budget is drawn if that ends nearer to it.
    drawn = (upto <= F.col("_budget")) | ((upto - F.col("size") < F.col("_budget")) & (upto - F.col("_budget") <= F.col("_budget") - (upto - F.col("size"))))
    return (
        base.withColumn("_sum", F.sum("size").over(within))
        .join(plan, ["_k", "_bin"])
        .withColumn("drawn", drawn & (F.col("size") > 0))
        .withColumn("taken", F.col("size") * (F.col("epochs") + F.col("drawn").cast("long")))
        .select(*RESULT, *[F.col("_carry")[c].alias(c) for c in carry if c not in RESULT])
    )


def quality_weights(labels: DataFrame) -> DataFrame:
    """doc_id, weight: 2 for documents labelled good, 0.5 for bad ones; where a document has several labels, the worst."""
    worst = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_q"))
    return worst.select("doc_id", F.when(F.col("_q") > 0, 2.0).otherwise(0.5).alias("weight"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("_n"))
    docs = docs.join(quality_weights(table(spark, sf_dir, "labels")), "doc_id", "left")
    return mix(docs, F.col("_n"), F.col("weight"))
