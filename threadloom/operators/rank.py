"""Ranking threads within categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import RankerConfig
from ..functions.scalars import age_penalty
from .order import position


def fan_out(threads: DataFrame) -> DataFrame:
    """Every thread under its category and under ``any``."""
    return threads.withColumn("category", F.explode(F.array(F.col("category"), F.lit("any"))))


def rank(threads: DataFrame, iter_ts: DataFrame, cfg: RankerConfig = RankerConfig(), limit: int | None = None) -> DataFrame:
    """threads: thread_id, lang_ord, category, size, freshest_ts, best_ts, importance. iter_ts: one row. Adds age_penalty,
    weight and rank within each category.

    Threads of at least ``min_cluster_size`` go by weight; smaller ones come after them by size, then weight. Ranks come from
    ranges of that order: ``any`` holds every thread and is no single task's.
    """
    rows = threads.join(F.broadcast(iter_ts.select("iter_ts")), F.lit(True))
    rows = rows.withColumn("age_penalty", age_penalty(F.col("best_ts"), F.col("iter_ts"), F.lit(cfg.window))).withColumn("weight", F.col("importance") * F.col("age_penalty"))
    out = fan_out(rows.drop("iter_ts"))
    order = [F.least("size", F.lit(cfg.min_cluster_size)).desc(), F.round("weight", 9).desc(), "lang_ord", "freshest_ts", "thread_id"]
    if limit is not None:
        # Tasks give up all but their first ``limit`` rows of a category before rows meet.
        return out.withColumn("rank", F.row_number().over(W.partitionBy("category").orderBy(*order))).where(F.col("rank") <= limit)
    return position(out, ("category",), order, "rank").withColumn("rank", (F.col("rank") + 1).cast("int"))
