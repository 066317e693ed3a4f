"""Importance of threads: bursts of different sources, weighed by rating."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import start_contribution, traffic_score
from ..schema import COUNTRIES
from .order import position, previous

DECAYS = (1800.0, 3600.0, 7200.0, 86400.0)
#: The main combination of rating kind, shift and decay.
MAIN = ("log", 1.0, 3600.0)
#: All combinations, in the order of the feature vector.
COMBINATIONS = tuple(("log", s, d) for s, d in product((1.0, 1.3, 1.6), DECAYS)) + tuple((k, 0.0, d) for k, d in product(("raw", "one"), DECAYS))
#: Positions in a bin of the join of starts and look-backs: small beside the hosts of a large thread.
BIN = 32
_SHARES = tuple(f"share_{c.lower()}" for c in COUNTRIES)


def _params(df: DataFrame, combos) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(i).alias("combo"), F.lit(k).alias("kind"), F.lit(s).alias("shift"), F.lit(d).alias("decay")) for i, (k, s, d) in enumerate(combos)])
    return df.select("*", F.explode(rows).alias("_p")).select("*", "_p.*").drop("_p")


def meetings(members: DataFrame, width: int = BIN) -> tuple[DataFrame, DataFrame]:
    """Start documents (thread_id, _i, _start) and documents with the span of positions that they answer for (thread_id, _j, _prev,
    ...), both with _bin: a start lies in one bin of ``width`` positions, a span in each that it touches."""
    docs = members.select("thread_id", "fetch_time", "url", "host", "raw", "share_us", "share_gb", "share_ru")
    docs = position(docs, ("thread_id",), ["fetch_time", "url", "host"], "_i")
    spans = previous(docs, ("thread_id", "host"), ["_i"], "_i", "_prev").withColumn("_prev", F.coalesce("_prev", F.lit(-1)))
    bin_of = lambda at: F.floor(at / width)
    spans = spans.withColumn("_bin", F.explode(F.sequence(bin_of(F.col("_prev") + 1), bin_of(F.col("_i")))))
    spans = spans.select("thread_id", "_bin", F.col("_i").alias("_j"), "_prev", F.col("fetch_time").alias("_t"), "host", "raw", "share_us", "share_gb", "share_ru")
    return docs.select("thread_id", bin_of(F.col("_i")).alias("_bin"), "_i", F.col("fetch_time").alias("_start")), spans


def importance(members: DataFrame, combos=(MAIN,)) -> DataFrame:
    """members: thread_id, fetch_time, url, host, raw, share_us, ... Per thread and combination: the highest sum, over
    start documents, of the contributions of each host's first document at or after the start; and that start's time.

    A host counts once per start, so a start document meets a host's next document only: that of the host's whose look-back
    reaches over the start. Starts are points and look-backs are spans of positions in the thread, joined by bins of
    positions: what is compared is about starts times hosts, not pairs of documents, and a large thread is many bins.
    Combinations share that one join.
    """
    starts, spans = meetings(members)
    met = starts.join(spans, ["thread_id", "_bin"]).where("_i <= _j and _i > _prev")
    scored = _params(met, combos)
    weight = traffic_score(F.col("kind"), F.col("raw"), F.col("share_us"), F.col("share_gb"), F.col("share_ru"), F.col("shift"))
    sums = scored.withColumn("_c", start_contribution(weight, F.col("_start"), F.col("_t"), F.col("decay"))).groupBy("thread_id", "combo", "_i").agg(F.sum("_c").alias("_s"), F.first("_start").alias("_start"))
    # Sums to ten decimals, so that starts that differ by the order of adding only are the tie that the earliest wins.
    best = F.max_by(F.struct(F.col("_s").alias("importance"), F.col("_start").alias("best_ts")), F.struct(F.round("_s", 10), -F.col("_i")))
    return sums.groupBy("thread_id", "combo").agg(best.alias("_b")).select("thread_id", "combo", F.when(F.col("_b.importance") > 0, F.col("_b.importance")).otherwise(0.0).alias("importance"), F.when(F.col("_b.importance") > 0, F.col("_b.best_ts")).otherwise(F.lit(0)).alias("best_ts"))


def country_shares(members: DataFrame, combos=(MAIN,)) -> DataFrame:
    """Mean shares and means weighted by rating, per thread and combination: share_us ... and w_share_us ..."""
    rows = _params(members, combos)
    rows = rows.withColumn("_w", traffic_score(F.col("kind"), F.col("raw"), F.col("share_us"), F.col("share_gb"), F.col("share_ru"), F.col("shift")))
    weighed = [F.when(F.sum("_w") > 0, F.sum(F.col(s) * F.col("_w")) / F.sum("_w")).otherwise(F.sum(F.col(s) * F.col("_w"))).alias(f"w_{s}") for s in _SHARES]
    return rows.groupBy("thread_id", "combo").agg(*[F.avg(s).alias(s) for s in _SHARES], *weighed)


def features(members: DataFrame) -> DataFrame:
    """The vector of 50: importances by combination, those of the longest decay followed by six weighted shares."""
    both = importance(members, COMBINATIONS).join(country_shares(members, COMBINATIONS), ["thread_id", "combo"])
    own = F.array("importance", *[F.col(f"w_{s}") for s in _SHARES])
    width = F.when(F.col("combo") % len(DECAYS) == len(DECAYS) - 1, 7).otherwise(1)
    rows = both.groupBy("thread_id").agg(F.array_sort(F.collect_list(F.struct("combo", F.slice(own, F.lit(1), width).alias("x")))).alias("r"))
    return rows.select("thread_id", F.flatten(F.transform("r", lambda r: r["x"])).alias("features"))
