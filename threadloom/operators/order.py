"""Positions, running sums and neighbours in a total order, of all rows or of each group, without a window over either.

Rows are dealt by ranges of (group, order), so a group of any size is spread over as many parts as it needs. What a part
has to know of the parts before it is one row for each part that a group enters from an earlier one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import cut


def _deal(rows: DataFrame, group: list, order: list, parts: int | None) -> DataFrame:
    return rows.repartitionByRange(parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *group, *order)


def _from_before(dealt: DataFrame, sums: DataFrame, part: str, group: list, name: str, value: Column) -> DataFrame:
    """dealt with ``name``: ``value`` over the group's earlier parts, null in a group's first part. sums: a row for each
    part and group. Only the group that a part begins with can have earlier parts: one row a part at most is broadcast."""
    was, side = f"__{name}_was", {c: f"__{name}_{c}" for c in [part, *group]}
    w = W.partitionBy(*group).orderBy(part)
    later = sums.withColumn(name, value.over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn(was, F.lag(part).over(w)).where(F.col(was).isNotNull())
    later = later.select(*[F.col(c).alias(side[c]) for c in side], name)
    on = F.col(part) == F.col(side[part])
    for g in group:
        on &= F.col(g).eqNullSafe(F.col(side[g]))
    return dealt.join(F.broadcast(later), on, "left").drop(*side.values())


def running_sum(rows: DataFrame, order: list, value: Column, name: str, parts: int | None = None, group: tuple = ()) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the group (columns by name; all rows without one) before this one
    in ``order`` (columns or their names), 0 for the first. Only rows of one part and group are sorted together. Ties in
    ``order`` are in any order: give a total one.
    """
    part, val, before, within = (f"__{name}_{x}" for x in ("part", "value", "before", "within"))
    # Written, so that a part is the same rows each time it is read.
    dealt = cut(_deal(rows.withColumn(val, value), list(group), order, parts).withColumn(part, F.spark_partition_id()))
    sums = dealt.groupBy(part, *group).agg(F.sum(val).alias(val))
    here = F.coalesce(F.sum(val).over(W.partitionBy(part, *group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = _from_before(dealt.withColumn(within, here), sums, part, list(group), before, F.sum(val))
    return out.withColumn(name, F.coalesce(F.col(before), F.lit(0)) + F.col(within)).drop(part, val, before, within)


def position(rows: DataFrame, group: tuple, order: list, name: str, parts: int | None = None) -> DataFrame:
    """Adds ``name`` (long): how many rows of the group come before this one in ``order``, a total one. A part is sorted
    once and numbered as it is written; a group's number in a part starts where its earlier parts end."""
    at, part, least, n, before = (f"__{name}_{x}" for x in ("at", "part", "least", "n", "before"))
    dealt = _deal(rows, list(group), order, parts).sortWithinPartitions(*group, *order)
    # The upper bits of this id are the part, the lower 33 the row in it.
    dealt = cut(dealt.withColumn(at, F.monotonically_increasing_id())).withColumn(part, F.shiftright(at, 33))
    sums = dealt.groupBy(part, *group).agg(F.count(F.lit(1)).alias(n), F.min(at).alias(least))
    w = W.partitionBy(*group).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(part, *group, (F.coalesce(F.sum(n).over(w), F.lit(0)) - F.col(least)).alias(before))
    side = starts.select(F.col(before), *[F.col(c).alias(f"{c}__s") for c in [part, *group]])
    on = F.col(part) == F.col(f"{part}__s")
    for g in group:
        on &= F.col(g).eqNullSafe(F.col(f"{g}__s"))
    # A row for each part and group: Spark broadcasts it while it is small, and joins by part and group beyond.
    return dealt.join(side, on).withColumn(name, F.col(at) + F.col(before)).drop(at, part, before, *[f"{c}__s" for c in [part, *group]])


def previous(rows: DataFrame, group: tuple, order: list, value: str, name: str, parts: int | None = None) -> DataFrame:
    """Adds ``name``: ``value`` of the row of the group before this one in ``order``, a total one; null for the first."""
    part, last, before, within = (f"__{name}_{x}" for x in ("part", "last", "before", "within"))
    key = F.struct(*order)
    dealt = cut(_deal(rows, list(group), order, parts).withColumn(part, F.spark_partition_id()))
    sums = dealt.groupBy(part, *group).agg(F.max_by(F.struct(value), key).alias(last))
    w = W.partitionBy(part, *group).orderBy(*order)
    here = dealt.withColumn(within, F.lag(F.struct(value)).over(w))
    out = _from_before(here, sums, part, list(group), before, F.last(last))
    return out.withColumn(name, F.coalesce(F.col(within), F.col(before))[value]).drop(part, before, within)
