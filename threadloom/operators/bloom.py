"""Bloom filters over keys, built as an aggregate and asked in a join.

A filter is a set of pages of 32,768 bits; a key sets ``K`` bits of one page. Pages are plain rows, so filters of any size are
built with partial sums, and asked by joining keys and pages. A key whose bits are not all set is definitely missing; others
may be there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a page: what Spark's bitmap functions hold.
PAGE = 32768
BITS, K = 10, 7


def words(key: Column) -> list[Column]:
    """Four numbers of 32 bits from the key's digest, the same in every engine."""
    digest = F.md5(key.cast("string").cast("binary"))
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _bits(key: Column) -> Column:
    w = words(key)
    return F.array(*[(w[1] + i * (w[2] - w[2] % 2 + 1)) % PAGE for i in range(K)])


def build(keys: DataFrame, key: str, group: tuple = (), bits: int = BITS) -> DataFrame:
    """One filter for each group: the group's columns, pages, page, bits. Null keys are left out."""
    own = [*group]
    rows = keys.where(F.col(key).isNotNull()).select(*own, F.col(key).alias("__key")).distinct()
    sizes = rows.groupBy(*own).agg(F.greatest(F.ceil(F.count(F.lit(1)) * bits / PAGE), F.lit(1)).cast("long").alias("pages"))
    sized = rows.join(sizes, own) if own else rows.join(F.broadcast(sizes), F.lit(True))
    at = sized.select(*own, "pages", (words(F.col("__key"))[0] % F.col("pages")).alias("page"), F.explode(_bits(F.col("__key"))).alias("__at"))
    return at.groupBy(*own, "pages", "page").agg(F.bitmap_construct_agg("__at").alias("bits"))


def ask(rows: DataFrame, filters: DataFrame, key: str, group: tuple = (), name: str = "may_hold") -> DataFrame:
    """Adds ``name``: false if the group's filter rules the key out; a group without a filter holds nothing, a null key is nowhere."""
    own = [*group]
    sizes = filters.select(*own, F.col("pages").alias("__pages")).distinct()
    sized = rows.join(sizes, own, "left") if own else rows.join(F.broadcast(sizes), F.lit(True), "left")
    sized = sized.withColumn("__page", words(F.col(key))[0] % F.col("__pages"))
    pages = filters.select(*[F.col(g).alias(f"__{g}") for g in own], F.col("page").alias("__of"), F.col("bits").alias("__bits"))
    on = F.col("__page") == F.col("__of")
    for g in own:
        on &= F.col(g) == F.col(f"__{g}")
    byte = lambda p: F.conv(F.hex(F.substring("__bits", (F.floor(p / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = lambda p: F.call_function("shiftright", byte(p), (p % 8).cast("int")) % 2 == 1
    found = sized.join(pages, on, "left").withColumn(name, F.coalesce(F.forall(_bits(F.col(key)), is_set), F.lit(False)))
    return found.drop("__pages", "__page", "__of", "__bits", *[f"__{g}" for g in own])
