"""What the corpus operators share: table access, word splitting, and cutting lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, shared_dir

__all__ = ["BLANK", "BLANK_CHARS", "WORD", "crc_mod", "cut", "shared_dir", "table", "unit", "word_count"]

#: Words are runs of anything but these six ASCII blanks.
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id's decimal text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def unit(*cols: Column) -> Column:
    """A deterministic number in (0, 1) from the columns' hash."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11) + F.lit(0.5)) / F.lit(float(2**53))
