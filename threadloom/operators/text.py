"""Term statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def document_frequency(docs: DataFrame, words: Column, key: str = "doc_id") -> DataFrame:
    """token, df. Tokens are made distinct within their row, so only partial counts are shuffled."""
    return docs.select(F.explode(F.array_distinct(words)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def idf_table(docs: DataFrame, words: Column, skip: int = 1000, keep: int = 10000) -> DataFrame:
    """ln((N + 1) / (df + 1)) of the tokens ranked after the ``skip`` most frequent, ``keep`` of them: token, df, idf."""
    n = docs.agg(F.count("*").alias("_n"))
    top = document_frequency(docs, words).orderBy(F.col("df").desc(), "token").limit(skip + keep)
    ranked = top.withColumn("_r", F.row_number().over(W.orderBy(F.col("df").desc(), "token"))).where(F.col("_r") > skip)
    return ranked.join(F.broadcast(n), F.lit(True)).select("token", "df", F.log((F.col("_n") + 1) / (F.col("df") + 1)).alias("idf"))


def exploded(docs: DataFrame, words: Column, *keep: str) -> DataFrame:
    """The kept columns, ``_n`` (tokens of the row) and ``token``, a row per token. The array is made once and counted below
    the explode, so that neither it nor the text it comes from is carried along with every token."""
    made = docs.select(*keep, words.alias("_words")).withColumn("_n", F.size("_words"))
    return made.select(*keep, "_n", F.explode("_words").alias("token"))


def tfidf(docs: DataFrame, words: Column, idf: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, token, tf, tfidf for the tokens of the table; tf is over all of a document's tokens."""
    counts = exploded(docs, words, key).groupBy(key, "_n", "token").agg(F.count("*").alias("_c"))
    return counts.join(idf.select("token", "idf"), "token").select(key, "token", (F.col("_c") / F.col("_n")).alias("tf"), (F.col("_c") / F.col("_n") * F.col("idf")).alias("tfidf"))


def indexed(docs: DataFrame, words: Column, vocabulary: DataFrame, key: str = "doc_id") -> DataFrame:
    """Positions and vocabulary indexes; 0 for unknown tokens."""
    rows = docs.select(key, F.posexplode(words).alias("pos", "token"))
    return rows.join(vocabulary.select("token", "idx"), "token", "left").select(key, "pos", F.coalesce("idx", F.lit(0)).alias("idx"))
