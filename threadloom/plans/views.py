"""The article view over the driver's tables, in Spark and in SQL, and small reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import category_name
from ..schema import CATEGORIES, COUNTRIES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str, vectors_only: bool = False) -> DataFrame:
    """All documents, with a null vector where there is none; or, for what works on vectors, those that have one."""
    docs, vectors, events = (table(spark, sf_dir, n) for n in ("documents", "embeddings", "events"))
    i = F.col("doc_id")
    label = F.coalesce("label", (i % 10).cast("int"))
    ordinal = F.when(i % 17 == 0, 9).otherwise(2 + (label + F.when(i % 3 == 0, 1).otherwise(0)) % 7)
    return (
        docs.select("doc_id", "text", "lang", "source")
        .join(vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label"), "doc_id", "inner" if vectors_only else "left")
        .join(events.select((F.col("event_id") / 5).cast("long").alias("doc_id"), "ts").where(events["event_id"] % 5 == 0), "doc_id", "left")
        .select(
            "doc_id", F.concat(i.cast("string"), F.lit(".html")).alias("file_name"), F.concat(F.lit("https://www."), "source", F.lit(".example.com/"), i.cast("string")).alias("url"),
            F.col("source").alias("site_name"), F.concat("source", F.lit(".example.com")).alias("host"), F.substring_index("text", "\n", 1).alias("title"), "text", "lang",
            F.coalesce(F.unix_seconds(F.col("ts").cast("timestamp")), F.lit(0).cast("long")).alias("fetch_time"), category_name(ordinal.cast("int")).alias("category"), (86400 * (1 + i % 30)).alias("ttl"), "vector", label.alias("label"),
            F.concat_ws("-", "lang", label.cast("string")).alias("thread_id"),
        )
    )


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its whole first line as title, for queries that need no vector, time or category."""
    i = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(
        F.concat(i, F.lit(".html")).alias("file_name"), F.concat(F.lit("https://www."), "source", F.lit(".example.com/"), i).alias("url"), F.substring_index("text", "\n", 1).alias("title"), "text",
    )


_NAMES = ", ".join(f"'{c}'" for c in CATEGORIES)


def _view(join: str) -> str:
    return f"""articles AS (
  SELECT d.doc_id, d.doc_id || '.html' AS file_name, 'https://www.' || d.source || '.example.com/' || d.doc_id AS url, d.source AS site_name,
    d.source || '.example.com' AS host, split_part(d.text, chr(10), 1) AS title, d.text, d.lang, coalesce(CAST(floor(epoch(e.ts)) AS BIGINT), 0) AS fetch_time,
    ([{_NAMES}])[1 + CASE WHEN d.doc_id % 17 = 0 THEN 9 ELSE 2 + (coalesce(m.label, d.doc_id % 10) + CASE WHEN d.doc_id % 3 = 0 THEN 1 ELSE 0 END) % 7 END] AS category,
    86400 * (1 + d.doc_id % 30) AS ttl, m.embedding AS vector, coalesce(m.label, d.doc_id % 10) AS label, d.lang || '-' || coalesce(m.label, d.doc_id % 10) AS thread_id
  FROM documents d {join} embeddings m ON m.vec_id = d.doc_id LEFT JOIN events e ON e.event_id = 5 * d.doc_id)"""


#: All documents; and those with a vector, under the same name.
ARTICLES, VECTORED = _view("LEFT JOIN"), _view("JOIN")


def pagerank_table(spark: SparkSession) -> DataFrame:
    k = F.col("id")
    return spark.range(20).where("id % 3 <> 0").select(F.concat(F.lit("src"), k.cast("string"), F.lit(".example.com")).alias("host"), ((k + 1) * 0.00125).alias("rating"))


PAGERANK = "pr AS (SELECT 'src' || k || '.example.com' AS host, ((k + 1) * 0.00125)::DOUBLE AS rating FROM range(20) t(k) WHERE k % 3 <> 0)"


def traffic_table(spark: SparkSession) -> DataFrame:
    k = F.col("id")
    shares = F.create_map(*[x for i, c in enumerate(COUNTRIES[:4]) for x in (F.lit(c), ((k * (i + 2)) % 23).cast("double"))])
    return spark.range(20).where("id % 4 <> 0").select(F.concat(F.lit("src"), k.cast("string"), F.lit(".example.com")).alias("host"), ((k + 1) * 0.37).alias("rating"), shares.alias("country"))


_SHARE = ", ".join(f"CAST((k * {i + 2}) % 23 AS DOUBLE) AS share_{c.lower()}" for i, c in enumerate(COUNTRIES[:4]))
TRAFFIC = f"tr AS (SELECT 'src' || k || '.example.com' AS host, ((k + 1) * 0.37)::DOUBLE AS rating, {_SHARE} FROM range(20) t(k) WHERE k % 4 <> 0)"
MEMBERS = f"""{ARTICLES}, {TRAFFIC}, members AS (
  SELECT a.*, coalesce(tr.rating, 0.1::DOUBLE) AS raw, {', '.join(f'coalesce(share_{c.lower()}, 0.0) AS share_{c.lower()}' for c in COUNTRIES[:4])}, 0.0 AS share_ca, 0.0 AS share_au
  FROM articles a LEFT JOIN tr ON tr.host = a.host WHERE category <> 'not_news')"""
