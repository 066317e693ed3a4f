"""The modes over article files: languages, news, json, categories, threads, top."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EN_CLUSTERING, RU_CLUSTERING, AnnotatorConfig, ClusteringConfig, RankerConfig
from ..functions.scalars import unit_vector
from ..operators import importance as imp
from ..operators import linkage, ratings, threads
from ..operators.annotate import annotate
from ..operators.embed import HashedEmbedder
from ..operators.rank import rank
from ..schema import CATEGORIES, TRAFFIC
from ..sources import sinks
from ..sources.readers import read_articles

MODES = ("languages", "news", "json", "categories", "threads", "top")
CLUSTERING = {"en": EN_CLUSTERING, "ru": RU_CLUSTERING}


def _scaled(w: float):
    """Unit vectors side by side, each scaled by the root of its weight: with weights that sum to 1, the distance of two
    such vectors is the weighted sum of the parts' distances."""
    return lambda x: x * float(w) ** 0.5


class ArticleEmbedder:
    """Title and text apart for ru, all in one otherwise."""

    def __init__(self, dim: int = 50, max_words: int = 150):
        self.dim, self.max_words = dim, max_words

    def transform(self, docs: DataFrame) -> DataFrame:
        out = docs
        for field in ("title", "text", "all"):
            out = HashedEmbedder(field, "avg", self.dim, self.max_words).transform(out).withColumnRenamed("vector", f"_{field}")
        half = F.concat(*[F.transform(unit_vector(F.col(f"_{c}")), _scaled(0.5)) for c in ("title", "text")])
        return out.withColumn("vector", F.when(F.col("lang") == "ru", half).otherwise(F.transform("_all", lambda x: x.cast("double")))).drop("_title", "_text", "_all")


def cluster(docs: DataFrame, configs: dict[str, ClusteringConfig] | None = None) -> DataFrame:
    """Thread labels of the documents whose language has a configuration: lang, file_name, seq, thread_id (unique over
    languages)."""
    parts = [linkage.threads(docs.where(F.col("lang") == lang), cfg) for lang, cfg in (configs or CLUSTERING).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("thread_id", F.concat_ws("-", "lang", "thread_id"))


def top(docs: DataFrame, labels: DataFrame, pagerank: DataFrame, traffic: DataFrame, cfg: RankerConfig = RankerConfig(), debug: bool = False) -> DataFrame:
    """Ranked threads with headline, articles and, for debugging, weights, features and shares."""
    rows = docs.join(labels.select("file_name", "thread_id"), "file_name")
    rated = ratings.with_traffic(rows, traffic)
    shown = threads.headlines(ratings.with_pagerank(threads.relevance(rows), pagerank))
    shown = sinks.threads(shown.select("thread_id", "pos", "title", "file_name"))
    table = threads.freshest(rows).join(threads.category(rows), "thread_id").join(imp.importance(rated).drop("combo"), "thread_id")
    table = table.withColumn("lang_ord", F.when(F.col("thread_id").startswith("en-"), 0).otherwise(1))
    out = rank(table, threads.nth_timestamp(docs), cfg).join(shown, "thread_id")
    if debug:
        out = out.join(imp.features(rated), "thread_id").join(imp.country_shares(rated).drop("combo"), "thread_id")
    return out


def run(
    spark: SparkSession, mode: str, path: str, ndocs: int | None = None, languages: tuple[str, ...] = ("ru", "en"), save_not_news: bool = False, window: int = 28800, debug: bool = False,
    pagerank: DataFrame | None = None, traffic: DataFrame | None = None, configs: dict[str, ClusteringConfig] | None = None, embed=None, annotator: AnnotatorConfig = AnnotatorConfig(),
) -> DataFrame:
    """One row per object of the mode's output."""
    if mode not in MODES:
        raise ValueError(f"mode {mode}: one of {', '.join(MODES)}")
    cfg = replace(annotator, save_not_news=save_not_news, languages=languages)
    embedder = (embed or ArticleEmbedder()) if mode in ("threads", "top") else None
    docs = annotate(read_articles(spark, path, ndocs), cfg, languages, mode, embed=embedder)
    if mode == "languages":
        return sinks.languages(docs)
    if mode == "news":
        return sinks.news(docs)
    if mode == "json":
        return sinks.documents_json(docs)
    if mode == "categories":
        return sinks.categories(docs, save_not_news).orderBy("ordinal").drop("ordinal")
    docs = docs.cache()
    labels = cluster(docs, configs)
    if mode == "threads":
        rows = docs.join(labels.select("file_name", "thread_id", F.col("seq").alias("pos")), "file_name")
        return sinks.threads(rows.select("thread_id", "pos", "title", "file_name"))
    pagerank = pagerank if pagerank is not None else spark.createDataFrame([], "host string, rating double")
    traffic = traffic if traffic is not None else spark.createDataFrame([], TRAFFIC)
    return top(docs, labels, pagerank, traffic, replace(RankerConfig(), window=window), debug)


def nested(ranked: DataFrame) -> DataFrame:
    """Ranked threads as one row per category, empty ones too: category, threads (array in rank order)."""
    fields = [c for c in ranked.columns if c not in ("rank", "lang_ord", "thread_id", "category")]
    rows = ranked.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("rank", F.to_json(F.struct(*fields)).alias("j")))).alias("_r"))
    every = ranked.sparkSession.createDataFrame([(c, i) for i, c in enumerate(CATEGORIES[1:-1])], "category string, ordinal int")
    return every.join(rows, "category", "left").select("category", "ordinal", F.coalesce(F.transform("_r", lambda r: r["j"]), F.array().cast("array<string>")).alias("threads")).orderBy("ordinal").drop("ordinal")
