"""Filters of the annotation and query paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clean_file_name


def by_language(docs: DataFrame, languages) -> DataFrame:
    return docs.where(F.col("lang").isin(*languages))


def min_text_bytes(docs: DataFrame, least: int = 20) -> DataFrame:
    return docs.where(F.octet_length("text") >= least)


def is_news() -> Column:
    return F.col("category").isNotNull() & ~F.col("category").isin("not_news", "undefined")


def news(docs: DataFrame, save_not_news: bool = False) -> DataFrame:
    keep = is_news() | (F.col("category") == "not_news") if save_not_news else is_news()
    return docs.where(keep)


def fully_indexed(docs: DataFrame, vectors: Column) -> DataFrame:
    """With a language, a category and an embedding. The server's path stops here; the batch path drops non-news too."""
    return docs.where(F.col("lang").isNotNull() & (F.col("lang") != "undefined") & F.col("category").isNotNull() & (F.col("category") != "undefined") & (F.size(vectors) > 0))


def supported_language(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("lang").isNotNull() & ~F.col("lang").isin("undefined", "other"))


def not_stale(docs: DataFrame) -> DataFrame:
    """The clock is the store's newest fetch time, not the wall's."""
    now = docs.agg(F.max("fetch_time").alias("_now"))
    return docs.join(F.broadcast(now), F.col("fetch_time") + F.col("ttl") >= F.col("_now")).drop("_now")


def fresh_range(threads: DataFrame, period: int) -> DataFrame:
    now = threads.agg(F.greatest(F.max("freshest_ts") - period, F.lit(0)).alias("_from"))
    return threads.join(F.broadcast(now), F.col("freshest_ts") >= F.col("_from")).drop("_from")


def embedding_field(kind: str) -> Column:
    """all, title or text: what is embedded."""
    return {"all": F.concat_ws(" ", "title", "text"), "title": F.col("title"), "text": F.col("text")}[kind]


def retain_texts(docs: DataFrame, keep: bool) -> DataFrame:
    return docs if keep else docs.drop("text", "description", "out_links")


def sample_by_class(docs: DataFrame, key: str, label: str, shares: dict[str, float]) -> DataFrame:
    """Kept with a probability by class; a digest of the key decides, so reruns and other engines agree."""
    share = F.coalesce(F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])[F.col(label)], F.lit(1.0)) if shares else F.lit(1.0)
    h = F.conv(F.substring(F.md5(F.col(key).cast("binary")), 1, 8), 16, 10).cast("long")
    return docs.where(h % 1_000_000 < share * 1_000_000)


def split(docs: DataFrame, key: str, share: float = 0.9, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows by a digest of the key, so that a row is on the same side on every run and in other
    engines. A null key counts as the empty one."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    inside = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 1_000_000 < int(share * 1_000_000)
    return docs.where(inside), docs.where(~inside)


def in_language_file(docs: DataFrame, listing: DataFrame, languages: tuple = ("ru", "en")) -> DataFrame:
    """docs whose file the output of the languages mode (lang_code, articles) lists under one of the languages."""
    files = listing.where(F.col("lang_code").isin(*languages)).select(F.explode("articles").alias("_file")).distinct()
    return docs.join(files, clean_file_name(F.col("file_name")) == F.col("_file"), "left_semi")
