"""Row types, and the enumerations whose order matters."""

from __future__ import annotations

from pyspark.sql import types as T

#: Names by ordinal.
CATEGORIES = ("undefined", "any", "society", "economy", "technology", "sports", "entertainment", "science", "other", "not_news")
LANGUAGES = ("undefined", "ru", "en", "other")
COUNTRIES = ("US", "GB", "IN", "RU", "CA", "AU")

RAW_DOC = T.StructType(
    [
        T.StructField("file_name", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("site_name", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("pub_time", T.LongType()),
        T.StructField("fetch_time", T.LongType()),
        T.StructField("out_links", T.ArrayType(T.StringType())),
    ]
)
DOC = T.StructType(
    [
        *RAW_DOC.fields,
        T.StructField("host", T.StringType()),
        T.StructField("ttl", T.LongType()),
        T.StructField("lang", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("nasty", T.BooleanType()),
        T.StructField("embeddings", T.MapType(T.StringType(), T.ArrayType(T.FloatType()))),
    ]
)
JSON_DOC = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("site_name", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("out_links", T.ArrayType(T.StringType())),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)
TRAFFIC = T.StructType([T.StructField("host", T.StringType()), T.StructField("rating", T.DoubleType()), T.StructField("country", T.MapType(T.StringType(), T.DoubleType()))])
DOC_EVENT = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("method", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("cache_control", T.StringType()),
        T.StructField("body", T.StringType()),
    ]
)
