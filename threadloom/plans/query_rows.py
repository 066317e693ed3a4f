"""Scalars, filters, sinks, lookups and set operations over the article view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import filters, markup, ratings
from ..schema import CATEGORIES
from ..sources import sinks
from .registered import Registered, sig
from .views import ARTICLES, MEMBERS, PAGERANK, TRAFFIC, articles, headed, pagerank_table, table, traffic_table

REGISTERED = query = Registered()
joined = lambda c: F.array_join(c, ",")


@query(r"""SELECT page_id, regexp_extract(url, '^(?:http|https)://(?:www\.)?([^/ :]+):?[^/ ]*/?[^ #?]*\x3f?[^ #]*#?[^ ]*$', 1) AS host FROM pages""")
def host_extract(spark, d):
    return table(spark, d, "pages").select("page_id", S.host_of(F.col("url")).alias("host"))


@query(r"SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS file_name FROM pages")
def clean_file_name(spark, d):
    return table(spark, d, "pages").select("page_id", S.clean_file_name(F.col("url")).alias("file_name"))


@query(f"SELECT o_orderkey, round({sig('(o_totalprice - 150000) / 20000')}, 8) AS s FROM orders")
def sigmoid_age(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(S.sigmoid((F.col("o_totalprice") - 150000) / 20000), 8).alias("s"))


@query("""SELECT event_id, greatest(CAST(epoch(date_trunc('second', ts)) AS BIGINT) - (CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) * ((event_id % 12) * 3600 + 1800), 0) AS at FROM events WHERE event_id % 10 <> 9
UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 10 = 9""")
def iso_to_epoch(spark, d):
    i = F.col("event_id")
    zone = F.concat(F.when(i % 2 == 0, "+").otherwise("-"), F.lpad((i % 12).cast("string"), 2, "0"), F.lit(":30"))
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(i % 10 == 9, "Z").otherwise(zone))
    return table(spark, d, "events").select("event_id", S.iso_to_epoch(iso).alias("at"))


@query(f"""WITH {ARTICLES} SELECT file_name, (lang = 'en' AND octet_length(encode(title)) < 16) OR right(title, 1) IN ('!', '?', '.', ' ') OR starts_with(title, '"') OR length(title) - length(replace(title, ' ', '')) < 2 AS nasty FROM articles""")
def nasty_flag(spark, d):
    return articles(spark, d).select("file_name", S.nasty(F.col("title"), F.col("lang")).alias("nasty"))


@query(f"""SELECT p_partkey, CASE WHEN n IN ({', '.join(repr(c) for c in CATEGORIES)}) THEN list_position([{', '.join(repr(c) for c in CATEGORIES)}], n) - 1 ELSE 0 END AS ordinal
FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'sports' WHEN 1 THEN 'any' WHEN 2 THEN 'not_news' WHEN 3 THEN 'weather' ELSE 'science' END AS n FROM part)""")
def enum_parse(spark, d):
    name = F.get(F.array(*[F.lit(x) for x in ("sports", "any", "not_news", "weather", "science")]), (F.col("p_partkey") % 5).cast("int"))
    return table(spark, d, "part").select("p_partkey", S.category_ordinal(name).cast("long").alias("ordinal"))


def _score_sql(kind: str, shift: float) -> str:
    inner = f"raw * (100.0 - share_us - share_gb) / 100.0 + {shift}"
    return {"one": "1.0", "raw": "raw * (100.0 - share_us - share_gb) / 100.0"}.get(kind, f"CASE WHEN {inner} > 0 THEN greatest(ln({inner}), 0.3) ELSE 0.3 END")


@query(f"WITH {MEMBERS} SELECT file_name, round({_score_sql('log', 1.0)}, 8) AS log_score, round({_score_sql('raw', 0)}, 8) AS raw_score, {_score_sql('one', 0)}::DOUBLE AS one_score FROM members")
def alexa_score(spark, d):
    score = lambda k, s: S.traffic_score(F.lit(k), F.col("raw"), F.col("share_us"), F.col("share_gb"), F.col("share_ru"), F.lit(s))
    return members(spark, d).select("file_name", F.round(score("log", 1.0), 8).alias("log_score"), F.round(score("raw", 0.0), 8).alias("raw_score"), score("one", 0.0).alias("one_score"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN -1 WHEN o_orderkey % 3 = 1 THEN o_custkey END AS ttl FROM orders""")
def ttl_header(spark, d):
    k = F.col("o_orderkey")
    header = F.when(k % 3 == 0, "no-cache").when(k % 3 == 1, F.concat(F.lit("max-age="), F.col("o_custkey").cast("string"))).otherwise("max-age=soon")
    return table(spark, d, "orders").select("o_orderkey", S.ttl_seconds(header).alias("ttl"))


@query(f"""WITH {ARTICLES}, w AS (SELECT file_name, list_filter(string_split_regex(title, ' +'), lambda x: x <> '')[1:150] AS t FROM articles)
SELECT file_name, array_to_string(list_transform(t, lambda x: CASE x WHEN 'the' THEN 1 WHEN 'of' THEN 2 WHEN 'de' THEN 3 WHEN 'der' THEN 4 ELSE 0 END), ',') AS idx FROM w""")
def tokenise_index(spark, d):
    words = S.plain_tokens(F.col("title"), 150)
    idx = S.index_tokens(words, {"the": 1, "of": 2, "de": 3, "der": 4})
    return articles(spark, d).select("file_name", joined(F.transform(idx, lambda i: i.cast("string"))).alias("idx"))


@query(r"""SELECT conv_id, turn, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]'), ' ') AS t FROM conversations""")
def text_normalise(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(S.tokens(F.col("text")), " ").alias("t"))


@query(f"""WITH {ARTICLES} SELECT file_name, 2 * length(regexp_replace(title, '[\\x00-\\x7FА-я]', '', 'g')) > length(title) AS bad FROM articles""")
def unknown_symbols(spark, d):
    return articles(spark, d).select("file_name", S.unknown_symbols(F.col("title")).alias("bad"))


_FOREIGN = r"length(regexp_replace(title, '[^\x{80}-\x{7FF}]|[А-я]', '', 'g'))"
_LAST = r"CASE WHEN regexp_matches(right(title, 1), '[\x{80}-\x{7FF}]') AND NOT regexp_matches(right(title, 1), '[А-я]') THEN 1 ELSE 0 END"


# Foreign two-byte letters count twice, but for one at the end. (The scan differs for U+0700 to U+07FF, which no table holds.)
@query(f"""WITH t AS (SELECT doc_id || '.html' AS file_name, split_part(text, chr(10), 1) AS title FROM documents)
SELECT file_name, 2 * (length(regexp_replace(title, '[\\x00-\\x{{7FF}}]', '', 'g')) + 2 * {_FOREIGN} - {_LAST}) > length(title) + {_FOREIGN} - {_LAST} AS bad FROM t""")
def unknown_symbols_bytes(spark, d):
    return headed(spark, d).select("file_name", S.unknown_symbols_bytes("title").alias("bad"))


@query(f"""WITH {ARTICLES} SELECT file_name, CASE WHEN p < 0.4 THEN NULL WHEN 2 * length(regexp_replace(title, '[\\x00-\\x7FА-я]', '', 'g')) > length(title) THEN 'other' WHEN l = 'ru' AND p < 0.6 THEN 'other' ELSE l END AS lang
FROM (SELECT *, (doc_id % 10) / 10.0 AS p, CASE WHEN doc_id % 4 = 0 THEN 'ru' ELSE lang END AS l FROM articles)""")
def language_decision(spark, d):
    i = F.col("doc_id")
    return articles(spark, d).select("file_name", S.language_decision(F.when(i % 4 == 0, "ru").otherwise(F.col("lang")), (i % 10) / 10.0, S.unknown_symbols(F.col("title"))).alias("lang"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(r, '^([^/?]*)', 1)), '^www\.', '') || regexp_extract(r, '^[^/?]*(.*)$', 1), '/+$', '') AS u
FROM (SELECT page_id, regexp_replace(regexp_replace(trim(url), '^[A-Za-z]+://', ''), '#.*$', '') AS r FROM pages)""")
def url_normalise(spark, d):
    return table(spark, d, "pages").select("page_id", S.normal_url(F.col("url")).alias("u"))


@query(f"""WITH {ARTICLES} SELECT file_name, replace(replace(replace(replace(title, chr(9), ' '), chr(10), ' '), chr(13), ' '), '"', '') AS t, strftime(make_timestamp(fetch_time * 1000000), '%-d %b %H:%M') AS shown FROM articles""")
def viewer_texts(spark, d):
    return articles(spark, d).select("file_name", S.clean_text(F.col("title")).alias("t"), S.short_date(F.col("fetch_time")).alias("shown"))


@query(f"""WITH {ARTICLES}, w AS (SELECT file_name, list_filter(string_split_regex(title, ' +'), lambda x: x <> '') AS t FROM articles)
SELECT file_name, array_to_string(t[1:len(t) // 2], ' ') AS first, array_to_string(t[len(t) // 2 + 1:], ' ') AS second FROM w""")
def text_halves(spark, d):
    return articles(spark, d).select("file_name", S.halves(F.col("title")).alias("h")).select("file_name", "h.first", "h.second")


# Filters.


@query(f"WITH {ARTICLES} SELECT file_name FROM articles WHERE category <> 'undefined' AND len(vector) > 0")
def docs_fully_indexed(spark, d):
    return filters.fully_indexed(articles(spark, d), F.col("vector")).select("file_name")


@query(f"WITH {ARTICLES} SELECT file_name, category FROM articles WHERE category NOT IN ('not_news', 'undefined')")
def docs_news(spark, d):
    return filters.news(articles(spark, d)).select("file_name", "category")


@query("SELECT doc_id FROM documents WHERE octet_length(encode(text)) >= 20")
def docs_min_length(spark, d):
    return filters.min_text_bytes(table(spark, d, "documents")).select("doc_id")


@query(f"WITH {ARTICLES} SELECT file_name, lang FROM articles WHERE lang IN ('en', 'de')")
def docs_language(spark, d):
    return filters.by_language(articles(spark, d), ("en", "de")).select("file_name", "lang")


@query(f"WITH {ARTICLES} SELECT file_name FROM articles WHERE fetch_time + ttl >= (SELECT max(fetch_time) FROM articles)")
def docs_not_stale(spark, d):
    return filters.not_stale(articles(spark, d)).select("file_name")


@query(f"WITH {ARTICLES}, t AS (SELECT thread_id, max(fetch_time) AS f FROM articles GROUP BY 1) SELECT thread_id, f AS freshest_ts FROM t WHERE f >= greatest((SELECT max(f) FROM t) - 86400, 0)")
def fresh_range(spark, d):
    t = articles(spark, d).groupBy("thread_id").agg(F.max("fetch_time").alias("freshest_ts"))
    return filters.fresh_range(t, 86400)


# Sinks.


@query(f"WITH {ARTICLES} SELECT lang AS lang_code, string_agg(file_name, ',' ORDER BY file_name) AS articles FROM articles GROUP BY 1")
def mode_languages(spark, d):
    return sinks.languages(articles(spark, d)).select("lang_code", joined("articles").alias("articles"))


@query(f"WITH {ARTICLES} SELECT string_agg(file_name, ',' ORDER BY file_name) AS articles FROM articles WHERE category <> 'not_news'")
def mode_news(spark, d):
    return sinks.news(filters.news(articles(spark, d))).select(joined("articles").alias("articles"))


@query(f"""WITH {ARTICLES}, c AS (SELECT unnest([{', '.join(repr(c) for c in CATEGORIES[2:-1])}]) AS category)
SELECT c.category, coalesce(string_agg(file_name, ',' ORDER BY file_name), '') AS articles FROM c LEFT JOIN articles a ON a.category = c.category GROUP BY 1""")
def mode_categories(spark, d):
    return sinks.categories(articles(spark, d)).select("category", joined("articles").alias("articles"))


@query(f"""WITH {ARTICLES} SELECT file_name, url, title, lang, category, fetch_time FROM articles""")
def mode_json(spark, d):
    rows = sinks.documents_json(articles(spark, d))
    back = F.from_json("json", "url string, title string, language string, category string, timestamp long").alias("j")
    return rows.select("file_name", back).select("file_name", "j.url", "j.title", F.col("j.language").alias("lang"), "j.category", F.col("j.timestamp").alias("fetch_time"))


@query(f"WITH {ARTICLES} SELECT file_name, '__label__' || category || ' ' || translate(title || ' ' || text, chr(10) || chr(13) || chr(9), '   ') AS value FROM articles")
def classifier_lines(spark, d):
    rows = articles(spark, d)
    lines = sinks.classifier_lines(rows.select("file_name", "category", "title", "text").select("category", F.concat("file_name", F.lit("|"), "title").alias("title"), "text"))
    v = F.col("value")
    name = F.regexp_extract(v, r"^__label__\S+ ([^|]*)\|", 1)
    return lines.select(name.alias("file_name"), F.regexp_replace(v, r"^(__label__\S+ )[^|]*\|", "$1").alias("value"))


# Lookups.


@query(f"WITH {ARTICLES}, {PAGERANK} SELECT file_name, round(coalesce(rating, 1.5e-5), 9) AS pagerank FROM articles LEFT JOIN pr USING (host)")
def pagerank_lookup(spark, d):
    return ratings.with_pagerank(articles(spark, d), pagerank_table(spark)).select("file_name", F.round("pagerank", 9).alias("pagerank"))


def members(spark, d, vectors_only=False):
    return ratings.with_traffic(filters.news(articles(spark, d, vectors_only)), traffic_table(spark))


@query(f"WITH {MEMBERS} SELECT file_name, round(raw, 9) AS raw FROM members")
def traffic_lookup(spark, d):
    return members(spark, d).select("file_name", F.round("raw", 9).alias("raw"))


@query(f"WITH {MEMBERS} SELECT file_name, share_us, share_gb, share_in, share_ru, share_au::DOUBLE AS share_au FROM members")
def country_share(spark, d):
    return members(spark, d).select("file_name", "share_us", "share_gb", "share_in", "share_ru", "share_au")


@query("SELECT min(rating) AS rating FROM (SELECT count(*) / 1000.0 AS rating FROM documents WHERE source IS NOT NULL GROUP BY source)")
def least_rating(spark, d):
    """Of hosts that are rated by their number of documents."""
    hosts = table(spark, d, "documents").where("source is not null").groupBy("source").agg((F.count("*") / 1000.0).alias("rating"))
    return ratings.least_rating(hosts)


@query("""SELECT c_mktsegment AS category, count(o_orderkey) AS n FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o ON o_custkey = c_custkey GROUP BY 1""")
def category_dim_left(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(F.col("c_mktsegment").alias("category")).agg(F.count("o_orderkey").alias("n"))


@query(f"WITH {ARTICLES} SELECT file_name, lang FROM articles WHERE lang IN ('en', 'fr')")
def semi_configured_lang(spark, d):
    configs = spark.createDataFrame([("en",), ("fr",), ("ru",)], "lang string")
    return articles(spark, d).join(configs, "lang", "left_semi").select("file_name", "lang")


@query("""WITH c AS (SELECT 'u' || l_orderkey AS first_url, 'u' || l_partkey AS second_url FROM lineitem), k AS (SELECT DISTINCT least('u' || l_partkey, 'u' || l_orderkey) AS a, greatest('u' || l_partkey, 'u' || l_orderkey) AS b FROM lineitem WHERE l_returnflag = 'R')
SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.a = least(c.first_url, c.second_url) AND k.b = greatest(c.first_url, c.second_url))""")
def anti_existing_pairs(spark, d):
    rows = table(spark, d, "lineitem")
    u = lambda c: F.concat(F.lit("u"), F.col(c).cast("string"))
    known = rows.where("l_returnflag = 'R'").select(u("l_partkey").alias("first_url"), u("l_orderkey").alias("second_url"))
    return markup.new_pairs(rows.select(u("l_orderkey").alias("first_url"), u("l_partkey").alias("second_url")), known)


@query("""SELECT o_orderkey, coalesce(c1, c2) AS category FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'sports' END AS c1, CASE WHEN o_orderstatus = 'O' AND o_orderpriority LIKE '1%' THEN 'economy' END AS c2 FROM orders) WHERE coalesce(c1, c2) IS NOT NULL""")
def tag_mapping(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("topic"), F.substring("o_orderpriority", 1, 1).alias("tag"))
    topics = spark.createDataFrame([("F", "sports")], "topic string, category string")
    tags = spark.createDataFrame([("O", "1", "economy")], "topic string, tag string, category string")
    return markup.map_tags(rows, tags, topics).select("o_orderkey", "category")


# Sets, versions, order.


@query(f"WITH {ARTICLES} SELECT DISTINCT host FROM articles")
def distinct_hosts(spark, d):
    return articles(spark, d).select("host").distinct()


@query(f"WITH {ARTICLES} SELECT file_name, category FROM articles UNION ALL SELECT file_name, 'any' FROM articles")
def fanout_any(spark, d):
    from ..operators.rank import fan_out

    return fan_out(articles(spark, d).select("file_name", "category"))


@query(f"WITH {ARTICLES} SELECT file_name, lang FROM articles WHERE lang = 'en' UNION ALL SELECT file_name, lang FROM articles WHERE lang = 'es'")
def union_langs(spark, d):
    a = articles(spark, d).select("file_name", "lang")
    return a.where("lang = 'en'").unionByName(a.where("lang = 'es'"))


@query("SELECT least(l_orderkey, l_partkey) AS a, greatest(l_orderkey, l_partkey) AS b FROM lineitem UNION SELECT least(l_orderkey, l_suppkey), greatest(l_orderkey, l_suppkey) FROM lineitem")
def pair_union(spark, d):
    rows = table(spark, d, "lineitem")
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    return rows.select(*pair("l_orderkey", "l_partkey")).union(rows.select(*pair("l_orderkey", "l_suppkey"))).distinct()


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def latest_version(spark, d):
    best = F.max_by(F.struct("event_id", "value"), "event_id")
    return table(spark, d, "events").groupBy("user_id").agg(best.alias("b")).select("user_id", "b.event_id", "b.value")


@query(f"WITH {ARTICLES} SELECT file_name, lag(file_name) OVER (PARTITION BY host ORDER BY fetch_time, file_name) AS previous FROM articles")
def prev_same_host(spark, d):
    return markup.previous_of_host(articles(spark, d).select("file_name", "host", "fetch_time")).select("file_name", "previous")


@query(f"""WITH {ARTICLES} SELECT file_name, category FROM articles
WHERE ('0x' || substr(md5(file_name), 1, 8))::BIGINT % 1000000 < CASE category WHEN 'sports' THEN 500000 WHEN 'science' THEN 100000 ELSE 1000000 END""")
def class_sample(spark, d):
    return filters.sample_by_class(articles(spark, d), "file_name", "category", {"sports": 0.5, "science": 0.1}).select("file_name", "category")
