"""Markup repair, language files, load requests, categories by language, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotate, filters, markup
from ..operators.order import position
from ..sources import readers, sinks
from ..streaming import load
from .registered import Registered
from .views import ARTICLES, articles, headed, table

REGISTERED = query = Registered()

_HEADED = "r AS (SELECT doc_id || '.html' AS file_name, 'https://www.' || source || '.example.com/' || doc_id AS url, split_part(text, chr(10), 1) AS title, text, lang FROM documents)"
_CLEAN = "replace(translate(title, chr(9) || chr(10) || chr(13), '   '), '\"', '')"


@query(f"WITH {_HEADED}, o AS (SELECT {_CLEAN} AS t, max(url) AS url FROM r GROUP BY 1) SELECT file_name, o.url FROM r JOIN o ON o.t = {_CLEAN}")
def restored_urls(spark, d):
    """Answers know titles only; the originals have the urls."""
    rows = headed(spark, d)
    return markup.restore_urls(rows.select("file_name", "title"), rows.select("title", "url")).select("file_name", "url")


@query(f"WITH {ARTICLES} SELECT file_name FROM articles WHERE lang IN ('en', 'es')")
def language_file(spark, d):
    rows = articles(spark, d)
    return filters.in_language_file(rows, sinks.languages(rows), ("en", "es")).select("file_name")


def _draw(salt: str, n: int) -> str:
    return f"(('0x' || substr(md5('{salt}:' || file_name), 1, 8))::BIGINT % {n})"


def _pick(salt: str, names: tuple) -> str:
    return f"([{', '.join(repr(x) for x in names)}])[1 + {_draw(salt, len(names))}]"


@query(f"""WITH {_HEADED}, i AS (SELECT *, row_number() OVER (ORDER BY file_name) - 1 AS i FROM r), d AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS k FROM i WHERE {_draw('delete', 1000000)} < 50000)
SELECT 3 * i AS seq, 'PUT' AS method, '/' || file_name AS target, 'max-age=' || ({_draw('ttl', load.TTL[1] - load.TTL[0] + 1)} + {load.TTL[0]}) AS cache_control, title AS body FROM i
UNION ALL SELECT 3 * d.i + 1, 'DELETE', '/' || i.file_name, NULL, NULL FROM d JOIN i ON i.i = d.k
UNION ALL SELECT 3 * i + 2, 'GET', '/threads?period=' || ({_draw('period', load.PERIOD[1] - load.PERIOD[0] + 1)} + {load.PERIOD[0]}) || '&lang_code=' || {_pick('lang', load.LANGUAGES)} || '&category=' || {_pick('category', load.CATEGORIES)}, NULL, NULL
FROM i WHERE {_draw('threads', 1000000)} < 50000""")
def load_requests(spark, d):
    return load.requests(headed(spark, d).select("file_name", F.col("title").alias("body")))


#: Words of the tables' invented languages, so that each lexicon finds some.
LEXICONS = {"en": {"sports": ("the", "of"), "economy": ("and", "to")}, "de": {"science": ("der", "und"), "society": ("die", "nicht")}}


def _hits(words: tuple) -> str:
    return f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in words)})))"


def _label(lexicon: dict) -> str:
    """Two labels by name: the first wins ties."""
    (a, x), (b, y) = sorted(lexicon.items())
    return f"CASE WHEN {_hits(x)} + {_hits(y)} = 0 THEN 'other' WHEN {_hits(x)} >= {_hits(y)} THEN '{a}' ELSE '{b}' END"


@query(f"""WITH {_HEADED}, w AS (SELECT file_name, lang, regexp_extract_all(lower(title || ' ' || text), '[\\p{{L}}\\p{{N}}]+|[^\\s\\p{{L}}\\p{{N}}]') AS w FROM r)
SELECT file_name, CASE lang {' '.join(f"WHEN '{k}' THEN {_label(v)}" for k, v in LEXICONS.items())} ELSE 'other' END AS category FROM w""")
def category_by_language(spark, d):
    rows = headed(spark, d).join(table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".html")).alias("file_name"), "lang"), "file_name")
    return annotate.by_language(LEXICONS)(rows).select("file_name", "category")


@query(f"""WITH {ARTICLES}, a AS (SELECT lang, category, url, row_number() OVER (PARTITION BY lang, category ORDER BY url) AS k FROM articles WHERE category <> 'not_news')
SELECT lang, category, '<html><head><meta charset="utf-8"><title>' || category || '</title></head><body>' || string_agg('<h2>' || category || ' ' || k || '</h2><ul><li><a href="' || url || '">' || url || '</a></li></ul>', chr(10) ORDER BY k) || '</body></html>' AS html FROM a GROUP BY 1, 2""")
def rubric_pages(spark, d):
    """A page for each language and category, here with a heading for each article."""
    rows = position(filters.news(articles(spark, d)).select("lang", "category", "url"), ("lang", "category"), ["url"], "rank")
    rows = rows.select("lang", "category", (F.col("rank") + 1).alias("rank"), F.array("url").alias("articles"))
    return sinks.rubric_pages(rows.withColumn("title", F.concat_ws(" ", "category", F.col("rank").cast("string"))))


@query(r"""WITH a AS (SELECT page_id, replace(html, '<head>', '<head><meta property="og:title" content="t' || page_id || '"><meta property="og:url" content="' || url || '">') AS html, url FROM pages)
SELECT page_id::VARCHAR AS file_name, 't' || page_id AS title, url, len(regexp_extract_all(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p[ >]')) AS paragraphs FROM a
WHERE regexp_matches(html, '<html[ >]') AND regexp_matches(html, '<head[ >]') AND regexp_matches(html, '<body[ >]') AND regexp_matches(html, '<article[ >]')""")
def html_articles(spark, d):
    """The parser over all pages, each given the properties that articles have."""
    head = F.concat(F.lit('<head><meta property="og:title" content="t'), F.col("page_id").cast("string"), F.lit('"><meta property="og:url" content="'), "url", F.lit('">'))
    rows = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("file_name"), F.replace("html", F.lit("<head>"), head).alias("html"))
    return readers.parse_pages(rows).select("file_name", "title", "url", F.regexp_count("text", F.lit("\n")).cast("long").alias("paragraphs"))
