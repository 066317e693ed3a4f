"""Readers that read back what was written, links and dates through the parser, and small operators, each over whole tables."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import filters, importance, linkage
from ..sources import readers, sinks
from ..storage import shared_dir
from ..streaming.keyed import KeyedTable
from .query_rows import members
from .query_threads import _DIST, _FREE, THETA, _importance_sql
from .registered import Registered
from .views import ARTICLES, MEMBERS, VECTORED, articles, headed, table

REGISTERED = query = Registered()
_HEADED = "h AS (SELECT doc_id, doc_id || '.html' AS file_name, 'https://www.' || source || '.example.com/' || doc_id AS url, source, lang, split_part(text, chr(10), 1) AS title, text FROM documents)"


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/written-{uuid.uuid4().hex}"


@query("WITH l AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'other' WHEN doc_id % 7 = 0 THEN 'undefined' WHEN doc_id % 11 = 0 THEN NULL ELSE lang END AS lang FROM documents) SELECT doc_id, lang FROM l WHERE lang NOT IN ('other', 'undefined')")
def docs_supported_language(spark, d):
    i = F.col("doc_id")
    lang = F.when(i % 5 == 0, "other").when(i % 7 == 0, "undefined").when(i % 11 == 0, F.lit(None)).otherwise(F.col("lang"))
    return filters.supported_language(table(spark, d, "documents").select("doc_id", lang.alias("lang")))


@query(f"WITH {_HEADED} SELECT file_name, url, title, NULL::VARCHAR AS kept FROM h UNION ALL SELECT file_name, url, title, md5(text) FROM h")
def texts_retained(spark, d):
    rows = headed(spark, d)
    dropped = filters.retain_texts(rows, False).withColumn("kept", F.lit(None).cast("string"))
    return dropped.unionByName(filters.retain_texts(rows, True).withColumn("kept", F.md5(F.col("text").cast("binary"))).drop("text"))


@query(f"WITH {_HEADED} SELECT file_name, md5(title || ' ' || text) AS \"all\", md5(title) AS title, md5(text) AS text FROM h")
def embedding_fields(spark, d):
    return headed(spark, d).select("file_name", *[F.md5(filters.embedding_field(k).cast("binary")).alias(k) for k in ("all", "title", "text")])


@query("SELECT doc_id, ('0x' || substr(md5('1:' || doc_id), 1, 8))::BIGINT % 1000000 < 900000 AS training FROM documents")
def train_val_split(spark, d):
    train, val = filters.split(table(spark, d, "documents").select("doc_id"), "doc_id")
    return train.withColumn("training", F.lit(True)).unionByName(val.withColumn("training", F.lit(False)))


@query(r"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL),
n AS (SELECT *, len(regexp_extract_all(p, '[^ \t\n\x0B\f\r]+')) AS n FROM p), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
SELECT doc_id, md5(string_agg(p || chr(10), '' ORDER BY k)) AS shrunk FROM b WHERE before < 200 GROUP BY 1""")
def text_shrink(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(S.shrink(F.split("text", "\n")).cast("binary")).alias("shrunk"))


@query(r"SELECT page_id, md5(array_to_string(regexp_extract_all(lower(translate(trim(html), chr(10) || chr(160), '  ')), '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]'), ' ')) AS text FROM pages")
def pages_preprocessed(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(S.preprocess(F.col("html")).cast("binary")).alias("text"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders")
def date_found(spark, d):
    day, k = F.col("o_orderdate"), F.col("o_orderkey")
    made = F.when(k % 3 == 0, F.date_format(day, "d MMM yyyy")).when(k % 3 == 1, F.date_format(day, "yyyy/MM/dd")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    text = F.concat_ws(" ", "o_orderpriority", F.lit("of"), made, F.lit("in all"))
    return table(spark, d, "orders").select("o_orderkey", S.find_date(text).alias("date"))


def _article_json(spark, d):
    """Every article as a JSON object; one in thirteen has no site name and one in seventeen is cut off."""
    i = F.regexp_extract("file_name", "^([0-9]+)", 1).cast("long")
    rows = headed(spark, d).withColumn("i", i)
    own = F.struct("url", F.when(F.col("i") % 13 != 0, F.lit("s")).alias("site_name"), F.col("i").alias("timestamp"), "title", F.lit("").alias("description"), "text", "file_name")
    return rows.select("i", F.to_json(own).alias("json"))


_READ = f"WITH {_HEADED} SELECT file_name, url, title, md5(text) AS text, doc_id AS fetch_time FROM h WHERE doc_id % 13 <> 0"


def _seen(rows):
    return rows.select("file_name", "url", "title", F.md5(F.col("text").cast("binary")).alias("text"), "fetch_time")


@query(f"{_READ} AND doc_id % 17 <> 0")
def jsonl_articles(spark, d):
    """JSON lines, some of them malformed, written and read back."""
    at = f"{_folder(spark)}.jsonl"
    rows = _article_json(spark, d)
    rows.select(F.when(F.col("i") % 17 == 0, F.left("json", F.length("json") - 1)).otherwise(F.col("json")).alias("value")).write.text(at)
    return _seen(readers.read_articles(spark, at))


@query(_READ)
def json_articles(spark, d):
    """JSON arrays of articles, a file for each twentieth or so, written and read back."""
    at = f"{_folder(spark)}.json"
    rows = _article_json(spark, d).groupBy((F.col("i") / 20).cast("long").alias("k")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("json"), ","), F.lit("]")).alias("value"))
    rows.write.partitionBy("k").text(at)
    return _seen(readers.read_articles(spark, at))


@query("SELECT source || '.example.com' AS host, round(avg(length(text)) / 1000, 6) AS rating FROM documents WHERE source IS NOT NULL GROUP BY 1")
def pagerank_file(spark, d):
    """Ratings of hosts, here by the length of their texts, written as lines and read back."""
    at = _folder(spark)
    rows = table(spark, d, "documents").where("source is not null").groupBy(F.concat("source", F.lit(".example.com")).alias("host")).agg((F.avg(F.length("text")) / 1000).alias("rating"))
    sinks.write_lines(rows.select(F.concat_ws("\t", F.col("rating").cast("string"), "host").alias("value")), at)
    return readers.read_pagerank(spark, at).select("host", F.round("rating", 6).alias("rating"))


@query("SELECT source || '.example.com' AS host, count(*)::DOUBLE AS rating, count(*) FILTER (lang = 'en')::DOUBLE AS us, count(*) FILTER (lang = 'de')::DOUBLE AS gb FROM documents WHERE source IS NOT NULL GROUP BY 1")
def traffic_file(spark, d):
    """Ratings with shares by country, here counts by language, written as JSON arrays and read back."""
    at = _folder(spark)
    count = lambda lang: F.sum((F.col("lang") == lang).cast("int")).cast("double")
    rows = table(spark, d, "documents").where("source is not null").groupBy("source").agg(F.count("*").cast("double").alias("rating"), F.create_map(F.lit("US"), count("en"), F.lit("GB"), count("de")).alias("country"))
    own = F.to_json(F.struct(F.concat("source", F.lit(".example.com")).alias("host"), "rating", "country"))
    files = rows.groupBy(F.substring(F.md5(F.col("source").cast("binary")), 1, 1).alias("k")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(own), ","), F.lit("]")).alias("value"))
    files.write.partitionBy("k").text(at)
    return readers.read_traffic(spark, at).select("host", "rating", F.col("country")["US"].alias("us"), F.col("country")["GB"].alias("gb"))


@query("""SELECT l_orderkey AS order_id, l_linenumber AS line, l_returnflag AS quality, l_comment AS text FROM (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus || ' "x" ' || l_partkey AS l_comment FROM lineitem)""")
def markup_file(spark, d):
    """Crowd-task rows with their prefixes, quotes included, written and read back."""
    at = _folder(spark)
    text = F.concat("l_linestatus", F.lit(' "x" '), F.col("l_partkey").cast("string"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("INPUT:order_id"), F.col("l_linenumber").alias("INPUT:line"), F.col("l_returnflag").alias("OUTPUT:quality"), text.alias("INPUT:text"))
    sinks.write_markup(rows, at)
    return readers.read_markup(spark, at).select(F.col("order_id").cast("long").alias("order_id"), F.col("line").cast("int").alias("line"), "quality", "text")


@query("SELECT title, md5(text) AS text, site_name, date FROM (SELECT o_orderpriority || ' ' || o_orderkey AS title, 'line' || chr(10) || '\"' || o_totalprice::DECIMAL(18, 2) || '\"' AS text, o_orderstatus AS site_name, CASE WHEN o_orderkey % 9 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders) WHERE date IS NOT NULL")
def news_csv(spark, d):
    """CSV with texts that span lines, written and read back; rows without a date go."""
    at = _folder(spark)
    text = F.concat(F.lit('line\n"'), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit('"'))
    date = F.when(F.col("o_orderkey") % 9 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("")
    rows = table(spark, d, "orders").select(F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("title"), text.alias("content"), F.col("o_orderstatus").alias("publication"), date.alias("date"))
    rows.write.option("header", "true").option("quote", '"').option("escape", '"').csv(at)
    return readers.read_news_csv(spark, at).select("title", F.md5(F.col("text").cast("binary")).alias("text"), "site_name", "date")


@query("SELECT conv_id, turn, md5(role || ' ' || text) AS text FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL")
def headline_lines(spark, d):
    """JSON lines of headlines and descriptions, written and read back."""
    at = _folder(spark)
    head = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role")
    rows = table(spark, d, "conversations").where("text is not null and role is not null")
    rows.select(head.alias("headline"), F.col("text").alias("short_description")).write.json(at)
    part = F.split("title", "/")
    whole = F.concat(part[2], F.substring("text", F.length("title") + 1, F.length("text")))
    return readers.read_headlines(spark, at).select(part[0].cast("long").alias("conv_id"), part[1].cast("long").alias("turn"), F.md5(whole.cast("binary")).alias("text"))


@query(r"""WITH p AS (SELECT page_id, string_split(url, '/') AS u FROM pages WHERE regexp_matches(html, '<html[ >]') AND regexp_matches(html, '<head[ >]') AND regexp_matches(html, '<body[ >]') AND regexp_matches(html, '<article[ >]'))
SELECT page_id::VARCHAR AS file_name, 'by ' || page_id AS author, 1600000000 + 60 * page_id AS pub_time, 1600000000 + 60 * page_id + 3600 AS fetch_time, '/a/' || page_id || ' /b?x=' || page_id AS links FROM p""")
def article_links(spark, d):
    """Links, author and times through the parser: every page's article gets an address, and a paragraph with two links in
    place of its own paragraphs."""
    i = F.col("page_id").cast("string")
    when = lambda zone, shift: F.concat(F.date_format(F.timestamp_seconds(1600000000 + 60 * F.col("page_id") + shift), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(zone))
    meta = F.concat(F.lit('<head><meta property="article:published_time" content="'), when("+00:00", 3600), F.lit('">'))
    own = F.concat(F.lit('<article><address><time datetime="'), when("+01:00", 3600), F.lit('"></time><a rel="author" href="/who">by '), i, F.lit('</a></address><p>See <a href="/a/'), i, F.lit('">a</a> and <b><a href="/b?x='), i, F.lit('">b</a></b>.</p></article>'))
    html = F.replace(F.regexp_replace("html", r"(?s)<article[ >].*</article>", "<!--own-->"), F.lit("<!--own-->"), own)
    rows = table(spark, d, "pages").where(F.col("html").rlike("<article[ >]")).select(i.alias("file_name"), F.replace(html, F.lit("<head>"), meta).alias("html"))
    return readers.parse_pages(rows, parse_links=True).select("file_name", "author", "pub_time", "fetch_time", F.array_join("out_links", " ").alias("links"))


_COMBOS = importance.COMBINATIONS
_LAST = [k for k, c in enumerate(_COMBOS) if c[2] == importance.DECAYS[-1]]
_COUNTRIES = ("us", "gb", "in", "ru", "ca", "au")


def _weight_sql(kind: str, shift: float) -> str:
    inner = f"raw * (100.0 - share_us - share_gb) / 100.0 + {shift}"
    return {"one": "1.0", "raw": "raw * (100.0 - share_us - share_gb) / 100.0"}.get(kind, f"CASE WHEN {inner} > 0 THEN greatest(ln({inner}), 0.3) ELSE 0.3 END")


def _vector_sql() -> str:
    shares = ", ".join(f"round((sum(share_{c} * w{k}) / sum(w{k}))::DOUBLE, 5) AS s{k}_{c}" for k in _LAST for c in _COUNTRIES)
    weights = ", ".join(f"{_weight_sql(*_COMBOS[k][:2])} AS w{k}" for k in _LAST)
    cols, n = [], 0
    for k in range(len(_COMBOS)):
        for value in [f"round(best_{k}.importance, 5)"] + ([f"s{k}_{c}" for c in _COUNTRIES] if k in _LAST else []):
            cols.append(f"{value} AS f{n}")
            n += 1
    joins = " ".join(f"JOIN best_{k} USING (thread_id)" for k in range(len(_COMBOS)))
    best = ", ".join(_importance_sql(*c, f"_{k}") for k, c in enumerate(_COMBOS))
    return f"WITH {MEMBERS}, {best}, shares AS (SELECT thread_id, {shares} FROM (SELECT *, {weights} FROM members) GROUP BY 1) SELECT thread_id, {', '.join(cols)} FROM shares {joins}"


@query(_vector_sql())
def importance_vector(spark, d):
    """All 50 features of every thread."""
    f = importance.features(members(spark, d))
    return f.select("thread_id", *[F.round(F.col("features")[i], 5).alias(f"f{i}") for i in range(50)])


_SIZE, _STEP = 60, 40


@query(f"""WITH RECURSIVE {VECTORED}, s AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY fetch_time DESC, file_name DESC) - 1 AS seq FROM articles),
k AS (SELECT *, greatest(ceil((seq - {_SIZE} + 1) / {_STEP}.0), 0) AS low, floor(seq / {_STEP}.0) AS high FROM s),
p AS (SELECT a.lang, a.seq AS a, b.seq AS b FROM k a JOIN k b ON a.lang = b.lang AND a.seq < b.seq AND greatest(a.low, b.low) <= least(a.high, b.high) WHERE {_DIST} <= {THETA}), e AS (SELECT lang, a, b FROM p UNION SELECT lang, b, a FROM p),
r(lang, n, m) AS (SELECT lang, a, a FROM e UNION SELECT e.lang, e.b, r.m FROM r JOIN e ON e.lang = r.lang AND e.a = r.n),
c AS (SELECT lang, n, min(m) AS m FROM r GROUP BY 1, 2) SELECT s.lang, s.file_name, coalesce(c.m, s.seq) AS thread_id FROM s LEFT JOIN c ON c.lang = s.lang AND c.n = s.seq""")
def chunk_components(spark, d):
    """Without limits on threads, chunks that overlap: pairs within a chunk, and threads of chunks that share a document."""
    cfg = replace(_FREE, chunk_size=_SIZE, chunk_overlap=_SIZE - _STEP)
    return linkage.threads(articles(spark, d, True), cfg).select("lang", "file_name", F.col("thread_id").cast("long").alias("thread_id"))


@query(f"WITH {ARTICLES} SELECT file_name, category FROM articles WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0")
def store_lookup(spark, d):
    """A keyed table after an insert and a delete, asked for all keys."""
    rows, i = articles(spark, d).select("doc_id", "file_name", "category"), F.col("doc_id")
    store = KeyedTable(spark, _folder(spark), parts=8)
    store.apply(rows.drop("doc_id"))
    store.apply(rows.limit(0).drop("doc_id"), rows.where((i % 3 == 0) & (i % 2 != 0)).select("file_name"))
    return store.lookup(rows.select("file_name"))
