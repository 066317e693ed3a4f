"""Term statistics, link graphs, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import embed, ratings, text
from ..operators.ngrams import NgramModel
from ..operators.svd import TruncatedSvd
from ..sources import readers
from ..storage import cut
from .registered import Registered
from .views import articles, headed, table

REGISTERED = query = Registered()
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')"


@query(f"""WITH t AS (SELECT DISTINCT doc_id, unnest({_WORDS}) AS token FROM documents), f AS (SELECT token, count(*) AS df FROM t GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY df DESC, token) AS k FROM f)
SELECT token, df, round(ln(((SELECT count(*) FROM documents) + 1) / (df + 1)), 4) AS idf FROM r WHERE k > 100 AND k <= 1100""")
def idf_table(spark, d):
    return text.idf_table(table(spark, d, "documents"), S.tokens(F.col("text")), 100, 1000).select("token", "df", F.round("idf", 4).alias("idf"))


@query(f"""WITH w AS (SELECT doc_id, {_WORDS} AS t FROM documents), l AS (SELECT doc_id, len(t) AS n, unnest(t) AS token FROM w), f AS (SELECT token, count(DISTINCT doc_id) AS df FROM l GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY df DESC, token) AS k FROM f), i AS (SELECT token, ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) AS idf FROM r WHERE k > 100 AND k <= 600)
SELECT doc_id, token, round(count(*) / min(n), 8) AS tf, round(count(*) / min(n) * min(idf), 8) AS tfidf FROM l JOIN i USING (token) GROUP BY 1, 2""")
def tfidf_vectors(spark, d):
    docs, words = table(spark, d, "documents"), S.tokens(F.col("text"))
    return text.tfidf(docs, words, text.idf_table(docs, words, 100, 500)).select("doc_id", "token", F.round("tf", 8).alias("tf"), F.round("tfidf", 8).alias("tfidf"))


@query(f"""WITH l AS (SELECT conv_id, turn, {_WORDS} AS t FROM conversations), p AS (SELECT conv_id, turn, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM l), f AS (SELECT token, count(*) AS n FROM p GROUP BY 1),
v AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) AS idx FROM f QUALIFY idx <= 50) SELECT conv_id * 1000 + turn AS id, pos, coalesce(idx, 0) AS idx FROM p LEFT JOIN v USING (token)""")
def vocab_lookup(spark, d):
    docs = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    words = S.tokens(F.col("text"))
    counts = docs.select(F.explode(words).alias("token")).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "token").limit(50)
    from pyspark.sql import Window as W

    vocabulary = counts.withColumn("idx", F.row_number().over(W.orderBy(F.col("n").desc(), "token")))
    return text.indexed(docs, words, vocabulary, "id").select("id", F.col("pos").cast("long").alias("pos"), F.col("idx").cast("long").alias("idx"))


def _linked(spark, d):
    i = F.col("o_orderkey")
    url = lambda k: F.concat(F.lit("https://h"), (k % 40).cast("string"), F.lit(".example.com/"), i.cast("string"))
    return table(spark, d, "orders").select(url(F.col("o_custkey")).alias("url"), F.array(url(i), url(F.floor(i / 7)), url(F.col("o_custkey"))).alias("links"))


_EDGES = """e AS (SELECT 'h' || s || '.example.com' AS src, 'h' || t || '.example.com' AS dst, count(*) AS n FROM (SELECT o_custkey % 40 AS s, unnest([o_orderkey % 40, (o_orderkey // 7) % 40, o_custkey % 40]) AS t FROM orders)
WHERE s <> t AND t IN (SELECT o_custkey % 40 FROM orders) GROUP BY 1, 2)"""


@query(f"WITH {_EDGES} SELECT * FROM e")
def host_links(spark, d):
    return ratings.host_links(_linked(spark, d)).select("src", "dst", "n")


@query(f"""WITH RECURSIVE {_EDGES}, g AS (SELECT * FROM e), v AS (SELECT DISTINCT src AS host FROM g), k AS (SELECT g.src, g.dst, g.n / sum(g.n) OVER (PARTITION BY g.src) AS p FROM g JOIN v ON v.host = g.dst),
c AS (SELECT count(*) AS n FROM v), m AS (SELECT a.host AS src, b.host AS dst, 0.7 * CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.src = a.host) THEN coalesce((SELECT p FROM k WHERE k.src = a.host AND k.dst = b.host), 0) ELSE 1.0 / (SELECT n FROM c) END + 0.3 / (SELECT n FROM c) AS p FROM v a, v b),
r(step, host, x) AS (SELECT 0, host, 1.0::DOUBLE / (SELECT n FROM c) FROM v UNION ALL SELECT r.step + 1, m.dst, sum(r.x * m.p)::DOUBLE FROM r JOIN m ON m.src = r.host WHERE r.step < 20 GROUP BY 1, 2)
SELECT host, round(x, 8) AS rating FROM r WHERE step = 20""")
def host_pagerank(spark, d):
    return ratings.pagerank(ratings.host_links(_linked(spark, d))).select("host", F.round("rating", 8).alias("rating"))


@query(r"SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title FROM pages")
def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", r"<h1>([^<]*)</h1>", 1).alias("title"))


@query(r"SELECT page_id, len(regexp_extract_all(html, '<p>')) AS n, array_to_string(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1), ' ') AS links FROM pages")
def html_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit("<p>"), 0)).cast("long").alias("n"), F.array_join(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1), " ").alias("links"))


@query(r"SELECT page_id, regexp_matches(html, '<html[ >]') AND regexp_matches(html, '<head[ >]') AND regexp_matches(html, '<meta[ >]') AND regexp_matches(html, '<body[ >]') AND regexp_matches(html, '<article[ >]') AS valid FROM pages")
def html_valid(spark, d):
    html = F.col("html")
    valid = html.rlike("<html[ >]")
    for tag in ("head", "meta", "body", "article"):
        valid = valid & html.rlike(f"<{tag}[ >]")
    return table(spark, d, "pages").select("page_id", valid.alias("valid"))


@query()
def html_paragraphs(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("file_name"), "html")
    return readers.parse_pages(pages, parse_links=True).select("file_name", "text", F.array_join("out_links", " ").alias("links"))


@query()
def hashed_vectors(spark, d):
    docs = headed(spark, d).select("file_name", "title", "text")
    return embed.HashedEmbedder("title", "avg").transform(docs).select("file_name", F.array_join(F.transform("vector", lambda x: F.round(x.cast("double"), 4).cast("string")), ",").alias("vector"))


_FOLD = "('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 10 = 0"
_GRAM = {1: "a[i]", 2: "a[i] * 1114112 + a[i + 1]", 3: "(a[i] * 1114112 + a[i + 1]) * 1114112 + a[i + 2]"}


@query(f"""WITH t AS (SELECT doc_id, lang, {_FOLD} AS held_out, [unicode(c)::BIGINT FOR c IN string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')] AS a FROM documents),
g AS ({' UNION ALL '.join(f"SELECT doc_id, lang, held_out, unnest([(({_GRAM[k]}) % 1000003 * 7919 + {k}) % 65536 FOR i IN range(1, len(a) - {k - 2})]) AS b FROM t" for k in (1, 2, 3))}),
d AS (SELECT doc_id, lang, held_out, b, count(*) AS n FROM g GROUP BY 1, 2, 3, 4), c AS (SELECT lang, b, sum(n)::DOUBLE AS n FROM d WHERE NOT held_out GROUP BY 1, 2), s AS (SELECT lang, sum(n) AS total FROM c GROUP BY 1),
p AS (SELECT lang, ln(count(*) / sum(count(*)) OVER ()) AS prior FROM t WHERE NOT held_out GROUP BY 1),
e AS (SELECT d.doc_id, s.lang, sum(d.n * ln((coalesce(c.n, 0) + 0.5) / (s.total + 0.5 * 65536))) AS score FROM d CROSS JOIN s LEFT JOIN c ON c.lang = s.lang AND c.b = d.b GROUP BY 1, 2),
r AS (SELECT t.doc_id, t.held_out, p.lang, p.prior + coalesce(e.score, 0) AS score FROM t CROSS JOIN p LEFT JOIN e ON e.doc_id = t.doc_id AND e.lang = p.lang)
SELECT doc_id, held_out, arg_max(lang, score) AS predicted FROM r GROUP BY 1, 2""")
def language_model(spark, d):
    """Languages of all documents by a model that has learned from nine tenths of them."""
    held = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 10 == 0
    rows = table(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("label"), held.alias("held_out"))
    return NgramModel().fit(rows.where(~F.col("held_out"))).transform(rows.drop("label")).select("doc_id", "held_out", "predicted")


@query()
def svd_documents(spark, d):
    """How much of each document's tf-idf vector the first 20 singular directions hold."""
    docs, words = table(spark, d, "documents"), S.tokens(F.col("text"))
    # Written, since the fit and the transform both read it.
    entries = cut(text.tfidf(docs, words, text.idf_table(docs, words, 100, 500)).select(F.col("doc_id").alias("row"), "token", F.col("tfidf").alias("x")))
    model = TruncatedSvd(20).fit(entries)
    held = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    return model.transform(entries).select(F.col("row").alias("doc_id"), F.round(F.sqrt(held), 4).alias("length"))
