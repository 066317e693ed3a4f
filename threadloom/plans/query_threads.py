"""Pairs, components, threads, importance and ranking over the article view."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..config import EN_CLUSTERING, RankerConfig
from ..functions import scalars as S
from ..operators import importance as imp
from ..operators import linkage, pairs, ratings, threads
from ..operators.rank import rank
from ..schema import COUNTRIES
from ..sources import sinks
from .query_rows import members
from .registered import Registered, sig
from .views import ARTICLES, MEMBERS, PAGERANK, VECTORED, articles, pagerank_table

REGISTERED = query = Registered()
joined = lambda c: F.array_join(c, ",")

_DIST = "greatest(1 - (list_cosine_similarity(CAST(a.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[])) + 1) / 2, 0)"
_PAIR = f"SELECT a.doc_id AS a, b.doc_id AS b, {_DIST} AS dist, a.fetch_time AS ta, b.fetch_time AS tb FROM articles a JOIN articles b ON a.lang = b.lang AND a.doc_id < b.doc_id"
THETA = 0.33


@query(f"WITH {VECTORED}, p AS ({_PAIR}) SELECT a, b, round(dist, 6) AS dist FROM p WHERE dist <= {THETA}")
def cosine_pairs(spark, d):
    return pairs.cosine_pairs(articles(spark, d, True), THETA, "doc_id", ("lang",)).select("a", "b", F.round("dist", 6).alias("dist"))


_NEAR = _PAIR.replace(" AS dist,", f" AS dist, round(0.5 * {_DIST} + 0.5 * {_DIST.replace('vector', 'vector[1:32]')}, 6) AS weighted,")


@query(f"WITH {VECTORED}, p AS ({_NEAR}) SELECT a, b, weighted AS dist FROM p WHERE dist <= {THETA}")
def weighted_distance(spark, d):
    """Both distances of a pair are taken where its rows meet, so that none is joined with its vectors."""
    near = pairs.cosine_pairs(articles(spark, d, True), THETA, "doc_id", ("lang",), heads=(32,))
    return near.select("a", "b", F.round(0.5 * F.col("dist") + 0.5 * F.col("head_32"), 6).alias("dist"))


@query(f"WITH {VECTORED}, p AS ({_PAIR}) SELECT a, b, round(least(dist * CASE WHEN abs(ta - tb) / 3600.0 >= 24 THEN abs(ta - tb) / 3600.0 / 24.0 ELSE 1 END, 1.0), 6) AS dist FROM p WHERE dist <= {THETA}")
def time_penalty_distance(spark, d):
    """Pairs carry the times of their documents, so that none is joined with them."""
    near = pairs.cosine_pairs(articles(spark, d, True), THETA, "doc_id", ("lang",), carry=("fetch_time",))
    return near.select("a", "b", F.round(S.time_penalty(F.col("dist"), F.col("fetch_time_a"), F.col("fetch_time_b")), 6).alias("dist"))


@query(f"""WITH RECURSIVE {VECTORED}, p AS ({_PAIR}), e AS (SELECT a, b FROM p WHERE dist <= {THETA} UNION SELECT b, a FROM p WHERE dist <= {THETA}),
r(n, m) AS (SELECT a, a FROM e UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.n) SELECT n AS doc_id, min(m) AS comp FROM r GROUP BY 1""")
def threshold_components(spark, d):
    return pairs.near_components(articles(spark, d, True), THETA, "doc_id", ("lang",))


_LOOSE = replace(EN_CLUSTERING, small_threshold=0.36, medium_threshold=0.35, large_threshold=0.34, small_size=3, medium_size=5, large_size=8)


def _threads(spark, d, cfg):
    return linkage.threads(articles(spark, d, True), cfg)


@query()
def constrained_threads(spark, d):
    return _threads(spark, d, _LOOSE)


@query()
def chunk_stitch(spark, d):
    return _threads(spark, d, replace(_LOOSE, chunk_size=60, chunk_overlap=20))


_FREE = replace(EN_CLUSTERING, small_threshold=THETA, small_size=10**9, ban_same_sites=False, budget="unbounded", chunk_size=10**9, chunk_overlap=0)  # no limit at all: threads are the components


@query(f"""WITH RECURSIVE {VECTORED}, s AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY fetch_time DESC, file_name DESC) - 1 AS seq FROM articles),
p AS (SELECT a.lang, a.seq AS a, b.seq AS b FROM s a JOIN s b ON a.lang = b.lang AND a.seq < b.seq WHERE {_DIST} <= {THETA}), e AS (SELECT lang, a, b FROM p UNION SELECT lang, b, a FROM p),
r(lang, n, m) AS (SELECT lang, a, a FROM e UNION SELECT e.lang, e.b, r.m FROM r JOIN e ON e.lang = r.lang AND e.a = r.n),
c AS (SELECT lang, n, min(m) AS m FROM r GROUP BY 1, 2) SELECT s.lang, s.file_name, coalesce(c.m, s.seq) AS thread_id FROM s LEFT JOIN c ON c.lang = s.lang AND c.n = s.seq""")
def cluster_ids(spark, d):
    return _threads(spark, d, _FREE).select("lang", "file_name", F.col("thread_id").cast("long").alias("thread_id"))


@query()
def mode_threads(spark, d):
    labels = _threads(spark, d, _LOOSE).withColumn("_t", F.concat_ws("-", "lang", "thread_id")).select("file_name", "_t", "seq")
    rows = articles(spark, d).join(labels, "file_name").select(F.col("_t").alias("thread_id"), F.col("seq").alias("pos"), "title", "file_name")
    return sinks.threads(rows).select("thread_id", "title", joined("articles").alias("articles"))


@query(f"""WITH {ARTICLES}, c AS (SELECT thread_id, category, count(*) AS n, min(list_position(['society', 'economy', 'technology', 'sports', 'entertainment', 'science', 'other'], category)) AS o FROM articles WHERE category <> 'not_news' GROUP BY 1, 2)
SELECT thread_id, category FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY n DESC, o) AS k FROM c) WHERE k = 1""")
def thread_category(spark, d):
    return threads.category(articles(spark, d).where("category <> 'not_news'"))


@query(f"WITH {ARTICLES} SELECT thread_id, count(*) AS size, max(fetch_time) AS freshest_ts FROM articles GROUP BY 1")
def thread_freshest(spark, d):
    return threads.freshest(articles(spark, d))


_RELEVANCE = "SELECT a.file_name, avg(list_cosine_similarity(CAST(a.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[]))) AS relevance FROM articles a JOIN articles b ON a.thread_id = b.thread_id GROUP BY 1"


@query(f"WITH {VECTORED} SELECT file_name, round(relevance, 6) AS relevance FROM ({_RELEVANCE})")
def doc_relevance(spark, d):
    return threads.relevance(articles(spark, d, True)).select("file_name", F.round("relevance", 6).alias("relevance"))


_NASTY = """((lang = 'en' AND octet_length(encode(title)) < 16) OR right(title, 1) IN ('!', '?', '.', ' ') OR starts_with(title, '"') OR length(title) - length(replace(title, ' ', '')) < 2)"""
_WEIGHT = f"""(coalesce(rating, 1.5e-5) + relevance) * {sig('(fetch_time - max(fetch_time) OVER (PARTITION BY thread_id)) / 3600.0 + 12.0')} * CASE WHEN {_NASTY} THEN 0.5 ELSE 1.0 END"""


@query(f"""WITH {VECTORED}, {PAGERANK}, rel AS ({_RELEVANCE}), w AS (SELECT thread_id, file_name, title, {_WEIGHT} AS weight FROM articles JOIN rel USING (file_name) LEFT JOIN pr USING (host))
SELECT thread_id, file_name, round(weight, 6) AS weight, row_number() OVER (PARTITION BY thread_id ORDER BY round(weight, 6) DESC, title, file_name) AS pos FROM w""")
def headline(spark, d):
    rows = ratings.with_pagerank(threads.relevance(articles(spark, d, True)), pagerank_table(spark)).withColumn("nasty", S.nasty(F.col("title"), F.col("lang")))
    return threads.headlines(rows).select("thread_id", "file_name", F.round("weight", 6).alias("weight"), F.col("pos").cast("long").alias("pos"))


_C = ("us", "gb", "in", "ru", "ca", "au")
_LOG = "CASE WHEN raw * (100.0 - share_us - share_gb) / 100.0 + 1.0 > 0 THEN greatest(ln(raw * (100.0 - share_us - share_gb) / 100.0 + 1.0), 0.3) ELSE 0.3 END"


@query(f"WITH {MEMBERS} SELECT thread_id, {', '.join(f'round(avg(share_{c})::DOUBLE, 6) AS share_{c}, round((sum(share_{c} * w) / sum(w))::DOUBLE, 6) AS w_share_{c}' for c in _C)} FROM (SELECT *, {_LOG} AS w FROM members) GROUP BY 1")
def country_shares(spark, d):
    return imp.country_shares(members(spark, d)).select("thread_id", *[F.round(f"{p}share_{c.lower()}", 6).alias(f"{p}share_{c.lower()}") for c in COUNTRIES for p in ("", "w_")])


def _importance_sql(kind: str = "log", shift: float = 1.0, decay: float = 3600.0, tag: str = "") -> str:
    """CTEs that end in best{tag}(thread_id, importance, best_ts)."""
    inner = f"raw * (100.0 - share_us - share_gb) / 100.0 + {shift}"
    w = {"one": "1.0", "raw": "raw * (100.0 - share_us - share_gb) / 100.0"}.get(kind, f"CASE WHEN {inner} > 0 THEN greatest(ln({inner}), 0.3) ELSE 0.3 END")
    return f"""ranked{tag} AS (SELECT *, {w} AS w, row_number() OVER (PARTITION BY thread_id ORDER BY fetch_time, url) AS i FROM members),
met{tag} AS (SELECT a.thread_id, a.i, a.fetch_time AS s, b.fetch_time AS t, b.w, row_number() OVER (PARTITION BY a.thread_id, a.i, b.host ORDER BY b.i) AS k FROM ranked{tag} a JOIN ranked{tag} b ON a.thread_id = b.thread_id AND b.i >= a.i),
sums{tag} AS (SELECT thread_id, i, min(s) AS s, sum(w * {sig(f'greatest((s - t) / {decay}, -15.0)')}) AS v FROM met{tag} WHERE k = 1 GROUP BY 1, 2),
best{tag} AS (SELECT thread_id, v AS importance, s AS best_ts FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY round(v, 10) DESC, i) AS k FROM sums{tag}) WHERE k = 1)"""


@query(f"WITH {MEMBERS}, {_importance_sql()} SELECT thread_id, round(importance, 6) AS importance, best_ts FROM best")
def importance(spark, d):
    return imp.importance(members(spark, d)).select("thread_id", F.round("importance", 6).alias("importance"), "best_ts")


@query(f"""WITH {MEMBERS}, {_importance_sql('log', 1.0, 1800.0, 'a')}, {_importance_sql('raw', 0.0, 86400.0, 'b')}, {_importance_sql('one', 0.0, 7200.0, 'c')}
SELECT thread_id, round(besta.importance, 5) AS f0, round(bestb.importance, 5) AS f33, round(bestc.importance, 5) AS f42, 50 AS n FROM besta JOIN bestb USING (thread_id) JOIN bestc USING (thread_id)""")
def importance_features(spark, d):
    f = imp.features(members(spark, d))
    return f.select("thread_id", *[F.round(F.col("features")[i], 5).alias(f"f{i}") for i in (0, 33, 42)], F.size("features").alias("n"))


def _thread_table(rows):
    main = imp.importance(rows).drop("combo")
    return threads.freshest(rows).join(threads.category(rows), "thread_id").join(main, "thread_id").withColumn("lang_ord", F.when(F.col("thread_id").startswith("en"), 0).otherwise(1))


_CLOCK = "(SELECT fetch_time FROM (SELECT fetch_time, row_number() OVER (ORDER BY fetch_time) - 1 AS k, count(*) OVER () AS n FROM members) WHERE k = least(CAST(floor(0.9900000095367432 * n) AS BIGINT), n - 1))"
_RANKED = f"""{MEMBERS}, {_importance_sql()}, size AS (SELECT thread_id, count(*) AS size, max(fetch_time) AS freshest_ts FROM members GROUP BY 1),
votes AS (SELECT thread_id, category, count(*) AS n, min(list_position(['society', 'economy', 'technology', 'sports', 'entertainment', 'science', 'other'], category)) AS o FROM members GROUP BY 1, 2),
cat AS (SELECT thread_id, category FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY n DESC, o) AS k FROM votes) WHERE k = 1),
aged AS (SELECT *, CASE WHEN thread_id LIKE 'en%' THEN 0 ELSE 1 END AS lang_ord, CASE WHEN best_ts + 28800 < {_CLOCK} THEN {sig(f'(best_ts + 28800 - {_CLOCK}) / 3600.0 + 8.0')} ELSE 1.0 END AS age_penalty FROM best JOIN size USING (thread_id) JOIN cat USING (thread_id)),
fan AS (SELECT * FROM aged UNION ALL SELECT * REPLACE ('any' AS category) FROM aged),
ranked_threads AS (SELECT *, importance * age_penalty AS weight, row_number() OVER (PARTITION BY category ORDER BY least(size, 3) DESC, round(importance * age_penalty, 9) DESC, lang_ord, freshest_ts, thread_id) AS rank FROM fan)"""


@query(f"WITH {MEMBERS} SELECT {_CLOCK} AS iter_ts")
def iter_timestamp(spark, d):
    return threads.nth_timestamp(members(spark, d))


@query(f"WITH {ARTICLES} SELECT fetch_time AS iter_ts FROM (SELECT fetch_time, row_number() OVER (ORDER BY fetch_time) - 1 AS k, count(*) OVER () AS n FROM articles) WHERE k = CAST(floor(0.9 * (n - 1)) AS BIGINT)")
def cluster_percentile(spark, d):
    return threads.nth_timestamp(articles(spark, d), 0.9, "n - 1")


def ranked(rows, limit=None):
    return rank(_thread_table(rows), threads.nth_timestamp(rows), RankerConfig(), limit)


@query(f"WITH {_RANKED} SELECT category, rank, thread_id, size, best_ts, round(age_penalty, 6) AS age_penalty, round(weight, 6) AS weight FROM ranked_threads")
def rank_threads(spark, d):
    return ranked(members(spark, d)).select("category", F.col("rank").cast("long").alias("rank"), "thread_id", "size", "best_ts", F.round("age_penalty", 6).alias("age_penalty"), F.round("weight", 6).alias("weight"))


@query(f"WITH {_RANKED} SELECT rank, thread_id FROM ranked_threads WHERE category = 'any' AND freshest_ts >= (SELECT max(freshest_ts) - 345600 FROM size) AND rank <= 10")
def top_k_period(spark, d):
    rows = members(spark, d)
    top = ranked(rows, 10).where("category = 'any'")
    newest = threads.freshest(rows).agg(F.max("freshest_ts").alias("_m"))
    return top.join(F.broadcast(newest), F.col("freshest_ts") >= F.col("_m") - 345600).select(F.col("rank").cast("long").alias("rank"), "thread_id")


@query(f"""WITH {_RANKED.replace(ARTICLES, VECTORED)}, {PAGERANK}, rel AS ({_RELEVANCE.replace('articles', 'members')}),
w AS (SELECT m.*, {_WEIGHT} AS weight FROM members m JOIN rel USING (file_name) LEFT JOIN pr USING (host)),
o AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY round(weight, 6) DESC, title, file_name) AS pos FROM w),
h AS (SELECT thread_id, min(CASE WHEN pos = 1 THEN title END) AS title, string_agg(file_name, ',' ORDER BY pos) AS articles FROM o GROUP BY 1)
SELECT category, rank, thread_id, title, articles, size, round(importance, 6) AS importance, best_ts, round(age_penalty, 6) AS age_penalty, round(weight, 6) AS weight FROM ranked_threads JOIN h USING (thread_id)""")
def mode_top(spark, d):
    """The flagship: threads of the articles that have a vector, headline first, ranked per category."""
    own = members(spark, d, True)
    rows = ratings.with_pagerank(threads.relevance(own), pagerank_table(spark)).withColumn("nasty", S.nasty(F.col("title"), F.col("lang")))
    shown = sinks.threads(threads.headlines(rows).select("thread_id", "pos", "title", "file_name"))
    return ranked(own).join(shown, "thread_id").select("category", F.col("rank").cast("long").alias("rank"), "thread_id", "title", joined("articles").alias("articles"), "size", F.round("importance", 6).alias("importance"), "best_ts", F.round("age_penalty", 6).alias("age_penalty"), F.round("weight", 6).alias("weight"))
