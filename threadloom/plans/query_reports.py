"""Reports: metrics, votes, agreement, pair reports, the viewer's table."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import markup, metrics
from .query_threads import _RANKED, ranked
from .query_rows import members
from .registered import Registered
from .views import ARTICLES, articles, headed, table

REGISTERED = query = Registered()


def _labelled(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.col("o_orderstatus").alias("gold"), F.when(F.col("o_orderkey") % 4 == 0, "F").when(F.col("o_orderkey") % 7 == 0, "P").otherwise(F.col("o_orderstatus")).alias("predicted"))


_LABELLED = "l AS (SELECT o_orderkey, o_orderstatus AS gold, CASE WHEN o_orderkey % 4 = 0 THEN 'F' WHEN o_orderkey % 7 = 0 THEN 'P' ELSE o_orderstatus END AS predicted FROM orders)"


@query(f"""WITH {_LABELLED}, n AS (SELECT label, count(*) FILTER (gold = label AND predicted = label) AS t, count(*) FILTER (predicted = label) AS p, count(*) FILTER (gold = label) AS s FROM l, (SELECT DISTINCT unnest([gold, predicted]) AS label FROM l) GROUP BY 1),
m AS (SELECT label, CASE WHEN p > 0 THEN t / p ELSE 0 END AS precision, CASE WHEN s > 0 THEN t / s ELSE 0 END AS recall, s, t FROM n),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, s AS support FROM f
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(s)::BIGINT FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * s) / sum(s), 6), round(sum(recall * s) / sum(s), 6), round(sum(f1 * s) / sum(s), 6), sum(s)::BIGINT FROM f
UNION ALL SELECT 'accuracy', round(sum(t) / sum(s), 6), round(sum(t) / sum(s), 6), round(sum(t) / sum(s), 6), sum(s)::BIGINT FROM f""")
def prf_report(spark, d):
    r = metrics.class_report(_labelled(spark, d))
    return r.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"WITH {_LABELLED} SELECT o_orderkey, gold, predicted FROM l WHERE gold <> predicted")
def error_list(spark, d):
    return metrics.errors(_labelled(spark, d))


@query("""WITH s AS (SELECT CAST(l_quantity AS DOUBLE) AS score, CAST(l_returnflag = 'R' AS INT) AS y FROM lineitem), p AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY 1),
b AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM p) SELECT round((sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)))::DOUBLE, 8) AS auc FROM b""")
def roc_auc(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return metrics.roc_auc(rows).select(F.round("auc", 8).alias("auc"))


def _votes(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("worker"), F.col("l_returnflag").alias("label"))
    return rows


_VOTES = "v AS (SELECT l_orderkey AS key, l_linenumber AS worker, l_returnflag AS label FROM lineitem)"


@query(f"""WITH {_VOTES}, c AS (SELECT key, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY key) AS total FROM v GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, label) AS k FROM c)
SELECT key, label, n AS votes, total::BIGINT AS total FROM r WHERE k = 1 AND n >= 3""")
def majority_vote(spark, d):
    return metrics.majority(_votes(spark, d), 3)


@query(f"""WITH {_VOTES}, c AS (SELECT key, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY key) AS total FROM v GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, label) AS k FROM c)
SELECT key, label, n AS votes, total::BIGINT AS total FROM r WHERE k = 1 AND n >= 0.7 * total""")
def pair_vote(spark, d):
    return metrics.majority(_votes(spark, d), 1, 0.7)


_KAPPA = f"""{_VOTES}, b AS (SELECT x.worker AS w1, y.worker AS w2, x.label AS l1, y.label AS l2 FROM v x JOIN v y ON x.key = y.key AND x.worker < y.worker),
o AS (SELECT w1, w2, count(*) AS n, avg(CAST(l1 = l2 AS DOUBLE)) AS po FROM b GROUP BY 1, 2), a AS (SELECT w1, w2, l1 AS l, count(*) AS a FROM b GROUP BY 1, 2, 3), c AS (SELECT w1, w2, l2 AS l, count(*) AS b FROM b GROUP BY 1, 2, 3),
e AS (SELECT w1, w2, sum(a * b) AS ab FROM a JOIN c USING (w1, w2, l) GROUP BY 1, 2), k AS (SELECT w1, w2, n, (po - ab / (n * n)) / (1 - ab / (n * n)) AS kappa FROM o JOIN e USING (w1, w2))"""


@query(f"WITH {_KAPPA} SELECT w1 AS worker, w2 AS worker2, n, round(kappa, 6) AS kappa FROM k")
def cohen_kappa(spark, d):
    return metrics.kappa_pairs(_votes(spark, d)).select("worker", "worker2", "n", F.round("kappa", 6).alias("kappa"))


@query(f"WITH {_KAPPA} SELECT round(avg(kappa), 6) AS kappa, count(*) AS pairs FROM k WHERE kappa BETWEEN -1 AND 1")
def average_kappa(spark, d):
    return metrics.average_kappa(_votes(spark, d)).select(F.round("kappa", 6).alias("kappa"), "pairs")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def label_histogram(spark, d):
    return metrics.histogram(table(spark, d, "events"), "event_type")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 9 <> 0")
def honeypot_filter(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, "gold").otherwise("").alias("golden"))
    return metrics.drop_controls(rows).select("o_orderkey")


def _pairs(spark, d):
    u = lambda c: F.concat(F.lit("u"), F.col(c).cast("string"))
    pairs = table(spark, d, "lineitem").select(u("l_orderkey").alias("first_url"), u("l_partkey").alias("second_url"), F.when(F.col("l_returnflag") == "N", "OK").otherwise("BAD").alias("quality"))
    labels = table(spark, d, "part").select(u("p_partkey").alias("url"), F.col("p_size").alias("thread_id"))
    return pairs, labels


_PAIRS = "p AS (SELECT l_orderkey AS a, l_partkey AS b, CASE WHEN l_returnflag = 'N' THEN 'OK' ELSE 'BAD' END AS quality FROM lineitem), t AS (SELECT p_partkey AS k, p_size AS thread_id FROM part)"


@query(f"WITH {_PAIRS} SELECT 'u' || a AS first_url, 'u' || b AS second_url, quality AS gold, CASE WHEN x.thread_id = y.thread_id THEN 'OK' ELSE 'BAD' END AS predicted FROM p JOIN t x ON x.k = a JOIN t y ON y.k = b")
def pair_label_join(spark, d):
    return metrics.thread_pairs(*_pairs(spark, d))


@query(f"WITH {_PAIRS} SELECT count(*) AS missing FROM p WHERE a NOT IN (SELECT k FROM t) OR b NOT IN (SELECT k FROM t)")
def pairs_not_found(spark, d):
    return metrics.missing_pairs(*_pairs(spark, d)).agg(F.count("*").alias("missing"))


@query(f"""WITH {ARTICLES}, p AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY fetch_time, file_name) AS pos FROM articles),
f AS (SELECT *, first_value(url) OVER (PARTITION BY lang, thread_id ORDER BY pos) AS head FROM p), heads AS (SELECT DISTINCT lang, thread_id, head FROM f),
k AS (SELECT DISTINCT least(url, head) AS a, greatest(url, head) AS b FROM f WHERE category = 'sports'),
c AS (SELECT lang, head AS first_url, url AS second_url, 'OK' AS expected FROM f WHERE url <> head UNION ALL SELECT lang, lag(head) OVER (PARTITION BY lang ORDER BY thread_id), head, 'BAD' FROM heads)
SELECT * FROM c WHERE first_url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM k WHERE k.a = least(first_url, second_url) AND k.b = greatest(first_url, second_url))""")
def pair_candidates(spark, d):
    """Pairs of the sports articles with their thread's first one are known already."""
    rows = articles(spark, d).withColumn("pos", F.row_number().over(W.partitionBy("thread_id").orderBy("fetch_time", "file_name")))
    head = F.first("url").over(W.partitionBy("lang", "thread_id").orderBy("pos"))
    known = rows.withColumn("first_url", head).where("category = 'sports'").select(F.col("url").alias("second_url"), "first_url")
    return markup.pair_candidates(rows, known)


@query("""WITH r AS (SELECT 'https://www.' || source || '.example.com/' || doc_id AS url, split_part(text, chr(10), 1) AS title, text FROM documents), c AS (SELECT url FROM r ORDER BY url LIMIT 3),
p AS (SELECT (row_number() OVER (ORDER BY md5('1:' || url), url) - 1) // 20 AS pool, url FROM r WHERE coalesce(title, '') <> '' AND coalesce(text, '') <> '')
SELECT pool::INT AS pool, url FROM p UNION ALL SELECT pool::INT, c.url FROM (SELECT DISTINCT pool FROM p), c""")
def task_pools(spark, d):
    rows = headed(spark, d).select("url", "title", "text")
    return markup.pools(rows, rows.orderBy("url").limit(3), 20).select("pool", "url")


@query(f"""WITH {_RANKED} SELECT category, rank, a.thread_id, file_name, url FROM ranked_threads JOIN articles a USING (thread_id) WHERE rank <= 200 AND a.lang IN ('en', 'de') AND a.category <> 'not_news'""".replace("SELECT category, rank", "SELECT ranked_threads.category AS category, rank"))
def viewer_dataset(spark, d):
    docs = articles(spark, d).where("lang in ('en', 'de') and category <> 'not_news'").select("thread_id", "file_name", "url")
    return ranked(members(spark, d), 200).join(docs, "thread_id").select("category", F.col("rank").cast("long").alias("rank"), "thread_id", "file_name", "url")
