"""The store after a stream of events over the article view, run to its end."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from ..config import EN_CLUSTERING
from ..operators import bloom, ratings, threads
from ..operators import importance as imp
from ..schema import DOC_EVENT
from ..storage import cut, shared_dir
from ..streaming import cycle
from ..streaming.keyed import KeyedTable
from ..streaming.store import DocumentStore, respond, run_stream
from .query_threads import _CLOCK, _PAIR, THETA, _importance_sql
from .registered import Registered, sig
from .views import ARTICLES, MEMBERS, VECTORED, articles, traffic_table

REGISTERED = query = Registered()
#: Hash parts of the keyed tables here; a store of production size has more.
_PARTS = 8
BODY = "url string, host string, title string, lang string, category string, fetch_time long, thread_id string"


def _events(spark, d):
    """Per article: a put; later for every third one a put of another title, for every fifth one of nothing indexable,
    for every seventh one a delete; every eleventh put has no time to live."""
    a = articles(spark, d)
    i = F.col("doc_id")
    body = lambda title, cat: F.to_json(F.struct("url", "host", title.alias("title"), "lang", cat.alias("category"), "fetch_time", "thread_id"))
    age = F.when(i % 11 == 0, "no-cache").otherwise(F.concat(F.lit("max-age="), F.col("ttl").cast("string")))
    row = lambda n, method, b: F.struct((i * 10 + n).alias("seq"), F.lit(method).alias("method"), "file_name", age.alias("cache_control"), b.alias("body"))
    none = F.lit(None).cast("string")
    rows = F.array(
        row(1, "PUT", body(F.col("title"), F.col("category"))),
        F.when(i % 3 == 0, row(2, "PUT", body(F.concat(F.lit("2 "), "title"), F.col("category")))),
        F.when(i % 5 == 0, row(3, "PUT", body(F.lit("3"), F.lit("undefined")))),
        F.when(i % 7 == 0, row(4, "DELETE", none)),
    )
    return a.select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("e")).select("e.*")


def annotated(rows):
    """The bodies of these events are annotated already."""
    out = rows.withColumn("_b", F.from_json("body", BODY)).select("seq", "file_name", "ttl", "_b.*")
    return out.withColumn("indexable", (F.col("category") != "undefined") & F.col("lang").isNotNull())


def build_index(docs):
    spark = docs.sparkSession
    rows = ratings.with_traffic(docs.where("category <> 'not_news'"), traffic_table(spark))
    main = imp.importance(rows).drop("combo")
    clock = threads.nth_timestamp(rows)
    lang = rows.groupBy("thread_id").agg(F.min("lang").alias("lang"))
    out = threads.freshest(rows).join(threads.category(rows), "thread_id").join(main, "thread_id").join(lang, "thread_id")
    return out.withColumn("lang_ord", F.when(F.col("lang") == "en", 0).otherwise(1)).join(F.broadcast(clock), F.lit(True))


def _run(spark, d):
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = _events(spark, d)
    # Files in the order of events: by three thirds of the sequence.
    for k in range(3):
        events.where(F.col("seq") % 10 == k + 1 if k < 2 else F.col("seq") % 10 >= 3).coalesce(1).write.mode("append").json(f"{at}/in/{k}")
    store = DocumentStore(spark, f"{at}/store", annotated, build_index, _PARTS)
    for k in range(3):
        source = spark.readStream.schema(DOC_EVENT).json(f"{at}/in/{k}")
        run_stream(store, source, f"{at}/checkpoint/{k}").awaitTermination()
    return store


_STORE = f"""{ARTICLES}, kept AS (SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN '2 ' || title ELSE title END AS title) FROM articles WHERE doc_id % 11 <> 0 AND doc_id % 7 <> 0 AND category <> 'undefined')"""


@query(f"WITH {_STORE} SELECT file_name, title, category, fetch_time, ttl FROM kept")
def stream_store_final(spark, d):
    return cut(_run(spark, d).documents().select("file_name", "title", "category", "fetch_time", "ttl"))


_LIVE = MEMBERS.replace("FROM articles a LEFT JOIN", "FROM live a LEFT JOIN").replace(ARTICLES, f"{_STORE}, live AS (SELECT * FROM kept WHERE fetch_time + ttl >= (SELECT max(fetch_time) FROM kept))")


@query(f"""WITH {_LIVE}, {_importance_sql()}, size AS (SELECT thread_id, min(lang) AS lang, count(*) AS size, max(fetch_time) AS freshest_ts FROM members GROUP BY 1),
w AS (SELECT *, importance * CASE WHEN best_ts + 28800 < {_CLOCK} THEN {sig(f'(best_ts + 28800 - {_CLOCK}) / 3600.0 + 8.0')} ELSE 1.0 END AS weight FROM best JOIN size USING (thread_id) WHERE lang = 'en' AND freshest_ts >= greatest((SELECT max(freshest_ts) FROM size) - 604800, 0))
SELECT row_number() OVER (ORDER BY least(size, 3) DESC, round(weight, 9) DESC, freshest_ts, thread_id) AS rank, thread_id, size, round(weight, 6) AS weight FROM w""")
def stream_threads_final(spark, d):
    found = _run(spark, d).threads(604800, "en", "any")
    return cut(found.select(F.col("rank").cast("long").alias("rank"), "thread_id", "size", F.round("weight", 6).alias("weight")))


@query(f"""WITH {ARTICLES}, e AS (SELECT doc_id, 1 AS n FROM articles UNION ALL SELECT doc_id, 2 FROM articles WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 3 FROM articles WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 4 FROM articles WHERE doc_id % 7 = 0)
SELECT doc_id * 10 + n AS seq, CASE WHEN n = 4 THEN CASE WHEN doc_id % 2 = 0 THEN 204 ELSE 404 END WHEN doc_id % 11 = 0 THEN 400 WHEN n = 3 THEN 204 WHEN doc_id % 2 = 0 THEN 204 ELSE 201 END AS status FROM e""")
def store_responses(spark, d):
    old = articles(spark, d).where("doc_id % 2 = 0").select("file_name")
    return respond(_events(spark, d), old, annotated).select("seq", "status")


_WORD = lambda i: f"('0x' || substr(md5(file_name), {1 + 8 * i}, 8))::BIGINT"


@query(f"""WITH {ARTICLES}, h AS (SELECT file_name, vector IS NOT NULL AS held, {_WORD(0)} AS w0, {_WORD(1)} AS w1, {_WORD(2)} AS w2, {_WORD(3)} % {_PARTS} AS part FROM articles),
s AS (SELECT part, greatest(ceil(count(*) * {bloom.BITS} / {bloom.PAGE}.0), 1)::BIGINT AS pages FROM h WHERE held GROUP BY 1),
b AS (SELECT h.*, h.w0 % s.pages AS page, unnest([(w1 + i * (w2 - w2 % 2 + 1)) % {bloom.PAGE} FOR i IN range({bloom.K})]) AS bit FROM h JOIN s USING (part)),
f AS (SELECT DISTINCT part, page, bit FROM b WHERE held),
m AS (SELECT b.file_name, bool_and(f.bit IS NOT NULL) AS may_hold FROM b LEFT JOIN f USING (part, page, bit) GROUP BY 1)
SELECT h.file_name, h.held, coalesce(m.may_hold, false) AS may_hold FROM h LEFT JOIN m USING (file_name)""")
def store_misses(spark, d):
    """A keyed table of the articles with a vector, and which of all articles its filters rule out."""
    rows = articles(spark, d).select("file_name", F.col("vector").isNotNull().alias("held"))
    table = KeyedTable(spark, f"{shared_dir(spark)}/keyed-{uuid.uuid4().hex}", parts=_PARTS)
    table.apply(rows.where("held"))
    return table.may_hold(rows)


_LIVE_VECTORS = f"{VECTORED}, live AS (SELECT * FROM articles WHERE doc_id % 7 <> 0 AND fetch_time + ttl >= (SELECT max(fetch_time) FROM articles))"


@query(f"""WITH RECURSIVE {_LIVE_VECTORS}, p AS ({_PAIR.replace('FROM articles a JOIN articles b', 'FROM live a JOIN live b')}),
e AS (SELECT a, b FROM p WHERE dist <= {THETA} UNION SELECT b, a FROM p WHERE dist <= {THETA}), r(n, m) AS (SELECT a, a FROM e UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.n),
c AS (SELECT n, min(m || '.html') AS thread FROM r GROUP BY 1) SELECT file_name, fetch_time, coalesce(c.thread, file_name) AS thread FROM live LEFT JOIN c ON c.n = live.doc_id""")
def incremental_threads(spark, d):
    """A stream over the articles with a vector: every second one is put late, every fifth one first with another vector, every seventh one is deleted,
    and those whose time runs out expire. The cycle re-links what each batch touches; SQL links the final state as a whole."""
    at = f"{shared_dir(spark)}/cycle-{uuid.uuid4().hex}"
    rows, i = articles(spark, d, True), F.col("doc_id")

    def put(vector):
        return F.to_json(F.struct("lang", "site_name", "fetch_time", vector.alias("vector")))

    def write(rows, n, payload=None):
        gone = F.lit(payload is None)
        own = F.lit(None).cast("long") if payload is None else F.col("fetch_time")
        cols = ["file_name", (i * 10 + n).alias("seq"), gone.alias("gone"), own.alias("fetch_time"), "ttl", (F.lit(None).cast("string") if payload is None else payload).alias("payload")]
        rows.select(*cols).write.mode("append").parquet(f"{at}/in")

    write(rows.where(i % 2 == 0), 1, put(F.when(i % 5 == 0, F.reverse("vector")).otherwise(F.col("vector"))))
    write(rows.where((i % 2 == 1) | (i % 5 == 0)), 2, put(F.col("vector")))
    write(rows.where(i % 7 == 0), 3)
    cfg = replace(EN_CLUSTERING, small_threshold=THETA, small_size=10**9, ban_same_sites=False, budget="unbounded")
    table = cycle.ThreadTable(spark, f"{at}/threads", cfg, parts=_PARTS)
    stream = spark.readStream.schema(cycle.CHANGE).option("maxFilesPerTrigger", 64).parquet(f"{at}/in")
    parse = lambda p: p.select("file_name", F.from_json("payload", "lang string, site_name string, fetch_time long, vector array<float>").alias("b")).select("file_name", "b.*")
    before = {k: spark.conf.get(k, None) for k in cycle.STATE_SETTINGS}
    for k, v in cycle.STATE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        cycle.run_threads(table, stream, parse, f"{at}/checkpoint").awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return table.documents().select("file_name", "fetch_time", "thread")
