"""WARC: resolving not-modified revisit records.

A revisit record of the server-not-modified profile holds no payload. It is resolved by an as-of join on the canonical
URL to the latest earlier full response; the pair's validators are compared (ETag weakly, else Last-Modified), and the
headers a 304 may update are merged over the stored ones.

Scale: a URL may hold a third of all records, so no URL is sorted in one task. Records are cut into time slices of
``slice_seconds``; rows are ordered within (URL, slice) only, and each slice hands its last response on to later slices
over one row per (URL, slice). Payloads stay where they are; only ids and headers move.

Defined cases: null URL: never resolved (state ``unresolved``). Null time: the record is neither earlier nor later than
any other, so unresolved as a revisit and no target as a response. Equal times: the lower record id is earlier.
Repeated records: each is resolved; a response repeated under one id counts once. Neither validator on both sides:
``unverified``. Null header maps: empty. Null record id: a revisit is resolved like any other; a response serves as a target of
null id, the earlier one at equal times. Null kinds and statuses: neither revisit nor full response. URLs and header values are read whole at any
length. Further columns, whatever their names, are ignored. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

#: Header fields that a 304 response may update, lower case.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not name a resource.
TRACKING = r"(?:utm_[a-z]+|fbclid|gclid|sessionid|phpsessid|jsessionid)"


def canonical_url(url: Column) -> Column:
    """Scheme and www. dropped, host lower-cased without default port, fragment and tracking parameters dropped, query
    parameters sorted, final slashes dropped. Null where there is no ``://``."""
    rest = F.regexp_extract(url, r"^[^:/?#]*://([^#]*)", 1)
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(rf"^{TRACKING}(?:=|$)")))
    query = F.when(query == "", "").otherwise(F.array_join(params, "&"))
    return F.when(url.contains("://"), F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame, slice_seconds: int = 86400) -> DataFrame:
    """records: record_id long, url string, ts long (seconds), kind string (response or revisit), status int, headers
    map<string,string> with lower-case names; other columns are ignored. Full responses are those of status 200.

    Returns a row per revisit: record_id, canonical_url, target_id (null if none), state (resolved, mismatch, unverified,
    unresolved), headers (merged if resolved, else the record's own).
    """
    own = records.select(
        "record_id", "ts", F.col("kind") == "revisit", (F.col("kind") == "response") & (F.col("status") == 200),
        F.coalesce("headers", F.create_map().cast("map<string,string>")), canonical_url(F.col("url")),
    ).toDF("record_id", "ts", "_revisit", "_full", "headers", "canonical_url")
    own = own.where("_revisit or (_full and canonical_url is not null and ts is not null)").withColumn("_slice", F.floor(F.col("ts") / slice_seconds))
    # Revisits that cannot have a target are dealt out by id rather than meet under one null key.
    placed = F.col("canonical_url").isNotNull() & F.col("ts").isNotNull()
    own = own.withColumn("_key", F.when(placed, F.col("canonical_url")).otherwise(F.concat(F.lit("\u0000"), F.coalesce(F.col("record_id").cast("string"), F.lit("")))))
    stored = F.when(F.col("_full"), F.struct(F.col("record_id").alias("id"), F.col("headers").alias("h")))
    order = W.partitionBy("_key", "_slice").orderBy("ts", "record_id", F.col("_full").desc()).rowsBetween(W.unboundedPreceding, -1)
    within = own.withColumn("_near", F.last(stored, ignorenulls=True).over(order))
    last = own.where("_full").groupBy("_key", "_slice").agg(F.max_by(F.struct(F.col("record_id").alias("id"), F.col("headers").alias("h")), F.struct("ts", F.col("record_id").isNotNull(), "record_id")).alias("_last"))
    slices = own.where("_revisit").select("_key", "_slice").distinct().join(last, ["_key", "_slice"], "full")
    slices = slices.withColumn("_far", F.last("_last", ignorenulls=True).over(W.partitionBy("_key").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))).select("_key", "_slice", "_far")
    found = within.where("_revisit").join(slices, ["_key", "_slice"], "left").withColumn("_t", F.coalesce("_near", "_far"))
    mine, kept = F.col("headers"), F.col("_t")["h"]
    same_tag = _weak(mine["etag"]) == _weak(kept["etag"])
    same_date = mine["last-modified"] == kept["last-modified"]
    state = (
        F.when(F.col("_t").isNull(), "unresolved")
        .when(same_tag.isNotNull(), F.when(same_tag, "resolved").otherwise("mismatch"))
        .when(same_date.isNotNull(), F.when(same_date, "resolved").otherwise("mismatch"))
        .otherwise("unverified")
    )
    allowed = F.map_filter(mine, lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(kept, lambda k, v: ~F.map_contains_key(allowed, k)), allowed)
    return found.withColumn("state", state).select(
        "record_id", "canonical_url", F.col("_t")["id"].alias("target_id"), "state",
        F.when(F.col("state") == "resolved", merged).otherwise(mine).alias("headers"),
    )


def page_records(pages: DataFrame) -> DataFrame:
    """The crawl log that op10 resolves: a full response for every page, and three later or earlier not-modified answers."""
    day = 86400
    at = F.lit(1704067200) + (F.col("page_id") * 7919) % (30 * day)
    tag = F.concat(F.lit('"'), F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary")), F.lit('"'))
    own = pages.select("page_id", "url", at.alias("_at"), tag.alias("_tag"), F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("_n"))
    n, i = F.col("_n"), F.col("page_id")
    ts = F.col("_at") + F.when(n == 3, -1 - i % 7).otherwise(n * day - F.when(n == 0, 0).otherwise(i % 5000))
    sent = F.when((n > 0) & (i % 7 == n), F.concat(F.lit('"x'), i.cast("string"), F.lit('"'))).otherwise(F.when((n == 1) & (i % 3 == 0), F.concat(F.lit("W/"), F.col("_tag"))).otherwise(F.col("_tag")))
    headers = F.map_from_arrays(
        F.array(F.lit("date"), F.lit("content-length"), F.lit("etag"), F.lit("last-modified"), F.lit("server")),
        F.array(ts.cast("string"), (n * 10 + i % 10).cast("string"), F.when((i % 5 == 0) & (n != 2), F.lit(None)).otherwise(sent), F.when(i % 4 == 0, F.lit(None)).otherwise((F.col("_at") - i % 3 * F.when(n == 2, 1).otherwise(0)).cast("string")), F.concat(F.lit("s"), n.cast("string"))),
    )
    return own.select((i * 4 + n).alias("record_id"), "url", ts.alias("ts"), F.when(n == 0, "response").otherwise("revisit").alias("kind"), F.when(n == 0, 200).otherwise(304).alias("status"), F.map_filter(headers, lambda k, v: v.isNotNull()).alias("headers"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(page_records(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return found.select("record_id", "canonical_url", "target_id", "state", F.array_join(lines, ";").alias("headers"))


ORACLE = r"""
WITH p AS (
  SELECT page_id AS i, url, 1704067200 + (page_id * 7919) % 2592000 AS t0,
         '"' || md5(coalesce(html, '')) || '"' AS tag,
         CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '^[^:/?#]*://([^#]*)', 1) END AS rest
  FROM pages
), c AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\.', ''), ':(?:80|443)$', '')
         || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS stem,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
           lambda q: q <> '' AND NOT regexp_matches(lower(q), '^(?:utm_[a-z]+|fbclid|gclid|sessionid|phpsessid|jsessionid)(?:=|$)'))), '&') AS q
  FROM p
), u AS (SELECT *, stem || CASE WHEN q = '' THEN '' ELSE '?' || q END AS cu FROM c
), r AS (
  SELECT i, n, i * 4 + n AS record_id, cu, t0, tag,
         t0 + CASE WHEN n = 3 THEN -1 - i % 7 WHEN n = 0 THEN 0 ELSE n * 86400 - i % 5000 END AS ts,
         CASE WHEN i % 5 = 0 AND n <> 2 THEN NULL WHEN n > 0 AND i % 7 = n THEN '"x' || i || '"'
              WHEN n = 1 AND i % 3 = 0 THEN 'W/' || tag ELSE tag END AS etag,
         CASE WHEN i % 4 = 0 THEN NULL WHEN n = 2 THEN t0 - i % 3 ELSE t0 END AS lm
  FROM u, (SELECT unnest([0, 1, 2, 3]) AS n)
), j AS (
  SELECT v.*, t.record_id AS target_id, t.etag AS t_etag, t.lm AS t_lm, t.n AS t_n, t.i AS t_i,
         row_number() OVER (PARTITION BY v.record_id ORDER BY t.ts DESC, t.record_id DESC) AS k
  FROM r v LEFT JOIN r t ON t.n = 0 AND t.cu = v.cu AND (t.ts < v.ts OR (t.ts = v.ts AND t.record_id < v.record_id))
  WHERE v.n > 0
), s AS (
  SELECT *, CASE WHEN target_id IS NULL THEN 'unresolved'
    WHEN etag IS NOT NULL AND t_etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = regexp_replace(t_etag, '^W/', '') THEN 'resolved' ELSE 'mismatch' END
    WHEN lm IS NOT NULL AND t_lm IS NOT NULL THEN CASE WHEN lm = t_lm THEN 'resolved' ELSE 'mismatch' END
    ELSE 'unverified' END AS state
  FROM j WHERE k = 1
)
SELECT record_id, cu AS canonical_url, target_id, state,
  CASE WHEN state = 'resolved'
    THEN concat_ws(';', 'content-length=' || t_i % 10, 'date=' || ts, 'etag=' || coalesce(etag, t_etag), 'last-modified=' || coalesce(lm, t_lm), 'server=s0')
    ELSE concat_ws(';', 'content-length=' || (n * 10 + i % 10), 'date=' || ts, 'etag=' || etag, 'last-modified=' || lm, 'server=s' || n) END AS headers
FROM s
"""
