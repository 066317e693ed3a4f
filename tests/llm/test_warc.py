import os
import random

import duckdb
from pyspark.sql import functions as F

from threadloom.llm import warc


def test_canonical_urls(spark):
    pairs = [
        ("HTTP://WWW.A.org:80/x/?b=2&a=1&utm_source=q#f", "a.org/x?a=1&b=2"), ("https://a.org", "a.org"), ("https://a.org/?", "a.org"), ("https://a.org:8080/x//", "a.org:8080/x"),
        ("nothing", None), (None, None), ("http://a.org/X?sessionid=1", "a.org/X"),
    ]
    df = spark.createDataFrame(pairs, "url string, want string")
    for r in df.select("want", warc.canonical_url(F.col("url")).alias("got")).collect():
        assert r["got"] == r["want"]


def test_query_like_sql(spark, data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    want = con.execute(warc.ORACLE)
    names = [c[0] for c in want.description]
    rows = warc.query(spark, data).select(*names).collect()
    assert sorted(repr(tuple(r)) for r in rows) == sorted(map(repr, want.fetchall()))


def test_hot_url_like_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for k in range(400):
        url = "http://hot.org/" if rng.random() < 0.6 else f"http://h{rng.randrange(4)}.org/" if rng.random() < 0.95 else None
        kind, status = rng.choice([("response", 200), ("response", 404), ("revisit", 304)])
        headers = {h: v for h, v in (("etag", f'"{rng.randrange(2)}"'), ("last-modified", str(rng.randrange(2))), ("vary", "x"), ("length", str(k))) if rng.random() < 0.7}
        rows.append((k, url, None if rng.random() < 0.03 else rng.randrange(6 * 86400) // 3600 * 3600, kind, status, headers if rng.random() < 0.95 else None, "extra"))
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, status int, headers map<string,string>, _key string")
    for width in (86400, 3600, 10**9):
        got = {r["record_id"]: r for r in warc.resolve_revisits(df, width).collect()}
        for k, url, ts, kind, _, headers, _ in rows:
            if kind != "revisit":
                continue
            earlier = [(o[2], o[0], o[5] or {}) for o in rows if o[3] == "response" and o[4] == 200 and url and o[1] == url and ts is not None and o[2] is not None and (o[2], o[0]) < (ts, k)]
            mine, best = headers or {}, max(earlier, key=lambda o: o[:2], default=None)
            state = "unresolved"
            if best:
                state = "unverified"
                for h in ("etag", "last-modified"):
                    if h in mine and h in best[2]:
                        state = "resolved" if mine[h] == best[2][h] else "mismatch"
                        break
            want = {**best[2], **{h: v for h, v in mine.items() if h in warc.PERMITTED}} if state == "resolved" else mine
            assert (got[k]["target_id"], got[k]["state"], got[k]["headers"]) == (best and best[1], state, want)


def test_empty(spark):
    df = spark.createDataFrame([], "record_id long, url string, ts long, kind string, status int, headers map<string,string>")
    assert warc.resolve_revisits(df).count() == 0


def test_defined_cases(spark):
    """Null ids, kinds and statuses, very long URLs and values, repeated records, equal times, and columns with the operator's own names."""
    long, value = "http://a.org/" + "p/" * 100_000, "v" * 200_000
    tag = {"etag": "1"}
    rows = [
        (1, long, 10, "response", 200, {"etag": "1", "x": value}), (2, long, 20, "revisit", 304, tag), (2, long, 20, "revisit", 304, tag),
        (None, "http://b.org/", 10, "response", 200, tag), (4, "http://b.org/", 10, "response", 200, {"etag": "2"}), (None, "http://b.org/", 10, "revisit", 304, tag), (5, "http://b.org/", 11, "revisit", 304, tag),
        (None, "http://c.org/", 10, "response", 200, tag), (7, "http://c.org/", 200_000, "revisit", 304, tag), (8, "http://d.org/", 10, None, 200, tag), (9, "http://d.org/", 10, "response", None, tag), (10, "http://d.org/", 20, "revisit", None, None),
    ]
    df = spark.createDataFrame([(*r, 7, 8, 9) for r in rows], "record_id long, url string, ts long, kind string, status int, headers map<string,string>, _slice int, canonical_url int, _near int")
    got = warc.resolve_revisits(df).collect()
    assert sorted((r["record_id"] or 0, r["target_id"], r["state"]) for r in got if r["record_id"] not in (7, 10)) == sorted([(2, 1, "resolved"), (2, 1, "resolved"), (0, None, "resolved"), (5, 4, "mismatch")])
    by = {r["record_id"]: r for r in got}
    assert by[2]["headers"]["x"] == value and len(by[2]["canonical_url"]) == len(long) - len("http://") - 1
    # A response of null id is found a slice later; a record without kind or status is no target.
    assert (by[7]["target_id"], by[7]["state"]) == (None, "resolved") and by[10]["state"] == "unresolved" and by[10]["headers"] == {}
