"""The keyed table, its filters, and the incremental cycle against a rebuild of everything."""

import json
import os
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.config import EN_CLUSTERING
from threadloom.operators import bloom, linkage, pairs
from threadloom.streaming import cycle
from threadloom.streaming.keyed import KeyedTable


def files(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_a_small_change_writes_few_files(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), parts=64)
    assert table.read() is None and table.lookup(spark.createDataFrame([("a",)], "file_name string")) is None
    first = spark.range(5000).select(F.concat(F.col("id").cast("string"), F.lit(".html")).alias("file_name"), F.col("id").alias("n"))
    assert len(table.apply(first)) == 64
    before = files(tmp_path)
    change = spark.createDataFrame([(f"{k}.html", -k) for k in range(6)] + [("new", 7), (None, 1)], "file_name string, n long")
    touched = table.apply(change, spark.createDataFrame([("10.html",), ("11.html",), ("5.html",), ("nowhere",)], "file_name string"))
    fresh = files(tmp_path) - before
    assert len(touched) <= 10 and len(fresh) <= 2 * len(touched)
    want = {f"{k}.html": k for k in range(5000)} | {f"{k}.html": -k for k in range(6)} | {"new": 7}
    del want["10.html"], want["11.html"]
    assert {r["file_name"]: r["n"] for r in table.read().collect()} == want
    asked = spark.createDataFrame([("3.html",), ("new",), ("10.html",), ("none",)], "file_name string")
    assert {tuple(r) for r in table.lookup(asked).collect()} == {("3.html", -3), ("new", 7)}


def test_versions_readers_and_emptied_parts(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), parts=4)
    rows = lambda *ks: spark.createDataFrame([(k, k) for k in ks], "file_name string, v string")
    table.apply(rows("a", "b", "c", "d", "e"))
    reader = table.read()
    table.apply(rows("a"), rows("b").select("file_name"))
    # One version back is kept whole for readers that are not done.
    assert reader.count() == 5 and table.read().count() == 4
    table.apply(rows().limit(0), table.read().select("file_name"))
    assert table.read().count() == 0 and table.manifest()["at"] == {}
    table.apply(rows("z").withColumn("more", F.lit(1)))
    assert [tuple(r) for r in table.read().collect()] == [("z", "z", 1)]
    assert len(table.versions()) == 2
    table.apply(rows().limit(0))
    with pytest.raises(ValueError, match="parts"):
        KeyedTable(spark, str(tmp_path / "t"), parts=8).apply(rows("y"))


def test_filters_rule_out_most_and_never_a_member(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), parts=3)
    keys = spark.range(9000).select(F.format_string("k%d", "id").alias("file_name"))
    assert table.may_hold(keys).where("may_hold").isEmpty()
    table.apply(keys.where("id % 2 = 0"))
    got = table.may_hold(keys.withColumn("in", F.expr("int(substring(file_name, 2)) % 2 = 0"))).groupBy("in", "may_hold").count().collect()
    n = {(r["in"], r["may_hold"]): r["count"] for r in got}
    assert n[True, True] == 4500 and (True, False) not in n
    assert n.get((False, True), 0) < 0.02 * 4500
    assert bloom.ask(keys.limit(1).withColumn("file_name", F.lit(None).cast("string")), bloom.build(keys, "file_name"), "file_name").first()["may_hold"] is False


CFG = replace(EN_CLUSTERING, small_threshold=0.03, medium_threshold=0.02, large_threshold=0.012, small_size=3, medium_size=5, large_size=8, budget="unbounded", chunk_size=10**6, chunk_overlap=0)
START = 1_600_000_000


def _changes(seed):
    """Batches of (file, seq, gone, fetch_time, ttl, payload) around a few stories."""
    rng = np.random.default_rng(seed)
    stories = rng.standard_normal((6, 4))
    seq, out = 0, []
    for b in range(5):
        batch = []
        for _ in range(14):
            seq += 1
            k, at = int(rng.integers(0, 40)), START + 1000 * b + int(rng.integers(0, 900)) - (4000 if rng.random() < 0.15 else 0)
            vector = (stories[rng.integers(0, 6)] + 0.25 * rng.standard_normal(4)).tolist()
            body = json.dumps({"lang": "en" if k % 3 else "de", "site_name": f"s{k % 9}", "fetch_time": at, "vector": vector})
            batch.append((f"f{k:02}", seq, False, at, int(rng.choice([300, 1500, 100_000])), body))
        for _ in range(2):
            seq += 1
            batch.append((f"f{int(rng.integers(0, 40)):02}", seq, True, None, None, None))
        batch.append(("clock", seq + 1, False, START + 1000 * b + 950, 10**6, json.dumps({"lang": "en", "site_name": "x", "fetch_time": START + 1000 * b + 950, "vector": [9.0, -9.0, 9.0, 9.0]})))
        seq += 1
        out.append(batch)
    return out


SCHEMA = "file_name string, seq long, gone boolean, fetch_time long, ttl long, payload string"
BODY = "lang string, site_name string, fetch_time long, vector array<double>"


@pytest.mark.parametrize("cfg", [CFG, replace(CFG, small_size=10**9, ban_same_sites=False)])
def test_the_cycle_ends_like_a_rebuild(spark, tmp_path, cfg):
    batches = _changes(3 if cfg is CFG else 4)
    for k, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    live, seen = {}, {}
    for b in batches:
        for name, seq, gone, at, ttl, body in b:
            live.pop(name, None)
            if not gone:
                live[name] = (at, ttl, body)
                seen[name] = seq
    clock = max(r[3] for b in batches for r in b if r[3])
    expired = {n for n, (at, ttl, _) in live.items() if at + ttl < clock}
    want = {n: json.loads(v[2]) for n, v in live.items() if n not in expired}
    assert expired and len(want) > 12
    for k, v in cycle.STATE_SETTINGS.items():
        spark.conf.set(k, v)
    table = cycle.ThreadTable(spark, f"{tmp_path}/threads", cfg, parts=8)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    parse = lambda rows: rows.select("file_name", F.from_json("payload", BODY).alias("b")).select("file_name", "b.*")
    cycle.run_threads(table, stream, parse, f"{tmp_path}/cp").awaitTermination()
    got = {r["file_name"]: r for r in table.documents().collect()}
    assert set(got) == set(want)
    whole = spark.createDataFrame([(n, v["lang"], v["site_name"], v["fetch_time"], v["vector"]) for n, v in want.items()], "file_name string, lang string, site_name string, fetch_time long, vector array<double>")
    labels = {r["file_name"]: (r["lang"], r["thread_id"]) for r in linkage.threads(whole, cfg).collect()}

    def groups(of):
        out = {}
        for n in want:
            out.setdefault(of(n), set()).add(n)
        return sorted(map(sorted, out.values()))

    assert groups(lambda n: labels[n]) == groups(lambda n: got[n]["thread"])
    assert all(min(g) == got[g[0]]["thread"] for g in groups(lambda n: got[n]["thread"]))
    assert all(r["comp"] <= r["thread"] <= n for n, r in got.items())


def test_batches_are_planned_adaptively_and_files_share_states(spark, tmp_path):
    rows = [(f"f{k}", k, False, START + k, 50 if k < 90 else 500, "{}") for k in range(100)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.json(f"{tmp_path}/in")
    for k, v in cycle.STATE_SETTINGS.items():
        spark.conf.set(k, v)
    seen = []

    class Table:
        def apply(self, puts, gone):
            seen.append((puts.sparkSession.conf.get("spark.sql.adaptive.enabled"), {r[0] for r in puts.collect()}, {r[0] for r in gone.select("file_name").collect()}))

    table = Table()
    table.spark = spark
    before, cycle.BUCKETS = cycle.BUCKETS, 3
    try:
        query = cycle.run_threads(table, spark.readStream.schema(SCHEMA).json(f"{tmp_path}/in"), lambda p: p.select("file_name"), f"{tmp_path}/cp")
        query.awaitTermination()
    finally:
        cycle.BUCKETS = before
    assert {s[0] for s in seen} == {"true"}
    # The clock ends at START + 99: files of before START + 49 are stale then.
    assert seen[0][1] == {f"f{k}" for k in range(100)} and set().union(*(s[2] for s in seen[1:])) == {f"f{k}" for k in range(49)}


def test_near_any_like_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = lambda n, at: spark.createDataFrame([(f"{at}{k}", "en" if k % 4 else "de", rng.standard_normal(3).tolist() if k else [0.0] * 3) for k in range(n)], "file_name string, lang string, vector array<double>")
    left, right = rows(20, "l"), rows(90, "r")
    x, y = left.collect(), right.collect()
    unit = lambda v: np.float32(v).astype(float) / max(np.linalg.norm(np.float32(v)), 1e-8)
    want = {b["file_name"] for b in y for a in x if a["lang"] == b["lang"] and any(a["vector"]) and any(b["vector"]) and (1 - unit(a["vector"]) @ unit(b["vector"])) / 2 <= 0.05}
    got = [r[0] for r in pairs.near_any(left, right, 0.05, "file_name", ("lang",), 8).collect()]
    assert len(got) == len(set(got)) and set(got) == want and 5 < len(want) < 90


def test_a_batch_leaves_other_components_alone(spark, tmp_path):
    table = cycle.ThreadTable(spark, f"{tmp_path}/t", CFG, parts=32)
    eye = np.eye(40)
    rows = [(f"f{k:02}{s}", "en", f"s{k}{s}", START + k, (eye[k] + (0.01 if s else 0)).tolist()) for k in range(40) for s in (0, 1)]
    schema = "file_name string, lang string, site_name string, fetch_time long, vector array<double>"
    df = spark.createDataFrame(rows, schema)
    table.apply(df, df.select("file_name").limit(0))
    before, written = {r["file_name"]: r for r in table.documents().collect()}, files(tmp_path)
    table.apply(spark.createDataFrame([("new", "en", "q", START, eye[7].tolist())], schema), spark.createDataFrame([("f090",)], "file_name string"))
    after = {r["file_name"]: r for r in table.documents().collect()}
    assert {n for n in after if before.get(n) != after[n]} == {"new", "f091"}
    # Rows and filters of the parts of the batch's files and those they are linked with.
    assert len(files(tmp_path) - written) <= 2 * 5
    assert after["new"]["thread"] == "f070" and after["f091"]["comp"] == "f091"
    with pytest.raises(ValueError, match="budget"):
        cycle.ThreadTable(spark, f"{tmp_path}/u", EN_CLUSTERING)
