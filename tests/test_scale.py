"""What large groups cost: ranges in place of windows, bins in place of pairs, cells in place of all blocks."""

import random
import tracemalloc
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.config import EN_CLUSTERING
from threadloom.operators import importance, linkage, order, pairs


@pytest.mark.parametrize("parts", [1, 6])
def test_grouped_order_like_sorted_lists(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["x", "x", "x", "y", "z", None]), k, rng.randrange(9)) for k in range(150)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k int, v int")
    want = {}
    for g in ("x", "y", "z", None):
        total, before = 0, None
        for at, (_, k, v) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1])):
            want[k] = (at, total, before)
            total, before = total + v, v
    at = {r["k"]: r["p"] for r in order.position(df, ("g",), ["k"], "p", parts).collect()}
    total = {r["k"]: r["s"] for r in order.running_sum(df, ["k"], F.col("v"), "s", parts, ("g",)).collect()}
    before = {r["k"]: r["b"] for r in order.previous(df, ("g",), ["k"], "v", "b", parts).collect()}
    assert {k: (at[k], total[k], before[k]) for k in at} == want and len(want) == 150
    down = {r["k"]: r["p"] for r in order.position(df, ("g",), [F.col("k").desc()], "p", parts).collect()}
    sizes = {g: sum(r[0] == g for r in rows) for g in ("x", "y", "z", None)}
    assert all(down[k] == sizes[g] - 1 - want[k][0] for g, k, _ in rows)
    assert order.position(df.limit(0), ("g",), ["k"], "p").count() == 0


def test_a_null_value_before_is_not_the_first_of_the_group(spark):
    df = spark.createDataFrame([("x", k, None if k == 3 else k) for k in range(12)], "g string, k int, v int")
    assert {r["k"]: r["b"] for r in order.previous(df, ("g",), ["k"], "v", "b", 4).collect()} == {k: None if k in (0, 4) else k - 1 for k in range(12)}


def test_a_large_thread_compares_starts_with_hosts_not_with_documents(spark):
    n, hosts = 20_000, 40
    rng = random.Random(1)
    rows = [("t", k // 3, f"u{k:05}", f"h{rng.randrange(hosts)}") for k in range(n)]
    df = spark.createDataFrame(rows, "thread_id string, fetch_time long, url string, host string")
    df = df.withColumn("raw", F.lit(3.0)).withColumns({f"share_{c}": F.lit(1.5) for c in ("us", "gb", "ru")})
    starts, spans = importance.meetings(df)
    compared = starts.groupBy("_bin").count().join(spans.groupBy("_bin").agg(F.count("*").alias("m")), "_bin").agg(F.sum(F.col("count") * F.col("m"))).first()[0]
    met = starts.join(spans, ["thread_id", "_bin"]).where("_i <= _j and _i > _prev")
    assert met.count() <= n * hosts and met.select("_i", "host").distinct().count() == met.count()
    assert compared <= n * (hosts + 2 * importance.BIN) < n * n / 100


def _crowds(seed, crowds, each, dim=16, spread=0.12):
    rng = np.random.default_rng(seed)
    middles = rng.standard_normal((crowds, dim))
    middles /= np.linalg.norm(middles, axis=1)[:, None]
    x = np.repeat(middles, each, axis=0) + spread * rng.standard_normal((crowds * each, dim)) / dim**0.5
    return np.concatenate([x, np.zeros((2, dim)), x[:3]])


@pytest.mark.parametrize(("crowds", "each"), [(30, 20), (3, 200), (600, 1)])
def test_cells_lose_no_pair_and_keep_far_ones_apart(spark, crowds, each):
    x, threshold = _crowds(crowds, crowds, each), 0.045
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vector array<double>")
    got = [(r["a"], r["b"]) for r in pairs.cosine_pairs(df, threshold, block=32).collect()]
    u, has = pairs.unit_rows(x.astype(np.float32).astype(float))
    near = (np.maximum(1 - (u @ u.T + 1) / 2, 0) <= threshold) & has[:, None] & has[None]
    assert len(got) == len(set(got)) and set(got) == {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)}
    base = df.select(F.lit(0).cast("long").alias("g"), "id", F.transform("vector", lambda v: v.cast("float")).alias("v"))
    sides = pairs.deal(base, threshold, 32).groupBy("i", "j").agg(F.sum((F.col("blk") == F.col("i")).cast("int")).alias("p"), F.sum((F.col("blk") == F.col("j")).cast("int")).alias("q"))
    compared = sides.agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("p") * (F.col("p") - 1) / 2).otherwise(F.col("p") * F.col("q")))).first()[0]
    if crowds == 30:
        assert compared < 0.35 * len(x) ** 2 / 2


def test_pairs_carry_columns_of_both_rows(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((150, 4)), np.zeros((2, 4)), np.ones((3, 4))]).astype(np.float32)
    df = spark.createDataFrame([(k, 1000 + 7 * k, v.tolist()) for k, v in enumerate(x)], "id long, at long, vector array<float>")
    u, has = pairs.unit_rows(x.astype(float))
    dist = np.maximum(1 - (u @ u.T + 1) / 2, 0)
    near = np.triu((dist <= 0.1) & has[:, None] & has[None], 1)
    want = {(int(a), int(b), 1000 + 7 * int(a), 1000 + 7 * int(b), round(float(dist[a, b]), 9)) for a, b in zip(*np.nonzero(near), strict=True)}
    for block in (None, 16):
        got = [(r["a"], r["b"], r["at_a"], r["at_b"], round(r["dist"], 9)) for r in pairs.cosine_pairs(df, 0.1, block=block, carry=("at",)).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_a_large_group_is_dealt_in_few_blocks(spark, monkeypatch):
    """Vectors among which nothing can be ruled out: a row travels once for each block, however many rows there are."""
    monkeypatch.setattr(pairs, "TILE", 8)
    x = np.random.default_rng(3).standard_normal((1600, 32))
    df = spark.createDataFrame([(0, k, v.tolist()) for k, v in enumerate(x)], "g long, id long, v array<float>")
    dealt = pairs.deal(df, 0.3)
    assert dealt.select("blk").distinct().count() >= pairs.MANY / 2
    assert dealt.groupBy("id").count().agg(F.max("count")).first()[0] <= 2 * pairs.MANY


def _joined_pairs(df):
    """Joins of a plan that stand above the comparison of blocks."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(k for k, x in enumerate(lines) if "FlatMapGroupsInArrow" in x)
    return [x for x in lines[:at] if "Join" in x]


def test_distances_with_a_time_penalty_join_no_pairs(spark, data):
    from threadloom.plans.registry import QUERIES

    assert _joined_pairs(QUERIES["time_penalty_distance"](spark, data)) == []


def test_distances_of_two_vectors_join_no_pairs(spark, data):
    from threadloom.plans.registry import QUERIES

    assert _joined_pairs(QUERIES["weighted_distance"](spark, data)) == []


def test_distances_by_leading_elements(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((90, 6)).astype(np.float32)
    x[4:9, :2] = 0
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vector array<float>")

    def dist(y):
        u, has = pairs.unit_rows(y.astype(float))
        return np.where(has[:, None] & has[None], np.maximum(1 - (u @ u.T + 1) / 2, 0), 1)

    whole, head = dist(x), dist(x[:, :2])
    want = {(int(a), int(b)): (round(float(whole[a, b]), 9), round(float(head[a, b]), 9)) for a, b in zip(*np.nonzero(np.triu(whole <= 0.3, 1)), strict=True)}
    for block in (None, 16):
        got = {(r["a"], r["b"]): (round(r["dist"], 9), round(r["head_2"], 9)) for r in pairs.cosine_pairs(df, 0.3, block=block, heads=(2,)).collect()}
        assert got == want and any(v[1] == 1 for v in want.values())


def test_a_forest_connects_what_all_pairs_do(spark):
    x = _crowds(2, 12, 25)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vector array<double>")
    whole = pairs.cosine_pairs(df, 0.045, block=32)
    only = pairs.cosine_pairs(df, 0.045, block=32, forest="only")
    labels = lambda e: {(r["key"], r["comp"]) for r in linkage.connected_components(e.select("a", "b")).collect()}
    assert labels(only) == labels(whole) and only.where("not tree").isEmpty()
    assert only.count() < whole.count() / 2
    assert pairs.cosine_pairs(df, 0.045, block=32, forest="mark").count() == whole.count()


@pytest.mark.parametrize(("crowds", "each", "threshold"), [(12, 25, 0.045), (1, 300, 0.2), (250, 1, 0.2), (250, 1, 0.3)])
def test_near_components_are_those_of_all_pairs(spark, monkeypatch, crowds, each, threshold):
    """Stories apart, one story, and near-random vectors of which some stay outside of the largest component."""
    monkeypatch.setattr(pairs, "TILE", 8)
    x = _crowds(7, crowds, each)
    df = spark.createDataFrame([(k, "x" if k % 9 else "y", v.tolist()) for k, v in enumerate(x)], "id long, lang string, vector array<double>")
    got = pairs.near_components(df, threshold, group=("lang",), block=32)
    want = linkage.connected_components(pairs.cosine_pairs(df, threshold, group=("lang",)).select("a", "b"))
    assert sorted(map(tuple, got.select("id", "comp").collect())) == sorted(map(tuple, want.collect()))


def test_one_component_is_not_compared_as_a_square(monkeypatch):
    n = 12_000
    rows, compared = pairs._Near(np.random.default_rng(1).standard_normal((n, 64)), 0.33), []
    whole = rows.tile
    monkeypatch.setattr(rows, "tile", lambda p, q: compared.append(len(p) * len(q)) or whole(p, q))
    label = np.arange(n)
    p, q = rows.links(np.arange(n), np.arange(n), label)
    assert sum(compared) < 0.4 * n * n / 2
    # Some rows stay alone; each pair joins two components, and all are near.
    assert len(p) == n - len(set(label.tolist())) > 0.98 * n and (rows.dist(p, q) <= 0.33).all()


def test_near_values_are_those_of_the_near_rows(spark):
    rng = np.random.default_rng(4)
    side = lambda n: spark.createDataFrame([(f"{k}", k % 13, rng.standard_normal(4).tolist()) for k in range(n)], "id string, comp int, vector array<double>")
    left, right = side(30).cache(), side(200).cache()
    for block, threshold in ((None, 0.002), (8, 0.002), (8, 0.2)):
        near = pairs.near_any(left, right, threshold, block=block)
        want = {r[0] for r in right.join(near, "id").select("comp").collect()}
        got = [r[0] for r in pairs.near_any(left, right, threshold, block=block, once="comp").collect()]
        assert len(got) == len(set(got)) and set(got) == want and want


@pytest.mark.parametrize("seed", range(6))
def test_components_in_arrays(seed):
    rng = np.random.default_rng(seed)
    i, j = rng.integers(0, 80, (2, 45)) if seed else (np.arange(99), np.arange(1, 100))
    label = {x: x for x in [*i.tolist(), *j.tolist()]}
    for _ in label:
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            label[a] = label[b] = min(label[a], label[b])
    assert dict(zip(*map(np.ndarray.tolist, linkage.components(i, j)), strict=True)) == label


@pytest.mark.parametrize("seed", range(8))
def test_matrix_and_maps_make_the_same_log(seed):
    rng = np.random.default_rng(seed)
    n = 40
    keep = np.argwhere(np.triu(rng.random((n, n)) < 0.7, 1))
    x = rng.integers(1, 12 if seed % 2 else 200, len(keep)) / 1000
    sites = [f"s{k}" for k in rng.integers(0, 25, n)]
    cfg = replace(EN_CLUSTERING, small_threshold=0.2, medium_threshold=0.12, large_threshold=0.06, small_size=3, medium_size=6, large_size=9, ban_same_sites=bool(seed % 3))
    for budget in (None, n - 1):
        one, two = (linkage.link(n, (keep[:, 0], keep[:, 1], x), sites, cfg, budget, dense) for dense in (False, True))
        assert one == two and one


def test_five_thousand_equal_documents_in_one_component():
    n = 5000
    i, j = (e.astype(np.int32) for e in np.triu_indices(n, 1))
    tracemalloc.start()
    log = linkage.link(n, (i, j, np.zeros(len(i), np.float32)), [f"s{k}" for k in range(n)], EN_CLUSTERING, n - 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(log) == n - 1 and sum(e[3] for e in log[:29]) == 29 and peak < 1e9


def test_equal_documents_through_the_whole_operator(spark):
    rows = [("en", f"{k:04}.html", f"s{k}", k, [1.0, 0.5, 0.25]) for k in range(700)]
    df = spark.createDataFrame(rows, "lang string, file_name string, site_name string, fetch_time long, vector array<double>")
    sizes = linkage.threads(df, EN_CLUSTERING).groupBy("thread_id").count().select("count").collect()
    # The loop gives up after as many rounds as rows: the first thread fills, then its refusals use the rounds up.
    assert sum(r[0] for r in sizes) == 700 and max(r[0] for r in sizes) == EN_CLUSTERING.large_size
    free = linkage.threads(df, replace(EN_CLUSTERING, budget="unbounded")).groupBy("thread_id").count()
    assert sorted(r[1] for r in free.collect()) == [10] + [30] * 23


def test_time_penalty_and_chunks_like_the_naive_loop(spark):
    """Documents up to four days apart: distances grow with the days, and pairs of the forests may be cut."""
    from .test_operators import naive_link, partition

    rng = np.random.default_rng(6)
    rows = [("en", f"{k:03}.html", f"s{int(rng.integers(0, 8))}", int(1_600_000_000 + rng.integers(0, 96) * 3600), rng.standard_normal(3).tolist()) for k in range(60)]
    df = spark.createDataFrame(rows, "lang string, file_name string, site_name string, fetch_time long, vector array<double>")
    cfg = replace(EN_CLUSTERING, small_threshold=0.05, medium_threshold=0.04, large_threshold=0.03, small_size=3, medium_size=5, large_size=8, time_penalty=True, budget="unbounded", chunk_size=40, chunk_overlap=15)
    got = {r["file_name"]: r["thread_id"] for r in linkage.threads(df, cfg).collect()}
    own = sorted(rows, key=lambda r: (r[3], r[1]), reverse=True)
    top, start = list(range(len(own))), 0
    while start == 0 or start + cfg.chunk_overlap < len(own):
        part = own[start : start + cfg.chunk_size]
        x = np.array([r[4] for r in part], np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        hours = np.abs(np.subtract.outer([r[3] for r in part], [r[3] for r in part])) / 3600
        dist = np.minimum(np.maximum(1 - (x @ x.T + 1) / 2, 0).astype(np.float32) * np.where(hours >= 24, hours / 24, 1), 1)
        for k, v in enumerate(naive_link(dist, [r[2] for r in part], cfg, False)):
            a, b = top[start + k], top[start + v]
            top = [min(a, b) if t in (a, b) else t for t in top]
        start += cfg.chunk_size - cfg.chunk_overlap
    assert partition(top) == partition([got[r[1]] for r in own]) and len(set(top)) < 55
