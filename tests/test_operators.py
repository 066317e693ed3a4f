import itertools
import os
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom import storage
from threadloom.config import EN_CLUSTERING, RankerConfig
from threadloom.operators import annotate, embed, importance, linkage, markup, metrics, order, pairs, rank, ratings, text, threads
from threadloom.operators.components import connected_components


def naive_link(dist, sites, cfg, budget):
    """The loop without any bookkeeping."""
    n = len(dist)
    d = dist.astype(np.float32).copy()
    np.fill_diagonal(d, 1)
    label, alive = list(range(n)), set(range(n))
    for _ in range(n - 1 if budget else 10**6):
        best = min(((d[i, j], i, j) for i in sorted(alive) for j in sorted(alive) if i != j), default=None)
        if best is None or best[0] > np.float32(cfg.small_threshold):
            break
        _, i, j = best
        own, other = ([k for k in range(n) if label[k] == label[x]] for x in (i, j))
        fits = linkage.size_allows(len(own) + len(other), float(best[0]), cfg) and not (cfg.ban_same_sites and {sites[k] for k in own} & {sites[k] for k in other})
        if not fits:
            d[i, j] = d[j, i] = 1
            continue
        for k in other:
            label[k] = label[i]
        d[i] = np.minimum(d[i], d[j])
        d[:, i] = d[i]
        d[i, i] = 1
        alive.discard(j)
    return label


def partition(labels):
    groups = {}
    for k, v in enumerate(labels):
        groups.setdefault(v, set()).add(k)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("seed", range(12))
def test_link_like_the_naive_loop(seed):
    rng = np.random.default_rng(seed)
    n = 14
    x = rng.integers(1, 40, (n, n)) / 100.0
    dist = np.triu(x, 1) + np.triu(x, 1).T
    sites = [f"s{k}" for k in rng.integers(0, 6, n)]
    cfg = replace(EN_CLUSTERING, small_threshold=0.2, medium_threshold=0.12, large_threshold=0.06, small_size=3, medium_size=5, large_size=7)
    for budget in (None, n - 1):
        label = list(range(n))
        edges = [(i, j, dist[i, j]) for i in range(n) for j in range(i)]
        for _, i, j, merged in linkage.link(n, edges, sites, cfg, budget):
            if merged:
                old = label[j]
                label = [label[i] if v == old else v for v in label]
        assert partition(label) == partition(naive_link(dist, sites, cfg, budget is not None))


def _docs(spark, n, seed, dim=3):
    rng = np.random.default_rng(seed)
    rows = [("en" if k % 3 else "de", f"{k:03}.html", f"s{int(rng.integers(0, 8))}", int(1000 + k // 2), rng.standard_normal(dim).astype(float).tolist()) for k in range(n)]
    return rows, spark.createDataFrame(rows, "lang string, file_name string, site_name string, fetch_time long, vector array<double>")


@pytest.mark.parametrize("budget", ["reference", "unbounded"])
def test_threads_like_the_naive_loop(spark, budget):
    rows, df = _docs(spark, 45, 5)
    cfg = replace(EN_CLUSTERING, small_threshold=0.02, medium_threshold=0.015, large_threshold=0.01, small_size=3, medium_size=5, large_size=8, budget=budget)
    got = {(r["lang"], r["file_name"]): r["thread_id"] for r in linkage.threads(df, cfg).collect()}
    for lang in ("en", "de"):
        own = sorted((r for r in rows if r[0] == lang), key=lambda r: (r[3], r[1]), reverse=True)
        x = np.array([r[4] for r in own])
        x /= np.linalg.norm(x, axis=1)[:, None]
        label = naive_link(np.maximum(1 - (x @ x.T + 1) / 2, 0), [r[2] for r in own], cfg, budget == "reference")
        assert partition(label) == partition([got[lang, r[1]] for r in own])


def test_chunks_stitch_by_shared_documents(spark):
    rows = [("en", f"{k:02}.html", f"s{k}", k, [1.0, 0.001 * (k % 3)]) for k in range(14)]
    df = spark.createDataFrame(rows, "lang string, file_name string, site_name string, fetch_time long, vector array<double>")
    cfg = replace(EN_CLUSTERING, small_size=100, chunk_size=6, chunk_overlap=2)
    assert linkage.threads(df, cfg).select("thread_id").distinct().count() == 1


def test_size_limits_at_equality():
    cfg = EN_CLUSTERING
    assert linkage.size_allows(10, 0.9, cfg) and linkage.size_allows(20, cfg.medium_threshold, cfg) and linkage.size_allows(30, cfg.large_threshold, cfg)
    assert not linkage.size_allows(11, 0.0401, cfg) and not linkage.size_allows(31, 0.0, cfg)


def test_pairs_over_blocks_and_zero_vectors(spark):
    rows, df = _docs(spark, 40, 9)
    df = df.withColumn("id", F.monotonically_increasing_id()).unionByName(df.limit(1).select("lang", "file_name", "site_name", "fetch_time", F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("vector"), F.lit(-1).cast("long").alias("id")))
    whole = {(r["a"], r["b"]) for r in pairs.cosine_pairs(df, 0.1).collect()}
    cut_up = [(r["a"], r["b"]) for r in pairs.cosine_pairs(df, 0.1, block=7).collect()]
    assert len(cut_up) == len(set(cut_up)) and set(cut_up) == whole and not any(-1 in p for p in whole) and whole


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(18)] + ([(i, i + 1) for i in range(100, 140)] if seed == 0 else [])
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["key"]: r["comp"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in label.items() if any(a != b and k in (a, b) for a, b in edges)}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rank_like_the_three_branches(spark):
    rng = random.Random(3)
    rows = [(f"t{k}", 0, "sports", rng.choice([1, 2, 3, 5, 10]), 100 + k, 1000, rng.random()) for k in range(40)]
    df = spark.createDataFrame(rows, "thread_id string, lang_ord int, category string, size int, freshest_ts long, best_ts long, importance double")
    clock = spark.createDataFrame([(1000,)], "iter_ts long")
    got = [r["thread_id"] for r in rank.rank(df, clock, RankerConfig()).where("category = 'any'").orderBy("rank").collect()]

    def before(a, b):
        if a[3] == b[3]:
            return a[6] > b[6]
        if a[3] < 3 or b[3] < 3:
            return a[3] > b[3]
        return a[6] > b[6]

    by = {r[0]: r for r in rows}
    assert not any(before(by[b], by[a]) for a, b in itertools.combinations(got, 2))


def test_importance_like_the_double_loop(spark):
    rng = random.Random(4)
    rows = [("t", 1000 + rng.choice([0, 0, 50, 4000, 90000]), f"u{k:02}", f"h{rng.randrange(5)}") for k in range(25)]
    df = spark.createDataFrame(rows, "thread_id string, fetch_time long, url string, host string")
    df = df.withColumn("raw", F.length("host") + F.substring("host", 2, 1).cast("double")).withColumns({f"share_{c}": F.lit(1.5) for c in ("us", "gb", "in", "ru", "ca", "au")})
    got = {r["combo"]: (r["importance"], r["best_ts"]) for r in importance.importance(df, importance.COMBINATIONS).collect()}
    docs = sorted(rows, key=lambda r: (r[1], r[2]))
    for combo, (kind, shift, decay) in enumerate(importance.COMBINATIONS):
        best = (0.0, 0)
        for i, start in enumerate(docs):
            seen, total = set(), 0.0
            for _, t, _, h in docs[i:]:
                if h not in seen:
                    seen.add(h)
                    raw = (2 + int(h[1])) * 0.97
                    w = {"one": 1.0, "raw": raw}.get(kind) or max(np.log(raw + shift), 0.3)
                    total += w / (1 + np.exp(-max((start[1] - t) / decay, -15)))
            if total > best[0] + 1e-10:
                best = (total, start[1])
        assert got[combo][0] == pytest.approx(best[0]) and got[combo][1] == best[1]
    assert importance.features(df).select(F.size("features")).first()[0] == 50


def test_category_ties_go_to_the_lowest_ordinal(spark):
    df = spark.createDataFrame([("t", "sports"), ("t", "economy"), ("t", "science"), ("t", "sports"), ("t", "economy")], "thread_id string, category string")
    assert threads.category(df).first()["category"] == "economy"


@pytest.mark.parametrize(("n", "p", "want"), [(0, 0.99, None), (1, 0.99, 0), (99, 0.99, 98), (100, 0.99, 99), (101, 0.99, 99), (100, 1.0, 99)])
def test_percentile(spark, n, p, want):
    df = spark.range(n).select(F.col("id").alias("fetch_time"))
    got = threads.nth_timestamp(df, p).collect()
    assert [r["iter_ts"] for r in got] == ([] if want is None else [want])


def test_pagerank_sums_to_one(spark):
    edges = spark.createDataFrame([("a", "b", 2), ("b", "a", 1), ("b", "c", 1), ("c", "zzz", 1)], "src string, dst string, n long")
    got = {r["host"]: r["rating"] for r in ratings.pagerank(edges, rounds=8).collect()}
    m = np.array([[0, 1, 0], [0.5, 0, 0.5], [1 / 3, 1 / 3, 1 / 3]])
    want = np.ones(3) / 3 @ np.linalg.matrix_power(0.7 * m + 0.1, 8)
    assert [got[h] for h in "abc"] == pytest.approx(want.tolist())


def test_votes(spark):
    df = spark.createDataFrame([("k", "a"), ("k", "a"), ("k", "a"), ("k", "b"), ("l", "a"), ("l", "b")], "key string, label string")
    assert [tuple(r) for r in metrics.majority(df, 3).collect()] == [("k", "a", 3, 4)]
    assert metrics.majority(df, 1, 0.8).count() == 0


def test_known_pairs_leave_in_both_orders(spark):
    c = spark.createDataFrame([("a", "b"), ("c", "d")], "first_url string, second_url string")
    k = spark.createDataFrame([("b", "a")], "first_url string, second_url string")
    assert [tuple(r) for r in markup.new_pairs(c, k).collect()] == [("c", "d")]


def test_pooling_reads_one_word_more():
    lookup = {"a": np.array([3.0, 0]), "b": np.array([0, 2.0]), "z": np.zeros(2)}
    get = lambda w: lookup.get(w, np.zeros(2))
    assert embed.pool(["a", "z", "a", "b"], get, "avg", 1).tolist() == [1.0, 0.0]
    assert embed.pool(["a", "b"], get, "max", 5).tolist() == [1.0, 1.0]
    assert embed.pool(["a", "b"], get, "matrix", 5).tolist() == [0.5, 0.5, 1, 1, 0, 0]
    assert embed.pool([], get, "avg", 5).tolist() == [0.0, 0.0]


def test_annotation_and_trained_classifier(spark):
    raw = spark.createDataFrame([("1.html", "https://a.org/1", "The match of the season", "", "the team and the coach of the league won the match in the end", 5)], "file_name string, url string, title string, description string, text string, fetch_time long")
    got = annotate.annotate(raw.withColumn("out_links", F.array().cast("array<string>"))).first()
    assert (got["lang"], got["category"], got["host"]) == ("en", "sports", "a.org")
    rows = spark.createDataFrame([("good words here", "x"), ("bad signs there", "y")] * 10, "text string, label string")
    out = annotate.TrainedClassifier(iterations=5).fit(rows).transform(rows)
    assert out.where("label <> predicted").count() == 0


def test_task_pools_hold_every_article(spark, data):
    from threadloom.plans import registry, views

    dealt = {r["url"] for r in registry.QUERIES["task_pools"](spark, data).collect()}
    assert dealt >= {r["url"] for r in views.articles(spark, data).where("coalesce(title, '') <> '' and coalesce(text, '') <> ''").select("url").collect()}


@pytest.mark.parametrize("name", ["hashed_vectors", "unknown_symbols_bytes"])
def test_text_queries_read_documents_without_vectors_and_whole_first_lines(spark, data, tmp_path, name):
    from threadloom.plans import registry

    docs = spark.read.parquet(f"{data}/documents.parquet").where("doc_id < 3").withColumn("text", F.concat(F.lit("a" * 130), F.repeat(F.lit(" w"), 60), F.repeat(F.lit("\u4e16"), 600), F.lit("\nb")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("embeddings", "events"):
        spark.read.parquet(f"{data}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    rows = registry.QUERIES[name](spark, str(tmp_path)).collect()
    assert len(rows) == 3
    if name == "hashed_vectors":
        assert all(len(r["vector"].split(",")) == 50 for r in rows)
    else:
        assert all(r["bad"] for r in rows)


@pytest.mark.parametrize("parts", [1, 5])
def test_running_sums_by_ranges(spark, parts):
    rows = [(k % 7, k, k % 4) for k in range(60)]
    df = spark.createDataFrame(rows, "a int, b int, v int")
    got = {r["b"]: r["s"] for r in order.running_sum(df, ["a", "b"], F.col("v"), "s", parts).collect()}
    total = 0
    for _, b, v in sorted(rows):
        assert got[b] == total
        total += v
    assert order.running_sum(df.limit(0), ["a"], F.col("v"), "s").columns == ["a", "b", "v", "s"]


def test_too_many_controls_are_refused(spark, monkeypatch):
    monkeypatch.setattr(markup, "MOST_CONTROLS", 2)
    rows = spark.createDataFrame([(f"u{k}", "t", "x") for k in range(5)], "url string, title string, text string")
    assert markup.pools(rows, rows.limit(2), 2).count() == 5 + 3 * 2
    with pytest.raises(ValueError, match="controls"):
        markup.pools(rows, rows.limit(3), 2)


def test_a_shared_folder_is_needed_on_a_cluster():
    class Other:
        conf: dict = {}

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Other)


def test_cut_tables_can_be_cleared(spark, monkeypatch):
    monkeypatch.setattr(spark, "_threadloom_cut", [], raising=False)
    kept = storage.cut(spark.range(5))
    at = spark._threadloom_cut[0].removeprefix("file:").replace("//", "/", 1)
    assert kept.count() == 5 and os.path.isdir(at)
    assert storage.clear(spark) == 1 and not os.path.isdir(at) and storage.clear(spark) == 0


def test_a_matrix_too_large_to_broadcast_is_refused(spark):
    with pytest.raises(ValueError, match="numbers"):
        embed.TfIdfEmbedder(spark.range(1), matrix=np.zeros((4, 5)), most=19)


def test_tfidf_counts_tokens_once_for_each_document(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, "")], "doc_id int, text string")
    words = F.split("text", " ")
    plan = text.tfidf(docs, words, spark.createDataFrame([("a", 2.0)], "token string, idf double"))
    assert [tuple(r) for r in plan.collect()] == [(1, "a", 2 / 3, 4 / 3)]
    assert "split(text" not in plan._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]


def test_tfidf_embedder_with_a_matrix(spark):
    docs = spark.createDataFrame([("1", "a b", "a"), ("2", "zz", "zz")], "file_name string, title string, text string")
    vocabulary = spark.createDataFrame([("a", 0, 3.0), ("b", 1, 6.0)], "token string, idx int, idf double")
    dense = {r["file_name"]: r["vector"] for r in embed.TfIdfEmbedder(vocabulary).transform(docs).collect()}
    assert dense["1"] == pytest.approx([2.0, 2.0]) and dense["2"] in ([0.0, 0.0], [0, 0])
    matrix = np.array([[1.0, 0, 2], [0, 1, 1]])
    got = {r["file_name"]: r["vector"] for r in embed.TfIdfEmbedder(vocabulary, matrix=matrix).transform(docs).collect()}
    assert got["1"] == pytest.approx([2.0, 2.0, 6.0]) and got["2"] == [0.0, 0.0, 0.0]


def test_token_id_embedder(spark):
    docs = spark.createDataFrame([("a b zz",), (None,)], "text string")
    vocabulary = spark.createDataFrame([("a", 5), ("b", 7)], "token string, idx int")
    rows = embed.TokenIdEmbedder(vocabulary, lambda: lambda ids: np.stack([ids.sum(axis=1), (ids == 0).sum(axis=1)], axis=1), "text").transform(docs).collect()
    assert rows[0]["vector"] == [12.0, 1.0] and rows[1]["vector"][0] == 0.0
    with pytest.raises(ValueError, match="tokens"):
        embed.TokenIdEmbedder(vocabulary, None, most=1).transform(docs)


def test_siamese_gradient_by_differences():
    rng = np.random.default_rng(1)
    x, y, label = rng.standard_normal((6, 4)), rng.standard_normal((6, 4)), np.array([0, 1, 1, 0, 1, 0.0])
    w, b, f = rng.standard_normal((4, 3)), rng.standard_normal(3), embed.SiameseTrainer.gradient
    _, gw, gb, gs, gc = f(x, y, label, w, b, 1.3, 0.2)
    e = 1e-6
    for i, j in ((0, 0), (2, 1), (3, 2)):
        d = np.zeros_like(w)
        d[i, j] = e
        assert (f(x, y, label, w + d, b, 1.3, 0.2)[0] - f(x, y, label, w - d, b, 1.3, 0.2)[0]) / (2 * e) == pytest.approx(gw[i, j], abs=1e-4)
    d = np.array([e, 0, 0])
    assert (f(x, y, label, w, b + d, 1.3, 0.2)[0] - f(x, y, label, w, b - d, 1.3, 0.2)[0]) / (2 * e) == pytest.approx(gb[0], abs=1e-4)
    assert (f(x, y, label, w, b, 1.3 + e, 0.2)[0] - f(x, y, label, w, b, 1.3 - e, 0.2)[0]) / (2 * e) == pytest.approx(gs, abs=1e-4)
    assert (f(x, y, label, w, b, 1.3, 0.2 + e)[0] - f(x, y, label, w, b, 1.3, 0.2 - e)[0]) / (2 * e) == pytest.approx(gc, abs=1e-4)


def test_siamese_map_learns_which_directions_count(spark):
    """Pairs belong together when their first two of six coordinates agree; the rest is noise."""
    rng = np.random.default_rng(5)

    def pairs_of(n):
        out = []
        for k in range(n):
            a = rng.standard_normal(2)
            b = a if k % 2 else -a
            out.append(([*map(float, a), *map(float, 3 * rng.standard_normal(4))], [*map(float, b), *map(float, 3 * rng.standard_normal(4))], k % 2))
        return spark.createDataFrame(out, "left array<double>, right array<double>, label int")

    trainer = embed.SiameseTrainer(dim=2, epochs=25, rate=0.2).fit(pairs_of(200), pairs_of(60))
    w, b = trainer.model()
    cos = []
    for r in pairs_of(100).collect():
        u, v = np.array(r["left"]) @ w + b, np.array(r["right"]) @ w + b
        cos.append((u @ v / np.linalg.norm(u) / np.linalg.norm(v), r["label"]))
    right = sum((c > 0) == bool(y) for c, y in cos)
    assert right > 80
    with pytest.raises(ValueError, match="no pairs"):
        trainer.fit(pairs_of(2).limit(0))


def test_category_models_by_language(spark):
    docs = spark.createDataFrame([("1", "en", "t", "good words here"), ("2", "ru", "t", "bad signs there"), ("3", "fr", "t", "good"), ("4", None, "t", "good")], "file_name string, lang string, title string, text string")
    fit = lambda a, b: annotate.TrainedClassifier(iterations=5).fit(spark.createDataFrame([("t good words here", a), ("t bad signs there", b)] * 10, "text string, label string"))
    got = {r["file_name"]: r for r in annotate.by_trained({"en": fit("sports", "economy"), "ru": fit("science", "society")})(docs).collect()}
    assert {k: r["category"] for k, r in got.items()} == {"1": "sports", "2": "society", "3": "other", "4": "other"}
    assert got["1"]["text"] == "good words here"


def test_limits_that_bind_nothing_give_components(spark):
    _, df = _docs(spark, 30, 8)
    cfg = replace(EN_CLUSTERING, small_threshold=0.02, small_size=10**9, ban_same_sites=False, budget="unbounded", chunk_size=1000, chunk_overlap=0)
    assert linkage.free(cfg) and not linkage.free(EN_CLUSTERING)
    one = {(r["lang"], r["file_name"]): r["thread_id"] for r in linkage.threads(df, cfg).collect()}
    other = {(r["lang"], r["file_name"]): r["thread_id"] for r in linkage.threads(df, replace(cfg, small_size=999)).collect()}
    assert one == other


@pytest.mark.parametrize(("name", "chunk"), [("constrained_threads", None), ("chunk_stitch", (60, 20))])
def test_thread_queries_like_the_naive_loop(spark, data, name, chunk):
    """Chunk by chunk with the plain loop, chunks that share a document united."""
    from threadloom.plans import registry, views
    from threadloom.plans.query_threads import _LOOSE

    got = {(r["lang"], r["file_name"]): r["thread_id"] for r in registry.QUERIES[name](spark, data).collect()}
    rows = views.articles(spark, data, True).select("lang", "file_name", "site_name", "fetch_time", "vector").collect()
    size, overlap = chunk or (_LOOSE.chunk_size, _LOOSE.chunk_overlap)
    for lang in {r["lang"] for r in rows}:
        own = sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["fetch_time"], r["file_name"]), reverse=True)
        top, start = list(range(len(own))), 0
        while True:
            part = own[start : start + size]
            x = np.array([r["vector"] for r in part], float)
            x /= np.linalg.norm(x, axis=1)[:, None]
            label = naive_link(np.maximum(1 - (x @ x.T + 1) / 2, 0), [r["site_name"] for r in part], _LOOSE, True)
            for k, v in enumerate(label):
                a, b = top[start + k], top[start + v]
                top = [min(a, b) if t in (a, b) else t for t in top]
            if start + size >= len(own):
                break
            start += size - overlap
        assert partition(top) == partition([got[lang, r["file_name"]] for r in own])


def test_mode_threads_like_its_parts(spark, data):
    from threadloom.plans import registry

    labels = registry.QUERIES["constrained_threads"](spark, data).collect()
    want = {}
    for r in sorted(labels, key=lambda r: r["seq"]):
        want.setdefault(f"{r['lang']}-{r['thread_id']}", []).append(r["file_name"])
    assert {r["thread_id"]: r["articles"].split(",") for r in registry.QUERIES["mode_threads"](spark, data).collect()} == want


def test_hashed_vectors_like_plain_python(spark, data):
    from threadloom.functions.scalars import preprocess
    from threadloom.plans import registry, views

    got = {r["file_name"]: [float(x) for x in r["vector"].split(",")] for r in registry.QUERIES["hashed_vectors"](spark, data).collect()}
    for r in views.headed(spark, data).select("file_name", preprocess(F.col("title")).alias("t")).collect():
        rows = [v / np.linalg.norm(v) for v in (embed.word_vector(w, 50) for w in (r["t"] or "").split()[:151])]
        want = np.mean(rows, axis=0) if rows else np.zeros(50)
        assert got[r["file_name"]] == pytest.approx(want.tolist(), abs=2e-4)
