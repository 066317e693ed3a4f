import random

import pytest
from pyspark.sql import functions as F

from threadloom.llm import mixing as m

from .conftest import prose


def naive_targets(sizes, weights=m.WEIGHTS, cap=m.CAP):
    """sizes by source in order; reshare until no target is above its cap."""
    total, left, capped = float(sum(sizes)), set(range(len(sizes))), set()
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    while True:
        rest = total - sum(cap * sizes[i] for i in capped)
        level = rest / sum(w[i] for i in left) if left else 0
        over = {i for i in left if level * w[i] > cap * sizes[i]}
        if not over:
            return [cap * sizes[i] if i in capped else level * w[i] for i in range(len(sizes))]
        capped |= over
        left -= over


@pytest.mark.parametrize("seed", range(6))
def test_targets_like_resharing(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 5, 40, 1000]) for _ in range(rng.randint(1, 9))]
    df = spark.createDataFrame([(f"={k}", f"s{k}", s) for k, s in enumerate(sizes)], "_k string, source string, source_size long")
    got = {r["_k"]: r["target"] for r in m.source_targets(df).collect()}
    assert [got[f"={k}"] for k in range(len(sizes))] == pytest.approx(naive_targets(sizes))


def check(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * (r["epochs"] + r["drawn"])
    order = sorted(by, key=lambda s: (s is None, s))
    sizes = [sum(r["size"] for r in by[s]) for s in order]
    for s, target, size in zip(order, naive_targets(sizes), sizes, strict=True):
        assert by[s][0]["target"] == pytest.approx(target) and by[s][0]["source_size"] == size
        taken = sum(r["taken"] for r in by[s])
        assert abs(taken - target) <= max([r["size"] for r in by[s]]) / 2 + 1e-6
        assert len({r["epochs"] for r in by[s]}) == 1
    return order


def test_mix_keeps_its_targets(spark, data, edge, nothing):
    rows = m.query(spark, data).collect()
    check(rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, m.query(spark, data).collect()))
    small = m.mix(edge, m.word_count(F.col("text")), F.lit(None).cast("double"), carry=("text", "size", "key"))
    got = small.collect()
    assert len(got) == edge.count() and None in check(got) and small.columns.count("size") == 1
    assert m.mix(nothing, F.col("n_chars"), F.lit(1.0)).count() == 0


@pytest.mark.parametrize("bins", [1, 16, 4096])
def test_slices_change_nothing(spark, docs_of, bins):
    df = docs_of([prose(k, 5 + k % 40) for k in range(300)], sources=["a" if k % 3 else "b" for k in range(300)])
    run = lambda n: sorted((r["doc_id"], r["taken"]) for r in m.mix(df, m.word_count(F.col("text")), F.lit(1.0), bins=n).collect())
    assert run(bins) == run(64)


def test_quality_weighs(spark, docs_of):
    df = docs_of([prose(k, 20) for k in range(900)], sources=["a"] * 300 + ["b"] * 600)
    rows = m.mix(df, m.word_count(F.col("text")), F.when(F.col("doc_id") % 2 == 0, 2.0).otherwise(0.5)).where("source = 'b'").collect()
    good, bad = ([r["drawn"] for r in rows if r["doc_id"] % 2 == k] for k in (0, 1))
    assert 0 < sum(bad) < 0.6 * sum(good)


def test_selection_like_sorting_by_key(spark, docs_of):
    """Within a source, by key and then id: whole prefixes are drawn, and the one that crosses the budget if that ends nearer."""
    df = docs_of([prose(k, 5 + k % 40) for k in range(250)], sources=["a" if k % 3 else "b" for k in range(250)])
    n, weight = m.word_count(F.col("text")), F.when(F.col("doc_id") % 4 == 0, 2.0).otherwise(1.0)
    key = F.lit(-1.0) * F.log(m.unit(F.lit(17), F.col("doc_id"), n.cast("long"))) / weight
    keys = {r["doc_id"]: r["k"] for r in df.select("doc_id", key.alias("k")).collect()}
    rows = m.mix(df, n, weight).collect()
    for source in "ab":
        own = sorted((r for r in rows if r["source"] == source), key=lambda r: (keys[r["doc_id"]], r["doc_id"], r["size"]))
        budget, total = own[0]["target"] - own[0]["epochs"] * own[0]["source_size"], 0
        for r in own:
            after = total + r["size"]
            assert r["drawn"] == (after <= budget or (total < budget and after - budget <= budget - total))
            total = after


def test_very_long_texts_and_clashing_names(spark, docs_of):
    df = docs_of(["w " * 300_000, prose(1, 30), None], sources=["a", "a", None]).withColumnsRenamed({"key": "_k", "score": "target"})
    rows = {r["doc_id"]: r for r in m.mix(df, m.word_count(F.col("text")), F.lit(1.0), carry=("_k", "target", "lang")).collect()}
    assert rows[0]["size"] == 300_000 and rows[0]["_k"] == "k" and rows[0]["lang"] == "en" and rows[2]["taken"] == 0
    assert rows[0]["target"] == rows[1]["target"] != 0.5
