import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import gated_lm as g


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) + ["\n"]


def brute(rows, train):
    c = Counter(w for t in train for w in words(t))
    n, v = sum(c.values()), len(c)
    z = math.log10(n + 0.1 * (v + 1))
    return [(i, len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(math.log10(c[w] + 0.1) - z for w in words(t)), 6)) for i, t in rows]


def flat(rows):
    return [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows]


@pytest.mark.parametrize("head", [0, 10, 10**6])
def test_base_scores_like_brute_force(spark, data, edge, head, monkeypatch):
    monkeypatch.setattr(g, "EPOCHS", 1)
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60).unionByName(edge.select("doc_id", "text", "lang", "source", "n_chars"))
    docs = docs.withColumn("text", F.concat("text", F.lit("\x1c Ümlaut É")))
    rows = docs.collect()
    train = docs.where("doc_id % 3 <> 0")
    got = g.score_texts(docs, train, head=head, sample_tokens=2000)
    assert sorted(map(repr, flat(got.collect()))) == sorted(map(repr, brute([(r["doc_id"], r["text"]) for r in rows], [r["text"] for r in rows if r["doc_id"] is not None and r["doc_id"] % 3])))


def test_query_folds_and_gain(spark, data):
    rows = g.query(spark, data).collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_outputs_are_a_distribution():
    net = g.GatedNet(hidden=8, classes=4, size=5)
    states = np.random.default_rng(0).standard_normal((3, 8)).astype(np.float32)
    total = sum(np.exp(net.log_p(states, np.full(3, k))) for k in range(20))
    assert total == pytest.approx(1, abs=1e-5)


def test_scores_carry_state_over_windows():
    net = g.GatedNet(hidden=8, classes=4, size=5)
    rng = np.random.default_rng(1)
    docs = [np.append(rng.integers(1, 20, n), 0) for n in (3000, 7, 1, 0, 450, 7)]

    def plain(ids):
        state, total = net.start(1), 0.0
        for k in ids:
            total += net.log_p(state, np.array([k]))[0]
            state = net.step(np.array([k]), state)
        return total / math.log(10)

    assert net.score(docs) == pytest.approx([plain(d) for d in docs], rel=1e-4)


def test_gradients():
    net = g.GatedNet(hidden=5, classes=3, size=4)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(2)
    x, y = (rng.integers(0, 12, (6, 3)) for _ in range(2))
    state = rng.standard_normal((3, 5))
    _, grad, _ = net.window(x, y, state)
    for name, at in (("u", (1, 3)), ("u", (2, 12)), ("x", (int(x[2, 1]), 7)), ("wc", (2, 1)), ("ww", (0, 1, 2)), ("bw", (1, 2)), ("bc", (0,))):
        loss = []
        for step in (1e-5, -1e-5):
            net.w[name][at] += step
            loss.append(net.window(x, y, state)[0])
            net.w[name][at] -= step
        assert (loss[0] - loss[1]) / 2e-5 == pytest.approx(grad[name][at], rel=1e-3, abs=1e-6)


def test_nothing_to_learn_from(spark, docs_of, nothing):
    rows = g.score_texts(docs_of(["a b", None]), nothing).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in rows)
    assert g.score_texts(nothing, nothing).count() == 0


def test_learns_from_all_training_documents(spark, docs_of, monkeypatch):
    """Also from those that the starting fit does not draw, and from copies, over several shards."""
    texts = ["a b c d " * 40, "e f g h " * 40]
    train, n = docs_of(texts * 300), 600 * 161
    monkeypatch.setattr(g, "SHARD", 20_000)
    monkeypatch.setattr(g, "SHARD_ROOT", 1)
    size = g.side(n)
    ids = g._ids([(w.encode(), 1) for w in "abcdefgh"], size**2)
    start = g.GatedNet(classes=size, size=size)
    weights, learned = g.learn_all(train, ids, start.w, n)
    assert learned == n
    docs = [np.array([ids[w] for w in t.encode().split()] + [0]) for t in texts]
    before, after = start.score(docs), g.GatedNet(classes=size, size=size, weights=weights).score(docs)
    assert (after > before + 10).all()


def test_output_words_grow_with_the_corpus():
    assert g.side(0) ** 2 >= 2304 and 2304 < g.side(10**8) ** 2 < g.side(10**10) ** 2


def test_start_is_bounded_and_never_untrained(docs_of):
    copies = docs_of(["a b c d e f g h i"] * 400)
    assert g._keyed(copies).select("h").distinct().count() == 400
    assert [len(d) for d in g._first(["a b c d e f g h i"] * 400, {}, 55)] == [9, 9, 9, 9, 9, 4]
    start = g.GatedNet().w
    assert not np.array_equal(g.fit_net(copies, {}, 0.0)["bc"], start["bc"])
    assert np.array_equal(g.fit_net(copies.limit(0), {}, 1.0)["bc"], start["bc"])


def ragged():
    return g.GatedNet(hidden=5, classes=4, size=4, edges=np.array([0, 1, 2, 5, 6, 16]))


def test_classes_by_counts_halve_the_terms():
    """Terms of both softmaxes for a token, by the words' shares, against classes of equal size."""
    outputs, n = 83**2, 10**6
    counts = {b"%d" % k: n // (12 * k) for k in range(1, outputs - 1)} | {g.END: n // 500}
    ids = g._ids(list(counts.items()), outputs)
    edges = g.class_edges(counts, ids, n, outputs)
    sizes = np.diff(edges)
    assert edges[0] == 0 and edges[-1] == outputs and (sizes > 0).all() and list(edges[:3]) == [0, 1, 2]
    p = np.zeros(outputs)
    for t, k in ids.items():
        p[k] = counts[t] / n
    p[1] = 1 - p.sum()
    own = sizes[np.repeat(np.arange(len(sizes)), sizes)]
    assert len(sizes) + (p * np.where(own > 1, own, 0)).sum() < 0.7 * 2 * 83
    for words in (0, 1, 3):
        few = {b"%d" % k: 5 for k in range(words)}
        assert g.class_edges(few, g._ids(list(few.items()), 2304), 5 * words, 2304)[-1] == 2304


def test_ragged_classes_are_a_distribution():
    states = np.random.default_rng(0).standard_normal((3, 5)).astype(np.float32)
    assert sum(np.exp(ragged().log_p(states, np.full(3, k))) for k in range(16)) == pytest.approx(1, abs=1e-5)


@pytest.mark.parametrize("scale", [1, 400])
def test_gradients_of_ragged_classes(scale):
    """Also with weights whose softmax needs its maximum."""
    net = ragged()
    net.w = {k: v.astype(np.float64) * (scale if k in ("wc", "ww") else 1) for k, v in net.w.items()}
    rng = np.random.default_rng(2)
    x, y = (rng.integers(0, 16, (6, 3)) for _ in range(2))
    state = rng.uniform(-1, 1, (3, 5))
    loss, grad, _ = net.window(x, y, state)
    before, states = state, []
    for t in range(6):
        before = net.step(x[t], before * (x[t] != 0)[:, None])
        states.append(before)
    assert loss == pytest.approx(-net.log_p(np.concatenate(states), y.ravel()).sum(), rel=1e-6)
    for name, at in (("u", (1, 3)), ("u", (2, 12)), ("x", (int(x[2, 1]), 7)), ("wc", (2, 1)), ("ww", (0, 2, 2)), ("ww", (2, 1, 3)), ("bw", (1, 3)), ("bc", (4,))):
        around = []
        for step in (1e-6, -1e-6):
            net.w[name][at] += step
            around.append(net.window(x, y, state)[0])
            net.w[name][at] -= step
        assert (around[0] - around[1]) / 2e-6 == pytest.approx(grad[name][at], rel=1e-3, abs=1e-5)


def test_sums_of_runs():
    rows = np.random.default_rng(4).standard_normal((400, 6)).astype(np.float32)
    first = np.array([0, 1, 2, 4, 12, 21, 300, 399])
    assert g._run_sums(rows, first) == pytest.approx(np.add.reduceat(rows, first, axis=0), abs=1e-4)
