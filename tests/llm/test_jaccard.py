import random

import numpy as np
import pytest

from threadloom.llm import jaccard as j

from .conftest import prose


def brute(texts, ids):
    """Class and links of every row, all pairs compared."""
    sets = []
    for t in texts:
        w = j._WORD.findall((t or "").lower())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links, top = [0] * len(sets), list(range(len(sets)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    classes = {}
    for k in range(len(sets)):
        classes.setdefault(root(k), []).append(k)
    least = {k: min((ids[x] for x in own if ids[x] is not None), default=None) for k, own in classes.items()}
    return sorted(repr((ids[k], least[root(k)], links[k])) for k in range(len(sets)))


def family(seed, n, words=120, edits=4):
    rng = random.Random(seed)
    base = prose(seed, words).split()
    out = [" ".join(base)]
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = f"edit{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block", [512, 7])
def test_like_all_pairs(spark, docs_of, edge_texts, block):
    texts = [t for t in edge_texts if t is None or len(t) < 40000] + family(1, 25) + family(2, 10, 60, 2) + [prose(k, 80) for k in range(50, 80)]
    random.Random(4).shuffle(texts)
    ids = [None if k % 17 == 0 else k for k in range(len(texts))]
    members, classes = j.join(docs_of(texts, ids), block=block)
    rows = members.join(classes.select("comp", "class_id"), "comp", "left").collect()
    got = sorted(repr((r["doc_id"], r["class_id"] if r["comp"] is not None else r["doc_id"], r["n_links"] or 0)) for r in rows)
    assert got == brute(texts, ids)


def test_query_like_all_pairs(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    rows = j.query(spark, data).collect()
    assert sorted(repr((r["doc_id"], r["class_id"], r["n_links"])) for r in rows) == brute([d["text"] for d in docs], [d["doc_id"] for d in docs])


def test_one_of_each_class_stays(spark, docs_of, edge, nothing):
    texts = family(7, 6, edits=1) + [None, "", "   ", prose(9, 40), prose(9, 40)]
    df = docs_of(texts)
    kept = j.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 7, 8, 9, 10]
    twice = docs_of([prose(3, 50)] * 4, [5, 5, None, 5])
    assert [r["doc_id"] for r in j.keep_one(twice).collect()] == [5]
    assert j.keep_one(nothing).count() == 0 and j.near_classes(nothing).count() == 0
    assert j.near_classes(edge).count() == edge.count()


def test_pruning_bounds():
    least = j.least_matches(96, 16, 0.8, 1e-6)
    assert list(least) == sorted(least) and 0 < least[0] < 16 and 40 < least[-1] < 70
    rng = np.random.default_rng(1)
    for similarity in (0.8, 0.9):
        assert (rng.binomial(16, similarity, 20000) >= least[0]).mean() > 0.999


def test_intersections_both_ways():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, 80).astype(np.uint64)) for _ in range(12)]
    a, b = np.triu_indices(12, 1)
    want = [len(set(sets[i].tolist()) & set(sets[k].tolist())) for i, k in zip(a, b, strict=True)]
    assert j._common(sets, a, b).tolist() == want
    assert j._common(sets, a[:5], b[:5]).tolist() == want[:5]
