import random

import numpy as np
import pytest

from threadloom.llm import decontaminate as d

from .conftest import prose


def naive_tiles(a, b, least):
    ma, mb, out = [False] * len(a), [False] * len(b), []
    while True:
        best, found = least, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ma[i + k] and not mb[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best and k >= least:
                    found.append((i, j))
        if not found:
            return out
        for i, j in found:
            if not any(ma[i : i + best]) and not any(mb[j : j + best]):
                out.append((i, j, best))
                ma[i : i + best] = [True] * best
                mb[j : j + best] = [True] * best


@pytest.mark.parametrize("seed", range(15))
def test_tiles_like_the_naive_form(seed):
    rng = random.Random(seed)
    a, b = ([rng.randrange(3) for _ in range(rng.randint(5, 40))] for _ in range(2))
    assert d.tile(np.array(a), np.array(b), 3) == naive_tiles(a, b, 3)


def test_reordered_passages_and_partial_ones(spark, docs_of):
    words = prose(3, 40).split()
    item = " ".join(words)
    texts = [prose(8, 30) + " " + item + " " + prose(9, 30), " ".join(words[20:]) + " zz " + " ".join(words[:20]), " ".join(words[:25]), item.upper(), prose(7, 300), None, ""]
    items = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (1, item)], "item_id long, text string")
    found = d.find_leaks(docs_of(texts), items)
    assert sorted({r["doc_id"] for r in found.collect()}) == [0, 1, 3]
    assert [r["n_tiles"] for r in found.collect() if r["doc_id"] == 1] == [2, 2]
    kept = d.drop_contaminated(docs_of(texts), items)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 5, 6] and kept.columns == docs_of(texts).columns


def test_blocks_change_nothing(spark, data):
    docs, items = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(map(tuple, d.find_leaks(docs, items).collect()))
    assert one == sorted(map(tuple, d.find_leaks(docs, items, block_bytes=900).collect())) and one
    kept = {r["doc_id"] for r in d.drop_contaminated(docs, items).collect()}
    assert kept == {r["doc_id"] for r in d.drop_contaminated(docs, items, block_bytes=900).collect()} == {r["doc_id"] for r in docs.collect()} - {r[0] for r in one}
    # Brute force: every document against every item.
    want = set()
    rows = [(r["item_id"], d.tokens_of(r["text"])) for r in items.collect()]
    for doc in docs.collect():
        own = d.tokens_of(doc["text"])
        grams = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
        for key, item in rows:
            if any(tuple(item[i : i + 5]) in grams for i in range(len(item) - 4)):
                ids = {t: i for i, t in enumerate(set(own) | set(item))}
                tiles = d.tile(np.array([ids[t] for t in item]), np.array([ids[t] for t in own]))
                if sum(t[2] for t in tiles) >= 0.8 * len(item):
                    want.add((doc["doc_id"], key))
    assert {r[:2] for r in one} == want


def test_edges(spark, edge, nothing):
    items = spark.createDataFrame([(1, "a " * 40), (2, prose(1, 60))], "item_id long, text string")
    # The long texts begin with the words of the short one.
    assert {r["doc_id"] for r in d.find_leaks(edge, items).collect()} == {5, 8, 9, 10}
    none = items.limit(0)
    assert d.find_leaks(edge, none).count() == 0 and d.drop_contaminated(edge, none).count() == edge.count()
    assert d.find_leaks(nothing, items).count() == 0 and d.drop_contaminated(nothing, items).count() == 0


def test_very_long_texts(spark, docs_of):
    """A text of equal words and one of 150,000 words that hides an item in two parts."""
    words = prose(3, 60).split()
    texts = ["a " * 200_000, " ".join([prose(8, 70_000), *words[30:], prose(9, 70_000), *words[:30]])]
    items = spark.createDataFrame([(1, " ".join(words)), (2, "a " * 500)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in d.find_leaks(docs_of(texts), items).collect()}
    assert set(found) == {(0, 2), (1, 1)} and found[1, 1]["n_tiles"] == 2 and found[1, 1]["matched"] == found[1, 1]["item_tokens"]
