import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import toxicity as t

from .conftest import prose

BAD = ["vilefool", "grotesque", "scumbag"]


def corpus(n=600):
    rng = random.Random(1)
    texts, marks = [], []
    for k in range(n):
        words = prose(k, 60).split()
        bad = k % 5 == 0
        for _ in range(3 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        texts.append(" ".join(words))
        marks.append(int(bad))
    return texts, marks


def test_held_out_accuracy_and_filter(spark, docs_of):
    texts, marks = corpus()
    df = docs_of(texts)
    labels = spark.createDataFrame([(k, m) for k, m in enumerate(marks)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = t.train(df, t.training_labels(labels))
    rows = t.score(df, model).collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(held) > 150 and all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([(r["score"] >= 0.7) == bool(marks[r["doc_id"]]) for r in held]) > 0.95
    kept = t.keep_clean(df, model)
    assert kept.columns == df.columns and all(marks[r["doc_id"]] == 0 or r["doc_id"] for r in kept.collect())
    assert len(model[0]) < 3000


def test_query_columns(spark, data):
    rows = t.query(spark, data).collect()
    assert len(rows) == 200
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7)


def test_ftrl_by_hand():
    """One row, one feature: the update rule written out."""
    at, w, b = t.ftrl([(np.array([5]), 1)], 4, epochs=1, alpha=1.0, beta=1.0, l1=0.1, l2=0.0)
    assert at.tolist() == [5]
    assert abs(w[0] - (0.5 - 0.1) / (1 + 0.5)) < 1e-9 and abs(b - 0.5 / (1.5 + 1e-3)) < 1e-9
    assert len(t.ftrl([(np.array([5]), 1)], 4, epochs=1, l1=1.0)[0]) == 0


def plain_ftrl(rows, epochs, alpha, beta, l1, l2):
    """The update one coordinate at a time, in dictionaries."""
    z, n, bz, bn = {}, {}, 0.0, 0.0

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(epochs):
        for features, y in rows:
            w = {i: weight(i) for i in features}
            b = -bz / ((beta + bn**0.5) / alpha + 1e-3)
            p = 1 / (1 + np.exp(-min(max(sum(w.values()) + b, -35), 35)))
            g = p - y
            for i in features:
                old = n.get(i, 0.0)
                s = ((old + g * g) ** 0.5 - old**0.5) / alpha
                z[i], n[i] = z.get(i, 0.0) + g - s * w[i], old + g * g
            s = ((bn + g * g) ** 0.5 - bn**0.5) / alpha
            bz, bn = bz + g - s * b, bn + g * g
    return {i: weight(i) for i in z if weight(i)}, -bz / ((beta + bn**0.5) / alpha + 1e-3)


def test_model_and_scores_like_a_plain_loop(spark, docs_of):
    """Words, neighbours and skip-grams by name, the update by coordinate, scores by summing."""
    texts, marks = corpus(120)
    df = docs_of(texts)
    labels = spark.createDataFrame([(k, m) for k, m in enumerate(marks)], "doc_id long, toxic int")
    order = [r["doc_id"] for r in labels.select("doc_id", F.xxhash64("doc_id", F.lit(5)).alias("h")).orderBy("h").collect()]
    features = t.Features(t.BITS)
    of = lambda text: sorted(set(features(text).tolist()))
    words = texts[0].split()
    assert len(features(texts[0])) == sum(len(re.findall(r"\w+", texts[0])) - gap for gap in range(4)) and words
    want, b = plain_ftrl([(of(texts[k]), marks[k]) for k in order], t.EPOCHS, t.ALPHA, t.BETA, 2.0, t.L2)
    model = t.train(df, labels, l1=2.0)
    assert dict(zip(model[0].tolist(), model[1].tolist(), strict=True)) == pytest.approx(want) and model[2] == pytest.approx(b) and want
    for r in t.score(df, model).collect():
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-(sum(want.get(i, 0.0) for i in of(texts[r["doc_id"]])) + b))), abs=1e-5)


def test_edges(spark, edge, nothing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = t.train(edge, none)
    assert {r["score"] for r in t.score(edge, model).collect()} == {0.5}
    one = t.train(edge, spark.createDataFrame([(5, 1), (5, 0)], "doc_id long, toxic int"))
    assert t.score(edge, one).count() == edge.count() and "key" in t.score(edge, one).columns
    assert t.score(nothing, model).count() == 0 and t.keep_clean(nothing, model).count() == 0
