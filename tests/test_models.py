"""Fitted models: languages by n-grams, truncated SVD, subword vectors."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import annotate, ngrams, svd
from threadloom.plans import registry
from threadloom.plans.views import table


def naive_grams(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    out = []
    for k in (1, 2, 3):
        for i in range(len(text) - k + 1):
            h = 0
            for c in text[i : i + k]:
                h = h * 1_114_112 + ord(c)
            out.append((h % 1_000_003 * 7919 + k) % (1 << 16))
    return out


@pytest.mark.parametrize("text", [None, "", "a", "Ab", "abc ÄÖ", "日本語 🙂 é", "x" * 500])
def test_grams(text):
    assert ngrams.grams(text).tolist() == naive_grams(text)


def test_model_rows_like_plain_python(spark):
    rows = [("en", "the cat and the dog"), ("en", "of the house"), ("de", "der Hund und die Katze"), ("de", None), (None, "la casa"), ("fr", "le chat et le chien")]
    df = spark.createDataFrame(rows, "label string, text string")
    model = ngrams.NgramModel().fit(df)
    sums = {label: Counter() for label in ("de", "en", "fr")}
    for label, text in rows:
        if label:
            sums[label].update(naive_grams(text))
    asked = ["the dog", "die Katze", "", None, "le chien", "zzz"]
    got = model.transform(spark.createDataFrame([(t,) for t in asked], "text string")).collect()
    for t, r in zip(asked, got, strict=True):
        score = {}
        for label, n in (("de", 2), ("en", 2), ("fr", 1)):
            total = sum(sums[label].values())
            score[label] = math.log(n / 5) + sum(math.log((sums[label][b] + 0.5) / (total + 0.5 * 65536)) for b in naive_grams(t))
        top = max(score.values())
        assert r["predicted"] == min(k for k, v in score.items() if v > top - 1e-9)
        assert r["probability"] == pytest.approx(1 / sum(math.exp(v - top) for v in score.values()))
    empty = ngrams.NgramModel().fit(df.limit(0))
    assert [tuple(r) for r in empty.transform(df.select("text").limit(1)).collect()] == [(rows[0][1], None, 0.0)]
    with pytest.raises(Exception, match="labels"):
        ngrams.NgramModel().fit(spark.range(80).select(F.col("id").cast("string").alias("label"), F.lit("x").alias("text")))


def test_held_out_accuracy(spark, data):
    rows = registry.QUERIES["language_model"](spark, data).join(table(spark, data, "documents").where("length(text) > 50"), "doc_id").where("held_out")
    n, right = rows.agg(F.count("*"), F.sum((F.col("predicted") == F.col("lang")).cast("int"))).first()
    assert n > 5 and right >= 0.95 * n


def test_model_as_a_language_step(spark, data):
    docs = table(spark, data, "documents").select(F.col("doc_id").cast("string").alias("file_name"), F.lit("https://a.org/x").alias("url"), F.substring_index("text", "\n", 1).alias("title"), F.lit("").alias("description"), "text", F.col("lang").alias("label"))
    step = ngrams.by_model(ngrams.NgramModel().fit(docs))
    out = annotate.annotate(docs, languages=("en", "de", "fr", "es"), mode="json", language=step)
    n, right = out.agg(F.count("*"), F.sum((F.col("lang") == F.col("label")).cast("int"))).first()
    assert n > 150 and right > 0.9 * n


@pytest.mark.parametrize("seed", [0, 1])
def test_svd_spans_numpys_subspace(spark, seed):
    rng = np.random.default_rng(seed)
    a = (rng.random((60, 25)) < 0.3) * rng.standard_normal((60, 25)) * np.linspace(3, 0.2, 25)
    if seed:
        a[:, 9:] = 0
    rows = [(int(i), f"t{j:02}", float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)]
    df = spark.createDataFrame([*rows, (None, "t00", 1.0), (1, None, 1.0), (2, "t01", None)], "row int, token string, x double")
    # By broadcast vectors, and by joins where they are too many numbers.
    model = svd.TruncatedSvd(6, rounds=6, most=svd.MOST if seed else 10).fit(df)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    assert model.values == pytest.approx(s[:6], rel=1e-4)
    v = np.zeros((25, 6))
    for r in model.vectors.collect():
        v[int(r["token"][1:])] = r["v"]
    assert v.T @ v == pytest.approx(np.eye(6), abs=1e-6)
    assert np.linalg.norm(vt[:6] @ v, 2) == pytest.approx(1, abs=1e-4) and np.linalg.svd(vt[:6] @ v)[1].min() > 0.999
    got = {r["row"]: r["vector"] for r in model.transform(df).collect() if r["row"] is not None}
    assert all(got[i] == pytest.approx((a[i] @ v).tolist(), abs=1e-6) for i in got)


def test_svd_of_little_or_nothing(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (2, "a", 4.0), (2, "b", 2.0)], "row int, token string, x double")
    model = svd.TruncatedSvd(5).fit(df)
    assert model.values == pytest.approx([5.0])
    assert len(svd.TruncatedSvd(5).fit(df.limit(0)).values) == 0


def test_svd_query_like_numpy(spark, data):
    from threadloom.functions import scalars as S
    from threadloom.operators import text

    docs, words = table(spark, data, "documents"), S.tokens(F.col("text"))
    rows = text.tfidf(docs, words, text.idf_table(docs, words, 100, 500)).collect()
    ids, tokens = sorted({r["doc_id"] for r in rows}), sorted({r["token"] for r in rows})
    a = np.zeros((len(ids), len(tokens)))
    for r in rows:
        a[ids.index(r["doc_id"]), tokens.index(r["token"])] += r["tfidf"]
    _, _, vt = np.linalg.svd(a, full_matrices=False)
    want = np.linalg.norm(a @ vt[:20].T, axis=1)
    got = {r["doc_id"]: r["length"] for r in registry.QUERIES["svd_documents"](spark, data).collect()}
    assert sorted(got) == ids
    assert np.abs(np.array([got[i] for i in ids]) - want).max() < 0.02 * want.max()
    assert sum(v * v for v in got.values()) == pytest.approx((want**2).sum(), rel=2e-3)


def test_subword_gradient_by_differences():
    from threadloom.operators import subword

    rng = np.random.default_rng(0)
    inner, outer = rng.standard_normal((6, 3)), rng.standard_normal((4, 3))
    rows, lengths, targets = np.array([[0, 1, 2]]), np.array([3]), np.array([[0, 1, 3]])

    def loss(a, b):
        s = b[targets[0]] @ a[rows[0]].mean(axis=0)
        return np.log1p(np.exp(-s[0])) + np.log1p(np.exp(s[1:])).sum()

    a, b = inner.copy(), outer.copy()
    subword.step(a, b, rows, lengths, targets, 1.0)
    e = 1e-6
    for i, j in ((0, 0), (2, 2)):
        d = np.zeros_like(outer)
        d[targets[0][i % 3], j] = e
        assert (loss(inner, outer + d) - loss(inner, outer - d)) / (2 * e) == pytest.approx((outer - b)[targets[0][i % 3], j], abs=1e-5)
        d = np.zeros_like(inner)
        d[i, j] = e
        # Each row of a centre moves by the whole gradient of the mean.
        assert 3 * (loss(inner + d, outer) - loss(inner - d, outer)) / (2 * e) == pytest.approx((inner - a)[i, j], abs=1e-5)


def test_subword_vectors_know_what_stands_together(spark):
    from threadloom.operators import subword

    rng = np.random.default_rng(3)
    topics = [[f"{stem}{end}" for stem in stems for end in ("er", "ing", "s")] for stems in (("lamp", "glow", "wick"), ("boat", "sail", "mast"))]
    docs = spark.createDataFrame([(rng.choice(topics[k % 2], 30).tolist(),) for k in range(240)] + [([],), (None,), (["lamper"],)], "w array<string>")
    fit = lambda: subword.SubwordVectors(dim=16, epochs=8, buckets=500, shards=3, rate=0.1).fit(docs, F.col("w"))
    model = fit()
    cos = lambda a, b: float(model.vector(a) @ model.vector(b) / np.linalg.norm(model.vector(a)) / np.linalg.norm(model.vector(b)))
    near = np.mean([cos(a, b) for t in topics for a in t for b in t if a[:4] != b[:4]])
    far = np.mean([cos(a, b) for a in topics[0] for b in topics[1]])
    assert near > far + 0.3
    # An unknown word is placed by its n-grams.
    assert cos("lampish", "glower") > cos("lampish", "sailer")
    assert np.abs(fit().inner - model.inner).max() < 1e-5
    out = model.transform(docs.where("size(w) > 20").limit(2).unionByName(docs.where("w is null")), F.col("w")).collect()
    assert [len(r["vector"]) for r in out] == [16] * 3 and not any(out[2]["vector"])
    assert subword.SubwordVectors(dim=4, buckets=10).fit(docs.limit(0), F.col("w")).vector("x").shape == (4,)
