"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its lower-cased words, adjacent pairs, and pairs one and two words apart, each present or not, in
``1 << bits`` hash buckets. Training visits labelled rows in a fixed order; every coordinate has its own learning rate,
and the L1 term leaves only weights that several rows have earned. Those alone travel to the scoring tasks.

Scale: the fit reads about ``max_rows`` labelled rows at most (a documented bound, taken by hash of the id), joined to
their texts by broadcasting that bounded set of labels, and runs in one executor task that can be run again. Scoring is
one pass without a shuffle; a task holds the weight table and one batch.

Defined cases: null or empty texts have no features and score by the intercept alone. Unlabelled rows and null labels do
not train; where a document has several labels, toxic wins. No labels, or labels of one kind only: scores near that
kind's rate (0.5 without any). Texts are read whole. Repeated rows are scored each. Empty table: no rows. Other columns
pass through ``keep_clean``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, cut, table

BITS = 22
MAX_ROWS = 12_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 0.1
THRESHOLD = 0.7
HELD_OUT_MOD, HELD_OUT_REST = 3, 1

_WORD = re.compile(r"\w+")
_CACHE_WORDS = 400_000


class Features:
    """Hash buckets of a text. Words are hashed once while the cache lasts; it is emptied when full."""

    def __init__(self, bits: int):
        self.shift, self.cache = np.uint64(64 - bits), {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Buckets of all features, repeats included."""
        if not text:
            return np.zeros(0, np.int64)
        words, cache = _WORD.findall(text.lower()), self.cache
        if len(cache) > _CACHE_WORDS:
            cache.clear()
        ids = []
        for w in words:
            h = cache.get(w)
            if h is None:
                h = cache[w] = xxhash.xxh3_64_intdigest(w)
            ids.append(h)
        x = np.array(ids, np.uint64)
        parts = [x * np.uint64(0x9E3779B97F4A7C15)]
        for gap, salt in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9), (3, 0x27D4EB2F165667C5)):
            if len(x) > gap:
                parts.append((x[:-gap] * np.uint64(salt) + x[gap:]) * np.uint64(0x9E3779B97F4A7C15))
        return (np.concatenate(parts) >> self.shift).astype(np.int64)


def ftrl(rows: list[tuple[np.ndarray, int]], bits: int, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
    """rows: (distinct buckets, label). Returns the buckets with a weight, their weights, and the intercept."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias_z, bias_n = 0.0, 0.0
    for _ in range(epochs):
        for at, y in rows:
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + root) / alpha + l2))
            b = -bias_z / ((beta + bias_n**0.5) / alpha + 1e-3)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
            g = p - y
            sigma = (np.sqrt(ni + g * g) - root) / alpha
            z[at] = zi + g - sigma * w
            n[at] = ni + g * g
            s = ((bias_n + g * g) ** 0.5 - bias_n**0.5) / alpha
            bias_z, bias_n = bias_z + g - s * b, bias_n + g * g
    at = np.flatnonzero(np.abs(z) > l1)
    w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
    return at, w, -bias_z / ((beta + bias_n**0.5) / alpha + 1e-3)


def train(docs: DataFrame, labels: DataFrame, bits: int = BITS, max_rows: int = MAX_ROWS, epochs: int = EPOCHS, l1: float = L1):
    """docs: doc_id, text. labels: doc_id, toxic. Returns (buckets, weights, intercept) as numpy arrays and a float."""
    marks = cut(labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("_y")).withColumn("_h", F.xxhash64("doc_id", F.lit(5))))
    n = marks.count()
    if n > max_rows:
        marks = marks.where(F.pmod("_h", F.lit(1 << 30)) < int((1 << 30) * max_rows / n))
    sample = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").select("_h", "_y", "text")

    def fit(batches):
        features, rows = Features(bits), []
        for batch in batches:
            for h, y, text in zip(*(batch.column(c) for c in ("_h", "_y", "text")), strict=True):
                at = np.unique(features(text.as_py())).astype(np.int32)
                rows.append((h.as_py(), at.tobytes(), at, int(y.as_py() > 0)))
        rows.sort(key=lambda r: r[:2] if len(r[1]) < 64 else (r[0], r[1][:64]))
        at, w, b = ftrl([r[2:] for r in rows], bits, epochs, l1=l1) if rows else (np.zeros(0, np.int64), np.zeros(0), 0.0)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(w, b), pa.float64())], ["bucket", "weight"])

    # The weights are sparse by the L1 term: at most one for every few features that the bounded sample repeats.
    got = sample.repartition(1).mapInArrow(fit, "bucket long, weight double").toPandas().groupby("bucket")["weight"].sum()
    intercept = float(got.get(-1, 0.0))
    got = got[got.index >= 0]
    return got.index.to_numpy(np.int64), got.to_numpy(np.float64), intercept


def _scorer(model, bits: int):
    at, w, intercept = model
    features, dense = Features(bits), np.zeros(1 << bits, np.float32)
    dense[at] = w

    def score(text: str | None) -> float:
        x = features(text)
        x = np.unique(x[dense[x] != 0])
        return float(1 / (1 + np.exp(-np.clip(dense[x].astype(np.float64).sum() + intercept, -35, 35))))

    return score


def score(docs: DataFrame, model, bits: int = BITS) -> DataFrame:
    """docs: any columns and text. Adds score; replaces a column of that name."""
    docs = docs.drop("score")

    def run(batches):
        of = _scorer(model, bits)
        for batch in batches:
            yield batch.append_column("score", pa.array([of(t.as_py()) for t in batch.column("text")], pa.float64()))

    from pyspark.sql.types import DoubleType, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("score", DoubleType()))


def keep_clean(docs: DataFrame, model, threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """docs whose score is under the threshold, all columns as they were."""

    def run(batches):
        of = _scorer(model, bits)
        for batch in batches:
            yield batch.filter(pa.array([of(t.as_py()) < threshold for t in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(crc_mod(F.col("doc_id"), HELD_OUT_MOD) != HELD_OUT_REST)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, training_labels(table(spark, sf_dir, "labels")))
    # Only what the score needs goes through Python, and the text comes out again by no column.
    scored = score(docs, model).select("doc_id", "score")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), HELD_OUT_MOD) == HELD_OUT_REST).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
