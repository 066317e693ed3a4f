"""A multinomial model over hashed character n-grams: what decides on languages and, for each language, on categories.

Fitting is one pass: each task counts the n-grams of its rows by label, and the counts are summed. What the driver holds is a
number for each label and bucket, a size that does not follow the data. Scoring is a pass without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import language_decision, unknown_symbols

SIZES, BUCKETS, SMOOTH = (1, 2, 3), 1 << 16, 0.5
#: Labels at most: with all buckets, two million numbers.
MOST_LABELS = 32
#: Above all code points, so that up to three make a number of their own.
_BASE, _MOD, _MIX = 1_114_112, 1_000_003, 7919


def grams(text: str | None, sizes: tuple = SIZES, buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of a text's n-grams (up to three code points, A-Z lower-cased), repeats included."""
    a = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    a = a + 32 * ((a >= 65) & (a <= 90))
    out = []
    for k in sizes:
        if len(a) >= k:
            h = a[: len(a) - k + 1]
            for t in range(1, k):
                h = h * _BASE + a[t : len(a) - k + 1 + t]
            out.append((h % _MOD * _MIX + k) % buckets)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class NgramModel:
    """fit on (label, text), then transform adds predicted and probability. Rows without a label do not train; null and empty
    texts have no n-grams and get the most frequent label. Ties: the first label by name."""

    def __init__(self, sizes: tuple = SIZES, buckets: int = BUCKETS, smooth: float = SMOOTH):
        if max(sizes) > 3:
            raise ValueError("n-grams of up to three characters")
        self.sizes, self.buckets, self.smooth = sizes, buckets, smooth
        self.labels, self.prior, self.weights = [], np.zeros(0), np.zeros((0, buckets))

    def counts(self, rows: DataFrame) -> DataFrame:
        """label, bucket, n; bucket -1 counts the rows."""
        sizes, buckets = self.sizes, self.buckets

        def count(batches):
            sums: dict[str, np.ndarray] = {}
            for batch in batches:
                for label, text in zip(batch.column("label").to_pylist(), batch.column("text"), strict=True):
                    if label not in sums:
                        if len(sums) >= MOST_LABELS:
                            raise ValueError(f"more than {MOST_LABELS} labels")
                        sums[label] = np.zeros(buckets + 1, np.int64)
                    own = sums[label]
                    own[:buckets] += np.bincount(grams(text.as_py(), sizes, buckets), minlength=buckets)
                    own[buckets] += 1
            for label, own in sums.items():
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(np.where(at == buckets, -1, at)), pa.array(own[at])], ["label", "bucket", "n"])

        known = rows.where("label is not null").select(F.col("label").cast("string").alias("label"), "text")
        return known.mapInArrow(count, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))

    def fit(self, rows: DataFrame) -> NgramModel:
        found = self.counts(rows).toPandas()
        self.labels = sorted(found["label"].unique())
        if len(self.labels) > MOST_LABELS:
            raise ValueError(f"more than {MOST_LABELS} labels")
        table = np.zeros((len(self.labels), self.buckets))
        docs = np.zeros(len(self.labels))
        for k, label in enumerate(self.labels):
            own = found[found["label"] == label]
            docs[k] = own.loc[own["bucket"] < 0, "n"].sum()
            own = own[own["bucket"] >= 0]
            table[k, own["bucket"]] = own["n"]
        self.prior = np.log(docs / docs.sum()) if len(docs) else docs
        self.weights = np.log((table + self.smooth) / (table.sum(axis=1, keepdims=True) + self.smooth * self.buckets))
        return self

    def transform(self, rows: DataFrame, text: str = "text") -> DataFrame:
        sizes, buckets, labels, prior = self.sizes, self.buckets, self.labels, self.prior
        weights = rows.sparkSession.sparkContext.broadcast(self.weights)  # MOST_LABELS times buckets numbers at most
        rows = rows.drop("predicted", "probability")

        def score(batches):
            for batch in batches:
                names, shares = [], []
                for t in batch.column(text):
                    if not labels:
                        names.append(None)
                        shares.append(0.0)
                        continue
                    s = prior + weights.value[:, grams(t.as_py(), sizes, buckets)].sum(axis=1)
                    k = int(s.argmax())
                    names.append(labels[k])
                    shares.append(float(1 / np.exp(s - s[k]).sum()))
                yield batch.append_column("predicted", pa.array(names, pa.string())).append_column("probability", pa.array(shares, pa.float64()))

        added = StructType.fromDDL("predicted string, probability double")
        return rows.mapInArrow(score, StructType([*rows.schema.fields, *added.fields]))


def by_model(model: NgramModel):
    """A language step: the model reads title, description and the text's first 100 characters, and the usual borders decide."""

    def step(docs: DataFrame) -> DataFrame:
        sample = F.concat_ws(" ", "title", "description", F.substring("text", 1, 100))
        scored = model.transform(docs.withColumn("__sample", F.translate(sample, "\n", " ")), "__sample")
        decided = language_decision(F.col("predicted"), F.col("probability"), unknown_symbols(F.col("title")))
        return scored.withColumn("lang", decided).drop("__sample", "predicted", "probability")

    return step
