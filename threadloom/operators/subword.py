"""Word vectors from words and their hashed character n-grams: skip-grams with negative sampling.

A word's vector is the mean of its own row and those of its n-grams, so unknown words have one too. An epoch is one pass: the texts
are dealt to shards by hash, each shard learns from its texts starting from the current rows, and what the shards changed is averaged
by how often each row was used. Rows follow the vocabulary and buckets, whose sizes are parameters, not the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .embed import pool

SHARDS = 16


def pieces(word: str, buckets: int, shortest: int = 3, longest: int = 6) -> list[int]:
    """The buckets of the n-grams of a word between its borders, each once and in order."""
    w = f"<{word}>"
    found = (w[i : i + k] for k in range(shortest, longest + 1) for i in range(len(w) - k + 1) if k < len(w))
    return list(dict.fromkeys(zlib.crc32(g.encode()) % buckets for g in found))


def step(inner: np.ndarray, outer: np.ndarray, rows: np.ndarray, lengths: np.ndarray, targets: np.ndarray, rate: float) -> None:
    """One batch of pairs. rows: padded input rows of each centre (length of each in ``lengths``); targets: the true output row, then
    false ones. Both matrices change in place by the gradient of the log loss; a row used several times moves by the mean of its changes."""
    use = np.arange(rows.shape[1]) < lengths[:, None]
    h = (inner[rows] * use[..., None]).sum(1) / lengths[:, None]
    out = outer[targets]
    p = 1 / (1 + np.exp(-np.clip(np.einsum("bd,bkd->bk", h, out), -20, 20)))
    p[:, 0] -= 1
    for table, at, change in ((outer, targets.ravel(), (p[..., None] * h[:, None]).reshape(-1, h.shape[1])), (inner, rows[use], np.repeat(np.einsum("bk,bkd->bd", p, out) , lengths, axis=0))):
        order = np.argsort(at, kind="stable")
        uniq, first, n = np.unique(at[order], return_index=True, return_counts=True)
        table[uniq] -= (rate * np.add.reduceat(change[order], first) / np.sqrt(n)[:, None]).astype(table.dtype)


class SubwordVectors:
    """fit on an array-of-words column, then ``vector`` of any word, or ``transform``. Words of fewer than ``min_count`` occurrences, and those beyond
    the ``words`` most frequent, have their n-grams only. Documents without two known words teach nothing. Reproducible for the same rows."""

    def __init__(self, dim: int = 50, epochs: int = 10, min_count: int = 5, words: int = 100_000, buckets: int = 50_000, window: int = 5, negative: int = 5, rate: float = 0.05, shards: int = SHARDS, max_words: int = 150):
        self.dim, self.epochs, self.min_count, self.words, self.buckets = dim, epochs, min_count, words, buckets
        self.window, self.negative, self.rate, self.shards, self.max_words = window, negative, rate, shards, max_words
        self.known: dict[str, int] = {}

    def rows_of(self, word: str) -> list[int]:
        own = [self.known[word]] if word in self.known else []
        return own + [len(self.known) + b for b in pieces(word, self.buckets)]

    def vector(self, word: str) -> np.ndarray:
        rows = self.rows_of(word)
        return self.inner[rows].mean(axis=0) if rows else np.zeros(self.dim, np.float32)

    def fit(self, docs: DataFrame, words: Column) -> SubwordVectors:
        spark, dim, window, negative, shards = docs.sparkSession, self.dim, self.window, self.negative, self.shards
        texts = docs.select(words.alias("w"), F.xxhash64(*docs.columns).alias("h")).where(F.size("w") > 1)
        counts = texts.select(F.explode("w").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= self.min_count)
        # At most ``words`` rows.
        top = counts.orderBy(F.col("n").desc(), "token").limit(self.words).collect()
        self.known = {r["token"]: k for k, r in enumerate(top)}
        n = len(top) + self.buckets
        rng = np.random.default_rng(1)
        self.inner = ((rng.random((n, dim)) - 0.5) / dim).astype(np.float32)
        self.outer = np.zeros((len(top), dim), np.float32)
        if not top:
            return self
        draw = np.cumsum(np.array([r["n"] for r in top], float) ** 0.75)
        draw /= draw[-1]
        rows = [self.rows_of(r["token"]) for r in top]
        lengths = np.array([len(r) for r in rows])
        padded = np.zeros((len(rows), lengths.max()), np.int64)
        for k, r in enumerate(rows):
            padded[k, : len(r)] = r
        known = self.known
        dealt = texts.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
        for epoch in range(self.epochs):
            model = spark.sparkContext.broadcast((self.inner, self.outer, draw, padded, lengths, known))
            rate = self.rate * (1 - epoch / self.epochs)

            def learn(batches, model=model, rate=rate, epoch=epoch):
                state, held = None, []

                def flush(pairs, state):
                    inner, outer, rng, used = state
                    centre, context = np.array(pairs, np.int64).T
                    order = rng.permutation(len(centre))
                    for at in np.array_split(order, max(1, len(order) // 512)):
                        false = np.searchsorted(model.value[2], rng.random((len(at), negative)))
                        step(inner, outer, model.value[3][centre[at]], model.value[4][centre[at]], np.column_stack([context[at], np.minimum(false, len(outer) - 1)]), rate)
                    np.add.at(used, centre, 1)

                def out(shard, state):
                    inner, outer, _, _ = state
                    for kind, new, old in ((0, inner, model.value[0]), (1, outer, model.value[1])):
                        at = np.flatnonzero((new != old).any(axis=1))
                        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * new.shape[1]), pa.array((new[at] - old[at]).ravel()))
                        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(at), pa.int32()), pa.array(at), flat], ["kind", "at", "v"])

                shard = None
                for batch in batches:
                    for s, words in zip(batch.column("shard").to_pylist(), batch.column("w"), strict=True):
                        if s != shard:
                            if state is not None:
                                if held:
                                    flush(held, state)
                                yield from out(shard, state)
                            shard, held = s, []
                            state = (model.value[0].copy(), model.value[1].copy(), np.random.default_rng([epoch, s]), np.zeros(len(model.value[4])))
                        ids = [model.value[5][w] for w in words.as_py() if w in model.value[5]]
                        for k, c in enumerate(ids):
                            reach = 1 + int(state[2].integers(window))
                            held += [(c, ids[j]) for j in range(max(0, k - reach), min(len(ids), k + reach + 1)) if j != k]
                        if len(held) > 20_000:
                            flush(held, state)
                            held = []
                if state is not None:
                    if held:
                        flush(held, state)
                    yield from out(shard, state)

            # A shard is one task's; its texts come in the order of their hashes.
            changed = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "h", "w").mapInArrow(learn, "kind int, at long, v array<float>")
            # Summed in the order of the shards' sums only up to rounding: means of what the shards changed.
            mean = changed.select("kind", "at", F.posexplode("v").alias("i", "x")).groupBy("kind", "at", "i").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("x"))
            got = mean.groupBy("kind", "at").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("v")).toPandas()
            for kind, table in ((0, self.inner), (1, self.outer)):
                own = got[got["kind"] == kind]
                if len(own):
                    table[own["at"].to_numpy()] += np.stack(own["v"]).astype(np.float32)
            model.destroy()
        return self

    def transform(self, docs: DataFrame, words: Column) -> DataFrame:
        """Adds vector: the mean of the unit vectors of a document's first ``max_words`` words and one."""
        shared = docs.sparkSession.sparkContext.broadcast((self.inner, self.known))
        buckets, max_words, dim = self.buckets, self.max_words, self.dim

        @F.pandas_udf("array<float>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            inner, known = shared.value
            cache: dict[str, np.ndarray] = {}

            def lookup(w: str) -> np.ndarray:
                if w not in cache:
                    if len(cache) > 200_000:
                        cache.clear()
                    rows = ([known[w]] if w in known else []) + [len(known) + b for b in pieces(w, buckets)]
                    cache[w] = inner[rows].mean(axis=0) if w and rows else np.zeros(dim, np.float32)
                return cache[w]

            for rows in batches:
                yield rows.map(lambda t: pool(list(t) if t is not None else [], lookup, "avg", max_words))

        return docs.withColumn("vector", embed(words))
