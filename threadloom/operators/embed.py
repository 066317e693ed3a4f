"""Embedders, by name: a registry of plug-ins with one method, ``transform(df) -> df`` with a vector column."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml.feature import Word2Vec
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import plain_tokens, preprocess
from .filters import embedding_field
from .text import exploded


class Embedder(Protocol):
    def transform(self, docs: DataFrame) -> DataFrame: ...


def word_vector(word: str, dim: int, salt: int = 0) -> np.ndarray:
    """A fixed pseudo-random vector for a word: an embedding without a model file."""
    import hashlib

    seed = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8, salt=salt.to_bytes(8, "little")).digest(), "little")
    return np.random.Generator(np.random.PCG64(seed)).standard_normal(dim).astype(np.float32)


def pool(words: list[str], lookup: Callable[[str], np.ndarray], mode: str, max_words: int, matrix: tuple | None = None) -> np.ndarray:
    """Pooled unit vectors. Words without length do not count; one more than ``max_words`` counted words are read."""
    rows = []
    for w in words:
        v = lookup(w)
        norm = float(np.linalg.norm(v))
        if norm > 0:
            rows.append(v / norm)
            if len(rows) > max_words:
                break
    if not rows:
        dim = len(lookup(""))
        return np.zeros(dim if matrix is None and mode != "matrix" else (matrix[0].shape[1] if matrix else 3 * dim), np.float32)
    x = np.array(rows)
    parts = {"avg": x.mean(axis=0), "max": x.max(axis=0), "min": x.min(axis=0)}
    if mode != "matrix":
        return parts[mode].astype(np.float32)
    flat = np.concatenate([parts["avg"], parts["max"], parts["min"]])
    return (flat @ matrix[0] + matrix[1] if matrix else flat).astype(np.float32)


class HashedEmbedder:
    """Hashed word vectors, pooled by avg, max, min or all three (matrix, with optional weights and bias)."""

    def __init__(self, field: str = "all", mode: str = "avg", dim: int = 50, max_words: int = 150, matrix: tuple | None = None):
        self.field, self.mode, self.dim, self.max_words, self.matrix = field, mode, dim, max_words, matrix

    def transform(self, docs: DataFrame) -> DataFrame:
        dim, mode, max_words, matrix = self.dim, self.mode, self.max_words, self.matrix

        @F.pandas_udf("array<float>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            cache: dict[str, np.ndarray] = {}

            def lookup(w: str) -> np.ndarray:
                if len(cache) > 200_000:
                    cache.clear()
                if w not in cache:
                    cache[w] = word_vector(w, dim)
                return cache[w]

            for texts in batches:
                yield texts.fillna("").map(lambda t: pool(t.split(), lookup, mode, max_words, matrix))

        return docs.withColumn("vector", embed(preprocess(embedding_field(self.field))))


class TfIdfEmbedder:
    """Tf-idf over a vocabulary of (token, idx, idf): dense, or times a matrix of components (vocabulary by dimensions, such
    as that of an exported model; see ``sources.readers.read_matrix``). The matrix is broadcast, so it may have ``most`` numbers;
    ``svd.TruncatedSvd`` fits and applies components that stay a table."""

    def __init__(self, vocabulary: DataFrame, field: str = "all", max_words: int = 10**6, matrix: np.ndarray | None = None, most: int = 50_000_000):
        self.vocabulary, self.field, self.max_words, self.matrix = vocabulary, field, max_words, matrix
        if matrix is not None and np.size(matrix) > most:
            raise ValueError(f"more than {most} numbers")

    def weights(self, docs: DataFrame, key: str = "file_name") -> DataFrame:
        """key, entries: array of (idx, x) in order of idx; documents without known tokens are missing."""
        words = plain_tokens(preprocess(embedding_field(self.field)), self.max_words)
        rows = exploded(docs, words, key).groupBy(key, "_n", "token").agg(F.count("*").alias("_c")).join(self.vocabulary, "token")
        parts = rows.groupBy(key, "idx").agg(F.sum(F.col("_c") / F.col("_n") * F.col("idf")).alias("x"))
        return parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "x"))).alias("entries"))

    def transform(self, docs: DataFrame, key: str = "file_name") -> DataFrame:
        joined = docs.join(self.weights(docs, key), key, "left")
        if self.matrix is not None:
            shared = docs.sparkSession.sparkContext.broadcast(np.asarray(self.matrix, np.float32))

            @F.pandas_udf("array<float>")
            def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
                matrix = shared.value
                one = lambda e: np.array([x["x"] for x in e], np.float32) @ matrix[[x["idx"] for x in e]] if e is not None and len(e) else np.zeros(matrix.shape[1], np.float32)
                for entries in batches:
                    yield entries.map(one, na_action=None)

            return joined.withColumn("vector", project("entries")).drop("entries")
        size = self.vocabulary.agg(F.max("idx")).first()[0] or 0
        found = F.map_from_entries("entries")
        dense = F.transform(F.sequence(F.lit(0), F.lit(size)), lambda i: F.coalesce(F.col("_m")[i], F.lit(0.0)).cast("float"))
        return joined.withColumn("_m", found).withColumn("vector", dense).drop("_m", "entries")


class Word2VecEmbedder:
    """Skip-gram vectors fitted by Spark ML, averaged."""

    def __init__(self, dim: int = 50, epochs: int = 10, min_count: int = 50, field: str = "all", seed: int = 1):
        self.dim, self.epochs, self.min_count, self.field, self.seed, self.model = dim, epochs, min_count, field, seed, None

    def _words(self, docs: DataFrame) -> DataFrame:
        return docs.withColumn("_words", plain_tokens(preprocess(embedding_field(self.field))))

    def fit(self, docs: DataFrame) -> Word2VecEmbedder:
        self.model = Word2Vec(vectorSize=self.dim, maxIter=self.epochs, minCount=self.min_count, inputCol="_words", outputCol="_v", seed=self.seed).fit(self._words(docs))
        return self

    def transform(self, docs: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        return self.model.transform(self._words(docs)).withColumn("vector", vector_to_array("_v", "float32")).drop("_words", "_v")


class TokenIdEmbedder:
    """Vectors from any function of token ids: ``model`` maps an int64 matrix (rows padded with 0) to a float matrix. It is
    loaded in each task by ``load``; see ``onnx_model`` for exported networks. The vocabulary travels to the tasks: up to
    ``most`` tokens of it, more are refused."""

    def __init__(self, vocabulary: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], field: str = "all", max_words: int = 150, most: int = 2_000_000):
        self.vocabulary, self.load, self.field, self.max_words, self.most = vocabulary, load, field, max_words, most

    def transform(self, docs: DataFrame) -> DataFrame:
        rows = self.vocabulary.select("token", "idx").limit(self.most + 1).collect()
        if len(rows) > self.most:
            raise ValueError(f"more than {self.most} tokens")
        shared, load, width = docs.sparkSession.sparkContext.broadcast({r["token"]: r["idx"] for r in rows}), self.load, self.max_words

        @F.pandas_udf("array<float>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model, known = load(), shared.value
            for texts in batches:
                found = [[known.get(w, 0) for w in t.split()[:width]] for t in texts.fillna("")]
                ids = np.zeros((len(found), max([1, *map(len, found)])), np.int64)
                for k, x in enumerate(found):
                    ids[k, : len(x)] = x
                yield pd.Series(list(np.asarray(model(ids), np.float32)))

        return docs.withColumn("vector", embed(preprocess(embedding_field(self.field))))


def onnx_model(path: str) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A loader of an exported network with one input of token ids; needs onnxruntime in the tasks."""

    def load():
        import onnxruntime

        session = onnxruntime.InferenceSession(path)
        name = session.get_inputs()[0].name
        return lambda ids: session.run(None, {name: ids})[0]

    return load


class SiameseTrainer:
    """A linear map under which cosines of pairs tell whether they belong together.

    p = sigmoid(a * cos(x W + b, y W + b) + c), fitted by Adam on the summed log loss, ended early on validation rows. Every
    step is a pass over all pairs in which partitions sum the gradient (a few thousand numbers); the driver holds those sums.
    """

    def __init__(self, dim: int = 50, epochs: int = 100, rate: float = 0.05, patience: int = 10, seed: int = 1):
        self.dim, self.epochs, self.rate, self.patience, self.seed = dim, epochs, rate, patience, seed
        self.matrix = self.bias = None
        self.scale, self.shift = 1.0, 0.0

    @staticmethod
    def gradient(x: np.ndarray, y: np.ndarray, label: np.ndarray, w: np.ndarray, b: np.ndarray, scale: float, shift: float):
        """Summed loss and gradients by matrix, bias, scale and shift."""
        u, v = x @ w + b, y @ w + b
        nu, nv = (np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-9) for t in (u, v))
        hu, hv = u / nu, v / nv
        cos = (hu * hv).sum(axis=1)
        z = scale * cos + shift
        p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        loss = -(label * np.log(p + 1e-12) + (1 - label) * np.log(1 - p + 1e-12)).sum()
        d = p - label
        g = (d * scale)[:, None]
        du, dv = g * (hv - cos[:, None] * hu) / nu, g * (hu - cos[:, None] * hv) / nv
        return loss, x.T @ du + y.T @ dv, (du + dv).sum(axis=0), float((d * cos).sum()), float(d.sum())

    def _sums(self, pairs: DataFrame):
        w, b, scale, shift, gradient = self.matrix, self.bias, self.scale, self.shift, self.gradient

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, n = 0.0, 0
            for pdf in batches:
                if len(pdf):
                    loss, *g = gradient(np.stack(pdf["left"]).astype(float), np.stack(pdf["right"]).astype(float), pdf["label"].to_numpy(float), w, b, scale, shift)
                    total, n = total + np.concatenate([[loss], *[np.ravel(x) for x in g]]), n + len(pdf)
            if n:
                yield pd.DataFrame({"i": np.arange(len(total)), "x": total, "n": n})

        rows = pairs.select("left", "right", "label").mapInPandas(run, "i int, x double, n long").groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("i").collect()
        return np.array([r["x"] for r in rows]) / max(rows[0]["n"], 1) if rows else None

    def fit(self, pairs: DataFrame, valid: DataFrame | None = None) -> SiameseTrainer:
        """pairs: left, right (vectors of one length), label 0 or 1."""
        first = pairs.select(F.size("left").alias("n")).first()
        if first is None:
            raise ValueError("no pairs")
        n, rng = first["n"], np.random.default_rng(self.seed)
        self.matrix, self.bias = rng.standard_normal((n, self.dim)) * (6 / (n + self.dim)) ** 0.5, np.zeros(self.dim)
        m = v = 0.0
        best, since, kept = np.inf, 0, None
        for t in range(1, self.epochs + 1):
            sums = self._sums(pairs)
            loss = self._sums(valid)[0] if valid is not None else sums[0]
            if loss < best - 1e-6:
                best, since, kept = loss, 0, (self.matrix.copy(), self.bias.copy(), self.scale, self.shift)
            else:
                since += 1
                if since >= self.patience:
                    break
            g = sums[1:]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            self.matrix = self.matrix - step[: n * self.dim].reshape(n, self.dim)
            self.bias = self.bias - step[n * self.dim : -2]
            self.scale, self.shift = self.scale - float(step[-2]), self.shift - float(step[-1])
        self.matrix, self.bias, self.scale, self.shift = kept
        return self

    def model(self) -> tuple[np.ndarray, np.ndarray]:
        """(matrix, bias) as ``HashedEmbedder`` takes them in matrix mode."""
        return self.matrix.astype(np.float32), self.bias.astype(np.float32)


EMBEDDERS: dict[str, Callable[..., Embedder]] = {"hashed": HashedEmbedder, "tfidf": TfIdfEmbedder, "word2vec": Word2VecEmbedder}


def embeddings_map(docs: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """A map of the vectors that a document has."""
    pairs = [x for k, c in columns.items() for x in (F.lit(k), c)]
    return docs.withColumn("embeddings", F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()))
