"""Truncated SVD of a sparse matrix given as rows (row, token, x), by a randomised range finder.

Tokens start with pseudo-random vectors from their hashes, are multiplied by the matrix and its transpose a few times, and are
made orthonormal in between; a small symmetric matrix then gives the singular values. Orthonormalisation needs only Gram matrices,
each task's sum of which is a few numbers.

A vocabulary whose vectors are at most ``MOST`` numbers is broadcast: a round is one pass over the rows, in which each task multiplies its
rows forth and back and gives up one sum for each token. Beyond that, products are joins with sums that are combined before
the shuffle, and no matrix with a side of rows or tokens is ever in one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .pairs import matrix


def _known(entries: DataFrame) -> DataFrame:
    return entries.where("row is not null and token is not null and x is not null")


def _gram(vectors: DataFrame, k: int) -> np.ndarray:
    """The sum over rows of v vT, k by k."""

    def partial(batches):
        total = np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("v"))
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["g"])

    summed = vectors.select("v").mapInArrow(partial, "g array<double>").agg(Summarizer.sum(array_to_vector("g")).alias("s")).first()
    return summed["s"].toArray().reshape(k, k) if summed["s"] is not None else np.zeros((k, k))


def _times(vectors: DataFrame, key: str, t: np.ndarray) -> DataFrame:
    """key, v: each vector times the small matrix."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = matrix(batch.column("v")) @ t
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * t.shape[1]), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(key), flat], [key, "v"])

    return vectors.select(key, "v").mapInArrow(run, f"{key} {dict(vectors.dtypes)[key]}, v array<double>")


def _sums(rows: DataFrame, key: str) -> DataFrame:
    """key, v: the sums of v times x."""
    weighed = rows.select(key, F.transform("v", lambda y: y * F.col("x")).alias("v"))
    return weighed.groupBy(key).agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))


def times_tokens(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """rows: row, e (its entries). row, v: the matrix times the tokens' vectors. A row's entries lie together, so its sum is made in few tasks."""
    return _sums(rows.select("row", F.explode("e").alias("e")).select("row", "e.*").join(tokens, "token"), "row")


def times_rows(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """token, v: the transpose times the rows' vectors. Rows move with all their entries; what is summed by token moves as sums."""
    return _sums(rows.join(vectors, "row").select("v", F.explode("e").alias("e")).select("v", "e.*"), "token")


#: Numbers of all tokens' vectors that are broadcast at most.
MOST = 4_000_000


class _Shared:
    """The tokens' vectors, broadcast: tokens (Arrow strings) and w (a row for each)."""

    def __init__(self, tokens: DataFrame):
        found = tokens.select("token", "v").toPandas()
        self.tokens, self.w = pa.array(found["token"], pa.string()), np.array(found["v"].tolist(), np.float64) if len(found) else np.zeros((0, 1))

    def forward(self, entries) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """entries: an Arrow column of lists of (token, x). Each row's sum; and of the known entries their rows, tokens and numbers."""
        flat = pc.list_flatten(entries)
        at = pc.index_in(flat.field("token"), self.tokens)
        own = np.repeat(np.arange(len(entries)), pc.list_value_length(entries).to_numpy(zero_copy_only=False))
        known = pc.is_valid(at).to_numpy(zero_copy_only=False)
        own, at, x = own[known], pc.drop_null(at).to_numpy(), flat.field("x").to_numpy(zero_copy_only=False)[known]
        y = np.zeros((len(entries), self.w.shape[1]))
        for k in range(y.shape[1]):
            y[:, k] = np.bincount(own, x * self.w[at, k], len(entries))
        return y, own, at, x


def _lists(y: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))


def forth(rows: DataFrame, tokens: DataFrame, most: int = MOST) -> DataFrame:
    """rows: row, e (its entries). row, v: the matrix times the tokens' vectors; rows without a known token are missing."""
    k, n = _width(tokens), tokens.count()
    if n * k > most:
        return times_tokens(rows, tokens)
    shared = rows.sparkSession.sparkContext.broadcast(_Shared(tokens))

    def run(batches):
        for batch in batches:
            y, own, _, _ = shared.value.forward(batch.column("e"))
            some = np.unique(own)
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(some)), _lists(y[some])], ["row", "v"])

    return rows.select("row", "e").mapInArrow(run, f"row {dict(rows.dtypes)['row']}, v array<double>")


def forth_and_back(rows: DataFrame, tokens: DataFrame, most: int = MOST) -> DataFrame:
    """token, v: the transpose of the matrix times the matrix times the tokens' vectors."""
    if tokens.count() * _width(tokens) > most:
        return times_rows(rows, times_tokens(rows, tokens))
    shared = rows.sparkSession.sparkContext.broadcast(_Shared(tokens))

    def run(batches):
        total = np.zeros_like(shared.value.w)
        for batch in batches:
            y, own, at, x = shared.value.forward(batch.column("e"))
            for k in range(y.shape[1]):
                total[:, k] += np.bincount(at, x * y[own, k], len(total))
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([shared.value.tokens.take(pa.array(some)), _lists(total[some])], ["token", "v"])

    parts = rows.select("e").mapInArrow(run, "token string, v array<double>")
    return parts.groupBy("token").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))


def _width(tokens: DataFrame) -> int:
    return tokens.agg(F.max(F.size("v"))).first()[0] or 0


class TruncatedSvd:
    """fit finds ``values`` (numpy, descending) and ``vectors`` (token, v: its coordinates on the right singular vectors), ``rank`` of
    them or fewer if the matrix has no more; transform maps rows to those coordinates. Deterministic. Repeated (row, token) entries
    add up; nulls are left out; a matrix without entries has no values and no vectors."""

    def __init__(self, rank: int = 50, oversample: int = 8, rounds: int = 4, most: int = MOST):
        self.rank, self.size, self.rounds, self.most = rank, rank + oversample, rounds, most
        self.values, self.vectors = np.zeros(0), None

    def fit(self, entries: DataFrame) -> TruncatedSvd:
        k = self.size
        entries = _known(entries).groupBy("row", "token").agg(F.sum(F.col("x").cast("double")).alias("x"))
        rows = cut(entries.groupBy("row").agg(F.collect_list(F.struct("token", "x")).alias("e")))
        unit = lambda i, salt: (F.shiftrightunsigned(F.xxhash64("token", i, F.lit(salt)), 11) + F.lit(0.5)) / F.lit(float(2**53))
        normal = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.sqrt(-2 * F.log(unit(i, 1))) * F.cos(2 * np.pi * unit(i, 2)))
        tokens = cut(rows.select(F.explode("e.token").alias("token")).distinct().withColumn("v", normal))
        for _ in range(self.rounds):
            back = cut(forth_and_back(rows, tokens, self.most))
            weight, basis = np.linalg.eigh(_gram(back, k))
            keep = weight > max(weight.max(), 0) * 1e-13
            if not keep.any():
                return self
            tokens, k = cut(_times(back, "token", basis[:, keep] / np.sqrt(weight[keep]))), int(keep.sum())
        # Once more by its Gram matrix, since squaring costs half of the digits.
        weight, basis = np.linalg.eigh(_gram(tokens, k))
        fix = basis / np.sqrt(weight)
        tokens = cut(_times(tokens, "token", fix))
        weight, basis = np.linalg.eigh(_gram(forth(rows, tokens, self.most), k))
        order = np.argsort(-weight)[: self.rank]
        order = order[weight[order] > weight.max() * 1e-12]
        self.values, self.vectors = np.sqrt(weight[order]), cut(_times(tokens, "token", basis[:, order]))
        return self

    def transform(self, entries: DataFrame) -> DataFrame:
        """row, vector; rows without a known token are missing."""
        rows = _known(entries).groupBy("row").agg(F.collect_list(F.struct("token", "x")).alias("e"))
        return forth(rows, self.vectors, self.most).withColumnRenamed("v", "vector")
