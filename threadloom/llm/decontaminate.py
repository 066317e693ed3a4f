"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item are compared once they share a seed: a run of ``min_match`` tokens with one Karp-Rabin
hash. Then the longest common runs are marked again and again, none overlapping, until none of ``min_match`` tokens is
left; the length to mark next is found by bisection with running Karp-Rabin hashes over the tokens not yet marked. The
share of the item's tokens under tiles is its coverage; tiles may lie in any order, so reordered passages count.

Scale: the benchmark is the stated query set and is read in blocks of at most about ``block_bytes`` of text; each block
is one pass over the documents, without a shuffle. A block's rows are broadcast, its index is all that a task holds, and where
there are several its findings are written and the block is released before the next one is read. Documents are never grouped.
An item is skipped before tiling only if the tokens under shared seeds could not reach the coverage: an upper bound.

Defined cases: tokens are lower-cased runs of letters, digits and underscores. Null or empty texts have none and match
nothing; items of fewer than ``min_match`` tokens match nothing. Texts and items are read whole at any length; tiling sorts a text's
windows a few times for each distinct tile length, so its time follows the length. Repeated documents and items are compared each. Ties
between runs of equal length: the earliest in the item, then in the document. Empty tables: no rows. Documents may have
further columns of any name; ``drop_contaminated`` passes them through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

MIN_MATCH = 5
COVERAGE = 0.8
BLOCK_BYTES = 4_000_000

_TOKEN = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def tokens_of(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int):
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, inverse))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def prefix_hash(ids: np.ndarray) -> np.ndarray:
    up, _ = _POWERS.get(max(len(ids), 1))
    out = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(ids * up[: len(ids)], out=out[1:])
    return out


def window_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` tokens, equal for equal runs wherever they start."""
    n = len(prefix) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    _, down = _POWERS.get(n)
    h = (prefix[width:] - prefix[:n]) * down
    h ^= h >> np.uint64(31)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def tile(item: np.ndarray, doc: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two token id arrays: (start in item, start in doc, length), none overlapping, longest first."""
    sides = [item, doc]
    prefix = [prefix_hash(x.astype(np.uint64)) for x in sides]
    marked = [np.zeros(len(x), bool) for x in sides]

    def free(width: int):
        out = []
        for p, m in zip(prefix, marked, strict=True):
            h = window_hash(p, width)
            taken = np.concatenate([[0], np.cumsum(m)])
            at = np.flatnonzero(taken[width : width + len(h)] == taken[: len(h)])
            out.append((at, h[at]))
        return out

    def shared(width: int):
        (a, ha), (b, hb) = free(width)
        hit = np.isin(ha, hb)
        return a[hit], ha[hit], b, hb

    tiles, most = [], min(len(item), len(doc))
    while most >= min_match and len(shared(min_match)[0]):
        low, high = min_match, most
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if len(shared(mid)[0]) else (low, mid - 1)
        a, ha, b, hb = shared(low)
        order = np.argsort(hb, kind="stable")
        sorted_hb = hb[order]
        before = len(tiles)
        for i, h in zip(a.tolist(), ha, strict=True):
            if marked[0][i : i + low].any():
                continue
            for j in b[order[np.searchsorted(sorted_hb, h, "left") : np.searchsorted(sorted_hb, h, "right")]].tolist():
                if not marked[1][j : j + low].any() and np.array_equal(item[i : i + low], doc[j : j + low]):
                    tiles.append((i, j, low))
                    marked[0][i : i + low] = True
                    marked[1][j : j + low] = True
                    break
        most = low if len(tiles) > before else low - 1
    return tiles


class Index:
    """Of one block of the benchmark: token ids, seeds in order, and the items that hold each."""

    def __init__(self, items: list[tuple], min_match: int):
        self.min_match, self.vocabulary, self.items = min_match, {}, []
        seeds, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for key, text in items:
            ids = np.array([self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in tokens_of(text)], np.int64)
            if len(ids) < min_match:
                continue
            h = window_hash(prefix_hash(ids.astype(np.uint64)), min_match)
            self.items.append((key, ids, h))
            distinct = np.unique(h)
            seeds.append(distinct)
            owners.append(np.full(len(distinct), len(self.items) - 1))
        flat, own = np.concatenate(seeds), np.concatenate(owners)
        order = np.argsort(flat, kind="stable")
        self.seeds, self.owners = flat[order], own[order]

    def matches(self, text: str | None, coverage: float) -> list[tuple]:
        """(item key, item tokens, tiles, tokens under tiles) of the items that the text covers."""
        get = self.vocabulary.get
        ids = np.array([get(t, 0) for t in tokens_of(text)], np.int64)
        m = self.min_match
        if len(ids) < m or not len(self.seeds):
            return []
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        at = np.flatnonzero(known[m:] - known[:-m] == m)
        if not len(at):
            return []
        h = window_hash(prefix_hash(ids.astype(np.uint64)), m)[at]
        found = np.unique(h[self.seeds[np.minimum(np.searchsorted(self.seeds, h), len(self.seeds) - 1)] == h])
        if not len(found):
            return []
        lo, hi = np.searchsorted(self.seeds, found, "left"), np.searchsorted(self.seeds, found, "right")
        out = []
        for k in np.unique(np.concatenate([self.owners[i:j] for i, j in zip(lo, hi, strict=True)])).tolist():
            key, item, own = self.items[k]
            under = np.zeros(len(item) + 1, np.int64)
            starts = np.flatnonzero(np.isin(own, found))
            np.add.at(under, starts, 1)
            np.add.at(under, starts + m, -1)
            if np.count_nonzero(np.cumsum(under[:-1])) < coverage * len(item):
                continue
            tiles = tile(item, ids, m)
            matched = sum(n for _, _, n in tiles)
            if matched >= coverage * len(item):
                out.append((key, len(item), len(tiles), matched))
        return out


def _blocks(items: DataFrame, block_bytes: int) -> tuple[int, Iterator[list[tuple]]]:
    """How many blocks the benchmark's rows make, and the blocks; one is what the driver holds at a time."""
    items = items.select("item_id", "text").where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    parts = (items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n))
    return n, ([(r[0], r[1]) for r in part.collect()] for part in parts)


def _found(docs: DataFrame, items: DataFrame, min_match: int, coverage: float, block_bytes: int) -> DataFrame:
    """A row for each pair whose coverage is reached, with the hash of the document's text besides."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, _th long, item_id {dict(items.dtypes)['item_id']}, item_tokens long, n_tiles long, matched long, coverage double"
    found = spark.createDataFrame([], schema)
    names, types = found.columns, [to_arrow_type(f.dataType) for f in found.schema]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_th"))

    def scan(block):
        def run(batches):
            index = Index(block.value, min_match)
            for batch in batches:
                cols: list[list] = [[] for _ in names]
                for doc, th, text in zip(batch.column("doc_id").to_pylist(), batch.column("_th").to_pylist(), batch.column("text"), strict=True):
                    for item, n, tiles, matched in index.matches(text.as_py(), coverage):
                        for c, v in zip(cols, (doc, th, item, n, tiles, matched, matched / n), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        return run

    n, blocks = _blocks(items, block_bytes)
    for block in blocks:
        shared = spark.sparkContext.broadcast(block)
        part = rows.mapInArrow(scan(shared), schema)
        if n == 1:
            return part
        found = found.unionByName(cut(part))
        shared.destroy()
    return found


def find_leaks(docs: DataFrame, items: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs: doc_id, text. items: item_id, text. Returns a row for each pair whose coverage is reached: doc_id, item_id,
    item_tokens, n_tiles, matched, coverage."""
    return _found(docs, items, min_match, coverage, block_bytes).drop("_th")


def drop_contaminated(docs: DataFrame, items: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without those that cover an item; all columns pass through. One block filters in place, without a shuffle; with
    several, the findings of all leave by id and text."""
    n, blocks = _blocks(items, block_bytes)
    if n == 1:
        block = docs.sparkSession.sparkContext.broadcast(next(blocks))

        def keep(batches):
            index = Index(block.value, min_match)
            for batch in batches:
                yield batch.filter(pa.array([not index.matches(t.as_py(), coverage) for t in batch.column("text")], pa.bool_()))

        return docs.mapInArrow(keep, docs.schema)
    gone = _found(docs, items, min_match, coverage, block_bytes).select(F.col("doc_id").alias("__gone_id"), F.col("_th").alias("__gone_th")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__gone_id"]) & (F.xxhash64(docs["text"]) == gone["__gone_th"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
