"""N-gram Jaccard join with Bayesian candidate pruning.

A document is the set of its shingles of five lower-cased words. Documents with one set are a copy class, joined once by
its representative. Bands of MinHash values bring candidates together; within a bucket, signatures are compared a few
values at a time, and a pair is dropped as soon as the posterior probability (uniform prior) that its similarity reaches
the threshold falls below ``tolerance``. What is left is verified on the sets themselves.

At similarity 0.8, 24 bands of 4 values miss a pair with probability 3e-6, and the pruning adds about as much as
``tolerance``; no bucket is capped.

Scale: only bucket counts and fingerprints are shuffled for all documents. Buckets with the same members are one bucket;
buckets of one member end there. The sets of the remaining representatives are hashed again from their texts and dealt to
their buckets; a large bucket is cut into blocks of ``block`` members, and each pair of blocks is a task's group. A pair
that meets in several buckets counts in the first. Blocks give out link counts and spanning edges, never pairs.

Defined cases: texts under five words are one shingle of all their words; null texts and texts without words have no
shingles, link to nothing and are classes of their own (id: their own doc_id). Copies link to each other, repeated rows
included. Null doc_id: joined by text alike; ids of classes are the least non-null doc_id. Texts are hashed whole. Empty
table: no rows. Other columns pass through ``keep_one``, but names that start with ``__near_`` are taken; of rows alike in id and
text but not in other columns, any one stays.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import cut, table

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
STEP = 16
TOLERANCE = 1e-6
BLOCK = 512

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_CACHE_WORDS = 400_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sorted distinct 64-bit hashes of a text's shingles."""

    def __init__(self, words: int = WORDS):
        self.words, self.cache = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        found, cache = _WORD.findall(text.lower()) if text else [], self.cache
        if not found:
            return np.zeros(0, np.uint64)
        if len(cache) > _CACHE_WORDS:
            cache.clear()
        ids = []
        for w in found:
            h = cache.get(w)
            if h is None:
                h = cache[w] = xxhash.xxh3_64_intdigest(w)
            ids.append(h)
        x = np.array(ids, np.uint64)
        k = min(self.words, len(x))
        n = len(x) - k + 1
        h = x[:n].copy()
        for i in range(1, k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + x[i : i + n]
        return np.unique(_mix(h + np.uint64(k)))


@lru_cache(4)
def _family(k: int):
    rng = np.random.default_rng(20240229)
    return (rng.integers(0, 1 << 63, k, dtype=np.uint64) << np.uint64(1)) | np.uint64(1), rng.integers(0, 1 << 63, k, dtype=np.uint64)


def signature(x: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    a, b = _family(k)
    out = np.full(k, np.iinfo(np.uint64).max)
    for i in range(0, len(x), 1024):
        np.minimum(out, (x[None, i : i + 1024] * a[:, None] + b[:, None]).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


@lru_cache(8)
def least_matches(k: int, step: int, threshold: float, tolerance: float) -> tuple[int, ...]:
    """For step, 2 step, ... compared values: the fewest matches at which P(similarity >= threshold) >= tolerance."""
    s = (np.arange(20000) + 0.5) / 20000
    out = []
    for n in range(step, k + 1, step):
        for m in range(n + 1):
            logs = m * np.log(s) + (n - m) * np.log1p(-s)
            p = np.exp(logs - logs.max())
            if p[s >= threshold].sum() >= tolerance * p.sum():
                break
        out.append(m)
    return tuple(out)


def _common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets a[i] and b[i]."""
    if len(a) <= 4 * len(sets):
        return np.array([len(sets[i]) + len(sets[j]) - len(np.unique(np.concatenate([sets[i], sets[j]]))) for i, j in zip(a, b, strict=True)], np.int64)
    # Many pairs of few sets: a product of the incidence matrix, over the shingles that occur twice, in slices.
    flat, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, own = flat[order], own[order]
    first = np.concatenate([[True], flat[1:] != flat[:-1]])
    ids = np.cumsum(first) - 1
    counts = np.bincount(ids)
    again = counts[ids] > 1
    new = np.cumsum(counts > 1) - 1
    ids, own = new[ids[again]], own[again]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(ids[-1]) + 1 if len(ids) else 0, 8192):
        part = slice(np.searchsorted(ids, at), np.searchsorted(ids, at + 8192))
        m = np.zeros((len(sets), 8192), np.float32)
        m[own[part], ids[part] - at] = 1
        total += m @ m.T
    return np.rint(total[a, b]).astype(np.int64)


def links_in(bucket: int, sides: np.ndarray, sizes: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray], buckets: list[list[int]], threshold: float = THRESHOLD, tolerance: float = TOLERANCE, step: int = STEP):
    """Linked pairs of a block (sides all 0) or between two blocks (sides 0 and 1) that meet in no earlier bucket."""
    if sides.any():
        a, b = (x.ravel() for x in np.meshgrid(np.flatnonzero(sides == 0), np.flatnonzero(sides == 1), indexing="ij"))
    else:
        a, b = np.triu_indices(len(sides), 1)
    near = np.minimum(sizes[a], sizes[b]) >= threshold * np.maximum(sizes[a], sizes[b]) - 1e-9
    a, b = a[near], b[near]
    earlier: dict[int, list[int]] = {}
    for i, own in enumerate(buckets):
        for z in own:
            if z < bucket:
                earlier.setdefault(z, []).append(i)
    earlier = {z: m for z, m in earlier.items() if len(m) > 1}
    if earlier and len(a):
        met = np.zeros((len(sides), len(sides)), bool)
        for m in earlier.values():
            met[np.ix_(m, m)] = True
        a, b = a[~met[a, b]], b[~met[a, b]]
    agree = np.zeros(len(a), np.int64)
    for k, least in enumerate(least_matches(sigs.shape[1], step, threshold, tolerance)):
        part = slice(k * step, (k + 1) * step)
        for i in range(0, len(a), 1 << 16):
            j = slice(i, i + (1 << 16))
            agree[j] += (sigs[a[j], part] == sigs[b[j], part]).sum(axis=1)
        alive = agree >= least
        a, b, agree = a[alive], b[alive], agree[alive]
    if not len(a):
        return a, b
    both = _common(sets, a, b)
    good = both >= threshold * (sizes[a] + sizes[b] - both) - 1e-9
    return a[good], b[good]


def _describe(words: int):
    def run(batches):
        of = Shingles(words)
        for batch in batches:
            keys, sigs, sizes = [], [], []
            for t in batch.column("text"):
                x = of(t.as_py())
                sizes.append(len(x))
                keys.append(np.array([_mix(x + np.uint64(1)).sum(), np.bitwise_xor.reduce(_mix(x ^ np.uint64(0x5851F42D4C957F2D)))]).astype("<u8").tobytes() if len(x) else None)
                sigs.append(signature(x).tobytes() if len(x) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_th"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "_th", "key", "n", "sig"])

    return run


def _sets(words: int):
    def run(batches):
        of = Shingles(words)
        for batch in batches:
            out = pa.array([of(t.as_py()).tobytes() for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("key"), out], ["key", "set"])

    return run


def _verify(threshold: float, tolerance: float):
    names = ["key", "other", "links"]

    def solve(rows, out):
        seen, own = set(), []
        for r in rows:  # a key once, should its text have come more than once
            if r["key"] not in seen:
                seen.add(r["key"])
                own.append(r)
        if len(own) < 2:
            return
        least = min(r["blk"] for r in own)
        cross = own[0]["i"] != own[0]["j"]
        sides = np.array([int(cross and r["blk"] != least) for r in own])
        if cross and not sides.any():
            return
        sets = [np.frombuffer(r["set"], np.uint64) for r in own]
        sizes, copies = np.array([len(x) for x in sets]), np.array([r["copies"] for r in own])
        sigs = np.array([np.frombuffer(r["sig"], np.uint32) for r in own])
        a, b = links_in(own[0]["bucket"], sides, sizes, sigs, sets, [r["buckets"] for r in own], threshold, tolerance)
        if not len(a):
            return
        n = np.bincount(a, copies[b], len(own)) + np.bincount(b, copies[a], len(own))
        root = list(range(len(own)))

        def top(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = top(x), top(y)
            if x != y:
                root[max(x, y)] = min(x, y)
        for k in np.flatnonzero(n).tolist():
            out.append((own[k]["key"], own[top(k)]["key"], int(n[k])))

    def run(batches):
        at, rows, out = None, [], []
        for batch in batches:
            for r in batch.to_pylist():
                g = (r["bucket"], r["i"], r["j"])
                if g != at:
                    solve(rows, out)
                    at, rows = g, []
                rows.append(r)
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.binary(), pa.binary(), pa.int64()))], names)
            out = []
        solve(rows, out)
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.binary(), pa.binary(), pa.int64()))], names)

    return run


def join(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, tolerance: float = TOLERANCE, block: int = BLOCK):
    """docs: doc_id, text. Returns two tables: members (doc_id, _th, key, comp, copies, n_links), a row per document, and
    classes (comp, class_id, _th: text hash of a document that may stand for the class)."""
    assert bands * rows == BANDS * ROWS
    text = docs.select("doc_id", "text", F.xxhash64("text").alias("_th"))
    id_type = dict(docs.dtypes)["doc_id"]
    seen = cut(text.mapInArrow(_describe(words), f"doc_id {id_type}, _th long, key binary, n long, sig binary"))
    reps = cut(
        seen.where("key is not null").groupBy("key")
        .agg(F.count("*").alias("copies"), F.min_by(F.struct("doc_id", "_th"), F.struct(F.col("doc_id").isNull(), "doc_id", "_th")).alias("_r"), F.first("sig").alias("sig"))
        .select("key", "copies", F.col("_r.doc_id").alias("doc_id"), F.col("_r._th").alias("_th"), "sig")
    )
    banded = reps.select("key", F.explode(F.array(*[F.xxhash64(F.lit(b), F.substring("sig", 4 * rows * b + 1, 4 * rows)) for b in range(bands)])).alias("bucket"))
    prints = [F.bit_xor(F.xxhash64("key", F.lit(s))).alias(f"_p{s}") for s in (1, 2)]
    full = banded.groupBy("bucket").agg(F.count("*").alias("_c"), *prints).where("_c > 1")
    full = cut(full.groupBy("_c", "_p1", "_p2").agg(F.min("bucket").alias("bucket")).select("bucket", "_c"))
    members = banded.join(full, "bucket")
    lists = cut(members.groupBy("key").agg(F.collect_list(F.struct("bucket", "_c")).alias("_b")).join(reps, "key"))
    wanted = lists.select("key", F.col("doc_id").alias("_d"), F.col("_th").alias("_t"))
    again = text.join(wanted, text["doc_id"].eqNullSafe(wanted["_d"]) & (text["_th"] == wanted["_t"])).select("key", "text")
    sets = again.mapInArrow(_sets(words), "key binary, set binary")
    full_rows = sets.join(lists.select("key", "copies", "sig", "_b"), "key")
    dealt = full_rows.withColumn("buckets", F.col("_b.bucket")).withColumn("_x", F.explode("_b"))
    blocks = F.ceil(F.col("_x._c") / block).cast("int")
    dealt = dealt.select("key", "copies", "sig", "set", "buckets", F.col("_x.bucket").alias("bucket"), blocks.alias("_n"), F.pmod(F.xxhash64("key", "_x.bucket"), blocks).cast("int").alias("blk"))
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select("key", "copies", "sig", "set", "buckets", "bucket", "blk", F.least("blk", "_o").alias("i"), F.greatest("blk", "_o").alias("j"))
    dealt = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    linked = cut(dealt.mapInArrow(_verify(threshold, tolerance), "key binary, other binary, links long"))
    comps = connected_components(linked.select(F.col("key").alias("a"), F.col("other").alias("b")))
    links = linked.groupBy("key").agg(F.sum("links").alias("_l"))
    known = cut(reps.drop("sig").join(comps, "key", "left").join(links, "key", "left").select("key", F.coalesce("comp", "key").alias("comp"), "copies", "doc_id", "_th", (F.coalesce("_l", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    best = F.min_by(F.struct("doc_id", "_th"), F.struct(F.col("doc_id").isNull(), "doc_id", "_th"))
    # Written, so that joins with it read two exchanges and Spark can split a large class.
    classes = cut(known.groupBy("comp").agg(best.alias("_b")).select("comp", F.col("_b.doc_id").alias("class_id"), F.col("_b._th").alias("_th")))
    return seen.select("doc_id", "_th", "key").join(known.select("key", "comp", "copies", "n_links"), "key", "left"), classes


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row per document: doc_id, class_id (least doc_id of the documents that links connect), n_links (documents whose
    similarity to it reaches the threshold), n_copies (documents with its shingle set, itself included)."""
    members, classes = join(docs, threshold)
    out = members.join(classes.select("comp", "class_id"), "comp", "left")
    return out.select("doc_id", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("n_copies"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each class (the one with the least doc_id) and all documents without words."""
    _, classes = join(docs, threshold)
    stay = classes.select(F.col("class_id").alias("__near_id"), F.col("_th").alias("__near_th"))
    rows = docs.withColumn("__near_hash", F.xxhash64("text"))
    blank = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = rows.where(~blank).join(stay, rows["doc_id"].eqNullSafe(stay["__near_id"]) & (rows["__near_hash"] == stay["__near_th"])).dropDuplicates(["__near_id", "__near_th"])
    return kept.select(*docs.columns).unionByName(docs.where(blank))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
