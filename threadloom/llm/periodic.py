"""Periodic runs of words: maximal stretches that repeat one block at least ``power`` times, and texts without the repeats.

A text's words become ids, and runs are found by divide and conquer after Main and Lorentz: at each midpoint, Z-functions
of both halves and of their reverses tell for every period how far it reaches to either side; what crosses the midpoint
and is long enough is a run unless a border of the half cuts it, in which case it crosses the midpoint of a larger piece.
Intervals found under several periods keep the smallest.

Periods are searched by powers of two, smallest first. In a run of period q every word but the first q has stood at most
q words before, so for each band of periods only stretches of such words are divided; words deep inside a run already
found are left out as well, since two runs of different periods share fewer words than the sum of the periods.

Scale: one pass without a shuffle; a task holds one batch of texts and the words of one text. Time is about n log n in a text's words.

Defined cases: words are separated by ASCII blanks. Null and empty texts have no words, no runs and an empty collapsed
text. Texts are read whole at any length. Repeated rows are treated each. Overlapping runs are all told; a word that any
of them repeats is dropped. Empty table: no rows. Other columns pass through; ``runs``, ``collapsed`` and ``n_words`` are replaced. In the
query a null doc_id gets no planted period.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import WORD, table

LEAST, POWER = 6, 4


def z_function(s: list[int], upto: int) -> list[int]:
    """For i below ``upto``, the length of the longest common prefix of s and s[i:]."""
    n, out, left, right = len(s), [0] * upto, 0, 0
    for i in range(1, upto):
        k = 0
        if i < right:
            k = out[i - left]
            if k < right - i:
                out[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        out[i] = k
        if i + k > right:
            left, right = i, i + k
    return out


def _divide(ids: list[int], begin: int, end: int, low: int, high: int, least: int, power: int, found: dict):
    """Runs of periods low to high inside ids[begin:end] that nothing extends, into found: (start, end) -> period."""
    n, pieces = len(ids), [(begin, end)]
    while pieces:
        l, r = pieces.pop()
        if r - l < max(least, power * low):
            continue
        m = (l + r) // 2
        pieces += [(l, m), (m, r)]
        before, after = ids[l:m], ids[m:r]
        most = min(high, (r - l) // power)
        a, b = min(most, m - l), min(most, r - m)
        # Forward from m: of v itself, then of the a words before m and what follows them. Backward likewise.
        ahead = z_function([*after, -1, *ids[m - a : r]], r - m + 1 + a)
        behind = z_function([*before[::-1], -1, *ids[l : m + b][::-1]], m - l + 1 + b)
        crossing = [(m - p - (behind[p] if p < m - l else 0), m + ahead[r - m + 1 + a - p], p) for p in range(low, a + 1)]
        crossing += [(m - behind[m - l + 1 + b - p], m + p + (ahead[p] if p < r - m else 0), p) for p in range(low, b + 1)]
        for s, e, p in crossing:
            if e - s < max(least, power * p) or (s and ids[s - 1] == ids[s - 1 + p]) or (e < n and ids[e] == ids[e - p]):
                continue
            if found.get((s, e), p) >= p:
                found[s, e] = p


def find(words: list, least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs of at least ``least`` words and ``power`` periods, by start, then period."""
    n = len(words)
    if n < max(least, power):
        return []
    seen: dict = {}
    back = np.empty(n, np.int64)
    for i, w in enumerate(words):
        back[i] = i - seen.get(w, -n - n)
        seen[w] = i
    ids, found, low = None, {}, 1
    while power * low <= n:
        high = min(2 * low - 1, n // power)
        near = back <= high
        for (s, e) in found:
            near[s + 2 * high : max(e - 2 * high, s + 2 * high)] = False
        edges = np.flatnonzero(np.diff(np.concatenate([[0], near, [0]])))
        starts, ends = edges[::2], edges[1::2]
        wide = ends - starts >= max((power - 1) * low, least - high)
        for s, e in zip(starts[wide].tolist(), ends[wide].tolist(), strict=True):
            if ids is None:
                number = dict.fromkeys(words)
                for k, w in enumerate(number):
                    number[w] = k
                ids = [number[w] for w in words]
            _divide(ids, max(0, s - high), e, low, high, least, power, found)
        low *= 2
    return sorted((s, e - s, p) for (s, e), p in found.items())


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds behind its first period."""
    drop = np.zeros(len(words) + 1, np.int64)
    for s, n, p in runs:
        drop[s + p] += 1
        drop[s + n] -= 1
    return [w for w, d in zip(words, np.cumsum(drop).tolist()) if not d]


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST, power: int = POWER) -> DataFrame:
    """docs: any columns and a text column. Adds n_words, runs (start, length, period; by start, then period) and collapsed: the
    words that stay, joined by one space."""
    docs = docs.drop("n_words", "runs", "collapsed")
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def search(batches):
        for batch in batches:
            counts, runs, left = [], [], []
            for t in batch.column(text):
                # bytes.split() cuts at exactly the six ASCII blanks.
                words = (t.as_py() or "").encode().split()
                at = find(words, least, power)
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in at])
                left.append(b" ".join(collapse(words, at) if at else words).decode())
            out = batch.append_column("n_words", pa.array(counts, pa.int64()))
            yield out.append_column("runs", pa.array(runs, run_type)).append_column("collapsed", pa.array(left, pa.string()))

    added = StructType.fromDDL("n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return docs.mapInArrow(search, StructType([*docs.schema.fields, *added.fields]))


def planted(doc_id: Column, text: Column) -> Column:
    """The text, with words from some place on repeated by a period that the id's checksum sets, for one id in ten."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(w: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1))
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(F.size(w) > 0, F.array_join(at, " "))

    # A one-element array binds the words, which are used several times.
    words = F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), repeat)[0]
    return F.when((h % 10 == 0) & text.isNotNull(), words).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = find_runs(docs).select("doc_id", "runs", "collapsed", best.alias("best"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.n").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.floor(1000 * F.col("best.n") / -F.col("best.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
