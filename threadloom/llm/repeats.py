"""Exact repeats: suffix sorting in buckets, with difference-cover ranks for long ties.

A byte goes if a ``width``-byte string that covers it also starts somewhere else. All suffixes of the corpus would have
to be sorted; instead they are dealt into suffix buckets by content, and one bucket is sorted at a time:

1. Every window of ``width`` bytes holds a run of ``gram`` bytes whose hash is the least in it (the later of equals): its
   anchor. Equal windows have equal anchors at equal distance. Neighbouring windows share an anchor, and travel as one
   segment, cut in the middle of the possible distances; all windows of such a part share more bytes than the anchor, and meet
   their equals in the bucket of these bytes' hash. Buckets with one segment end here.
2. Segments whose bytes are alike are one; where such a segment occurs twice, all of its windows repeat.
3. In the other buckets, the windows of the distinct segments are sorted in byte order. Distances from the anchor align
   them, so a cover of one residue modulo ``PERIOD`` meets in every pair: ranks of the cover's samples over up to 256 bytes
   are precomputed by doubling, and windows that tie on their first bytes are ordered by two sample ranks and their last
   bytes. Neighbours in that order are then compared. Memory is that of a bucket, or of a slice of small ones.
4. A bucket of more than ``most`` distinct segments is split by further content first: its segments are cut into pieces of
   an eighth of the distances, dealt by all bytes that the piece's windows share, and steps 2 to 4 run again on those. A
   piece ends as one window, whose bucket holds nothing else; so this comes to an end for any content.

The same runs over words in place of bytes, each word as a 64-bit hash, for passages of ``words`` words or more (51: over 50)
that another document holds too, blanks aside. Many of these are under ``width`` bytes, so they are told, not removed.

Scale: the texts are cut twice, first to count buckets, then to keep the segments of those that hold several. Sorted buckets ask
once more for their segments' bytes, and texts that lose something are read again. What goes on to the exact join in each case
is chosen by a bitmap of ``BITS`` bits at most, which goes to the tasks; on a corpus that fills it, more rows are shuffled and
the result is the same. Whole copies of a document are told from their 128-bit hash, folded in each task before anything is
shuffled, and one of them is asked for bytes. Counts are combined before shuffles, and joins with a hot passage read written
tables, so that Spark can split them. Nothing is collected but those bitmaps.
Segments count as alike by 64-bit hashes within a 64-bit bucket at one distance and length; short of such a collision,
results are exact.

Defined cases: null text: no bytes, no words. Texts under ``width`` bytes keep all. Overlapping occurrences count, in one
text too. Repeated rows are copies of each other. Texts are read whole, long ones in overlapping pieces. Empty table: no
rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, word_count

WIDTH, WORDS = 400, 51
PERIOD = 32
CHUNK = 1 << 20
#: A bucket to sort takes about 30 kB a segment.
MOST = 4000
SPLIT = 8
#: A multiple of 2 ** 15; the bitmap takes an eighth of it in bytes.
BITS = 1 << 27
_LOW = np.uint64((1 << 28) - 1)

_BASE = 0x9E3779B97F4A7C15
_POW: list[np.ndarray] = []
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


@dataclass(frozen=True)
class Kind:
    """What windows are made of. Contents are bytes, ``unit`` of them for each place where a window may start."""

    number: int
    width: int
    gram: int
    unit: int

    @property
    def places(self) -> int:
        """Distances that an anchor can have from the start of its window."""
        return self.width - self.gram + 1

    @property
    def half(self) -> int:
        return -(-self.places // 2)


def _powers(n: int):
    if not _POW or len(_POW[0]) < n:
        size = max(n, CHUNK + 4 * WIDTH)
        _POW[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64)))]
    return _POW


def _prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _hash(prefix: np.ndarray, start, end) -> np.ndarray:
    """Hash of the values from start to end; start and end as arrays or slices of the prefix."""
    return _mix((prefix[end] - prefix[start]) * _powers(len(prefix))[1][start])


def _blank(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def _word_hashes(data: np.ndarray):
    """Starts and hashes of the words of some bytes."""
    word = np.concatenate([[False], ~_blank(data), [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[::2], _hash(_prefix(_BYTES[data]), edge[::2], edge[1::2])


def words_of(data: np.ndarray) -> np.ndarray:
    """Hashes of all words of a text, which is read in slices that end at blanks."""
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(data):
        end, size = min(at + CHUNK, len(data)), CHUNK
        while end < len(data):
            blanks = np.flatnonzero(_blank(data[at:end]))
            if len(blanks):
                end = at + int(blanks[-1]) + 1
                break
            size *= 2
            end = min(at + size, len(data))
        out.append(_word_hashes(data[at:end])[1])
        at = end
    return np.concatenate(out)


def segments(values: np.ndarray, starts: np.ndarray, kind: Kind):
    """For all windows of the pieces that begin at starts[:-1] and end at starts[1:]: arrays (piece, first window, last
    window, anchor, hash of the values that windows at such distances share, hash of the values from the first window's start
    to the last one's end). Windows with one anchor, in one half of the distances to it, are a segment."""
    width, gram, w = kind.width, kind.gram, kind.places
    n = len(values) - width + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    p = _prefix(values)
    h = _hash(p, slice(0, n + w - 1), slice(gram, gram + n + w - 1))
    # The hash's upper bits, then the place counted downwards: the least of a window is the later of equals.
    v = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))
    v = np.concatenate([v, np.full(-len(v) % w, np.iinfo(np.uint64).max)]).reshape(-1, w)
    ahead = np.minimum.accumulate(v, axis=1).ravel()
    back = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (_LOW - (np.minimum(back[:n], ahead[w - 1 : w - 1 + n]) & _LOW)).astype(np.int64)
    # Pieces lie one after the other; windows that reach into the next piece are no windows.
    begins = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    ends = starts[1:] - width + 1
    begins[starts[:-1][starts[:-1] < n]] = True
    begins[ends[(ends >= 0) & (ends < n)]] = True
    first = np.flatnonzero(begins)
    last = np.append(first[1:], n) - 1
    own = np.searchsorted(starts, first, "right") - 1
    ok = first < ends[own]
    own, first, last = own[ok], first[ok], last[ok]
    # Where the distance gets to the upper half.
    cross = anchor[first] - w + 1 + kind.half
    low, high = np.flatnonzero(first < cross), np.flatnonzero(last >= cross)
    upper = np.repeat([0, 1], [len(low), len(high)])
    first, last = np.concatenate([first[low], np.maximum(first, cross)[high]]), np.concatenate([np.minimum(last, cross - 1)[low], last[high]])
    own, a = own[np.concatenate([low, high])], anchor[first]
    least = a - w + 1 + upper * kind.half
    return own, first, last, a, _mix(_hash(p, least + kind.half - 1, least + width) + upper.astype(np.uint64)), _hash(p, first, last + width)


def _pieces(row: int, values: np.ndarray, width: int):
    """A text as (row, offset, values), a long one in pieces that overlap by a window less one."""
    for at in range(0, max(len(values) - width + 1, 0), CHUNK):
        yield row, at, values[at : at + CHUNK + width - 1]


_RUN = ("kind byte", "key binary", "first int", "last int", "anchor int", "fp long", "seg long", "w long")
_RUN_NAMES = [x.split()[0] for x in _RUN]
_RUN_TYPES = [pa.int8(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def _batch(cols: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, _RUN_TYPES, strict=True)], _RUN_NAMES)


def _cut_segments(kinds: tuple[Kind, ...], met=None):
    """Of all segments, the bucket alone; with a bitmap of buckets (a broadcast), all that is told of those in it."""

    def emit(keys, part, kind):
        starts = np.concatenate([[0], np.cumsum([len(x[2]) for x in part])])
        values = np.concatenate([x[2] for x in part])
        own, first, last, anchor, fp, seg = segments(_BYTES[values] if kind.unit == 1 else values, starts, kind)
        fp = _mix(fp + np.uint64(kind.number))
        if met is None:
            return pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64))], ["fp"])
        ok = _among(fp, met.value)
        own, first, last, anchor, fp, seg = (x[ok] for x in (own, first, last, anchor, fp, seg))
        row, shift = np.array([x[0] for x in part])[own], (np.array([x[1] for x in part]) - starts[:-1])[own]
        return _batch([np.full(len(own), kind.number, np.int8), keys.take(pa.array(row)), *((x + shift).astype(np.int32) for x in (first, last, anchor)), fp.view(np.int64), seg.view(np.int64), np.ones(len(own), np.int64)])

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            keys = batch.column("key")
            new = []
            for i, (key, t) in enumerate(zip(keys, batch.column("text"), strict=True)):
                if t.is_valid and key.as_py() not in seen:  # copies once for each task
                    seen.add(key.as_py())
                    new.append((i, np.frombuffer(t.as_buffer(), np.uint8)))
            for kind in kinds:
                part, size = [], 0
                for i, data in new:
                    for x in _pieces(i, data if kind.unit == 1 else words_of(data), kind.width):
                        part.append(x)
                        size += len(x[2])
                        if size >= CHUNK:
                            yield emit(keys, part, kind)
                            part, size = [], 0
                if part:
                    yield emit(keys, part, kind)
        yield _batch([[] for _ in _RUN]).select(_RUN_NAMES if met is not None else ["fp"])

    return run


def _among(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    bit = hashes & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _bitmap(hashes: DataFrame):
    """A broadcast of the bits of the hashes in the only column, by their lower bits: about sixteen for each, ``BITS`` at most."""
    bits = min(BITS, 1 << max(15, (16 * hashes.count()).bit_length()))
    at = F.col(hashes.columns[0]).bitwiseAND(bits - 1)
    rows = hashes.groupBy(F.shiftright(at, 15).cast("int").alias("k")).agg(F.bitmap_construct_agg(at.bitwiseAND((1 << 15) - 1)).alias("b")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[r["k"] << 12 : (r["k"] + 1) << 12] = np.frombuffer(bytes(r["b"]), np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(out)


def _texts(source: DataFrame, asked: DataFrame) -> DataFrame:
    """source: key, row, text. asked: row and more, a row for each text that is asked for. Their join; other texts end in the
    tasks that read them."""
    bitmap = _bitmap(asked.select("row"))

    def only(batches):
        for batch in batches:
            yield batch.filter(pa.array(_among(batch.column("row").to_numpy().view(np.uint64), bitmap.value)))

    return source.mapInArrow(only, source.schema).join(asked, "row")


def _ranks(words: np.ndarray) -> np.ndarray:
    """Dense ranks of rows of big-endian words, in byte order."""
    order = np.lexsort(words.T[::-1])
    new = np.concatenate([[False], (words[order[1:]] != words[order[:-1]]).any(axis=1)])
    out = np.empty(len(words), np.int64)
    out[order] = np.cumsum(new)
    return out


def repeated_windows(contents: list[bytes], offsets: np.ndarray, weights: np.ndarray, buckets: np.ndarray, kind: Kind, owners: np.ndarray | None = None) -> list[np.ndarray]:
    """Sort the windows of distinct segments, bucket by bucket. offsets: of a content's first window from its anchor.
    Returns for each segment whether each of its windows starts elsewhere too: anywhere, or with another owner if there are
    owners."""
    unit, width = kind.unit, kind.width * kind.unit
    sizes, offsets = np.array([len(c) for c in contents]), np.asarray(offsets) * unit
    base = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(contents) + bytes(2 * PERIOD), np.uint8)
    word = np.ndarray(len(data) - 7, ">u8", data, strides=(1,))
    # The cover's samples: places whose distance from the anchor is 0 modulo PERIOD, with PERIOD bytes after them.
    lead = -offsets % PERIOD
    count = np.maximum((sizes - lead) // PERIOD, 0)
    at_sample = np.cumsum(count) - count
    samples = np.repeat(base[:-1] + lead, count) + PERIOD * (np.arange(count.sum()) - np.repeat(at_sample, count))
    rank = _ranks(np.stack([word[samples + 8 * k].astype(np.uint64) for k in range(PERIOD // 8)], axis=1)) if len(samples) else np.zeros(0, np.int64)
    room = np.repeat(count, count) - (np.arange(count.sum()) - np.repeat(at_sample, count))  # samples to the segment's end
    span = 1
    while 2 * span * PERIOD <= width - 2 * PERIOD:
        far = np.minimum(np.arange(len(rank)) + span, len(rank) - 1)
        both = (rank << 32) | rank[far]
        rank = np.where(room >= 2 * span, np.unique(both, return_inverse=True)[1] if len(both) else both, rank)
        span *= 2
    # Windows: bucket and distance, first bytes, two sample ranks that reach from sample to sample, last bytes. In this
    # order of the columns, the order of the rows is that of the windows' bytes.
    many = (sizes - width) // unit + 1
    own = np.repeat(np.arange(len(sizes)), many)
    p = unit * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
    place, c = base[own] + p, offsets[own] + p
    s0 = -(-c // PERIOD) * PERIOD
    s1 = (c + width) // PERIOD * PERIOD - span * PERIOD
    k0 = at_sample[own] + (s0 - offsets[own] - lead[own]) // PERIOD
    k1 = at_sample[own] + (s1 - offsets[own] - lead[own]) // PERIOD
    cols = [(buckets[own].astype(np.int64) << 32) + c]
    cols += [word[place + 8 * k].astype(np.uint64) for k in range(PERIOD // 8)]
    cols += [(rank[k0] << 32) | rank[k1]]
    cols += [word[place + width - PERIOD + 8 * k].astype(np.uint64) for k in range(PERIOD // 8)]
    order = np.lexsort(cols[::-1])
    same = np.ones(max(len(order) - 1, 0), bool)
    for x in cols:
        y = x[order]
        same &= y[1:] == y[:-1]
    again = np.zeros(len(own), bool)
    if owners is None:
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        again |= weights[own] > 1
    elif len(order):
        begins = np.flatnonzero(np.concatenate([[True], ~same]))
        who, heavy = owners[own][order], weights[own][order]
        several = (np.minimum.reduceat(who, begins) != np.maximum.reduceat(who, begins)) | (np.maximum.reduceat(heavy, begins) > 1)
        again[order] = np.repeat(several, np.diff(np.append(begins, len(order))))
    return np.split(again, np.cumsum(many)[:-1])


def _runs(flags: np.ndarray):
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - 1


def _slices(batches, rows: int = 128):
    """Small parts of batches: what is made of a row may be many times its size."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _contents(batches, kinds: tuple[Kind, ...]):
    """Of texts with asked segments: (key, segment, content) one by one."""
    for batch in _slices(batches):
        for key, text, asked in zip(batch.column("key"), batch.column("text"), batch.column("asked").to_pylist(), strict=True):
            buffers: dict[int, memoryview] = {}
            for r in asked:
                kind = kinds[r["kind"]]
                if r["kind"] not in buffers:
                    buffers[r["kind"]] = memoryview(text.as_buffer()) if kind.unit == 1 else memoryview(words_of(np.frombuffer(text.as_buffer(), np.uint8)).tobytes())
                yield key.as_py(), r, bytes(buffers[r["kind"]][r["first"] * kind.unit : (r["last"] + kind.width) * kind.unit])


def _fetch(kinds: tuple[Kind, ...]):
    """Contents of the segments asked of each text."""
    names = ["fp", "seg", "kind", "n", "offset", "key", "first", "content"]
    types = [pa.int64(), pa.int64(), pa.int8(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]

    def run(batches):
        cols: list[list] = [[] for _ in names]
        size, made = 0, lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)
        for key, r, content in _contents(batches, kinds):
            for c, v in zip(cols, (r["fp"], r["seg"], r["kind"], r["n"], r["first"] - r["anchor"], key, r["first"], content), strict=True):
                c.append(v)
            size += len(content)
            if size >= CHUNK:
                yield made()
                cols, size = [[] for _ in names], 0
        yield made()

    return run


def _cut_again(kinds: tuple[Kind, ...], reach: int):
    """Segments of large buckets, cut where the distance from the anchor passes a multiple of ``reach``. A piece's bucket
    is that of the content which all windows at its distances share."""

    def run(batches):
        rows: list[tuple] = []
        for key, r, content in _contents(batches, kinds):
            kind = kinds[r["kind"]]
            values = _BYTES[np.frombuffer(content, np.uint8)] if kind.unit == 1 else np.frombuffer(content, np.uint64)
            p, far = _prefix(values), r["anchor"] - r["first"]  # the anchor's place in the content
            first = 0
            while first <= r["last"] - r["first"]:
                low = (first - far + kind.places - 1) // reach * reach - kind.places + 1  # least distance of this piece
                last = min(low + reach - 1 + far, r["last"] - r["first"])
                shared, all_ = _hash(p, np.array([far + low + reach - 1, first]), np.array([far + low + kind.width, last + kind.width]))
                fp = _mix(np.array([shared]) + np.uint64(r["fp"] & 0xFFFFFFFFFFFFFFFF) * np.uint64(3) + np.uint64(low + kind.places))[0]
                rows.append((r["kind"], key, r["first"] + first, r["first"] + last, r["anchor"], int(fp.view(np.int64)), int(all_.view(np.int64)), r["n"]))
                first = last + 1
            if len(rows) >= 10_000:
                yield _batch(list(zip(*rows, strict=True)))
                rows = []
        yield _batch(list(zip(*rows, strict=True)) if rows else [[] for _ in _RUN])

    return run


_SPAN = "kind byte, key binary, first int, last int"


def _sort_buckets(kinds: tuple[Kind, ...]):
    names = ["kind", "key", "first", "last"]
    types = [pa.int8(), pa.binary(), pa.int32(), pa.int32()]

    def solve(rows):
        out: list[list] = [[] for _ in names]
        seen: dict[tuple, dict] = {}
        for r in rows:  # a segment once, should its text have come more than once
            seen.setdefault((r["fp"], r["seg"], r["key"], r["first"]), r)
        for kind in kinds:
            own = [r for r in seen.values() if r["kind"] == kind.number]
            if not own:
                continue
            number = lambda xs: np.array([d[x] for d in [{x: i for i, x in enumerate(dict.fromkeys(xs))}] for x in xs])
            found = repeated_windows([r["content"] for r in own], np.array([r["offset"] for r in own]), np.array([r["n"] for r in own]), number([r["fp"] for r in own]), kind, number([r["key"] for r in own]) if kind.number else None)
            for r, flags in zip(own, found, strict=True):
                if r["n"] == 1:  # others repeat as a whole
                    for i, j in zip(*_runs(flags), strict=True):
                        for c, v in zip(out, (kind.number, r["key"], r["first"] + int(i), r["first"] + int(j)), strict=True):
                            c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    def run(batches):
        rows, size = [], 0
        for batch in _slices(batches, 1000):
            for r in batch.to_pylist():
                if size >= CHUNK and r["fp"] != rows[-1]["fp"]:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r["content"])
        yield solve(rows)

    return run


def _strip(width: int):
    """What is left of a text without the bytes that its repeated windows cover."""
    names = ["key", "n_removed", "n_spans", "kept_sha256"]

    def run(batches):
        for batch in _slices(batches):
            cols: list[list] = [[] for _ in names]  # of a slice
            for key, text, spans in zip(batch.column("key"), batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                data, at, gone, runs, left = text.as_buffer(), 0, 0, 0, hashlib.sha256()
                end = -1
                for i, j in sorted((s["first"], s["last"] + width) for s in spans):
                    if i > end:
                        runs += 1
                        left.update(data[at:i])
                        at = i
                    if j > end:
                        gone += j - max(i, end)
                        end = at = j
                left.update(data[at:])
                for c, v in zip(cols, (key.as_py(), gone, runs, left.hexdigest()), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], names)

    return run


def repeated_spans(source: DataFrame, reps: DataFrame, kinds: tuple[Kind, ...], most: int = MOST) -> list[DataFrame]:
    """source: key (of the text), row, text. reps: key, row of one of the texts with it. Spans (kind, key, first window, last window) of the windows that repeat, in tables to be
    united: of bytes (kind 0) if they start anywhere else, of words (kind 1) if another text holds them. Copies of a text count
    as one; a text's spans may come several times and overlap."""
    several = lambda rows: cut(rows.groupBy("fp").agg(F.count("*").alias("_n")).where("_n > 1").select("fp"))
    met = several(source.mapInArrow(_cut_segments(kinds), "fp long"))
    runs = cut(source.mapInArrow(_cut_segments(kinds, _bitmap(met)), ", ".join(_RUN)))
    spans, level = [], 0
    while True:
        # Written, so that joins read two exchanges and Spark can split the hash of a very common passage.
        runs = cut(runs.join(met, "fp", "left_semi"))
        # The hash of a segment's content is of its bucket and place: the distance of its start from the anchor tells places apart.
        same = ["fp", "seg", "_off", "_len"]
        runs = runs.withColumns({"_off": F.col("first") - F.col("anchor"), "_len": F.col("last") - F.col("first")})
        owned = (F.min("key") != F.max("key")) | (F.max("w") > 1)
        n = F.when(F.min("kind") == 0, F.sum("w")).otherwise(F.when(owned, 2).otherwise(1)).cast("long")
        distinct = cut(runs.groupBy(*same).agg(n.alias("n"), F.min_by(F.struct("kind", "key", "first", "last", "anchor"), F.struct("key", "first")).alias("r")))
        spans.append(cut(runs.where("w = 1").join(distinct.where("n > 1").select(*same), same, "left_semi").select("kind", "key", "first", "last")))
        open_ = cut(distinct.groupBy("fp").agg(F.count("*").alias("_d"), F.min("n").alias("_least")).where("_d > 1 and _least = 1").select("fp", "_d"))
        asked = cut(distinct.join(open_, "fp").select(*same, "n", "_d", "r.*"))
        # Words may come again in their own text alone: then each place is asked for.
        own = cut(asked.where("kind = 1 and n = 1").select(*same, "n", "_d").join(runs.select(*same, "kind", "key", "first", "last", "anchor"), same))
        asked = asked.where("kind = 0 or n > 1").unionByName(own).drop("_off", "_len")
        listed = lambda rows: rows.groupBy("key").agg(F.collect_list(F.struct("kind", "fp", "seg", "n", "first", "last", "anchor")).alias("asked"))
        per_text = lambda rows: _texts(source, cut(listed(rows).join(reps, "key").select("row", "asked")))
        small = per_text(asked.where(F.col("_d") <= most)).mapInArrow(_fetch(kinds), "fp long, seg long, kind byte, n long, offset int, key binary, first int, content binary")
        spans.append(cut(small.repartition("fp").sortWithinPartitions("fp").mapInArrow(_sort_buckets(kinds), _SPAN)))
        large = asked.where(F.col("_d") > most)
        level += 1
        if large.isEmpty():
            return spans
        reach = max(1, max(k.half for k in kinds) // SPLIT**level)
        again = per_text(large).mapInArrow(_cut_again(kinds, reach), ", ".join(_RUN))
        # Copies of a text bring the same pieces.
        runs = cut(again.dropDuplicates(["kind", "key", "first", "last", "fp"]))
        met = several(runs)


def repeated_bytes(docs: DataFrame, width: int = WIDTH, words: int = WORDS, most: int = MOST) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared_words (in passages of ``words`` words
    or more that another document holds too) and n_passages (maximal runs of them), a row per document."""
    kinds = (Kind(0, width, max(1, width // 5), 1), Kind(1, words, max(1, words // 10), 8))
    text = F.coalesce("text", F.lit(""))
    key = F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(text, *x)), 16, "0") for x in ((), (F.lit(1),))]))
    keyed = docs.select("doc_id", key.alias("key"), text.alias("text")).withColumn("row", F.xxhash64("key", "doc_id"))
    told = cut(keyed.select("doc_id", "key", "row", F.octet_length("text").cast("long").alias("n_bytes"), word_count(F.col("text")).alias("_words"), F.sha2(F.col("text").cast("binary"), 256).alias("_sha")))
    # A word and a blank for each place of a window, at least.
    source = keyed.where(F.octet_length("text") >= min(width, 2 * words - 1)).select("key", "row", "text")
    # Of the copies of a text, one stands for all.
    reps = cut(told.groupBy("key").agg(F.min("row").alias("row"), F.count("*").alias("_c")))
    parts = repeated_spans(source, reps.select("key", "row"), kinds, most)
    spans = parts[0]
    for x in parts[1:]:
        spans = spans.unionByName(x)
    copies = reps.where("_c > 1").select("key")
    # Documents whose text occurs again go as a whole; the others are read once more where they lose something.
    # Sets first: copies bring the same spans under one key, and partial sets fold them before the shuffle.
    per_text = cut(spans.groupBy("key", "kind").agg(F.collect_set(F.struct("first", "last")).alias("spans")).join(copies, "key", "left_anti"))
    lost = cut(per_text.where("kind = 0").join(reps, "key").select("row", "spans"))
    stripped = _texts(source, lost).mapInArrow(_strip(width), "key binary, n_removed long, n_spans long, kept_sha256 string")
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("runs"))
    upto = lambda s: s["last"] + words
    step = lambda a, s: F.struct(F.greatest(a["end"], upto(s)).alias("end"), (a["n"] + F.greatest(upto(s) - F.greatest(a["end"], s["first"]), F.lit(0))).alias("n"), (a["runs"] + ((a["runs"] == 0) | (s["first"] > a["end"])).cast("long")).alias("runs"))
    shared = per_text.where("kind = 1").select("key", F.aggregate(F.array_sort("spans"), begin, step).alias("s")).select("key", F.col("s.n").alias("_n_shared"), F.col("s.runs").alias("_passages"))
    rows = copies.withColumn("_gone", F.lit(True)).unionByName(stripped, allowMissingColumns=True).unionByName(shared, allowMissingColumns=True)
    # One row for each text, written, so that the join with a large group of copies can be split.
    known = cut(rows.groupBy("key").agg(*[F.max(c).alias(c) for c in rows.columns if c != "key"]))
    gone, none = F.coalesce("_gone", F.lit(False)), F.lit(0).cast("long")
    whole = gone & (F.col("n_bytes") >= width)
    copied = gone & (F.col("_words") >= words)
    return told.drop("row").join(known, "key", "left").select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", none)).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", none)).alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "_sha")).alias("kept_sha256"),
        F.when(copied, F.col("_words")).otherwise(F.coalesce("_n_shared", none)).alias("n_shared_words"),
        F.when(copied, F.lit(1).cast("long")).otherwise(F.coalesce("_passages", none)).alias("n_passages"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
