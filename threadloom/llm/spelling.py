"""Grouping of spelling variants: words one edit apart, the frequent form of a rare one, and the root of a chain of forms.

Two words are near if one inserted, deleted or replaced code point tells them apart. An edit leaves the first or the second
half of the shorter word as it is, so near words meet in a cell of words that share that half. Within a cell every word is
cut into padded pairs of characters with their positions, and an inverted index lists the words of each pair and position.
One edit touches two pairs at most and moves the rest by one place: of a word's pairs, all but two must occur in the other
within one position. So among any three pairs one survives: the postings of the three rarest are merged by a heap, what
else the merged words share is looked up, words under the count bound fall away, and the rest is verified.

Scale: words are counted with partial sums before the shuffle. A cell holds at most two slices of ``cell`` words; a half that more
words share is dealt in slices, and each pair of slices is a cell of its own, so no group is bounded by dropping. A pair of
words is found in one cell only: the first halves have priority, and lengths belong to the shorter word. Chains of forms
are followed by pointer jumping, each round written; counts grow at least by ``ratio`` along a chain, so rounds are few.

Defined cases: null texts have no words. Words are compared by code points; only A-Z are lower-cased. Ties between forms:
the smaller in code-point order. A null doc_id counts as the empty text in the checksum. Repeated rows count each. Texts
and words are read whole at any length. Empty table: no rows. Further columns of the documents are not read.
"""

from __future__ import annotations

import heapq
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

SHORTEST, FEWEST, RATIO = 6, 5, 5
CELL = 2048
SLIP = 199
RUN = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def one_edit(x: str, y: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point tells the words apart."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1 or x == y:
        return False
    i = next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), len(x))
    return x[i + (len(x) == len(y)) :] == y[i + 1 :]


def near_in_cell(words: list[tuple[str, int]], size: int, across: bool, first_half: bool):
    """words: (word, slice). Yields the numbers of near words whose shorter one has ``size`` code points; of different slices
    only if ``across``; without those that share a first half too, if the cell is of second halves."""
    numbers: dict[str, int] = {}
    grams = []
    postings: dict[int, list[int]] = {}
    for k, (word, _) in enumerate(words):
        padded = f"\0{word}\0"
        # Positions next to each other are numbers next to each other.
        at = [(numbers.setdefault(padded[p : p + 2], len(numbers)) << 32) + p + 1 for p in range(len(word) + 1)]
        grams.append(frozenset(at))
        for g in at:
            postings.setdefault(g, []).append(k)
    half = size // 2
    for k, (word, part) in enumerate(words):
        if len(word) != size:
            continue
        lists = sorted(((found, g) for g in grams[k] if (found := [postings[x] for x in (g - 1, g, g + 1) if x in postings])), key=lambda e: sum(map(len, e[0])))
        rare, rest = lists[:3], [g for _, g in lists[3:]]
        for other, hits in groupby(heapq.merge(*(p for found, _ in rare for p in found))):
            word2, part2 = words[other]
            # Both of the shorter length would meet twice: the later one is the partner.
            if (len(word2) == size and other <= k) or (across and part == part2):
                continue
            mine = grams[other]
            bound = max(size, len(word2)) - 1
            shared = min(sum(1 for _ in hits), 3) + sum(1 for g in rest if g in mine or g - 1 in mine or g + 1 in mine)
            if shared >= bound and (first_half or word[:half] != word2[:half]) and one_edit(word, word2):
                yield k, other


def near_words(words: DataFrame, cell: int = CELL, shortest: int = SHORTEST) -> DataFrame:
    """words: word (distinct, at least ``shortest`` code points), n. Returns word, near, near_n: each near pair in both orders."""
    size = F.length("word")
    halves = F.array(
        *[F.struct(F.lit(first).alias("first"), (size - F.lit(less)).alias("size"), F.when(size - less >= shortest, half(less)).alias("part")) for less in (0, 1) for first, half in ((True, _first), (False, _second))]
    )
    keyed = words.select("word", "n", F.explode(halves).alias("h")).select("word", "n", "h.*").where("part is not null")
    keys = ["first", "size", "part"]
    slices = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    slices = slices.select(*keys, F.ceil(F.col("members") / cell).cast("int").alias("slices"))
    own = keyed.join(slices, keys).withColumn("own", F.pmod(F.xxhash64("word"), F.col("slices")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    cells = dealt.groupBy(*keys, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list(F.struct("word", "own", "n")).alias("members"))
    cells = cells.select("first", "size", (F.col("i") != F.col("j")).alias("across"), "members")

    def search(batches):
        for batch in batches:
            out: tuple[list, list, list] = [], [], []
            for first, length, across, members in zip(*(batch.column(c) for c in ("first", "size", "across", "members")), strict=True):
                rows = [(m["word"], m["own"], m["n"]) for m in members.as_py()]
                for a, b in near_in_cell([r[:2] for r in rows], length.as_py(), across.as_py(), first.as_py()):
                    for x, y in ((a, b), (b, a)):
                        for col, v in zip(out, (rows[x][0], rows[y][0], rows[y][2]), strict=True):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int64()), strict=True)], ["word", "near", "near_n"])

    return cells.mapInArrow(search, "word string, near string, near_n long")


def _first(less: int) -> Column:
    return F.substring("word", F.lit(1), ((F.length("word") - less) / 2).cast("int"))


def _second(less: int) -> Column:
    """What follows the shorter word's first half, counted from the end."""
    kept = F.length("word") - less - ((F.length("word") - less) / 2).cast("int")
    return F.substring("word", F.length("word") - kept + 1, kept)


def follow(forms: DataFrame) -> DataFrame:
    """forms: word, form, without circles. Returns word, root: the last form of each chain, by pointer jumping."""
    links = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = cut(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if links.where("moved").isEmpty():
            return links.drop("moved")
        links = links.drop("moved")


def variants(words: DataFrame, ratio: int = RATIO, cell: int = CELL) -> DataFrame:
    """words: word (distinct), n. Returns word, form, root, n, n_near, form_n."""
    words = cut(words.select("word", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    near = near_words(words, cell).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    takes = -F.col("best.n") >= ratio * F.col("n")
    found = cut(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best.word")).alias("form"), F.when(takes, -F.col("best.n")).alias("form_n")
        )
    )
    roots = follow(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def count_words(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST, slip: int = SLIP) -> DataFrame:
    """docs: doc_id, text. Returns word, n. One run in about ``slip`` loses a code point, by the checksum of id and run."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % slip == 0, slipped).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= fewest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(count_words(table(spark, sf_dir, "documents").select("doc_id", "text")))
