"""Pairs of documents under a distance threshold, looked for where they can be.

A large group of rows is cut into cells around pivots: each row belongs to its nearest one. By the triangle inequality over
chord lengths a row has near rows in another cell only if it lies within the threshold of that cell's ball; and, the space
being Euclidean, only if it lies within the threshold of the plane half way between the two pivots. A row is sent to the
cells that are left, so far cells never meet and no pair is lost. Large cells are cut by hash into blocks, and each pair of
blocks is compared apart, so no task holds a cell. Where nothing can be ruled out, each row travels once for each block of its group, so blocks grow
with the group up to ``BLOCK`` rows; a task compares its two blocks in tiles and gives out the pairs of each tile as it goes.
What is asked of a pair, columns of both rows or further distances, is made there, so no pair is joined with its rows again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .components import connected_components

#: Pivots of a group at most: a task holds them beside one block.
PIVOTS = 256
#: Added to every bound for the rounding of distances, so that none cuts a pair off.
SLACK = 1e-5
#: Blocks of a cell at most, to name them by one number.
_BLOCKS = 1 << 20
#: Rows of a block: as many as make about ``MANY`` blocks of a group, from ``TILE`` to ``BLOCK``. A task compares ``TILE`` rows with as many at once.
BLOCK, MANY, TILE = 16384, 16, 1024


def matrix(vectors) -> np.ndarray:
    """An Arrow column of equally long lists as rows."""
    return pc.list_flatten(vectors).to_numpy().astype(np.float64).reshape(len(vectors), -1)


def unit_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows divided by their lengths, and which have one; the others are zero."""
    norm = np.linalg.norm(x, axis=1)
    return np.where(norm[:, None] > 1e-8, x / np.maximum(norm, 1e-8)[:, None], 0), norm > 1e-8


def _block(count, block: int | None):
    """Rows of a block in a group of so many rows."""
    return F.lit(block) if block else F.greatest(F.lit(TILE), F.least(F.ceil(count / MANY), F.lit(BLOCK))).cast("int")


def _tiles(rows: np.ndarray) -> list[np.ndarray]:
    return np.array_split(rows, -(-len(rows) // TILE)) if len(rows) else []


class _Near:
    """Rows to be compared with each other: which of them are near, and how far apart they are."""

    def __init__(self, x: np.ndarray, threshold: float, single: bool = False):
        (self.x, self.has), self.threshold, self.single = unit_rows(x), threshold, single
        self.rough = self.x.astype(np.float32)
        # Rounding of the rough products.
        self.slack = np.float32((x.shape[1] + 8) * 2.0**-22)

    def dist(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Of the pairs (p[k], q[k])."""
        parts = [np.einsum("ij,ij->i", self.x[p[k : k + (1 << 16)]], self.x[q[k : k + (1 << 16)]]) for k in range(0, len(p), 1 << 16)]
        return np.where(self.has[p] & self.has[q], np.maximum(1 - (np.concatenate([*parts, np.zeros(0)]) + 1) / 2, 0), 1)

    def tile(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Which rows of p are near which of q, all with a length: products in single precision, taken again in double precision where they are about the threshold."""
        s, limit = self.rough[p] @ self.rough[q].T, np.float32(1 - 2 * self.threshold)
        near = s >= limit - self.slack
        if near.any():
            i, j = np.nonzero(near)
            unsure = s[i, j] < limit + self.slack
            i, j = i[unsure], j[unsure]
            d = self.dist(p[i], q[j])
            near[i, j] = d.astype(np.float32) <= np.float32(self.threshold) if self.single else d <= self.threshold
        return near

    def links(self, first: np.ndarray, second: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Near rows (p[k], q[k]), p of first and q of second, that connect what all near ones do. Rows of a label are connected already, so they are not
        compared; labels are joined as pairs are found. label: a number below its length for each row."""
        found, same = [], first is second
        for m, a in enumerate(_tiles(first)):
            for n, b in enumerate(_tiles(second)):
                if same and m > n:
                    continue
                most = np.bincount(label[np.concatenate([a, b])]).argmax()
                main, rest, others = a[label[a] == most], a[label[a] != most], b[label[b] != most]
                for p, q in ((rest, b), (main, others)):
                    if not (len(p) and len(q)):
                        continue
                    i, j = np.nonzero(spanning(self.tile(p, q) & (label[p][:, None] != label[q][None])))
                    kept = _join(label, p[i], q[j])
                    found.append((p[i[kept]], q[j[kept]]))
        return tuple(np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in (0, 1))


def _join(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> list[int]:
    """Join the labels of rows p[k] and q[k]. Returns the k that joined two."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    kept = []
    for k, (a, b) in enumerate(zip(label[p].tolist(), label[q].tolist(), strict=True)):
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
            kept.append(k)
    if up:
        to = np.arange(len(label))
        for x in up:
            to[x] = root(x)
        label[:] = to[label]
    return kept


def spanning(near: np.ndarray) -> np.ndarray:
    """near: which rows of one side are near which of the other. As many of these pairs as connect what all of them connect."""
    tree = np.zeros_like(near)
    left, right = near.any(axis=1), near.any(axis=0)
    for start in np.flatnonzero(left).tolist():
        todo, left[start] = ([start] if left[start] else []), False
        while todo:
            i = todo.pop()
            fresh = np.flatnonzero(near[i] & right)
            right[fresh] = False
            tree[i, fresh] = True
            for j in fresh.tolist():
                more = np.flatnonzero(near[:, j] & left)
                left[more] = False
                tree[more, j] = True
                todo += more.tolist()
    return tree


def _pivots(base: DataFrame, counts: DataFrame) -> DataFrame:
    """g, _n, k, v: for each group about as many pivots as it has blocks, drawn by hash (a group may get none)."""
    h = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30))
    rate = F.least(2.0 * F.col("_p") / F.col("_c"), F.lit(1.0)) * float(1 << 30)
    drawn = base.join(counts.withColumn("_p", F.least("_n", F.lit(PIVOTS))), "g").withColumn("_h", h).where(F.col("_h") < rate)
    listed = drawn.groupBy("g", "_n").agg(F.slice(F.array_sort(F.collect_list(F.struct("_h", "id", "v"))), F.lit(1), F.least(F.first("_p"), F.lit(PIVOTS))).alias("_l"))
    # Written: all rows have to agree on them.
    return cut(listed.select("g", "_n", F.posexplode("_l").alias("k", "_e")).select("g", "_n", "k", F.col("_e.v").alias("v")))


def _counts(base: DataFrame, block: int | None) -> DataFrame:
    """g, _c, _s, _n: rows of each group, of a block of it, and its blocks. Tables of one row a group are written: joins then know
    their sizes, and Spark broadcasts them or splits a hot group."""
    sized = base.groupBy("g").agg(F.count(F.lit(1)).alias("_c")).withColumn("_s", _block(F.col("_c"), block))
    return cut(sized.withColumn("_n", F.ceil(F.col("_c") / F.col("_s")).cast("int")))


def deal(base: DataFrame, threshold: float, block: int | None = None) -> DataFrame:
    """base: g, id, v and what goes with a row. Returns g, i, j, blk and these: each row once for each pair (i, j) of blocks that has to be compared, with its own
    block, which is one of them. Blocks have 1.5 ``block`` rows at most."""
    own = [c for c in base.columns if c != "g"]
    base = cut(base)
    counts = _counts(base, block)
    if (counts.agg(F.max("_n")).first()[0] or 0) <= 1:
        return base.select("g", *[F.lit(0).cast("long").alias(c) for c in ("i", "j", "blk")], *own)
    reach, types = 2 * threshold**0.5 + SLACK, dict(base.dtypes)
    pivots = _pivots(base, counts)
    beside = pivots.select("g", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_b"), "k", *[F.col("v") if c == "v" else F.lit(None).cast(types[c]).alias(c) for c in own])
    rows = base.join(counts, "g").select("g", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int").alias("_b"), F.lit(None).cast("int").alias("k"), *own)

    def place(t: pa.Table) -> pa.Table:
        """A block of a group, with the group's pivots beside it."""
        mine = t.filter(pc.is_null(t["k"]))
        pivots = t.filter(pc.is_valid(t["k"])).sort_by("k")
        n = len(mine)
        cell, far, meets, d2 = np.zeros(n, np.int32), np.zeros(n), np.ones((n, 1), bool), np.zeros((n, 1))
        if len(pivots) and n:
            x, p = unit_rows(matrix(mine["v"]))[0], unit_rows(matrix(pivots["v"]))[0]
            d2 = np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * x @ p.T, 0)
            gap = np.sqrt(np.maximum((p * p).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * p @ p.T, 0))
            cell = d2.argmin(axis=1).astype(np.int32)
            own_d2 = d2[np.arange(n), cell]
            far = np.sqrt(own_d2)
            meets = d2 - own_d2[:, None] <= 2 * gap[cell] * reach + SLACK
            meets[np.arange(n), cell] = True
        at = pa.array(np.concatenate([[0], np.cumsum(meets.sum(axis=1))]).astype(np.int32))
        cells = pa.StructArray.from_arrays([pa.array(np.nonzero(meets)[1].astype(np.int32)), pa.array(np.sqrt(d2[meets]).astype(np.float32))], ["cell", "far"])
        return pa.table({c: mine[c] for c in ("g", *own)} | {"cell": pa.array(cell), "far": pa.array(far), "at": pa.ListArray.from_arrays(at, cells)})

    schema = ", ".join(f"{c} {types[c]}" for c in ("g", *own))
    placed = cut(rows.unionByName(beside).groupBy("g", "_b").applyInArrow(place, f"{schema}, cell int, far double, at array<struct<cell:int,far:float>>"))
    # A little more or less than a block in a cell does not make another one.
    parts = lambda n: F.greatest(F.round(n / F.col("_s")), F.lit(1)).cast("int")
    balls = placed.groupBy("g", "cell").agg(F.max("far").alias("r"), F.count(F.lit(1)).alias("n")).join(counts, "g").withColumn("n", parts(F.col("n")))
    balls = cut(balls.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("cell", F.struct("r", "n")))).alias("_balls")))
    there = F.filter(F.transform("at", lambda a: F.struct(a["cell"].alias("cell"), a["far"].alias("far"), F.try_element_at("_balls", a["cell"]).alias("b"))), lambda a: a["b"].isNotNull() & ((a["cell"] == F.col("cell")) | (a["far"] <= a["b"]["r"] + reach)))
    name = lambda c, q: c.cast("long") * _BLOCKS + q
    others = F.flatten(F.transform(there, lambda a: F.transform(F.sequence(F.lit(0), a["b"]["n"] - 1), lambda q: name(a["cell"], q))))
    blk = name(F.col("cell"), F.pmod(F.xxhash64("id", F.lit(11)), F.element_at("_balls", F.col("cell"))["n"]))
    met = placed.join(balls, "g").select("g", blk.alias("blk"), F.explode(others).alias("_o"), *own)
    return met.select("g", F.least("blk", "_o").alias("i"), F.greatest("blk", "_o").alias("j"), "blk", *own)


def _keyed(docs: DataFrame, key: str, group: tuple, carry: tuple = ()) -> DataFrame:
    return docs.select(F.xxhash64(F.struct(*group) if group else F.lit(0)).alias("g"), F.col(key).alias("id"), F.transform("vector", lambda x: x.cast("float")).alias("v"), *[F.col(c).alias(f"c_{c}") for c in carry])


def cosine_pairs(docs: DataFrame, threshold: float, key: str = "id", group: tuple = (), block: int | None = None, forest: str | None = None, single: bool = False, lists: bool = False, carry: tuple = (), heads: tuple = ()) -> DataFrame:
    """Pairs within ``group`` (all rows without one) whose (1 - cosine) / 2 is at most the threshold, below 1: a, b, dist; a < b.

    With ``forest`` "mark" there is also ``tree``: whether the pair is one of those that connect what all pairs of its two tiles
    connect; with "only", just these come, so that a crowd of near rows gives no square of them. ``single``: distances are
    compared in single precision. ``lists``: a row for each row and tile in place of each pair: a, others, dists, trees; then a may be the greater
    key. ``carry``: columns that each pair has of both its rows, as NAME_a and NAME_b. ``heads``: numbers of leading elements by which its
    distance is taken as well, as head_N. Vectors and heads without length are at distance 1.
    """
    base = _keyed(docs, key, group, carry)
    extra, types = ["tree"] if forest else [], dict(base.dtypes)
    id_type = types["id"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).combine_chunks()
        t = t.filter(pa.array(unit_rows(matrix(t["v"]))[1])).combine_chunks()
        if not len(t):
            return
        ids, blk, i, j = t["id"].combine_chunks(), t["blk"].to_numpy(), t["i"][0].as_py(), t["j"][0].as_py()
        x = matrix(t["v"])
        rows, parts = _Near(x, threshold, single), {n: _Near(x[:, :n], threshold) for n in heads}
        for m, a in enumerate(_tiles(np.flatnonzero(blk == i))):
            for n, b in enumerate(_tiles(np.flatnonzero(blk == j))):
                if i == j and m > n:
                    continue
                near = rows.tile(a, b)
                if i == j and m == n:
                    near = np.triu(near, 1)
                if not near.any():
                    continue
                tree = spanning(near) if forest else near
                p, q = np.nonzero(tree if forest == "only" else near)
                dist, tree = rows.dist(a[p], b[q]), tree[p, q]
                if lists:
                    starts, count = np.unique(p, return_counts=True)
                    at = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
                    made = (pa.ListArray.from_arrays(at, x) for x in (ids.take(pa.array(b[q])), pa.array(dist.astype(np.float32)), pa.array(tree)))
                    yield pa.RecordBatch.from_pydict(dict(zip(("a", "others", "dists", "trees"), (ids.take(pa.array(a[starts])), *made), strict=True)))
                    continue
                one, two = pa.array(a[p]), pa.array(b[q])
                swap = pc.greater(ids.take(one), ids.take(two))
                one, two = pc.if_else(swap, two, one), pc.if_else(swap, one, two)
                out = {"a": ids.take(one), "b": ids.take(two), "dist": pa.array(dist)} | {"tree": pa.array(tree) for _ in extra}
                out |= {f"{c}_{side}": t[f"c_{c}"].combine_chunks().take(at) for c in carry for side, at in (("a", one), ("b", two))}
                out |= {f"head_{n}": pa.array(part.dist(a[p], b[q])) for n, part in parts.items()}
                yield pa.RecordBatch.from_pydict(out)

    dealt = deal(base, threshold + 1e-6, block)
    if lists:
        return dealt.groupBy("g", "i", "j").applyInArrow(compare, f"a {id_type}, others array<{id_type}>, dists array<float>, trees array<boolean>")
    schema = f"a {id_type}, b {id_type}, dist double" + ", tree boolean" * len(extra) + "".join(f", {c}_{side} {types[f'c_{c}']}" for c in carry for side in "ab")
    schema += "".join(f", head_{n} double" for n in heads)
    return dealt.groupBy("g", "i", "j").applyInArrow(compare, schema)


def _drawn(base: DataFrame, counts: DataFrame) -> DataFrame:
    """About ``TILE`` rows of each group, by hash."""
    rate = F.least(TILE / F.col("_c"), F.lit(1.0)) * float(1 << 30)
    return base.join(counts, "g").where(F.pmod(F.xxhash64("id", F.lit(13)), F.lit(1 << 30)) < rate)


def _facing(one: DataFrame, two: DataFrame, block: int | None) -> DataFrame:
    """g, i, j, first, id, v: rows of groups that both sides have, cut into blocks by hash; each row once for each block of the other side."""
    sizes = lambda df, n: _counts(df, block).select("g", F.col("_n").alias(n))
    both = cut(sizes(one, "_n").join(sizes(two, "_m"), "g"))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = one.join(both, "g").select("g", own("_n").alias("i"), every("_m").alias("j"), F.lit(True).alias("first"), *[c for c in one.columns if c != "g"])
    b = two.join(both, "g").select("g", every("_n").alias("i"), own("_m").alias("j"), F.lit(False).alias("first"), *[c for c in two.columns if c != "g"])
    return a.unionByName(b, allowMissingColumns=True)


def near_components(docs: DataFrame, threshold: float, key: str = "id", group: tuple = (), block: int | None = None, single: bool = False) -> DataFrame:
    """key, comp: the components that the pairs of ``cosine_pairs`` make, by their least key; rows without a near one are left out.

    Rows are first compared within blocks by hash and with a few of their group, drawn. What that connects need not be compared again: of each group's
    largest component so far, rows meet only those outside of it. Where one component takes in nearly all, that is nearly
    all of the work; where there are many small ones, cells keep far rows apart. Tasks give out forests.
    """
    base = cut(_keyed(docs, key, group))
    counts = _counts(base, block)
    many = counts.where("_n > 1")
    id_type = dict(base.dtypes)["id"]
    schema = f"a {id_type}, b {id_type}"

    def connect(t: pa.Table, sides, known=None) -> pa.Table:
        """sides: of a table, the pairs of row sets to compare; known: which rows are in one component."""
        t = t.filter(pa.array(unit_rows(matrix(t["v"]))[1])).combine_chunks()
        if not len(t):
            return pa.table({"a": t["id"], "b": t["id"]})
        label = np.arange(len(t))
        if known is not None:
            own = known(t)
            label[own] = own[0] if len(own) else 0
        rows = _Near(matrix(t["v"]), threshold, single)
        p, q = (pa.array(np.concatenate(x)) for x in zip(*(rows.links(a, b, label) for a, b in sides(t)), strict=True))
        return pa.table({"a": t["id"].take(p), "b": t["id"].take(q)})

    at = lambda t, column, value=True: np.flatnonzero(t[column].to_numpy() == value)

    def inside(t: pa.Table) -> pa.Table:
        def sides(t):
            drawn, own = at(t, "first"), at(t, "first", False)
            return (drawn, own), (own, own)

        return connect(t, sides)

    def between(t: pa.Table) -> pa.Table:
        def sides(t):
            a, b = (at(t, "blk", t[c][0].as_py()) for c in ("i", "j"))
            return [(a, a if t["i"][0] == t["j"][0] else b)]

        return connect(t, sides)

    def across(t: pa.Table) -> pa.Table:
        return connect(t, lambda t: [(at(t, "first"), at(t, "first", False))], lambda t: at(t, "first", False))

    own = base.join(counts, "g").select("g", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int").alias("i"), F.lit(False).alias("first"), "id", "v")
    drawn = _drawn(base, many).select("g", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("i"), F.lit(True).alias("first"), "id", "v")
    labels = connected_components(own.unionByName(drawn).groupBy("g", "i").applyInArrow(inside, schema))
    if many.isEmpty():
        return labels.select(F.col("key").alias(key), "comp")
    known = base.join(many.select("g"), "g").join(labels, F.col("id") == F.col("key"), "left").select("g", "id", "v", F.coalesce("comp", "id").alias("comp"))
    known = cut(known)
    most = cut(known.groupBy("g", "comp").count().groupBy("g").agg(F.max_by("comp", F.struct("count", "comp")).alias("_most")))
    known = known.join(most, "g")
    rest = cut(known.where("comp <> _most").select("g", "id", "v"))
    main = known.where("comp = _most").select("g", "id", "v")
    more = deal(rest, threshold + 1e-6, block).groupBy("g", "i", "j").applyInArrow(between, schema)
    more = cut(more.unionByName(_facing(rest, main, block).groupBy("g", "i", "j").applyInArrow(across, schema)))
    alone = more.select(F.col("a").alias("key")).union(more.select("b")).distinct().join(labels, "key", "left_anti").select("key", F.col("key").alias("comp"))
    labels = cut(labels.unionByName(alone))
    to = lambda x: labels.select(F.col("key").alias(x), F.col("comp").alias(f"_{x}"))
    joined = connected_components(more.join(to("a"), "a").join(to("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    joined = joined.select(F.col("key").alias("comp"), F.col("comp").alias("_least"))
    return labels.join(joined, "comp", "left").select(F.col("key").alias(key), F.coalesce("_least", "comp").alias("comp"))


def near_any(left: DataFrame, right: DataFrame, threshold: float, key: str = "id", group: tuple = (), block: int | None = None, once: str | None = None) -> DataFrame:
    """Rows of ``right`` that have a row of ``left`` within the threshold in their ``group``: their keys, each once; compared in single
    precision. Both sides are cut into blocks by hash and each pair of blocks is compared apart; pairs never leave it.
    ``once``: a column of ``right`` whose values are asked for in place of the keys; those near a few drawn rows of ``left`` are not looked at again."""
    one, two = _keyed(left, key, group), _keyed(right, key, group, (once,) if once else ())
    name = f"c_{once}" if once else "id"

    def compare(t: pa.Table) -> pa.Table:
        t = t.filter(pa.array(unit_rows(matrix(t["v"]))[1])).combine_chunks()
        if not len(t):
            return t.select([name])
        first = t["first"].to_numpy()
        rows, found = _Near(matrix(t["v"]), threshold, True), [np.zeros(0, np.int64)]
        for q in _tiles(np.flatnonzero(~first)):
            for p in _tiles(np.flatnonzero(first)):
                near = rows.tile(q, p).any(axis=1)
                found.append(q[near])
                q = q[~near]
        return pa.table({name: pc.unique(t[name].take(pa.array(np.concatenate(found))))})

    def found(one: DataFrame, two: DataFrame) -> DataFrame:
        return _facing(one, two, block).groupBy("g", "i", "j").applyInArrow(compare, f"{name} {dict(two.dtypes)[name]}").distinct()

    if not once:
        return found(one, two).withColumnRenamed(name, key)
    one, two = cut(one), cut(two)
    counts = _counts(one, block)
    hit = cut(found(_drawn(one, counts).select("g", "id", "v"), two))
    if not counts.where(F.col("_c") > TILE).isEmpty():
        hit = hit.unionByName(found(one, two.join(hit, name, "left_anti"))).distinct()
    return hit.withColumnRenamed(name, once)
