"""Constrained single linkage: threads of documents.

Every merge needs a distance under the small threshold, so documents share a thread only within a component of the graph
of pairs under it. Components are found by joins; the greedy loop with size and source limits runs inside each one. The
loop's budget of one round fewer than rows, of which refused merges take their share, is shared by all components of a
chunk: their logs of rounds are merged in the order of the whole loop, and rounds beyond the budget are taken back.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EN_CLUSTERING, ClusteringConfig
from ..storage import cut
from .components import connected_components
from .order import position
from .pairs import cosine_pairs, near_components


def size_allows(size: int, distance: float, cfg: ClusteringConfig) -> bool:
    if size <= cfg.small_size:
        return True
    if size <= cfg.medium_size:
        return distance <= np.float32(cfg.medium_threshold)
    return size <= cfg.large_size and distance <= np.float32(cfg.large_threshold)


#: Bytes that the loop needs for an edge in its maps, measured; and for a pair of rows in its matrix.
EDGE_BYTES, PAIR_BYTES = 440, 4


def link(n: int, edges, sites: list[str], cfg: ClusteringConfig, budget: int | None = None, dense: bool | None = None) -> list[tuple[float, int, int, bool]]:
    """The loop over ``n`` rows and the distances under the small threshold, (row, other row, distance) each or three arrays:
    its log of (distance, row, other row, merged). The nearest pair, by distance and then rows, is merged or, if the limits
    forbid it, dropped; a merged row has the least distances of both. Pairs beyond the threshold never come up.

    Few edges are kept in maps with a heap, many in a matrix with each row's nearest neighbour: what takes less memory, so a chunk of c rows
    never takes more than 4 c**2 bytes (``dense`` forces the one or the other).
    """
    i, j, x = edges if isinstance(edges, tuple) else (np.array(e) for e in zip(*edges, strict=True)) if edges else (np.zeros(0),) * 3
    i, j, x = np.asarray(i, np.int32), np.asarray(j, np.int32), np.asarray(x, np.float32)
    use = (i != j) & (x <= np.float32(cfg.small_threshold))
    if not use.all():
        i, j, x = i[use], j[use], x[use]
    size, names, log = [1] * n, [{s} for s in sites], []

    def decide(at: float, i: int, j: int) -> bool:
        fits = size_allows(size[i] + size[j], at, cfg) and not (cfg.ban_same_sites and names[i] & names[j])
        log.append((at, i, j, fits))
        if fits:
            size[i] += size[j]
            names[i] |= names[j]
        return fits

    if dense is None:
        dense = EDGE_BYTES * len(x) > PAIR_BYTES * n * n
    (_by_matrix if dense else _by_maps)(n, i, j, x, decide, budget, log)
    return log


def _by_maps(n, rows, others, dist, decide, budget, log):
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, x in zip(rows.tolist(), others.tolist(), dist.tolist(), strict=True):
        near[i][j] = near[j][i] = min(x, near[i].get(j, x))
    heap = [(x, i, j) for i in range(n) for j, x in near[i].items() if i < j]
    heapq.heapify(heap)
    while heap and (budget is None or len(log) < budget):
        at, i, j = heapq.heappop(heap)
        if near[i].get(j) != at:  # merged away, dropped, or nearer by now
            continue
        del near[i][j], near[j][i]
        if decide(at, i, j):
            for k, x in near[j].items():
                del near[k][j]
                if x < near[i].get(k, np.inf):
                    near[i][k] = near[k][i] = x
                    heapq.heappush(heap, (x, min(i, k), max(i, k)))
            near[j] = {}


def _by_matrix(n, rows, others, dist, decide, budget, log):
    d = np.full((n, n), np.inf, np.float32)
    np.minimum.at(d, (rows, others), dist)
    np.minimum.at(d, (others, rows), dist)
    # Of each row: the nearest later row, the first of equal ones, and its distance.
    nearest, at = np.zeros(n, np.int64), np.full(n, np.inf, np.float32)

    def look(k: int):
        if k + 1 < n:
            nearest[k] = k + 1 + np.argmin(d[k, k + 1 :])
            at[k] = d[k, nearest[k]]

    for k in range(n):
        look(k)
    while budget is None or len(log) < budget:
        i = int(np.argmin(at))
        if at[i] == np.inf:
            return
        j, x = int(nearest[i]), float(at[i])
        d[i, j] = d[j, i] = np.inf
        if not decide(x, i, j):
            look(i)
            continue
        np.minimum(d[i], d[j], out=d[i])
        d[i, i] = np.inf
        d[:, i] = d[i]
        d[j] = d[:, j] = np.inf
        at[j] = np.inf
        look(i)
        # Rows before i may have come nearer to it; those between i and j that j was nearest to look anew.
        ahead = d[:i, i]
        nearer = (ahead < at[:i]) | ((ahead == at[:i]) & (ahead < np.inf) & (i < nearest[:i]))
        nearest[:i][nearer] = i
        at[:i][nearer] = ahead[nearer]
        for k in np.flatnonzero(nearest[i + 1 : j] == j).tolist():
            look(i + 1 + k)


def replay(logs: dict, budget: int | None) -> list[tuple]:
    """Merge component logs as one loop would have run them: by distance, then row. Returns the merges within the budget
    as (component, row, other row)."""
    heads = [(log[0][0], log[0][1], c, 0) for c, log in logs.items() if log]
    heapq.heapify(heads)
    done, out = 0, []
    while heads and (budget is None or done < budget):
        _, _, c, k = heapq.heappop(heads)
        _, i, j, merged = logs[c][k]
        done += 1
        if merged:
            out.append((c, i, j))
        if k + 1 < len(logs[c]):
            heapq.heappush(heads, (logs[c][k + 1][0], logs[c][k + 1][1], c, k + 1))
    return out


def components(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    i, j, label = at[: len(i)], at[len(i) :], np.arange(len(nodes))
    while True:
        least = np.minimum(label[i], label[j])
        if np.array_equal(label[i], least) and np.array_equal(label[j], least):
            return nodes, nodes[label]
        # To the labels of both ends, then along the labels.
        for end in (label[i], label[j], i, j):
            np.minimum.at(label, end, least)
        while not np.array_equal(label, label[label]):
            label = label[label]


def _chunk_components(lists: pa.Table) -> pa.Table:
    i = np.repeat(lists["at"].to_numpy(), pc.list_value_length(lists["others"]).to_numpy())
    nodes, least = components(i, pc.list_flatten(lists["others"]).to_numpy())
    return pa.table({c: pa.repeat(lists[c][0], len(nodes)) for c in ("lang", "chunk")} | {"at": pa.array(nodes.astype(np.int32)), "comp": pa.array(least.astype(np.int32))})


def threads(docs: DataFrame, cfg: ClusteringConfig = EN_CLUSTERING, order: tuple = ("fetch_time", "file_name")) -> DataFrame:
    """docs: lang, file_name, site_name, fetch_time, vector. Returns lang, file_name, seq (newest first), thread_id (the
    least seq of the thread's documents).

    A chunk holds ``chunk_size`` rows by seq and overlaps the next; threads of chunks that share a document are one.
    """
    base = position(docs.select("lang", "file_name", "site_name", "fetch_time", "vector"), ("lang",), [F.col(c).desc() for c in order], "seq")
    step = max(1, cfg.chunk_size - cfg.chunk_overlap)
    first = F.greatest(F.ceil((F.col("seq") - cfg.chunk_size + 1) / step), F.lit(0)).cast("int")
    # The first chunk that reaches a language's end is its last. A row for each language, written, so that its size is known.
    last = F.greatest(F.ceil((F.max("seq") + 1 - cfg.chunk_size) / step), F.lit(0)).cast("int")
    ends = cut(base.groupBy("lang").agg(last.alias("_end"))).withColumnRenamed("lang", "_lang")
    within = base.join(ends, F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang")
    chunks = F.sequence(first, F.least(F.floor(F.col("seq") / step).cast("int"), F.col("_end")))
    dealt = within.withColumn("chunk", F.explode(chunks)).drop("_end").withColumn("id", F.concat_ws("/", "chunk", "seq", "lang"))
    part = lambda c, k: F.get(F.split(c, "/", 3), F.lit(k))
    own = [part("a", 2).alias("lang"), part("a", 0).cast("int").alias("chunk"), part("a", 1).cast("long")]
    if free(cfg) and not cfg.time_penalty:
        comps = near_components(dealt, cfg.small_threshold, "id", ("lang", "chunk"), single=True).withColumnRenamed("id", "a")
        return _labelled(base, comps.select(own[0], own[2].alias("i"), part("comp", 1).cast("long").alias("j")))
    # A row for each document and block, so that a crowd of near documents makes no row for each pair.
    lists = cosine_pairs(dealt, cfg.small_threshold, "id", ("lang", "chunk"), forest="mark", single=True, lists=True)
    lists = lists.select(*own[:2], own[2].alias("seq"), "others", "dists", "trees")
    # Within a chunk, rows are named by their place in it: a small number for each end of an edge.
    place = lambda seq: (seq - F.col("chunk") * step).cast("int")
    lists = lists.withColumn("others", F.transform("others", lambda o: place(part(o, 1).cast("long"))))
    if cfg.time_penalty:
        edges = lists.select("lang", "chunk", F.col("seq").alias("i"), F.explode(F.arrays_zip("others", "dists")).alias("e")).select("lang", "chunk", "i", (F.col("e.others") + F.col("chunk").cast("long") * step).alias("j"), F.col("e.dists").alias("dist"))
        times = base.select("lang", "seq", "fetch_time")
        edges = edges.join(times.select("lang", F.col("seq").alias("i"), F.col("fetch_time").alias("_ti")), ["lang", "i"]).join(times.select("lang", F.col("seq").alias("j"), F.col("fetch_time").alias("_tj")), ["lang", "j"])
        hours = F.abs(F.col("_ti") - F.col("_tj")) / 3600.0
        edges = edges.withColumn("dist", F.least(F.col("dist") * F.when(hours >= 24, hours / 24).otherwise(1.0), F.lit(1.0)).cast("float"))
        edges = edges.where(F.col("dist") <= F.lit(cfg.small_threshold).cast("float"))
        # The penalty may have cut pairs of the blocks' forests, so all that are left count.
        lists = edges.groupBy("lang", "chunk", F.col("i").alias("seq")).agg(F.collect_list(F.struct("j", "dist")).alias("e"))
        lists = lists.select("lang", "chunk", "seq", F.transform("e", lambda e: place(e["j"])).alias("others"), F.transform("e", lambda e: e["dist"]).alias("dists"), F.transform("e", lambda e: F.lit(True)).alias("trees"))
    lists = cut(lists)
    # Pairs of the blocks' forests connect what all pairs do. A chunk's are bounded by the configuration: one task's arrays.
    forests = lists.select("lang", "chunk", place(F.col("seq")).alias("at"), F.transform(F.filter(F.arrays_zip("others", "trees"), lambda e: e["trees"]), lambda e: e["others"]).alias("others"))
    comps = forests.groupBy("lang", "chunk").applyInArrow(_chunk_components, "lang string, chunk int, at int, comp int")
    comps = comps.select("lang", "chunk", (F.col("at") + F.col("chunk").cast("long") * step).alias("seq"), "comp")
    sizes = cut(dealt.groupBy("lang", "chunk").agg(F.count("*").alias("n")))
    near = lists.groupBy("lang", "chunk", "seq").agg(F.flatten(F.collect_list("others")).alias("others"), F.flatten(F.collect_list("dists")).alias("dists"))
    inside = dealt.select("lang", "chunk", "seq", "site_name").join(comps, ["lang", "chunk", "seq"])
    rows = inside.join(near, ["lang", "chunk", "seq"], "left").join(sizes, ["lang", "chunk"])

    def solve(own: pa.Table) -> pa.Table:
        """One component of a chunk: a row for each document, with its edges to later ones as lists."""
        own = own.sort_by("seq").combine_chunks()
        seqs = own["seq"].to_numpy()
        lengths = pc.fill_null(pc.list_value_length(own["others"]), 0).to_numpy()
        i = np.repeat(np.arange(len(seqs), dtype=np.int32), lengths)
        j = np.searchsorted(seqs - own["chunk"][0].as_py() * step, pc.list_flatten(own["others"]).to_numpy()).astype(np.int32)
        # No component can use more rounds than its chunk has.
        budget = own["n"][0].as_py() - 1 if cfg.budget == "reference" else None
        log = link(len(seqs), (i, j, pc.list_flatten(own["dists"]).to_numpy()), own["site_name"].to_pylist(), cfg, budget)
        same = {c: pa.repeat(own[c][0], len(log)) for c in ("lang", "chunk", "comp")}
        at = np.array([e[1:3] for e in log], np.int64).reshape(-1, 2)
        return pa.table(same | {"k": pa.array(range(len(log)), pa.int32()), "dist": pa.array([e[0] for e in log], pa.float64()), "i": pa.array(seqs[at[:, 0]]), "j": pa.array(seqs[at[:, 1]]), "merged": pa.array([e[3] for e in log], pa.bool_())})

    logs = cut(rows.groupBy("lang", "chunk", "comp").applyInArrow(solve, "lang string, chunk int, comp int, k int, dist double, i long, j long, merged boolean"))

    def within(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["comp", "k"])
        grouped = {c: [(r.dist, r.i, r.j, r.merged) for r in g.itertuples()] for c, g in pdf.groupby("comp")}
        kept = replay(grouped, int(pdf["n"].iloc[0]) - 1)
        return pd.DataFrame([(key[0], i, j) for _, i, j in kept], columns=["lang", "i", "j"])

    if cfg.budget == "reference":
        # A chunk's logs hold about as many rows as the chunk, which the configuration bounds.
        merges = logs.join(sizes, ["lang", "chunk"]).groupBy("lang", "chunk").applyInPandas(within, "lang string, i long, j long")
    else:
        merges = logs.where("merged").select("lang", "i", "j")
    return _labelled(base, merges)


def link_components(docs: DataFrame, cfg: ClusteringConfig = EN_CLUSTERING) -> DataFrame:
    """docs: file_name, lang, site_name, fetch_time, vector. Returns file_name, comp, thread: the least file name of its component, by pairs under
    the small threshold, and of its thread. Without chunks and a shared budget, so each component is linked apart; where nothing limits merges, the
    components are the threads and no pairs are asked for."""
    if unlimited(cfg):
        threads = near_components(docs, cfg.small_threshold, "file_name", ("lang",), single=True).withColumn("thread", F.col("comp"))
    else:
        edges = cosine_pairs(docs, cfg.small_threshold, "file_name", ("lang",), single=True)
        edges = cut(edges.select("a", "b", F.col("dist").cast("float").alias("dist")))
        comps = connected_components(edges.select("a", "b")).select(F.col("key").alias("file_name"), "comp")
        near = edges.groupBy(F.col("a").alias("file_name")).agg(F.collect_list("b").alias("others"), F.collect_list("dist").alias("dists"))
        rows = docs.select("file_name", "site_name", "fetch_time").join(comps, "file_name").join(near, "file_name", "left")

        def solve(own: pa.Table) -> pa.Table:
            # Newest first, as the loop numbers its rows.
            own = own.sort_by([("fetch_time", "descending"), ("file_name", "descending")]).combine_chunks()
            names = own["file_name"].to_pylist()
            at = {n: k for k, n in enumerate(names)}
            lengths = pc.fill_null(pc.list_value_length(own["others"]), 0).to_numpy()
            j = np.array([at[n] for n in pc.list_flatten(own["others"]).to_pylist()], np.int32)
            i = np.repeat(np.arange(len(names), dtype=np.int32), lengths)
            label = list(range(len(names)))
            for _, x, y, merged in link(len(names), (i, j, pc.list_flatten(own["dists"]).to_numpy()), own["site_name"].to_pylist(), cfg):
                if merged:
                    label[y] = x

            def root(k):
                while label[k] != k:
                    k = label[k] = label[label[k]]
                return k

            least: dict[int, str] = {}
            for k, n in enumerate(names):
                least[root(k)] = min(n, least.get(root(k), n))
            return pa.table({"file_name": own["file_name"], "comp": own["comp"], "thread": pa.array([least[root(k)] for k in range(len(names))], pa.string())})

        threads = rows.groupBy("comp").applyInArrow(solve, "file_name string, comp string, thread string")
    return docs.select("file_name").join(threads, "file_name", "left").select("file_name", F.coalesce("comp", "file_name").alias("comp"), F.coalesce("thread", "file_name").alias("thread"))


def unlimited(cfg: ClusteringConfig) -> bool:
    """Whether nothing limits merges, however many documents there are."""
    return cfg.budget == "unbounded" and not cfg.ban_same_sites and cfg.small_size >= 10**9


def free(cfg: ClusteringConfig) -> bool:
    """Whether nothing limits merges: then threads are the components, and no group goes through the loop."""
    return cfg.budget == "unbounded" and not cfg.ban_same_sites and cfg.small_size >= cfg.chunk_size


def _labelled(base: DataFrame, merges: DataFrame) -> DataFrame:
    joined = connected_components(merges.select(F.struct("lang", F.col("i").alias("seq")).alias("a"), F.struct("lang", F.col("j").alias("seq")).alias("b")))
    labels = joined.select(F.col("key.lang").alias("lang"), F.col("key.seq").alias("seq"), F.col("comp.seq").alias("_t"))
    return base.select("lang", "file_name", "seq").join(labels, ["lang", "seq"], "left").select("lang", "file_name", "seq", F.coalesce("_t", "seq").alias("thread_id"))
