"""LM scoring by a gated recurrent network with a class-factored softmax.

The network reads a document word by word and carries its state from the first word to the end mark, so that a score is
the log-likelihood of the complete text. Frequent words form classes by rank, small where counts are high
(``class_edges``), so that both softmaxes have few terms; a word's probability is that of its class times that within its class. All other words share one output, whose probability is split among them by
their smoothed corpus counts, with one share left for words never seen: a proper distribution over words. Training is by
truncated backpropagation in numpy.

Scale: token counts are summed over all training documents, combined in the tasks before they are shuffled. The ``head``
most frequent words' counts travel to the tasks (at most that many rows); the rest is joined, and no word of the rest is
frequent enough to make a hot key. The network starts from a fit on whole training documents of about ``sample_tokens``
tokens, at most twice as many, by one task. It then learns from all training documents, in ``ROUNDS`` rounds: each document is in one round and in
one of its shards by hash, a task learns from one shard in pieces of ``PIECE`` tokens, and the shards' weights are averaged by
tokens, in blocks. Shards grow with the square root of the tokens, as does their number, and the words that the network
tells apart grow with the power 0.4 of them, up to ``HEAD``, which binds beyond some 6e11 tokens. Scoring is one pass; documents of a batch run side by side, and a long one
alone costs steps, not memory.

Defined cases: null or empty text: the end mark alone. Words are the runs between ASCII blanks, A-Z lower-cased. Null
doc_id: crc32 of the empty text. No training documents: N, V and counts are 0, a text without known words scores by the
share of unseen words. Texts are read whole. Repeated rows are counted and scored each. Empty table: no rows. Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, cut, table

#: The end mark: a blank, so never a word.
END = b"\n"
SMOOTH = 0.1
HEAD = 200_000
CLASSES, SIZE = 48, 48
HIDDEN = 32
SAMPLE_TOKENS = 600_000
ROUNDS, SHARD, SHARD_ROOT, PIECE = 2, 3_000_000, 300, 600_000
EPOCHS, STREAMS, STEPS, RATE = 3, 64, 24, 0.01
WIDE = 256
FOLDS, HELD_OUT = 10, 0
_FLUSH = 300_000
_SIDE = 1024
_HELD = 2_000_000
_BLOCK = 8192
_COLUMNS = 2048
_CACHED = 16384
_RUN = 8
_SAFE = 60.0


def tokens_of(text: str | None) -> list[bytes]:
    """Words of a text. For bytes, lower() and split() know just A-Z and the six ASCII blanks."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _encoded(words: list[bytes], ids: dict[bytes, int], other: int = 1) -> np.ndarray:
    return np.fromiter(map(ids.get, words, repeat(other)), np.int64, len(words))


def _run_sums(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of runs of rows that begin at ``first``: short runs side by side, long ones each as a product with ones."""
    counts, out = np.diff(first, append=len(rows)), rows[first]
    live, ones = np.flatnonzero(counts <= _RUN), np.ones(len(rows), rows.dtype)
    for k in range(1, _RUN):
        live = live[counts[live] > k]
        out[live] += rows[first[live] + k]
    for i in np.flatnonzero(counts > _RUN):
        out[i] = ones[: counts[i]] @ rows[first[i] : first[i] + counts[i]]
    return out


class GatedNet:
    """Gated recurrent units over word ids, with class-factored output. Ids: 0 the end mark, 1 the rest, then by rank.
    ``edges``: where the classes begin and, last, the number of outputs; without, classes of equal size."""

    def __init__(self, hidden: int = HIDDEN, classes: int = CLASSES, size: int = SIZE, weights: dict | None = None, seed: int = 3, edges: np.ndarray | None = None):
        self.edges = np.arange(classes + 1) * size if edges is None else edges
        self.h, self.c = hidden, len(self.edges) - 1
        sizes = np.diff(self.edges)
        # 16-bit numbers are sorted by radix. A word that is a class by itself needs no second softmax.
        self.of, self.wide = np.repeat(np.arange(self.c), sizes).astype(np.uint16 if self.c < 1 << 16 else np.int64), sizes > 1
        if weights is None:
            rng = np.random.default_rng(seed)
            draw = lambda *n: (rng.standard_normal(n) * 0.1).astype(np.float32)
            weights = {"x": draw(classes * size, 3 * hidden), "u": draw(hidden, 3 * hidden), "wc": draw(hidden, self.c), "bc": np.zeros(self.c, np.float32), "ww": draw(classes, size, hidden), "bw": np.zeros((classes, size), np.float32)}
        self.w = weights

    def _gates(self) -> tuple[np.ndarray, ...]:
        """x and u by gates, each in one run of memory, and halved for the two sigmoids, which are made of tanh."""
        n, x, u = self.h, self.w["x"], self.w["u"]
        return x[:, : 2 * n] * np.float32(0.5), x[:, 2 * n :].copy(), u[:, : 2 * n] * np.float32(0.5), u[:, 2 * n :].copy()

    def step(self, ids: np.ndarray, state: np.ndarray, gates: tuple | None = None) -> np.ndarray:
        """The states after the ids. Gates are made in place: most of the time goes to passes over memory."""
        n, (xzr, xn, uzr, un) = self.h, gates or self._gates()
        zr = state @ uzr
        zr += xzr[ids]
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        new = state @ un
        new *= zr[:, n:]
        new += xn[ids]
        np.tanh(new, out=new)
        out = state - new
        out *= zr[:, :n]
        out += new
        return out

    def start(self, n: int) -> np.ndarray:
        """The state after an end mark, before a document's first word."""
        return self.step(np.zeros(n, np.int64), np.zeros((n, self.h), np.float32))

    def _by_class(self, ids: np.ndarray):
        """The order of ids by class, and the runs of classes with several words: class, from, to."""
        cls = self.of[ids]
        order = np.argsort(cls, kind="stable")
        edges = np.searchsorted(cls[order], np.arange(self.c + 1))
        return order, [(k, int(edges[k]), int(edges[k + 1])) for k in np.flatnonzero(self.wide & (edges[1:] > edges[:-1]))]

    def log_p(self, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural logs of the probabilities of ids after the states."""
        order, runs = self._by_class(ids)
        states, ids, got = np.ascontiguousarray(states[order].T), ids[order], np.empty(len(ids))
        cls, ww, bw = self.of[ids], self.w["ww"].reshape(-1, self.h), self.w["bw"].ravel()
        # In blocks of columns that stay in a core's cache.
        for at in range(0, len(ids), _COLUMNS):
            part = slice(at, at + _COLUMNS)
            a = self.w["wc"].T @ states[:, part]
            a += self.w["bc"][:, None]
            a -= a.max(axis=0)
            got[part] = a[cls[part], np.arange(a.shape[1])]
            got[part] -= np.log(np.exp(a, out=a).sum(axis=0))
        for k, lo, hi in runs:
            own = slice(self.edges[k], self.edges[k + 1])
            b = ww[own] @ states[:, lo:hi]
            b += bw[own, None]
            b -= b.max(axis=0)
            got[lo:hi] += b[ids[lo:hi] - self.edges[k], np.arange(hi - lo)]
            got[lo:hi] -= np.log(np.exp(b, out=b).sum(axis=0))
        out = np.empty(len(ids))
        out[order] = got
        return out

    def _loss(self, states, ids, grad):
        """Summed loss of states in columns, each in [-1, 1]; adds to grad and returns the states' gradient. A state's last
        row is 1 here, which makes biases a column of the weights."""
        order, runs = self._by_class(ids)
        n, ids, cls = len(ids), ids[order], self.of[ids[order]]
        states, rows = np.concatenate([np.take(states, order, axis=1), np.ones((1, n), states.dtype)]), np.arange(n)
        wc = np.concatenate([self.w["wc"], self.w["bc"][None]]).T
        ww = np.concatenate([self.w["ww"].reshape(-1, self.h), self.w["bw"].reshape(-1, 1)], axis=1)
        ones = np.ones(max(self.h + 1, len(ww)), states.dtype)
        # A softmax whose terms cannot overflow needs no maximum.
        safe_c, safe_w = (float((np.abs(w) @ ones[: self.h + 1]).max()) < _SAFE for w in (wc, ww))
        gc, gw, back, inner, hits = np.zeros_like(wc), np.zeros_like(ww), np.empty_like(states), np.zeros_like(states), np.ones((2, n), states.dtype)

        def errors(w, part, picked, safe, hits):
            p = w @ part
            if not safe:
                p -= p.max(axis=0)
            np.exp(p, out=p)
            p *= 1 / (ones[: len(p)] @ p)
            flat, at = p.ravel(), picked * p.shape[1] + rows[: p.shape[1]]
            hit = hits[:] = flat[at]
            flat[at] = hit - 1
            return p

        for at in range(0, n, _COLUMNS):
            part = slice(at, at + _COLUMNS)
            p = errors(wc, states[:, part], cls[part].astype(np.int64), safe_c, hits[0, part])
            gc += p @ states[:, part].T
            np.matmul(wc.T, p, out=back[:, part])
        place = ids - self.edges[cls]
        for k, lo, hi in runs:
            own, part = slice(self.edges[k], self.edges[k + 1]), slice(lo, hi)
            q = errors(ww[own], states[:, part], place[part], safe_w, hits[1, part])
            np.matmul(q, states[:, part].T, out=gw[own])
            np.matmul(ww[own].T, q, out=inner[:, part])
        back += inner
        grad["wc"] += gc[:, :-1].T
        grad["bc"] += gc[:, -1]
        grad["ww"] += gw[:, :-1].reshape(grad["ww"].shape)
        grad["bw"] += gw[:, -1].reshape(grad["bw"].shape)
        place[order] = rows
        return -float(np.log(hits).sum(dtype=np.float64)), np.take(back[:-1], place, axis=1)

    def _window(self, inputs: np.ndarray, targets: np.ndarray, state: np.ndarray):
        """Like ``window``, but the gradient of x has only the rows of the ids that occur: loss, gradients, those ids, state.
        Units come before streams within, so that each gate is one run of memory. What does not wait for a later step is
        worked out for all steps at once."""
        n, (steps, width) = self.h, inputs.shape
        grad = {k: np.zeros_like(v) for k, v in self.w.items() if k != "x"}
        u, live, ids = self.w["u"], (inputs != 0).astype(state.dtype), inputs.ravel()
        ut, state = np.ascontiguousarray(u.T), np.ascontiguousarray(state.T)
        ut[: 2 * n] *= 0.5
        g = np.ascontiguousarray(self.w["x"].take(ids, axis=0).reshape(steps, width, 3 * n).transpose(0, 2, 1))
        g[:, : 2 * n] *= 0.5
        before, out, rest, un = (np.empty((steps, n, width), state.dtype) for _ in range(4))
        for t in range(steps):
            np.multiply(state, live[t], out=before[t])
            a, zr, new = ut @ before[t], g[t, : 2 * n], g[t, 2 * n :]
            zr += a[: 2 * n]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            np.multiply(zr[n:], a[2 * n :], out=un[t])
            new += un[t]
            np.tanh(new, out=new)
            state = np.subtract(before[t], new, out=rest[t])
            state = np.multiply(state, zr[:n], out=out[t])
            state += new
        loss, back = self._loss(out.transpose(1, 0, 2).reshape(n, -1), targets.ravel(), grad)
        back = back.reshape(n, steps, width)
        z, r, new = g[:, :n], g[:, n : 2 * n], g[:, 2 * n :]
        keep = 1 - z
        rest *= z
        rest *= keep
        new *= new
        new *= keep
        keep -= new
        un *= 1 - r
        inner, gn = np.empty_like(g), np.empty_like(before)
        carried, d, gu = np.zeros_like(state), np.empty_like(state), np.zeros_like(ut)
        for t in range(steps - 1, -1, -1):
            np.add(back[:, t], carried, out=d)
            np.multiply(d, rest[t], out=inner[t, :n])
            np.multiply(d, keep[t], out=gn[t])
            np.multiply(gn[t], un[t], out=inner[t, n : 2 * n])
            np.multiply(gn[t], r[t], out=inner[t, 2 * n :])
            gu += inner[t] @ before[t].T
            np.matmul(u, inner[t], out=carried)
            d *= z[t]
            carried += d
            carried *= live[t]
        grad["u"] += gu.T
        order = np.argsort(ids.astype(np.uint16) if len(self.of) <= 1 << 16 else ids, kind="stable")
        ranked = ids[order]
        first = np.flatnonzero(np.diff(ranked, prepend=-1))
        inner[:, 2 * n :] = gn
        grad["x"] = _run_sums(inner.transpose(0, 2, 1).reshape(-1, 3 * n).take(order, axis=0), first)
        return loss, grad, ranked[first], np.ascontiguousarray(state.T)

    def window(self, inputs: np.ndarray, targets: np.ndarray, state: np.ndarray):
        """One truncated window, time by stream. An input of 0 begins a document and forgets. Returns loss, gradients, state."""
        loss, grad, ids, state = self._window(inputs, targets, state)
        whole = np.zeros_like(self.w["x"])
        whole[ids] = grad["x"]
        return loss, grad | {"x": whole}, state

    def _adam(self, name, rows, g, m, v, size, rate, scale):
        """Moves rows of a weight by ``size`` times the gradient g, which is used up. m and v are decaying sums of g and of
        its squares. In blocks that stay in a core's cache."""
        rate, eps, w = rate / math.sqrt(scale), 1e-5 / (size * math.sqrt(scale)), self.w[name]
        if rows is None:
            w, g, m, v, step = w.ravel(), g.ravel(), m[name].ravel(), v[name].ravel(), _CACHED
        else:
            m, v, step = m[name], v[name], max(1, _CACHED // w.shape[1])
        for at in range(0, len(g), step):
            part = slice(at, at + step)
            own, d = part if rows is None else rows[part], g[part]
            a, b = m[own], v[own]
            a *= 0.9
            a += d
            d *= d
            b *= 0.99
            b += d
            if rows is not None:
                m[own], v[own] = a, b
            np.sqrt(b, out=d)
            d += eps
            np.divide(a, d, out=d)
            d *= rate
            w[own] -= d

    def learn(self, pieces, streams: int = WIDE, steps: int = STEPS, rate: float = RATE) -> int:
        """One pass over lists of documents (word ids without end marks), each list a piece of the data that fits in memory.
        Rows of x move only when their words occur. Returns the tokens learned from, end marks included."""
        m, v, seen, t = {k: np.zeros_like(w) for k, w in self.w.items()}, {k: np.zeros_like(w) for k, w in self.w.items()}, 0, 0
        for docs in pieces:
            flat = np.concatenate([np.append(0, d) for d in docs] + [np.zeros(1, np.int64)])
            seen += len(flat) - 1
            # What does not divide by the streams comes last, as one stream.
            width = max(1, min(streams, (len(flat) - 1) // (64 * steps)))
            n = (len(flat) - 1) // width
            for at, width, n in ((0, width, n), (width * n, 1, len(flat) - 1 - width * n)):
                x, y = (flat[k + at : k + at + width * n].reshape(width, n).T for k in (0, 1))
                state = np.zeros((width, self.h), np.float32)
                for i in range(0, n, steps):
                    _, grad, ids, state = self._window(x[i : i + steps], y[i : i + steps], state)
                    t += 1
                    lr, size = rate * min(1.0, t / 20) / (1 - 0.9**t), 1.0 / (streams * steps)
                    for k, g in grad.items():
                        self._adam(k, ids if k == "x" else None, g, m, v, size, lr, 1 / (1 - 0.99**t))
        return seen

    def fit(self, docs: list[np.ndarray], epochs: int = EPOCHS, streams: int = STREAMS, steps: int = STEPS, rate: float = RATE):
        """docs: word ids without end marks."""
        flat = np.concatenate([np.append(0, d) for d in docs] + [np.zeros(1, np.int64)])
        n = (len(flat) - 1) // streams
        if n < 1:
            streams, n = 1, len(flat) - 1
        x, y = (flat[k : k + streams * n].reshape(streams, n).T for k in (0, 1))
        m, v, t = {k: np.zeros_like(w) for k, w in self.w.items()}, {k: np.zeros_like(w) for k, w in self.w.items()}, 0
        rounds = epochs * -(-n // steps)
        for _ in range(epochs):
            state = np.zeros((streams, self.h), np.float32)
            for at in range(0, n, steps):
                _, grad, state = self.window(x[at : at + steps], y[at : at + steps], state)
                t += 1
                lr = rate * (1 - 0.9 * t / rounds)
                for k, g in grad.items():
                    self._adam(k, None, g, m, v, 1.0 / (streams * steps), lr / (1 - 0.9**t), 1 / (1 - 0.99**t))

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Log10 probabilities of documents (ids with the end mark last), run side by side with states carried throughout."""
        out, start, gates = np.zeros(len(docs)), self.start(1), self._gates()
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        for at in range(0, len(order), _SIDE):
            part = order[at : at + _SIDE]
            lengths = np.array([len(docs[i]) for i in part])
            state, total, t = start[np.zeros(len(part), np.int64)], np.zeros(len(part)), 0
            while t < lengths[0]:
                steps = int(min(max(8, 16384 // max(1, np.count_nonzero(lengths > t))), lengths[0] - t))
                live = int(np.count_nonzero(lengths > t))
                ids = np.zeros((steps, live), np.int64)
                for k in range(live):
                    piece = docs[part[k]][t : t + steps]
                    ids[: len(piece), k] = piece
                states, targets, owners = [], [], []
                for s in range(steps):
                    n = int(np.count_nonzero(lengths[:live] > t + s))
                    if not n:
                        break
                    states.append(state[:n])
                    targets.append(ids[s, :n])
                    owners.append(np.arange(n))
                    state = self.step(ids[s, :n], state[:n], gates)
                total += np.bincount(np.concatenate(owners), self.log_p(np.concatenate(states), np.concatenate(targets)), len(part))
                t += steps
            out[part] = total / np.log(10)
        return out


def count_tokens(docs: DataFrame) -> DataFrame:
    """token binary, n: of all texts, end marks included, combined in the tasks and then by the shuffle."""

    def run(batches):
        counts: Counter = Counter()

        def flush():
            got = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])
            counts.clear()
            return got

        for batch in batches:
            for t in batch.column("text"):
                counts.update(tokens_of(t.as_py()))
                counts[END] += 1
                if len(counts) > _FLUSH:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _head(counts: DataFrame, head: int) -> list:
    """The most frequent tokens, at most ``head``: all those in the highest bins of a histogram of counts that fit."""
    bins = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    level, total = None, 0
    for r in sorted(counts.groupBy(bins.alias("b")).count().collect(), key=lambda r: -r["b"]):
        total += r["count"]
        if total > head:
            break
        level = r["b"]
    return [] if level is None else [(bytes(r["token"]), r["n"]) for r in counts.where(bins >= level).select("token", "n").toLocalIterator()]


def _ids(head: list, slots: int) -> dict[bytes, int]:
    """Ids of the words that the network tells apart."""
    ranked = sorted((-n, t) for t, n in head if t != END)[: slots - 2]
    return {END: 0} | {t: i + 2 for i, (_, t) in enumerate(ranked)}


def side(tokens: int) -> int:
    """Root of the number of outputs for a corpus of so many tokens."""
    return max(CLASSES, SIZE, math.ceil(math.sqrt(4 * tokens**0.4)))


def class_edges(counts: dict[bytes, int], ids: dict[bytes, int], tokens: int, outputs: int) -> np.ndarray:
    """Where classes of ids begin, and the number of outputs: the end mark and the rest alone, the others by rank in classes
    whose sizes go with the inverse root of their words' counts, which for a number of classes makes the terms of both
    softmaxes fewest; of these numbers the best one."""
    n = np.zeros(outputs)
    for t, k in ids.items():
        n[k] = counts.get(t, 0)
    n[1] = max(0, tokens - n.sum())
    p = (n + SMOOTH) / (n + SMOOTH).sum()
    root = np.sqrt(p[2:])
    before, best = np.cumsum(root) - root, None
    for k in range(4, 2 * math.isqrt(outputs)):
        edges = np.concatenate([[0, 1], 2 + np.flatnonzero(np.diff(np.floor(before * (k / root.sum())), prepend=-1)), [outputs]])
        sizes = np.diff(edges)
        terms = len(sizes) + float((np.add.reduceat(p, edges[:-1]) * sizes)[sizes > 1].sum())
        if best is None or terms < best[0]:
            best = terms, edges
    return best[1]


def _keyed(docs: DataFrame) -> DataFrame:
    """text, h: a hash with the id, if there is one, so that copies of one text are dealt out."""
    return docs.select("text", F.xxhash64(*(c for c in ("doc_id", "text") if c in docs.columns), F.lit(9)).alias("h"))


def _first(texts, ids: dict[bytes, int], most: int) -> list[np.ndarray]:
    """Word ids of the first texts, of ``most`` tokens at most, end marks included."""
    got, held = [], 0
    for t in texts:
        got.append(_encoded(tokens_of(t)[: most - held - 1], ids))
        held += len(got[-1]) + 1
        if held >= most:
            break
    return got


def fit_net(docs: DataFrame, ids: dict[bytes, int], share: float, size: int = SIZE, most: int = 2 * SAMPLE_TOKENS, edges: np.ndarray | None = None) -> dict:
    """Weights fitted on documents taken by hash with probability ``share``, one at least, and at most ``most`` tokens of
    them: what ``learn_all`` starts from."""
    keyed = _keyed(docs)

    def run(batches):
        net, got = GatedNet(classes=size, size=size, edges=edges), _first((t.as_py() for b in batches for t in b.column("text")), ids, most)
        if got:
            net.fit(got)
            yield pa.RecordBatch.from_arrays([pa.array(list(net.w)), pa.array([v.tobytes() for v in net.w.values()], pa.binary())], ["name", "value"])

    def fitted(sample):
        return sample.repartition(1).sortWithinPartitions("h", "text").select("text").mapInArrow(run, "name string, value binary").collect()

    start = GatedNet(classes=size, size=size, edges=edges).w
    rows = fitted(keyed.where(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * min(1.0, share)))) or fitted(keyed.orderBy("h", "text").limit(1))
    return start | {r["name"]: np.frombuffer(r["value"], np.float32).reshape(start[r["name"]].shape).copy() for r in rows}


def learn_all(docs: DataFrame, ids: dict[bytes, int], weights: dict, tokens: int, edges: np.ndarray | None = None) -> tuple[dict, int]:
    """Weights after learning from every document once, and the tokens learned from. docs: text, and doc_id if there is one."""
    spark = docs.sparkSession
    size, learned = weights["bw"].shape[0], 0
    shards = math.ceil(tokens / ROUNDS / max(SHARD, SHARD_ROOT * math.sqrt(tokens)))
    keyed = _keyed(docs)
    for k in range(ROUNDS if tokens else 0):
        shared, rate = spark.sparkContext.broadcast((ids, weights)), RATE * 0.4 / (1 + k)

        def run(batches, shared=shared, rate=rate):
            known, start = shared.value
            net = GatedNet(classes=size, size=size, weights={name: w.copy() for name, w in start.items()}, edges=edges)

            def pieces():
                docs, held = [], 0
                for b in batches:
                    for t in b.column("text"):
                        docs.append(_encoded(tokens_of(t.as_py()), known))
                        held += len(docs[-1]) + 1
                        if held >= PIECE:
                            yield docs
                            docs, held = [], 0
                if docs:
                    yield docs

            n = net.learn(pieces(), rate=rate)
            for name, w in net.w.items() if n else ():
                flat = w.ravel()
                for at in range(0, len(flat), _BLOCK):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at], pa.int64()), pa.array([n], pa.int64()), pa.array([flat[at : at + _BLOCK].tobytes()], pa.binary())], ["name", "at", "n", "value"])

        def mean(group):
            n = group.column("n").to_numpy()
            values = np.stack([np.frombuffer(v.as_py(), np.float32) for v in group.column("value")])
            value = np.average(values[np.lexsort((values[:, 0], n))], axis=0, weights=np.sort(n)).astype(np.float32)
            return pa.table({"name": group.column("name")[:1], "at": group.column("at")[:1], "n": pa.array([int(n.sum())], pa.int64()), "value": pa.array([value.tobytes()], pa.binary())})

        of_round = keyed.where(F.pmod("h", F.lit(ROUNDS)) == k).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int"))
        fitted = of_round.repartitionById(shards, "shard").sortWithinPartitions("h", "text").select("text").mapInArrow(run, "name string, at long, n long, value binary")
        blocks = fitted.groupBy("name", "at").applyInArrow(mean, "name string, at long, n long, value binary").collect()
        if blocks:
            learned += blocks[0]["n"]
            weights = {name: np.frombuffer(b"".join(bytes(r["value"]) for r in sorted(blocks, key=lambda r: r["at"]) if r["name"] == name), np.float32).reshape(w.shape).copy() for name, w in weights.items()}
    return weights, learned


def score_texts(docs: DataFrame, train: DataFrame, head: int = HEAD, sample_tokens: int = SAMPLE_TOKENS) -> DataFrame:
    """docs: doc_id, text. train: text. Returns doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    counts = cut(count_tokens(train))
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    size = side(n)
    top = _head(counts, head)
    ids = _ids(top, size * size)
    edges = class_edges(dict(top), ids, n, size * size)
    weights, _ = learn_all(train, ids, fit_net(train, ids, sample_tokens / max(n, 1), size, max(2, 2 * sample_tokens), edges), n, edges)
    # Of the words that share an output: their tokens and number, one more for words never seen.
    own = [(t, c) for t, c in top if t in ids]
    rest_n, rest_v = n - sum(c for _, c in own), v - len(own)
    rest = np.log10(rest_n + SMOOTH * (rest_v + 1))
    whole = np.log10(n + SMOOTH * (v + 1))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((dict(top), ids, weights))

    def run(batches):
        known, ids, weights = shared.value
        net = GatedNet(classes=size, size=size, weights=weights, edges=edges)
        # Places of the words told apart or known, from 1; the end mark has one at any rate. 0: all others.
        own = list(known | {END: known.get(END, 0)})
        at, net_ids = {t: i for i, t in enumerate(own, 1)}, np.array([1] + [ids.get(t, 1) for t in own], np.int32)
        counted = np.array([False] + [t in known for t in own])
        logs = np.log10(np.array([0] + [known.get(t, 0) for t in own]) + SMOOTH) * counted
        splits = np.where(net_ids == 1, logs, 0.0)

        # In slices of about _HELD tokens: enough texts of a length side by side, and what a task holds does not follow the batch.
        def sliced(batch):
            held = 0
            for i, text in enumerate(batch.column("text")):
                held += 1 + (len(text.as_buffer()) // 6 if text.is_valid else 0)
                if held >= _HELD:
                    yield i + 1
                    held = 0
            yield batch.num_rows

        def slices():
            for batch in batches:
                at = 0
                for end in sliced(batch):
                    if end > at:
                        yield batch.slice(at, end - at)
                    at = end

        for batch in slices():
            rows, seqs = [], []
            for text in batch.column("text"):
                words = tokens_of(text.as_py())
                words.append(END)
                places = _encoded(words, at, 0)
                seq, hit = net_ids[places], counted[places]
                found = Counter(words[i] for i in np.flatnonzero(~hit))
                seqs.append(seq)
                rows.append((len(words), int(np.count_nonzero(hit)), float(logs[places].sum()), float(splits[places].sum()), int(np.count_nonzero(seq == 1)), found))
            scores = net.score(seqs)
            flat = pa.StructArray.from_arrays([pa.array([t for r in rows for t in r[5]], pa.binary()), pa.array([k for r in rows for k in r[5].values()], pa.int64())], ["token", "n"])
            tail = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(r[5]) for r in rows]), pa.int32()), flat)
            cols = [batch.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()))), pa.array(scores, pa.float64()), tail]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "hits", "base", "split", "n_rest", "net", "tail"])

    id_type = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {id_type}, n_tokens long, hits long, base double, split double, n_rest long, net double, tail array<struct<token:binary,n:long>>"
    passed = cut(docs.select("doc_id", "text").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    words = passed.where(F.size("tail") > 0).select("row", F.explode("tail").alias("t")).select("row", "t.token", F.col("t.n").alias("k"))
    count = F.coalesce("n", F.lit(0))
    share = F.log10(count + SMOOTH) * F.col("k")
    # A word outside the head is one of those that share an output, but for the end mark where there are no counts.
    tail = words.join(counts, "token", "left").groupBy("row").agg(F.sum(share).alias("_log"), F.sum(F.when(F.col("token") != END, share)).alias("_split"), F.sum(F.when(count > 0, F.col("k")).otherwise(0)).alias("_known"))
    out = passed.drop("tail").join(tail, "row", "left")
    zero = F.lit(0.0)
    return out.select(
        "doc_id", "n_tokens", (F.col("hits") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_log", zero) - F.col("n_tokens") * float(whole)).alias("base_score"),
        (F.col("net") + F.col("split") + F.coalesce("_split", zero) - F.col("n_rest") * float(rest)).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_texts(docs, docs.where(crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
