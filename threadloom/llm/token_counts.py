"""Token counts by a byte-level BPE tokenizer compiled to a deterministic transducer.

A vocabulary file becomes one transducer over characters, whose transitions carry the change they make in the number of
tokens. A state says how the text is being cut into pieces (letters, digits, other signs, white space, a contraction being
read) and, within the piece, all that BPE needs: every start from which a longer token could still end here, the token
before that start, and how many tokens earlier it lies. For BPE the tokens of a prefix never depend on what follows, and a
sequence of tokens is the right one if and only if each pair of neighbours is what BPE makes of the two together; so the
last token is the one that fits its predecessor, and a step needs no more than the state and the character. A token that
swallows earlier ones makes a negative change. States are compiled when a text first reaches them and forgotten all
together when there are too many, so memory is bounded and results are not touched.

Long texts are cut into chunks. A chunk's state map sends the state before it to a count and the state after it; since all
states meet again where white space follows another character, it is kept as the text before the first such place, the
count between the first and the last, and the text behind the last, which stands for the state. Maps compose
associatively: composing by groups in rounds is the scan, and no step holds more than ``FAN`` maps.

Scale: texts up to ``chunk`` characters are counted in one pass without a shuffle. Chunks of longer ones are dealt to
all tasks, one copy of each distinct text; a hot text costs its chunks once. The vocabulary is a file of bounded size that is broadcast.

Defined cases: null and empty texts have no tokens. Texts are read whole at any length, also without any white space (their
chunks join before they are counted). Repeated rows and null ids count each by themselves. Special strings inside texts are
one token each. Empty table: no rows. Other columns pass through; columns named ``n_tokens`` or starting with ``__tok_`` are taken.
"""

from __future__ import annotations

import json
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

CHUNK = 1 << 16
FAN = 64
STATES = 250_000
LIMIT = 512
VOCABULARY = "byte_bpe_50k.json"

#: The contractions that the piece pattern of this kind of tokenizer tries first.
SHORT, LONG = frozenset("stmd"), {"r": "e", "v": "e", "l": "l"}

_FIRST = re.compile(r"\S(?=[ \n])")
_LAST = re.compile(r"[ \n]\S")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if visible, else the next from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in seen]
    return [chr(b) if b in seen else chr(256 + hidden.index(b)) for b in range(256)]


class State(dict):
    """Character -> (state, change of the count). ``final`` is the change if the text ends here."""

    __slots__ = ("final", "items", "kind", "last", "machine")

    def __init__(self, machine: Machine, kind: str, items: tuple | None, last: str, final: int):
        self.machine, self.kind, self.items, self.last, self.final = machine, kind, items, last, final

    def __missing__(self, ch: str):
        out = self[ch] = self.machine.step(self, ch)
        return out


class Machine:
    """The transducer of one vocabulary file, compiled as texts ask for it."""

    def __init__(self, spec: str, states: int = STATES):
        from tokenizers.pre_tokenizers import ByteLevel

        found = json.loads(spec)
        model, pre = found["model"], found["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or found["normalizer"]:
            raise ValueError("only byte-level BPE without a normalizer or a leading space")
        if model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            raise ValueError("only plain BPE merges")
        byte = {c: b for b, c in enumerate(_byte_letters())}

        def raw(letters: str) -> bytes:
            return bytes(byte[c] for c in letters)

        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        made = [a + b for a, b in self.ranks]
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.tokens = {bytes([b]) for b in range(256)}
        self.tokens |= {t for t in made if self.bpe(t) == [t]}
        self.prefixes = {t[:k] for t in self.tokens for k in range(1, len(t))}
        added = [a for a in found.get("added_tokens", []) if a["content"]]
        for a in added:
            if a["single_word"] or a["lstrip"] or a["rstrip"] or re.search(r"\s", a["content"]):
                raise ValueError(f"added token {a['content']!r} must be plain and without white space")
        self.special = re.compile("|".join(re.escape(a["content"]) for a in sorted(added, key=lambda a: -len(a["content"])))) if added else None
        self.split = ByteLevel(add_prefix_space=False).pre_tokenize_str
        self.kinds: dict[str, str] = {}
        self.states = states
        self._clear()

    def _clear(self):
        self.known: dict[tuple, State] = {}
        self.fits.clear()
        self.root = self.advance((), b"")[0]
        self.start = self.state("start", None)

    def bpe(self, data: bytes) -> list[bytes]:
        """Plain BPE: the merge of least rank, the leftmost of equal ones, until none applies."""
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        while len(parts) > 1:
            rank, at = min((ranks.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit(self, a: bytes | None, b: bytes) -> bool:
        """Whether BPE leaves a and b as two tokens side by side."""
        if a is None:
            return True
        found = self.fits.get((a, b))
        if found is None:
            found = self.fits[a, b] = self.bpe(a + b) == [a, b]
        return found

    def advance(self, items: tuple, data: bytes) -> tuple[tuple, int]:
        """items: (bytes since a start, token before it, tokens from there to here, at most 0), of all starts that matter.
        Returns the items after the bytes and the change of the count."""
        items, change = items or ((b"", None, 0),), 0
        for k in range(len(data)):
            b, kept, last = data[k : k + 1], [], None
            for since, before, back in items:
                run = since + b
                if last is None and run in self.tokens and self.fit(before, run):
                    last, step = run, back + 1
                if run in self.prefixes:
                    kept.append((run, before, back))
            items = (*((run, before, back - step) for run, before, back in kept), (b"", last, 0))
            change += step
        return items, change

    def kind_of(self, ch: str) -> str:
        """Letter, number, space or other, as the library's own pattern has it."""
        found = self.kinds.get(ch)
        if found is None:
            found = self.kinds[ch] = next((k for k, near in (("letter", "a"), ("number", "1"), ("other", "!")) if len(self.split(near + ch)) == 1), "space")
        return found

    def state(self, kind: str, items: tuple | None, last: str = "") -> State:
        key = (kind, items, last)
        found = self.known.get(key)
        if found is None:
            final = self.advance(items or self.root, last.encode())[1] if kind == "space" else 0
            found = self.known[key] = State(self, kind, items, last, final)
        return found

    def begin(self, ch: str, kind: str, lead: str = "") -> tuple[State, int]:
        """A new piece, with a space in front if ``lead`` is one."""
        if kind == "space":
            return self.state("space", None, ch), 0
        items, change = self.advance(self.root, (lead + ch).encode())
        return self.state("quote" if ch == "'" and not lead else kind, items), change

    def step(self, at: State, ch: str) -> tuple[State, int]:
        if len(self.known) > self.states:
            self._clear()
        kind = self.kind_of(ch)
        if at.kind == "space":
            if kind == "space":
                items, change = self.advance(at.items or self.root, at.last.encode())
                return self.state("space", items, ch), change
            if at.last == " ":
                return self.begin(ch, kind, " ")
            alone = self.advance(self.root, at.last.encode())[1]
            to, change = self.begin(ch, kind)
            return to, alone + change
        if at.kind == "quote":
            if ch in SHORT:
                return self.start, len(self.bpe(("'" + ch).encode())) - 1
            if ch in LONG:
                return self.state("short", self.advance(self.root, ch.encode())[0], ch), 1
            if kind == "other":
                items, change = self.advance(at.items, ch.encode())
                return self.state(kind, items), change
        elif at.kind == "short":
            if ch == LONG[at.last]:
                return self.start, len(self.bpe(("'" + at.last + ch).encode())) - 2
            if kind == "letter":
                items, change = self.advance(at.items, ch.encode())
                return self.state(kind, items), change
        elif at.kind == kind:
            items, change = self.advance(at.items, ch.encode())
            return self.state(kind, items), change
        return self.begin(ch, kind)

    def run(self, text: str) -> int:
        """Tokens of a text without special strings."""
        at, total = self.start, 0
        for ch in text:
            at, change = at[ch]
            total += change
        return total + at.final

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None:
            return self.run(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.run, parts))

    # State maps of chunks: (head, count or -1 where no two states meet, tail).

    def chunk_map(self, text: str) -> tuple[str, int, str]:
        first = _FIRST.search(text)
        if first is None:
            return text, -1, ""
        lo, hi = first.end(), len(text) - _LAST.search(text[::-1]).end() + 1
        return text[:lo], self.count(text[lo:hi]), text[hi:]

    def compose(self, maps: list[tuple[str, int, str]]) -> tuple[str, int, str]:
        """The map of the maps one after the other."""
        head, n, open_ = [], -1, []
        for h, k, t in maps:
            (head if n < 0 else open_).append(h)
            if k < 0:
                # No two states meet in the whole chunk, but they may where it joins the next: what is open stays text.
                continue
            n = k if n < 0 else n + self.count("".join(open_)) + k
            open_ = [t]
        return "".join(head), n, "".join(open_)

    def total(self, head: str, n: int, tail: str) -> int:
        return self.count(head) if n < 0 else self.count(head) + n + self.count(tail)


_MACHINES: dict[int, Machine] = {}


def machine(spec: str) -> Machine:
    """One machine for each vocabulary and Python worker: tasks that follow find it warm."""
    key = zlib.crc32(spec.encode())
    if key not in _MACHINES:
        _MACHINES.clear()
        _MACHINES[key] = Machine(spec)
    return _MACHINES[key]


_MAP = "struct<head:string,n:long,tail:string>"


def count_tokens(docs: DataFrame, path: str, text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """docs: any columns and a text column. Adds n_tokens (long) by the vocabulary file at ``path``, which only the driver reads."""
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        m = machine(spec.value)
        return pa.array([m.count(t.as_py()) for t in texts], pa.int64())

    @F.arrow_udf(_MAP)
    def chunk_map(texts: pa.Array) -> pa.Array:
        m = machine(spec.value)
        return pa.StructArray.from_arrays([*map(pa.array, zip(*(m.chunk_map(t.as_py()) for t in texts), strict=True))], ["head", "n", "tail"]) if len(texts) else _none()

    @F.arrow_udf(_MAP)
    def compose(groups: pa.Array) -> pa.Array:
        m = machine(spec.value)
        maps = (m.compose([(x["head"], x["n"], x["tail"]) for x in g.as_py()]) for g in groups)
        return pa.StructArray.from_arrays([*map(pa.array, zip(*maps, strict=True))], ["head", "n", "tail"]) if len(groups) else _none()

    @F.arrow_udf("long")
    def total(maps: pa.Array) -> pa.Array:
        m = machine(spec.value)
        return pa.array([m.total(**x.as_py()) for x in maps], pa.int64())

    def _none():
        return pa.StructArray.from_arrays([pa.array([], pa.string()), pa.array([], pa.int64()), pa.array([], pa.string())], ["head", "n", "tail"])

    size = F.coalesce(F.length(text), F.lit(0))
    short = docs.where(size <= chunk).withColumn("n_tokens", count(F.col(text)))
    long = docs.where(size > chunk).withColumn("__tok_key", F.sha2(F.col(text), 256))
    at = F.explode(F.sequence(F.lit(0), F.expr(f"(length(__tok_text) - 1) div {chunk}"))).alias("no")
    each = long.select("__tok_key", F.col(text).alias("__tok_text")).dropDuplicates(["__tok_key"]).select("__tok_key", at, "__tok_text")
    pieces = each.select("__tok_key", "no", F.substring("__tok_text", F.col("no") * chunk + 1, F.lit(chunk)).alias("piece"))
    # Dealt by chunk, so that the chunks of one text are spread; written, since the number of rounds depends on them.
    maps = cut(pieces.repartition("__tok_key", "no").select("__tok_key", "no", chunk_map("piece").alias("map")))
    most = maps.agg(F.max("no")).first()[0] or 0
    while most:
        grouped = maps.groupBy("__tok_key", F.expr(f"no div {FAN}").alias("no")).agg(F.sort_array(F.collect_list(F.struct("no", "map"))).alias("all"))
        maps, most = grouped.select("__tok_key", "no", compose(F.transform("all", lambda x: x["map"])).alias("map")), most // FAN
    totals = maps.select("__tok_key", total("map").alias("n_tokens"))
    joined = long.drop("n_tokens").join(totals, "__tok_key").drop("__tok_key")
    return short.select(*[c for c in docs.columns if c != "n_tokens"], "n_tokens").unionByName(joined)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = count_tokens(docs, public_tokenizers.path(VOCABULARY))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
