import hashlib
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.llm import periodic
from threadloom.llm.common import table


def naive(w, least=6, power=4):
    """All runs by their definition: each period, each stretch, smallest period by trial."""
    n, out = len(w), set()
    for q in range(1, n // power + 1):
        s = 0
        while s < n - q:
            e = s
            while e + q < n and w[e] == w[e + q]:
                e += 1
            length = e + q - s
            if e > s and length >= max(least, power * q) and not any(w[s : s + length - k] == w[s + k : s + length] for k in range(1, q)):
                out.add((s, length, q))
            s = max(e, s) + 1
    return sorted(out)


def naive_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = naive(w) if len(w) < 1200 else periodic.find(w)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    top = min(((-k, s, q) for s, k, q in runs), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = (top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *best, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


blocks = st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=9), st.integers(1, 9)), max_size=6)


@settings(max_examples=400, deadline=None)
@given(blocks.map(lambda b: [x for w, k in b for x in w * k]), st.sampled_from([(6, 4), (2, 2), (10, 3)]))
def test_runs_equal_the_definition(words, limits):
    assert periodic.find(words, *limits) == naive(words, *limits)


def test_long_runs_nested_runs_and_borders():
    block = [f"w{i}" for i in range(300)]
    for words in (["a"] * 5000, block * 5, ["x", *block * 4, *["b", "c"] * 700, "y"], (["a", "b"] * 6 + ["c"]) * 9):
        assert periodic.find(words) == naive(words)


def test_z_function():
    s = [1, 2, 1, 2, 1, 3, 1, 2]
    assert periodic.z_function(s, len(s))[1:] == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(1, len(s))]


def test_query_over_the_whole_table(spark, data):
    rows = table(spark, data, "documents").select("doc_id", "text").collect()
    got = {tuple(r) for r in periodic.query(spark, data).collect()}
    assert got == {naive_row(r.doc_id, r.text) for r in rows}
    assert any(r[1] for r in got)


def test_edges(spark, edge, nothing, tmp_path):
    found = periodic.find_runs(edge)
    assert found.columns == [*edge.columns, "n_words", "runs", "collapsed"]
    for r in found.collect():
        words = (r.text or "").encode().split()
        assert r.n_words == len(words)
        assert [tuple(x) for x in r.runs] == (periodic.find(words) if len(words) > 400 else naive(words))
    assert found.where("text is null").select(F.sum("n_words"), F.max("collapsed")).first() == (0, "")
    assert periodic.find_runs(nothing).count() == 0
    edge.write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((naive_row(r.doc_id, r.text) for r in edge.collect()), key=str)
    assert sorted((tuple(r) for r in periodic.query(spark, str(tmp_path)).collect()), key=str) == want
