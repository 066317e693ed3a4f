import random
import re
import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import spelling
from threadloom.llm.common import table


def distance_one(x, y):
    """By definition: some single insertion, deletion or replacement turns x into y."""
    if x == y:
        return False
    cuts = {x[:i] + x[i + 1 :] for i in range(len(x))}
    return y in cuts or x in {y[:i] + y[i + 1 :] for i in range(len(y))} or (len(x) == len(y) and sum(a != b for a, b in zip(x, y, strict=True)) == 1)


def naive_counts(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def naive_variants(n):
    near = defaultdict(set)
    holes = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].add(w)
            if (shorter := w[:i] + w[i + 1 :]) in n:
                near[w].add(shorter)
                near[shorter].add(w)
    for alike in holes.values():
        for w in alike:
            near[w] |= alike - {w}
    form = {w: (min(near[w], key=lambda y: (-n[y], y)) if near[w] else None) for w in n}
    form = {w: f if f and n[f] >= 5 * n[w] else None for w, f in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


@settings(max_examples=300, deadline=None)
@given(st.text("abé", min_size=5, max_size=8), st.text("abé", min_size=5, max_size=8))
def test_one_edit(x, y):
    assert spelling.one_edit(x, y) == distance_one(x, y)


def test_near_words_over_slices_equal_all_pairs(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(6, 9))) for _ in range(500)} | {"aaaaaa", "aaaaaaa", "aaaaaaaa", "x" * 700, "x" * 699, "x" * 698, "ababab", "bababa", "üüüüüü"}
    df = spark.createDataFrame([(w, k) for k, w in enumerate(sorted(words))], "word string, n long")
    want = sorted((x, y) for x in words for y in words if distance_one(x, y))
    for cell in (5, 2048):
        assert sorted((r.word, r.near) for r in spelling.near_words(df, cell).collect()) == want


def test_chains_reach_their_roots(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(13)] + [("a", "w5"), ("b", "a")]
    got = {(r.word, r.root) for r in spelling.follow(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {(w, "w13") for w, _ in chain}


def test_query_over_the_whole_table(spark, data):
    rows = [tuple(r) for r in table(spark, data, "documents").select("doc_id", "text").collect()]
    got = {tuple(r) for r in spelling.query(spark, data).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == naive_variants(naive_counts(rows))
    assert any(r[1] for r in got)


def test_edges(spark, edge, nothing, docs_of):
    texts = ["Muster muster MUSTER Müster"] * 40 + ["mustre muster musterx"] * 6 + [None, "", "×÷ abc " * 9, "z" * 20000] * 6
    docs = docs_of(texts).unionByName(edge)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {tuple(r) for r in spelling.variants(spelling.count_words(docs)).collect()}
    assert got == naive_variants(naive_counts(rows))
    assert ("musterx", "muster", "muster") in {r[:3] for r in got}
    assert spelling.variants(spelling.count_words(nothing)).count() == 0
