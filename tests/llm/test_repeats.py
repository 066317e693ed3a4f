import hashlib
import random
import re

import numpy as np
import pytest

from threadloom.llm import repeats as r

from .conftest import prose


def brute(texts, width):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for b in data:
        for p in range(len(b) - width + 1):
            seen[b[p : p + width]] = seen.get(b[p : p + width], 0) + 1
    out = []
    for b in data:
        cover = np.zeros(len(b) + 1, np.int64)
        for p in range(len(b) - width + 1):
            if seen[b[p : p + width]] > 1:
                cover[p] += 1
                cover[p + width] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def hard(seed):
    rng = random.Random(seed)
    passage = prose(seed, 90)
    out = [prose(k, 40) + passage[rng.randrange(60) : 470 + rng.randrange(80)] + prose(k + 1, 30) for k in range(100 * seed, 100 * seed + 8)]
    return out + [passage * 3, "ab" * 700, "é🙂" * 300, "x" * 399, "x" * 400, "y" * 401, passage[:400] + "!", "z" + passage[:400], prose(77, 200), prose(77, 200)]


def brute_words(texts, n):
    """Words in runs of n or more that another document holds too, and maximal runs of them."""
    words = [[w for w in re.split("[ \t\n\x0b\x0c\r]+", t or "") if w] for t in texts]
    owners = {}
    for k, ws in enumerate(words):
        for i in range(len(ws) - n + 1):
            owners.setdefault(tuple(ws[i : i + n]), set()).add(k)
    out = []
    for ws in words:
        end = total = runs = 0
        for i in range(len(ws) - n + 1):
            if len(owners[tuple(ws[i : i + n])]) > 1:
                runs += not total or i > end
                total += i + n - max(end, i)
                end = i + n
        out.append((total, runs))
    return out


@pytest.mark.parametrize("most", [r.MOST, 1])
def test_like_brute_force(spark, docs_of, edge_texts, most, monkeypatch):
    monkeypatch.setattr(r, "CHUNK", 5000)
    texts = hard(1) + hard(2) + [t for t in edge_texts if t is None or len(t) < 3000] + [prose(5, 1500)]
    got = {x["doc_id"]: tuple(x)[1:] for x in r.repeated_bytes(docs_of(texts), most=most).collect()}
    assert [got[k][:4] for k in range(len(texts))] == brute(texts, 400)
    assert [got[k][4:] for k in range(len(texts))] == brute_words(texts, 51)


def test_query_like_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()
    got = {x["doc_id"]: tuple(x)[1:] for x in r.query(spark, data).collect()}
    assert [got[d["doc_id"]][:4] for d in docs] == brute([d["text"] for d in docs], 400)
    assert [got[d["doc_id"]][4:] for d in docs] == brute_words([d["text"] for d in docs], 51)


@pytest.mark.parametrize("most", [r.MOST, 1])
def test_passages_of_over_fifty_words_are_told_even_under_the_width(spark, docs_of, most):
    """The passage is of 51 words and under 400 bytes: no byte goes, and both documents are told, whatever the blanks."""
    rng = random.Random(8)
    passage = [rng.choice("abcdefgh") * rng.randint(1, 5) + str(k) for k in range(51)]
    texts = [prose(1, 60) + " " + " ".join(passage) + " " + prose(2, 60), prose(3, 80) + "\n" + "\n".join(passage) + "\n" + prose(4, 20), prose(5, 30) + " " + " ".join(passage[:50]) + " " + prose(6, 30), " ".join(passage[:1] * 60) + " " + prose(7, 30)]
    assert len(" ".join(passage)) < 400
    got = {x["doc_id"]: x for x in r.repeated_bytes(docs_of(texts), most=most).collect()}
    assert [(got[k]["n_removed"], got[k]["n_shared_words"], got[k]["n_passages"]) for k in range(4)] == [(0, 51, 1), (0, 51, 1), (0, 0, 0), (0, 0, 0)]


def test_windows_are_sorted_in_byte_order():
    """What the sort compares neighbours in is the order of the windows' bytes, ties of several hundred bytes included."""
    rng = np.random.default_rng(2)
    core, kind = rng.integers(97, 99, 700, dtype=np.uint8), r.Kind(0, 400, 100, 1)
    contents = []
    for k in range(12):
        c = core.copy()
        if k:
            c[rng.integers(0, 700)] = 99 + k % 3
        contents.append(c.tobytes())
    orders = []

    def spy(keys):
        orders.append(real(keys))
        return orders[-1]

    real, r.np.lexsort = np.lexsort, spy
    try:
        found = r.repeated_windows(contents, np.full(12, -150), np.ones(12, np.int64), np.zeros(12, np.int64), kind)
    finally:
        r.np.lexsort = real
    windows = [(k - 150 + i - k, contents[s][i : i + 400]) for s in range(12) for k, i in ((i, i) for i in range(301))]
    assert [windows[k] for k in orders[-1]] == sorted(windows)
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    assert np.concatenate(found).tolist() == [seen[w] > 1 for w in windows]


def test_segments_do_not_depend_on_where_they_stand():
    rng, kind = np.random.default_rng(3), r.Kind(0, 400, 80, 1)
    core = rng.integers(0, 256, 1500, dtype=np.uint8)
    for lead in (0, 13, 1000):
        data = np.concatenate([rng.integers(0, 256, lead, dtype=np.uint8), core])
        _, first, last, anchor, fp, _ = r.segments(r._BYTES[data], np.array([0, len(data)]), kind)
        inside = {(int(a - lead), int(f)) for a, i, f in zip(anchor, first, fp.view(np.int64), strict=True) if i >= lead}
        if lead == 0:
            want = inside
        assert inside >= {x for x in want if x[0] > 400}


def test_words_of_long_texts_in_slices(monkeypatch):
    text = (prose(4, 300) + "  \t" + "x" * 700 + "\n" + prose(5, 100)).encode()
    whole = r.words_of(np.frombuffer(text, np.uint8))
    monkeypatch.setattr(r, "CHUNK", 150)
    assert whole.tolist() == r.words_of(np.frombuffer(text, np.uint8)).tolist() and len(whole) == len(text.split())


def test_edges(spark, edge, nothing, edge_texts):
    rows = r.repeated_bytes(edge).collect()
    assert len(rows) == len(edge_texts) and r.repeated_bytes(nothing).count() == 0
    long = [x for x in rows if x["doc_id"] in (8, 9)]
    assert all(x["n_removed"] == x["n_bytes"] and x["n_spans"] == 1 for x in long)
