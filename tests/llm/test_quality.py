import re
from collections import Counter

from pyspark.sql import functions as F

from threadloom.llm import quality as q

from .conftest import prose


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    marked = set()
    for i in range(len(w) - 7):
        if grams[tuple(w[i : i + 8])] > 1:
            marked.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked), len(w) < 20 or 100 * len(marked) > 30 * len(w)


def test_counts_like_brute_force(spark, edge, docs_of, data):
    phrase = prose(5, 9)
    more = docs_of([f"{phrase} x {phrase}", "a b c d e f g h " * 3, "a\na\n a\n\n \r\na\r", "#<é>|" * 9, prose(6, 30) + " " + phrase])
    for df in (edge, more, spark.read.parquet(f"{data}/documents.parquet")):
        for r in q.judge(df).collect():
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(r["text"])
            assert not (r["base_failed"] and r["kept"])


def test_line_rules(spark, docs_of):
    good = prose(2, 60)
    loud = " ".join(w + "!!" for w in prose(3, 60).upper().split())
    bars = " | ".join(prose(4, 60).split())
    texts = [good, loud, bars, good + "\nHome\nAll rights reserved.\n| a | b | c |", f"{loud}\n{good[:60]}.", "Copyright matters were raised " + good]
    rows = {r["doc_id"]: r for r in q.judge(docs_of(texts), clean=True).collect()}
    assert [rows[k]["kept"] for k in range(6)] == [True, False, False, True, False, True]
    assert rows[3]["cleaned_text"] == good and rows[5]["n_lost_chars"] == 0


def test_empty_and_native(spark, nothing, edge):
    assert q.judge(nothing).count() == 0
    plan = q.judge(edge)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Exchange"))


def test_clashing_names_and_the_share_lost(spark, docs_of):
    """``kept`` and ``n_lost_chars`` from the lines one by one; columns of other names, the like of ours included, pass through."""
    texts = [prose(k, 40) + "\nHome\n" * (k % 4) + "| a | b | c |\n" * (k % 5) + prose(k + 50, 30) for k in range(20)] + [None, "", "Home\n" * 30]
    df = docs_of(texts).withColumnsRenamed({"size": "_words", "score": "_order", "key": "_lines", "n_chars": "kept"})
    fails = {r["line"]: r["f"] for r in spark.createDataFrame([(x,) for t in texts if t for x in t.split("\n")], "line string").distinct().select("line", q.line_fails(F.col("line")).alias("f")).collect()}
    got = {r["doc_id"]: r for r in q.judge(df).collect()}
    for k, text in enumerate(texts):
        lines = [x for x in (text or "").split("\n") if x.strip()]
        lost, every = sum(len(x) for x in lines if fails[x]), sum(map(len, lines))
        assert got[k]["n_lost_chars"] == lost and got[k]["kept"] == (not brute(text)[5] and lost <= 0.5 * every)
        assert (got[k]["_words"], got[k]["_order"], got[k]["_lines"]) == (k, 0.5, "k")
