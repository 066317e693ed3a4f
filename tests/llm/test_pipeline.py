import math
import re

from pyspark.sql import functions as F

import corpus_pipeline as p
from threadloom.llm import pii, quality, toxicity
from threadloom.llm.common import table, unit

from .conftest import prose
from .test_decontaminate import naive_tiles
from .test_mixing import naive_targets
from .test_pii import brute as brute_spans


def _tables(spark, tmp_path, docs, items, labels):
    for name, df in (("documents", docs), ("benchmark", items), ("labels", labels)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_every_stage_decides(spark, docs_of, tmp_path):
    leak = prose(900, 40)
    clean = [prose(k, 80) for k in range(40)]
    toxic = [prose(100 + k, 60) + " vilefool grotesque vilefool" for k in range(60)]
    near = clean[0].replace(clean[0].split()[40], "changed", 1)
    texts = [*clean, *toxic, near, clean[1], f"{prose(500, 30)} {leak}", f"{prose(501, 60)} mail x@y.org soon.", None, ""]
    docs = docs_of(texts).select("doc_id", "text", "lang", "source", "n_chars")
    items = spark.createDataFrame([(1, leak)], "item_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(40 <= k < 100)) for k in range(100)], "doc_id long, quality int, toxic int")
    where = _tables(spark, tmp_path, docs, items, labels)
    seen, at = [], docs
    for name, stage in p.STAGES:
        at = stage(spark, at, where)
        if name != "mixing":
            assert at.columns == docs.columns
        seen.append({r["doc_id"]: r for r in at.collect()})
    tox, dedup, decon, redacted, mixed = seen
    assert not any(40 <= k < 100 for k in tox) and set(range(40)) <= set(tox)
    assert set(tox) - set(dedup) == {100, 101}
    assert set(dedup) - set(decon) == {102}
    assert set(redacted) == set(decon) and redacted[103]["text"].endswith("mail [EMAIL] soon.") and redacted[103]["n_chars"] == len(redacted[103]["text"])
    assert set(mixed) <= set(redacted) and all(r["taken"] > 0 for r in mixed.values()) and 104 not in mixed
    assert [n for n, _ in p.STAGES] == ["toxicity", "near_copies", "decontamination", "pii", "mixing"]
    assert len(re.findall("x@y.org", " ".join(r["text"] or "" for r in mixed.values()))) == 0


def test_run_over_tables_and_nothing(spark, data, docs_of, tmp_path):
    assert 0 < p.run(spark, data).count() <= 200
    docs = docs_of([]).select("doc_id", "text", "lang", "source", "n_chars")
    where = _tables(spark, tmp_path, docs, spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert p.run(spark, where).count() == 0


def test_clashing_names_and_repeated_rows(spark, docs_of, tmp_path):
    """Extra columns with names like the stages' own pass through; of repeated rows one stays."""
    texts = [prose(k, 50) for k in range(12)] + [prose(3, 50)]
    docs = docs_of(texts).withColumnsRenamed({"size": "__before", "score": "__lines", "key": "_th"}).unionByName(docs_of(texts[:2]).withColumnsRenamed({"size": "__before", "score": "__lines", "key": "_th"}))
    where = _tables(spark, tmp_path, docs, spark.createDataFrame([(1, prose(700, 40))], "item_id long, text string"), spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int"))
    at = docs
    for name, stage in p.STAGES:
        at = stage(spark, at, where)
        if name != "mixing":
            assert at.columns == docs.columns
        if name == "pii":
            assert sorted(r["doc_id"] for r in at.collect()) == list(range(12))
    assert all(r["_th"] == "k" and r["__lines"] == 0.5 for r in at.collect())


def _plain_toxicity(rows, model):
    at, weights, intercept = model
    table, of = dict(zip(at.tolist(), weights.tolist(), strict=True)), toxicity.Features(toxicity.BITS)

    def score(text):
        return 1 / (1 + math.exp(-(sum(table.get(b, 0.0) for b in set(of(text).tolist())) + intercept)))

    return [r for r in rows if score(r["text"]) < toxicity.THRESHOLD]


def _plain_near(rows):
    """All pairs; of each class the least id stays, and every text without words."""
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").lower())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    least = {}
    for k, r in enumerate(rows):
        if sets[k]:
            least[root(k)] = min(r["doc_id"], least.get(root(k), r["doc_id"]))
    return [r for k, r in enumerate(rows) if not sets[k] or least[root(k)] == r["doc_id"]]


def _plain_leaks(rows, items):
    tokens = lambda t: re.findall(r"\w+", (t or "").lower())
    seeds = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    bench = [w for w in (tokens(i["text"]) for i in items) if len(w) >= 5]

    def leaks(text):
        own = tokens(text)
        mine = seeds(own)
        return any(seeds(w) & mine and sum(n for _, _, n in naive_tiles(w, own, 5)) >= 0.8 * len(w) for w in bench)

    return [r for r in rows if not leaks(r["text"])]


def _plain_redaction(text, spans):
    """Spans that overlap are one place, named by the first."""
    out, at = "", 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]


def test_run_like_plain_stages(spark, data):
    """The whole run over the whole tables: scores, pairs, tiles, spans, targets and the order of drawing by plain loops over each stage's own input.
    The fits of toxicity and PII, held against plain loops in their own tests, are taken as they are."""
    docs, labels = table(spark, data, "documents"), table(spark, data, "labels")
    rows = _plain_toxicity([r.asDict() for r in docs.collect()], toxicity.train(docs, labels))
    rows = _plain_leaks(_plain_near(rows), table(spark, data, "benchmark").collect())
    found = pii.find(spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string"))
    spans = {r["doc_id"]: [(x["start"], x["end"], x["kind"]) for x in r["__pii_spans"]] for r in pii.with_spans(found, pii.Trees(pii.count_features(found))).select("doc_id", "__pii_spans").collect()}
    for r in rows:
        base = [x for x in spans[r["doc_id"]] if x[2] in pii.BASE]
        assert ",".join(f"{k}:{a}:{b}" for a, b, k in base) == brute_spans(r["text"])
        if spans[r["doc_id"]]:
            r["text"] = _plain_redaction(r["text"], spans[r["doc_id"]])
            r["n_chars"] = len(r["text"])
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for r in rows:
        lines = [x for x in (r["text"] or "").split("\n") if word.search(x)]
        r["lines"], r["size"] = lines, len(word.findall(r["text"] or ""))
    every = sorted({x for r in rows for x in r["lines"]})
    fails = {r["x"]: r["f"] for r in spark.createDataFrame([(x,) for x in every], "x string").select("x", quality.line_fails(F.col("x")).alias("f")).collect()}
    drawn = spark.createDataFrame([(r["doc_id"], r["size"]) for r in rows], "doc_id long, size long").select("doc_id", unit(F.lit(17), F.col("doc_id"), F.col("size")).alias("u"))
    u = {r["doc_id"]: r["u"] for r in drawn.collect()}
    order = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s))
    sizes = [sum(r["size"] for r in rows if r["source"] == s) for s in order]
    want = set()
    for s, target, size in zip(order, naive_targets(sizes), sizes, strict=True):
        own = [r for r in rows if r["source"] == s]
        weight = {r["doc_id"]: 0.5 + 1.5 * sum(not fails[x] for x in r["lines"]) / max(len(r["lines"]), 1) for r in own}
        epochs = int(target // size) if size else 0
        budget, total = target - epochs * size, 0
        for r in sorted(own, key=lambda r: -math.log(u[r["doc_id"]]) / weight[r["doc_id"]]):
            before, total = total, total + r["size"]
            takes = total <= budget or (before < budget and total - budget <= budget - before)
            taken = r["size"] * (epochs + (takes and r["size"] > 0))
            if taken:
                want.add((r["doc_id"], r["text"], r["n_chars"], r["source"], taken))
    got = [(r["doc_id"], r["text"], r["n_chars"], r["source"], r["taken"]) for r in p.run(spark, data).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
