import hashlib
import re

import pytest

from threadloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    odd = [int(c) for c in digits[::-1]]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(odd)) % 10 == 0


def brute(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", m) for m in EMAIL.finditer(text)]
    out += [("ip", m) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", m) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


HARD = ["a@b.c_d@e.f x", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.004", "4111 1111 1111 1111 2", "4111-1111-1111-1111", "é🙂 4111111111111111 x@y.z", "+1 (619) 555-0053. +12", "+1 +2 345 678 901", "..@a.b a@b a@b. a@-.-", "0" * 16, "@@a@b.c@d.e"]


def spans(spark, df):
    found = pii.find(df)
    rows = pii.with_spans(found, pii.Trees(pii.count_features(found)))
    return rows.select("text", pii._joined(rows["__pii_base"]).alias("b"), pii._joined(rows["__pii_spans"]).alias("s")).collect()


def test_base_spans_like_brute_force(spark, edge, docs_of, data):
    for df in (edge, docs_of(HARD), spark.read.parquet(f"{data}/documents.parquet")):
        for r in spans(spark, df):
            assert r["b"] == brute(r["text"])
            assert set(filter(None, r["b"].split(","))) <= set(r["s"].split(","))


def test_positions_over_many_slices(spark, docs_of):
    text = " ".join(f"u{i}@m.org é" for i in range(3 * pii.SLICE + 7))
    assert spans(spark, docs_of([text]))[0]["b"] == brute(text)


def test_query_columns(spark, data):
    rows = pii.query(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text"), "doc_id").collect()
    assert len(rows) == 200
    for r in rows:
        want = brute(r["text"])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] == (want.count(",") + 1 if want else 0)


def test_trees_find_secrets_and_leave_words(spark, docs_of):
    keys = [f'token = "{hashlib.sha1(str(i).encode()).hexdigest()}" end' for i in range(120)]
    clean = [f"the build number{i}abcdefghijklmnop of page 12 2020 stays" for i in range(120)]
    got = spans(spark, docs_of(keys + clean))
    assert sum("secret" in r["s"] for r in got[:120]) >= 110
    assert not any("secret" in r["s"] for r in got if "stays" in r["text"])


def test_keys_without_evidence_are_judged_by_their_looks(spark, docs_of):
    key = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    known = [f"api_key: {key(i)} end" for i in range(200)]
    bare = [f"here stands {key(1000 + i)} alone" for i in range(6)]
    other = [f"see part_{i}_of_the_long_list for more" for i in range(100, 160)]
    got = spans(spark, docs_of(known + bare + other))
    assert all("secret" in r["s"] for r in got[:206]) and not any("secret" in r["s"] for r in got[206:])


def test_the_threshold_alone_decides(spark, docs_of):
    """Evidence of a kind whose looks say nothing adds no span: half of the same looks have none."""
    key = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    alike = [f"{'token' if i % 2 else 'about'} {key(i)} end" for i in range(200)]
    found = pii.find(docs_of(alike))
    trees = pii.Trees(pii.count_features(found))
    assert trees.report["secret"][:2] == (200, 100) and not trees.thresholds
    assert not any(r["s"] for r in spans(spark, docs_of(alike)))
    # Where looks and evidence go together, precision and recall of the cross-fitted threshold are near one.
    apart = [f"token {key(i)} end" for i in range(200)] + [f"about part_{i}_of_the_long_list end" for i in range(200)]
    total, confirmed, chosen, precision = pii.Trees(pii.count_features(pii.find(docs_of(apart)))).report["secret"]
    assert (total, confirmed) == (400, 200) and precision >= 0.95 and chosen * precision >= 0.95 * confirmed


def test_long_parts_of_addresses(spark, docs_of):
    texts = [f"write to {'a' * n}[at]{'b' * n}[dot]org now" for n in (3, 64, 65, 500)]
    rows = pii.find(docs_of(texts)).selectExpr("__pii_wide as w").collect()
    assert [[(c["start"], c["end"]) for c in r["w"] if c["kind"] == "contact"] for r in rows] == [[(9, 9 + 2 * n + 12)] for n in (3, 64, 65, 500)]


def test_evidence_is_no_feature(spark, docs_of):
    """A key looks alike with and without the word that confirms it, a number with and without its plus."""
    texts = ["token=0123456789abcdef0123", "about 0123456789abcdef0123", "to +14155550133 now", "to 14155550133 now"]
    rows = pii.find(docs_of(texts)).selectExpr("__pii_wide as w").collect()
    of = [[c for c in r["w"] if c["kind"] == ("secret" if k < 2 else "number")][0] for k, r in enumerate(rows)]
    for a, b in ((of[0], of[1]), (of[2], of[3])):
        assert a["y"] and not b["y"] and [a[n] for n in pii.BINS] == [b[n] for n in pii.BINS]


def test_selection_like_brute_force(spark, docs_of, data):
    """Scores by walking the trees, overlaps by comparing all spans of a text."""
    texts = ["t@a.b token=abcdef0123456789abcdef 4111 1111 1111 1111, sk-0123456789abcdef0123@x.org +1 415 555 0133 999-888-7777-666", "password: aB3aB3aB3aB3aB3aB3aB3 tel 0301234567 0301234568"] * 12
    for df in (docs_of(texts), spark.read.parquet(f"{data}/documents.parquet")):
        found = pii.find(df)
        trees = pii.Trees(pii.count_features(found))
        names = list(pii.BINS)
        for r in pii.with_spans(found.withColumn("w", found["__pii_wide"]), trees).collect():
            base = [tuple(x) for x in r["__pii_base"]]
            chosen = []
            for c in r["w"]:
                score = trees.start
                for (f, v), (yes, a, b), (no, x, y) in trees.trees:
                    at, hit, miss = (yes, a, b) if c[names[f]] == v else (no, x, y)
                    score += hit if c[names[at[0]]] == at[1] else miss
                if score >= trees.thresholds.get(c["family"], 1e9):
                    chosen.append((c["kind"], c["start"], c["end"]))
            chosen = [c for c in chosen if not any(b[1] < c[2] and c[1] < b[2] for b in base)]
            kept = []
            for c in sorted(chosen, key=lambda c: (c[1], -c[2], c[0])):
                if not any(k[1] < c[2] and c[1] < k[2] for k in kept):
                    kept.append(c)
            assert [tuple(x) for x in r["__pii_spans"]] == base + sorted(kept)


def test_redaction_of_very_many_spans(spark, docs_of):
    n = 3 * pii.SLICE + 11
    text = "é🙂 " * 700 + " ".join(f"w{i} u{i}@m.org é" for i in range(n)) + " z" * 3000
    want = "é🙂 " * 700 + " ".join(f"w{i} [EMAIL] é" for i in range(n)) + " z" * 3000
    assert pii.redact(docs_of([text])).first()["text"] == want


def test_other_columns_with_clashing_names(spark, docs_of):
    df = docs_of(["mail a@b.org", None]).withColumnsRenamed({"size": "__text", "score": "__spans", "key": "kind"})
    got = pii.redact(df).collect()
    assert [r["text"] for r in got] == ["mail [EMAIL]", None] and got[0]["__text"] == 0 and got[0]["__spans"] == 0.5 and got[0]["kind"] == "k"


def test_redaction(spark, docs_of, edge, nothing):
    df = docs_of(["mail a@b.org or +1 (619) 555-0053 now", "nothing here", None, "x 4111111111111111"])
    got = pii.redact(df)
    assert got.columns == df.columns
    assert [r["text"] for r in got.collect()] == ["mail [EMAIL] or [PHONE] now", "nothing here", None, "x [CARD]"]
    assert pii.redact(edge).count() == edge.count()
    assert pii.redact(nothing).count() == 0


def test_native_plan(spark, edge):
    plan = pii.redact(edge)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval"))


@pytest.mark.parametrize("n", [0, 1])
def test_few_candidates(n):
    assert pii.Trees([]).thresholds == {}
