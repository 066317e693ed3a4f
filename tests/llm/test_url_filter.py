import random
import re
import time
from itertools import combinations

from pyspark.sql import functions as F

from threadloom.llm import url_filter as u


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.split(r"[/?#]", rest, maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m.group().lower(), raw)
        path = re.split(r"[?#]", rest[len(raw) :], maxsplit=1)[0]
    fits = [(len(h + p), h + p, v) for h, p, v in u.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best and best[2]


URLS = [
    "https://www.Example.COM/en/1?x#y", "http://a.example.com/en/", "http://example.com/en", "http://x.net/es/1", "http://net/fr/", "http://xnet/fr/", "nothing", None, "", "a://b://c/d", "http://", "http://h?a/b", "http://h#/x",
    "http://É.com/", "http://www.example.com/en/a", "http://com/", "http://com", "://x/y", "http://a.com/en/\n?q",
]


def test_parts_and_rules(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(URLS)] + [(0, URLS[0])], "page_id long, url string")
    rows = u.judge(df).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        host, path, rule, verdict = brute(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        if rule:
            assert r["verdict"] == verdict


def test_rules_are_mined_pruned_and_matched(spark):
    rows = [(i, f"http://{'casino-win' if i % 4 == 0 else 'news'}{'' if i % 3 else '-x'}.org/de/{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    labels = df.select("page_id", (F.col("page_id") % 4 == 0).alias("block")).where("page_id < 200")
    got = u.judge(df, labels, seed_words=())
    assert got.where("(verdict = 'block') <> (page_id % 4 = 0)").count() == 0
    # Brute force: every kept rule has the confidence, none contains another that is as good.
    known = df.join(labels, "page_id").select(u.url_tokens(u.host_of(F.col("url")), u.path_of(F.col("url")), F.col("url")).alias("tokens"), "block")
    rules = {tuple(r["rule"]): r["confidence"] for r in u.mine_rules(known).collect()}
    bags = [(set(r["tokens"]), r["block"]) for r in known.collect()]
    for rule, confidence in rules.items():
        hit = [b for t, b in bags if set(rule) <= t]
        assert confidence == sum(hit) / len(hit) >= u.MIN_CONFIDENCE and sum(hit) >= u.MIN_ROWS
        assert not any(set(o) < set(rule) and rules[o] >= confidence for o in rules)
    assert ("w:casino",) in rules or ("w:win",) in rules


def test_few_rows_make_rules_at_any_size(spark):
    """Ten blocked pages of a host are enough, five are not, and a ninth that is allowed among ten is too many."""
    make = lambda host, n: [f"http://{host}.org/de/{i}" for i in range(n)]
    urls = make("bad-one", 10) + make("few-two", 5) + make("mixed-three", 10) + make("fine", 300)
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = df.select("page_id", (F.col("url").rlike("bad|few") | (F.col("url").rlike("mixed") & ~F.col("url").endswith("/9") & ~F.col("url").endswith("/8"))).alias("block"))
    got = {r["host"] for r in u.judge(df, labels, seed_words=()).where("verdict = 'block'").collect()}
    assert got == {"bad-one.org"}


def test_long_urls_ties_and_other_columns(spark):
    long = "http://casino-win.org/" + "/".join(f"p{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(2000))
    rows = [(i, f"http://casino-win.org/x{'y' * (i % 3)}", 1, "t", None) for i in range(30)] + [(100, long, 1, "t", None)] + [(200 + i, f"http://ok{chr(97 + i % 9)}.org/", 1, "t", None) for i in range(90)]
    df = spark.createDataFrame(rows, "page_id long, url string, block int, tokens string, rule string")
    got = u.judge(df, df.where("page_id <> 100").select("page_id", (F.col("page_id") < 30).alias("block")), seed_words=()).collect()
    assert {r["page_id"] for r in got if r["verdict"] == "block"} == {*range(30), 100}
    # casino and win are blocked alike: the later name stands.
    assert {r["mined"] for r in got if r["verdict"] == "block"} == {"w:win"}


def test_empty_and_unlabelled(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert u.judge(df).count() == 0
    one = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    assert u.judge(one).first()["verdict"] == "allow"


def test_bounded_fit(spark):
    df = spark.createDataFrame([(i, f"http://{'spam' if i % 2 else 'fine'}.org/{chr(97 + i % 26)}{i}") for i in range(600)], "page_id long, url string")
    labels = df.select("page_id", (F.col("page_id") % 2 == 1).alias("block"))
    assert u.judge(df, labels, seed_words=(), max_labelled=200).where("verdict = 'block'").count() == 300


def naive_rules(bags, min_rows=6):
    """All item sets by trial: confident, and none within another. bags: (tokens, block)."""
    total, blocked = len(bags), sum(b for _, b in bags)
    count = lambda s: (sum(b for t, b in bags if s <= t), sum(s <= t for t, _ in bags))

    def good(hits, n):
        p = hits / n if n else 0
        return hits >= min_rows and p >= u.MIN_CONFIDENCE and (p + 1.96**2 / (2 * n) - 1.96 * (p * (1 - p) / n + 1.96**2 / (4 * n * n)) ** 0.5) / (1 + 1.96**2 / n) >= u.MIN_BOUND

    tokens = sorted(set().union(*(t for t, _ in bags)))
    out = [frozenset([t]) for t in tokens if good(*count({t}))]
    rest = [t for t in tokens if frozenset([t]) not in out and (c := count({t}))[0] >= min_rows and c[0] * total >= blocked * c[1]]
    for k in range(2, len(rest) + 1):
        frequent = [frozenset(s) for s in combinations(rest, k) if count(set(s))[0] >= min_rows]
        if not frequent:
            break
        out += [s for s in frequent if good(*count(s)) and not any(o < s for o in out)]
    return set(out)


def test_combinations_are_mined(spark):
    """Blocked if and only if both path words are there: neither word is a rule, the pair is."""
    rows = [(i, f"http://h{i % 7}.org/{'aa/' if i % 2 else 'cc/'}{'bb' if i // 2 % 2 else 'dd'}/{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = u.judge(df, df.select("page_id", ((F.col("page_id") % 2 == 1) & (F.expr("page_id div 2 % 2") == 1)).alias("block")), seed_words=())
    assert got.where("(verdict = 'block') <> (path like '/aa/bb/%')").count() == 0
    assert {r["mined"] for r in got.where("mined is not null").collect()} == {"p:aa+p:bb"}


def test_mined_rules_are_complete(spark):
    """Against the miner by trial: every variant of a rule that takes one token of each item, and no other."""
    for seed in range(3):
        rng = random.Random(seed)
        bags = []
        for _ in range(160):
            t = {x for x in "abcdefg" if rng.random() < 0.45}
            t |= {"e2", "e3"} if "e" in t else set()
            bad = ({"a", "b"} <= t and rng.random() < 0.97) or ({"c", "d", "e"} <= t) or ("g" in t and "f" in t and rng.random() < 0.5)
            bags.append((frozenset(t), bad))
        df = spark.createDataFrame([(sorted(t), b) for t, b in bags], "tokens array<string>, block boolean")
        rules = u.mine_rules(df).collect()
        got = set()
        for r in rules:
            variants = [frozenset()]
            for alike in r["alike"]:
                variants = [v | {t} for v in variants for t in alike]
            got |= set(variants)
            assert (r["hits"], r["n"]) == (sum(b for t, b in bags if set(r["rule"]) <= t), sum(set(r["rule"]) <= t for t, _ in bags))
        # Two tokens of one item add nothing to each other.
        alike = [{"e", "e2", "e3"}]
        want = {s for s in naive_rules(bags) if not any(len(s & a) > 1 for a in alike)}
        assert got == want and any(len(s) == 2 for s in got)


def test_equal_long_urls_are_one_item(spark):
    """Six equal blocked URLs of 200 tokens, all of them in allowed URLs too: folded, no power set."""
    long = [f"p{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    rows = [(sorted(["w:x", *long]), True)] * 6 + [(sorted(["w:y", *long]), False)] * 2 + [(["w:x"], False)] * 3 + [(["w:z"], False)] * 40
    start = time.time()
    rules = u.mine_rules(spark.createDataFrame(rows, "tokens array<string>, block boolean")).collect()
    assert time.time() - start < 60
    assert [(r["rule"], [len(a) for a in r["alike"]], r["hits"], r["n"]) for r in rules] == [([max(long), "w:x"], [200, 1], 6, 6)]
