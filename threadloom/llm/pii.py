"""PII: candidate gradient boosting, in DataFrame functions only.

Strict patterns find the base spans (email, ip, card, phone), which always stay. Wide generators propose further,
overlapping spans: address-like, key-like and number-like runs (kinds ``contact``, ``secret`` and ``number``). Strict evidence
labels some for training and for nothing else: an address that is well formed, a number that passes Luhn or is international,
a key after a credential word or with an issuer's prefix. Boosted trees learn from the labels how such candidates look, from
binned format and context features that leave out whatever the evidence itself reads. A threshold for each generator,
calibrated on scores that no candidate's own fold has learned, alone decides which candidates are added.

Scale: spans are found, described and scored within their document's row; nothing is shuffled but counts of feature
combinations. The fit uses all candidates of all documents through that table of counts, whose size the bins bound
(``BINS``), whatever the input. Trees become one CASE expression. Positions, overlaps and cuts come from folds over slices of
``SLICE`` elements, and texts are cut by blocks, so that the time for a text with very many spans follows its length.

Defined cases: null text: no spans, sha of the empty text. Texts are read whole. Overlapping base spans of different
kinds all stay; an added span that overlaps a base span is dropped, of two added ones that overlap the later-starting
(then the shorter) is. Repeated rows are judged each. No candidates, none with evidence, or no threshold precise enough: nothing is added to the base spans. Empty
table: no rows. Other columns pass through ``redact``, but names that start with ``__pii_pii_`` are taken.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: The strict patterns, written so that matching never goes back over a run: possessive runs, entered at their start or
#: where the last match ended. ``gate`` is a cheap test that every match implies.
BASE = {
    "email": (r"(?:(?<![A-Za-z0-9._%+\-])|\G)[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++", r"@[A-Za-z0-9\-]++\."),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]"),
    "card": (r"[0-9](?:[\x20\-]?[0-9])++", r"[0-9](?:[\x20\-]?[0-9]){12}"),
    "phone": (r"\+[0-9][\x20().0-9\-]+[0-9]", r"\+[0-9]"),
}
#: Wide generators: address-like, key-like, number-like.
WIDE = {
    "contact": (r"(?<![^\x20\t\n\r<>(),;\"'])[A-Za-z0-9._%+\-]++(?:\x20?[\[(]at[\])]\x20?|@)[A-Za-z0-9\-]++(?:(?:\x20?[\[(]dot[\])]\x20?|\.)[A-Za-z0-9\-]++)*+", r"@|[\[(]at[\])]"),
    "secret": (r"(?<![A-Za-z0-9_/+\-])(?=[A-Za-z_/+\-]*+[0-9])[A-Za-z0-9_/+\-]{16,}+={0,2}", r"[A-Za-z0-9_/+\-]{16}"),
    "number": (r"(?<![0-9A-Za-z])\+?+\(?+[0-9](?:[\x20().\-]{0,2}[0-9]){6,}+", r"[0-9](?:[\x20().\-]{0,2}[0-9]){6}"),
}
KINDS = ("email", "ip", "card", "phone", "contact", "number", "secret")

#: Words that tell what a following value is, and prefixes of issued keys.
CREDENTIAL = r"(?i)(?:pass(?:word|wd|phrase)?|token|secret|api[_\- ]?key|access[_\- ]?key|auth)[\"']?\x20?[=:]?\x20?[\"']?$"
CONTACT = r"(?i)(?:tel|phone|mobile|fax|call|mail|e-mail|contact)[.:]?\x20?$"
PAYMENT = r"(?i)(?:card|visa|iban|account|ssn|passport)[.:#]?\x20?$"
NUMBERING = r"(?i)(?:version|v|page|no|order|isbn|issn|doi|http[^\x20]*|id|ref)[.:#/]?\x20?$"
ISSUED = r"^(?:AKIA|ASIA|AIza|ghp_|gho_|glpat-|xox[abp]-|sk-|sk_live_|eyJ)"

#: How many values each feature has. ``turns`` is of keys only, ``groups`` of numbers only.
BINS = {"family": 3, "len": 6, "digits": 5, "case": 4, "hex": 2, "seps": 4, "variety": 4, "left": 4, "right": 3, "context": 5, "turns": 4, "groups": 6}
ROUNDS, RATE, RIDGE, PRECISION, LEAST, FOLDS = 12, 0.4, 1.0, 0.95, 10, 4
AROUND = 24
SLICE = 256


def _states(items: Column, zero: Column, step, kind: str) -> Column:
    """The fold's state before each element, as an array of ``kind``: first before each slice, then within. ``items`` must be
    a column that is made below, not an expression: it is read several times."""
    part = lambda k: F.slice(items, k * SLICE + 1, SLICE)
    none, begin = F.array().cast(f"array<{kind}>"), lambda at: F.struct(at.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    slices = F.sequence(F.lit(0), F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / SLICE).cast("int"))
    bounds = F.aggregate(slices, F.struct(zero.alias("at"), none.alias("out")), lambda a, k: F.struct(F.aggregate(part(k), a["at"], step).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]
    one = lambda at, k: F.aggregate(part(k), begin(at), lambda a, x: F.struct(step(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]
    return F.flatten(F.transform(bounds, one))


def _located(df: DataFrame, text: str, patterns: dict) -> DataFrame:
    """Adds ``__pii_s_<kind>``: array of (start, end, s, left, right) of the pattern's matches, in code points; left and right
    are what stands around a match, up to the next one."""
    t = F.col(text)
    df = df.withColumns({f"__pii_g_{k}": F.when(t.rlike(gate), F.split(t, p, -1)).otherwise(F.array().cast("array<string>")) for k, (p, gate) in patterns.items()})

    def pieces(k, p):  # split leaves one piece more than there are matches
        g = F.col(f"__pii_g_{k}")
        zipped = F.arrays_zip(g.alias("g"), F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0))).alias("after"), F.when(F.size(g) > 1, F.regexp_extract_all(t, F.lit(p), 0)).otherwise(F.array().cast("array<string>")).alias("s"))
        rows = F.transform(zipped, lambda x: F.struct(F.length(x["g"]).alias("gap"), F.length(x["s"]).alias("n"), x["s"].alias("s"), F.right(x["g"], F.lit(AROUND)).alias("left"), F.left(x["after"], F.lit(1)).alias("right")))
        return F.filter(rows, lambda x: x["s"].isNotNull())

    df = df.withColumns({f"__pii_z_{k}": pieces(k, p) for k, (p, _) in patterns.items()}).drop(*[f"__pii_g_{k}" for k in patterns])
    df = df.withColumns({f"__pii_o_{k}": _states(F.col(f"__pii_z_{k}"), F.lit(0), lambda a, x: a + x["gap"] + x["n"], "int") for k in patterns})
    spans = lambda k: F.zip_with(f"__pii_z_{k}", f"__pii_o_{k}", lambda x, o: F.struct((o + x["gap"]).alias("start"), (o + x["gap"] + x["n"]).alias("end"), x["s"].alias("s"), x["left"].alias("left"), x["right"].alias("right")))
    return df.withColumns({f"__pii_s_{k}": spans(k) for k in patterns}).drop(*[f"__pii_{c}_{k}" for c in "zo" for k in patterns])


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _card(s: Column) -> Column:
    return F.length(_digits(s)).between(13, 19) & F.call_function("luhn_check", _digits(s))


VALID = {
    "email": lambda s: F.lit(True),
    "ip": lambda s: s.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"),
    "card": _card,
    "phone": lambda s: F.length(_digits(s)).between(9, 15),
}


def _bin(x: Column, *edges) -> Column:
    return reduce(lambda a, i: a.when(x < edges[i], i), range(1, len(edges)), F.when(x < edges[0], 0)).otherwise(len(edges))


def _features(family: int, kind: str, x: Column) -> Column:
    """The candidate as a struct: span, whether strict evidence confirms it, its fold, and binned features. What the evidence
    of a kind reads is no feature of that kind."""
    whole, left, right = x["s"], x["left"], x["right"]
    confirmed = {
        "contact": whole.rlike(r"^[^@]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+$"),
        "secret": left.rlike(CREDENTIAL) | whole.rlike(ISSUED),
        "number": F.coalesce(_card(whole), F.lit(False)) | (whole.rlike(r"^\+") & F.length(_digits(whole)).between(9, 15)),
    }[kind]
    s = F.regexp_replace(whole, r"^\+", "") if kind == "number" else whole
    n, digits, letters = F.length(s), F.length(_digits(s)), F.length(F.regexp_replace(s, "[^A-Za-z]", ""))
    lower, upper = s.rlike("[a-z]"), s.rlike("[A-Z]")
    zero = F.lit(0)
    context = F.when(left.rlike(CONTACT), 2).when(left.rlike(PAYMENT), 3).when(left.rlike(NUMBERING), 4)
    context = zero if kind == "secret" else F.when(left.rlike(CREDENTIAL), 1).otherwise(context.otherwise(0))
    before = F.when((left == "") | left.rlike(r"[\x20\t\n\r]$"), 0).when(left.rlike("[\"'(<\\[]$"), 1).when(left.rlike("[=:]$"), 2).otherwise(3)
    return F.struct(
        F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), confirmed.alias("y"), (F.crc32(whole.cast("binary")) % FOLDS).cast("int").alias("fold"),
        F.lit(family).alias("family"), _bin(n, 8, 12, 16, 24, 40).alias("len"),
        F.when(digits == 0, 0).when(digits * 4 < n, 1).when(digits * 2 < n, 2).when(digits < n, 3).otherwise(4).alias("digits"),
        F.when(lower & upper, 3).when(upper, 2).when(lower, 1).otherwise(0).alias("case"), F.when(s.rlike("^[0-9a-fA-F]+$"), 1).otherwise(0).alias("hex"),
        (zero if kind == "contact" else F.least(n - digits - letters, F.lit(3))).alias("seps"),
        _bin(F.size(F.array_distinct(F.split(s, ""))), 6, 10, 14).alias("variety"),
        (zero if kind == "secret" else before).alias("left"),
        F.when((right == "") | right.rlike(r"[\x20\t\n\r.,;:!?]"), 0).when(right.rlike("[\"')>\\]]"), 1).otherwise(2).alias("right"),
        context.alias("context"),
        # Keys: how often letters and digits take turns. Numbers: how the digits are grouped.
        (_bin(F.regexp_count(s, F.lit("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")) * 8, n, 2 * n, 4 * n) if kind == "secret" else zero).alias("turns"),
        (_grouping(s) if kind == "number" else zero).alias("groups"),
    )


def _grouping(s: Column) -> Column:
    """One run, fours, a bracketed code, dates and years, threes and fours, or anything else."""
    g = F.when(s.rlike("^[0-9]+$"), 0).when(s.rlike(r"^[0-9]{4}(?:[\x20\-][0-9]{4})+$"), 1).when(s.rlike(r"^[0-9]{0,3}[\x20.\-]?\([0-9]+\)"), 2)
    return g.when(s.rlike(r"^(?:[0-9]{4}[.\-][0-9]{2}[.\-][0-9]{2}|[0-9]{2}[.\-][0-9]{2}[.\-][0-9]{4})"), 3).when(s.rlike(r"^(?:[0-9]{1,3}[\x20.\-])?[0-9]{3}[\x20.\-][0-9]{3,4}(?:[\x20.\-][0-9]{4})?$"), 4).otherwise(5)


def find(docs: DataFrame) -> DataFrame:
    """Adds ``__pii_base`` (array of kind, start, end: validated, by kind, then start) and ``__pii_wide`` (described candidates)."""
    df = _located(docs.withColumn("__pii_text", F.coalesce("text", F.lit(""))), "__pii_text", BASE | WIDE)

    def valid(k):
        good = F.filter(f"__pii_s_{k}", lambda x: F.coalesce(VALID[k](x["s"]), F.lit(False)))
        return F.transform(good, lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    def described(i, k):
        return F.transform(f"__pii_s_{k}", lambda x: _features(i, k, x))

    base, wide = F.concat(*[valid(k) for k in BASE]), F.concat(*[described(i, k) for i, k in enumerate(WIDE)])
    return df.withColumns({"__pii_base": base, "__pii_wide": wide}).drop("__pii_text", *[f"__pii_s_{k}" for k in BASE | WIDE])


def count_features(found: DataFrame) -> list:
    """Candidates counted by feature values, evidence and fold: all that the fit needs. The bins bound its rows."""
    names = list(BINS)
    return found.select(F.explode("__pii_wide").alias("c")).groupBy(*[F.col(f"c.{n}").alias(n) for n in names], F.col("c.y").alias("y"), F.col("c.fold").alias("fold")).agg(F.count("*").alias("n")).collect()


def _boost(on: np.ndarray, tests: list, y: np.ndarray, w: np.ndarray):
    """Depth-2 trees by Newton steps on the log loss: (start, trees, scores of all rows). on: one row per test."""
    rate = (w @ y + 1) / (w.sum() + 2)
    start = float(np.log(rate / (1 - rate)))
    score, trees = np.full(len(y), start), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        g, h = w * (y - p), w * p * (1 - p)

        def split(part, g=g, h=h):
            gi, hi = on @ (g * part), on @ (h * part)
            ga, ha = (g * part).sum(), (h * part).sum()
            return int(np.argmax(gi**2 / (hi + RIDGE) + (ga - gi) ** 2 / (ha - hi + RIDGE)))

        leaf = lambda part: float(RATE * (g * part).sum() / ((h * part).sum() + RIDGE))  # noqa: B023, E731
        a = split(np.ones(len(y), bool))
        tree = [tests[a]]
        for side in (on[a], ~on[a]):
            b = split(side)
            yes, no = leaf(side & on[b]), leaf(side & ~on[b])
            tree.append((tests[b], yes, no))
            score = score + np.where(side, np.where(on[b], yes, no), 0.0)
        trees.append(tree)
    return start, trees, score


class Trees:
    """Boosted trees over one-hot features, fitted to counts of all candidates, and a threshold for each generator. The
    thresholds are calibrated on scores by trees that were fitted without the candidate's fold. ``report``: for each generator,
    candidates, those with evidence, how many the threshold selects, and the share of these that have evidence."""

    def __init__(self, rows: list):
        names = list(BINS)
        self.trees, self.thresholds, self.start, self.report = [], {}, 0.0, {}
        if not any(r["y"] for r in rows):
            return
        x = np.array([[r[c] for c in names] for r in rows])
        y, fold, n = (np.array([float(r[c]) for r in rows]) for c in ("y", "fold", "n"))
        tests = [(f, v) for f, c in enumerate(names) for v in range(BINS[c])]
        on = np.array([x[:, f] == v for f, v in tests])
        self.start, self.trees, _ = _boost(on, tests, y, n)
        score = np.zeros(len(rows))
        for k in range(FOLDS):
            score[fold == k] = _boost(on, tests, y, n * (fold != k))[2][fold == k]
        for k, kind in enumerate(WIDE):
            # The lowest score above which candidates are confirmed often enough, in total and at that score.
            mine, best = x[:, 0] == k, None
            for s in sorted(set(np.round(score[mine], 6)), reverse=True):
                own = mine & (score >= s - 1e-6)
                at = own & (score <= s + 1e-6)
                total, right = (n * own).sum(), (n * own * y).sum()
                if total >= LEAST and right >= PRECISION * total and (n * at * y).sum() >= 0.5 * (n * at).sum():
                    best, found = float(s) - 1e-6, (int(total), float(right / total))
            if best is not None:
                self.thresholds[k] = best
            if mine.any():
                self.report[kind] = (int((n * mine).sum()), int((n * mine * y).sum()), *(found if best is not None else (0, None)))

    def selects(self, c: Column) -> Column:
        """Whether the candidate's score reaches its generator's threshold."""
        if not self.trees or not self.thresholds:
            return F.lit(False)
        names = list(BINS)
        test = lambda t: c[names[t[0]]] == t[1]
        one = lambda t: F.when(test(t[0]), F.when(test(t[1][0]), t[1][1]).otherwise(t[1][2])).otherwise(F.when(test(t[2][0]), t[2][1]).otherwise(t[2][2]))
        total = reduce(lambda a, t: a + one(t), self.trees, F.lit(self.start))
        bound = reduce(lambda a, k: a.when(c["family"] == k, self.thresholds[k]), list(self.thresholds)[1:], F.when(c["family"] == next(iter(self.thresholds)), next(iter(self.thresholds.values()))))
        return F.coalesce(total >= bound, F.lit(False))


def _with_added(df: DataFrame, trees: Trees) -> DataFrame:
    """Adds ``__pii_more``: selected candidates that no base span overlaps, each free of those before it (start, then the
    longest first), in order of start."""
    item = lambda x, base: F.struct(x["start"].alias("start"), F.lit(0 if base else 1).alias("added"), (-x["end"]).alias("last"), x["kind"].alias("kind"))
    chosen = F.transform(F.filter("__pii_wide", trees.selects), lambda x: item(x, False))
    df = df.withColumn("__pii_all", F.array_sort(F.concat(F.transform("__pii_base", lambda x: item(x, True)), chosen)))
    # Of base spans: the furthest end before a span, and the next start after it.
    df = df.withColumn("__pii_rev", F.reverse("__pii_all"))
    ends = _states(F.col("__pii_all"), F.lit(0), lambda a, x: F.when(x["added"] == 0, F.greatest(a, -x["last"])).otherwise(a), "int")
    nexts = F.reverse(_states(F.col("__pii_rev"), F.lit(2**31 - 1), lambda a, x: F.when(x["added"] == 0, F.least(a, x["start"])).otherwise(a), "int"))
    zipped = F.arrays_zip(F.col("__pii_all").alias("x"), ends.alias("end"), nexts.alias("next"))
    clear = F.filter(zipped, lambda z: (z["x"]["added"] == 1) & (z["end"] <= z["x"]["start"]) & (z["next"] >= -z["x"]["last"]))
    df = df.withColumn("__pii_clear", F.transform(clear, lambda z: z["x"]))
    taken = _states(F.col("__pii_clear"), F.lit(0), lambda a, x: F.when(x["start"] < a, a).otherwise(-x["last"]), "int")
    kept = F.filter(F.zip_with("__pii_clear", taken, lambda x, a: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), (-x["last"]).alias("end"), (x["start"] >= a).alias("stays"))), lambda x: x["stays"])
    return df.withColumn("__pii_more", F.transform(kept, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))).drop("__pii_all", "__pii_rev", "__pii_clear")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def with_spans(found: DataFrame, trees: Trees) -> DataFrame:
    """Adds ``__pii_spans``: base spans, then the added ones by kind and start."""
    return _with_added(found, trees).withColumn("__pii_spans", F.concat("__pii_base", F.array_sort("__pii_more"))).drop("__pii_more", "__pii_wide")


BLOCK = 1024


def redact(docs: DataFrame, trees: Trees | None = None) -> DataFrame:
    """docs with every span in text replaced by its kind in brackets (overlapping spans together by the first's kind).
    Columns, their order and other values stay. Fits trees on docs unless given some."""
    if trees is None:
        # Candidates are written before they are counted: exploding them in place would describe each of them twice.
        trees = Trees(count_features(cut(find(docs.select("text")).select("__pii_wide"))))
    df = with_spans(find(docs), trees)
    df = df.withColumn("__pii_order", F.array_sort(F.transform("__pii_spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))))
    ends = _states(F.col("__pii_order"), F.lit(0), lambda a, x: F.greatest(a, x["end"]), "int")
    df = df.withColumn("__pii_led", F.zip_with("__pii_order", ends, lambda x, a: F.struct(a.alias("before"), x["start"].alias("start"), x["kind"].alias("kind"))))
    # What is kept: from the furthest end so far to the start of a span that begins beyond it, and from the last end on.
    heads = F.filter("__pii_led", lambda x: x["start"] >= x["before"])
    last = F.struct(F.array_max(F.transform("__pii_order", lambda x: x["end"])).alias("before"), F.length("text").alias("start"), F.lit("").alias("kind"))
    blocks = F.when(F.size("__pii_order") > 0, F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{BLOCK}}}"), 0)).otherwise(F.array().cast("array<string>"))
    df = df.withColumns({"__pii_keep": F.concat(heads, F.array(last)), "__pii_blocks": blocks}).drop("__pii_order", "__pii_led")
    block = F.col("__pii_blocks")

    def between(a: Column, b: Column) -> Column:  # code points a to b, from the blocks that hold them
        of = lambda k: F.coalesce(F.get(block, F.least(k, F.size(block) - 1)), F.lit(""))
        inside = lambda k: F.substring(of(k), F.greatest(a - k * BLOCK, F.lit(0)) + 1, F.least(b - k * BLOCK, F.lit(BLOCK)) - F.greatest(a - k * BLOCK, F.lit(0)))
        first, final = F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")
        return F.when(b > a, F.array_join(F.transform(F.sequence(first, F.greatest(first, final)), inside), "")).otherwise("")

    made = F.array_join(F.transform("__pii_keep", lambda x: F.concat(between(x["before"], x["start"]), F.when(x["kind"] != "", F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(""))), "")
    return df.withColumn("text", F.when(F.size("__pii_spans") > 0, made).otherwise(F.col("text"))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    out = with_spans(found, Trees(count_features(found)))
    n = lambda k: F.size(F.filter("__pii_base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *[n(k) for k in BASE], F.sha2(_joined(F.col("__pii_base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("__pii_spans")).alias("spans"))
