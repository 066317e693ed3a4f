"""URL filters: association rules over URL tokens, in DataFrame functions and Spark's FP-growth only.

URLs become token sets. A token that is confident enough by itself is a rule, and sets that contain it need no other. The
tokens that are left and blocked more than the average are folded into items, those that occur in exactly the same labelled
URLs into one, and FP-growth mines the item sets that at least ``min_rows`` blocked URLs share. Each is a rule ``set => block``,
counted over all labelled URLs and pruned by confidence and by the lower bound of its confidence interval; a rule
that contains a rule goes. The rest match through an inverted index: each rule is filed under its rarest item, and a URL's
items (any token of an item will do: in what was learned from they come together) look it up. Stated host and path rules come
first; the mined ones judge what no stated rule fits.

Scale: mining reads at most about ``max_labelled`` labelled rows (a documented bound on a fit; rows are taken by hash of
their URL, alike on every run). Without folding, six equal URLs of k tokens are 2**k sets; with it they are one item. There
is no cap on a set's length. Counting and matching are done once for each distinct token
set: URLs of one host and shape share one, so a hot host is one row before the index join, and is met again only in a join
that Spark can split.

Defined cases: null URL or no ``://``: empty host and path, no tokens, no rule, allowed. No labelled rows, or none
blocked: no mined rules. Very long URLs are tokenised whole, and a set has each token once. Ties between rules that fit: more
confidence, then more blocked rows, then the later name. Repeated pages are judged each. Empty table: no rows. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: The stated rules: host suffix, path prefix, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

#: Host words that label a page as one to block.
SEED_WORDS = ("ads", "track", "adult", "bets", "casino", "pills", "spam", "porn", "viagra", "lottery")

#: A rule rests on so many blocked rows at least, and on so much confidence, measured and at the lower end of its 95 % interval.
MIN_ROWS = 6
MIN_CONFIDENCE, MIN_BOUND = 0.9, 0.6
#: How much oftener than the average a token must be blocked to enter combinations.
MIN_LIFT = 1.0
MAX_LABELLED = 2_000_000

_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), *_LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def stated_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest stated rule that fits, or null. A rule's path is compared from the start."""
    found = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        made = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, made) if found is None else found.when(fits, made)
    return found


def url_tokens(host: Column, path: Column, url: Column) -> Column:
    """Sorted distinct tokens: words of the host, words of the path, query keys. Runs of digits become
    one ``0``, so that serial numbers make no items of their own."""
    words = lambda kind, text, sep: F.transform(F.filter(F.split(F.regexp_replace(F.lower(text), "[0-9]+", "0"), sep), lambda w: w != ""), lambda w: F.concat(F.lit(kind), w))
    keys = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), 1)
    return F.array_sort(F.array_distinct(F.concat(words("w:", host, r"[.\-]"), words("p:", path, r"[/._\-]+"), F.transform(keys, lambda k: F.concat(F.lit("q:"), F.lower(k))))))


def lower_bound(hits: Column, n: Column, z: float = 1.96) -> Column:
    """The lower end of Wilson's interval for a share."""
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def fitting(sets: DataFrame, rules: DataFrame, *kept: str) -> DataFrame:
    """sets: tokens (distinct rows), items. rules: rule array<string>, filed (one of its items). All pairs of a set and a rule
    within its items, with the kept columns of both, by the inverted index."""
    looked = sets.withColumn("filed", F.explode("items")).join(rules, "filed")
    return looked.where(F.size(F.array_except("rule", "items")) == 0).select("tokens", "rule", *kept)


def itemised(sets: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """sets: tokens (distinct rows), ... vocabulary: token, item. Adds items (sorted, each once); sets without any go."""
    found = sets.select("tokens", F.explode("tokens").alias("token")).join(vocabulary, "token").groupBy("tokens").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return sets.join(found, "tokens")


def frequent_sets(bags: DataFrame, min_rows: int) -> DataFrame:
    """bags: items, n. The item sets of two and more that at least ``min_rows`` rows share, a bag counting as n: rule."""
    rows = cut(bags.where("size(items) > 1").select("items", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("_k")).select("items"))
    n = max(rows.count(), 1)
    # A little under the count, so that rounding up gives it.
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (min_rows - 0.5) / n)).fit(rows)
    return model.freqItemsets.where("size(items) > 1").select(F.array_sort("items").alias("rule"))


def mine_rules(labelled: DataFrame, min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE, min_bound: float = MIN_BOUND, min_lift: float = MIN_LIFT) -> DataFrame:
    """labelled: tokens array<string>, block boolean. Returns rules, none within another: rule (sorted items, each named by its last token), alike
    (of each item, its tokens), filed, hits, n, confidence."""
    # One row for each token set: what is counted below does not follow a hot host.
    sets = cut(labelled.groupBy("tokens").agg(F.count("*").alias("n"), F.sum(F.col("block").cast("long")).alias("hits")))
    rows, blocked = sets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("hits"), F.lit(0))).first()
    good = (F.col("hits") >= min_rows) & (F.col("hits") / F.col("n") >= min_confidence) & (lower_bound(F.col("hits"), F.col("n")) >= min_bound)
    # Where a token occurs, as two sums of hashes and a count: equal for tokens of the same sets.
    where = [F.bit_xor(F.xxhash64("tokens", F.lit(k))).alias(f"_w{k}") for k in (1, 2)] + [F.count(F.lit(1)).alias("_w")]
    each = sets.select(F.explode("tokens").alias("token"), "tokens", "n", "hits")
    single = cut(each.groupBy("token").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), *where).withColumn("own", good))
    one = single.where("own").select(F.array("token").alias("rule"), F.array(F.array("token")).alias("alike"), F.col("token").alias("filed"), "hits", "n", (F.col("hits") / F.col("n")).alias("confidence"))
    if blocked < min_rows:
        return one
    enters = ~F.col("own") & (F.col("hits") >= min_rows) & (F.col("hits") * rows >= min_lift * blocked * F.col("n"))
    folded = single.where(enters).groupBy("_w1", "_w2", "_w").agg(F.max("token").alias("item"), F.array_sort(F.collect_list("token")).alias("tokens"), F.max("n").alias("_n"))
    folded = cut(folded.select("item", "tokens", "_n"))
    with_items = cut(itemised(sets, folded.select(F.explode("tokens").alias("token"), "item")))
    found = frequent_sets(with_items.where("hits > 0").groupBy("items").agg(F.sum("hits").alias("n")), min_rows)
    filed = found.select("rule", F.explode("rule").alias("item")).join(folded.select("item", "_n", "tokens"), "item")
    filed = filed.groupBy("rule").agg(F.min_by("item", F.struct("_n", "item")).alias("filed"), F.transform(F.array_sort(F.collect_list(F.struct("item", "tokens"))), lambda x: x["tokens"]).alias("alike"))
    sums = fitting(with_items, cut(filed), "n", "hits", "filed", "alike").groupBy("rule", "alike", "filed").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    many = cut(sums.where(good).withColumn("confidence", F.col("hits") / F.col("n")))
    inside = many.select("rule", F.explode("rule").alias("filed")).join(many.select(F.col("rule").alias("_part"), "filed"), "filed")
    inside = inside.where((F.size("_part") < F.size("rule")) & (F.size(F.array_except("_part", "rule")) == 0)).select("rule").distinct()
    return cut(one.unionByName(many.join(inside, "rule", "left_anti")))


def match_rules(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """sets: distinct ``tokens``. Returns those that a rule fits, with the strongest rule (mined) and its confidence."""
    vocabulary = rules.select(F.explode(F.arrays_zip("rule", "alike")).alias("e")).select(F.col("e.rule").alias("item"), F.explode("e.alike").alias("token")).distinct()
    best = F.max(F.struct("confidence", "hits", F.array_join("rule", "+").alias("mined")))
    return fitting(itemised(sets, vocabulary), rules, "confidence", "hits").groupBy("tokens").agg(best.alias("_b")).select("tokens", "_b.mined", "_b.confidence")


def judge(pages: DataFrame, labels: DataFrame | None = None, rules=RULES, seed_words=SEED_WORDS, min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """pages: page_id, url. labels: page_id, block. Returns page_id, host, path, rule, verdict, mined, confidence.

    A page whose host holds a seed word is labelled block; where a page has several labels, block wins.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parts = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    parts = parts.select("page_id", "host", "path", F.when(F.col("host") != "", url_tokens(F.col("host"), F.col("path"), F.col("url"))).alias("tokens"), F.xxhash64("url").alias("_h"), stated_rule(F.col("host"), F.col("path"), rules).alias("_s"))
    parts = cut(parts)
    seeds = F.arrays_overlap("tokens", F.array(*[F.lit("w:" + w) for w in seed_words]))
    known = parts.where("tokens is not null").select("page_id", "tokens", "_h", seeds.alias("_seed"))
    if labels is not None:
        marks = labels.where("page_id is not null and block is not null").groupBy("page_id").agg(F.max("block").alias("_block"))
        known = known.join(marks, "page_id", "left")
    else:
        known = known.withColumn("_block", F.lit(None).cast("boolean"))
    known = cut(known.where("_seed or _block is not null").select("tokens", "_h", (F.col("_seed") | F.coalesce("_block", F.lit(False))).alias("block")))
    n = known.count()
    if n > max_labelled:
        known = known.where(F.pmod("_h", F.lit(1 << 30)) < int((1 << 30) * max_labelled / n))
    mined = mine_rules(known, min_rows, min_confidence) if n else None
    sets = parts.where("tokens is not null and _s is null").select("tokens").distinct()
    if mined is None:
        hits = sets.limit(0).select("tokens", F.lit("").alias("mined"), F.lit(0.0).alias("confidence"))
    else:
        # Written, so that the join with all pages reads two exchanges and Spark can split a hot token set.
        hits = cut(match_rules(sets, mined))
    out = parts.join(hits, "tokens", "left")
    own = F.when(F.col("_s").isNull() & F.col("mined").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("_s.rule").alias("rule"), F.coalesce(F.col("_s.verdict"), own).alias("verdict"), F.when(F.col("_s").isNull(), F.col("mined")).alias("mined"), F.when(F.col("_s").isNull(), F.col("confidence")).alias("confidence"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    marks = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("block"))
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), marks)
