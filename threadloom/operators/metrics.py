"""Quality of predictions, and agreement of annotators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import running_sum


def class_report(rows: DataFrame) -> DataFrame:
    """rows: gold, predicted. Precision, recall, F1 and support per label, then macro avg, weighted avg and accuracy."""
    long = rows.select(F.explode(F.array(F.struct(F.col("gold").alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p"), (F.col("gold") == F.col("predicted")).cast("int").alias("t")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).alias("t")))).alias("x")).select("x.*")
    own = long.groupBy("label").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("g").alias("support"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    own = own.withColumns({"precision": ratio(F.col("t"), F.col("p")), "recall": ratio(F.col("t"), F.col("support"))})
    own = own.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    names = ("precision", "recall", "f1")
    macro = own.agg(F.lit("macro avg").alias("label"), *[F.avg(c).alias(c) for c in names], F.sum("support").alias("support"))
    weighted = own.agg(F.lit("weighted avg").alias("label"), *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names], F.sum("support").alias("support"))
    accuracy = own.agg(F.lit("accuracy").alias("label"), *[(F.sum("t") / F.sum("support")).alias(c) for c in names], F.sum("support").alias("support"))
    return own.select("label", *names, "support").unionByName(macro).unionByName(weighted).unionByName(accuracy)


def errors(rows: DataFrame) -> DataFrame:
    return rows.where("gold <> predicted")


def roc_auc(rows: DataFrame) -> DataFrame:
    """rows: score, label 0 or 1. By the rank sum; ties share. Scores are counted first and summed by ranges."""
    counts = rows.groupBy("score").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    below = running_sum(counts, ["score"], F.col("neg"), "_below")
    return below.agg((F.sum(F.col("pos") * (F.col("_below") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def majority(votes: DataFrame, min_votes: int = 3, min_share: float = 0.0) -> DataFrame:
    """votes: key, label. The most frequent label (ties: the first by name) where it has the votes and the share."""
    counts = votes.groupBy("key", "label").agg(F.count("*").alias("n"))
    best = counts.groupBy("key").agg(F.min_by(F.struct("label", "n"), F.struct(-F.col("n"), "label")).alias("b"), F.sum("n").alias("total"))
    return best.select("key", F.col("b.label").alias("label"), F.col("b.n").alias("votes"), "total").where((F.col("votes") >= min_votes) & (F.col("votes") >= min_share * F.col("total")))


def kappa_pairs(votes: DataFrame) -> DataFrame:
    """votes: worker, key, label, once per worker and key. Cohen's kappa of every two workers that share items."""
    other = votes.select(F.col("worker").alias("worker2"), "key", F.col("label").alias("label2"))
    both = votes.join(other, "key").where("worker < worker2")
    pairs = both.groupBy("worker", "worker2").agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("label2")).cast("double")).alias("po"))
    one = both.groupBy("worker", "worker2", "label").agg(F.count("*").alias("a"))
    two = both.groupBy("worker", "worker2", F.col("label2").alias("label")).agg(F.count("*").alias("b"))
    chance = one.join(two, ["worker", "worker2", "label"]).groupBy("worker", "worker2").agg(F.sum(F.col("a").cast("double") * F.col("b")).alias("_ab"))
    out = pairs.join(chance, ["worker", "worker2"], "left").withColumn("pe", F.coalesce("_ab", F.lit(0.0)) / (F.col("n") * F.col("n")))
    return out.select("worker", "worker2", "n", F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def average_kappa(votes: DataFrame) -> DataFrame:
    return kappa_pairs(votes).where("kappa between -1 and 1").agg(F.avg("kappa").alias("kappa"), F.count("*").alias("pairs"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column)


def drop_controls(rows: DataFrame, golden: str = "golden") -> DataFrame:
    """Only real tasks: those without a golden answer."""
    return rows.where(F.col(golden).isNull() | (F.col(golden) == ""))


def thread_pairs(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs: first_url, second_url, quality (OK or BAD). labels: url, thread_id. gold and predicted of the pairs whose
    documents both have a thread."""
    one = pairs.join(labels.select(F.col("url").alias("first_url"), F.col("thread_id").alias("_t1")), "first_url")
    two = one.join(labels.select(F.col("url").alias("second_url"), F.col("thread_id").alias("_t2")), "second_url")
    return two.select("first_url", "second_url", F.col("quality").alias("gold"), F.when(F.col("_t1") == F.col("_t2"), "OK").otherwise("BAD").alias("predicted"))


def missing_pairs(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of which a document has no thread."""
    urls = labels.select("url")
    a = pairs.join(urls, pairs["first_url"] == urls["url"], "left_anti")
    b = pairs.join(urls, pairs["first_url"] == urls["url"], "left_semi").join(urls, F.col("second_url") == urls["url"], "left_anti")
    return a.unionByName(b)
