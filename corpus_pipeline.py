"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next
one. All but the last return the columns of ``documents``. Null texts and texts without words pass through the first
four stages; the mix takes none of their (zero) words. Null ids and sources stay. Repeated rows are copies of each other, so
one of them stays after the second stage; of rows alike in id and text but not in other columns it is any one. Ties between
copies: the least id stays; ties in the mix: by id, then size. Texts are read whole at any length. Empty table: no rows.
Further columns pass through, whatever their names; names that start with ``__pii_``,
``__near_``, ``__gone_`` or ``__corpus_`` are taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import decontaminate, jaccard, mixing, pii, quality, toxicity
from threadloom.llm.common import cut, table, word_count


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on labelled ones, scores under its threshold."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word Jaccard links of 0.8 or more connect: the one with the least doc_id."""
    return jaccard.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets replaced by their kind; n_chars follows the text where it changed."""
    out = pii.redact(docs.withColumn("__corpus_before", F.length("text")))
    changed = F.length("text") != F.col("__corpus_before")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, source_size, target, epochs, drawn and taken. A document's quality weight
    is two for lines that pass the quality rules, down to a half for none."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    scored = docs.withColumn("__corpus_lines", lines)
    good = F.size(F.filter("__corpus_lines", lambda x: ~quality.line_fails(x)))
    weight = 0.5 + 1.5 * good / F.greatest(F.size("__corpus_lines"), F.lit(1))
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "source"))
    return mixing.mix(scored, word_count(F.col("text")), weight, carry=carry).where("taken > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("pii", redact_pii),
    ("mixing", mix_sources),
]

#: The learned stages and the near-copy join have no SQL form; a test in tests/llm holds the run over whole tables against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
