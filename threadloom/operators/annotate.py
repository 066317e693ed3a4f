"""Annotation: host, language, category, nastiness. Classifiers are pluggable; two kinds come with the library."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AnnotatorConfig
from ..functions.scalars import host_of, language_decision, nasty, plain_tokens, preprocess, unknown_symbols

#: Frequent words by language.
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "with", "was", "for"),
    "de": ("der", "die", "und", "das", "ist", "von", "nicht", "mit", "den", "ein"),
    "fr": ("le", "la", "de", "et", "les", "des", "une", "que", "pour", "dans"),
    "es": ("el", "los", "que", "del", "las", "una", "por", "con", "para", "su"),
    "ru": ("и", "в", "не", "на", "что", "с", "по", "как", "это", "для"),
}
#: Words that speak for a category.
TOPIC_WORDS = {
    "society": ("police", "government", "president", "court", "law", "election"),
    "economy": ("market", "bank", "shares", "economy", "trade", "price"),
    "technology": ("software", "phone", "internet", "app", "google", "computer"),
    "sports": ("match", "team", "league", "coach", "goal", "season"),
    "entertainment": ("film", "music", "actor", "show", "album", "star"),
    "science": ("study", "scientists", "space", "research", "species", "planet"),
}


def lexicon_scores(words: Column, lexicon: dict[str, tuple[str, ...]]) -> Column:
    """Struct (label, probability): the label with most words of the lexicon (ties: the first by name) and its share."""
    counts = {k: _hits(words, v) for k, v in sorted(lexicon.items())}
    total = reduce(lambda a, b: a + b, counts.values())
    best = F.greatest(*[F.struct(c.alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("label")) for i, (k, c) in enumerate(counts.items())])
    return F.struct(F.when(total > 0, best["label"]).alias("label"), F.when(total > 0, best["n"] / total).otherwise(0.0).alias("probability"))


def _hits(words: Column, lexicon: tuple[str, ...]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*lexicon)))


def detect_language(docs: DataFrame) -> DataFrame:
    """Adds lang from title, description and the text's first 100 bytes (as characters)."""
    sample = F.concat_ws(" ", "title", "description", F.substring("text", 1, 100))
    scored = docs.withColumn("_s", lexicon_scores(plain_tokens(F.lower(F.translate(sample, "\n", " "))), STOP_WORDS))
    return scored.withColumn("lang", language_decision(F.col("_s.label"), F.col("_s.probability"), unknown_symbols(F.col("title")))).drop("_s")


def detect_category(docs: DataFrame) -> DataFrame:
    """Adds category by the lexicon; ``other`` without a word of it, ``not_news`` never: train a model for that."""
    words = plain_tokens(preprocess(F.concat_ws(" ", "title", "text")))
    return docs.withColumn("category", F.coalesce(lexicon_scores(words, TOPIC_WORDS)["label"], F.lit("other")))


def by_language(models: dict[str, dict[str, tuple[str, ...]]], default: dict[str, tuple[str, ...]] | None = None):
    """A category step with a lexicon for each language (others: the default one, or ``other``)."""

    def step(docs: DataFrame) -> DataFrame:
        words = plain_tokens(preprocess(F.concat_ws(" ", "title", "text")))
        label = lambda lexicon: lexicon_scores(words, lexicon)["label"]
        found = reduce(lambda a, kv: a.when(F.col("lang") == kv[0], label(kv[1])), models.items(), F.when(F.lit(False), F.lit("")))
        found = found.otherwise(label(default)) if default else found
        return docs.withColumn("category", F.coalesce(found, F.lit("other")))

    return step


def by_trained(models: dict[str, TrainedClassifier]):
    """A category step with a trained model for each language; documents of other languages get ``other``. Each model reads
    the rows of its language alone."""

    def step(docs: DataFrame) -> DataFrame:
        kept = docs.columns
        parts = [docs.where(~F.coalesce(F.col("lang").isin(*models), F.lit(False))).withColumn("category", F.lit("other"))]
        for lang, model in models.items():
            rows = docs.where(F.col("lang") == lang).withColumn("_text", F.col("text")).withColumn("text", F.translate(F.concat_ws(" ", "title", "text"), "\n", " "))
            parts.append(model.transform(rows).withColumn("text", F.col("_text")).withColumn("category", F.col("predicted")).select(*[c for c in kept if c != "category"], "category"))
        return reduce(DataFrame.unionByName, [parts[0].select(*parts[-1].columns), *parts[1:]])

    return step


class TrainedClassifier:
    """A bag-of-words logistic regression in Spark ML: fit on (text, label), adds label and probability."""

    def __init__(self, features: int = 1 << 14, iterations: int = 30):
        self.stages = [StringIndexer(inputCol="label", outputCol="_y", handleInvalid="skip"), HashingTF(inputCol="_words", outputCol="_x", numFeatures=features), LogisticRegression(featuresCol="_x", labelCol="_y", predictionCol="_p", probabilityCol="_q", rawPredictionCol="_r", maxIter=iterations)]
        self.model = None

    def _words(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_words", plain_tokens(preprocess(F.col("text"))))

    def fit(self, rows: DataFrame) -> TrainedClassifier:
        self.model = Pipeline(stages=self.stages).fit(self._words(rows))
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        out = self._words(rows)
        for stage in self.model.stages[1:]:
            out = stage.transform(out)
        names = F.array(*[F.lit(x) for x in self.model.stages[0].labels])
        return out.withColumns({"predicted": F.get(names, F.col("_p").cast("int")), "probability": F.array_max(vector_to_array("_q"))}).drop("_words", "_x", "_p", "_q", "_r")


def annotate(raw: DataFrame, cfg: AnnotatorConfig = AnnotatorConfig(), languages: tuple | None = None, mode: str = "top", language=detect_language, category=detect_category, embed=None) -> DataFrame:
    """Raw documents to annotated ones. ``languages`` mode groups by language and stops there; the others drop short
    texts, foreign languages and, unless kept, non-news, in front of any embedder."""
    docs = language(raw.withColumn("host", host_of(F.col("url"))))
    if mode == "languages":
        return docs
    docs = docs.where(F.col("lang").isin(*(languages or cfg.languages)) & (F.octet_length("text") >= cfg.min_text_length))
    docs = category(docs)
    docs = docs.where((F.col("category") != "not_news") | F.lit(cfg.save_not_news))
    if cfg.compute_nasty:
        docs = docs.withColumn("nasty", nasty(F.col("title"), F.col("lang")))
    if embed is not None:
        docs = embed.transform(docs)
    if not cfg.save_texts and mode != "json":
        docs = docs.drop("text", "description", "out_links")
    return docs
