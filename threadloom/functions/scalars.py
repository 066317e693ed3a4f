"""Scalar functions over columns."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..config import RatingDefaults
from ..schema import CATEGORIES

_R = RatingDefaults()


def host_of(url: Column) -> Column:
    """Host of an http(s) URL without ``www.``; empty where the URL does not match as a whole."""
    return F.coalesce(F.regexp_extract(url, r"^(?:http|https)://(?:www\.)?([^/ :]+):?[^/ ]*/?[^ #?]*\x3f?[^ #]*#?[^ ]*$", 1), F.lit(""))


def clean_file_name(name: Column) -> Column:
    return F.substring_index(name, "/", -1)


def sigmoid(x: Column) -> Column:
    """In the form that never overflows."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


_ISO = r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})([+\-])(\d{2}):(\d{2})$"


def iso_to_epoch(date: Column) -> Column:
    """Strict ISO-8601 with a numeric zone to epoch seconds, not below 0; null where it does not parse."""
    part = lambda i: F.regexp_extract(date, _ISO, i).try_cast("int")
    day = F.to_date(F.when(date.rlike(_ISO), F.try_to_timestamp(F.regexp_extract(date, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd"))))
    local = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86400 + part(4) * 3600 + part(5) * 60 + part(6)
    zone = (part(8) * 3600 + part(9) * 60) * F.when(F.regexp_extract(date, _ISO, 7) == "+", 1).otherwise(-1)
    return F.when(local.isNotNull(), F.greatest(local - zone, F.lit(0).cast("long")))


def nasty(title: Column, lang: Column) -> Column:
    """Titles that are short (in bytes), end in a mark or blank, begin with a quote, or have under three words."""
    size = F.octet_length(title)
    return (
        ((lang == "en") & (size < 16)) | ((lang == "ru") & (size < 30)) | F.substring(title, -1, 1).isin("!", "?", ".", " ")
        | title.startswith('"') | (F.length(title) - F.length(F.replace(title, F.lit(" "), F.lit(""))) < 2)
    )


def unknown_symbols(title: Column) -> Column:
    """Share of characters that are neither ASCII nor basic Cyrillic above one half: the plain form."""
    bad = F.length(F.regexp_replace(title, r"[\x00-\x7FА-я]", ""))
    return 2 * bad > F.length(title)


@F.pandas_udf(BooleanType())
def unknown_symbols_bytes(title: pd.Series) -> pd.Series:
    """The same by a scan over bytes in which a foreign two-byte letter counts its second byte once more."""

    def scan(text: str) -> bool:
        data, total, bad, i = text.encode(), 0, 0, 0
        while i < len(data):
            lead = data[i]
            if lead < 128:
                total, i = total + 1, i + 1
                continue
            width = 4 if lead >= 240 else 3 if lead >= 220 else 2
            if width > 2:
                total, bad, i = total + 1, bad + 1, i + width
                continue
            if i + 1 >= len(data):
                break
            known = (lead == 0xD0 and data[i + 1] >= 0x90) or (lead == 0xD1 and data[i + 1] <= 0x8F)
            total, bad, i = total + 1, bad + (not known), i + 1 + known
        return 2 * bad > total

    return title.fillna("").map(scan)


def language_decision(label: Column, probability: Column, foreign: Column, border: float = 0.4, ru_border: float = 0.6) -> Column:
    """The language that stands after a classifier's best label: null below the border, ``other`` for foreign titles,
    unsure Russian and labels outside the set."""
    return F.when(probability < border, None).when(foreign, "other").when((label == "ru") & (probability < ru_border), "other").when(label.isin("ru", "en", "de", "fr", "es"), label).otherwise("other")


def category_name(ordinal: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(c) for c in CATEGORIES]), ordinal), F.lit("undefined"))


def category_ordinal(name: Column) -> Column:
    """Unknown names are the first ordinal."""
    return F.greatest(F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.coalesce(name, F.lit(""))) - 1, F.lit(0)).cast("int")


def traffic_score(kind: Column, raw: Column, us: Column, gb: Column, ru: Column, shift: Column, lang: Column | None = None) -> Column:
    """Weight of a source. kind: one, raw or log. Where the log's argument is not positive, the floor holds."""
    coeff = (100.0 - us - gb) / 100.0
    if lang is not None:
        coeff = F.when(lang == "en", coeff).otherwise(ru)
    inner = raw * coeff + shift
    return F.when(kind == "one", 1.0).when(kind == "raw", raw * coeff).otherwise(F.when(inner > 0, F.greatest(F.log(inner), F.lit(_R.log_floor))).otherwise(_R.log_floor))


def headline_weight(pagerank: Column, relevance: Column, fetch_time: Column, freshest: Column, is_nasty: Column) -> Column:
    return (pagerank + relevance) * sigmoid((fetch_time - freshest) / 3600.0 + 12.0) * F.when(is_nasty, 0.5).otherwise(1.0)


def start_contribution(weight: Column, start: Column, other: Column, decay: Column) -> Column:
    return weight * sigmoid(F.greatest((start - other) / decay, F.lit(-15.0)))


def age_penalty(best_time: Column, now: Column, window: Column) -> Column:
    """1 inside the window; beyond it a sigmoid that starts just below 1."""
    return F.when(best_time + window < now, sigmoid((best_time + window - now) / 3600.0 + 8.0)).otherwise(1.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit_vector(v: Column) -> Column:
    """Scaled to length 1; vectors of no length stay."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 1e-8, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def pair_distance(a: Column, b: Column) -> Column:
    """(1 - cosine) / 2, not below 0; 1 where a vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 1e-16, F.greatest(1.0 - (dot(a, b) / norm + 1.0) / 2.0, F.lit(0.0))).otherwise(1.0)


def time_penalty(distance: Column, t1: Column, t2: Column) -> Column:
    """Distances of documents a day or more apart grow with the days, to 1 at most."""
    hours = F.abs(t1 - t2) / 3600.0
    return F.least(distance * F.when(hours >= 24, hours / 24.0).otherwise(1.0), F.lit(1.0))


def ttl_seconds(header: Column) -> Column:
    """``max-age=N`` to N (its eight first characters are not looked at), ``no-cache`` to -1, else null."""
    digits = F.regexp_extract(F.substring(header, 9, 1000), r"^\s*([+\-]?\d{1,9})", 1)
    return F.when(header == "no-cache", F.lit(-1).cast("long")).when(digits != "", digits.try_cast("long"))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, and single other signs."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), 0)


def plain_tokens(text: Column, max_words: int | None = None) -> Column:
    """Split at blanks, runs of blanks as one, cut after ``max_words``."""
    words = F.filter(F.split(text, " +"), lambda w: w != "")
    return F.slice(words, 1, max_words) if max_words else words


def index_tokens(words: Column, vocabulary: dict[str, int]) -> Column:
    """Vocabulary indexes of few tokens, 0 for unknown ones; join the vocabulary instead where it is large."""
    table = F.create_map(*[F.lit(x) for kv in vocabulary.items() for x in kv]) if vocabulary else None
    return F.transform(words, lambda w: F.coalesce(table[w], F.lit(0)) if table is not None else F.lit(0))


def preprocess(text: Column) -> Column:
    """Trimmed, line ends and no-break spaces to blanks, lower-cased, tokenised, joined by blanks."""
    return F.array_join(tokens(F.translate(F.trim(text), "\n ", "  ")), " ")


def clean_text(text: Column) -> Column:
    """Tabs and line ends to blanks, double quotes dropped."""
    return F.translate(text, '\t\n\r"', "   ")


def normal_url(url: Column) -> Column:
    """Without scheme, ``www.``, fragment and final slash; host lower-cased."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"^[A-Za-z]+://", ""), "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/?]*)", 1)), r"^www\.", "")
    return F.regexp_replace(F.concat(host, F.regexp_extract(rest, "^[^/?]*(.*)$", 1)), "/+$", "")


def find_date(text: Column) -> Column:
    return F.regexp_extract(text, r"(\d{4}[/\-]\d{2}[/\-]\d{2})", 1)


def halves(text: Column) -> Column:
    """Struct of the first and second half of the words."""
    words = plain_tokens(text)
    n = F.floor(F.size(words) / 2).cast("int")
    return F.struct(F.array_join(F.slice(words, 1, n), " ").alias("first"), F.array_join(F.slice(words, n + 1, F.size(words) - n), " ").alias("second"))


def short_date(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "d MMM HH:mm")


def shrink(paragraphs: Column, max_words: int = 200) -> Column:
    """Paragraphs up to and with the one that reaches ``max_words``, each with a line end."""
    count = lambda p: F.size(F.filter(F.split(p, r"\s+"), lambda w: w != ""))
    begin = F.struct(F.lit(0).alias("n"), F.lit("").alias("t"))
    step = lambda a, p: F.when(a["n"] >= max_words, a).otherwise(F.struct((a["n"] + count(p)).alias("n"), F.concat(a["t"], p, F.lit("\n")).alias("t")))
    return F.aggregate(paragraphs, begin, step)["t"]


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
