"""Quality rules: line-first cleaning, in DataFrame functions only.

Each line is judged by punctuation, navigation and boilerplate rules; failing lines are removed, and a document that
loses too much of its text with them is rejected. Beside that stand whole-document counts and the base rule on them.

Scale: everything about a document is computed within its row; there is no shuffle. Repeated 8-word windows are found by
sorting window hashes within the row, and only in rows where a hash set shows that some window repeats.

Defined cases: null or blank text: all counts 0, fails the base rule, cleaned text empty. Lines without a word are
neither kept nor lost. Texts of any length are read whole. Repeated rows are judged each. Empty table: no rows. Other
columns of the input pass through; those named like a result of ``judge`` give way to it, and names that start with ``__quality_``
are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, table

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A document may lose this share of its characters with its failing lines.
MAX_LOST = 0.5

#: Phrases of lines that belong to a site rather than to its text.
BOILERPLATE = (
    r"(?i)(?:all rights reserved|licensed under|terms of (?:use|service)|privacy policy|cookie|enable javascript|"
    r"subscribe (?:now|to)|sign (?:in|up)|log ?in|share (?:this|on)|copyright|\(c\) ?\d{4}|©)"
)
#: A boilerplate phrase condemns a line of at most so many words.
BOILERPLATE_WORDS = 25


def _at_least(line: Column, n: int) -> Column:
    return line.rlike(rf"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){{{n - 1}}}[^\x20\x09-\x0D]")


def line_fails(line: Column) -> Column:
    """True where a line breaks a rule. The shares are per word, so that long and short lines are judged alike.

    Punctuation: at most a third of the words may end in doubled marks or symbols, and a line of under five words must end
    a sentence. Navigation: separators standing between at least a quarter of the words, three at least. Boilerplate: a
    short line with such a phrase. Each costly test stands behind a cheap one that it implies.
    """
    words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    loud = F.regexp_count(line, F.lit(r"(?:[!?]{2,}|[#*$%&]{2,})(?=[\x20\x09-\x0D]|$)"))
    bars = F.regexp_count(line, F.lit(r"(?<=^|[\x20\x09])[|»›>·•/](?=[\x20\x09]|\r?$)"))
    ended = line.rlike(r"""[.!?…:;。！？]["'”’»)\]]*[\x20\x09\x0B-\x0D]*$""")
    return (
        (line.rlike(r"[!?]{2}|[#*$%&]{2}") & (loud * 3 > words))
        | (~_at_least(line, 5) & ~ended)
        | (line.rlike("[|»›>·•/]") & (bars >= 3) & (bars * 4 >= words - bars))
        | (~_at_least(line, BOILERPLATE_WORDS + 1) & line.rlike(BOILERPLATE))
    )


def _covered(order: Column) -> Column:
    """order: (hash, position) of all windows, sorted. Words in windows whose hash occurs again."""
    last = F.size(order) - 1
    at = F.filter(
        F.transform(order, lambda s, k: F.when(((k > 0) & (F.get(order, k - 1)["h"] == s["h"])) | ((k < last) & (F.get(order, k + 1)["h"] == s["h"])), s["p"])),
        lambda p: p.isNotNull(),
    )
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + F.least(F.lit(WINDOW), p + WINDOW - a["end"])).alias("n"))
    return F.aggregate(F.array_sort(at), start, step, lambda a: a["n"])


def judge(docs: DataFrame, max_lost: float = MAX_LOST, clean: bool = False) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost_chars, base_failed, kept; with ``clean``,
    cleaned_text too. The input needs a text column."""
    text = F.coalesce("text", F.lit(""))
    n = F.size("__quality_hashes")
    pairs = lambda a, k: F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - k, F.lit(0))), F.slice(a, k + 1, F.greatest(F.size(a) - k, F.lit(0))), lambda x, y: F.xxhash64(x, y))
    # Each layer is used several times by the next one, so that the optimizer keeps them apart and computes each once.
    zero = docs.withColumns({"__quality_words": F.filter(F.split(text, BLANK), lambda w: w != ""), "__quality_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    one = zero.withColumns({"__quality_hashes": F.transform("__quality_words", lambda w: F.xxhash64(w)), "word_chars": F.length(F.array_join("__quality_words", "")).cast("long")}).drop("__quality_words")
    twos = one.withColumns({
        "n_words": n,
        # Hashes of 8 words, by doubling: of 2, of 4, of 8.
        "__quality_twos": pairs(F.col("__quality_hashes"), 1),
        "__quality_good": F.filter("__quality_lines", lambda x: ~line_fails(x)),
        "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_dup_lines": (F.size("__quality_lines") - F.size(F.array_distinct("__quality_lines"))).cast("long"),
        "__quality_chars": F.length(F.array_join("__quality_lines", "")),
    }).drop("__quality_hashes", "__quality_lines")
    two = twos.withColumn("__quality_fours", pairs(F.col("__quality_twos"), 2)).drop("__quality_twos").withColumn("__quality_windows", pairs(F.col("__quality_fours"), 4)).drop("__quality_fours")
    repeats = F.size(F.array_distinct("__quality_windows")) < F.size("__quality_windows")
    three = two.withColumns({
        "__quality_order": F.when(repeats, F.array_sort(F.transform("__quality_windows", lambda h, p: F.struct(h.alias("h"), p.alias("p"))))),
        "n_lost_chars": (F.col("__quality_chars") - F.length(F.array_join("__quality_good", ""))).cast("long"),
    }).drop("__quality_windows")
    four = three.withColumns({"n_repeat_words": F.coalesce(_covered(F.col("__quality_order")), F.lit(0)).cast("long"), "n_words": F.col("n_words").cast("long")})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = four.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("n_lost_chars") <= max_lost * F.col("__quality_chars")))
    if clean:
        out = out.withColumn("cleaned_text", F.array_join("__quality_good", "\n"))
    return out.drop("__quality_order", "__quality_good", "__quality_chars")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_chars", "base_failed", "kept"
    )
