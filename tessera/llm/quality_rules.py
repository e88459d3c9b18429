"""Line-first cleaning with built-in functions only.

Rules look at one line at a time: a line goes if it has no closing punctuation, looks like navigation, holds boilerplate
or is mostly symbols. A document is rejected when it fails the base limits or when its lines lose too much of its text.

Defined results: null or blank text counts as no words and is rejected (fewer than 20 words); null doc_id is carried
through; repeated rows give repeated results; an empty table gives an empty result; columns other than doc_id and text are
ignored, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, table

SYMBOLS = "[#*$%&|<>]"
#: What is trimmed from lines.
BLANKS = " \t\n\x0b\x0c\r"
#: A line must end in one of these, closing quotes and brackets allowed after it.
CLOSING = "[.!?\\u2026:;\\u3002\\uFF01\\uFF1F][\"'\\u00BB\\u201D\\u2019)\\]]*$"
NAVIGATION = "[|>\\u00BB\\u2022\\u00B7\\u2192]"
BOILERPLATE = [
    "cookie policy", "accept cookies", "accept all cookies", "privacy policy", "terms of use", "terms of service",
    "all rights reserved", "enable javascript", "click here", "sign in", "log in", "subscribe now", "lorem ipsum",
    "share this", "read more",
]
WINDOW = 8


def _distinct_gap(values: str) -> Column:
    return F.size(values) - F.size(F.array_distinct(values))


def _contains_any(text: Column) -> Column:
    low, out = F.lower(text), F.lit(False)
    for phrase in BOILERPLATE:
        out = out | F.contains(low, F.lit(phrase))
    return out


def line_kept(line: Column, marked: Column, phrased: Column) -> Column:
    """True where a line passes all line rules. marked, phrased: whether its document has any symbol or phrase at all."""
    words = F.size(F.split(F.trim(line, F.lit(BLANKS)), f"{SPACE}+"))
    marks = F.regexp_count(line, F.lit(NAVIGATION))
    symbols = F.regexp_count(line, F.lit(SYMBOLS))
    return (
        F.substring(F.rtrim(line, F.lit(BLANKS)), -4, 4).rlike(CLOSING)
        & (~marked | ((marks * 4 < words) & (symbols * 10 <= F.length(line))))
        & (~phrased | ~line.rlike("(?i)\\b(" + "|".join(BOILERPLATE) + ")\\b"))
    )


def _no_spaces(text: Column) -> Column:
    for c in (" ", "\n", "\t", "\r", "\x0b", "\x0c"):
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _doubled(hashes: str, step: int) -> Column:
    """Hash of each element with the one `step` places on; the last ones, without a partner, are cut off later."""
    return F.zip_with(hashes, F.slice(hashes, F.lit(step + 1), F.size(hashes)), lambda x, y: F.xxhash64(x, y))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, _lines (with a word) and the base measures of each text."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t"))
    split = base.select(
        "doc_id",
        F.filter(F.split("_t", f"{SPACE}+"), lambda w: w != "").alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("_lines"),
        F.length(_no_spaces(F.col("_t"))).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.col("_t").rlike("[#*$%&|<>\\u00BB\\u2022\\u00B7\\u2192]").alias("_marked"),
        _contains_any(F.col("_t")).alias("_phrased"),
    )
    hashed = split.select(
        "doc_id", "_lines", "_marked", "_phrased", "word_chars", "n_symbols",
        F.size("_w").cast("long").alias("n_words"),
        _distinct_gap("_lines").cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    # pairs, fours, eights: three hashes per word give every window; only texts in which one returns pay for the sort
    pairs = hashed.withColumn("_h", _doubled("_h", 1))
    fours = pairs.withColumn("_h", _doubled("_h", 2))
    windows = fours.withColumn(
        "_win", F.when(F.col("n_words") > WINDOW, F.slice(_doubled("_h", 4), F.lit(1), F.size("_h") - (WINDOW - 1)))
    ).drop("_h")
    repeated = windows.withColumn(
        "_sorted",
        F.when(
            F.size("_win") > F.size(F.array_distinct("_win")),
            F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop("_win")
    starts = repeated.withColumn(
        "_starts",
        F.sort_array(
            F.filter(
                F.transform(
                    "_sorted",
                    lambda x, j: F.when(
                        (x["h"] == F.get("_sorted", j - 1)["h"]) | (x["h"] == F.get("_sorted", j + 1)["h"]), x["i"]
                    ),
                ),
                lambda p: p.isNotNull(),
            )
        ),
    ).drop("_sorted")
    return starts.select(
        "doc_id", "_lines", "_marked", "_phrased", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(
            F.aggregate(
                F.transform("_starts", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", j + 1) - p, F.lit(WINDOW)))),
                F.lit(0), lambda a, x: a + x,
            ), F.lit(0),
        ).cast("long").alias("n_repeat_words"),
    )


def clean(docs: DataFrame, max_lost: float = 0.5, keep_text: bool = True) -> DataFrame:
    """Measures, the verdict and, with keep_text, the cleaned text of each document.

    max_lost: share of the characters in non-blank lines that may go with the failing lines.
    """
    m = measures(docs)
    marked = m.withColumn("_ok", F.filter("_lines", lambda x: line_kept(x, F.col("_marked"), F.col("_phrased"))))
    chars = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    counted = marked.withColumn("line_chars", chars(F.col("_lines"))).withColumn("kept_chars", chars(F.col("_ok")))
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    out = counted.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("line_chars") - F.col("kept_chars") <= F.col("line_chars") * max_lost)
    )
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    extra = [F.size("_lines").alias("n_lines"), F.size("_ok").alias("n_lines_kept")]
    if keep_text:
        extra.append(F.array_join("_ok", "\n").alias("clean_text"))
    return out.select(*cols, *extra)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
