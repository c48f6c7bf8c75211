"""Quality rules with thresholds that follow each language and source, in DataFrame functions only.

For every document the mean word length and the shares of symbols, repeated
lines and repeated words are computed. Their distributions are kept as quantile
sketches with logarithmic buckets: a sketch is a table of bucket counts, two
sketches merge by adding counts, and every quantile is exact to ``ACCURACY`` of
its value. Sketches are counted for each language and source, merged to
languages and to the whole corpus, and a group of fewer than ``LEAST_DOCS``
documents takes its language's thresholds, or else the corpus's. Documents are
then joined with the thresholds of their group.

Counts are added up in the map tasks, so a source with a third of all rows sends
no more buckets than another. Texts stay in their task: repeats are found by
sorting the windows of one text, without a shuffle.

A null text has no words. Null languages and sources are groups of their own.
Repeated rows count each; a null id is kept as it is; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladewise.llm.common import SPACE, stored

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
SPAN = 8

ACCURACY = 0.01
_LOG_GAMMA = math.log((1 + ACCURACY) / (1 - ACCURACY))
#: Bucket of the value 0, below all others.
_ZERO = -1_000_000
LEAST_DOCS = 100

#: A share may be so many times its third quartile, and always up to the floor:
#: where hardly any document has a symbol or a repeat, one more is no fault.
UPPER = {"symbols": (3.0, 0.10), "dup_lines": (3.0, 0.30), "repeats": (3.0, 0.20)}
#: The mean word length may lie so many quartile distances (as ratios) outside the quartiles.
FENCE = 4.0
#: Quartile distances count as at least this ratio.
LEAST_RATIO = 1.05


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once; an expression inside a lambda would be computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def word_array(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: without(x, BLANKS) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _covered(words: Column) -> Column:
    """Words inside windows that occur twice or more; exact, by sorting the windows themselves."""
    starts = F.sequence(F.lit(1), F.size(words) - (SPAN - 1))
    windows = F.sort_array(
        F.transform(
            starts, lambda i: F.struct(F.array_join(F.slice(words, i, SPAN), " ").alias("s"), i.alias("i"))
        )
    )

    def repeated(sorted_: Column) -> Column:
        def place(x: Column, k: Column) -> Column:
            before = F.get(sorted_, k - 1)["s"].eqNullSafe(x["s"])
            after = F.get(sorted_, k + 1)["s"].eqNullSafe(x["s"])
            return F.when(before | after, x["i"])

        return F.sort_array(F.filter(F.transform(sorted_, place), lambda p: p.isNotNull()))

    return F.aggregate(
        let(windows, repeated),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(
            (p + SPAN).alias("end"), (a["n"] + p + SPAN - F.greatest(p, a["end"])).cast("long").alias("n")
        ),
        lambda a: a["n"],
    )


def repeated_words(words: Column) -> Column:
    """Hashes of the windows show cheaply that most texts repeat nothing; the others are looked at exactly."""
    starts = F.sequence(F.lit(1), F.size(words) - (SPAN - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, SPAN)))
    some = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    none = F.lit(0).cast("long")
    return F.when(F.size(words) <= SPAN, none).otherwise(F.when(some, _covered(words)).otherwise(none))


def measures(docs: DataFrame) -> DataFrame:
    """Exact counts of every document, with its language and source."""
    text = F.coalesce(F.col("text"), F.lit(""))
    of_words = let(
        word_array(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")),
    )
    found = docs.select(
        "doc_id",
        "lang",
        "source",
        of_words.alias("w"),
        F.length(without(text, BLANKS)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        duplicate_lines(text).alias("n_dup_lines"),
        F.size(F.split(text, "\n")).cast("long").alias("n_lines"),
    )
    n_words, repeats = F.col("w.n_words"), F.col("w.n_repeat_words")
    return found.select(
        "doc_id",
        "lang",
        "source",
        n_words.alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        repeats.alias("n_repeat_words"),
        "n_lines",
        ((n_words < 20) | (100 * repeats > 30 * n_words)).alias("base_failed"),
    )


def ratios() -> dict[str, Column]:
    """The measures that thresholds are found for; every document with a word has them."""
    return {
        "word_length": F.col("word_chars") / F.col("n_words"),
        "symbols": F.col("n_symbols") / F.col("word_chars"),
        "dup_lines": F.col("n_dup_lines") / F.col("n_lines"),
        "repeats": F.col("n_repeat_words") / F.col("n_words"),
    }


def sketch(measured: DataFrame) -> DataFrame:
    """``lang, source, measure, bucket, n``: the sketches of all groups of documents that pass the base rules."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), v.alias("v")) for k, v in ratios().items())))
    bucket = F.when(F.col("p.v") > 0, F.ceil(F.ln("p.v") / _LOG_GAMMA)).otherwise(F.lit(_ZERO)).cast("long")
    return (
        measured.where(~F.col("base_failed") & (F.col("word_chars") > 0))
        .select("lang", "source", pairs.alias("p"))
        .groupBy("lang", "source", F.col("p.measure").alias("measure"), bucket.alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def merged(sketches: DataFrame, *keys: str) -> DataFrame:
    """Sketches of larger groups: counts are added."""
    return sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, *keys: str) -> DataFrame:
    """First and third quartile of each measure and the number of documents, one row for each group."""
    group = Window.partitionBy(*keys, "measure")
    ranked = sketches.select(
        *keys,
        "measure",
        F.when(F.col("bucket") == _ZERO, 0.0).otherwise(F.exp((F.col("bucket") - 0.5) * _LOG_GAMMA)).alias("v"),
        F.sum("n").over(group.orderBy("bucket")).alias("upto"),
        F.sum("n").over(group).alias("n"),
    )

    def quantile(measure: str, q: float) -> Column:
        reached = (F.col("measure") == measure) & (F.col("upto") >= F.ceil(F.col("n") * q))
        return F.min(F.when(reached, F.col("v")))

    found = [F.max("n").alias("n"), quantile("word_length", 0.25).alias("q1_word_length")]
    found += [quantile(k, 0.75).alias(f"q3_{k}") for k in ratios()]
    return ranked.groupBy(*keys).agg(*found)


def thresholds(measured: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """One row for each language and source with the bounds of each measure."""
    sketches = sketch(measured)
    own = quartiles(sketches, "lang", "source")
    by_lang = quartiles(merged(sketches, "lang"), "lang")
    corpus = quartiles(merged(sketches))
    values = [c for c in own.columns if c not in ("lang", "source")]

    def named(df: DataFrame, level: str) -> DataFrame:
        return df.select(*(F.col(k).alias(f"{level}_{k}") for k in df.columns))

    a, b, c = named(own, "a"), named(by_lang, "b"), named(corpus, "c")
    levels = a.join(b, F.col("a_lang").eqNullSafe(F.col("b_lang"))).join(F.broadcast(c.limit(1)), F.lit(True), "left")

    def pick(k: str) -> Column:
        return (
            F.when(F.col("a_n") >= least_docs, F.col(f"a_{k}"))
            .when(F.col("b_n") >= least_docs, F.col(f"b_{k}"))
            .otherwise(F.col(f"c_{k}"))
            .alias(k)
        )

    picked = levels.select(F.col("a_lang").alias("t_lang"), F.col("a_source").alias("t_source"), *map(pick, values))
    low, high = F.col("q1_word_length"), F.col("q3_word_length")
    stretch = F.pow(F.greatest(high / low, F.lit(LEAST_RATIO)), FENCE)
    upper = [F.greatest(F.col(f"q3_{k}") * f, F.lit(floor)).alias(f"most_{k}") for k, (f, floor) in UPPER.items()]
    return picked.select(
        "t_lang", "t_source", (low / stretch).alias("least_word_length"), (high * stretch).alias("most_word_length"), *upper
    )


def judge(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Counts, the base rule and the verdict for every row.

    The measured rows, some tens of bytes each, are stored once and read for the
    sketches and for the join. Groups without a document that passes the base
    rules have no thresholds, and no document to judge by them.
    """
    measured = stored(measures(docs))
    limits = thresholds(measured, least_docs)
    ratio = ratios()
    within = ratio["word_length"].between(F.col("least_word_length"), F.col("most_word_length"))
    for k in UPPER:
        within &= ratio[k] <= F.col(f"most_{k}")
    joined = measured.join(
        limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left"
    )
    return joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        F.when(F.col("base_failed"), False).otherwise(F.coalesce(within, F.lit(False))).alias("kept"),
    )
