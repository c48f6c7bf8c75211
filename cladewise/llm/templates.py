"""Boilerplate lines, found with a log-template tree of fixed depth.

A line goes down the tree by its number of tokens and its ``LEADING`` first
tokens; tokens with a digit are variable fields from the start. The lines of a
leaf are counted by position and token. A position keeps its commonest token if
half of the leaf's documents have it there and is a variable field otherwise;
this is the leaf's template. Lines agreeing with enough of its fixed tokens
belong to it, and any other line is a template of its own. A template that stands
in ``least_docs`` different texts or more recurs, and its lines are dropped.

Exact copies of a text count once, so copied documents make none of their lines
recur. A document that would lose more than half of its characters is a near
copy of others and no carrier of boilerplate: it is left whole for near-duplicate
removal. Lines of fewer than ``LEAST_TOKENS`` tokens and blank lines stay.

This is the query op5. The pipeline's stage, ``drop_boilerplate``, judges by other
rules. A leaf holds any number of templates: of the tokens behind the leading ones
a line may have ``1 - REST_AGREE`` as variable fields, those that fewest texts of
the leaf have at that place, and lines that then say the same form a template.
This is repeated on the lines left over until nothing recurs any more. The
support of a line or template is the number of near-duplicate groups, as the
next stage takes them, whose texts have it, so copies do not make each other's
lines recur and no text is left whole. The longer a line, the fewer groups it
needs (``SUPPORT``); scripts without spaces are measured by characters. Lines
without a letter outside of variable fields are layout or data and stay.

All counts are sums that the map tasks begin, so a leaf, line or token that a
third of all documents share is no more than one row of each task.

Null and empty texts stay as they are, as do all other columns. Rows are judged by
their text alone, so ids may be null or repeat. Empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladewise.llm import neardup
from cladewise.llm.common import passing, stored, unused
from cladewise.llm.quality import let

LEADING = 4
LEAST_TOKENS = 3
LEAST_DOCS = 10
FIELD = "<*>"
#: White space within lines, and a token with a digit.
BLANK = r"[\x09\x0B-\x0D]"
WITH_DIGIT = r"(?<![^\x20\n])[^\x20\n0-9]*+[0-9][^\x20\n]*+"
#: A leaf's template needs this share of fixed positions, and a line this share of agreement with them.
FIXED = 0.5
AGREE = 0.8
MOST_LOSS = 0.5
#: The stage: share of the tokens behind the leading ones that a template has fixed, words and the groups
#: that lines of as many need; shorter lines need ``MOST_SUPPORT``.
REST_AGREE = 0.7
SUPPORT = [(40, 2), (16, 3), (3, 10)]
MOST_SUPPORT = 50
#: Tokens longer than this on average are no words; so many characters count as one then.
LONG_TOKEN = 12
WORD_CHARS = 4
#: A table of this size at most, counted first, is sent to all executors.
BROADCAST_ROWS = 500_000


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def masked_lines(docs: DataFrame) -> DataFrame:
    """``t, pos, said``: the text a line is in, its number, and its tokens with one space or more between them.

    Tokens with a digit are variable fields. Texts are hashed and masked before their
    lines become rows, so the work follows the characters, however many lines a text has.
    """
    masked = F.regexp_replace(F.regexp_replace("text", BLANK, " "), WITH_DIGIT, FIELD)
    texts = docs.where(F.col("text") != "").select(text_key(F.col("text")).alias("t"), masked.alias("masked"))
    return texts.select("t", F.posexplode(F.split("masked", "\n")).alias("pos", "said"))


def tokens(said: Column) -> Column:
    return F.array_remove(F.split(said, " "), "")


def leaf_and_line(w: Column) -> list[Column]:
    n = F.size(w)
    return [F.xxhash64(n, F.slice(w, 1, LEADING)).alias("leaf"), F.xxhash64(n, w).alias("line")]


def parsed_lines(docs: DataFrame) -> DataFrame:
    """``t, pos, leaf, line, said``: the text a line is in, its number, its leaf and what it says, as a hash and in full."""
    found = masked_lines(docs).select("t", "pos", "said", tokens(F.col("said")).alias("w"))
    return found.where(F.size("w") >= LEAST_TOKENS).select("t", "pos", *leaf_and_line(F.col("w")), "said")


def small(df: DataFrame) -> DataFrame:
    """A broadcast where the counted rows, of a few numbers each, allow it; else Spark shuffles."""
    return sent_if_small(stored(df))


def sent_if_small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def recurring(parsed: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``line, template``: the lines of all templates that stand in ``least_docs`` texts or more."""
    lines = stored(parsed.groupBy("leaf", "line").agg(F.count_distinct("t").alias("docs")))
    leaves = small(
        lines.groupBy("leaf").agg(F.sum("docs").alias("leaf_docs"), F.count("*").alias("n_lines")).where(
            F.col("leaf_docs") >= least_docs
        )
    )
    # Leaves of one line need no tokens: the line is the template.
    mixed = leaves.where("n_lines > 1").select("leaf", "leaf_docs")
    said = (
        parsed.join(mixed, "leaf")
        .groupBy("leaf", "leaf_docs", "line")
        .agg(F.first("said").alias("said"))
        .select("leaf", "leaf_docs", "line", tokens(F.col("said")).alias("tokens"))
    )
    weighed = stored(said.join(lines.select("line", "docs"), "line"))
    cells = weighed.select(
        "leaf", "leaf_docs", "line", "docs", F.size("tokens").alias("n"), F.posexplode("tokens").alias("at", "token")
    )
    fixed = (
        cells.groupBy("leaf", "leaf_docs", "n", "at", "token")
        .agg(F.sum("docs").alias("d"))
        .where((F.col("token") != FIELD) & (2 * F.col("d") > F.col("leaf_docs")))
        .select("leaf", "at", F.col("token").alias("fixed_token"))
    )
    n_fixed = fixed.groupBy("leaf").agg(F.count("*").alias("n_fixed"))
    agreeing = (
        cells.join(fixed, ["leaf", "at"])
        .where(F.col("token") == F.col("fixed_token"))
        .groupBy("leaf", "line", "n")
        .agg(F.count("*").alias("agree"))
        .join(n_fixed, "leaf")
        .where((F.col("n_fixed") >= FIXED * F.col("n")) & (F.col("agree") >= AGREE * F.col("n_fixed")))
        .select("line", F.col("leaf").alias("template"))
    )
    of_lines = (
        lines.join(leaves.select("leaf"), "leaf", "left_semi")
        .join(agreeing, "line", "left")
        .select("line", F.coalesce("template", "line").alias("template"))
    )
    of_lines = small(of_lines)
    seen = parsed.select("t", "line").join(of_lines, "line")
    kept = seen.groupBy("template").agg(F.count_distinct("t").alias("docs")).where(F.col("docs") >= least_docs)
    return of_lines.join(kept.select("template"), "template", "left_semi").select("line", "template")


def sized_lines(docs: DataFrame) -> DataFrame:
    """``t, pos, leaf, line, n, need, said`` of the lines with a letter: ``n`` tokens, and the support that makes them recur."""
    speaking = masked_lines(docs).where(F.col("said").rlike(r"\p{L}"))
    found = speaking.select("t", "pos", "said", tokens(F.col("said")).alias("w"))
    n, chars = F.size("w"), F.length(F.regexp_replace("said", " ", ""))
    words = F.when(chars > LONG_TOKEN * n, F.greatest(n, chars / WORD_CHARS)).otherwise(n)
    need = F.lit(MOST_SUPPORT)
    for least, groups in reversed(SUPPORT):
        need = F.when(words >= least, groups).otherwise(need)
    return found.select("t", "pos", *leaf_and_line(F.col("w")), n.alias("n"), need.alias("need"), "said")


def of_templates(said: DataFrame, seen: DataFrame) -> DataFrame:
    """``leaf, line``: the lines of ``said`` (``leaf, line, docs, need, tokens``) whose template recurs among them."""
    cells = said.select("leaf", "line", "docs", F.posexplode("tokens").alias("at", "token")).where(
        (F.col("at") >= LEADING) & (F.col("token") != FIELD)
    )
    place = F.xxhash64("leaf", "at", "token")
    common = small(cells.groupBy(place.alias("place")).agg(F.sum("docs").alias("d")))
    every = Window.partitionBy("line")
    rarest = every.orderBy("d", "at")
    masked = cells.select("line", "at", place.alias("place")).join(common, "place").select(
        "line",
        (F.row_number().over(rarest) - 1).alias("fields"),
        F.count("*").over(every).alias("rest"),
        # The places and tokens that stay fixed when the cells before this one are fields.
        F.bit_xor("place").over(every).bitwiseXOR(F.bit_xor("place").over(rarest)).bitwiseXOR(F.col("place")).alias("fixed"),
    )
    keyed = stored(
        masked.where(F.col("fields") <= F.floor((1 - REST_AGREE) * F.col("rest") + 1e-9))
        .join(said.select("leaf", "line", "docs", "need"), "line")
        .select(F.xxhash64("leaf", "fixed").alias("template"), "leaf", "line", "docs", "need")
    )
    often = keyed.groupBy("template").agg(F.sum("docs").alias("most"), F.max("need").alias("need"))
    often = often.where(F.col("most") >= F.col("need")).select("template", "need")
    keyed = small(keyed.select("template", "leaf", "line").join(often, "template"))
    kept = (
        seen.join(keyed, "line")
        .groupBy("template", "need")
        .agg(F.count_distinct("g").alias("groups"))
        .where(F.col("groups") >= F.col("need"))
    )
    return keyed.join(kept.select("template"), "template", "left_semi").select("leaf", "line").distinct()


def text_groups(docs: DataFrame) -> DataFrame:
    """``t, g``: the near-duplicate group of each text with words."""
    with passing(docs.sparkSession) as keep:
        labels = neardup.labelled(docs, neardup.STAGE).where("label is not null")
        return keep(labels.groupBy(F.col("tie").alias("t")).agg(F.xxhash64(F.min("label")).alias("g")))


def boilerplate(parsed: DataFrame, groups: DataFrame) -> DataFrame:
    """``line``: the lines that recur, or whose template does, in enough near-duplicate groups (``t, g``).

    Each round of templates looks only at leaves that lost lines in the round before,
    as no other leaf can form another template, and reads tables written for it.
    """
    seen = stored(parsed.join(sent_if_small(groups), "t").select("g", "leaf", "line", "n", "need").distinct())
    lines = stored(seen.groupBy("leaf", "line", "n", "need").agg(F.count("*").alias("docs")))
    # Lines of fewer tokens have no room for a variable field.
    roomy = lines.where(F.floor((1 - REST_AGREE) * (F.col("n") - LEADING) + 1e-9) >= 1)
    mixed = roomy.groupBy("leaf").agg(
        F.sum("docs").alias("all"), F.count("*").alias("n_lines"), F.min("need").alias("least"), F.max(F.col("docs") < F.col("need")).alias("open")
    )
    mixed = mixed.where((F.col("n_lines") > 1) & (F.col("all") >= F.col("least")) & F.col("open")).select("leaf")
    open_lines = small(roomy.join(mixed, "leaf", "left_semi").select("line", "docs"))
    left = stored(
        parsed.join(open_lines, "line")
        .groupBy("leaf", "line", "docs", "need")
        .agg(F.first("said").alias("said"))
        .select("leaf", "line", "docs", "need", tokens(F.col("said")).alias("tokens"))
    )
    seen = seen.select("g", "line")
    rounds = []
    while not (more := stored(of_templates(left, seen))).isEmpty():
        rounds.append(more.select("line"))
        left = stored(
            left.join(more.select("leaf").distinct(), "leaf", "left_semi").join(more, "line", "left_anti")
        )
    found = lines.where(F.col("docs") >= F.col("need")).select("line")
    return reduce(DataFrame.union, rounds, found).distinct()


def places(parsed: DataFrame, lines: DataFrame) -> DataFrame:
    """``t, places``: the numbers of the given lines in each text that has some."""
    return parsed.join(small(lines), "line").groupBy("t").agg(F.collect_set("pos").alias("places"))


def cut(docs: DataFrame, drops: DataFrame, most_loss: float, counts: bool = False) -> DataFrame:
    """The rows without the lines at ``places``; those that would lose more than a share of ``most_loss`` stay as they are.

    Places come with a row for each text, too many to be sent to all executors, so texts are
    shuffled once at every size.
    """
    key, drop_name, short_name = (unused(docs, k) for k in ("_key", "_drop", "_short"))
    drops = drops.select(F.col("t").alias(key), F.col("places").alias(drop_name)).hint("merge")
    joined = docs.join(drops, text_key(F.col("text")) == F.col(key), "left")
    parts, drop, short = F.split("text", "\n"), F.col(drop_name), F.col(short_name)

    def shorter(ls: Column) -> Column:
        # By a hash set, so the work follows the lines and not lines times dropped ones.
        stay = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), drop)
        rest = F.transform(stay, lambda i: F.get(ls, i))
        return let(rest, lambda r: F.struct(F.array_join(r, "\n").alias("text"), F.size(r).alias("n")))

    found = joined.withColumn(short_name, F.when(drop.isNotNull(), let(parts, shorter)))
    loses = F.length("text") - F.length(short["text"])
    dropped = F.coalesce(loses <= most_loss * F.length("text"), F.lit(False))
    columns = [
        F.when(dropped, short["text"]).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c)
        for c in docs.columns
    ]
    if counts:
        n = F.when(F.col("text").isNotNull(), F.size(parts)).otherwise(0)
        columns += [
            n.cast("long").alias("lines_before"),
            F.when(dropped, n - short["n"]).otherwise(0).cast("long").alias("lines_dropped"),
        ]
    return found.select(*columns)


def drop_recurring(docs: DataFrame, least_docs: int = LEAST_DOCS, counts: bool = False) -> DataFrame:
    """The rows with their recurring lines taken out of ``text``; with ``counts`` also ``lines_before`` and ``lines_dropped``."""
    with passing(docs.sparkSession) as keep:
        parsed = stored(parsed_lines(docs))
        drops = keep(places(parsed, recurring(parsed, least_docs).select("line").distinct()))
    return cut(docs, drops, MOST_LOSS, counts)


def drop_boilerplate(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: the rows without the lines of recurring templates, whatever their share of a text."""
    with passing(docs.sparkSession) as keep:
        # The tables of the groups are gone before the lines are stored.
        groups = text_groups(docs)
        parsed = stored(sized_lines(docs), "zstd")
        drops = keep(places(parsed, boilerplate(parsed, groups)))
    return cut(docs, drops, 1.0)
