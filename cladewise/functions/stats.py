"""Hypergeometric column p-values as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Arguments are raised by so much; from there on the series below is exact to double precision.
_SHIFT = 8


def _beyond_stirling(n: Column) -> Column:
    """What ln n! has beyond (n + 1/2) ln n - n + ln(2 pi) / 2, for n of 8 or more."""
    x = 1.0 / (n * n)
    inner = 1 / 1680 - x * (1 / 1188 - x * (691 / 360360))
    return (1 / 12 - x * (1 / 360 - x * (1 / 1260 - x * inner))) / n


def all_drawn(deck: Column, drawn: Column, wanted: Column) -> Column:
    """Chance that all ``drawn`` cards of a deck of ``deck`` are among ``wanted`` marked ones.

    Equals C(wanted, drawn) / C(deck, drawn), by Stirling's series for the four
    factorials. Their large terms are taken together before they are rounded, so
    the cost and the relative error stay small for groups of any size.
    """
    w, d = (wanted + _SHIFT).cast("double"), (deck + _SHIFT).cast("double")
    left, rest = w - drawn, d - drawn
    log = (
        drawn * F.log(w / d)
        - (left + 0.5) * F.log1p(-drawn / w)
        + (rest + 0.5) * F.log1p(-drawn / d)
        + (_beyond_stirling(w) - _beyond_stirling(left))
        - (_beyond_stirling(d) - _beyond_stirling(rest))
    )
    # The factors by which the raised factorials are too large.
    raised = F.aggregate(
        F.sequence(F.lit(0), F.lit(_SHIFT - 1)),
        F.lit(1.0),
        lambda p, k: p * ((left - k) / (w - k)) * ((d - k) / (rest - k)),
    )
    return (
        F.when(drawn == 0, F.lit(1.0))
        .when((wanted < drawn) | (wanted > deck), F.lit(0.0))
        .otherwise(F.exp(log) * raised)
    )


def column_pvalue(counts: Column, n_fg: Column, n_bg: Column) -> Column:
    """Chance of a split of the column's symbols between groups of the given sizes.

    ``counts`` holds the number of species per non-gap symbol. One group takes
    a single symbol, the other the remaining ones; with unequal sizes both
    roles count, and splits of one symbol against one other symbol are taken
    off when there are three or more symbols. With two symbols and unequal
    sizes each split stays counted twice.
    """
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda s, n: s + n)
    given = F.struct(
        counts.alias("counts"), total.alias("total"), n_fg.cast("bigint").alias("n_fg"), n_bg.cast("bigint").alias("n_bg")
    )
    # Bound in an array of one, as the loops below would compute them for every symbol.
    return F.element_at(
        F.transform(F.array(given), lambda g: _split_chance(g["counts"], g["total"], g["n_fg"], g["n_bg"])), 1
    )


def _split_chance(counts: Column, total: Column, n_fg: Column, n_bg: Column) -> Column:
    rest = total - n_fg
    factors = F.transform(
        counts,
        lambda n: F.struct(
            all_drawn(total, n_fg, n).alias("fg_one"),
            all_drawn(rest, n_bg, n).alias("bg_one"),
            all_drawn(total, n_fg, total - n).alias("fg_others"),
            all_drawn(rest, n_bg, total - n).alias("bg_others"),
        ),
    )

    def add(s: Column, x: Column) -> Column:
        return F.struct(
            (s["fg_converges"] + x["fg_one"] * x["bg_others"]).alias("fg_converges"),
            (s["bg_converges"] + x["fg_others"] * x["bg_one"]).alias("bg_converges"),
            (s["fg_one"] + x["fg_one"]).alias("fg_one"),
            (s["bg_one"] + x["bg_one"]).alias("bg_one"),
            (s["same"] + x["fg_one"] * x["bg_one"]).alias("same"),
        )

    def finish(s: Column) -> Column:
        one_against_one = s["fg_one"] * s["bg_one"] - s["same"]
        both = s["fg_converges"] + s["bg_converges"]
        return (
            F.when(n_fg == n_bg, s["fg_converges"])
            .when(F.size(counts) == 2, both)
            .otherwise(both - one_against_one)
        )

    names = ("fg_converges", "bg_converges", "fg_one", "bg_one", "same")
    zeros = F.struct(*[F.lit(0.0).alias(name) for name in names])
    return F.aggregate(factors, zeros, add, finish)
