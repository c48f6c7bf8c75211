"""Counters for many traits at once, and bounds on them word by word.

A membership word holds 64 traits, one bit each. Counting needs more bits a trait, so
a word is dealt to ``width`` words of 64 / ``width`` lanes: lane word r takes the traits
r, r + width, r + 2 * width and so on. Lane words are added as plain numbers, with
map-side combining, since the width leaves room for the greatest count and one bit
more. Adding what a bound lacks to that bit compares all lanes of a word at once;
the bits of all lane words, back at the traits' own places, mask the hit word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewise.functions.bounds import Bounds
from cladewise.operators.bitmaps import BITS, TraitBits
from cladewise.operators.columns import cells
from cladewise.schema import GAP

_BLOCK = ["set_id", "block"]
#: Positions that are added in lanes of 16 bits before they are added apart.
_CHUNK = 1 << 14


def lane_width(greatest: int) -> int:
    """Bits a lane needs for sums up to ``greatest``; the highest bit stays free, so sums never turn negative."""
    for width in (2, 4, 8, 16, 32):
        if greatest < 1 << (width - 1):
            return width
    raise ValueError(f"a count of {greatest} is too great for a lane of 32 bits")


def lanes(width: int) -> int:
    """The lowest bit of every lane."""
    return sum(1 << k for k in range(0, BITS, width))


def lane_words(word: str, width: int) -> list[str]:
    return [f"(shiftrightunsigned({word}, {r}) & {lanes(width)}L)" for r in range(width)]


def above(sums: list[str], bound: int, width: int) -> str:
    """The traits whose count, in summed lane words, is over the bound, at their places in a word.

    The highest lane is compared apart, as its free bit is the sign of the word.
    """
    if bound < 0:
        return "-1L"
    if bound >= (1 << (width - 1)) - 1:
        return "0L"
    top = BITS - width
    lower = (1 << top) - 1
    lacking = ((1 << (width - 1)) - 1 - bound) * (lanes(width) & lower)
    words = [
        f"shiftleft((shiftrightunsigned(({x} & {lower}L) + {lacking}L, {width - 1}) & {lanes(width) & lower}L)"
        f" | if(shiftrightunsigned({x}, {top}) > {bound}L, {1 << top}L, 0L), {r})"
        for r, x in enumerate(sums)
    ]
    return "(" + " | ".join(words) + ")"


def membership_words(bits: TraitBits) -> DataFrame:
    """``species, set_id, block, f, b``: a row for each block in which a species has a trait."""
    members = bits.groups.rows.join(bits.places, "trait")
    return members.groupBy("species", *_BLOCK).agg(
        F.expr("bit_or(if(grp = 1, shiftleft(1L, bit), 0L)) AS f"), F.expr("bit_or(if(grp = 0, shiftleft(1L, bit), 0L)) AS b")
    )


def accepted_blocks(
    columns: DataFrame, records: DataFrame, bits: TraitBits, bounds: Bounds, ragged: bool = False
) -> DataFrame:
    """Columns whose hit blocks keep only the traits within the bounds on gaps and missing members.

    A gapped member is in the gene without a symbol in the column; with whole records
    those cells are counted, with ragged ones the others, and taken from the members in
    the gene. Missing members are the trait's members less those in the gene.
    """
    if bounds.unlimited:
        return columns
    greatest = bits.places.agg(F.max(F.col("n_fg") + F.col("n_bg"))).first()[0] or 0
    width = lane_width(greatest)
    words = bits.groups.near(membership_words(bits))

    def counted(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        sums = [F.expr(f"sum({x}) AS {name}{s}{r}") for s in "fb" for r, x in enumerate(lane_words(s, width))]
        return rows.groupBy(*keys, *_BLOCK).agg(*sums)

    shown = cells(records).where(F.col("symbol") != GAP if ragged else F.col("symbol") == GAP)
    in_column = counted(shown.drop("symbol").join(words, "species"), ["gene", "pos"], "c")
    in_gene = counted(records.select("gene", "species").join(words, "species"), ["gene"], "g")
    in_trait = counted(words, [], "t")

    def gapped(place: str) -> str:
        return f"(coalesce(g{place}, 0L) - coalesce(c{place}, 0L))" if ragged else f"coalesce(c{place}, 0L)"

    def missing(place: str) -> str:
        return f"(t{place} - coalesce(g{place}, 0L))"

    rejected = []
    for kind, fg, bg, both in (
        (gapped, bounds.max_fg_gaps, bounds.background_gaps, bounds.max_gaps),
        (missing, bounds.max_fg_miss, bounds.background_miss, bounds.max_miss),
    ):
        of_fg, of_bg = ([kind(f"{side}{r}") for r in range(width)] for side in "fb")
        of_both = [f"({f} + {b})" for f, b in zip(of_fg, of_bg)]
        rejected += [above(x, bound, width) for x, bound in ((of_fg, fg), (of_bg, bg), (of_both, both)) if bound is not None]
    parts = ["set_id", "block", "hits", "fg_many", "bg_many"]
    carried = [c for c in columns.columns if c not in ("gene", "pos", "blocks")]
    blocks = columns.select("gene", "pos", *carried, F.explode_outer("blocks").alias("s")).select("gene", "pos", *carried, "s.*")
    if ragged or any(b is not None for b in (bounds.max_fg_gaps, bounds.max_bg_gaps, bounds.max_gaps)):
        blocks = blocks.join(in_column, ["gene", "pos", *_BLOCK], "left")
    if ragged or any(b is not None for b in (bounds.max_fg_miss, bounds.max_bg_miss, bounds.max_miss)):
        blocks = blocks.join(in_gene, ["gene", *_BLOCK], "left").join(bits.groups.near(in_trait), _BLOCK, "left")
    masked = blocks.withColumn("hits", F.expr(f"hits & ~({' | '.join(rejected)})"))
    # A column has a row for each of its hit blocks, and not one for each trait.
    kept = F.collect_list(F.when(F.col("hits") != 0, F.struct(*parts))).alias("blocks")
    return masked.groupBy("gene", "pos").agg(*(F.any_value(c).alias(c) for c in carried), kept).select(*columns.columns)


def hits_per_trait(columns: DataFrame, bits: TraitBits) -> DataFrame:
    """``trait, n_hits``: columns hit by each trait, zero included, from the hit words.

    At most ``_CHUNK`` columns of a gene are added in lanes of 16 bits; these sums are
    taken apart and added as whole numbers. No hit becomes a row.
    """
    width = 16
    chunks = (
        columns.select("gene", "pos", F.explode("blocks").alias("s"))
        .groupBy("gene", F.expr(f"pos div {_CHUNK}").alias("chunk"), "s.set_id", "s.block")
        .agg(*(F.expr(f"sum({x}) AS l{r}") for r, x in enumerate(lane_words("s.hits", width))))
    )
    counts = [f"sum(shiftrightunsigned(l{bit % width}, {bit - bit % width}) & {(1 << width) - 1}L)" for bit in range(BITS)]
    per_bit = (
        chunks.groupBy(*_BLOCK)
        .agg(F.expr(f"array({', '.join(counts)}) AS counts"))
        .select(*_BLOCK, F.posexplode("counts").alias("bit", "n_hits"))
    )
    return bits.places.join(per_bit, [*_BLOCK, "bit"], "left").select("trait", F.coalesce("n_hits", F.lit(0)).alias("n_hits"))
