"""Verdicts for many traits at once, one bit per trait.

A species' memberships become two bitmaps per block of 64 traits: where it is
foreground and where it is background. OR-ing them per (column, symbol) while
counting gives the histogram and the group symbols of every trait from one
scan, with map-side combining and a row width that does not depend on how
many species or cycles there are. Comparing the symbols of a column then
decides all traits of a block with a few bit operations.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladewise.functions.verdict import ALL_PATTERNS, DEFAULT_PATTERNS, parse_patterns
from cladewise.operators.columns import cells, finish_profile, profile_aggregates
from cladewise.operators.evidence import group_sizes
from cladewise.plans.sizing import Groups, pin, pin_groups
from cladewise.schema import GAP

BITS = 64
BLOCKS_PER_SET = 16
TRAITS_PER_SET = BITS * BLOCKS_PER_SET


@dataclass(frozen=True)
class TraitBits:
    """Traits with their group sizes and their place: set of blocks, block, bit."""

    groups: Groups
    places: DataFrame
    n_blocks: int
    single_set: bool


def number_traits(groups: DataFrame | Groups) -> TraitBits:
    """Give every trait a set, a block and a bit; numbering is spread over hash buckets."""
    groups = pin_groups(groups)
    traits = group_sizes(groups.rows)
    n_traits = groups.n_traits
    n_buckets = max(1, n_traits // (8 * TRAITS_PER_SET))
    in_bucket = Window.partitionBy("bucket").orderBy("trait")
    number = F.row_number().over(in_bucket) - 1
    places = (
        traits.withColumn("bucket", F.pmod(F.xxhash64("trait"), F.lit(n_buckets)))
        .withColumn("number", number)
        .select(
            "trait",
            "n_fg",
            "n_bg",
            (
                F.col("bucket") * 1_000_000 + F.floor(F.col("number") / TRAITS_PER_SET)
            ).cast("bigint").alias("set_id"),
            F.floor(F.col("number") % TRAITS_PER_SET / BITS).cast("int").alias("block"),
            (F.col("number") % BITS).cast("int").alias("bit"),
        )
    )
    single = n_traits <= TRAITS_PER_SET
    n_blocks = max(1, -(-n_traits // BITS)) if single else BLOCKS_PER_SET
    return TraitBits(groups, groups.near(pin(places)), n_blocks, single)


def membership_bitmaps(bits: TraitBits) -> DataFrame:
    """One row per (species, set) with a foreground and a background word per block."""
    words = [
        F.expr(f"bit_or(if(block = {k} AND grp = {grp}, shiftleft(1L, bit), 0L)) AS {side}{k}")
        for side, grp in (("f", 1), ("b", 0))
        for k in range(bits.n_blocks)
    ]
    members = bits.groups.rows.join(bits.places, "trait").drop("trait", "n_fg", "n_bg")
    if not bits.single_set:
        # Histogram counts ride on set 0, so each member species needs a row there.
        home = members.selectExpr(
            "species", "-1 AS grp", "0L AS set_id", "0 AS block", "0 AS bit"
        ).distinct()
        members = members.unionByName(home)
    return members.groupBy("species", "set_id").agg(*words)


def test_columns(
    records: DataFrame,
    bits: TraitBits,
    patterns: str | Iterable[int] = DEFAULT_PATTERNS,
    ragged: bool = False,
    with_counts: bool = True,
) -> DataFrame:
    """One row per column: profile, symbol counts if asked for, and the hit blocks.

    ``blocks`` lists, for blocks with any hit, the hit bits and where the
    foreground or background shows more than one symbol.
    """
    wanted = parse_patterns(patterns)
    blocks = range(bits.n_blocks)
    words = [f"{side}{k}" for side in "fb" for k in blocks]
    key = ["gene", "pos"] if bits.single_set else ["gene", "pos", "set_id"]

    bitmaps = bits.groups.near(membership_bitmaps(bits))
    tagged = records.join(bitmaps, "species", "left").selectExpr(
        "gene",
        "seq",
        *([] if bits.single_set else ["coalesce(set_id, 0L) AS set_id"]),
        *[f"coalesce({w}, 0L) AS {w}" for w in words],
    )
    counted = "count(*)" if bits.single_set else "count_if(set_id = 0)"
    per_symbol = (
        cells(tagged)
        .groupBy(*key, "symbol")
        .agg(F.expr(f"{counted} AS n"), *[F.expr(f"bit_or({w}) AS {w}") for w in words])
    )

    # A bit seen in an earlier symbol and again in this one has two symbols.
    # Everything from here on is clustered by column, so it shuffles once.
    if not bits.single_set:
        per_symbol = per_symbol.repartition("gene", "pos")
    earlier = (
        f"OVER (PARTITION BY {', '.join(key)} ORDER BY symbol "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )
    seen = per_symbol.selectExpr(
        *key, "symbol", "n", *[f"if(symbol = '{GAP}', 0L, {w}) AS {w}" for w in words]
    ).selectExpr("*", *[f"{w} & coalesce(bit_or({w}) {earlier}, 0L) AS m{w}" for w in words])

    aggregates = profile_aggregates()
    profile = ["listed", "nongap", "n_symbols", "top"]
    if with_counts:
        profile.append("counts")
        aggregates.append(
            F.expr(f"collect_list(if(symbol <> '{GAP}' AND n > 0, n, NULL)) AS counts")
        )
    for k in blocks:
        aggregates += [
            F.expr(f"bit_or(f{k}) AS f{k}"),
            F.expr(f"bit_or(b{k}) AS b{k}"),
            F.expr(f"bit_or(f{k} & b{k}) AS x{k}"),
            F.expr(f"bit_or(mf{k}) AS mf{k}"),
            F.expr(f"bit_or(mb{k}) AS mb{k}"),
        ]
    set_id = "0L" if bits.single_set else "set_id"
    found = ", ".join(
        f"named_struct('set_id', {set_id}, 'block', {k}, 'hits', {_hit_word(k, wanted)}, "
        f"'fg_many', mf{k}, 'bg_many', mb{k})"
        for k in blocks
    )
    columns = (
        seen.groupBy(*key)
        .agg(*aggregates)
        .selectExpr(*key, *profile, f"filter(array({found}), s -> s.hits <> 0L) AS blocks")
    )
    if not bits.single_set:
        columns = columns.groupBy("gene", "pos").agg(
            *[F.expr(f"max(if(set_id = 0, {c}, NULL)) AS {c}") for c in profile],
            F.flatten(F.collect_list("blocks")).alias("blocks"),
        )
    return finish_profile(columns, records, ragged)


def _hit_word(block: int, patterns: tuple[int, ...]) -> str:
    """Bits of a block whose groups share nothing and show one of the patterns."""
    hits = f"f{block} & b{block} & ~x{block}"
    if set(patterns) == set(ALL_PATTERNS):
        return f"({hits})"
    sides = [
        f"({'' if p in (3, 4) else '~'}mf{block} & {'' if p in (2, 4) else '~'}mb{block})"
        for p in patterns
    ]
    return f"({hits} & ({' | '.join(sides)}))"


def hit_count(blocks: Column) -> Column:
    """Number of traits hit in a column."""
    return F.aggregate(blocks, F.lit(0), lambda n, s: n + F.bit_count(s["hits"]))


def hit_names(columns: DataFrame, bits: TraitBits, *carried: str) -> DataFrame:
    """Columns with ``traits``, the sorted names of the traits hit; empty where none is.

    Names are picked block by block, so a column makes one row per block
    with hits and not one per hit.
    """
    in_block = bits.places.groupBy("set_id", "block").agg(
        F.map_from_entries(F.collect_list(F.struct("bit", "trait"))).alias("by_bit")
    )
    per_block = columns.select(
        "gene", "pos", *carried, F.explode_outer("blocks").alias("s")
    ).select("gene", "pos", *carried, "s.set_id", "s.block", "s.hits")
    names = F.expr(f"transform({_SET_BITS}, i -> by_bit[i])")
    return (
        per_block.join(bits.groups.near(in_block), ["set_id", "block"], "left")
        .withColumn("names", names)
        .groupBy("gene", "pos", *carried)
        .agg(F.sort_array(F.flatten(F.collect_list("names"))).alias("traits"))
    )


_SET_BITS = "filter(sequence(0, 63), i -> (shiftright(hits, i) & 1L) = 1L)"


def explode_hits(columns: DataFrame, bits: TraitBits, *carried: str) -> DataFrame:
    """One row per hit (gene, pos, trait) with its pattern and the trait's group sizes."""
    return (
        columns.select("gene", "pos", *carried, F.explode("blocks").alias("s"))
        .select("gene", "pos", *carried, "s.*")
        .withColumn("bit", F.explode(F.expr(_SET_BITS)))
        .join(bits.places, ["set_id", "block", "bit"])
        .selectExpr(
            "gene",
            "pos",
            *carried,
            "trait",
            "n_fg",
            "n_bg",
            "1 + int(shiftright(bg_many, bit) & 1L) + 2 * int(shiftright(fg_many, bit) & 1L) AS pattern",
        )
    )
