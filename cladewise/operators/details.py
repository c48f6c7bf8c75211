"""Member details of given (gene, pos, trait) rows, worked out on words of 64 species."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladewise.operators.bitmaps import BITS
from cladewise.operators.columns import cells
from cladewise.operators.evidence import group_sizes
from cladewise.plans.sizing import Groups, fits, pin, pin_groups
from cladewise.schema import GAP

#: Species that are numbered together.
_BUCKET = 4096


def number_species(groups: DataFrame | Groups) -> DataFrame:
    """``species, word, bit`` of every member; those that share their first trait stand side by side.

    Numbering is spread over buckets, and a trait of many members over several of them.
    """
    groups = pin_groups(groups)
    sizes = group_sizes(groups.rows).select("trait", (F.col("n_fg") + F.col("n_bg")).alias("n"))
    homes = (
        groups.rows.join(groups.near(sizes), "trait")
        .groupBy("species")
        .agg(F.min(F.struct("trait", "n")).alias("home"))
        .select("species", F.col("home.trait").alias("home"), F.ceil(F.col("home.n") / _BUCKET).alias("parts"))
    )
    part = F.pmod(F.xxhash64("species"), F.col("parts"))
    bucket = F.pmod(F.xxhash64("home", part), F.lit(max(1, groups.n_rows // _BUCKET)))
    number = F.row_number().over(Window.partitionBy("bucket").orderBy("home", "species")) - 1
    return (
        homes.withColumn("bucket", bucket)
        .withColumn("number", number)
        .select(
            "species",
            (F.col("bucket") * (1 << 31) + F.floor(F.col("number") / BITS)).cast("long").alias("word"),
            (F.col("number") % BITS).cast("int").alias("bit"),
        )
    )


def _bits(condition: str | None = None) -> Column:
    return F.expr(f"bit_or(if({condition}, shiftleft(1L, bit), 0L))" if condition else "bit_or(shiftleft(1L, bit))")


def cells_at(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``cells`` in the columns ``wanted`` (``gene, at``, a list of positions); others are not made."""
    carried = [c for c in records.columns if c != "seq"]
    symbols = F.transform(
        F.array(F.split("seq", "")),
        lambda all_symbols: F.transform(
            "at", lambda p: F.struct(p.alias("pos"), F.get(all_symbols, p).alias("symbol"))
        ),
    )
    return (
        records.join(wanted, "gene")
        .select(*carried, F.explode(F.get(symbols, F.lit(0))).alias("c"))
        .select(*carried, "c.pos", "c.symbol")
        .where(F.col("symbol") != "")
    )


def column_words(records: DataFrame, places: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``gene, pos, word, symbols``: the bits of the members that show each symbol of a column, gaps left out.

    ``symbols`` is as long as the alphabet at most. Sequences are taken apart once, and
    only those of members and in the wanted columns; what goes into the shuffle is combined in the map tasks.
    """
    members = records.join(places, "species").drop("species")
    taken = cells(members) if wanted is None else cells_at(members, wanted)
    return (
        taken.where(F.col("symbol") != GAP)
        .groupBy("gene", "pos", "word", "symbol")
        .agg(_bits().alias("bits"))
        .groupBy("gene", "pos", "word")
        .agg(F.collect_list(F.struct("symbol", "bits")).alias("symbols"), F.expr("bit_or(bits)").alias("solid"))
    )


def hit_details(hits: DataFrame, records: DataFrame, groups: DataFrame | Groups) -> DataFrame:
    """Found, gapped and missing members of both groups for each hit row, and the symbols they show.

    A hit meets the words of its trait's members, and these the words of its column and
    gene; everything is counted there. Names are read off the bits in the end, as
    the result names them. Other columns of ``hits`` are kept, but for the group
    sizes ``n_fg`` and ``n_bg``.
    """
    key = ["gene", "pos", "trait"]
    carried = [c for c in hits.columns if c not in (*key, "n_fg", "n_bg")]
    groups = pin_groups(groups)
    places = groups.near(pin(number_species(groups)))
    of_trait = (
        groups.rows.join(places, "species").groupBy("trait", "word").agg(_bits("grp = 1").alias("f"), _bits("grp = 0").alias("b"))
    )
    names = places.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("bit", "species"))).alias("by_bit"))
    in_gene = records.select("gene", "species").join(places, "species").groupBy("gene", "word").agg(_bits().alias("here"))
    hits = pin(hits.select(*key, *carried))
    wanted = hits.groupBy("gene").agg(F.collect_set("pos").alias("at"))
    # A row for each gene with hits; its positions are hits, too.
    wanted = F.broadcast(wanted) if fits(hits, row_bytes=32) else wanted
    words = (
        hits.join(groups.near(of_trait), "trait")
        .join(column_words(records, places, wanted), ["gene", "pos", "word"], "left")
        .join(in_gene, ["gene", "word"], "left")
        .join(groups.near(names), "word")
        .withColumns({"solid": F.coalesce("solid", F.lit(0)), "here": F.coalesce("here", F.lit(0))})
    )
    sets = {
        "fg_found": "f & solid",
        "bg_found": "b & solid",
        "fg_gapped": "f & here & ~solid",
        "bg_gapped": "b & here & ~solid",
        "fg_missing": "f & ~here",
        "bg_missing": "b & ~here",
    }
    words = words.selectExpr("*", *(f"{bits} AS {name}" for name, bits in sets.items()))
    counts = {
        "ffgn": "fg_found", "fbgn": "bg_found", "gfg": "fg_gapped", "gbg": "bg_gapped", "mfg": "fg_missing", "mbg": "bg_missing"
    }

    def named(bits: str) -> Column:
        return F.expr(f"transform(filter(sequence(0, {BITS - 1}), i -> (shiftright({bits}, i) & 1L) = 1L), i -> by_bit[i])")

    def shown(side: str) -> Column:
        return F.expr(f"transform(filter(symbols, s -> (s.bits & {side}) <> 0L), s -> s.symbol)")

    def gathered(lists: Column) -> Column:
        return F.flatten(F.collect_list(lists))

    return words.groupBy(*key).agg(
        *(F.any_value(c).alias(c) for c in carried),
        *(F.sum(F.bit_count(s)).cast("int").alias(c) for c, s in counts.items()),
        gathered(named("fg_found")).alias("fg_found"),
        gathered(named("bg_found")).alias("bg_found"),
        gathered(named("(fg_missing | bg_missing)")).alias("missing"),
        F.array_distinct(gathered(shown("f"))).alias("fg_symbols"),
        F.array_distinct(gathered(shown("b"))).alias("bg_symbols"),
    )
