"""Evidence per column and trait: counts, symbols, missing species."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewise.functions.verdict import is_hit, pattern_class
from cladewise.operators.columns import cells
from cladewise.plans.sizing import Groups, pin_groups
from cladewise.schema import GAP


def group_sizes(groups: DataFrame) -> DataFrame:
    """Members per trait and group."""
    return groups.groupBy("trait").agg(
        F.count_if(F.col("grp") == 1).alias("n_fg"),
        F.count_if(F.col("grp") == 0).alias("n_bg"),
    )


def member_lists(groups: DataFrame) -> DataFrame:
    """All member names per trait, and the foreground and background sizes."""
    return groups.groupBy("trait").agg(
        F.collect_list(F.when(F.col("grp") == 1, F.col("species"))).alias("fg_all"),
        F.collect_list(F.when(F.col("grp") == 0, F.col("species"))).alias("bg_all"),
    )


def group_evidence(records: DataFrame, groups: DataFrame | Groups) -> DataFrame:
    """Symbols, found species and gaps of both groups for every (gene, pos, trait).

    Only member records are transposed. Counting per symbol first keeps the
    shuffled rows few and of fixed width however large the groups are. Traits
    without a found member on both sides give no row.
    """
    groups = pin_groups(groups)
    members = records.join(groups.near(groups.rows), "species").drop("species")
    fg, bg = F.col("grp") == 1, F.col("grp") == 0
    per_symbol = (
        cells(members)
        .groupBy("gene", "pos", "trait", "symbol")
        .agg(F.count_if(fg).alias("n1"), F.count_if(bg).alias("n0"))
    )
    solid = F.col("symbol") != GAP
    in_fg, in_bg = solid & (F.col("n1") > 0), solid & (F.col("n0") > 0)
    return (
        per_symbol.groupBy("gene", "pos", "trait")
        .agg(
            F.sort_array(F.collect_list(F.when(in_fg, F.col("symbol")))).alias("fg_symbols"),
            F.sort_array(F.collect_list(F.when(in_bg, F.col("symbol")))).alias("bg_symbols"),
            F.count_if(in_fg & in_bg).alias("n_shared"),
            F.sum(F.when(solid, F.col("n1")).otherwise(0)).alias("ffgn"),
            F.sum(F.when(solid, F.col("n0")).otherwise(0)).alias("fbgn"),
            F.sum(F.when(solid, 0).otherwise(F.col("n1"))).alias("gfg"),
            F.sum(F.when(solid, 0).otherwise(F.col("n0"))).alias("gbg"),
        )
        .where((F.col("ffgn") > 0) & (F.col("fbgn") > 0))
    )


def with_verdict(evidence: DataFrame) -> DataFrame:
    """Adds ``is_hit`` and ``pattern`` to evidence rows."""
    k_fg, k_bg = F.size("fg_symbols"), F.size("bg_symbols")
    return evidence.withColumn("is_hit", is_hit(k_fg, k_bg, F.col("n_shared"))).withColumn(
        "pattern", pattern_class(k_fg, k_bg)
    )


def missing_members(records: DataFrame, groups: DataFrame | Groups) -> DataFrame:
    """Members absent from a whole gene, for each (gene, trait) with at least one present."""
    groups = pin_groups(groups)
    present = (
        records.select("gene", "species")
        .join(groups.near(groups.rows), "species")
        .groupBy("gene", "trait")
        .agg(F.collect_list("species").alias("present"))
    )
    lists = groups.near(member_lists(groups.rows))
    fg = F.array_except("fg_all", "present")
    bg = F.array_except("bg_all", "present")
    return present.join(lists, "trait").select(
        "gene",
        "trait",
        F.size(fg).alias("mfg"),
        F.size(bg).alias("mbg"),
        F.sort_array(F.concat(fg, bg)).alias("missing"),
    )


def gene_trait_grid(
    records: DataFrame, groups: DataFrame | Groups, per_bucket: int = 1024
) -> DataFrame:
    """Every gene with every trait.

    Traits sit in buckets of about ``per_bucket``; a gene meets them by an
    equi-join on the bucket number, so neither side is gathered in one place.
    """
    groups = pin_groups(groups)
    traits = groups.rows.select("trait").distinct()
    n_buckets = 1 + groups.n_traits // per_bucket
    bucketed = traits.withColumn("bucket", F.pmod(F.hash("trait"), F.lit(n_buckets)))
    genes = (
        records.select("gene")
        .distinct()
        .withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(n_buckets - 1))))
    )
    return genes.join(groups.near(bucketed), "bucket").select("gene", "trait")
