"""Discovery: convergent columns of many alignments for many group definitions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewise.functions.bounds import Bounds
from cladewise.functions.stats import column_pvalue
from cladewise.functions.text import comma_list, comma_list_or_dash, substitution
from cladewise.functions.verdict import DEFAULT_PATTERNS
from cladewise.operators.bitmaps import explode_hits, number_traits, test_columns
from cladewise.operators.columns import DEFAULT_MAX_GAP_RATIO
from cladewise.operators.counters import accepted_blocks
from cladewise.operators.details import hit_details
from cladewise.operators.evidence import gene_trait_grid
from cladewise.plans.sizing import Groups, pin_groups


def discovery(
    records: DataFrame,
    groups: DataFrame | Groups,
    bounds: Bounds = Bounds(),
    patterns: str | Iterable[int] = DEFAULT_PATTERNS,
    max_gap_ratio: float = DEFAULT_MAX_GAP_RATIO,
    ragged: bool = False,
) -> DataFrame:
    """All hits of all traits in all genes, in the layout of ``schema.DISCOVERY``.

    One scan tests every column for every trait; bounds mask its hit words. P-values
    and species lists are worked out for hits only.
    """
    groups = pin_groups(groups)
    bits = number_traits(groups)
    columns = test_columns(records, bits, patterns, ragged).where(
        (F.size("blocks") > 0) & (F.col("gaps") / F.col("total") <= F.lit(float(max_gap_ratio)))
    )
    hits = (
        explode_hits(accepted_blocks(columns, records, bits, bounds, ragged), bits, "counts", "minority")
        .where(F.col("minority") >= bounds.threshold_of(F.col("n_fg"), F.col("n_bg")))
        .drop("minority")
    )
    return hit_details(hits, records, groups).select(
        F.col("gene").alias("Gene"),
        F.col("trait").alias("Trait"),
        F.col("pos").alias("Position"),
        substitution(F.col("fg_symbols"), F.col("bg_symbols")).alias("Substitution"),
        column_pvalue(F.col("counts"), F.col("ffgn"), F.col("fbgn")).alias("Pvalue"),
        F.concat(F.lit("pattern"), F.col("pattern").cast("string")).alias("Pattern"),
        F.col("ffgn").alias("FFGN"),
        F.col("fbgn").alias("FBGN"),
        F.col("gfg").alias("GFG"),
        F.col("gbg").alias("GBG"),
        F.col("mfg").alias("MFG"),
        F.col("mbg").alias("MBG"),
        comma_list(F.col("fg_found")).alias("FFG"),
        comma_list(F.col("bg_found")).alias("FBG"),
        comma_list_or_dash(F.col("missing")).alias("MS"),
    )


def batch_summary(records: DataFrame, groups: DataFrame | Groups, hits: DataFrame) -> DataFrame:
    """Hits per (gene, trait), zero where a combination has none."""
    counted = hits.groupBy(F.col("Gene").alias("gene"), F.col("Trait").alias("trait")).agg(
        F.count("*").alias("n_hits")
    )
    return (
        gene_trait_grid(records, groups)
        .join(counted, ["gene", "trait"], "left")
        .select("gene", "trait", F.coalesce("n_hits", F.lit(0)).alias("n_hits"))
    )
