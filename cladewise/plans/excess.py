"""Excess test: does a trait hit more columns than resampled groups do?"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewise.functions.bounds import Bounds
from cladewise.functions.verdict import DEFAULT_PATTERNS
from cladewise.operators.bitmaps import number_traits, test_columns
from cladewise.operators.columns import DEFAULT_MAX_GAP_RATIO, kept_column
from cladewise.operators.counters import accepted_blocks, hits_per_trait
from cladewise.operators.ranks import with_count_from
from cladewise.plans.sizing import pin

_OBSERVED, _CYCLE = "o", "c"


def column_hits(
    records: DataFrame,
    groups: DataFrame,
    threshold: int,
    bounds: Bounds = Bounds(),
    patterns: str | Iterable[int] = DEFAULT_PATTERNS,
    max_gap_ratio: float = DEFAULT_MAX_GAP_RATIO,
    ragged: bool = False,
) -> DataFrame:
    """``trait, n_hits``: how many of the kept columns each trait hits, zero included."""
    bits = number_traits(groups)
    columns = test_columns(records, bits, patterns, ragged, with_counts=False)
    columns = columns.where(kept_column(threshold, max_gap_ratio))
    return hits_per_trait(accepted_blocks(columns, records, bits, bounds, ragged), bits)


def excess(
    records: DataFrame,
    observed: DataFrame,
    cycles: DataFrame,
    n_cycles: int,
    threshold: int,
    bounds: Bounds = Bounds(),
    patterns: str | Iterable[int] = DEFAULT_PATTERNS,
    max_gap_ratio: float = DEFAULT_MAX_GAP_RATIO,
    ragged: bool = False,
) -> DataFrame:
    """``trait, n_hits, cycles, n_at_least, pvalue`` for each observed trait.

    One scan tests the observed traits and all cycles. ``n_at_least`` counts the cycles
    with as many hits or more; cycles that name no groups count as cycles without
    hits. The p-value is (n_at_least + 1) / (cycles + 1), never 0.
    """
    if n_cycles <= 0:
        raise ValueError("n_cycles must be positive")
    both = observed.withColumn("trait", F.concat(F.lit(_OBSERVED), "trait")).unionByName(
        cycles.withColumn("trait", F.concat(F.lit(_CYCLE), "trait"))
    )
    counted = pin(column_hits(records, both, threshold, bounds, patterns, max_gap_ratio, ragged))
    kind, name = F.substring("trait", 1, 1), F.expr("substring(trait, 2)")
    found = counted.where(kind == _OBSERVED).select(name.alias("trait"), "n_hits")
    null = counted.where(kind == _CYCLE).select("n_hits")
    ranked = with_count_from(found, "n_hits", null, "n_at_least")
    at_least = F.when(F.col("n_hits") == 0, F.lit(n_cycles)).otherwise(F.col("n_at_least")).cast("long")
    return ranked.select(
        "trait",
        "n_hits",
        F.lit(n_cycles).alias("cycles"),
        at_least.alias("n_at_least"),
        ((at_least + 1) / F.lit(n_cycles + 1)).alias("pvalue"),
    )
