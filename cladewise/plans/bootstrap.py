"""Bootstrap: how many resampled cycles hit each retained column."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewise.functions.bounds import Bounds
from cladewise.functions.text import position_key
from cladewise.functions.verdict import DEFAULT_PATTERNS
from cladewise.operators.bitmaps import hit_count, hit_names, number_traits, test_columns
from cladewise.operators.columns import DEFAULT_MAX_GAP_RATIO, kept_column
from cladewise.operators.counters import accepted_blocks
from cladewise.operators.evidence import group_sizes
from cladewise.plans.sizing import Groups, pin_groups


def template_threshold(template: DataFrame, bounds: Bounds) -> int:
    """Threshold from the template's group sizes; the template names one trait."""
    sizes = group_sizes(template).limit(2).collect()
    if len(sizes) != 1:
        raise ValueError(f"the template must hold exactly one trait, found {len(sizes)}")
    return bounds.threshold(sizes[0]["n_fg"], sizes[0]["n_bg"])


def bootstrap(
    records: DataFrame,
    cycles: DataFrame | Groups,
    n_cycles: int,
    threshold: int,
    bounds: Bounds = Bounds(),
    patterns: str | Iterable[int] = DEFAULT_PATTERNS,
    max_gap_ratio: float = DEFAULT_MAX_GAP_RATIO,
    ragged: bool = False,
    trait_config: str = "",
    with_cycle_list: bool = True,
) -> DataFrame:
    """One row per retained column, zero counts included, as in ``schema.BOOTSTRAP``.

    ``cycles`` are groups whose trait is the cycle name. Counts come straight
    from the bitmaps; bounds mask the hit words, so hits never become rows.
    """
    if n_cycles <= 0:
        raise ValueError("n_cycles must be positive")
    cycles = pin_groups(cycles)
    bits = number_traits(cycles)
    columns = test_columns(records, bits, patterns, ragged, with_counts=False).where(
        kept_column(threshold, max_gap_ratio)
    )
    columns = accepted_blocks(columns, records, bits, bounds, ragged)
    if with_cycle_list:
        named = hit_names(columns, bits)
        count = F.size("traits")
    else:
        named = columns.withColumn("traits", F.array().cast("array<string>"))
        count = hit_count(F.col("blocks"))
    counted = named.select("gene", "pos", count.alias("count"), F.array_join("traits", ",").alias("cycle_list"))
    return counted.select(
        position_key(F.col("gene"), F.col("pos")).alias("position"),
        "count",
        F.lit(n_cycles).alias("cycles"),
        (F.col("count") / F.lit(n_cycles)).alias("empval"),
        "cycle_list",
        F.lit(trait_config).alias("trait_config"),
    )


def empirical_values(bootstrap_rows: DataFrame) -> DataFrame:
    """Position and empirical value, by column name."""
    return bootstrap_rows.select("position", "empval")
