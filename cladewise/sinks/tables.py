"""Writers for results, cycles and prepared alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewise.operators.sampling import cycle_text, cycles_to_groups, first_cycles


def write_discovery(hits: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replaces ``path``; without hits an empty table with the same columns results."""
    if fmt == "tsv":
        hits.write.mode("overwrite").csv(path, sep="\t", header=True, emptyValue="")
    else:
        hits.write.mode("overwrite").format(fmt).save(path)


def write_discovery_by_job(hits: DataFrame, path: str) -> None:
    """One folder per gene and trait with hits."""
    (
        hits.repartition("Gene", "Trait")
        .write.mode("overwrite")
        .partitionBy("Gene", "Trait")
        .parquet(path)
    )


def write_cycles(cycles: DataFrame, path: str) -> None:
    """Tab lines: cycle, foreground list, background list."""
    cycle_text(cycles).write.mode("overwrite").csv(path, sep="\t", header=False, emptyValue="")


def write_bootstrap(rows: DataFrame, path: str) -> None:
    """Tab lines without a header, zero counts included."""
    rows.write.mode("overwrite").csv(path, sep="\t", header=False, emptyValue="")


def write_cycle_configs(
    cycles: DataFrame, path: str, n: int | None = None, fg_label: int = 1
) -> None:
    """``species label`` tables, one folder per cycle; ``n`` keeps the first n cycles."""
    groups = cycles_to_groups(cycles, fg_label)
    if n is not None:
        groups = first_cycles(groups, n)
    (
        groups.select("trait", "species", F.col("grp").cast("string").alias("grp"))
        .write.mode("overwrite")
        .partitionBy("trait")
        .csv(path, sep="\t", header=False)
    )


def save_records(records: DataFrame, table: str, n_buckets: int) -> None:
    """Store records bucketed and sorted by gene.

    All column aggregations have the gene among their keys, so reading this
    table back they run without a shuffle. Meant for many genes of like size;
    leave records unbucketed where single genes hold much of the data.
    """
    (
        records.write.mode("overwrite")
        .bucketBy(n_buckets, "gene")
        .sortBy("gene", "species")
        .format("parquet")
        .saveAsTable(table)
    )
