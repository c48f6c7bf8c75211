"""Group definitions, cycles, families, trait values, bootstrap results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.functions.text import file_name, names_in
from cladewise.operators.sampling import cycles_to_groups
from cladewise.sources.files import Naming, require_unique


def _columns(spark: SparkSession, path: str, separator: str, name: Naming | None = None) -> DataFrame:
    line = F.trim("value") if separator != "\t" else F.col("value")
    file = name(F.col("_metadata.file_path")) if name else file_name(F.col("_metadata.file_name"))
    return spark.read.text(path).select(F.split(line, separator).alias("c"), file.alias("file"))


def _label_ok(label: Column) -> Column:
    return label.isin("0", "1")


def read_groups(spark: SparkSession, path: str, name: Naming | None = None) -> DataFrame:
    """One trait per file, ``species label`` lines; other labels and short lines drop out; file names differ, or the job fails.

    ``name`` takes the trait from a file's path; files of one such name are one trait.
    """
    if not name:
        require_unique(spark, path)
    rows = _columns(spark, path, r"\s+", name).where(F.size("c") >= 2)
    return (
        rows.where(_label_ok(F.col("c")[1]))
        .select(F.col("file").alias("trait"), F.col("c")[0].alias("species"), F.col("c")[1].cast("int").alias("grp"))
        .distinct()
    )


def rejected_group_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines per file that ``read_groups`` leaves out."""
    rows = _columns(spark, path, r"\s+")
    short = F.size("c") < 2
    # Spark evaluates both sides of a condition, so ask for the label safely.
    odd = ~F.coalesce(_label_ok(F.get("c", F.lit(1))), F.lit(False))
    return rows.where(short | odd).groupBy(F.col("file").alias("trait")).count()


def read_cycles(spark: SparkSession, path: str) -> DataFrame:
    """Cycle rows of a tab file: cycle, foreground list, background list."""
    rows = _columns(spark, path, "\t").where(F.size("c") >= 3)
    return rows.select(
        F.col("c")[0].alias("cycle"), names_in(F.col("c")[1]).alias("fg"), names_in(F.col("c")[2]).alias("bg")
    )


def read_cycle_groups(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Cycles as groups, and the number of lines, bad and repeated ones included."""
    n_cycles = spark.read.text(path).count()
    return cycles_to_groups(read_cycles(spark, path)).distinct(), n_cycles


def read_families(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """``species family`` tab lines; ``header`` drops a first line reading Species, Family."""
    rows = _columns(spark, path, "\t").where(F.size("c") >= 2)
    families = rows.select(F.col("c")[0].alias("species"), F.col("c")[1].alias("family"))
    if header:
        is_header = (F.lower("species") == "species") & (F.lower("family") == "family")
        families = families.where(~is_header)
    return families.distinct()


def read_trait_values(spark: SparkSession, path: str) -> DataFrame:
    """``species value [label]`` tab lines; lines without a number drop out."""
    rows = _columns(spark, path, "\t").where(F.size("c") >= 2)
    return rows.select(
        F.col("c")[0].alias("species"),
        F.col("c")[1].try_cast("double").alias("value"),
        F.get("c", F.lit(2)).try_cast("int").alias("label"),
    ).where(F.col("value").isNotNull())


def read_bootstrap(spark: SparkSession, path: str) -> DataFrame:
    """Bootstrap tables with six columns, or five in files without the cycle count."""
    rows = _columns(spark, path, "\t").where(F.size("c") >= 5)
    shift = F.size("c") - 6
    return rows.select(
        F.col("c")[0].alias("position"),
        F.col("c")[1].cast("int").alias("count"),
        F.when(shift == 0, F.col("c")[2]).cast("int").alias("cycles"),
        F.get("c", shift + 3).cast("double").alias("empval"),
        F.get("c", shift + 4).alias("cycle_list"),
        F.get("c", shift + 5).alias("trait_config"),
    )


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    """One tree per file, whatever its line breaks; file names differ, or the job fails."""
    require_unique(spark, path)
    return spark.read.text(path, wholetext=True).select(
        file_name(F.col("_metadata.file_name")).alias("tree"), F.col("value").alias("newick")
    )
