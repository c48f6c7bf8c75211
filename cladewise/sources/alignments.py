"""Alignment files as ``(gene, species, seq)`` records.

Paths may be files, folders or globs; a folder is read in one job and the
gene is each file's base name up to the first dot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladewise.functions.text import gene_name
from cladewise.operators.columns import last_record_wins
from cladewise.sources.files import Naming, require_unique, require_unique_names

# First words of CLUSTAL-family header lines.
_CLUSTAL_HEADERS = ("CLUSTAL", "PROBCONS", "MUSCLE", "MSAPROBS", "Kalign", "Biopython")

_BLANK = r"\s+"


def _lines(spark: SparkSession, path: str, name: Naming | None, **options: str) -> DataFrame:
    """Text rows with their gene and their place: block start, then order inside the block."""
    gene = name(F.col("_metadata.file_path")) if name else gene_name(F.col("_metadata.file_name"))
    place = F.struct(
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("nth"),
    )
    return spark.read.options(**options).text(path).select(
        gene.alias("gene"), "value", place.alias("place")
    )


def _without_blanks(text: Column) -> Column:
    return F.regexp_replace(text, _BLANK, "")


def _fasta(spark: SparkSession, path: str, name: Naming | None) -> DataFrame:
    # Records part at a '>' that starts a line; only a file's first one keeps it.
    rows = _lines(spark, path, name, lineSep="\n>")
    text = F.regexp_replace("value", r"^\s*>", "")
    return rows.select(
        "gene",
        F.regexp_extract(text, r"^[ \t]*(\S+)", 1).alias("species"),
        _without_blanks(F.regexp_extract(text, r"(?s)^[^\n]*\n(.*)$", 1)).alias("seq"),
        "place",
    )


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``number``, the place of a row in its file from 0, and ``total``, the file's rows.

    Rows are ranked inside each split of a file and shifted by the splits before,
    so a file is never ranked by a single task.
    """
    rows = rows.withColumn("start", F.col("place.start"))
    splits = rows.groupBy("gene", "start").agg(F.count("*").alias("n"))
    file = Window.partitionBy("gene")
    before = file.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "gene",
        "start",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
        F.sum("n").over(file).alias("total"),
    )
    rank = F.row_number().over(Window.partitionBy("gene", "start").orderBy("place.nth"))
    return (
        rows.withColumn("rank", rank)
        .join(offsets, ["gene", "start"])
        .withColumn("number", F.col("offset") + F.col("rank") - 1)
    )


def _phylip_relaxed(spark: SparkSession, path: str, name: Naming | None) -> DataFrame:
    """Records on one line each or in interleaved blocks, of which the first has the names.

    The counts in the first line say how many lines a block has; a file that
    they do not fit fails the read.
    """
    rows = _numbered(_lines(spark, path, name).where(F.col("value").rlike(r"\S")))

    def header(nth: int) -> Column:
        return F.regexp_extract("value", r"^\s*(\d+)\s+(\d+)\s*$", nth).try_cast("bigint")

    heads = rows.where(F.col("number") == 0).select(
        "gene", F.nullif(header(1), F.lit(0)).alias("n_records"), header(2).alias("n_columns")
    )

    def unless(bad: Column, why: str, value: Column) -> Column:
        error = F.raise_error(F.concat(F.lit(why), F.lit(" in the file of gene '"), F.col("gene"), F.lit("'")))
        return F.when(F.coalesce(bad, F.lit(True)), error).otherwise(value)

    uneven = (F.col("total") - 1) % F.col("n_records") != 0
    lines = rows.where(F.col("number") > 0).join(heads, "gene").withColumn(
        "line", unless(uneven, "lines do not fit the counts in the first line", F.col("number") - 1)
    )
    named = F.col("line") < F.col("n_records")
    segment = F.when(named, F.regexp_extract("value", r"^\s*\S+\s+(.*)$", 1)).otherwise(F.col("value"))
    records = lines.groupBy("gene", (F.col("line") % F.col("n_records")).alias("place")).agg(
        F.max(F.when(named, F.regexp_extract("value", r"^\s*(\S+)", 1))).alias("species"),
        F.sort_array(F.collect_list(F.struct("line", _without_blanks(segment).alias("segment")))).alias("parts"),
        F.max("n_columns").alias("n_columns"),
    )
    seq = F.array_join(F.transform("parts", lambda p: p["segment"]), "")
    return records.select("gene", "species", seq.alias("seq"), "place", "n_columns").select(
        "gene",
        "species",
        unless(F.length("seq") != F.col("n_columns"), "a sequence is not as long as told", F.col("seq")).alias("seq"),
        "place",
    )


def _blocks(rows: DataFrame) -> DataFrame:
    """Join the segments of each record in file order."""
    segments = rows.groupBy("gene", "species").agg(
        F.sort_array(F.collect_list(F.struct("place", "segment"))).alias("parts")
    )
    return segments.select(
        "gene",
        "species",
        F.array_join(F.transform("parts", lambda p: p["segment"]), "").alias("seq"),
    )


_SEGMENT = r"^(\S+)\s+(\S+)(?:\s+\d+)?\s*$"


def _segments(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("value").rlike(_SEGMENT)).select(
        "gene",
        F.regexp_extract("value", _SEGMENT, 1).alias("species"),
        F.regexp_extract("value", _SEGMENT, 2).alias("segment"),
        "place",
    )


def _clustal(spark: SparkSession, path: str, name: Naming | None) -> DataFrame:
    header = F.col("value").rlike("^(" + "|".join(_CLUSTAL_HEADERS) + r")\b")
    return _blocks(_segments(_lines(spark, path, name).where(~header)))


def _stockholm(spark: SparkSession, path: str, name: Naming | None) -> DataFrame:
    noise = F.col("value").startswith("#") | F.col("value").startswith("//")
    rows = _segments(_lines(spark, path, name).where(~noise))
    # Dots are gaps in this format.
    return _blocks(rows.withColumn("segment", F.translate("segment", ".", "-")))


_READERS: dict[str, Callable[[SparkSession, str, Naming | None], DataFrame]] = {
    "fasta": _fasta,
    "phylip-relaxed": _phylip_relaxed,
    "clustal": _clustal,
    "stockholm": _stockholm,
}


def read_alignments(
    spark: SparkSession, path: str, fmt: str = "clustal", unique_ids: bool = False, name: Naming | None = None
) -> DataFrame:
    """Records of every alignment under ``path``.

    Two files of one gene are an error, as their records would mix. A species
    named twice in a gene keeps its last record. Looking for such
    names costs one pass over the keys; ``unique_ids=True`` skips it for data
    known to have none. ``name`` takes another gene name from a file's path, as
    ``file_stem`` does, by which ``G1.v1.fa`` and ``G1.v2.fa`` are jobs of their own.
    """
    if fmt not in _READERS:
        raise ValueError(f"format must be one of {sorted(_READERS)}")
    if name:
        require_unique_names(spark, path, name)
    else:
        require_unique(spark, path, lambda file: file.split(".")[0])
    rows = _READERS[fmt](spark, path, name).where((F.col("species") != "") & (F.col("seq") != ""))
    if "place" in rows.columns:
        if not unique_ids and has_repeated_ids(rows):
            return last_record_wins(rows, "place")
        rows = rows.drop("place")
    return rows


def has_repeated_ids(records: DataFrame) -> bool:
    repeated = records.groupBy("gene", "species").count().where(F.col("count") > 1)
    return not repeated.isEmpty()


def ragged_genes(records: DataFrame) -> DataFrame:
    """Genes whose records differ in length, so not alignments."""
    length = F.length("seq")
    return (
        records.groupBy("gene")
        .agg(F.min(length).alias("shortest"), F.max(length).alias("longest"))
        .where(F.col("shortest") != F.col("longest"))
    )
