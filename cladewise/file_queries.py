"""Queries that render the tables as files of each format, written by Spark, and read them back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise import adapters as A
from cladewise.functions.text import file_name, file_stem, folder_value, gene_name
from cladewise.operators import sampling as S
from cladewise.session import ensure_checkpoint_dir
from cladewise.sinks import tables as K
from cladewise.sources import alignments as R
from cladewise.sources import traits as G
from cladewise.sources.files import manifest

#: Columns of the first block in formats that part sequences.
FIRST_BLOCK = 4
GENES = 10


def new_folder(spark: SparkSession) -> str:
    """A folder name below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


def _class_of(gene: str) -> Column:
    return F.concat(F.lit("c"), (F.substring(gene, 2, 20).cast("bigint") % GENES).cast("string"))


def class_records(spark: SparkSession, sf: str) -> DataFrame:
    """The line records with classes of suppliers as genes and (supplier, part class) as species."""
    return A.line_records(spark, sf).select(
        _class_of("gene").alias("gene"), F.concat_ws("_", "gene", "species").alias("species"), "seq"
    )


def write_by(lines: DataFrame, column: str, path: str, *order: str) -> None:
    """Text files, one folder for each value of ``column``, lines in the given order."""
    ordered = lines.repartition(column).sortWithinPartitions(column, *order).select(column, "value")
    ordered.write.partitionBy(column).text(path)


def _placed(place: int, value: Column, *keys: str) -> list[Column | str]:
    return [F.lit(place).alias("place"), *keys, value.alias("value")]


def _head() -> Column:
    return F.substring("seq", 1, FIRST_BLOCK)


def _tail() -> Column:
    return F.expr(f"substring(seq, {FIRST_BLOCK + 1})")


def _fasta_lines(records: DataFrame) -> DataFrame:
    text = F.concat(F.lit(">"), "species", F.lit(" a note > more\n"), _head(), F.lit("\n"), _tail())
    return records.select("gene", *_placed(0, text, "species"))


def _phylip_lines(records: DataFrame) -> DataFrame:
    counts = records.groupBy("gene").agg(F.count("*").alias("n"), F.max(F.length("seq")).alias("width"))
    head = counts.select("gene", *_placed(0, F.concat_ws(" ", "n", "width")), F.lit("").alias("species"))
    first = records.select("gene", *_placed(1, F.concat_ws("   ", "species", _head()), "species"))
    second = records.select("gene", *_placed(2, F.concat(F.lit("     "), _tail()), "species"))
    return head.unionByName(first).unionByName(second)


def _block_lines(records: DataFrame, header: str, between: str, gap: str) -> DataFrame:
    """Two blocks of names and segments, as CLUSTAL and STOCKHOLM have them."""
    genes = records.select("gene", F.lit("").alias("species")).distinct()
    lines = genes.select("gene", *_placed(0, F.lit(header), "species")).unionByName(
        genes.select("gene", *_placed(2, F.lit(between), "species"))
    )
    for place, segment in ((1, _head()), (3, _tail())):
        text = F.concat_ws("   ", "species", F.translate(segment, "-", gap))
        lines = lines.unionByName(records.select("gene", *_placed(place, text, "species")))
    return lines


FORMATS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "fasta": _fasta_lines,
    "phylip-relaxed": _phylip_lines,
    "clustal": lambda r: _block_lines(r, "CLUSTAL W (1.83) multiple sequence alignment\n", "\n", "-"),
    "stockholm": lambda r: _block_lines(r, "# STOCKHOLM 1.0\n#=GF ID x", "\n#=GC note", "."),
}


def _alignment_files(fmt: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        path = new_folder(spark)
        write_by(FORMATS[fmt](class_records(spark, sf)), "gene", path, "place", "species")
        return R.read_alignments(spark, path, fmt, name=folder_value("gene"))

    return query


def file_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Files and bytes of a folder of alignments, listed and not opened."""
    path = new_folder(spark)
    write_by(_fasta_lines(class_records(spark, sf)), "gene", path, "species")
    files = manifest(spark, path, folder_value("gene")).where(F.col("path").endswith(".txt"))
    return files.groupBy("name").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def path_names(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return A.table(spark, sf, "pages").select(
        "page_id", gene_name(url).alias("gene"), file_name(url).alias("trait"), file_stem(url).alias("job")
    )


def trait_files(spark: SparkSession, sf: str) -> DataFrame:
    """Group files with lines of other labels and short lines, which drop out."""
    path = new_folder(spark)
    groups = A.label_groups(spark, sf)
    lines = groups.select("trait", F.lit(1).alias("place"), F.concat_ws("\t", "species", "grp").alias("value"))
    odd = groups.select("trait").distinct()
    for place, text in ((0, "species label"), (2, "d0"), (3, "d0 2")):
        lines = lines.unionByName(odd.select("trait", *_placed(place, F.lit(text))))
    write_by(lines, "trait", path, "place", "value")
    return G.read_groups(spark, path, folder_value("trait"))


def _cycles(spark: SparkSession, sf: str, n: int) -> DataFrame:
    customers = A.table(spark, sf, "customer").select(F.col("c_name").alias("species"))
    return S.cycle_lists(S.resample_random(customers, 5, 4, n, 7))


def cycle_files(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark)
    K.write_cycles(_cycles(spark, sf, 200), path)
    groups, n = G.read_cycle_groups(spark, path)
    return groups.withColumn("cycles", F.lit(n))


def cycle_config_files(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark)
    K.write_cycle_configs(_cycles(spark, sf, 200), path, n=10)
    return G.read_groups(spark, path, folder_value("trait"))


def family_files(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark)
    A.customer_families(spark, sf).select(F.concat_ws("\t", "species", "family")).write.text(path)
    return G.read_families(spark, path)


def value_files(spark: SparkSession, sf: str) -> DataFrame:
    """Values of which some have a label, and lines without a number, which drop out."""
    path = new_folder(spark)
    value = F.col("p_retailprice").cast("string")
    third = F.when(F.col("p_partkey") % 2 == 0, (F.col("p_size") % 3 - 1).cast("string"))
    number = F.when(F.col("p_partkey") % 7 == 0, "none").otherwise(value)
    name = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    A.table(spark, sf, "part").select(F.concat_ws("\t", name, number, third)).write.text(path)
    return G.read_trait_values(spark, path)


def bootstrap_files(rows: DataFrame) -> DataFrame:
    """Bootstrap rows as they come back from their file."""
    path = new_folder(rows.sparkSession)
    K.write_bootstrap(rows, path)
    return G.read_bootstrap(rows.sparkSession, path)


def discovery_files(hits: DataFrame) -> DataFrame:
    """Hits as they come back from their tab file."""
    path = new_folder(hits.sparkSession)
    K.write_discovery(hits, path, "tsv")
    return hits.sparkSession.read.csv(path, sep="\t", header=True, schema=hits.schema, emptyValue="")


def job_folders(hits: DataFrame) -> DataFrame:
    """Hits per (class of genes, trait) as the folders of the jobs hold them."""
    path = new_folder(hits.sparkSession)
    hits = hits.withColumn("Gene", _class_of("Gene"))
    K.write_discovery_by_job(hits, path)
    held = hits.sparkSession.read.schema(hits.schema).parquet(path)
    return held.groupBy("Gene", "Trait").agg(F.count("*").alias("n_hits"), F.max("Position").alias("last"))


QUERIES = {
    "fasta_files": _alignment_files("fasta"),
    "phylip_files": _alignment_files("phylip-relaxed"),
    "clustal_files": _alignment_files("clustal"),
    "stockholm_files": _alignment_files("stockholm"),
    "file_manifest": file_manifest,
    "path_names": path_names,
    "trait_files": trait_files,
    "cycle_files": cycle_files,
    "cycle_config_files": cycle_config_files,
    "family_files": family_files,
    "value_files": value_files,
}
