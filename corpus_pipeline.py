"""The corpus pipeline: documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a frame, which is written as
Parquet and read again as the next one's ``docs``. All but the last give the
columns of ``documents``. The stages handle what their operators handle: nulls in
any column, empty and very long texts, ties, repeated rows, further columns and
empty tables (see the operators' docstrings).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.llm import decontam, language, neardup, packing, templates
from cladewise.llm.common import count_words, stored, table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose text has no letter or whose main language holds under half of it."""
    return language.keep_identified(docs)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; documents stay."""
    return templates.drop_boilerplate(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates, five-word shingles and a similarity of 0.8, the document with the smallest id stays."""
    return neardup.keep_one(docs, neardup.STAGE)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that contain an item of the benchmark."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence; a document takes its words and one end mark."""
    return packing.pack(docs.select("doc_id", (count_words(F.col("text")) + 1).alias("length")))


STAGES = [
    ("language_identification", identified),
    ("line_dedup", without_boilerplate),
    ("minhash_neardup", one_of_each_group),
    ("benchmark_decontamination", decontaminated),
    ("best_fit_packing", packed),
]

#: No SQL: mixtures, latent retrieval and packing are iterative; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
