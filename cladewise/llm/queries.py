"""The registered queries of the operators, at production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.llm import (
    alignment,
    chat,
    decontam,
    language,
    neardup,
    packing,
    quality,
    repair,
    simhash,
    templates,
    tokenfile,
    tokens,
    warc,
)
from cladewise.llm.common import count_words, shared_folder, table
from cladewise.llm.oracle import ORACLE

__all__ = ["ORACLE", "QUERIES"]

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def op1_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations, and one whose texts look like control strings."""
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.read_back(chat.format_conversations(turns), in_order=True)


def op2_language_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return language.predict(table(spark, sf, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    """A document takes its words and one end mark."""
    documents = table(spark, sf, "documents")
    return packing.pack(documents.select("doc_id", (count_words(F.col("text")) + 1).alias("length")))


def op4_adaptive_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(table(spark, sf, "documents"))


def op5_line_templates(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    return templates.drop_recurring(documents, counts=True).select("doc_id", "text", "lines_before", "lines_dropped")


def op6_token_files(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark)
    tokenfile.write_ids(table(spark, sf, "documents"), public_tokenizers.path(BYTE_BPE), folder)
    return tokenfile.digests(spark, folder)


def op7_warc(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark)
    warc.write_archives(table(spark, sf, "pages"), folder)
    return warc.read_archives(spark, folder).drop("url")


def op8_minhash_neardup(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf, "documents"))


def op9_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op10_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf, "documents"), public_tokenizers.path(BYTE_BPE))


def op11_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    paths = (public_tokenizers.path(name) for name in (BYTE_BPE, PIECES))
    return alignment.link_statistics(table(spark, sf, "documents"), *paths)


def op12_simhash_neardup(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


def op13_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    turns = table(spark, sf, "conversations")
    return repair.audited(turns, repair.damage(turns))


QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_language_mixture": op2_language_mixture,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_adaptive_quality": op4_adaptive_quality,
    "op5_line_templates": op5_line_templates,
    "op6_token_files": op6_token_files,
    "op7_warc": op7_warc,
    "op8_minhash_neardup": op8_minhash_neardup,
    "op9_decontamination": op9_decontamination,
    "op10_token_counts": op10_token_counts,
    "op11_token_alignment": op11_token_alignment,
    "op12_simhash_neardup": op12_simhash_neardup,
    "op13_conversation_repair": op13_conversation_repair,
}
