"""What the physical plans may and may not hold."""

from __future__ import annotations

import re

import brute
import pytest
from pyspark.sql import functions as F

from cladewise import adapters as A
from cladewise.catalog import QUERIES
from cladewise.operators.bitmaps import number_traits, test_columns as scan_columns
from cladewise.operators.columns import column_profile
from cladewise.plans import sizing
from cladewise.schema import GROUPS, RECORDS
from cladewise.sinks.tables import save_records


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairing_and_no_python_rows(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "BatchEvalPython"):
        assert operator not in text
    # A shuffle into one partition would pass everything through one task.
    assert "SinglePartition" not in text


def test_scans_read_only_their_columns(spark, sf_dir):
    text = plan(QUERIES["discovery"](spark, sf_dir))
    schemas = set(re.findall(r"ReadSchema: struct<([^>]*)>", text))
    fields = {f.split(":")[0] for s in schemas for f in s.split(",")}
    assert fields <= {"l_partkey", "l_suppkey", "l_linenumber", "l_quantity"}


def test_counts_are_combined_before_the_shuffle(spark, sf_dir):
    text = plan(column_profile(A.line_records(spark, sf_dir)))
    assert text.count("Exchange hashpartitioning") == 3
    assert text.index("keys=[gene") < text.index("Exchange") < text.rindex("partial_count")


def test_member_scan_drops_other_species_before_exploding(spark):
    records, groups = brute.random_case(1)
    records_df = spark.createDataFrame(records, RECORDS)
    groups_df = spark.createDataFrame(brute.group_rows(groups), GROUPS)
    from cladewise.operators.evidence import group_evidence

    text = plan(group_evidence(records_df, groups_df))
    assert text.index("Generate posexplode") < text.index("BroadcastHashJoin")


def test_bucketed_records_need_no_shuffle(spark):
    records, groups = brute.random_case(2)
    save_records(spark.createDataFrame(records, RECORDS), "bucketed_records", 4)
    try:
        stored = spark.table("bucketed_records")
        assert "Exchange" not in plan(column_profile(stored))
        bits = number_traits(spark.createDataFrame(brute.group_rows(groups), GROUPS))
        text = plan(scan_columns(stored, bits))
        by_column = [x for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text) if "gene" in x]
        assert not by_column
        assert sorted(column_profile(stored).collect()) == sorted(
            column_profile(spark.createDataFrame(records, RECORDS)).collect()
        )
    finally:
        spark.sql("DROP TABLE bucketed_records")


def test_top_picks_are_cut_before_the_shuffle(spark, sf_dir):
    assert "WindowGroupLimit" in plan(QUERIES["select_inner"](spark, sf_dir))


def test_broadcast_follows_the_counted_size(spark, monkeypatch):
    df = spark.range(1000).withColumn("x", F.col("id"))
    assert sizing.fits(df, row_bytes=10, budget=10_000)
    assert not sizing.fits(df, row_bytes=10, budget=9_990)
    groups = spark.createDataFrame([("t", "a", 1)], GROUPS)
    assert sizing.pin_groups(groups).small
    monkeypatch.setattr(sizing, "BROADCAST_BYTES", 100)
    assert not sizing.pin_groups(groups).small


def test_symbols_of_long_sequences_are_counted_without_a_row_for_each(spark, monkeypatch):
    from cladewise.operators import columns as C

    monkeypatch.setattr(C, "_PIECE", 7)
    texts = ["", "-", "ab-é語😀\n ", "a" * 20, "語" * 9 + "b", None, "퟿"]
    rows = [(gene, f"s{k}", texts[(k * k + k) % len(texts)]) for k in range(60) for gene in ("g", "", None)]
    records = spark.createDataFrame(rows, "gene string, species string, seq string").repartition(3)
    expected = C.cells(records.select("gene", "seq")).groupBy("gene", "pos", "symbol").count()
    found = C.symbol_counts(records)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, map(tuple, expected.collect())))
    profile = C.column_profile(records.where("gene is not null"), ragged=True)
    assert "explode" not in profile._jdf.queryExecution().optimizedPlan().toString()
