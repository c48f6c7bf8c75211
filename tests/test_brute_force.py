from __future__ import annotations

import brute
import pytest

from cladewise.functions.bounds import Bounds
from cladewise.operators import bitmaps
from cladewise.plans import sizing
from cladewise.plans.bootstrap import bootstrap, template_threshold
from cladewise.plans.discovery import discovery
from cladewise.schema import BOOTSTRAP, DISCOVERY, GROUPS, RECORDS
from pyspark.sql import functions as F

CASES = [
    (Bounds(), (1, 2, 3), 0.5, False),
    (Bounds(), (1, 2, 3, 4), 1.0, True),
    (Bounds(max_fg_gaps=1, max_bg_gaps=0, max_gaps=1), (1, 2, 3, 4), 0.6, False),
    (Bounds(max_fg_miss=0, max_bg_miss=1, max_miss=1), (2, 3), 0.5, True),
    (Bounds(max_gaps=0, max_miss=0), (1,), 0.5, False),
    (Bounds(max_fg_gaps=0, max_bg_gaps=3, bg_bound="fg"), (1, 2, 3), 0.9, False),
]


def frames(spark, seed, ragged):
    records, groups = brute.random_case(seed, ragged=ragged)
    return (
        records,
        groups,
        spark.createDataFrame(records, RECORDS),
        spark.createDataFrame(brute.group_rows(groups), GROUPS),
    )


def combinations(*other_layout_cases):
    """The usual layout runs all cases, the others a few."""
    usual = [("one set", case) for case in range(len(CASES))]
    others = [(x, c) for x in ("several sets", "no broadcast") for c in other_layout_cases]
    return pytest.mark.parametrize("layout, case", usual + others, indirect=["layout"])


@pytest.fixture()
def layout(request, monkeypatch, spark):
    """The same rules must come out however traits are laid out and joins are run."""
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    if request.param == "several sets":
        monkeypatch.setattr(bitmaps, "BLOCKS_PER_SET", 1)
        monkeypatch.setattr(bitmaps, "TRAITS_PER_SET", 16)
    if request.param == "no broadcast":
        monkeypatch.setattr(sizing, "BROADCAST_BYTES", 0)
        spark.conf.set(threshold, "-1")
    yield request.param
    spark.conf.set(threshold, before)


@combinations(1, 2)
def test_discovery(spark, layout, case):
    bounds, patterns, ratio, ragged = CASES[case]
    records, groups, records_df, groups_df = frames(spark, case, ragged)
    rows = discovery(records_df, groups_df, bounds, patterns, ratio, ragged)
    got = [tuple(r) for r in rows.withColumn("Pvalue", F.round("Pvalue", 9)).collect()]
    expected = brute.discovery(records, groups, bounds, patterns, ratio)
    assert expected
    assert len(got) == len(expected)
    assert set(got) == expected


@combinations(1, 3)
def test_bootstrap(spark, layout, case):
    bounds, patterns, ratio, ragged = CASES[case]
    records, groups, records_df, groups_df = frames(spark, 100 + case, ragged)
    rows = bootstrap(records_df, groups_df, 75, 2, bounds, patterns, ratio, ragged, "cfg")
    got = [tuple(r) for r in rows.withColumn("empval", F.round("empval", 9)).collect()]
    expected = brute.bootstrap(records, groups, 75, 2, bounds, patterns, ratio)
    assert len(got) == len(expected)
    assert set(got) == expected
    assert any(r[1] > 0 for r in got)


def test_counts_without_cycle_list(spark):
    _, _, records, groups = frames(spark, 5, False)
    full = bootstrap(records, groups, 70, 2)
    short = bootstrap(records, groups, 70, 2, with_cycle_list=False)
    pick = ["position", "count", "empval"]
    assert sorted(full.select(pick).collect()) == sorted(short.select(pick).collect())
    assert {r[0] for r in short.select("cycle_list").collect()} == {""}


def test_layouts(spark):
    _, _, records, groups = frames(spark, 6, False)
    one = groups.where("trait = 't000'")
    assert [f.name for f in discovery(records, one).schema] == [c.split()[0] for c in DISCOVERY.split(", ")]
    got = bootstrap(records, one, 1, 1).schema
    assert [(f.name, f.dataType.simpleString()) for f in got] == [
        (c.split()[0], c.split()[1].lower()) for c in BOOTSTRAP.split(", ")
    ]


def test_looser_bounds_keep_all_hits(spark):
    _, _, records, groups = frames(spark, 7, False)
    key = ["Gene", "Trait", "Position"]

    def keys(**limits):
        # The threshold follows the bounds, so it is held fixed through the gap ratio alone.
        rows = discovery(records, groups, Bounds(**limits), (1, 2, 3, 4), 1.0)
        return {tuple(r) for r in rows.select(key).collect()}

    tight, middle, loose = keys(max_gaps=0, max_miss=0), keys(max_gaps=1, max_miss=1), keys()
    assert tight < middle < loose


def test_template_must_hold_one_trait(spark):
    _, _, _, groups = frames(spark, 8, False)
    with pytest.raises(ValueError):
        template_threshold(groups, Bounds())
    one = spark.createDataFrame([("t", "a", 1), ("t", "b", 1), ("t", "c", 0), ("t", "d", 0)], GROUPS)
    assert template_threshold(one, Bounds(max_fg_gaps=1, max_gaps=9)) == 1


def test_empty_results(spark):
    records = spark.createDataFrame([("g", "a", "AAA"), ("g", "b", "AAA")], RECORDS)
    groups = spark.createDataFrame([("t", "a", 1), ("t", "b", 0)], GROUPS)
    assert discovery(records, groups).count() == 0
    assert bootstrap(records, groups, 1, 0).select("count").collect() == [(0,)] * 3


def test_trait_without_foreground_gives_no_row(spark):
    records = spark.createDataFrame([("g", "a", "A"), ("g", "b", "B"), ("g", "c", "B")], RECORDS)
    groups = spark.createDataFrame([("only_bg", "a", 0), ("ok", "a", 1), ("ok", "b", 0)], GROUPS)
    assert [r["Trait"] for r in discovery(records, groups).collect()] == ["ok"]
