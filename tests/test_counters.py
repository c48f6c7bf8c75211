from __future__ import annotations

import random

import brute
import pytest
from pyspark.sql import functions as F

from cladewise.functions.bounds import Bounds
from cladewise.operators import bitmaps
from cladewise.operators.counters import above, lane_width, lane_words, lanes
from cladewise.operators.ranks import with_count_from
from cladewise.plans.excess import excess
from cladewise.schema import GROUPS, RECORDS


@pytest.mark.parametrize("greatest", [1, 7, 100, 20_000, 1 << 30])
def test_lanes_count_and_compare(spark, greatest):
    """Sums of many words, compared with bounds, against counting bit by bit."""
    random.seed(greatest)
    width = lane_width(greatest)
    n = min(greatest, 60)
    words = [random.getrandbits(64) & random.getrandbits(64) for _ in range(n)]
    counts = [sum(w >> k & 1 for w in words) for k in range(64)]
    signed = [(w - (1 << 64) if w >> 63 else w,) for w in words]
    sums = [F.expr(f"sum({x}) AS s{r}") for r, x in enumerate(lane_words("w", width))]
    summed = spark.createDataFrame(signed, "w long").agg(*sums)
    for bound in {-1, 0, 1, min(counts), max(counts) - 1, max(counts), greatest - 1, greatest}:
        got = summed.selectExpr(f"{above([f's{r}' for r in range(width)], bound, width)} AS x").first().x
        assert [got >> k & 1 for k in range(64)] == [int(c > bound) for c in counts]


def test_lane_layout():
    assert lanes(32) == 1 | 1 << 32
    assert [lane_width(n) for n in (1, 2, 7, 8, 127, 128)] == [2, 4, 4, 8, 8, 16]
    with pytest.raises(ValueError):
        lane_width(1 << 31)


def test_counts_from_a_value_on(spark):
    random.seed(2)
    values = [random.choice([0, 1, 5, 5, 5, 1 << 40, random.getrandbits(20), (1 << 63) - 1]) for _ in range(300)]
    asked = [*range(8), 1 << 39, (1 << 40) + 1, (1 << 63) - 1, *values[:20]]
    found = with_count_from(
        spark.createDataFrame([(a,) for a in asked], "x long"), "x", spark.createDataFrame([(v,) for v in values], "x long"), "n"
    )
    assert sorted(map(tuple, found.collect())) == sorted((a, sum(v >= a for v in values)) for a in asked)
    nothing = spark.createDataFrame([], "x long")
    assert with_count_from(spark.createDataFrame([(3,)], "x long"), "x", nothing, "n").collect() == [(3, 0)]
    with pytest.raises(Exception, match="not from 0"):
        with_count_from(spark.createDataFrame([(-1,)], "x long"), "x", nothing, "n").collect()


@pytest.mark.parametrize("layout", ["one set", "several sets"])
@pytest.mark.parametrize(
    "bounds, ragged",
    [
        (Bounds(), False),
        (Bounds(max_fg_gaps=1, max_bg_gaps=0, max_miss=1), False),
        (Bounds(max_gaps=1, max_fg_miss=0), True),
        (Bounds(max_fg_gaps=0, max_bg_gaps=3, bg_bound="fg"), True),
    ],
)
def test_excess(spark, monkeypatch, layout, bounds, ragged):
    if layout == "several sets":
        monkeypatch.setattr(bitmaps, "BLOCKS_PER_SET", 1)
        monkeypatch.setattr(bitmaps, "TRAITS_PER_SET", 16)
    records, groups = brute.random_case(31, ragged=ragged)
    observed = {k: groups[k] for k in list(groups)[:5]} | {"idle": (["nobody"], ["noone"])}
    cycles = {k: groups[k] for k in list(groups)[5:]}

    def hits(part):
        rows = brute.bootstrap(records, part, 1, 2, bounds, (1, 2, 3), 0.5)
        return {t: sum(t in r[4].split(",") for r in rows) for t in part}

    null = list(hits(cycles).values()) + [0] * 5
    want = set()
    for trait, n in hits(observed).items():
        at_least = sum(x >= n for x in null)
        want.add((trait, n, len(null), at_least, round((at_least + 1) / (len(null) + 1), 9)))
    rows = excess(
        spark.createDataFrame(records, RECORDS),
        spark.createDataFrame(brute.group_rows(observed), GROUPS),
        spark.createDataFrame(brute.group_rows(cycles), GROUPS),
        len(null),
        2,
        bounds,
        ragged=ragged,
    )
    got = {tuple(r) for r in rows.withColumn("pvalue", F.round("pvalue", 9)).collect()}
    assert got == want
    assert any(r[1] for r in got)
