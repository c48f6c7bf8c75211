from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cladewise.operators import sampling as S
from cladewise.schema import GROUPS


def pool(spark, n=30):
    return spark.createDataFrame([(f"s{i:03d}",) for i in range(n)], "species string")


def test_random_groups_are_disjoint_and_complete(spark):
    groups = S.resample_random(pool(spark), 5, 4, 300, seed=1).collect()
    by_cycle = {}
    for r in groups:
        by_cycle.setdefault(r.trait, []).append((r.species, r.grp))
    assert set(by_cycle) == {f"b_{i}" for i in range(1, 301)}
    for members in by_cycle.values():
        assert len({s for s, _ in members}) == 9
        assert Counter(g for _, g in members) == {1: 5, 0: 4}


def test_random_groups_are_even(spark):
    n = 12
    groups = S.resample_random(pool(spark, n), 2, 1, 4000, seed=2)
    counts = groups.groupBy("species", "grp").count().collect()
    assert len(counts) == 2 * n
    for r in counts:
        expected = 4000 * (2 if r.grp == 1 else 1) / n
        assert abs(r["count"] - expected) < 6 * expected**0.5


def test_seed_fixes_the_draw(spark):
    def draw(seed):
        return {tuple(r) for r in S.resample_random(pool(spark), 3, 2, 20, seed).collect()}

    assert draw(5) == draw(5)
    assert draw(5) != draw(6)


def test_whole_pool_can_be_drawn(spark):
    groups = S.resample_random(pool(spark, 7), 4, 3, 10, seed=0)
    assert groups.groupBy("trait").agg(F.count_distinct("species").alias("n")).where("n <> 7").count() == 0


def test_families_keep_the_template(spark):
    families = spark.createDataFrame(
        [(f"{f}{i}", f) for f, n in (("a", 6), ("b", 9), ("c", 3)) for i in range(n)],
        "species string, family string",
    )
    template = spark.createDataFrame(
        [("t", "a0", 1), ("t", "a1", 0), ("t", "b0", 1), ("t", "b1", 1), ("t", "b2", 0), ("t", "b3", 0)],
        GROUPS,
    )
    groups = S.resample_family(families, template, 50, seed=3).collect()
    by_cycle = {}
    for r in groups:
        by_cycle.setdefault(r.trait, []).append(r)
    assert len(by_cycle) == 50
    for rows in by_cycle.values():
        assert Counter((r.species[0], r.grp) for r in rows) == {
            ("a", 1): 1, ("a", 0): 1, ("b", 1): 2, ("b", 0): 2,
        }
        assert len({r.species for r in rows}) == 6


def test_small_or_unknown_families_fail(spark):
    families = spark.createDataFrame([("a0", "a"), ("b0", "b")], "species string, family string")
    too_small = spark.createDataFrame([("t", "a0", 1), ("t", "a1", 0)], GROUPS)
    with pytest.raises(Exception, match="no family for template species 'a1'"):
        S.resample_family(families, too_small, 2).collect()
    families = families.union(spark.createDataFrame([("a1", "a"), ("b1", "b")]))
    template = spark.createDataFrame([("t", "a0", 1), ("t", "a1", 1), ("t", "a0", 0)], GROUPS)
    with pytest.raises(Exception, match="too few species"):
        S.resample_family(families, template, 2).collect()
    with pytest.raises(Exception, match="too few species"):
        S.resample_random(pool(spark, 4), 3, 2, 1).collect()


def test_value_strategies(spark):
    permuted = spark.createDataFrame(
        [("b_1", "p", 9.0), ("b_1", "q", 5.0), ("b_1", "r", 2.0), ("b_1", "s", 1.0), ("b_1", "u", 7.5)],
        "cycle string, species string, value double",
    )
    values = spark.createDataFrame(
        [("x", 9.0), ("y", 5.0), ("z", 2.0), ("w", 1.0)], "species string, value double"
    )
    template = spark.createDataFrame([("t", "x", 1), ("t", "y", 1), ("t", "z", 0), ("t", "w", 0)], GROUPS)
    one_each = template.where("species in ('x', 'z')")

    def pick(strategy, groups):
        rows = S.select_by_value(permuted, values, groups, strategy).collect()
        return {(r.species, r.grp) for r in rows}

    both = {("p", 1), ("q", 1), ("r", 0), ("s", 0)}
    assert pick("inner", template) == pick("edges", template) == pick("random", template) == both
    assert pick("inner", one_each) == {("p", 1), ("r", 0)}
    tied = template.where("species <> 'w'")
    assert pick("inner", tied) == {("p", 1), ("q", 1), ("r", 0)}
    with pytest.raises(ValueError):
        pick("outer", template)


@pytest.mark.parametrize("value", (9.0, 1.0))
def test_value_groups_that_stay_short_fail(spark, value):
    permuted = spark.createDataFrame([("b_1", "p", value), ("b_1", "q", 2.0)], "cycle string, species string, value double")
    values = spark.createDataFrame([("x", 9.0), ("y", 5.0), ("z", 2.0)], "species string, value double")
    template = spark.createDataFrame([("t", "x", 1), ("t", "y", 1), ("t", "z", 0)], GROUPS)
    with pytest.raises(Exception, match="too few candidates in cycle 'b_1'"):
        S.select_by_value(permuted, values, template, "inner").collect()


def test_strategies_order_their_candidates(spark):
    permuted = spark.createDataFrame(
        [("b_1", f"s{i}", float(v)) for i, v in enumerate((1, 1, 2, 2, 3, 3))],
        "cycle string, species string, value double",
    )
    values = spark.createDataFrame([("x", 1.0), ("y", 3.0), ("z", 2.0), ("w", 3.0)], "species string, value double")
    template = spark.createDataFrame([("t", "x", 1), ("t", "y", 1), ("t", "z", 0), ("t", "w", 0)], GROUPS)

    def pick(strategy):
        rows = S.select_by_value(permuted, values, template, strategy).collect()
        return sorted(r.species for r in rows if r.grp == 1), sorted(r.species for r in rows if r.grp == 0)

    assert pick("inner") == (["s4", "s5"], ["s2", "s3"])
    assert pick("edges") == (["s0", "s1"], ["s4", "s5"])


def test_cycles_and_groups_convert(spark):
    groups = S.resample_random(pool(spark), 2, 3, 12, seed=1)
    cycles = S.cycle_lists(groups)
    assert {tuple(r) for r in S.cycles_to_groups(cycles).collect()} == {tuple(r) for r in groups.collect()}
    swapped = {(r.trait, r.species, 1 - r.grp) for r in S.cycles_to_groups(cycles, fg_label=0).collect()}
    assert swapped == {tuple(r) for r in groups.collect()}
    again = S.text_to_cycles(S.cycle_text(cycles))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, cycles.collect()))
    first = S.first_cycles(groups, 10).select("trait").distinct().collect()
    assert {r.trait for r in first} == {f"b_{i}" for i in range(1, 11)}


def test_first_cycles_keep_names_without_a_number(spark):
    groups = spark.createDataFrame([("cycle_b", "x", 1), ("b_2", "x", 1), ("cycle_a", "x", 1)], "trait string, species string, grp int")
    assert {r.trait for r in S.first_cycles(groups, 2).collect()} == {"b_2", "cycle_a"}


def test_draws_of_many_are_those_of_floyd_and_are_made_behind_the_spread(spark):
    def digest(*parts):
        return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()

    def floyd(size, wanted, cycle):
        chosen = set()
        for j in range(size - wanted, size):
            i = int(digest(3, cycle, j)[:15], 16) % (j + 1)
            chosen.add(j if i in chosen else i)
        return sorted(chosen, key=lambda i: digest(3, cycle, "order", i))

    asked = [(c, *x) for c in range(20) for x in ((1, 1), (30, 9), (400, 400), (400, 399), (3000, 1500))]
    frame = spark.createDataFrame(asked, "cycle long, size long, wanted long")
    drawn = frame.select("*", S.draw_indexes(F.col("size"), F.col("wanted"), F.col("cycle"), seed=3).alias("picks"))
    for r in drawn.collect():
        assert r.picks == floyd(r.size, r.wanted, r.cycle)
    groups = S.resample_random(pool(spark), 5, 4, 10, seed=1)
    plan = groups._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "md5" in line]
