from __future__ import annotations

import random

import brute
from pyspark.sql import functions as F

from cladewise.functions.bounds import Bounds
from cladewise.operators import details
from cladewise.operators.details import cells_at, hit_details, number_species
from cladewise.plans.discovery import discovery
from cladewise.schema import GROUPS, RECORDS


def long_case(seed, ragged):
    """Traits of up to 150 members, so that members fill several words."""
    rng = random.Random(seed)
    records, _ = brute.random_case(seed, n_genes=2, n_species=160, width=12, n_traits=0, ragged=ragged)
    # Groups that rarely share a symbol: foreground species show other symbols in some columns.
    records = [(g, s, "".join("Z" if int(s[1:]) % 3 == 0 and k % 2 else c for k, c in enumerate(q))) for g, s, q in records]
    names = [f"s{i:02d}" for i in range(160)] + ["absent_a", "absent_b"]
    fg = [s for s in names if s[1:].isdigit() and int(s[1:]) % 3 == 0]
    bg = [s for s in names if s not in fg]
    groups = {"all": (fg, bg)}
    for t in range(6):
        groups[f"t{t}"] = (rng.sample(fg, rng.randint(1, 50)), rng.sample(bg, rng.randint(1, 100)))
    return records, groups


def test_members_fill_several_words(spark, monkeypatch):
    monkeypatch.setattr(details, "_BUCKET", 40)
    for seed, ragged, bounds in ((1, False, Bounds()), (2, True, Bounds(max_fg_gaps=20, max_miss=30))):
        records, groups = long_case(seed, ragged)
        frames = spark.createDataFrame(records, RECORDS), spark.createDataFrame(brute.group_rows(groups), GROUPS)
        rows = discovery(*frames, bounds, "1,2,3,4", 0.9, ragged)
        got = [tuple(r) for r in rows.withColumn("Pvalue", F.round("Pvalue", 9)).collect()]
        want = brute.discovery(records, groups, bounds, (1, 2, 3, 4), 0.9)
        assert want and len(got) == len(want)
        assert set(got) == want


def test_numbers_are_places_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(details, "_BUCKET", 40)
    _, groups = long_case(3, False)
    places = number_species(spark.createDataFrame(brute.group_rows(groups), GROUPS)).collect()
    assert len({r.species for r in places}) == len(places) == 162
    assert len({(r.word, r.bit) for r in places}) == len(places)
    assert all(0 <= r.bit < 64 for r in places)


def test_members_without_a_column(spark):
    """A member absent from the gene is missing, one without a symbol gapped, one in both groups named once."""
    records = spark.createDataFrame([("g", "a", "A"), ("g", "b", "-"), ("g", "c", "")], RECORDS)
    groups = [("t", s, 1) for s in "abcd"] + [("t", s, 0) for s in "de"]
    hits = spark.createDataFrame([("g", 0, "t", 4, 2, 7)], "gene string, pos int, trait string, n_fg long, n_bg long, x int")
    r = hit_details(hits, records, spark.createDataFrame(groups, GROUPS)).first()
    assert (r.ffgn, r.gfg, r.mfg, r.ffgn + r.fbgn, r.gbg, r.mbg, r.x) == (1, 2, 1, 1, 0, 2, 7)
    assert (r.fg_found, r.bg_found, sorted(r.missing)) == (["a"], [], ["d", "e"])
    assert (r.fg_symbols, r.bg_symbols) == (["A"], [])


def test_only_wanted_columns_are_taken_apart(spark):
    records = spark.createDataFrame([("g", "a", "AC-D"), ("g", "b", "A"), ("h", "a", "XYZ")], "gene string, species string, seq string")
    wanted = spark.createDataFrame([("g", [3, 0, 2])], "gene string, at array<int>")
    got = {(r.gene, r.species, r.pos, r.symbol) for r in cells_at(records, wanted).collect()}
    assert got == {("g", "a", 0, "A"), ("g", "a", 2, "-"), ("g", "a", 3, "D"), ("g", "b", 0, "A")}
