"""A small alignment and its answer, worked out by hand from the definitions."""

from __future__ import annotations

import pytest

from cladewise.functions.bounds import Bounds
from cladewise.plans.discovery import discovery
from cladewise.sources.alignments import read_alignments
from cladewise.sources.traits import read_groups

#: Columns 0 to 5: one symbol everywhere; K against R; V shared; S with a gap against T; K, L against R;
#: only a species outside of the groups differs.
SEQUENCES = {
    "a": "MKL-KM",
    "b": "MKLSLM",
    "c": "MKVSKM",
    "x": "MRVTRM",
    "y": "MRITRM",
    "z": "MRITRM",
    "other": "MRLTRW",
}
GROUPS = {"a": 1, "b": 1, "c": 1, "x": 0, "y": 0, "z": 0}


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("hand")
    (root / "genes").mkdir()
    (root / "genes" / "G1.fasta").write_text("".join(f">{k}\n{v}\n" for k, v in SEQUENCES.items()))
    # A gene without c and z.
    (root / "genes" / "G2.fasta").write_text("".join(f">{k}\n{SEQUENCES[k][1]}\n" for k in "abxy"))
    (root / "long.tab").write_text("".join(f"{k}\t{v}\n" for k, v in GROUPS.items()))
    return read_alignments(spark, f"{root}/genes", fmt="fasta"), read_groups(spark, f"{root}/long.tab")


def hits(inputs, **bounds):
    found = discovery(*inputs, Bounds(**bounds), patterns="1,2,3").collect()
    return {
        (r.Gene, r.Position, r.Substitution, r.Pattern, r.FFGN, r.FBGN, r.GFG, r.GBG, r.MFG, r.MBG, r.FFG, r.FBG, r.MS)
        for r in found
    }


WHOLE = {
    ("G1", 1, "K/R", "pattern1", 3, 3, 0, 0, 0, 0, "a,b,c", "x,y,z", "-"),
    ("G1", 4, "KL/R", "pattern3", 3, 3, 0, 0, 0, 0, "a,b,c", "x,y,z", "-"),
}
GAPPED = ("G1", 3, "S/T", "pattern1", 2, 3, 1, 0, 0, 0, "b,c", "x,y,z", "-")
SHORT = ("G2", 0, "K/R", "pattern1", 2, 2, 0, 0, 1, 1, "a,b", "x,y", "c,z")


def test_hits_with_neither_gaps_nor_missing_species(inputs):
    assert hits(inputs, max_gaps=0, max_miss=0) == WHOLE


def test_a_gap_allowed(inputs):
    assert hits(inputs, max_fg_gaps=1, max_bg_gaps=0, max_miss=0) == WHOLE | {GAPPED}


def test_a_missing_species_allowed_in_each_group(inputs):
    assert hits(inputs, max_gaps=0, max_fg_miss=1, max_bg_miss=1) == WHOLE | {SHORT}
