"""Published result files, found by their layout, against our results on the same alignments."""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cladewise.functions.bounds import Bounds
from cladewise.operators.columns import slice_columns
from cladewise.plans.bootstrap import bootstrap
from cladewise.plans.discovery import discovery
from cladewise.sources.alignments import read_alignments
from cladewise.sources.traits import read_bootstrap, read_cycle_groups, read_groups

ROOT = os.environ.get("GOLDEN_DIR")
HEADER = "Gene\tTrait\tPosition\tSubstitution"


def first_line(path: Path) -> str:
    try:
        with open(path) as handle:
            return handle.readline()
    except UnicodeDecodeError:
        return ""


@pytest.fixture(scope="module")
def published(spark):
    """Alignments, groups and published rows that belong together."""
    files = [p for p in Path(ROOT).rglob("*") if p.is_file()] if ROOT else []
    results = {}
    for path in files:
        if first_line(path).startswith(HEADER):
            rows = [line.split("\t") for line in path.read_text().splitlines()[1:]]
            if rows and path.name.count(".") >= 2:
                results[path.name.rsplit(".", 1)[0]] = rows
    alignments = {p.name: p for p in files if p.suffix == ".fasta" and p.name in results}
    if not alignments:
        pytest.skip("no published results here")
    trait = next(iter(results.values()))[0][1]
    config = next(p for p in files if p.name == trait)
    records = read_alignments(spark, f"{next(iter(alignments.values())).parent}/*.fasta", "phylip-relaxed")
    genes = {name.split(".")[0] for name in alignments}
    return {
        "files": files,
        "rows": [r for name in alignments for r in results[name]],
        "genes": genes,
        "records": records.where(F.col("gene").isin(*genes)),
        "groups": read_groups(spark, str(config)),
    }


def test_hits_without_gaps_or_missing(published):
    found = discovery(published["records"], published["groups"], Bounds(max_gaps=0, max_miss=0))
    ours = {
        (r.Gene, r.Position, r.Substitution, r.Pattern[-1], r.FFGN, r.FBGN, r.FFG, r.FBG)
        for r in found.collect()
    }
    theirs = {
        (r[0], int(r[2]), r[3], r[5][-1], int(r[6]), int(r[7]), r[12], r[13]) for r in published["rows"]
    }
    assert len(theirs) > 600
    assert ours == theirs


def test_kept_columns(spark, published):
    checked = 0
    for path in published["files"]:
        gene = first_line(path).split("@")[0]
        if path.suffix != ".boot" or gene not in published["genes"]:
            continue
        theirs = {r.position for r in read_bootstrap(spark, str(path)).select("position").collect()}
        mine = slice_columns(published["records"].where(F.col("gene") == gene), 3)
        assert {f"{r.gene}@{r.pos}" for r in mine.collect()} == theirs
        checked += 1
    assert checked


def test_missing_species_cut_cycles(spark, published):
    """Cycles naming an absent species may hit, but never once missing species are ruled out."""
    cycle_files = [
        p for p in published["files"]
        if len(parts := first_line(p).rstrip("\n").split("\t")) == 3 and parts[0].startswith("b_")
    ]
    assert cycle_files
    gene = sorted(published["genes"])[0]
    records = published["records"].where(F.col("gene") == gene)
    present = {r.species for r in records.select("species").collect()}
    seen = 0
    for path in cycle_files:
        groups, n = read_cycle_groups(spark, str(path))
        rows = groups.collect()
        lacking = {r.trait for r in rows if r.species not in present}

        def cycles(bounds):
            out = {}
            for r in bootstrap(records, groups, n, 3, bounds).collect():
                assert 0 <= r.empval <= 1
                out[r.position] = {c for c in r.cycle_list.split(",") if c}
            return out

        free, strict = cycles(Bounds()), cycles(Bounds(max_miss=0))
        assert free.keys() == strict.keys()
        for position, names in strict.items():
            assert names == free[position] - lacking
        seen += sum(map(len, free.values()))
    assert seen
