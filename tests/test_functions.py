from __future__ import annotations

import math
import random

import brute
import pytest
from pyspark.sql import functions as F

from cladewise.functions import text
from cladewise.functions.bounds import Bounds
from cladewise.functions.stats import all_drawn, column_pvalue
from cladewise.functions.verdict import parse_patterns
from cladewise.operators import columns as C
from cladewise.operators import evidence as E
from cladewise.schema import GROUPS, RECORDS


def test_pvalue_against_exact_fractions(spark):
    rng = random.Random(3)
    cases = []
    for _ in range(300):
        counts = [rng.randint(1, 30) for _ in range(rng.randint(1, 6))]
        f, b = rng.randint(1, 6), rng.randint(1, 6)
        if f + b <= sum(counts):
            cases.append((counts, f, b))
    df = spark.createDataFrame(cases, "counts array<bigint>, f int, b int")
    rows = df.select("*", column_pvalue(F.col("counts"), F.col("f"), F.col("b")).alias("p")).collect()
    for r in rows:
        assert r.p == pytest.approx(brute.pvalue(r.counts, r.f, r.b), rel=1e-9, abs=1e-15)


def test_chances_in_decks_of_any_size(spark):
    cases = [(1_500_003, 1_000_000, 1_500_000), (2_000_000, 3, 1_999_990), (60_000, 20_000, 59_999), (40, 40, 40), (9, 0, 4), (9, 5, 4)]
    df = spark.createDataFrame(cases, "deck bigint, drawn bigint, wanted bigint")
    for r in df.select("*", all_drawn(F.col("deck"), F.col("drawn"), F.col("wanted")).alias("p")).collect():
        if r.wanted < r.drawn:
            assert r.p == 0
        else:
            logs = (math.log1p((r.wanted - r.deck) / (r.deck - i)) for i in range(r.drawn))
            assert r.p == pytest.approx(math.exp(math.fsum(logs)), rel=1e-9)


def test_pvalues_of_columns_worth_testing(spark):
    seqs = ["AAA-", "AAC-", "ACC-", "ACCC"]
    records = spark.createDataFrame([("g", f"s{i}", q) for i, q in enumerate(seqs)], RECORDS)
    rows = {r.pos: r.pvalue for r in C.column_pvalues(records, 1, 1).collect()}
    expected = {p: pytest.approx(brute.pvalue(n, 1, 1)) for p, n in ((1, [2, 2]), (2, [1, 3]))}
    assert rows == expected


def test_two_symbols_of_unequal_groups_count_twice(spark):
    df = spark.createDataFrame([([6, 4],)], "counts array<bigint>")
    p = df.select(column_pvalue(F.col("counts"), F.lit(3), F.lit(2))).first()[0]
    once = sum(
        brute.all_drawn(10, 3, x) * brute.all_drawn(7, 2, 10 - x) for x in (6, 4)
    )
    assert p == pytest.approx(float(2 * once))


def test_names(spark):
    df = spark.createDataFrame([("/a/b.c/GENE.sp.fasta", "x,,y,")], "path string, names string")
    row = df.select(
        text.gene_name(F.col("path")),
        text.file_name(F.col("path")),
        text.names_in(F.col("names")),
        text.pair_key(F.lit("b"), F.lit("a")),
    ).first()
    assert tuple(row) == ("GENE", "GENE.sp.fasta", ["x", "y"], "a@b")


def test_patterns():
    assert parse_patterns("1, 2,3") == (1, 2, 3)
    for wrong in ("", "5", "12"):
        with pytest.raises(ValueError):
            parse_patterns(wrong)


def test_bounds():
    assert Bounds(max_fg_gaps=1, max_bg_miss=2, max_gaps=3).threshold(4, 3) == 1
    assert Bounds().unlimited and not Bounds(max_miss=0).unlimited
    with pytest.raises(ValueError):
        Bounds(max_bg_gaps=1, bg_bound="fg")


def test_profile_counts_gaps_both_ways(spark):
    full = spark.createDataFrame([("g", "a", "A-B-"), ("g", "b", "AC--"), ("g", "c", "B---")], RECORDS)
    short = spark.createDataFrame([("g", "a", "A-B"), ("g", "b", "AC"), ("g", "c", "B")], RECORDS)
    expected = [(0, 3, 0, 1), (1, 3, 2, 0), (2, 3, 2, 0)]

    def rows(df, ragged):
        return sorted(
            tuple(r) for r in C.column_profile(df, ragged).select("pos", "total", "gaps", "minority").collect()
        )

    # The fourth column is all gaps: only rectangular records name it.
    assert rows(full, False) == expected + [(3, 3, 3, 0)]
    assert rows(short, True) == expected


def test_sparse_cells_become_records(spark):
    cells = spark.createDataFrame(
        [("g", "a", 0, "X"), ("g", "a", 3, "Y"), ("g", "b", 1, "Z")],
        "gene string, species string, pos int, symbol string",
    )
    got = {(r.species, r.seq) for r in C.assemble_records(cells).collect()}
    assert got == {("a", "X--Y"), ("b", "-Z")}


def test_any_alphabet(spark):
    records = spark.createDataFrame([("g", "a", "é中\n"), ("g", "b", "e😀x")], RECORDS)
    got = {(r.species, r.pos, r.symbol) for r in C.cells(records).collect()}
    assert got == {("a", 0, "é"), ("a", 1, "中"), ("a", 2, "\n"), ("b", 0, "e"), ("b", 1, "😀"), ("b", 2, "x")}


def test_evidence_and_missing_on_random_case(spark):
    records, groups = brute.random_case(11)
    records_df = spark.createDataFrame(records, RECORDS)
    groups_df = spark.createDataFrame(brute.group_rows(groups), GROUPS)
    expected = {}
    for (gene, pos), column in brute.columns_of(records).items():
        for trait, (fg, bg) in groups.items():
            e = brute.evaluate(column, fg, bg)
            if e:
                expected[gene, pos, trait] = (e["tag"], e["hit"], e["pattern"], *e["gaps"])
    got = {}
    for r in E.with_verdict(E.group_evidence(records_df, groups_df)).collect():
        tag = "".join(r.fg_symbols) + "/" + "".join(r.bg_symbols)
        got[r.gene, r.pos, r.trait] = (tag, r.is_hit, r.pattern, r.gfg, r.gbg)
    assert got == expected

    by_gene = {}
    for gene, species, _ in records:
        by_gene.setdefault(gene, set()).add(species)
    for r in E.missing_members(records_df, groups_df).collect():
        fg, bg = groups[r.trait]
        assert r.missing == sorted(s for s in fg + bg if s not in by_gene[r.gene])
        assert r.mfg == sum(s not in by_gene[r.gene] for s in fg)


def test_symbol_species(spark):
    records, _ = brute.random_case(12)
    expected = {}
    for (gene, pos), column in brute.columns_of(records).items():
        for species, symbol in column.items():
            expected.setdefault((gene, pos, symbol), []).append(species)
    rows = C.symbol_species(spark.createDataFrame(records, RECORDS)).collect()
    assert {(r.gene, r.pos, r.symbol): r.species for r in rows} == {k: sorted(v) for k, v in expected.items()}
    assert len(rows) == len(expected)
