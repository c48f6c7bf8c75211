from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cladewise.functions.bounds import Bounds
from cladewise.functions.text import file_stem, folder_value, gene_name
from cladewise.operators import sampling as S
from cladewise.operators import tree as T
from cladewise.operators.columns import cells
from cladewise.plans.bootstrap import bootstrap, empirical_values
from cladewise.plans.discovery import discovery
from cladewise import schema
from cladewise.schema import RECORDS
from cladewise.sinks import tables as K
from cladewise.sources import alignments as R
from cladewise.sources import traits as G
from cladewise.sources.files import manifest

EXPECTED = {("toy", "sp1", "AC-D"), ("toy", "sp2", "ACED"), ("toy", "sp3", "-CEF")}

FORMATS = {
    "fasta": ">sp1 first >one\nAC\n-D\n>sp2\r\nACED\r\n>sp3\n-C EF\n",
    "phylip-relaxed": " 3 4\nsp1   AC-D\nsp2 AC ED\nsp3\t-CEF\n",
    "clustal": (
        "CLUSTAL W (1.81) multiple sequence alignment\n\n"
        "sp1   AC 2\nsp2   AC 2\nsp3   -C 1\n       *\n\n"
        "sp1   -D\nsp2   ED\nsp3   EF\n\n"
    ),
    "stockholm": (
        "# STOCKHOLM 1.0\n#=GF ID x\nsp1 AC\nsp2 AC\nsp3 .C\n\n"
        "sp1 -D\n#=GR sp1 SS HH\nsp2 ED\nsp3 EF\n//\n"
    ),
}


@pytest.mark.parametrize("fmt", sorted(FORMATS))
def test_alignment_formats(spark, tmp_path, fmt):
    (tmp_path / "toy.set1.txt").write_bytes(FORMATS[fmt].encode())
    rows = R.read_alignments(spark, str(tmp_path), fmt)
    assert {tuple(r) for r in rows.collect()} == EXPECTED
    assert R.ragged_genes(rows).count() == 0


def test_interleaved_phylip(spark, tmp_path):
    names = [f"s{i}" for i in range(40)]
    blocks = [[f"{'ACDE'[(i + b) % 4] * 5} {'KLMN'[(i + b) % 4] * 5}" for i in range(40)] for b in range(6)]
    lines = ["40 60"] + [f"{s}  {q}" for s, q in zip(names, blocks[0])]
    for block in blocks[1:]:
        lines += ["", *("   " + q for q in block)]
    (tmp_path / "g.phy").write_text("\n".join(lines) + "\n")
    expected = {(s, "".join(b[i].replace(" ", "") for b in blocks)) for i, s in enumerate(names)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "501")
    try:
        rows = R.read_alignments(spark, str(tmp_path / "g.phy"), "phylip-relaxed")
        assert {(r.species, r.seq) for r in rows.collect()} == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("text", ("2 8\na ACDE\nb ACDE\n", "3 4\na ACDE\nb ACDE\n", "a ACDE\nb ACDE\n"))
def test_phylip_that_does_not_fit_its_counts_fails(spark, tmp_path, text):
    (tmp_path / "g.phy").write_text(text)
    with pytest.raises(Exception, match="in the file of gene 'g'"):
        R.read_alignments(spark, str(tmp_path), "phylip-relaxed").collect()


def test_fasta_across_file_splits(spark, tmp_path):
    records = {f"s{i}": "ACDE"[i % 4] * 500 for i in range(300)}
    (tmp_path / "big.fa").write_text("".join(f">{s}\n{q[:250]}\n{q[250:]}\n" for s, q in records.items()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7001")
    try:
        rows = R.read_alignments(spark, str(tmp_path / "big.fa"), "fasta", unique_ids=True)
        assert rows.rdd.getNumPartitions() > 10
        assert {(r.species, r.seq) for r in rows.collect()} == set(records.items())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_repeated_ids_keep_the_last(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">a\nAA\n>b\nBB\n>a\nCC\n")
    rows = R.read_alignments(spark, str(tmp_path), "fasta")
    assert {(r.species, r.seq) for r in rows.collect()} == {("a", "CC"), ("b", "BB")}


def test_files_of_one_name_are_an_error(spark, tmp_path):
    for fmt, text in FORMATS.items():
        folder = tmp_path / fmt
        folder.mkdir()
        for version in ("v1", "v2"):
            (folder / f"toy.{version}.txt").write_bytes(text.encode())
        with pytest.raises(ValueError, match="toy"):
            R.read_alignments(spark, str(folder), fmt)
    for folder in ("x", "y"):
        (tmp_path / "traits" / folder).mkdir(parents=True)
        (tmp_path / "traits" / folder / "one.cfg").write_text("a\t1\n")
    with pytest.raises(ValueError, match="one.cfg"):
        G.read_groups(spark, str(tmp_path / "traits" / "*"))


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        R.read_alignments(spark, "x", "nexus")


def test_ragged_genes_are_told(spark):
    rows = spark.createDataFrame([("g", "a", "AA"), ("g", "b", "A"), ("h", "a", "A")], RECORDS)
    assert [r.gene for r in R.ragged_genes(rows).collect()] == ["g"]


def test_group_files(spark, tmp_path):
    (tmp_path / "one.cfg").write_text("a\t1\nb  0\nc\t-1\nbad\n\na\t1\n")
    (tmp_path / "two.cfg").write_text("a\t0\nd\t1\n")
    many = {tuple(r) for r in G.read_groups(spark, str(tmp_path)).collect()}
    assert many == {("one.cfg", "a", 1), ("one.cfg", "b", 0), ("two.cfg", "a", 0), ("two.cfg", "d", 1)}
    one = G.read_groups(spark, str(tmp_path / "one.cfg"))
    assert one.count() == 2
    rejected = {r.trait: r["count"] for r in G.rejected_group_lines(spark, str(tmp_path)).collect()}
    assert rejected == {"one.cfg": 3}


def test_cycle_files(spark, tmp_path):
    (tmp_path / "cycles.tab").write_text("b_1\ta,b\tc\nbad line\nb_2\tc,\ta,b\nb_1\td\te\n")
    groups, n = G.read_cycle_groups(spark, str(tmp_path / "cycles.tab"))
    assert n == 4
    assert {tuple(r) for r in groups.collect()} == {
        ("b_1", "a", 1), ("b_1", "b", 1), ("b_1", "c", 0), ("b_2", "c", 1), ("b_2", "a", 0),
        ("b_2", "b", 0), ("b_1", "d", 1), ("b_1", "e", 0),
    }


def test_family_value_and_tree_files(spark, tmp_path):
    (tmp_path / "fam.tab").write_text("Species\tFamily\na\tF1\nb\tF2\n")
    assert G.read_families(spark, str(tmp_path / "fam.tab")).count() == 3
    kept = G.read_families(spark, str(tmp_path / "fam.tab"), header=True)
    assert {tuple(r) for r in kept.collect()} == {("a", "F1"), ("b", "F2")}
    (tmp_path / "values.tab").write_text("a\t1.5\t-1\nb\t2\nhead\tvalue\n")
    values = {tuple(r) for r in G.read_trait_values(spark, str(tmp_path / "values.tab")).collect()}
    assert values == {("a", 1.5, -1), ("b", 2.0, None)}
    (tmp_path / "x.nw").write_text("(\na:1,\n(b:1,c:2):0.5);\n")
    trees = G.read_newick(spark, str(tmp_path / "x.nw"))
    tips = T.tree_tips(trees).collect()
    assert {(r.tree, r.species) for r in tips} == {("x.nw", "a"), ("x.nw", "b"), ("x.nw", "c")}


def test_bootstrap_files_of_both_ages(spark, tmp_path):
    (tmp_path / "new.boot").write_text("g@1\t2\t10\t0.2\tb_1,b_2\tcfg\ng@2\t0\t10\t0.0\t\tcfg\n")
    (tmp_path / "old.boot").write_text("g@1\t2\t0.2\tb_1,b_2\tcfg\n")
    new = G.read_bootstrap(spark, str(tmp_path / "new.boot"))
    assert {tuple(r) for r in new.collect()} == {
        ("g@1", 2, 10, 0.2, "b_1,b_2", "cfg"), ("g@2", 0, 10, 0.0, "", "cfg"),
    }
    old = G.read_bootstrap(spark, str(tmp_path / "old.boot"))
    assert [tuple(r) for r in old.collect()] == [("g@1", 2, None, 0.2, "b_1,b_2", "cfg")]
    assert {tuple(r) for r in empirical_values(new).collect()} == {("g@1", 0.2), ("g@2", 0.0)}


@pytest.fixture()
def toy(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "toy.fa").write_text(">a\nAAC\n>b\nABC\n>c\nBB-\n>d\nBBC\n")
    (tmp_path / "in" / "void.fa").write_text(">a\nAAA\n>b\nAAA\n>c\nAAA\n>d\nAAA\n")
    (tmp_path / "trait.cfg").write_text("a\t1\nb\t1\nc\t0\nd\t0\n")
    return (
        R.read_alignments(spark, str(tmp_path / "in"), "fasta"),
        G.read_groups(spark, str(tmp_path / "trait.cfg")),
    )


def test_discovery_from_files_to_files(spark, tmp_path, toy):
    records, groups = toy
    hits = discovery(records, groups)
    K.write_discovery(hits, str(tmp_path / "out"), "tsv")
    lines = [r.value for f in (tmp_path / "out").glob("*.csv") for r in spark.read.text(str(f)).collect()]
    assert lines[0].startswith("Gene\tTrait\tPosition\tSubstitution\tPvalue\tPattern")
    assert [x.split("\t")[:4] for x in lines[1:]] == [["toy", "trait.cfg", "0", "A/B"]]
    K.write_discovery_by_job(hits, str(tmp_path / "jobs"))
    assert (tmp_path / "jobs" / "Gene=toy" / "Trait=trait.cfg").is_dir()
    none = hits.where("Gene = 'void'")
    K.write_discovery(none, str(tmp_path / "none"))
    back = spark.read.parquet(str(tmp_path / "none"))
    assert back.count() == 0 and back.columns == hits.columns


def test_cycles_and_bootstrap_round_trip(spark, tmp_path, toy):
    records, _ = toy
    species = records.select("species").distinct()
    groups = S.resample_random(species, 2, 2, 30, seed=4)
    K.write_cycles(S.cycle_lists(groups), str(tmp_path / "cycles"))
    revived, n = G.read_cycle_groups(spark, str(tmp_path / "cycles"))
    assert n == 30
    assert {tuple(r) for r in revived.collect()} == {tuple(r) for r in groups.collect()}
    rows = bootstrap(records, revived, n, 2, Bounds(), trait_config="trait.cfg")
    K.write_bootstrap(rows, str(tmp_path / "boot"))
    back = G.read_bootstrap(spark, str(tmp_path / "boot"))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in rows.collect()}
    for r in back.collect():
        named = [c for c in r.cycle_list.split(",") if c]
        assert len(named) == r["count"] and r.empval == pytest.approx(r["count"] / 30)


def test_readers_give_the_named_layouts(spark, tmp_path):
    (tmp_path / "x").write_text("a\tb\tc\n")
    path = str(tmp_path / "x")
    read = {
        schema.RECORDS: R.read_alignments(spark, path, "phylip-relaxed"),
        schema.GROUPS: G.read_groups(spark, path),
        schema.CYCLES: G.read_cycles(spark, path),
        schema.FAMILIES: G.read_families(spark, path),
        schema.TRAIT_VALUES: G.read_trait_values(spark, path),
        schema.CELLS: cells(R.read_alignments(spark, path, "phylip-relaxed")).select(
            "gene", "species", "pos", "symbol"
        ),
        schema.TREE_EDGES: T.tree_edges(G.read_newick(spark, path)),
    }
    for layout, frame in read.items():
        got = [f"{f.name} {f.dataType.simpleString().upper()}" for f in frame.schema]
        assert ", ".join(got) == layout


def test_cycle_configs(spark, tmp_path):
    groups = spark.createDataFrame(
        [(f"b_{i}", s, g) for i in range(1, 13) for s, g in (("a", 1), ("b", 0))],
        "trait string, species string, grp int",
    )
    K.write_cycle_configs(S.cycle_lists(groups), str(tmp_path / "cfg"), n=10)
    assert len(list((tmp_path / "cfg").glob("trait=*"))) == 10
    K.write_cycle_configs(S.cycle_lists(groups), str(tmp_path / "swapped"), fg_label=0)
    lines = spark.read.text(str(tmp_path / "swapped" / "trait=b_12")).collect()
    assert {r.value for r in lines} == {"a\t0", "b\t1"}


def test_files_as_jobs_of_their_own(spark, tmp_path):
    """Named by their base name less its last suffix, two files of one gene are two jobs."""
    for job, symbol in (("G1.v1", "A"), ("G1.v2", "C")):
        (tmp_path / f"{job}.fa").write_text(f">a\n{symbol}{symbol}\n>b\n{symbol}-\n")
    with pytest.raises(ValueError, match="G1"):
        R.read_alignments(spark, str(tmp_path), "fasta")
    rows = R.read_alignments(spark, str(tmp_path), "fasta", name=file_stem)
    assert sorted(map(tuple, rows.collect())) == [
        ("G1.v1", "a", "AA"), ("G1.v1", "b", "A-"), ("G1.v2", "a", "CC"), ("G1.v2", "b", "C-")
    ]
    listed = manifest(spark, str(tmp_path)).collect()
    assert sorted((r.name, r.bytes) for r in listed) == [("G1.v1", 12), ("G1.v2", 12)]
    with pytest.raises(ValueError, match="G1"):
        R.read_alignments(spark, str(tmp_path), "fasta", name=gene_name)


def test_names_of_odd_paths(spark):
    paths = ["/x/G1.v1.fa", "plain", "/a.b/.hidden", "/a/two..dots", "/trait=n 1/part-0.txt", ""]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select(file_stem(F.col("p")), folder_value("trait")(F.col("p")))
    assert [tuple(r) for r in rows.collect()] == [
        ("G1.v1", ""), ("plain", ""), (".hidden", ""), ("two.", ""), ("part-0", "n 1"), ("", "")
    ]
