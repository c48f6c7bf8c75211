from __future__ import annotations

import random

import pytest

from cladewise.operators import tree as T


def build(rng, tips, comb=False):
    """A random tree as Newick text, with parents and lengths by label."""
    nodes, links = [(f"t{i}", None) for i in range(tips)], {}
    texts = {name: name for name, _ in nodes}
    live, n = [name for name, _ in nodes], 0
    while len(live) > 1:
        size = 2 if comb else min(len(live), rng.choice((2, 2, 3)))
        children = live[:size] if comb else rng.sample(live, size)
        name = f"n{n}"
        n += 1
        inside = []
        for child in children:
            links[child] = (name, rng.choice((0, 1, 2, 2.5, 7)))
            inside.append(f"{texts[child]}:{links[child][1]}")
        texts[name] = f"({','.join(inside)}){name}"
        live = [name] + [x for x in live if x not in children]
    return texts[live[0]] + ";", links


def distance(links, a, b):
    def path(x):
        out = {x: 0.0}
        total = 0.0
        while x in links:
            x, length = links[x]
            total += length
            out[x] = total
        return out

    pa, pb = path(a), path(b)
    return min(pa[x] + pb[x] for x in pa.keys() & pb.keys())


@pytest.fixture(scope="module")
def forest(spark):
    rng = random.Random(9)
    built = {f"tree{i}": build(rng, rng.randint(2, 25), comb=i % 3 == 0) for i in range(24)}
    trees = spark.createDataFrame([(k, v[0]) for k, v in built.items()], "tree string, newick string")
    return {k: v[1] for k, v in built.items()}, trees


def tips_of(links):
    return sorted(x for x in links if x.startswith("t"))


def test_edges(forest):
    links, trees = forest
    edges = T.tree_edges(trees).collect()
    names = {(e.tree, e.node): e.label for e in edges}
    for tree, parents in links.items():
        mine = [e for e in edges if e.tree == tree]
        got = {e.label: (names[tree, e.parent], e.length) for e in mine if e.parent is not None}
        assert got == parents
        assert {e.label for e in mine if e.is_tip} == set(tips_of(parents))
        assert sum(e.parent is None for e in mine) == 1


def test_pair_distances(spark, forest):
    links, trees = forest
    rng = random.Random(1)
    pairs = [
        (tree, rng.choice(tips), rng.choice(tips))
        for tree, parents in links.items()
        for tips in [tips_of(parents)]
        for _ in range(30)
    ]
    pairs = sorted(set(pairs))
    asked = spark.createDataFrame(pairs, "tree string, a string, b string")
    got = {(r.tree, r.a, r.b): r.d for r in T.pair_distances(trees, asked).collect()}
    assert set(got) == set(pairs)
    for (tree, a, b), d in got.items():
        assert d == pytest.approx(distance(links[tree], a, b))


def test_farthest_pair_and_distances(forest):
    links, trees = forest
    best = {}
    for tree, parents in links.items():
        tips = tips_of(parents)
        best[tree] = max((distance(parents, a, b), a, b) for a in tips for b in tips if a < b)
    got = {r.tree: (r.max_distance, r.farthest, r.partner) for r in T.farthest_tip(trees).collect()}
    assert got == best
    for r in T.distances_from_farthest(trees).collect():
        assert r.d == pytest.approx(distance(links[r.tree], best[r.tree][1], r.species))


def test_newick_spellings(spark):
    text = "[&R] (\n'Homo sapiens':0.1,\n(Pan:1e-1 , Gorilla_g : 2)95:0.25 ,\nX);\n"
    trees = spark.createDataFrame([("t", text)], "tree string, newick string")
    edges = {(e.label, e.length, e.is_tip) for e in T.tree_edges(trees).collect()}
    assert edges == {
        ("Homo_sapiens", 0.1, True), ("Pan", 0.1, True), ("Gorilla_g", 2.0, True),
        ("95", 0.25, False), ("X", 0.0, True), (None, 0.0, False),
    }
    assert {r.species for r in T.tree_tips(trees).collect()} == {"Homo_sapiens", "Pan", "Gorilla_g", "X"}


def test_single_tip_has_no_pair(spark):
    trees = spark.createDataFrame([("t", "only;")], "tree string, newick string")
    assert T.farthest_tip(trees).count() == 0
    assert [r.species for r in T.tree_tips(trees).collect()] == ["only"]


def test_tips_sorted_by_distance(spark):
    trees = spark.createDataFrame([("b", "(x:1,y:1);"), ("a", "((p:1,q:1)m:1,r:5,s:2);")], "tree string, newick string")
    rows = [tuple(r) for r in T.sorted_from_farthest(trees).collect()]
    assert rows == sorted(rows, key=lambda r: (r[0], r[2], r[1])) and len(rows) == 6
    assert rows == sorted(map(tuple, T.distances_from_farthest(trees).collect()), key=lambda r: (r[0], r[2], r[1]))


def test_sorted_output_comes_in_parts_that_follow_the_tips(spark, monkeypatch):
    from cladewise.plans import sizing

    monkeypatch.setattr(sizing, "PART_ROWS", 5)
    trees = spark.createDataFrame([(f"t{k:02d}", f"(b:1,a:{k + 2},c:1);") for k in range(30)], "tree string, newick string")
    found = T.sorted_from_farthest(trees)
    assert found.rdd.getNumPartitions() == 18
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == 90 and rows == sorted(rows, key=lambda r: (r[0], r[2], r[1]))


def counted(trees, folder):
    """The same trees, with a file in ``folder`` for each time that they are computed."""
    def run(batches):
        import tempfile

        tempfile.mkstemp(dir=folder)
        yield from batches

    return trees.coalesce(1).mapInArrow(run, trees.schema)


def test_sorted_output_walks_along_the_trees_once(spark, tmp_path):
    trees = spark.createDataFrame([(f"t{k:02d}", f"(b:1,(a:{k + 2},c:1)n:1);") for k in range(20)], "tree string, newick string")
    found = T.sorted_from_farthest(counted(trees, str(tmp_path))).collect()
    assert sorted(map(tuple, found), key=lambda r: (r[0], r[2], r[1])) == [tuple(r) for r in found]
    assert sorted(found) == sorted(T.distances_from_farthest(trees).collect())
    assert len(list(tmp_path.iterdir())) == 1


def test_trees_walked_together_do_not_meet(spark, monkeypatch):
    """Brackets without tips, without partners and without names, repeated names, lengths that are no numbers."""
    from cladewise.operators import walks

    texts = [
        "(()m:3,(x:2,y:5)n:2)r;", "()r;", "((", "", "(a:Infinity,b:1,c:NaN)z;", "(a:1,(b:2,c:3", "d:1)e:2)f;",
        "('it''s':2,'p q:1':3,(:4,:4)u:1)v;", "(k:1e300,l:1,(m:2,n:1e-9):3)w;", "(a:4,a:4,(a:4,b:4)c)d;", "((((x:1)a:1)b:1)c:1,y:9)d;", "only;",
    ]
    trees = spark.createDataFrame([(f"t{k:02d}", text) for k, text in enumerate(texts * 3)], "tree string, newick string")
    batches = trees.coalesce(1).select("tree", T.token_lengths().alias("tokens")).toArrow().combine_chunks().to_batches()

    def rows():
        return [[repr(r) for r in batch.to_pylist()] for batch in walks.farthest_rows(iter(batches))]

    together = rows()
    monkeypatch.setattr(walks, "_AT_ONCE", 1)
    alone = rows()
    assert len(together) == 1 and sorted(sum(together, [])) == sorted(sum(alone, [])) and len(alone) > 20
    one = {r.species: r.d for r in T.distances_from_farthest(trees.where("tree = 't00'")).collect()}
    assert one == {None: None, "x": 0.0, "y": 7.0}
    names = {r.species for r in T.distances_from_farthest(trees.where("tree = 't07'")).collect()}
    assert names == {"it's", "p_q:1", None}
    pair = T.farthest_tip(trees.where("tree = 't09'")).first()
    assert (pair.farthest, pair.partner, pair.max_distance) == ("a", "b", 8.0)


def test_pairs_meet_their_trees_once(spark, tmp_path, monkeypatch):
    """Long lists of pairs are dealt out; repeated names give a row each, missing ones none."""
    monkeypatch.setattr(T, "_PAIRS", 3)
    texts = {f"t{k}": f"((a:1,b:2)m:1,(c:{k},(d:2,e:1)n:2)o:1,a:5)r;" for k in range(12)}
    trees = spark.createDataFrame(list(texts.items()), "tree string, newick string")
    asked = [(tree, x, y) for tree in texts for x in "abcde" for y in "bcde"]
    asked += [("t1", "b", "c"), ("t1", "b", None), ("t1", None, "b"), ("t1", "b", "z"), ("no", "a", "b"), (None, "a", "b")]
    pairs = spark.createDataFrame(asked, "tree string, a string, b string")
    found = [tuple(r) for r in T.pair_distances(counted(trees, str(tmp_path)), pairs).collect()]
    assert len(list(tmp_path.iterdir())) == 1
    assert len(found) == 12 * (4 * 4 + 2 * 4) + 1
    got = {}
    for tree, a, b, d in found:
        got.setdefault((tree, a, b), []).append(d)
    assert sorted(got["t3", "a", "c"]) == [6.0, 9.0] and sorted(got["t3", "a", "b"]) == [3.0, 8.0]
    assert got["t1", "b", "c"] == [5.0, 5.0] and got["t4", "c", "e"] == [7.0] and got["t4", "d", "d"] == [0.0]


def test_neighbours_of_a_tree_are_not_shuffled_with_tables_of_gaps(spark, sf_dir):
    """Trees meet lists of pairs by one join, on the parts where the lines of a tree already are."""
    from cladewise.catalog import QUERIES

    plan = QUERIES["patristic_distance"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    behind = plan[: plan.index("MapInArrow") + plan[plan.index("MapInArrow") :].index("Join")]
    assert "Exchange" not in behind and plan.count("Window [") <= 2
