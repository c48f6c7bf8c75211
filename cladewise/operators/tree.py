"""Trees as token tables: edges, tips, distances between tips.

Edges are windows over a tree's tokens. Between two tips, the token where the
bracket depth is lowest stands inside their last common ancestor, so distances
need a running or ranged minimum over the tips in file order and no walk along
ancestors; a tree is one text, so these run within the task that holds it (``walks``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyarrow import RecordBatch
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladewise.operators import walks
from cladewise.plans.sizing import n_parts, stored

# One bracket, comma or node text; bracketed comments are removed before.
_TOKEN = r"[(),]|'(?:[^']|'')*'(?:\s*:\s*[^(),\s;]+)?|[^(),\s;']+"
_COMMENT = r"\[[^\]]*\]"


def _token_texts() -> Column:
    text = F.regexp_replace(F.col("newick"), _COMMENT, "")
    text = F.regexp_replace(text, r"\s*:\s*", ":")
    return F.regexp_extract_all(text, F.lit(_TOKEN), 0)


def tree_tokens(trees: DataFrame) -> DataFrame:
    """``(tree, newick)`` to one row per bracket or node with depth and parsed label.

    A closing bracket takes the label and length that follow it.
    """
    raw = trees.select("tree", F.posexplode(_token_texts()).alias("at", "token"))
    order = Window.partitionBy("tree").orderBy("at")
    previous, following = F.lag("token").over(order), F.lead("token").over(order)
    is_text = ~F.col("token").isin("(", ")", ",")
    tagged = raw.select(
        "tree",
        "at",
        "token",
        is_text.alias("is_text"),
        (is_text & (previous == ")")).alias("belongs_before"),
        F.when(
            (F.col("token") == ")") & ~following.isin("(", ")", ","), following
        ).alias("closing_text"),
    ).where((F.col("token") != ",") & ~F.coalesce("belongs_before", F.lit(False)))
    text_of = F.when(F.col("is_text"), F.col("token")).otherwise(F.col("closing_text"))
    step = F.when(F.col("token") == "(", 1).when(F.col("token") == ")", -1).otherwise(0)
    kind = F.when(F.col("is_text"), "tip").when(F.col("token") == "(", "open").otherwise("close")
    return tagged.select(
        "tree",
        "at",
        kind.alias("kind"),
        _label(text_of).alias("label"),
        _length(text_of).alias("length"),
        F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("depth"),
    )


def _has_length(text: Column) -> Column:
    return text.contains(":") & ~text.endswith("'")


def _length(text: Column) -> Column:
    return F.when(_has_length(text), F.substring_index(text, ":", -1).try_cast("double"))


def _label(text: Column) -> Column:
    """The name before the length; quotes taken off, blanks turned to underscores."""
    suffix = F.length(F.substring_index(text, ":", -1)) + 1
    name = F.when(_has_length(text), F.substr(text, F.lit(1), F.length(text) - suffix)).otherwise(text)
    bare = F.replace(F.substr(name, F.lit(2), F.length(name) - 2), F.lit("''"), F.lit("'"))
    name = F.when(name.startswith("'"), bare).otherwise(name)
    return F.nullif(F.translate(name, " ", "_"), F.lit(""))


def _matched(tokens: DataFrame) -> DataFrame:
    """Tokens where an opening bracket knows the label and length of its closing one.

    At one level opening and closing brackets alternate, so the partner is the
    next bracket of that level.
    """
    level = F.when(F.col("kind") == "close", F.col("depth") + 1).otherwise(F.col("depth"))
    brackets = Window.partitionBy("tree", "level", F.col("kind") == "tip").orderBy("at")
    tokens = tokens.withColumn("level", level)
    is_open = F.col("kind") == "open"
    return tokens.select(
        "tree",
        "at",
        "kind",
        "depth",
        "level",
        F.when(is_open, F.lead("label").over(brackets)).otherwise(F.col("label")).alias("label"),
        F.when(is_open, F.lead("length").over(brackets)).otherwise(F.col("length")).alias("length"),
    )


def tree_edges(trees: DataFrame) -> DataFrame:
    """One row per node, in the layout of ``schema.TREE_EDGES``; the root has no parent.

    A node's id is the place of its first token; missing lengths count as zero.
    """
    nodes = _matched(tree_tokens(trees)).where(F.col("kind") != "close")
    # A child stands one level below its parent's bracket: put both in one group.
    is_tip, is_open = F.col("kind") == "tip", F.col("kind") == "open"
    as_child = F.struct(
        F.when(is_tip, F.col("level")).otherwise(F.col("level") - 1).alias("group"),
        F.lit(False).alias("is_parent"),
    )
    as_parent = F.struct(F.col("level").alias("group"), F.lit(True).alias("is_parent"))
    roles = F.explode(F.when(is_open, F.array(as_child, as_parent)).otherwise(F.array(as_child)))
    order = (
        Window.partitionBy("tree", "role.group")
        .orderBy("at")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    opened = F.when(F.col("role.is_parent"), F.struct("at", "label"))
    return (
        nodes.withColumn("role", roles)
        .withColumn("parent", F.last(opened, ignorenulls=True).over(order))
        .where(~F.col("role.is_parent"))
        .select(
            "tree",
            F.col("at").cast("bigint").alias("node"),
            F.col("parent.at").cast("bigint").alias("parent"),
            "label",
            F.col("parent.label").alias("parent_label"),
            F.coalesce("length", F.lit(0.0)).alias("length"),
            (F.col("kind") == "tip").alias("is_tip"),
        )
    )


def tree_tips(trees: DataFrame) -> DataFrame:
    """Tip labels per tree."""
    return (
        tree_tokens(trees).where(F.col("kind") == "tip").select("tree", F.col("label").alias("species")).distinct()
    )


def token_lengths() -> Column:
    """The tokens of ``newick`` in order, each with its length."""
    return F.transform(_token_texts(), lambda token: F.struct(token.alias("text"), _length(token).alias("length")))


def _walked(trees: DataFrame, walk: Callable[[Iterator[RecordBatch]], Iterator[RecordBatch]], layout: str) -> DataFrame:
    """Walk along the tokens of whole trees; further columns go along. Rows of one name are trees of their own."""
    more = [c for c in trees.columns if c not in ("tree", "newick")]
    known = trees.where(F.col("newick").isNotNull())
    return known.select("tree", token_lengths().alias("tokens"), *more).mapInArrow(walk, layout)


def with_farthest_tip(trees: DataFrame) -> DataFrame:
    """Tips with their distance ``d`` from the tree's farthest tip, whose own row names ``partner`` and ``max_distance``.

    The farthest tip is the alphabetically first tip of the farthest pair;
    among equally far pairs the greatest (first, second) labels win. Lengths
    must not be negative. The tip farthest from the root ends a longest path,
    one sweep from there finds the diameter, one from its far end tells which
    tips reach it, a third fixes the pair: its second label is the greatest
    reaching label, its first the greatest label at full distance from that.
    """
    return _walked(trees, walks.farthest_rows, "tree string, label string, d double, partner string, max_distance double")


def farthest_tip(trees: DataFrame) -> DataFrame:
    """Per tree the farthest pair and its distance; trees of one tip give no row."""
    return (
        with_farthest_tip(trees)
        .where(F.col("max_distance").isNotNull())
        .select("tree", F.col("label").alias("farthest"), "partner", "max_distance")
    )


def distances_from_farthest(trees: DataFrame) -> DataFrame:
    """Distance of every tip, itself included, from its tree's farthest tip."""
    return with_farthest_tip(trees).select("tree", F.col("label").alias("species"), "d")


def sorted_from_farthest(trees: DataFrame) -> DataFrame:
    """The same rows in the order of distance within their tree, equal distances by label.

    They are stored once, since counting them, choosing ranges and sorting would each walk along all trees.
    """
    found = stored(distances_from_farthest(trees))
    order = ["tree", "d", "species"]
    return found.repartitionByRange(n_parts(found, found.count()), *order).sortWithinPartitions(*order)


# Pairs asked of a tree that one row holds.
_PAIRS = 200_000


def pair_distances(trees: DataFrame, pairs: DataFrame) -> DataFrame:
    """Path length between the tips of given pairs ``(tree, a, b)``.

    The pairs of a tree meet it as lists of bounded length and are answered from
    the lowest points over the 1, 2, 4, ... gaps between tips: the run from
    the first tip on and the run up to the second together cover the stretch
    between them. The full pair matrix of a tree is never formed.
    """
    order = Window.partitionBy("tree").orderBy("a")
    lists = (
        pairs.select("tree", "a", "b", F.floor((F.row_number().over(order) - 1) / _PAIRS).alias("nth"))
        .groupBy("tree", "nth")
        .agg(F.collect_list(F.struct("a", "b")).alias("pairs"))
    )
    asked = trees.join(lists, "tree").select("tree", "newick", "pairs")
    return _walked(asked, walks.pair_rows, "tree string, a string, b string, d double")
