"""Near duplicates by SimHash fingerprints, found through counts of bits in segments.

A fingerprint of 64 bits has one bit for each position that is set in over half of
the hashes of the text's word shingles. It is mapped to the number of set bits in
each of 32 segments of two bits. Two fingerprints differ in at least as many bits
as these counts differ in sum (Manhattan distance), so the counts may only bring
too many candidates and never too few. Counts are kept in unary, so that their
Manhattan distance is the number of bits of an exclusive or.

Range join on a grid: the 32 axes form eight groups. A distance of at most four
leaves four of the eight groups without any difference, so two fingerprints in range
meet in a cell of one of the 70 grids over four groups. Within a cell the members
are sorted by their number of bits, a further axis, and each meets those up to four
bits above. Candidates that pass the Manhattan bound are compared exactly.

A cell of two members is compared while cells are counted. Larger ones are not listed
pair by pair. Their members first meet a few leaders of the cell; what is linked becomes
one component, and cells that lie in one component are done. In the others, members of
different components are compared within tasks: cells of over ``BLOCK`` members in
blocks, those outside the cell's largest component against all. Only links between
components leave a task. Nothing is capped.

Null and empty texts, and those without words, have the fingerprint zero and are
linked like any other. Rows of one id are judged each; a component is named by its
smallest id, by null only if it has no other. Very long texts are hashed a slice at
a time. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.llm.common import byte_words, same, stored
from cladewise.llm.neardup import components

SHINGLE = 4
SEED = 42
RADIUS = 4
GROUPS = 8
LEADERS = 3
BLOCK = 2048
#: Rows of small cells that a task compares at a time.
CHUNK = 1 << 16
#: A fingerprint is hot with more than this share of all rows, so there are fewer than 1,000.
HOT_SHARE = 1000
#: The low bit of every segment.
LOW = 0x5555555555555555


def shingle_hashes(text: str | None) -> Iterator[np.ndarray]:
    """XXH64 of the shingles in order, repeats included, in slices; with fewer words the whole sequence is one."""
    words = byte_words(text)
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = min(SHINGLE, len(words))
    first, last = starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(first), CHUNK):
        spans = zip(first[at : at + CHUNK], last[at : at + CHUNK])
        yield np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=np.uint64)


def fingerprint(text: str | None) -> int:
    """The fingerprint as an unsigned number."""
    total, ones = 0, np.zeros(64, dtype=np.int64)
    for hashes in shingle_hashes(text):
        total += len(hashes)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > total, bitorder="little")
    return int(packed.view("<u8")[0])


# --- Spark -----------------------------------------------------------------


def fingerprinted(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` of every row; ``fp`` holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def unary(fp: Column) -> Column:
    """The segments' counts, each as that many low bits of its segment."""
    low, high = fp.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def in_range(a: Column, b: Column) -> Column:
    """The Manhattan distance of the counts, then the exact one."""
    manhattan = F.bit_count(unary(a).bitwiseXOR(unary(b)))
    return (manhattan <= RADIUS) & (F.bit_count(a.bitwiseXOR(b)) <= RADIUS)


def grids() -> list[int]:
    """For each choice of groups that may be free of differences, the mask of their bits as a signed number."""
    width = 64 // GROUPS
    masks = (
        sum(((1 << width) - 1) << (width * g) for g in chosen) for chosen in combinations(range(GROUPS), GROUPS - RADIUS)
    )
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def cells(nodes: DataFrame) -> DataFrame:
    """``cell, fp``: each fingerprint in its cell of every grid."""
    keys = [F.xxhash64(F.lit(k), F.col("counts").bitwiseAND(F.lit(m))) for k, m in enumerate(grids())]
    return nodes.select("fp", unary(F.col("fp")).alias("counts")).select(F.explode(F.array(*keys)).alias("cell"), "fp")


def leader_links(members: DataFrame) -> DataFrame:
    """Links ``a, b`` of members with their cell's leaders: those whose hashes, by several seeds, are least."""
    leaders = members.groupBy("cell").agg(
        F.array(*(F.min_by("fp", F.xxhash64(F.lit(k), "fp")) for k in range(LEADERS))).alias("leaders")
    )
    return (
        members.join(leaders, "cell")
        .select("fp", F.explode(F.array_distinct("leaders")).alias("leader"))
        .where((F.col("fp") != F.col("leader")) & in_range(F.col("fp"), F.col("leader")))
        .select(F.least("fp", "leader").alias("a"), F.greatest("fp", "leader").alias("b"))
        .distinct()
    )


def _unary(fp: np.ndarray) -> np.ndarray:
    low, high = fp & np.uint64(LOW), (fp >> np.uint64(1)) & np.uint64(LOW)
    return low | high | ((low & high) << np.uint64(1))


def links_in_groups(group: np.ndarray, fp: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Pairs of labels with fingerprints in range, of rows sorted by group and number of bits.

    Each row meets the next, the next but one and so on, as long as it is in its
    group and at most ``RADIUS`` bits heavier.
    """
    counts, weight = _unary(fp), np.bitwise_count(fp).astype(np.int64)
    at, lag, found = np.arange(len(fp)), 0, []
    while True:
        lag += 1
        at = at[at + lag < len(fp)]
        other = at + lag
        near = (group[at] == group[other]) & (weight[other] - weight[at] <= RADIUS)
        at, other = at[near], other[near]
        if not len(at):
            break
        here = (label[at] != label[other]) & (np.bitwise_count(counts[at] ^ counts[other]) <= RADIUS)
        here[here] = np.bitwise_count(fp[at[here]] ^ fp[other[here]]) <= RADIUS
        if here.any():
            pairs = np.sort(np.stack([label[at[here]], label[other[here]]], axis=1), axis=1)
            found.append(np.unique(pairs, axis=0))
    return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), dtype=np.int64)


def remaining_links(members: DataFrame, labels: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links ``a, b`` between different components that share a cell."""
    placed = stored(
        members.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").select(
            "cell", "fp", F.coalesce("label", "fp").alias("label")
        )
    )
    shares = placed.groupBy("cell", "label").agg(F.count("*").alias("n"))
    sizes = (
        shares.groupBy("cell")
        .agg(F.max_by("label", "n").alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"))
        .where("most < n")
        .select(
            "cell",
            "main",
            F.when(F.col("n") > block, F.ceil((F.col("n") - F.col("most")) / block)).otherwise(1).cast("int").alias("left"),
            F.when(F.col("n") > block, F.ceil(F.col("n") / block)).otherwise(1).cast("int").alias("right"),
        )
    )
    mixed = placed.join(sizes, "cell")
    whole = F.col("right") == 1

    def block_of(n: str) -> Column:
        return F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")

    def all_of(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    rest = ["fp", "label"]
    alone = mixed.where(whole).select("cell", F.lit(0).alias("i"), F.lit(0).alias("j"), *rest)
    outside = mixed.where(~whole & (F.col("label") != F.col("main")))
    work = alone.union(outside.select("cell", block_of("left").alias("i"), all_of("right").alias("j"), *rest)).union(
        mixed.where(~whole).select("cell", all_of("left").alias("i"), block_of("right").alias("j"), *rest)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[np.ndarray]) -> pa.RecordBatch:
            group, fp, label = rows
            pairs = links_in_groups(group, fp.view(np.uint64), label)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = rows if held is None else [np.concatenate(p) for p in zip(held, rows)]
            if len(held[0]) >= CHUNK:
                # The last group may go on in the next batch.
                cut = int((held[0] != held[0][-1]).nonzero()[0].max(initial=-1)) + 1
                if cut:
                    yield out([p[:cut] for p in held])
                    held = [p[cut:] for p in held]
        if held is not None:
            yield out(held)

    # Groups that share a hash are compared as one, which can only add candidates.
    keyed = work.select(F.xxhash64("cell", "i", "j").alias("group"), "fp", "label").repartition("group")
    ordered = keyed.sortWithinPartitions("group", F.bit_count("fp")).select("group", "fp", "label")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def linked_nodes(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """``node, label`` of the fingerprints (column ``fp``, each once) that have a link; components share a label."""
    placed = cells(nodes)
    met = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    # Most cells with company hold two by chance; these are compared where they are counted.
    met = stored(met.where((F.col("n") > 2) | ((F.col("n") == 2) & in_range(F.col("a"), F.col("b")))))
    # Both sides grow with the corpus, so they are shuffled at every size.
    members = stored(placed.join(met.where("n > 2").select("cell").hint("merge"), "cell"))
    links = stored(leader_links(members).union(met.where("n = 2").select("a", "b")).distinct())
    more = stored(remaining_links(members, components(links), block))
    return components(links.union(more))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    Rows of hot fingerprints meet their component by a broadcast of fewer than
    ``HOT_SHARE`` rows, so that no task of the other join gets more than that share.
    """
    rows = stored(fingerprinted(docs))
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    labels = linked_nodes(nodes.select("fp"))
    labelled = stored(
        nodes.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn(
            "label", F.coalesce("label", "fp")
        )
    )
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    placed = stored(labelled.join(smallest, "label").select("fp", "n", "component_id"))
    bar = (placed.agg(F.sum("n")).first()[0] or 0) / HOT_SHARE
    hot, others = placed.where(F.col("n") > bar).drop("n"), placed.where(F.col("n") <= bar).drop("n")
    joined = (
        rows.join(F.broadcast(hot), "fp")
        .unionByName(rows.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(others, "fp"))
    )
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
