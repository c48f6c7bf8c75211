"""Near duplicates by MinHash bands with sequential Bayesian verification.

Texts become sets of hashed word shingles, and equal sets one node. Signatures of
``HASHES`` minima are cut into ``BANDS`` bands; nodes that agree in a whole band
are candidates. A pair at the threshold has no such band with probability 2e-8, for a
``Rule`` of 0.85 and 30 bands as for one of 0.8 and 45. Candidates are verified batch by batch: after each batch of hashes the
posterior of the similarity (uniform prior) gives the probability that it reaches
the threshold, and pairs below ``MISS`` are given up. What survives is verified on
the full sets; only such links count.

Pairs within a band's bucket are never listed. First each member meets a few
leaders of its bucket (the same nodes lead in all their buckets, so there are few
different pairs), the verified links are contracted to components, and buckets
that lie in one component are done. In the others every pair of members of
different components that is still open is compared, in blocks of ``BLOCK``
members: those outside the bucket's largest component against all. A pair is looked
at in the first bucket it shares, its full sets are compared in the same task, and
one link is sent for each two components and pair of blocks. Nothing is capped, so
no link between components is lost.

Components are contracted with stars on the links, stored after each round.

Null texts and texts without words are linked with nothing. Rows of one id are
judged each; null ids are smaller than none, so a group keeps a null id only if
it has no other. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.llm import common
from cladewise.llm.common import passing, same, stored, unused
from cladewise.llm.decontam import cut_words, hashes, in_bytes

SHINGLE = 3
PERCENT = 85
ROWS, BANDS = 5, 30
BATCH = 30
MISS = 1e-6
LEADERS = 3
BLOCK = 512
#: So many pairs of a block are looked up one by one; more are counted together.
FEW = 64
#: Ids of texts that are read again are sent to all executors up to this number.
BROADCAST_IDS = 1_000_000
#: Texts that are taken apart together, and their characters.
TEXTS = 128
CHARS = 1 << 20


class Rule(NamedTuple):
    """Words of a shingle, least similarity in percent, bands of ``ROWS`` hashes."""

    size: int = SHINGLE
    percent: int = PERCENT
    bands: int = BANDS

    @property
    def hashes(self) -> int:
        return ROWS * self.bands


#: The rule of the query op8, and that of the pipeline's stages.
QUERY = Rule()
STAGE = Rule(5, 80, 45)

def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted hashes of each text's different shingles; with fewer words the whole sequence is one.

    Words are hashed and mixed for all texts together.
    """
    said, first, last, n_words = cut_words([in_bytes(t) for t in texts])
    h = hashes(said, first, last - first + 1)

    def mixed(n: int, words: np.ndarray) -> np.ndarray:
        found = np.full(len(words) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            found = _mixed(found * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i])
        return found

    every = mixed(size, h) if len(h) >= size else h[:0]
    ends = np.cumsum(n_words).tolist()
    return [
        np.unique(every[end - n : end - size + 1]) if n >= size else mixed(n, h[end - n : end]) if n else h[:0]
        for n, end in zip(n_words.tolist(), ends)
    ]


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    return shingle_sets([text], size)[0]


def portions(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    return common.portions(texts, TEXTS, CHARS)


def node_of(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


@lru_cache
def _hash_family(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(8)
    a = rng.integers(1, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, hashes, dtype=np.uint64)


def signature(shingles: np.ndarray, rule: Rule = QUERY) -> bytes:
    """The minima of all hash functions, 32 bits each."""
    a, b = _hash_family(rule.hashes)
    low = np.full(rule.hashes, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(low, (_mixed(shingles[at : at + 1024])[:, None] * a + b).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype("<u4").tobytes()


@lru_cache
def least_matches(rule: Rule = QUERY) -> dict[int, int]:
    """Matches among n hashes below which a pair reaches the threshold with a probability under MISS.

    With a uniform prior the similarity after m of n matches is Beta(m + 1, n - m + 1),
    whose upper tail at t is the chance of at most m heads in n + 1 throws.
    """
    t, found = rule.percent / 100, {}
    for n in range(BATCH, rule.hashes + 1, BATCH):
        tail, m = 0.0, 0
        while True:
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= MISS:
                break
            m += 1
        found[n] = m
    return found


def open_pairs(left: np.ndarray, right: np.ndarray, pairs: np.ndarray, rule: Rule = QUERY) -> np.ndarray:
    """The pairs (rows of left and right) that no batch of hashes rules out."""
    needed = least_matches(rule)
    matches = np.zeros(len(pairs), dtype=np.int64)
    for n, least in needed.items():
        part = slice(n - BATCH, n)
        matches += (left[pairs[:, 0], part] == right[pairs[:, 1], part]).sum(axis=1)
        alive = matches >= least
        pairs, matches = pairs[alive], matches[alive]
    return pairs


def linked(x: np.ndarray, y: np.ndarray, rule: Rule = QUERY) -> bool:
    """Whether two full sets reach the threshold."""
    if 100 * min(len(x), len(y)) < rule.percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= rule.percent * (len(x) + len(y) - both)


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two lists, a slice of the shingles at a time."""
    both = left + right
    values, place = np.unique(np.concatenate(both), return_inverse=True)
    row = np.repeat(np.arange(len(both)), [len(s) for s in both])
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    out = np.zeros((len(left), len(right)), dtype=np.float64)
    width = 4096
    for low in range(0, len(values), width):
        part = slice(*np.searchsorted(place, (low, low + width)))
        has = np.zeros((len(both), width), dtype=np.float32)
        has[row[part], place[part] - low] = 1.0
        out += has[: len(left)] @ has[len(left) :].T
    return out.astype(np.int64)


def linked_pairs(
    left: list[np.ndarray], right: list[np.ndarray], pairs: np.ndarray, rule: Rule = QUERY
) -> np.ndarray:
    """The pairs whose full sets reach the threshold."""
    if len(pairs) <= FEW:
        true = [linked(left[i], right[j], rule) for i, j in pairs]
        return pairs[np.array(true, dtype=bool)] if len(pairs) else pairs
    both = common_counts(left, right)[pairs[:, 0], pairs[:, 1]]
    sizes = np.array([len(s) for s in left])[pairs[:, 0]] + np.array([len(s) for s in right])[pairs[:, 1]]
    return pairs[100 * both >= rule.percent * (sizes - both)]


def bucket_keys(sigs: np.ndarray, rule: Rule = QUERY) -> np.ndarray:
    """The buckets of each signature, a column for each band."""
    sigs = sigs.astype(np.uint64).reshape(-1, rule.bands, ROWS)
    key = np.broadcast_to(np.arange(1, rule.bands + 1, dtype=np.uint64), sigs.shape[:2])
    for i in range(ROWS):
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + sigs[:, :, i])
    return key.view(np.int64)


# --- Spark -----------------------------------------------------------------


def signed(docs: DataFrame, rule: Rule = QUERY) -> DataFrame:
    """``doc_id, tie, n_shingles, node, sig`` of every row; ``tie`` tells rows of one id apart by their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for at, end in portions(texts):
                part = batch.slice(at, end - at)
                sets = shingle_sets(texts[at:end], rule.size)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([node_of(s) for s in sets], pa.binary()),
                        pa.array([signature(s, rule) if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "tie", "n_shingles", "node", "sig"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tie"), "text")
    return rows.mapInArrow(run, "doc_id long, tie long, n_shingles long, node binary, sig binary")


def banded(nodes: DataFrame, rule: Rule = QUERY) -> DataFrame:
    """``bucket, node``: a row for each band of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                if not part.num_rows:
                    continue
                key = bucket_keys(_matrix(part.column(1).to_pylist()), rule)
                node = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), rule.bands)))
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1)), node], ["bucket", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "bucket long, node binary")


def _matrix(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), dtype="<u4").reshape(len(sigs), -1)


def _set(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype=np.uint64)


def ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def leader_pairs(members: DataFrame) -> DataFrame:
    """Each member of a bucket with the bucket's leaders: the nodes whose hashes, by several seeds, are least."""
    leaders = members.groupBy("bucket").agg(
        F.array(*(F.min_by("node", F.xxhash64(F.lit(k), "node")) for k in range(LEADERS))).alias("leaders")
    )
    return (
        members.join(leaders, "bucket")
        .select("node", F.explode(F.array_distinct("leaders")).alias("leader"))
        .where("node != leader")
        .select(*ordered("node", "leader"))
        .distinct()
    )


def unpruned(pairs: DataFrame, nodes: DataFrame, rule: Rule = QUERY) -> DataFrame:
    """Pairs ``a, b`` that survive the comparison of their signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                same_row = np.repeat(np.arange(n), 2).reshape(n, 2)
                left, right = (_matrix(batch.column(k).to_pylist()) for k in ("sig_a", "sig_b"))
                alive = open_pairs(left, right, same_row, rule)[:, 0]
                yield batch.select(["a", "b"]).take(pa.array(alive))

    joined = pairs.join(nodes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(
        nodes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b"
    )
    return joined.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a binary, b binary")


def confirmed(pairs: DataFrame, sets: DataFrame, rule: Rule = QUERY) -> DataFrame:
    """Pairs whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            true = [linked(_set(x), _set(y), rule) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(true, pa.bool_()))

    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b"
    )
    return joined.select("a", "b", "set_a", "set_b").mapInArrow(run, "a binary, b binary")


def full_sets(docs: DataFrame, rows: DataFrame, members: DataFrame, rule: Rule = QUERY) -> DataFrame:
    """``node, set`` of all nodes that have a candidate, from one text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at, end in portions(texts):
                sets = [s for s in shingle_sets(texts[at:end], rule.size) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["node", "set"],
                )

    ids = stored(
        rows.join(members.select("node").distinct(), "node", "left_semi")
        .groupBy("node")
        .agg(F.min(F.struct("doc_id", "tie")).alias("one"))
        .select(F.col("one.doc_id").alias("of_id"), F.col("one.tie").alias("of_tie"))
    )
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(
        ids, same(F.col("doc_id"), F.col("of_id")) & (F.xxhash64("text") == F.col("of_tie")), "left_semi"
    )
    return texts.select("text").mapInArrow(run, "node binary, set binary").dropDuplicates(["node"])


def components(links: DataFrame) -> DataFrame:
    """``node, label`` of all nodes in ``links`` (columns a, b): alternating large and small stars until nothing changes."""

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    before = state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.union(low.select("u", F.col("m").alias("v"))).where("u > v").distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )


def remaining_links(members: DataFrame, labels: DataFrame, known: DataFrame, rule: Rule = QUERY) -> DataFrame:
    """Verified links between different components that share a bucket, one for each two components and pair of blocks.

    In each bucket the members outside its largest component, in blocks, meet all
    members, in blocks; a task holds two blocks at a time. Members are dealt to blocks
    before they meet their signatures and sets, which so are shuffled twice only.
    """
    placed = stored(
        members.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    )
    shares = placed.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    buckets = (
        shares.groupBy("bucket")
        .agg(F.max_by("label", "n").alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"))
        .where("most < n")
        .select(
            "bucket",
            "main",
            F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("n_left"),
            F.ceil(F.col("n") / BLOCK).cast("int").alias("n_right"),
        )
    )

    def blocks(n: str, place: Callable[[Column], tuple[Column, Column]], side: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda k: seat(*place(k), F.lit(side)))

    def block(n: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.col(n)).cast("int")

    def seat(i: Column, j: Column, side: Column) -> Column:
        return F.struct(i.alias("i"), j.alias("j"), side.alias("side"))

    # A member outside the main component is needed on both sides; where one task holds all, one row is both.
    outside = F.col("label") != F.col("main")
    one = F.array(seat(F.lit(0), F.lit(0), F.when(outside, 2).otherwise(1)))
    left = blocks("n_right", lambda j: (block("n_left"), j), 0)
    right = blocks("n_left", lambda i: (i, block("n_right")), 1)
    seats = F.when(F.col("n_right") == 1, one).when(outside, F.concat(left, right)).otherwise(right)
    dealt = placed.join(buckets, "bucket").select("bucket", F.explode(seats).alias("seat"), "node", "label")
    work = dealt.join(known, "node").select("bucket", "seat.i", "seat.j", "seat.side", "node", "label", "sig", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        found: list[tuple[bytes, bytes]] = []
        for (bucket, _, _), group in groupby(rows, key=lambda r: r[:3]):
            held = list(group)
            found += block_links(bucket, [r for r in held if r[3] != 1], [r for r in held if r[3] != 0], rule)
            if len(found) > 5000:
                yield _pairs_batch(found)
                found = []
        yield _pairs_batch(found)

    work = work.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
    return work.mapInArrow(run, "a binary, b binary").distinct()


def block_links(
    bucket: int, left: list[tuple], right: list[tuple], rule: Rule = QUERY
) -> list[tuple[bytes, bytes]]:
    """Links of two blocks' rows ``bucket, i, j, side, node, label, sig, set`` that join components."""
    if not left or not right:
        return []
    place: dict[bytes, int] = {}
    la, lb = (np.array([place.setdefault(r[5], len(place)) for r in side]) for side in (left, right))
    pairs = np.argwhere(la[:, None] != lb[None, :])
    if not len(pairs):
        return []
    sa, sb = (_matrix([r[6] for r in side]) for side in (left, right))
    pairs = np.concatenate([open_pairs(sa, sb, pairs[k : k + 50_000], rule) for k in range(0, len(pairs), 50_000)])
    if not len(pairs):
        return []
    ka, kb = bucket_keys(sa, rule), bucket_keys(sb, rule)
    first = np.concatenate(
        [(ka[p[:, 0]] == kb[p[:, 1]]).argmax(axis=1) for p in np.array_split(pairs, 1 + len(pairs) // 50_000)]
    )
    pairs = pairs[ka[pairs[:, 0], first] == bucket]
    xa, xb = ([np.frombuffer(r[7], dtype=np.uint64) for r in side] for side in (left, right))
    true = linked_pairs(xa, xb, pairs, rule)
    joins = {tuple(sorted((int(la[i]), int(lb[j])))): (i, j) for i, j in true.tolist()}
    found = ((left[i][4], right[j][4]) for i, j in joins.values())
    return [(x, y) if x < y else (y, x) for x, y in found]


def _pairs_batch(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], ["a", "b"])


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels when further links join components: only the components they join are contracted again."""
    left, right = (labels.select(F.col("node").alias(k), F.col("label").alias(f"of_{k}")) for k in ("a", "b"))
    ends = links.join(left, "a", "left").join(right, "b", "left")
    above = components(ends.select(*(F.coalesce(f"of_{k}", k).alias(k) for k in ("a", "b"))))
    renamed = above.select(F.col("node").alias("label"), F.col("label").alias("least"))
    known = labels.join(renamed, "label", "left").select("node", F.coalesce("least", "label").alias("label"))
    return known.union(above.join(labels, "node", "left_anti").select("node", "label"))


def labelled(docs: DataFrame, rule: Rule = QUERY) -> DataFrame:
    """``doc_id, tie, n_shingles, label`` of every row; rows of one group have one label, texts without words none.

    Signatures stay only until the buckets are known, and then those of nodes in shared buckets.
    """
    spark = docs.sparkSession
    with passing(spark) as keep:
        with passing(spark) as hold:
            with passing(spark) as pick:
                every = stored(signed(docs, rule))
                rows = keep(every.drop("sig"))
                nodes = pick(every.where("node is not null").select("node", "sig").dropDuplicates(["node"]))
            bands = banded(nodes, rule)
            shared = bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
            members = hold(bands.join(shared, "bucket"))
            known = hold(full_sets(docs, rows, members, rule).join(nodes, "node"))
        links = stored(confirmed(unpruned(leader_pairs(members), known, rule), known, rule))
        labels = components(links)
        more = stored(remaining_links(members, labels, known, rule))
        labels = keep(joined(labels, more))
    placed = rows.join(labels, "node", "left")
    return placed.select("doc_id", "tie", "n_shingles", F.coalesce("label", "node").alias("label"))


def classes(docs: DataFrame, rule: Rule = QUERY) -> DataFrame:
    """``doc_id, tie, n_shingles, component_id`` of every row."""
    placed = labelled(docs, rule)
    first = placed.where("label is not null").groupBy(F.col("label").alias("of")).agg(F.min("doc_id").alias("first_id"))
    return placed.join(first, F.col("label") == F.col("of"), "left").select(
        "doc_id",
        "tie",
        "n_shingles",
        F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("first_id")).alias("component_id"),
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row."""
    return classes(docs).select(
        "doc_id", "n_shingles", "component_id", same(F.col("doc_id"), F.col("component_id")).alias("kept")
    )


def keep_one(docs: DataFrame, rule: Rule = QUERY) -> DataFrame:
    """One document of each group, the one of the smallest id; columns stay as they are."""
    of_id, of_tie = unused(docs, "_id"), unused(docs, "_tie")
    with passing(docs.sparkSession) as keep:
        kept = classes(docs, rule).where(same(F.col("doc_id"), F.col("component_id")))
        kept = keep(kept.select(F.col("doc_id").alias(of_id), F.col("tie").alias(of_tie)).distinct())
    here = same(F.col("doc_id").cast("long"), F.col(of_id)) & (F.xxhash64("text") == F.col(of_tie))
    return docs.join(kept, here, "left_semi")
