"""Alignment of two tokenizers' tokens over the bytes of each text, by merge-path partitioning.

A text is encoded by a byte-level BPE (A, given the text after a space) and by a
sentencepiece model (B, which adds that space itself). Both cut the same bytes, so
their token ends are two ascending lists; merging them gives all overlaps, one for each
byte range between neighbouring ends, and the groups, cut where both end together.

The ends of all texts of a batch stand behind each other in two long lists. Their
merge is a path of as many steps as there are ends. It is divided on equally spaced
diagonals, and a binary search on each diagonal finds where the path crosses it, so
every piece holds the same number of steps, however long single texts are. Pieces are
merged on their own and emit their overlaps and the group ends in them; a group that
runs over a piece's border is closed by the piece that holds its end, when the pieces
are stitched in order.

Links are counted in documents per pair of ids over the whole corpus. Each task counts
its batches before the shuffle.

Encoding is remembered by unit (a space and what follows up to the next), as no token of
either side reaches over a single space: for A by its pre-tokens, for B as no piece of the
vocabulary holds a space mark behind another character, which is checked on loading. Texts
with further white space around a space, and units whose bytes do not come back, go
through the libraries as a whole.

Null and empty texts, and texts whose bytes a tokenizer does not give back, have no
tokens: zeros and an empty digest. Repeated rows count each as a document. Very long
texts are one entry of their batch. Empty tables give empty results; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cladewise.llm.common import stored
from cladewise.llm.tokens import _ASTRAL, MEMORY, MEMORY_CHARS, PreTokens, Units, _byte_chars, pre_token_pattern

#: Steps of the merge path in a piece.
PIECE = 1 << 14
#: Bytes of text that are aligned together.
BATCH_BYTES = 1 << 20
#: Pairs of ids that are sent to all executors; of more, only those in over 1 / HOT_SHARE of the documents.
BROADCAST_PAIRS = 1_000_000
HOT_SHARE = 1000


# --- Tokens ------------------------------------------------------------------


class ByteLevel:
    """Side A: ids of a space and a text, special tokens' strings as plain text."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        values = {c: b for b, c in _byte_chars().items()}
        n = self.library.get_vocab_size(with_added_tokens=True)
        names = (self.library.id_to_token(i) or "" for i in range(n))
        self.bytes = [bytes(values[c] for c in t) if all(c in values for c in t) else t.encode() for t in names]
        self.cut = pre_token_pattern(path).findall
        self.merged = PreTokens(path, lambda ids: ids)

    def whole(self, text: str) -> list[int]:
        return self.library.encode(" " + text, add_special_tokens=False).ids

    def unit(self, text: str) -> list[int]:
        if _ASTRAL.search(text):
            return self.whole(text)
        return [i for t in self.cut(" " + text) for i in self.merged[t]]


class Pieces:
    """Side B: ids of a text before which the model itself puts a space."""

    def __init__(self, path: str) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.library.get_piece_size()):
            piece = self.library.id_to_piece(i)
            if self.library.is_byte(i):
                self.bytes.append(bytes([int(piece[3:-1], 16)]))
            else:
                self.bytes.append(piece.replace("▁", " ").encode())
        #: Whether a text may be cut before single spaces.
        self.by_unit = not any(" " in b.decode(errors="replace").lstrip(" ") for b in self.bytes)

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text)

    unit = whole


class Encoder:
    """Both sides' ids of texts in one worker, as little-endian 32-bit numbers; empty if the bytes do not come back."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.known: dict[str, tuple[bytes, bytes] | None] = {}
        self.len_a, self.len_b = (np.array([len(x) for x in s.bytes], dtype=np.int64) for s in (self.a, self.b))

    def _checked(self, ids_a: list[int], ids_b: list[int], text: str) -> tuple[bytes, bytes] | None:
        want = b" " + text.encode("utf-8", "surrogatepass")
        for side, ids in ((self.a, ids_a), (self.b, ids_b)):
            if b"".join(map(side.bytes.__getitem__, ids)) != want:
                return None
        return np.array(ids_a, dtype="<i4").tobytes(), np.array(ids_b, dtype="<i4").tobytes()

    def _unit(self, text: str) -> tuple[bytes, bytes] | None:
        found = self._checked(self.a.unit(text), self.b.unit(text), text)
        if len(text) <= MEMORY_CHARS:
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[text] = found
        return found

    def ids(self, text: str | None) -> tuple[bytes, bytes]:
        if not text:
            return b"", b""
        if self.b.by_unit and text[0] != " " and Units.regular(text):
            known, found = self.known, []
            for unit in text.split(" "):
                pair = known[unit] if unit in known else self._unit(unit)
                if pair is None:
                    break
                found.append(pair)
            else:
                return b"".join([p[0] for p in found]), b"".join([p[1] for p in found])
        return self._checked(self.a.whole(text), self.b.whole(text), text) or (b"", b"")


@lru_cache(maxsize=2)
def encoder(path_a: str, path_b: str) -> Encoder:
    """The worker's encoder, which keeps what it has met from task to task."""
    return Encoder(path_a, path_b)


# --- Merging -----------------------------------------------------------------


def crossings(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """How many ends of ``a`` lie before each diagonal of the merge path, by binary search on all diagonals at once.

    Of equal ends that of ``a`` comes first.
    """
    steps = len(a) + len(b)
    diagonals = np.append(np.arange(0, steps, piece), steps)
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        # a[middle] is before the diagonal if it is not after the last end of b before it.
        other = np.clip(diagonals - middle - 1, 0, max(len(b) - 1, 0))
        before = open_ & (a[np.minimum(middle, len(a) - 1)] <= b[other])
        low = np.where(before, middle + 1, low)
        high = np.where(open_ & ~before, middle, high)
    return np.stack([low, diagonals - low], axis=1)


class Merged(NamedTuple):
    """Overlaps as places in the two lists, and how many ends of each list lie up to each common end."""

    link_a: np.ndarray
    link_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray


def merged_piece(a: np.ndarray, b: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Merged:
    """What lies between two crossings; needs nothing from the pieces before it but their last end."""
    (a0, b0), (a1, b1) = start.tolist(), stop.tolist()
    ends = np.concatenate([a[a0:a1], b[b0:b1]])
    # Two ascending runs, which the stable sort merges; of equal ends that of a stays first.
    order = np.argsort(ends, kind="stable")
    ends = ends[order]
    of_a = order < a1 - a0
    done_a = a0 + np.cumsum(of_a)
    done_b = b0 + np.cumsum(~of_a)
    last = max(a[a0 - 1] if a0 else 0, b[b0 - 1] if b0 else 0)
    # A step that moves on is an overlap of the tokens that were open; one that does not closes a group.
    moves = np.diff(ends, prepend=last) > 0
    return Merged(
        (done_a - of_a)[moves], (done_b - ~of_a)[moves], done_a[~moves], done_b[~moves]
    )


def merged(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> Merged:
    """All pieces, stitched in order; groups run from one common end to the next, over the borders of pieces."""
    path = crossings(a, b, piece)
    parts = [merged_piece(a, b, path[k], path[k + 1]) for k in range(len(path) - 1)]
    if not parts:
        nothing = np.empty(0, dtype=np.int64)
        return Merged(nothing, nothing, nothing, nothing)
    return Merged(*(np.concatenate(p) for p in zip(*parts)))


@lru_cache(maxsize=1)
def _names(n: int) -> list[str]:
    """Ids in decimal, followed by a comma, then all again by a bar, then by a semicolon."""
    return [f"{i}{sign}" for sign in ",|;" for i in range(n)]


class Batch:
    """The aligned tokens of several texts."""

    def __init__(self, found: list[tuple[bytes, bytes]], enc: Encoder, piece: int = PIECE) -> None:
        self.a, self.b = (np.frombuffer(b"".join([f[k] for f in found]), dtype="<i4").astype(np.int64) for k in (0, 1))
        self.n_a, self.n_b = (np.array([len(f[k]) // 4 for f in found], dtype=np.int64) for k in (0, 1))
        self.all = merged(np.cumsum(enc.len_a[self.a]), np.cumsum(enc.len_b[self.b]), piece)
        self.width = max(len(enc.len_a), len(enc.len_b))
        #: Where each text's tokens, links and groups end; a text without tokens has none of them.
        self.stop_a, self.stop_b = np.cumsum(self.n_a), np.cumsum(self.n_b)
        self.stop_link = np.searchsorted(self.all.link_a, self.stop_a)
        self.stop_group = np.searchsorted(self.all.group_a, self.stop_a, side="right")

    def group_texts(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        group_a, group_b = self.all.group_a, self.all.group_b
        tokens = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        # A token's place is its own and all of the other side before it.
        of_a = np.searchsorted(group_a, np.arange(len(self.a)), side="right")
        of_b = np.searchsorted(group_b, np.arange(len(self.b)), side="right")
        begin_b = np.concatenate([[0], group_b])
        tokens[np.arange(len(self.a)) + begin_b[of_a]] = self.a
        tokens[np.arange(len(self.b)) + group_a[of_b]] = self.b
        tokens[group_a - 1 + begin_b[:-1]] += self.width
        tokens[group_a + group_b - 1] += 2 * self.width
        names = _names(self.width)
        stops = (self.stop_a + self.stop_b).tolist()
        flat = [names[t] for t in tokens.tolist()]
        return ["".join(flat[low:high])[:-1] for low, high in zip([0, *stops], stops)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different linked id pairs of each text in order, how often each is linked, and how many each text has."""
        links = np.diff(self.stop_link, prepend=0)
        text = np.repeat(np.arange(len(links)), links)
        pair = (self.a[self.all.link_a] << 32) | self.b[self.all.link_b]
        order = np.lexsort((pair, text))
        pair, text = pair[order], text[order]
        new = np.ones(len(pair), dtype=bool)
        new[1:] = (pair[1:] != pair[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(pair)))
        return pair[first], times, np.bincount(text[first], minlength=len(links))


# --- Spark -------------------------------------------------------------------


def _batches(
    batches: Iterator[pa.RecordBatch], enc: Encoder
) -> Iterator[tuple[pa.RecordBatch, list[str | None], list[tuple[bytes, bytes]]]]:
    """Rows ``doc_id, text`` in parts of about ``BATCH_BYTES``, with their ids."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        size, start = 0, 0
        for k, text in enumerate(texts):
            size += len(text or "") + 64
            if size >= BATCH_BYTES or k + 1 == len(texts):
                held = texts[start : k + 1]
                yield batch.slice(start, k + 1 - start), held, [enc.ids(t) for t in held]
                size, start = 0, k + 1


ALIGNED = "doc_id long, a_ids array<int>, b_ids array<int>, group_a array<int>, group_b array<int>"


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, a_ids, b_ids, group_a, group_b``: tokens of both sides, and how many of each lie up to the end of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path_a, path_b)
        for rows, _, found in _batches(batches, enc):
            b = Batch(found, enc)
            groups = np.diff(b.stop_group, prepend=0)
            before_a, before_b = (np.repeat(s - n, groups) for s, n in ((b.stop_a, b.n_a), (b.stop_b, b.n_b)))
            columns = [
                (b.stop_a, b.a),
                (b.stop_b, b.b),
                (b.stop_group, b.all.group_a - before_a),
                (b.stop_group, b.all.group_b - before_b),
            ]
            lists = [
                pa.ListArray.from_arrays(pa.array(np.append(0, stop), pa.int32()), pa.array(values, pa.int32()))
                for stop, values in columns
            ]
            yield pa.RecordBatch.from_arrays([rows.column(0), *lists], ["doc_id", "a_ids", "b_ids", "group_a", "group_b"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ALIGNED)


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
LINKED = (
    "row long, doc_id long, "
    + ", ".join(f"{c} long" for c in _COUNTS)
    + ", groups_sha256 string, pairs array<long>, times array<int>, docs long"
)


def linked(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each document, numbered in ``row``, with its counts, the digest of its groups and its pairs of ids.

    A row with ``docs`` is no document: it has the pairs of a batch of documents and in ``times``
    how many of them hold each.
    """
    digest: Callable[[str], str] = lambda s: hashlib.sha256(s.encode()).hexdigest() if s else ""

    def lists(stops: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(0, stops), pa.int32()), pa.array(values, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path_a, path_b)
        row = TaskContext.get().partitionId() << 33
        for rows, _, found in _batches(batches, enc):
            b = Batch(found, enc)
            pair, times, per_text = b.pairs()
            in_docs = np.unique(pair, return_counts=True)
            stops = np.append(np.cumsum(per_text), len(pair) + len(in_docs[0]))
            n = len(found)
            counts = [b.n_a, b.n_b, np.diff(b.stop_group, prepend=0), np.diff(b.stop_link, prepend=0)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + n + 1)),
                    pa.concat_arrays([rows.column(0), pa.nulls(1, pa.int64())]),
                    *(pa.array(np.append(c, 0), pa.int64()) for c in counts),
                    pa.array([digest(g) for g in b.group_texts()] + [None], pa.string()),
                    lists(stops, np.concatenate([pair, in_docs[0]]), pa.int64()),
                    lists(stops, np.concatenate([times, in_docs[1]]), pa.int32()),
                    pa.array([None] * n + [n], pa.int64()),
                ],
                ["row", "doc_id", *_COUNTS, "groups_sha256", "pairs", "times", "docs"],
            )
            row += n + 1

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, LINKED)


def pair_counts(rows: DataFrame) -> DataFrame:
    """``pair, count, best``: documents that hold each linked pair of ids, and whether no pair of its A id has more."""
    counts = (
        rows.where("docs is not null")
        .select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
        .groupBy(F.col("p.pairs").alias("pair"))
        .agg(F.sum("p.times").alias("count"))
    )
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("count").alias("most"))
    return counts.join(most, F.shiftright("pair", 32) == F.col("a")).select(
        "pair", "count", (F.col("count") == F.col("most")).alias("best")
    )


def link_statistics(docs: DataFrame, path_a: str, path_b: str, broadcast: int = BROADCAST_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    Documents meet the counts of their pairs by a broadcast of at most ``broadcast`` pairs. If
    there are more, those in over one of ``HOT_SHARE`` documents are sent (at most ``HOT_SHARE`` times
    the pairs of a mean document) and the others are joined by a shuffle in which no pair is hot.
    """
    rows = stored(linked(docs, path_a, path_b))
    counts = stored(pair_counts(rows))
    texts = rows.where("docs is null")
    links = texts.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(
        "row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times")
    )
    bar = 0
    if counts.count() > broadcast:
        bar = (rows.agg(F.sum("docs")).first()[0] or 0) // HOT_SHARE
    hot, others = counts.where(F.col("count") > bar), counts.where(F.col("count") <= bar)
    met = links.join(F.broadcast(hot), "pair")
    if bar:
        rest = links.join(F.broadcast(hot.select("pair")), "pair", "left_anti")
        met = met.unionByName(rest.join(others, "pair"))
    sums = met.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("count")).alias("count_sum"),
    )
    return texts.join(sums, "row", "left").select(
        "doc_id",
        *_COUNTS,
        F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"),
        "groups_sha256",
    )
