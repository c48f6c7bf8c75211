"""Best-fit packing into sequences of several permitted lengths.

Documents longer than the greatest permitted length are cut into full sequences
and a rest. The rests are packed longest first: each goes to the open sequence
where it leaves least room (best fit). Where none has room, every permitted
length that holds the piece is tried against the pieces still to come: what
would fill it (again longest first), the length that it would have after
downsizing, and the cost of that for each token. The least cost opens; its
sequence then takes part in the best fit. At last every sequence is given the
least permitted length that holds its contents.

A sequence of length c costs ``overhead + c + c * c / attention``: a fixed part,
one for each position, and attention, which grows with the square. Short
sequences pay the fixed part and their gaps, long ones the attention, so the
permitted lengths compete and the pieces at hand decide.

Rows are dealt to shards in equal numbers, whatever their ids, and each shard is
packed on its own; a shard needs room for its ids and lengths only. Shards are
large enough that the gaps at their ends do not matter. Lengths are stored before
they are counted, so they are computed once.

Rows with null or no length take no place and give no row. Ties go to the smaller
id and then to the sequence opened first. Repeated rows are packed each; a null
id is kept as it is; other columns are not read; an empty table gives no row.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import accumulate
from operator import neg

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewise.llm.common import stored

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 16
#: Length at which attention costs as much as all else of a position.
ATTENTION = 1 << 16
#: Rows that one shard packs together.
SHARD_ROWS = 50_000

PACKED = "doc_id long, piece long, piece_start long, length long, bin_id string, bin_offset long, bin_capacity long"
_PACKED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int64()),
        ("piece_start", pa.int64()),
        ("length", pa.int64()),
        ("bin_id", pa.string()),
        ("bin_offset", pa.int64()),
        ("bin_capacity", pa.int64()),
    ]
)


def smallest(capacities: tuple[int, ...], content: int) -> int:
    return capacities[bisect_left(capacities, content)]


def cost(capacity: int, overhead: int = OVERHEAD, attention: int = ATTENTION) -> float:
    return overhead + capacity + capacity * capacity / attention


class ToCome:
    """The pieces that follow, longest first, and what of them goes into a room."""

    def __init__(self, lengths: list[int]) -> None:
        self.lengths = lengths
        self.sums = list(accumulate(lengths, initial=0))

    def fill(self, at: int, room: int) -> int:
        """Tokens that pieces from number ``at`` on put into ``room``, each taken that still fits."""
        n, free = len(self.lengths), room
        while free and (at := bisect_left(self.lengths, -free, at, n, key=neg)) < n:
            # The run of pieces from here that fits as a whole.
            end = bisect_right(self.sums, self.sums[at] + free) - 1
            free -= self.sums[end] - self.sums[at]
            at = end
        return room - free


def best_fit(
    lengths: list[int], capacities: tuple[int, ...], overhead: int = OVERHEAD, attention: int = ATTENTION
) -> tuple[list[tuple[int, int]], list[int]]:
    """Place pieces that come longest first: (bin, offset) of each, and the lengths of the bins after downsizing.

    ``open_bins`` holds (room, bin) in order of room, so the fullest bin that has
    room is one bisection away.
    """
    to_come = ToCome(lengths)
    price = {c: cost(c, overhead, attention) for c in capacities}
    places: list[tuple[int, int]] = []
    filled: list[int] = []
    open_bins: list[tuple[int, int]] = []

    def rate(at: int, capacity: int) -> tuple[float, int]:
        content = lengths[at] + to_come.fill(at + 1, capacity - lengths[at])
        return price[smallest(capacities, content)] / content, capacity

    for i, length in enumerate(lengths):
        at = bisect_left(open_bins, (length, -1))
        if at < len(open_bins):
            room, k = open_bins.pop(at)
        else:
            room = min((c for c in capacities if c >= length), key=lambda c: rate(i, c))
            k = len(filled)
            filled.append(0)
        places.append((k, filled[k]))
        filled[k] += length
        if room > length:
            insort(open_bins, (room - length, k))
    return places, [smallest(capacities, f) for f in filled]


def pack(
    lengths: DataFrame,
    capacities: tuple[int, ...] = CAPACITIES,
    overhead: int = OVERHEAD,
    attention: int = ATTENTION,
) -> DataFrame:
    """Rows ``doc_id, length`` to one row for each piece, with its sequence, its place there and the sequence's length."""
    capacities = tuple(sorted(set(capacities)))
    if not capacities or capacities[0] < 1:
        raise ValueError("permitted lengths are positive")
    rows = stored(lengths.select(F.col("doc_id").cast("long"), F.col("length").cast("long"))).where("length > 0")
    shards = max(1, -(-rows.count() // SHARD_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        whole = [(n, i) for b in batches for i, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        most = capacities[-1]
        out: list[tuple] = []
        n_full = 0
        rests: list[tuple[int, int | None, int, int]] = []  # length, doc_id, piece, start

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _PACKED)], schema=_PACKED)
                out.clear()

        for n, doc_id in sorted(whole, key=lambda r: (-r[0], r[1] is None, r[1] or 0)):
            for piece in range(n // most):
                out.append((doc_id, piece, piece * most, most, f"{shard}-f{n_full}", 0, most))
                n_full += 1
                if len(out) >= 10_000:
                    yield from flush()
            if n % most:
                rests.append((n % most, doc_id, n // most, n - n % most))
        rests.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))
        places, sizes = best_fit([r[0] for r in rests], capacities, overhead, attention)
        for (length, doc_id, piece, start), (k, offset) in zip(rests, places):
            out.append((doc_id, piece, start, length, f"{shard}-{k}", offset, sizes[k]))
            if len(out) >= 10_000:
                yield from flush()
        yield from flush()

    return rows.repartition(shards).mapInArrow(run, PACKED)
