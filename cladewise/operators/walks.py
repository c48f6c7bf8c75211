"""Walks over the tokens of many trees at once, as arrays within the tasks.

Spark takes the texts apart and brings trees and what is asked of them together;
here sums and minima run along the tokens of the trees at hand, a portion of them
at a time. Trees do not meet each other: floating sums are taken tree by tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OPEN, CLOSE, COMMA, TEXT = range(4)

# Tokens and asked pairs taken together, unless one tree has more.
_AT_ONCE = 250_000

# Summed lengths carry rounding noise; distances are compared at this many digits.
_DIGITS = 9


@dataclass
class Places:
    """Tips of some trees in file order, side by side.

    ``low`` ranks the shallowest bracket open between a tip and the next one by depth and
    root distance, which ``low_at`` holds by rank. A tree with a bracket that closes before
    its first tip begins with a place that has no tip.
    """

    row: np.ndarray  # the tree
    seg: np.ndarray  # the tree as a number without gaps
    starts: np.ndarray  # first place of each seg
    label: pa.Array  # null where there is no tip or no name
    is_tip: np.ndarray
    root_distance: np.ndarray
    low: np.ndarray
    low_at: np.ndarray


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([key[1:] != key[:-1] for key in keys])
    return np.flatnonzero(new)


def _running(step: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Running sums of whole numbers that begin anew at ``starts``."""
    total = np.cumsum(step)
    return total - np.repeat(total[starts] - step[starts], np.diff(starts, append=len(step)))


def _labels(texts: pa.Array) -> pa.Array:
    """Names before the lengths, quotes taken off and blanks turned to underscores, as ``tree._label`` has it."""
    has_length = pc.and_(pc.match_substring(texts, ":"), pc.invert(pc.ends_with(texts, "'")))
    names = pc.if_else(has_length, pc.replace_substring_regex(texts, ":[^:]*$", ""), texts)
    quoted = pc.starts_with(names, "'")
    if pc.any(quoted).as_py():
        bare = pc.replace_substring(pc.utf8_slice_codeunits(names, 1, -1), "''", "'")
        names = pc.replace_substring(pc.if_else(quoted, bare, names), " ", "_")
    return pc.if_else(pc.equal(names, ""), None, names)


def places(text: pa.Array, length: np.ndarray, sizes: np.ndarray) -> Places:
    """Tips with root distances and low points, from the tokens of trees of the given sizes."""
    kind = pc.index_in(text, pa.array(["(", ")", ","], text.type)).fill_null(TEXT).to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    starts = _changes(row)
    before = np.concatenate([[COMMA], kind[:-1]])[: len(kind)]
    before[starts] = COMMA
    # A closing bracket takes the text behind it.
    named = (kind == TEXT) & (before == CLOSE)
    texts = np.flatnonzero(named)
    length = length.copy()
    length[texts - 1] = length[texts]
    token = np.flatnonzero((kind != COMMA) & ~named)
    row, kind, length = row[token], kind[token], length[token]
    starts = _changes(row)
    is_open, is_close, is_tip = kind == OPEN, kind == CLOSE, kind == TEXT
    depth = _running(is_open.astype(np.int64) - is_close, starts)
    # At one level opening and closing brackets alternate, so the partner is the next of that level.
    brackets = np.flatnonzero(~is_tip)
    level = (depth + is_close)[brackets]
    span = level.max(initial=0) - level.min(initial=0) + 1
    key = row[brackets] * span + level
    order = np.argsort(key, kind="stable")
    paired = is_open[brackets[order[:-1]]] & (key[order[:-1]] == key[order[1:]])
    length[brackets[order[:-1][paired]]] = length[brackets[order[1:][paired]]]
    step = np.where(is_open, length, np.where(is_close, -length, 0.0))
    here = np.empty(len(step))
    for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(step)]):
        np.cumsum(step[at:end], out=here[at:end])
    nth = _running(is_tip.astype(np.int64), starts)
    # A closing bracket counts to the tip before it. An opening bracket lies deeper
    # than the token before it and is never a low point.
    shut = np.flatnonzero(~is_open)
    begins = _changes(row[shut], nth[shut])
    first, runs = shut[begins], np.diff(begins, append=len(shut))
    if not len(first):
        none = np.zeros(0, dtype=np.int64)
        return Places(none, none, none, text.slice(0, 0), none.astype(bool), none.astype(float), none, none.astype(float))
    low_depth = np.minimum.reduceat(depth[shut], begins)
    lowest = depth[shut] == np.repeat(low_depth, runs)
    low_here = np.minimum.reduceat(np.where(lowest, here[shut], np.inf), begins)
    by_depth = np.lexsort((low_here, low_depth))
    low = np.empty(len(first), dtype=np.int64)
    low[by_depth] = np.arange(len(first))
    tip, row = is_tip[first], row[first]
    starts = _changes(row)
    return Places(
        row,
        np.repeat(np.arange(len(starts)), np.diff(starts, append=len(row))),
        starts,
        _labels(text.take(pa.array(token[first], mask=~tip))),
        tip,
        np.where(tip, here[first] + length[first], np.nan),
        low,
        low_here[by_depth],
    )


def _rounded(x: np.ndarray) -> np.ndarray:
    """To ``_DIGITS`` digits; numbers too great to have as many stay."""
    fits = np.abs(x) < 2**53 / 10**_DIGITS
    return np.where(fits, np.round(np.where(fits, x, 0.0), _DIGITS) + 0.0, x)


def _sweep(p: Places, source: np.ndarray) -> np.ndarray:
    """Distance of every place to that in ``source``, one for each seg, without a walk for each pair."""
    n, at, start = len(p.row), np.arange(len(p.row)), source[p.seg]
    # Portions of lesser numbers one after the other: a running minimum begins anew with each tree.
    onward, back = (p.seg[-1] - p.seg) * (n + 1), p.seg * (n + 1)
    after = np.minimum.accumulate(np.where(at >= start, p.low, n) + onward) - onward
    until = np.minimum.accumulate((np.where(at < start, p.low, n) + back)[::-1])[::-1] - back
    lowest = np.where(at > start, np.concatenate([[0], after[:-1]]), np.where(at < start, until, 0))
    distance = _rounded(p.root_distance + p.root_distance[start] - 2 * p.low_at[lowest])
    return np.where(at == start, 0.0, distance)


def _ordered(p: Places, distance: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Distances as they compare: no number is greatest, none at all is least."""
    known = p.is_tip if start is None else p.is_tip | (np.arange(len(p.row)) == start[p.seg])
    return np.where(known, np.where(np.isnan(distance), np.inf, distance), -np.inf)


def _greatest(p: Places, rank: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The place of greatest (label, number) of each seg among the given ones, -1 where there is none."""
    ranks = np.where(of, rank, -1)
    top = np.maximum.reduceat(ranks, p.starts)[p.seg]
    return np.maximum.reduceat(np.where(of & (ranks == top), np.arange(len(of)), -1), p.starts)


def from_farthest(p: Places) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each seg its farthest tip (-1: none), that one's partner, their distance; and distances of all places to it."""
    rank = pc.rank(p.label, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)

    def top(distance: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(distance, p.starts)

    def farthest(distance: np.ndarray) -> np.ndarray:
        return _greatest(p, rank, distance == top(distance)[p.seg])

    s1 = farthest(_ordered(p, p.root_distance))
    d1 = _ordered(p, _sweep(p, s1), s1)
    s2 = farthest(d1)
    d2 = _ordered(p, _sweep(p, s2), s2)
    diameter = top(d1)
    second = _greatest(p, rank, np.maximum(d1, d2) == diameter[p.seg])
    d3 = _ordered(p, _sweep(p, second), second)
    at_full = (d3 == diameter[p.seg]) & (np.arange(len(d3)) != second[p.seg])
    first = _greatest(p, rank, at_full)
    d = _sweep(p, np.where(first < 0, p.starts, first))
    return first, second, np.where(np.isinf(diameter), d[second], diameter), d


def _offsets(lists: pa.Array) -> np.ndarray:
    return lists.offsets.to_numpy().astype(np.int64)


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Places]]:
    """Places of portions of the trees in a batch, with the first row of each and that behind its last."""
    tokens = batch.column("tokens")
    offsets = _offsets(tokens)
    held = sum(_offsets(column) for column in batch.columns if pa.types.is_nested(column.type))
    lo = 0
    while lo < len(tokens):
        hi = max(lo + 1, int(np.searchsorted(held, held[lo] + _AT_ONCE, side="right")) - 1)
        part = tokens.values.slice(offsets[lo], offsets[hi] - offsets[lo])
        text, length = part.flatten()
        yield lo, hi, places(text, length.fill_null(0.0).to_numpy(), np.diff(offsets[lo : hi + 1]))
        lo = hi


def farthest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``tree, label, d`` of all tips; the farthest tip itself also has its ``partner`` and ``max_distance``."""
    for batch in batches:
        for lo, hi, p in _portions(batch):
            if not len(p.row):
                continue
            first, second, diameter, d = from_farthest(p)
            found = np.flatnonzero(first[p.seg] >= 0)
            is_first = (first[p.seg] == np.arange(len(d)))[found]
            seg = p.seg[found]
            known = p.is_tip[found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("tree").slice(lo, hi - lo).take(pa.array(p.row[found])),
                    p.label.take(pa.array(found)),
                    pa.array(d[found], mask=~known),
                    p.label.take(pa.array(second[seg], mask=~is_first)),
                    pa.array(diameter[seg], mask=~is_first),
                ],
                ["tree", "label", "d", "partner", "max_distance"],
            )


def _ends(p: Places, codes: np.ndarray, row: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All places with the asked labels of the asked trees: which question, which place."""
    tips = np.flatnonzero(codes >= 0)
    key = p.row[tips] * n + codes[tips]
    order = np.argsort(key, kind="stable")
    key, asked = key[order], np.where(code >= 0, row * n + code, -1)
    lo = np.searchsorted(key, asked, side="left")
    times = np.searchsorted(key, asked, side="right") - lo
    question = np.repeat(np.arange(len(asked)), times)
    nth = np.arange(len(question)) - np.repeat(np.cumsum(times) - times, times)
    return question, tips[order[lo[question] + nth]]


def _between(p: Places, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The lowest point from place ``x`` on and before ``y`` behind it: two runs of 1, 2, 4, ... gaps cover the stretch."""
    k = np.frexp((y - x).astype(float))[1] - 1
    out, runs = np.zeros(len(x), dtype=np.int64), p.low
    by_k = np.argsort(k, kind="stable")
    ends = np.searchsorted(k[by_k], np.arange(k.max(initial=-1) + 2))
    for step in range(len(ends) - 1):
        q = by_k[ends[step] : ends[step + 1]]
        out[q] = np.minimum(runs[x[q]], runs[y[q] - 2**step])
        runs = np.minimum(runs[: -(2**step)], runs[2**step :])
    return out


def pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``tree, a, b, d`` of the ``pairs`` asked of each tree whose labels are there, once for each tip of that name."""
    for batch in batches:
        pairs = batch.column("pairs")
        offsets = _offsets(pairs)
        for lo, hi, p in _portions(batch):
            asked = pairs.values.slice(offsets[lo], offsets[hi] - offsets[lo])
            a, b = asked.flatten()
            row = np.repeat(np.arange(hi - lo), np.diff(offsets[lo : hi + 1]))
            names = pa.concat_arrays([p.label, a, b]).dictionary_encode()
            codes = names.indices.fill_null(-1).to_numpy().astype(np.int64)
            n, of_a, of_b = len(names.dictionary) + 1, len(p.label), len(p.label) + len(a)
            pair, left = _ends(p, codes[:of_a], row, codes[of_a:of_b], n)
            again, right = _ends(p, codes[:of_a], row[pair], codes[of_b:][pair], n)
            pair, left = pair[again], left[again]
            x, y = np.minimum(left, right), np.maximum(left, right)
            d = np.zeros(len(pair))
            apart = np.flatnonzero(codes[of_a:of_b][pair] != codes[of_b:][pair])
            x, y = x[apart], y[apart]
            d[apart] = _rounded(p.root_distance[x] + p.root_distance[y] - 2 * p.low_at[_between(p, x, y)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("tree").slice(lo, hi - lo).take(pa.array(row[pair])),
                    a.take(pa.array(pair)),
                    b.take(pa.array(pair)),
                    pa.array(d),
                ],
                ["tree", "a", "b", "d"],
            )
