"""Benchmark decontamination by latent semantic retrieval.

Words are hashed to ``FEATURES`` features and weighed by their inverse document
frequency over all documents. A distributed randomised SVD of TF-IDF passages
gives a basis of ``RANK`` latent directions: in each round every task multiplies
its passages with the basis and sends the product's blocks, which are added up in
Spark. It is fitted on all items of a block and all passages of the corpus, which
are stored once and read in each round.

Then every text is cut into windows of ``STEP``-word steps, as many as an item
takes wherever it begins. A window is a candidate if the words that it shares with
the item weigh as much as the lightest words do that could pass the checks below,
so the words around an item take no part and no text that passes is missed.
Candidates are taken in the order of their cosine with the item in latent space.
They are checked by the longest common subsequence of words,
which also finds reordered or thinned-out wordings, and by the answer, taken to be
the item's last words: enough of both has to be there. Items of fewer than
``LEAST_WORDS`` words have to be there word by word.

Items are the queries, taken in blocks of ``ITEMS`` against all rows; a block's
model has a fixed greatest size. Windows are looked at inside their own text's
task, so nothing is shuffled, and no row is left out.

Null texts and items match nothing, nor do items without words. Repeated items and rows match each. Empty tables give empty results; other
columns stay and are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.llm.common import byte_words, passing, stored

FEATURES = 1 << 13
RANK = 128
EXTRA = 8
POWER_ROUNDS = 2
#: Items count so much more than passages of the corpus, so that the basis spans a block of them.
ITEM_WEIGHT = 4.0
PASSAGE = 64
STEP = 16
ITEMS = 200
LEAST_WORDS = 8
#: Steps that are weighed together, and words of candidates that are compared together.
CHUNK = 4096
COMPARED = 1 << 20
#: Texts that are taken apart together, and passages that one task multiplies, as it sends a part as large as the basis.
TEXTS = 128
TASK_PASSAGES = 100_000
LCS_SHARE = 0.7
ANSWER_WORDS = 8
ANSWER_SHARE = 0.5
_MARKS = b".,;:!?\"'()[]|-"


def normal_words(text: str | None) -> list[bytes]:
    return [s for w in byte_words(text) if (s := w.strip(_MARKS))]


_SPACES = b"\t\n\x0b\x0c\r "
_LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
_SAID = ~np.isin(np.arange(256), list(_SPACES))
_SOLID = _SAID & ~np.isin(np.arange(256), list(_MARKS))


def _u64(x: int) -> np.uint64:
    return np.uint64(x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Both halves of the products of 128 bits, one xor the other."""
    low, half = _u64(0xFFFFFFFF), _u64(32)
    a0, a1, b0, b1 = a & low, a >> half, b & low, b >> half
    mid = a1 * b0 + (a0 * b0 >> half)
    cross = (mid & low) + a0 * b1
    return a * b ^ (a1 * b1 + (mid >> half) + (cross >> half))


def hashes(said: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XXH3 (64 bits) of the words at given places of an array of bytes, as ``xxhash`` has it; up to 16 bytes by arrays."""
    padded = np.append(said, np.zeros(8, dtype=np.uint8))
    of4, of8 = (np.ndarray(len(said), dtype, padded, strides=(1,)) for dtype in ("<u4", "<u8"))
    out = np.empty(len(at), dtype=np.uint64)
    for least, most in ((1, 3), (4, 8), (9, 16)):
        mine = np.flatnonzero((size >= least) & (size <= most))
        a, n = at[mine], size[mine]
        long = n.astype(np.uint64)
        if most == 3:
            x = said[a].astype(np.uint64) << _u64(16) | said[a + n // 2].astype(np.uint64) << _u64(24)
            x = (x | said[a + n - 1] | long << _u64(8)) ^ _u64(0x87275A9B)
            x = (x ^ x >> _u64(33)) * _u64(0xC2B2AE3D27D4EB4F)
            x = (x ^ x >> _u64(29)) * _u64(0x165667B19E3779F9)
            x ^= x >> _u64(32)
        elif most == 8:
            x = (of4[a + n - 4] + (of4[a].astype(np.uint64) << _u64(32))) ^ _u64(0xC73AB174C5ECD5A2)
            x ^= (x << _u64(49) | x >> _u64(15)) ^ (x << _u64(24) | x >> _u64(40))
            x *= _u64(0x9FB21C651E98DF25)
            x = (x ^ (x >> _u64(35)) + long) * _u64(0x9FB21C651E98DF25)
            x ^= x >> _u64(28)
        else:
            x, y = of8[a] ^ _u64(0x6782737BEA4239B9), of8[a + n - 8] ^ _u64(0xAF56BC3B0996523A)
            x = long + x.byteswap() + y + _times(x, y)
            x = (x ^ x >> _u64(37)) * _u64(0x165667919E3779F9)
            x ^= x >> _u64(32)
        out[mine] = x
    for k in np.flatnonzero(size > 16).tolist():
        out[k] = xxhash.xxh3_64_intdigest(said[at[k] : at[k] + size[k]].tobytes())
    return out


def cut_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts with A-Z in lower case, the first and last place of each word, and the words of each text.

    Words are cut as in ``byte_words``.
    """
    ends = np.cumsum([0, *map(len, texts)])
    said = _LOWER[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    inside = _SAID[said]
    # The first byte of each text, and what follows the last one, begin anew.
    begins = np.append(inside, False)
    begins[1:-1] &= ~inside[:-1]
    stops = np.append(inside[1:], False) if len(said) else inside
    stops = inside & ~stops
    border = ends[(ends > 0) & (ends < len(said))]
    begins[border] = inside[border]
    stops[border - 1] = inside[border - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(stops)
    return said, first, last, np.diff(np.searchsorted(first, ends))


def spoken_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The feature of each word of all texts in order, and the number of words of each text.

    Words are taken without their marks; words of marks alone have the place behind all features.
    """
    said, first, last, sizes = cut_words(texts)
    solid = _SOLID[said]
    at = np.flatnonzero(solid)
    upto = np.cumsum(solid, dtype=np.int32 if len(said) < 1 << 31 else np.int64)
    before = upto[first] - solid[first]
    worded = np.flatnonzero(upto[last] > before)
    start, end = at[before[worded]], at[upto[last[worded]] - 1]
    places = np.full(len(first), FEATURES, dtype=np.int32)
    places[worded] = hashes(said, start, end - start + 1) % _u64(FEATURES)
    return places, sizes


def in_bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def features(words: list[bytes]) -> np.ndarray:
    """The feature of each word without its marks; words of marks alone have the place behind all features."""
    return spoken_features(words)[0]


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that are taken apart together: ``TEXTS`` at most."""
    for batch in batches:
        for at in range(0, len(batch), TEXTS):
            yield batch.slice(at, TEXTS)


def chosen(key: int, n: int, rate: float) -> np.ndarray:
    """Which of n positions of a text are chosen, each with the given rate and by its hash alone."""
    x = (np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key % (1 << 64))
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(factor)
    return np.flatnonzero((x >> np.uint64(11)) < rate * (1 << 53))


def lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values with the bytes of a numpy array from one end to the next."""
    offsets = (ends * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def from_lists(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of binary values, one after the other, and where each begins, with the end of all."""
    _, offsets, values = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    numbers = np.frombuffer(values or b"", dtype=np.uint8)[ends[0] : ends[-1]].view(dtype)
    return numbers, (ends - ends[0]) // np.dtype(dtype).itemsize


def feature_counts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct features of passages, a row of ``PASSAGE`` places each, how often each stands there, and where rows end."""
    rows.sort(axis=1)
    flat = rows.ravel()
    new = np.ones(len(flat), dtype=bool)
    new[1:] = flat[1:] != flat[:-1]
    new[::PASSAGE] = True
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(flat)))
    known = flat[begin] < FEATURES
    ends = np.append(0, np.cumsum(np.bincount(begin[known] // PASSAGE, minlength=len(rows))))
    return flat[begin][known], n[known].astype(np.uint8), ends


def counted(texts: DataFrame, rate: float = 1.0) -> DataFrame:
    """``places, counts``: the distinct features of passages of texts (columns ``key, text``), chosen at a rate, and their counts.

    Places are numbers of 16 bits and counts of 8 bits, side by side in binary values. The last
    row of each task has no places but ``totals``: how many of its texts have each feature, over
    all passages, and how many texts and passages there are. So texts are taken apart once.
    """
    schema = pa.schema([("places", pa.binary()), ("counts", pa.binary()), ("totals", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n_texts, n_passages = np.zeros(FEATURES, dtype=np.int64), 0, 0
        for batch in portions(batches):
            places, sizes = spoken_features([in_bytes(t) for t in batch.column(1).to_pylist()])
            owner = np.repeat(np.arange(len(sizes)), sizes)
            has = np.zeros((len(sizes), FEATURES + 1), dtype=bool)
            has[owner, places] = True
            total += has[:, :FEATURES].sum(axis=0)
            places, owner = places[places < FEATURES], owner[places < FEATURES]
            worded = np.bincount(owner, minlength=len(sizes))
            n = -(-worded // PASSAGE)
            n_texts += len(sizes)
            n_passages += int(n.sum())
            # A passage's places stand side by side, the last one of a text is filled up.
            first = np.cumsum(n) - n
            rows = np.full((n.sum(), PASSAGE), FEATURES, dtype=np.uint16)
            rows.ravel()[np.arange(len(places)) + (first * PASSAGE - np.cumsum(worded) + worded)[owner]] = places
            if rate < 1.0:
                keys = zip(first.tolist(), batch.column(0).to_pylist(), n.tolist())
                rows = rows[np.concatenate([f + chosen(key, k, rate) for f, key, k in keys])]
            at, often, ends = feature_counts(rows)
            yield pa.RecordBatch.from_arrays([lists(at, ends), lists(often, ends), pa.nulls(len(rows), schema.types[2])], schema=schema)
        totals = np.append(total, [n_texts, n_passages]).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(([None], [None], [totals]), schema.types)], schema=schema)

    return texts.select("key", "text").mapInArrow(run, "places binary, counts binary, totals array<long>")


def added_totals(found: DataFrame) -> tuple[np.ndarray, int, int]:
    """The totals of all tasks of ``counted``."""
    parts = found.where("totals is not null").select(F.posexplode("totals").alias("feature", "n"))
    out = np.zeros(FEATURES + 2, dtype=np.int64)
    for row in parts.groupBy("feature").agg(F.sum("n").alias("n")).collect():
        out[row["feature"]] = row["n"]
    return out[:-2], int(out[-2]), int(out[-1])


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int, int]:
    """How many texts have each feature, over all rows, and how many rows and passages there are."""
    return added_totals(counted(docs.select(F.lit(0).alias("key"), "text")))


def weighed(found: DataFrame, idf: np.ndarray, length: float = 1.0) -> DataFrame:
    """``places, weights``: TF-IDF vectors of equal length of the passages of ``counted``; weights have 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ends = from_lists(batch.column(0), np.uint16)
            w = from_lists(batch.column(1), np.uint8)[0] * idf[at]
            row = np.repeat(np.arange(len(batch)), np.diff(ends))
            norm = np.sqrt(np.bincount(row, w * w, minlength=len(batch)))
            w *= (length / np.maximum(1e-9, norm))[row]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(w.astype(np.float32), ends)], ["places", "weights"])

    return found.where("totals is null").select("places", "counts").mapInArrow(run, "places binary, weights binary")


def passages(texts: DataFrame, idf: np.ndarray, length: float = 1.0, rate: float = 1.0) -> DataFrame:
    """``places, weights``: TF-IDF vectors of equal length of passages of texts (columns ``key, text``), chosen at a rate."""
    return weighed(counted(texts, rate), idf, length)


def weighed_corpus(docs: DataFrame) -> tuple[np.ndarray, DataFrame]:
    """Inverse document frequencies, and the stored vectors of all passages."""
    with passing(docs.sparkSession) as keep:
        found = stored(counted(docs.select(F.xxhash64("doc_id", "text").alias("key"), "text")))
        df, n, n_passages = added_totals(found)
        idf = np.log((n + 1) / (df + 1)) + 1e-3
        corpus = keep(weighed(found, idf))
    return idf, corpus.coalesce(-(-n_passages // TASK_PASSAGES) or 1)


def add_products(at: np.ndarray, w: np.ndarray, ends: np.ndarray, v: np.ndarray, out: np.ndarray) -> None:
    """Adds A'Av to ``out`` for sparse rows A: features and weights side by side, a row from one end to the next.

    Rows of ``v`` are taken together and multiplied in place, first by row of A, then by feature.
    """
    y = np.zeros((len(ends) - 1, v.shape[1]), dtype=np.float32)
    order = np.argsort(at, kind="stable")
    found, begin = np.unique(at[order], return_index=True)
    stops = np.append(begin[1:], len(at))
    portion = ends[::PASSAGE] if len(y) % PASSAGE == 0 else np.append(ends[::PASSAGE], ends[-1])
    most = max(np.diff(portion).max(initial=0), (stops - begin).max(initial=0))
    near = np.empty((most, v.shape[1]), dtype=np.float32)
    for low in range(0, len(y), PASSAGE):
        some = ends[low : low + PASSAGE + 1].tolist()
        np.take(v, at[some[0] : some[-1]], axis=0, out=near[: some[-1] - some[0]], mode="clip")
        for k, (a, b) in enumerate(zip(some, some[1:]), low):
            np.dot(w[a:b], near[a - some[0] : b - some[0]], out=y[k])
    row, w = np.repeat(np.arange(len(y)), np.diff(ends))[order], w[order]
    for place, a, b in zip(found.tolist(), begin.tolist(), stops.tolist()):
        np.take(y, row[a:b], axis=0, out=near[: b - a], mode="clip")
        out[place] += w[a:b] @ near[: b - a]


def gram_product(vectors: DataFrame, basis: np.ndarray, blocks: int = 64) -> np.ndarray:
    """A'A times the basis, for the passages A; tasks send their parts in blocks of features."""
    shared = vectors.sparkSession.sparkContext.broadcast(basis.astype(np.float32))
    height = FEATURES // blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        out = np.zeros(v.shape)
        for batch in batches:
            at, ends = from_lists(batch.column(0), np.uint16)
            add_products(at, from_lists(batch.column(1), np.float32)[0], ends, v, out)
        sent = out.astype(np.float32)
        parts = [sent[k * height : (k + 1) * height].tobytes() for k in range(blocks)]
        yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int64()), pa.array(parts, pa.binary())], ["block", "part"])

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(height * basis.shape[1])
        for p in parts["part"]:
            total += np.frombuffer(p, dtype=np.float32)
        return pd.DataFrame({"block": [parts["block"].iloc[0]], "part": [total.tobytes()]})

    summed = vectors.mapInArrow(run, "block long, part binary").groupBy("block").applyInPandas(add, "block long, part binary")
    out = np.zeros_like(basis)
    for row in summed.collect():
        k = row["block"]
        out[k * height : (k + 1) * height] = np.frombuffer(row["part"]).reshape(height, -1)
    return out


def latent_basis(vectors: DataFrame) -> np.ndarray:
    """The leading right singular vectors of the passages, by randomised subspace iteration."""
    basis = np.linalg.qr(np.random.default_rng(9).standard_normal((FEATURES, RANK + EXTRA)))[0]
    for _ in range(POWER_ROUNDS):
        basis = np.linalg.qr(gram_product(vectors, basis))[0]
    values, turn = np.linalg.eigh(basis.T @ gram_product(vectors, basis))
    return basis @ turn[:, np.argsort(-values)[:RANK]]


class Model:
    """Items, their latent vectors, weights and the projection of features, for one block of items."""

    def __init__(self, items: list[tuple[int | None, str]], basis: np.ndarray, idf: np.ndarray) -> None:
        self.projection = np.vstack([basis * idf[:, None], np.zeros((1, basis.shape[1]))]).astype(np.float32)
        self.squares = np.append(idf**2, 0.0)
        weight = idf**2
        worded = [(i, w) for i, t in items if (w := normal_words(t))]
        self.short = [(i, w, features(w)) for i, w in worded if len(w) < LEAST_WORDS]
        self.rarity = np.append(idf, 0.0)
        known = sorted((x for x in worded if len(x[1]) >= LEAST_WORDS), key=lambda x: len(x[1]))
        self.ids, self.words = [i for i, _ in known], [w for _, w in known]
        self.sizes = np.array([-(-(len(w) + STEP - 1) // STEP) for w in self.words], dtype=np.int64)
        self.weights = np.zeros((FEATURES + 1, len(known)), dtype=np.float32)
        self.counts: list[tuple[np.ndarray, np.ndarray]] = []
        self.least = np.zeros(len(known), dtype=np.float32)
        self.vectors = np.zeros((len(known), basis.shape[1]), dtype=np.float32)
        for k, words in enumerate(self.words):
            places = features(words)
            vector = self.projection[places].sum(axis=0)
            self.vectors[k] = vector / max(1e-9, np.linalg.norm(vector))
            at, n = np.unique(places, return_counts=True)
            self.counts.append((at, n.astype(np.float32)))
            self.weights[at, k] = n * weight[at]
            # The least weight of features that have the needed share of the item's words.
            order = np.argsort(weight[at])
            before = np.cumsum(n[order]) - n[order]
            taken = np.clip(LCS_SHARE * len(words) - before, 0, n[order])
            self.least[k] = (1 - 1e-4) * (taken * weight[at][order]).sum()
        self.used = np.append((self.weights[:-1] > 0).any(axis=1), False)

    def matches(self, texts: list[str | None]) -> list[list[dict]]:
        """For each text the items it contains."""
        said, n_words = spoken_features([in_bytes(t) for t in texts])
        # Few texts are looked at word by word.
        spoken = cache(lambda d: byte_words(texts[d]))
        n_steps = -(-n_words // STEP)
        starts = np.concatenate([[0], np.cumsum(n_steps)]).astype(np.int64)
        out: list[list[dict]] = [[] for _ in texts]
        if not starts[-1]:
            return out
        places = np.full(starts[-1] * STEP, FEATURES, dtype=np.int32)
        places[np.arange(len(said)) + np.repeat(starts[:-1] * STEP - (np.cumsum(n_words) - n_words), n_words)] = said
        owner = np.repeat(np.arange(len(texts)), n_steps)
        if self.ids:
            found = self._candidates(places, starts, owner)
            self._check(out, spoken, places, starts, owner, found)
        if self.short:
            self._exact(out, spoken, places, starts, owner)
        return out

    def _candidates(self, places: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
        """First steps of windows, each with an item whose words the window and a step around it have enough of."""
        steps = np.where(self.used[places], places, FEATURES).reshape(-1, STEP)
        steps.sort(axis=1)
        steps[:, 1:][steps[:, 1:] == steps[:, :-1]] = FEATURES
        steps.sort(axis=1)
        n, ends = len(steps), starts[owner + 1]
        first = np.arange(n) == starts[owner]
        most = int(self.sizes.max())
        found: list[tuple[int, int]] = []
        for low in range(0, n, CHUNK):
            m = min(CHUNK, n - low)
            near = steps[max(0, low - 1) : low + m + most]
            heavy = np.zeros((m + most + 1, len(self.ids)), dtype=np.float32)
            part = heavy[int(low == 0) :][: len(near)]
            for c in range(STEP):
                rows = np.flatnonzero(near[:, c] < FEATURES)
                if not len(rows):
                    break
                part[rows] += self.weights[near[rows, c]]
            for size in np.unique(self.sizes).tolist():
                items = slice(*np.searchsorted(self.sizes, (size, size + 1)))
                if size <= STEP:
                    weight = heavy[:m, items].copy()
                    for k in range(1, size + 2):
                        weight += heavy[k : k + m, items]
                else:
                    upto = np.cumsum(heavy[:, items], axis=0, dtype=np.float64)
                    upto = np.vstack([np.zeros((1, upto.shape[1])), upto])
                    weight = upto[size + 2 : size + 2 + m] - upto[:m]
                begin = np.arange(low, low + m)
                begins = first[low : low + m] | (begin + size <= ends[low : low + m])
                rows, cols = np.nonzero((weight >= self.least[items]) & begins[:, None])
                order = np.argsort(cols, kind="stable")
                rows, cols = rows[order] + low, cols[order] + items.start
                for item in np.unique(cols).tolist():
                    mine = rows[slice(*np.searchsorted(cols, (item, item + 1)))]
                    found += [(b, item) for b in self._holding(item, mine, steps, starts, owner).tolist()]
        return found

    def _holding(self, item: int, begin: np.ndarray, steps: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Those windows that have, with a step around them, the needed share of the item's words in any order."""
        at, n = self.counts[item]
        size = int(self.sizes[item])
        local = np.full(FEATURES + 1, len(at), dtype=np.int32)
        local[at] = np.arange(len(at))
        kept = []
        width = max(1, COMPARED // ((size + 2) * STEP))
        for k in range(0, len(begin), width):
            b = begin[k : k + width]
            which = b[:, None] + np.arange(-1, size + 1)
            which = np.clip(which, starts[owner[b]][:, None], starts[owner[b] + 1][:, None] - 1)
            has = np.zeros((len(b), len(at) + 1), dtype=np.float32)
            has[np.arange(len(b))[:, None], local[steps[which].reshape(len(b), -1)]] = 1.0
            kept.append(b[has[:, :-1] @ n >= LCS_SHARE * len(self.words[item]) - 1e-3])
        return np.concatenate(kept)

    def _cosine(self, item: int, places: np.ndarray) -> float:
        """In latent space, the window's length being that of its whole TF-IDF vector."""
        length = max(1e-9, self.squares[places].sum()) ** 0.5
        return float(self.projection[places].sum(axis=0) @ self.vectors[item] / length)

    def _check(self, out, spoken, places, starts, owner, candidates) -> None:
        best: dict[tuple[int, int], list[tuple[float, int]]] = {}
        for b, item in candidates:
            doc = int(owner[b])
            end = min(b + int(self.sizes[item]), int(starts[doc + 1]))
            best.setdefault((doc, item), []).append((self._cosine(item, places[b * STEP : end * STEP]), b))
        for (doc, item), found in best.items():
            words, wanted, size = spoken(doc), self.words[item], int(self.sizes[item])
            for cosine, b in sorted(found, reverse=True):
                at = (b - int(starts[doc])) * STEP
                region = [w.strip(_MARKS) for w in words[max(0, at - STEP) : at + (size + 1) * STEP]]
                share = common(wanted, region) / len(wanted)
                if share < LCS_SHARE:
                    continue
                answer = wanted[-ANSWER_WORDS:]
                kept = common(answer, region) / len(answer)
                if kept >= ANSWER_SHARE:
                    out[doc].append(
                        {"item_id": self.ids[item], "similarity": cosine, "lcs_share": share, "answer_share": kept}
                    )
                    break

    def _exact(self, out, spoken, places, starts, owner) -> None:
        """Short items stand in a text word by word; marks between words do not count."""
        at = np.flatnonzero(places < FEATURES)
        said, doc = places[at], owner[at // STEP]
        for item, words, wanted in self.short:
            rare = int(np.argmax(self.rarity[wanted]))
            begin = np.flatnonzero(said == wanted[rare]) - rare
            begin = begin[(begin >= 0) & (begin + len(wanted) <= len(said))]
            begin = begin[doc[begin] == doc[begin + len(wanted) - 1]]
            for k, place in enumerate(wanted):
                begin = begin[said[begin + k] == place]
            done = set()
            for b in begin.tolist():
                d = int(doc[b])
                here = (spoken(d)[x - int(starts[d]) * STEP].strip(_MARKS) for x in at[b : b + len(wanted)].tolist())
                if d not in done and list(here) == words:
                    done.add(d)
                    out[d].append({"item_id": item, "similarity": 1.0, "lcs_share": 1.0, "answer_share": 1.0})


def common(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, a bit for each word of ``a``."""
    masks: dict[bytes, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    every = (1 << len(a)) - 1
    v = every
    for w in b:
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & every
    return len(a) - v.bit_count()


MATCHES = "array<struct<item_id: long, similarity: double, lcs_share: double, answer_share: double>>"


def models(docs: DataFrame, benchmark: DataFrame) -> Iterator[Model]:
    """A model for each block of items."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long"), "text")
    n_items = items.count()
    if not n_items:
        return
    idf, corpus = weighed_corpus(docs)
    blocks = -(-n_items // ITEMS)
    for k in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        keyed = mine.select(F.xxhash64("text").alias("key"), "text")
        basis = latent_basis(corpus.union(stored(passages(keyed, idf, ITEM_WEIGHT))))
        yield Model([tuple(r) for r in mine.collect()], basis, idf)


def contained(docs: DataFrame, benchmark: DataFrame) -> Column:
    """An array of the items that each row's text contains."""

    def matcher(model: Model) -> Column:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        @F.pandas_udf(MATCHES)
        def matched(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                found: list[list[dict]] = []
                for at in range(0, len(texts), TEXTS):
                    found += shared.value.matches(texts.iloc[at : at + TEXTS].tolist())
                yield pd.Series(found, dtype=object)

        return matched(F.col("text"))

    found = [matcher(m) for m in models(docs, benchmark)]
    return F.concat(*found) if found else F.array().cast(MATCHES)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item that it contains."""
    found = docs.select("doc_id", F.explode(contained(docs, benchmark)).alias("m"))
    return found.select("doc_id", "m.item_id", "m.similarity", "m.lcs_share", "m.answer_share")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows that contain no item; columns stay as they are."""
    return docs.where(F.size(contained(docs, benchmark)) == 0)
