"""Language identification as inference over mixtures.

A model holds, for every language, the probabilities of character n-grams of
words (one to three characters, with a mark at both ends). A word's likelihood
under a language is the geometric mean of its n-gram probabilities, raised to a
fixed power, so that long words do not outweigh all others. A document is a bag
of words drawn from a mixture of languages: expectation-maximisation estimates
the proportions, and languages enter one by one as long as the gain in
log-likelihood exceeds the penalty of the Bayesian information criterion, half
the logarithm of the number of words for each language.

Counting reads all given rows. Each task counts words, takes them apart once and
sends one number for each language and n-gram bucket, so a language or source
that holds most rows adds no more than any other. Buckets are limited so that
the model stays under ``MODEL_BYTES``, which bounds its broadcast.

Null texts, and texts without a letter, are ``und`` with score 0. Null languages
teach nothing. With no labelled row everything is ``und``. Repeated rows and ties
are treated alike; of equally likely languages the first in order of name wins.
Texts of any length are read whole; long words are cut into pieces of
``PIECE`` characters. Other columns are kept and never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.llm.common import portions, unused

MODEL_BYTES = 64 << 20
MOST_BUCKETS = 1 << 17
#: A letter run is cut after so many characters; scripts without spaces give such pieces too.
PIECE = 12
#: The exponent that makes neighbouring n-grams of a word count as fewer independent ones.
SHARPNESS = 3.0
ROUNDS = 12
#: Distinct words a task gathers before it takes them apart, and words that a worker remembers.
GATHER = 50_000
MEMORY = 100_000

#: Words that are taken apart together, and texts and characters that are read together.
WORDS = 1 << 14
TEXTS = 64
CHARS = 1 << 20

#: Runs of letters, long ones in pieces.
_LETTERS = re.compile(rf"[^\W\d_]{{1,{PIECE}}}")
#: Bits of a character in the number of an n-gram.
_BITS = 21
UNKNOWN = "und"


def pieces(text: str | None) -> list[str]:
    """Runs of letters in lower case, long ones in pieces."""
    return _LETTERS.findall(text.lower()) if text else []


class _Buckets(dict):
    """Buckets of n-grams by their numbers, of which a language has few."""

    def __init__(self, size: int) -> None:
        super().__init__()
        self.size = size

    def __missing__(self, number: int) -> int:
        if len(self) >= MEMORY:
            self.clear()
        codes = (number >> shift & (1 << _BITS) - 1 for shift in (0, _BITS, 2 * _BITS))
        gram = "".join(chr(c) for c in codes if c)
        found = self[number] = xxhash.xxh3_64_intdigest(gram) % self.size
        return found

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of the n-grams of all words, one word after the other and short n-grams first, and each word's number of them.

        N-grams are numbered by arrays; only different ones are looked up.
        """
        n = np.fromiter(map(len, words), np.int64, len(words)) + 2
        chars = np.frombuffer(f" {'  '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = 3 * n - 3
        length = np.repeat(n, n)
        at = np.arange(len(chars)) - np.repeat(np.cumsum(n) - n, n)
        place = at + np.repeat(np.cumsum(sizes) - sizes, n)
        numbers = np.empty(int(sizes.sum()), np.int64)
        numbers[place] = gram = chars
        for k in (1, 2):
            # A word's n-grams of k + 1 characters follow those of k; its last characters begin none.
            gram, place = gram[:-1] + (chars[k:] << k * _BITS), (place + length - (k - 1))[:-1]
            length, at = length[:-1], at[:-1]
            begins = at < length - k
            numbers[place[begins]] = gram[begins]
        codes, different = pd.factorize(numbers)
        return np.array([self[g] for g in different.tolist()], np.int64)[codes], sizes


def bucket_count(n_languages: int) -> int:
    size = MOST_BUCKETS
    while size * max(1, n_languages) * 4 > MODEL_BYTES:
        size //= 2
    if size < 1024:
        raise ValueError("too many languages for a model that can be sent to all executors")
    return size


def gram_counts(labelled: DataFrame, size: int) -> DataFrame:
    """``lang, bucket, n``: n-grams of all rows with a text and a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        words: dict[str, Counter] = {}
        bucket = _Buckets(size)

        def settle(lang: str) -> None:
            into = totals.setdefault(lang, np.zeros(size, dtype=np.int64))
            held = words.pop(lang)
            said, counts = list(held), np.fromiter(held.values(), np.int64, len(held))
            for at in range(0, len(said), WORDS):
                places, sizes = bucket.of_words(said[at : at + WORDS])
                np.add.at(into, places, np.repeat(counts[at : at + WORDS], sizes))

        for batch in batches:
            for lang, text in zip(*(batch.column(k).to_pylist() for k in ("lang", "text"))):
                held = words.setdefault(lang, Counter())
                held.update(pieces(text))
                if len(held) > GATHER:
                    settle(lang)
        for lang in list(words):
            settle(lang)
        for lang, into in totals.items():
            at = np.flatnonzero(into)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(into[at])], ["lang", "bucket", "n"]
            )

    rows = labelled.where("lang is not null and text is not null").select("lang", "text")
    return rows.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Log probabilities of n-gram buckets for each language, and inference with them."""

    def __init__(self, languages: list[str], log_p: np.ndarray) -> None:
        self.__setstate__((languages, log_p))

    def __getstate__(self) -> tuple:
        return self.languages, self.log_p

    def __setstate__(self, state: tuple) -> None:
        self.languages, self.log_p = state
        self.bucket = _Buckets(len(self.log_p))
        self.forget(0)

    def forget(self, room: int) -> None:
        """Start afresh with the words that a worker remembers, with place for so many rows."""
        self.known: dict[str, int] = {}
        self.rows = np.empty((room, len(self.languages)), dtype=np.float32)

    def learn(self, words: Iterable[str]) -> None:
        """Remember the scaled log-likelihood of words under each language, a row for each."""
        every = dict.fromkeys(words)
        new = [w for w in every if w not in self.known]
        if len(self.known) + len(new) > MEMORY:
            self.forget(0)
            new = list(every)
        for at in range(0, len(new), WORDS):
            some = new[at : at + WORDS]
            places, sizes = self.bucket.of_words(some)
            sums = np.add.reduceat(self.log_p[places], np.cumsum(sizes) - sizes, axis=0)
            first = len(self.known)
            if first + len(some) > len(self.rows):
                room = np.empty((first // 2 + 2 * len(some), sums.shape[1]), np.float32)
                self.rows = np.vstack([self.rows[:first], room])
            self.rows[first : first + len(some)] = SHARPNESS * sums / sizes[:, None]
            self.known.update(zip(some, range(first, first + len(some))))

    def infer(self, text: str | None) -> tuple[str, float, list[float]]:
        return self.infer_all([text])[0]

    def infer_all(self, texts: list[str | None]) -> list[tuple[str, float, list[float]]]:
        """The main language of each text, its share, and all shares in order of the languages."""
        bags = [Counter(pieces(t) if self.languages else ()) for t in texts]
        self.learn(chain.from_iterable(bags))
        return [self.judged(bag) for bag in bags]

    def judged(self, counts: Counter) -> tuple[str, float, list[float]]:
        if not counts:
            return UNKNOWN, 0.0, [0.0] * len(self.languages)
        rows = np.fromiter(map(self.known.__getitem__, counts), np.int64, len(counts))
        logs = self.rows[rows].astype(np.float64)
        weights = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
        top = logs.max(axis=1)
        likelihood = np.exp(logs - top[:, None])
        shares = choose(likelihood, weights)
        best = int(np.argmax(shares))
        return self.languages[best], float(min(1.0, shares[best])), shares.tolist()


def mixture(likelihood: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the given languages by expectation-maximisation, and the log-likelihood."""
    share = np.full(likelihood.shape[1], 1.0 / likelihood.shape[1])
    total = weights.sum()
    for _ in range(ROUNDS):
        joint = likelihood * share
        share = (weights / joint.sum(axis=1)) @ joint / total
    return share, float(weights @ np.log(likelihood @ share))


def choose(likelihood: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Grow the set of languages while the penalised likelihood grows; shares of all languages."""
    likelihood = np.maximum(likelihood, 1e-12)
    shares = np.zeros(likelihood.shape[1])
    alone = weights @ np.log(likelihood)
    chosen = [int(np.argmax(alone))]
    share, fit = np.ones(1), float(alone[chosen[0]])
    total = weights.sum()
    penalty = 0.5 * np.log(total + 1.0)
    while len(chosen) < likelihood.shape[1]:
        now = likelihood[:, chosen] @ share
        # The likelihood is concave in the shares: what does not rise at a share of 0 has its best share there.
        rises = np.ones(len(shares), dtype=bool)
        if len(chosen) == 1:
            rises = weights @ (likelihood / now[:, None]) > total
            rises[chosen] = False
        if not rises.any():
            break
        # The language that explains best what the chosen ones explain badly.
        gain = weights @ np.maximum(np.log(likelihood / now[:, None]), 0.0)
        gain[chosen] = -np.inf
        trial = [*chosen, int(np.argmax(gain))]
        if not rises[trial[-1]]:
            break
        new_share, new_fit = mixture(likelihood[:, trial], weights)
        if new_fit - fit <= penalty:
            break
        chosen, share, fit = trial, new_share, new_fit
    shares[chosen] = share
    return shares


def train(labelled: DataFrame) -> Model:
    """A model of all given rows; the driver gets one number for each language and bucket."""
    languages = sorted(r[0] for r in labelled.where("lang is not null").select("lang").distinct().collect())
    size = bucket_count(len(languages))
    counts = np.zeros((size, len(languages)), dtype=np.float64)
    place = {lang: i for i, lang in enumerate(languages)}
    if languages:
        got = gram_counts(labelled, size).toArrow()
        at = [place[x] for x in got["lang"].to_pylist()]
        np.add.at(counts, (got["bucket"].to_numpy(), at), got["n"].to_numpy())
    smooth = counts + 0.5
    return Model(languages, np.log(smooth / smooth.sum(axis=0)).astype(np.float32))


def identify(df: DataFrame, model: Model, text: Column) -> Column:
    """A struct ``lang, score, shares`` for each text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, shares array<double>")
    def inferred(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.tolist()
            found = [x for at, end in portions(texts, TEXTS, CHARS) for x in shared.value.infer_all(texts[at:end])]
            yield pd.DataFrame(found, columns=["lang", "score", "shares"])
        # Workers live on and serve other steps.
        shared.value.forget(0)

    return inferred(text)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: the checksum of its id leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row, learned from the rows that are not held out."""
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), identify(docs, model, F.col("text")).alias("found")
    ).select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows whose main language holds at least ``least`` of the text; columns stay as they are."""
    model = train(docs.where(~held_out(F.col("doc_id"))))
    name = unused(docs, "_identified")
    found = docs.withColumn(name, identify(docs, model, F.col("text")))
    return found.where((F.col(name)["lang"] != UNKNOWN) & (F.col(name)["score"] >= least)).drop(name)
