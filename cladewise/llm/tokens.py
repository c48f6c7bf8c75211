"""Token counts by the whole-token shortcut.

Byte-level BPE cuts a text into pre-tokens and merges the bytes of each on its
own. A pre-token that is itself a vocabulary entry and provably encodes to that
one entry needs no merging. ``prove_whole`` finds these entries once, on the
driver; the tasks count them directly and leave only the rest to the library.

Two further exact steps save the pattern search. A pre-token holds a space at
its start only, so a text may be cut before every single space and each unit
looked up on its own; and what a unit costs is remembered in each worker.
``Units.regular`` says where the cut could change a run of white space; such
texts go through the pattern as a whole.

Null and empty texts have no token. Repeated rows are counted each; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Entries that a worker remembers before it starts afresh.
MEMORY = 700_000
#: Longer units are not remembered.
MEMORY_CHARS = 64


@lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def _ranges(codes: list[int]) -> str:
    """Code points in ascending order as the inside of a character class."""
    out, start = [], None
    for i, code in enumerate(codes):
        if start is None:
            start = code
        if i + 1 == len(codes) or codes[i + 1] != code + 1:
            out.append(f"\\u{start:04x}-\\u{code:04x}")
            start = None
    return "".join(out)


@lru_cache(maxsize=4)
def pre_token_pattern(path: str) -> re.Pattern:
    """The library's pre-tokens for texts below U+10000, with classes asked from the library itself.

    Letters come first: no other alternative starts with a letter, or with a
    space and a letter, so the order changes nothing but the time.
    """
    cut = load(path).pre_tokenizer.pre_tokenize_str

    def joins(before: str, char: str) -> bool:
        return len(cut(before + char)) == 1

    kinds: dict[str, list[int]] = {"letter": [], "number": [], "other": [], "space": []}
    for code in range(0x10000):
        if 0xD800 <= code < 0xE000:
            continue
        char = chr(code)
        kind = "letter" if joins("a", char) else "number" if joins("1", char) else "other" if joins("!", char) else "space"
        kinds[kind].append(code)
    letter, number, space = (_ranges(kinds[k]) for k in ("letter", "number", "space"))
    return re.compile(
        f" ?[{letter}]+|'(?:[stmd]|re|ve|ll)| ?[{number}]+| ?[^{space}{letter}{number}]+"
        f"|[{space}]+(?![^{space}])|[{space}]+"
    )


def prove_whole(path: str) -> frozenset[str]:
    """Vocabulary strings that stand for themselves: one pre-token, encoded alone as exactly that entry.

    Every entry is tried, so this is a proof by cases and not a guess from the
    merge order. Entries that are parts of characters have no string and are
    left out, and so are special tokens, which are no ordinary text.
    """
    tok = load(path)
    special = {t.content for t in tok.get_added_tokens_decoder().values()}
    ids = [i for i in range(tok.get_vocab_size(with_added_tokens=False))]
    texts = tok.decode_batch([[i] for i in ids], skip_special_tokens=False)
    pairs = [(i, t) for i, t in zip(ids, texts) if t and "�" not in t and t not in special]
    coded = tok.encode_batch_fast([t for _, t in pairs], add_special_tokens=False)
    pattern = pre_token_pattern(path)
    return frozenset(t for (i, t), e in zip(pairs, coded) if e.ids == [i] and pattern.findall(t) == [t])


class Units(dict):
    """Values of units (a space and what follows up to the next), computed when first met.

    ``value`` turns the text of one unit into what is summed or joined.
    """

    def __init__(self, value: Callable[[str], object]) -> None:
        super().__init__()
        self.value = value

    def __missing__(self, piece: str) -> object:
        found = self.value(" " + piece)
        if len(piece) <= MEMORY_CHARS:
            if len(self) >= MEMORY:
                self.clear()
            self[piece] = found
        return found

    @staticmethod
    def regular(text: str) -> bool:
        """Whether cutting before each space leaves all runs of white space as they are.

        A run is torn only where white space, a space and again white space (or
        the end) follow each other.
        """
        return "  " not in text and not text.endswith(" ") and not _TORN.search(text)

    def of(self, text: str) -> Iterator[object]:
        """The values along a text that holds no special token."""
        if not text:
            return
        if not self.regular(text):
            yield self.value(text)
            return
        first, _, rest = text.partition(" ")
        if first:
            yield self.value(first)
        if rest or len(first) < len(text):
            yield from map(self.__getitem__, rest.split(" "))


_TORN = re.compile(r"[^\S ] [^\S ]")
_ASTRAL = re.compile("[\U00010000-\U0010ffff\ud800-\udfff]")


def special_tokens(path: str) -> dict[str, int]:
    return {t.content: i for i, t in load(path).get_added_tokens_decoder().items()}


def special_pattern(path: str) -> re.Pattern:
    """Cuts a text at the special tokens, which then stand at the odd places."""
    names = sorted(special_tokens(path), key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else re.compile("((?!))")


@lru_cache(maxsize=1)
def _byte_chars() -> dict[int, str]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves and the rest as characters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class PreTokens(dict):
    """Ids of pre-tokens, merged by the library's model when first met; ``value`` turns them into what is kept."""

    def __init__(self, path: str, value: Callable[[list[int]], object]) -> None:
        super().__init__()
        self.merge, self.value, self.chars = load(path).model.tokenize, value, _byte_chars()

    def __missing__(self, pre_token: str) -> object:
        mapped = pre_token.encode().decode("latin-1").translate(self.chars)
        found = self.value([t.id for t in self.merge(mapped)])
        if len(pre_token) <= MEMORY_CHARS:
            if len(self) >= MEMORY:
                self.clear()
            self[pre_token] = found
        return found


class Counter:
    """Counts the tokens of texts in one worker."""

    def __init__(self, path: str, whole: frozenset[str]) -> None:
        self.path, self.whole = path, whole
        self.cut = pre_token_pattern(path).findall
        self.special = special_pattern(path)
        self.merged = PreTokens(path, len)
        self.units = Units(self._unit)

    def _unit(self, text: str) -> int:
        if _ASTRAL.search(text):
            return len(load(self.path).encode(text, add_special_tokens=False).ids)
        whole, merged = self.whole, self.merged
        return sum(1 if t in whole else merged[t] for t in self.cut(text))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.special.split(text)
        return len(parts) // 2 + sum(sum(self.units.of(part)) for part in parts[::2])


_COUNTERS: dict[str, Counter] = {}


def counter(path: str, whole: frozenset[str]) -> Counter:
    """The worker's counter, which keeps what it has met from task to task."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path, whole)
    return _COUNTERS[path]


def token_count(df: DataFrame, text: Column, path: str) -> Column:
    """The number of tokens of a text column, as the library gives it.

    ``path`` names a tokenizer file that every executor has. The proven entries
    travel as one broadcast, bounded by the vocabulary.
    """
    whole = df.sparkSession.sparkContext.broadcast(prove_whole(path))

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(path, whole.value).count
        for texts in batches:
            yield pd.Series([count(t) for t in texts], dtype="int64")

    return counted(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row."""
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return docs.select(
        "doc_id", n_bytes.alias("n_bytes"), token_count(docs, F.col("text"), path).alias("n_tokens")
    ).withColumn("over_limit", F.col("n_tokens") > limit)
