"""Hit verdict and pattern class from the symbols of two groups."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ALL_PATTERNS = (1, 2, 3, 4)
DEFAULT_PATTERNS = (1, 2, 3)


def pattern_class(n_fg_symbols: Column, n_bg_symbols: Column) -> Column:
    """1 both groups on one symbol, 2 only the foreground, 3 only the background, 4 neither.

    Null where a group has no symbol at all.
    """
    base = (
        F.lit(1)
        + (n_bg_symbols > 1).cast("int")
        + F.lit(2) * (n_fg_symbols > 1).cast("int")
    )
    return F.when((n_fg_symbols > 0) & (n_bg_symbols > 0), base)


def is_hit(n_fg_symbols: Column, n_bg_symbols: Column, n_shared: Column) -> Column:
    """Both groups show a symbol and none is shared."""
    return (n_fg_symbols > 0) & (n_bg_symbols > 0) & (n_shared == 0)


def parse_patterns(patterns: str | Iterable[int]) -> tuple[int, ...]:
    """Accepts ``"1,2,3"`` or numbers; every token must name a pattern."""
    if isinstance(patterns, str):
        patterns = [int(token) for token in patterns.split(",") if token.strip()]
    chosen = tuple(sorted(set(patterns)))
    unknown = [p for p in chosen if p not in ALL_PATTERNS]
    if unknown or not chosen:
        raise ValueError(f"patterns must be taken from {ALL_PATTERNS}, got {patterns!r}")
    return chosen


def pattern_admitted(pattern: Column, patterns: str | Iterable[int]) -> Column:
    return pattern.isin(*parse_patterns(patterns))
