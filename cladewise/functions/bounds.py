"""Gap and missing-species bounds."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def within_bounds(
    n_fg: Column,
    n_bg: Column,
    max_fg: int | None = None,
    max_bg: int | None = None,
    max_all: int | None = None,
) -> Column:
    """True where no given bound is exceeded; bounds are inclusive, None means no bound."""
    checks = [
        value <= bound
        for value, bound in ((n_fg, max_fg), (n_bg, max_bg), (n_fg + n_bg, max_all))
        if bound is not None
    ]
    return reduce(lambda a, b: a & b, checks, F.lit(True))


@dataclass(frozen=True)
class Bounds:
    """Accepted gaps and missing species per group and overall.

    ``bg_bound="fg"`` compares the background with the foreground bound
    wherever a background bound is given, which some published tables did.
    """

    max_fg_gaps: int | None = None
    max_bg_gaps: int | None = None
    max_gaps: int | None = None
    max_fg_miss: int | None = None
    max_bg_miss: int | None = None
    max_miss: int | None = None
    bg_bound: str = "bg"

    def __post_init__(self) -> None:
        if self.bg_bound not in ("bg", "fg"):
            raise ValueError("bg_bound must be 'bg' or 'fg'")
        if self.bg_bound == "fg":
            for fg, bg in (
                (self.max_fg_gaps, self.max_bg_gaps),
                (self.max_fg_miss, self.max_bg_miss),
            ):
                if bg is not None and fg is None:
                    raise ValueError("bg_bound='fg' needs a foreground bound")

    @property
    def unlimited(self) -> bool:
        return all(
            v is None
            for v in (
                self.max_fg_gaps,
                self.max_bg_gaps,
                self.max_gaps,
                self.max_fg_miss,
                self.max_bg_miss,
                self.max_miss,
            )
        )

    def _background(self, fg: int | None, bg: int | None) -> int | None:
        return fg if self.bg_bound == "fg" and bg is not None else bg

    @property
    def background_gaps(self) -> int | None:
        return self._background(self.max_fg_gaps, self.max_bg_gaps)

    @property
    def background_miss(self) -> int | None:
        return self._background(self.max_fg_miss, self.max_bg_miss)

    def accepts(self, gfg: Column, gbg: Column, mfg: Column, mbg: Column) -> Column:
        gaps = within_bounds(
            gfg,
            gbg,
            self.max_fg_gaps,
            self.background_gaps,
            self.max_gaps,
        )
        missing = within_bounds(
            mfg,
            mbg,
            self.max_fg_miss,
            self.background_miss,
            self.max_miss,
        )
        return gaps & missing

    def threshold(self, n_fg: int, n_bg: int) -> int:
        """Fewest minority symbols a column needs before it can separate the groups.

        The overall bounds take no part; unset bounds count as zero.
        """
        spare_fg, spare_bg = self._spare()
        return min(n_fg - spare_fg, n_bg - spare_bg)

    def threshold_of(self, n_fg: Column, n_bg: Column) -> Column:
        """``threshold`` where the group sizes are columns."""
        spare_fg, spare_bg = self._spare()
        return F.least(n_fg - spare_fg, n_bg - spare_bg)

    def _spare(self) -> tuple[int, int]:
        return (
            (self.max_fg_gaps or 0) + (self.max_fg_miss or 0),
            (self.max_bg_gaps or 0) + (self.max_bg_miss or 0),
        )
