"""Size checks behind every broadcast, and pinned group tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewise.session import ensure_checkpoint_dir

BROADCAST_BYTES = 128 * 1024 * 1024

#: Rows that one task sorts or groups where their number is known. A dozen sorts of one stage hold
#: them at once, so parts are small; a table of some hundred thousand rows has several already.
PART_ROWS = 25_000

#: The same where no step holds more than a sort or two. Two shuffles in a row exchange parts times parts
#: pieces, so where rows are many parts must not be small.
LARGE_PART_ROWS = 250_000

# Widest row derived from one group row: a species with all words of a trait set.
_GROUP_ROW_BYTES = 400


def fits(df: DataFrame, row_bytes: int, budget: int = BROADCAST_BYTES) -> bool:
    """Whether the counted rows stay within the budget.

    A plain count is combined in the map tasks; a limit would send rows of
    every partition to one task.
    """
    return df.count() * row_bytes <= budget


def broadcast_if_small(
    df: DataFrame, row_bytes: int = 64, budget: int = BROADCAST_BYTES
) -> DataFrame:
    """Hint a broadcast only where the counted size allows it.

    Beyond the budget the frame comes back unhinted and Spark shuffles both
    sides, splitting skewed partitions at run time.
    """
    return F.broadcast(df) if fits(df, row_bytes, budget) else df


def spread_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Deal a small input out to all cores before its rows are expanded.

    Applies only below one file split per core, where few row groups would
    leave cores idle; larger inputs keep the partitioning of their files.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if fits(df, row_bytes, cores * BROADCAST_BYTES):
        return df.repartition(cores)
    return df


def n_parts(df: DataFrame, rows: int, part_rows: int | None = None) -> int:
    """Parts of at most ``part_rows`` (``PART_ROWS``) of the counted rows, and as many as the session's shuffles have."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-rows // (part_rows or PART_ROWS)))


def spread_by(df: DataFrame, rows: int, *keys: str, part_rows: int | None = None) -> DataFrame:
    """Shuffle by the keys into parts that grow in number and not in size with the counted rows.

    Grouping and windows over these keys, or over them and further columns, then need no
    other shuffle, and their sorts stay small whatever the session's number of partitions.
    """
    return df.repartition(n_parts(df, rows, part_rows), *keys)


def pin(df: DataFrame) -> DataFrame:
    """Write a frame that several branches read to the checkpoint folder once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write a frame that several jobs read as a Parquet table to the checkpoint folder; it is computed once."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Groups:
    """A pinned ``(trait, species, grp)`` table with its counted size."""

    rows: DataFrame
    n_rows: int
    n_traits: int

    @property
    def small(self) -> bool:
        return self.n_rows * _GROUP_ROW_BYTES <= BROADCAST_BYTES

    def near(self, derived: DataFrame) -> DataFrame:
        """Broadcast a frame with at most one row per group row, if the groups are small."""
        return F.broadcast(derived) if self.small else derived


def pin_groups(groups: DataFrame | Groups) -> Groups:
    """Groups are read by many branches of a plan: compute and count them once."""
    if isinstance(groups, Groups):
        return groups
    rows = pin(groups.select("trait", "species", "grp").distinct())
    sizes = rows.agg(F.count("*").alias("n"), F.count_distinct("trait").alias("t")).first()
    return Groups(rows, sizes["n"], sizes["t"])
