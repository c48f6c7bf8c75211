"""Column-wise views of alignments: symbols, histograms, profiles, slices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.functions.stats import column_pvalue
from cladewise.plans.sizing import Groups, broadcast_if_small, pin_groups
from cladewise.schema import GAP

DEFAULT_MAX_GAP_RATIO = 0.5

#: Symbols of a gene that are counted together in memory, and of one piece of a sequence.
_PORTION = 1 << 21
_PIECE = 1 << 18


def cells(records: DataFrame) -> DataFrame:
    """Transpose: one row per symbol, extra record columns carried along.

    Joins that drop or enrich whole records belong before this call, where
    they handle one row per sequence instead of one per symbol.
    """
    carried = [c for c in records.columns if c != "seq"]
    return records.select(
        *carried, F.posexplode(F.split("seq", "")).alias("pos", "symbol")
    ).where(F.col("symbol") != "")


def assemble_records(sparse_cells: DataFrame) -> DataFrame:
    """Records from loose ``(gene, species, pos, symbol)`` rows; unnamed cells become gaps.

    Records end at their last named cell, so use the result as ragged.
    """
    by_pos = F.map_from_entries(F.collect_list(F.struct("pos", "symbol")))
    return (
        sparse_cells.groupBy("gene", "species", "pos")
        .agg(F.max("symbol").alias("symbol"))
        .groupBy("gene", "species")
        .agg(by_pos.alias("m"), F.max("pos").alias("last"))
        .select(
            "gene",
            "species",
            F.array_join(
                F.transform(
                    F.sequence(F.lit(0), F.col("last")),
                    lambda p: F.coalesce(F.element_at("m", p), F.lit(GAP)),
                ),
                "",
            ).alias("seq"),
        )
    )


def last_record_wins(records: DataFrame, order: str) -> DataFrame:
    """One record per (gene, species): the last in ``order``, which is dropped."""
    return records.groupBy("gene", "species").agg(F.max_by("seq", order).alias("seq"))


def gene_species(records: DataFrame) -> DataFrame:
    return records.select("gene", "species").distinct()


def species_counts(records: DataFrame) -> DataFrame:
    """Species per gene; a species has one record per gene."""
    return records.groupBy("gene").agg(F.count("*").alias("n_species"))


def symbol_histogram(records: DataFrame) -> DataFrame:
    """Species per non-gap symbol of every column."""
    return (
        cells(records.select("gene", "seq"))
        .where(F.col("symbol") != GAP)
        .groupBy("gene", "pos", "symbol")
        .agg(F.count("*").alias("n"))
    )


def _counted(pieces: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position, code point and count of the symbols of pieces of sequences, each with the place it begins at."""
    codes = np.frombuffer("".join(p for _, p in pieces).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([len(p) for _, p in pieces])
    pos = np.arange(len(codes)) + np.repeat(np.array([at for at, _ in pieces]) - (np.cumsum(sizes) - sizes), sizes)
    number = np.zeros(int(codes.max()) + 1, dtype=np.int64)
    number[codes] = 1
    symbols = np.flatnonzero(number)
    number[symbols] = np.arange(len(symbols))
    least = int(pos.min())
    cell = (pos - least) * len(symbols) + number[codes]
    if int(cell.max()) < 4 * len(cell):
        n = np.bincount(cell)
        found = np.flatnonzero(n)
        n = n[found]
    else:
        found, n = np.unique(cell, return_counts=True)
    return least + found // len(symbols), symbols[found % len(symbols)], n


def symbol_counts(records: DataFrame) -> DataFrame:
    """``gene, pos, symbol, n`` of long sequences: counted in numpy within the tasks, so that no symbol becomes a row."""

    def rows(gene: str | None, pieces: list[tuple[int, str]]) -> pa.RecordBatch:
        pos, code, n = _counted(pieces)
        symbols, which = np.unique(code, return_inverse=True)
        symbol = pa.array([chr(c) for c in symbols.tolist()], pa.string()).take(pa.array(which))
        columns = [pa.array([gene], pa.string()).take(pa.array(np.zeros(len(n), dtype=np.int64))), pa.array(pos, pa.int32()), symbol, pa.array(n, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["gene", "pos", "symbol", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            waiting: dict[str | None, list[tuple[int, str]]] = {}
            held: dict[str | None, int] = {}
            for gene, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for at in range(0, len(seq or ""), _PIECE):
                    piece = seq[at : at + _PIECE]
                    waiting.setdefault(gene, []).append((at, piece))
                    held[gene] = held.get(gene, 0) + len(piece)
                    if held[gene] >= _PORTION:
                        yield rows(gene, waiting.pop(gene))
                        del held[gene]
            for gene, pieces in waiting.items():
                yield rows(gene, pieces)

    found = records.select("gene", "seq").mapInArrow(run, "gene string, pos int, symbol string, n long")
    return found.groupBy("gene", "pos", "symbol").agg(F.sum("n").alias("n"))


def profile_aggregates(n: str = "n") -> list[Column]:
    """Column profile over the (symbol, count) rows of a column."""
    solid = F.col("symbol") != GAP
    return [
        F.sum(n).alias("listed"),
        F.coalesce(F.sum(F.when(solid, F.col(n))), F.lit(0)).alias("nongap"),
        F.count_if(solid & (F.col(n) > 0)).alias("n_symbols"),
        F.coalesce(F.max(F.when(solid, F.col(n))), F.lit(0)).alias("top"),
    ]


def finish_profile(
    columns: DataFrame, records: DataFrame, ragged: bool = False
) -> DataFrame:
    """Adds ``total``, ``gaps`` and ``minority`` to columns that carry the profile aggregates.

    Ragged records end early without gap symbols, so their column height is
    the gene's number of records; otherwise every column lists all records.
    """
    if ragged:
        heights = broadcast_if_small(species_counts(records), row_bytes=64)
        columns = columns.join(heights, "gene").withColumnRenamed("n_species", "total")
    else:
        columns = columns.withColumn("total", F.col("listed"))
    return (
        columns.withColumn("gaps", F.col("total") - F.col("nongap"))
        .withColumn("minority", F.col("nongap") - F.col("top"))
        .drop("listed")
    )


def column_profile(records: DataFrame, ragged: bool = False) -> DataFrame:
    """Total, gaps, non-gap and distinct symbols, top and minority counts per column.

    Ragged records are taken to be long, whole texts as a rule, and counted in the tasks.
    """
    if ragged:
        symbols = symbol_counts(records)
    else:
        symbols = (
            cells(records.select("gene", "seq"))
            .groupBy("gene", "pos", "symbol")
            .agg(F.count("*").alias("n"))
        )
    profile = symbols.groupBy("gene", "pos").agg(*profile_aggregates())
    return finish_profile(profile, records, ragged).select(
        "gene", "pos", "total", "gaps", "nongap", "n_symbols", "top", "minority"
    )


def kept_column(threshold: int, max_gap_ratio: float = DEFAULT_MAX_GAP_RATIO) -> Column:
    """Column filter over a profile: not too gappy and enough minority symbols."""
    ratio = F.col("gaps") / F.col("total")
    return (ratio <= F.lit(float(max_gap_ratio))) & (F.col("minority") >= F.lit(threshold))


def slice_columns(
    records: DataFrame,
    threshold: int,
    max_gap_ratio: float = DEFAULT_MAX_GAP_RATIO,
    ragged: bool = False,
) -> DataFrame:
    """The profile rows of the columns worth testing."""
    return column_profile(records, ragged).where(kept_column(threshold, max_gap_ratio))


def column_pvalues(
    records: DataFrame,
    n_fg: int,
    n_bg: int,
    max_gap_ratio: float = DEFAULT_MAX_GAP_RATIO,
    ragged: bool = False,
) -> DataFrame:
    """P-value of every column worth testing, for fixed group sizes; the smaller one is the minority threshold."""
    symbols = (
        cells(records.select("gene", "seq"))
        .groupBy("gene", "pos", "symbol")
        .agg(F.count("*").alias("n"))
    )
    # One number for each symbol of the alphabet.
    counts = F.sort_array(F.collect_list(F.when(F.col("symbol") != GAP, F.col("n"))))
    columns = symbols.groupBy("gene", "pos").agg(*profile_aggregates(), counts.alias("counts"))
    return (
        finish_profile(columns, records, ragged)
        .where(kept_column(min(n_fg, n_bg), max_gap_ratio))
        .select(
            "gene",
            "pos",
            column_pvalue(F.col("counts"), F.lit(n_fg), F.lit(n_bg)).alias("pvalue"),
        )
    )


def symbol_species(records: DataFrame) -> DataFrame:
    """Species showing each symbol of each column, gaps included; one row per symbol at every height."""
    return (
        cells(records)
        .groupBy("gene", "pos", "symbol")
        .agg(F.sort_array(F.collect_set("species")).alias("species"))
    )


def symbol_traits(records: DataFrame, groups: DataFrame | Groups) -> DataFrame:
    """Trait groups with a member showing each symbol of each column, gaps included."""
    groups = pin_groups(groups)
    members = records.join(groups.near(groups.rows), "species").drop("species")
    return cells(members).select("gene", "pos", "symbol", "trait", "grp").distinct()
