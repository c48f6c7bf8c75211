"""The queries of this package over the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise import adapters as A
from cladewise import file_queries as FQ
from cladewise.functions.bounds import Bounds
from cladewise.functions.text import pair_key, substitution
from cladewise.functions.verdict import pattern_admitted
from cladewise.operators import columns as C
from cladewise.operators import evidence as E
from cladewise.operators import sampling as S
from cladewise.operators import tree as T
from cladewise.plans.bootstrap import bootstrap, template_threshold
from cladewise.plans.discovery import batch_summary, discovery
from cladewise.plans.excess import excess
from cladewise.plans.sizing import LARGE_PART_ROWS, pin_groups

Query = Callable[[SparkSession, str], DataFrame]

SLICE_THRESHOLD = 20
BOOTSTRAP_CYCLES = 1000
RESAMPLE_CYCLES = 200
SEED = 7
DIGITS = 9


def _joined(names: Column) -> Column:
    return F.array_join(F.sort_array(names), ",")


def _rounded(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.round(column, DIGITS))


def position_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return C.cells(A.line_records(spark, sf)).select("gene", "species", "pos", "symbol")


def gene_species(spark: SparkSession, sf: str) -> DataFrame:
    return C.gene_species(A.line_records(spark, sf))


def symbol_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return C.symbol_histogram(A.line_records(spark, sf))


def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    return C.column_profile(A.line_records(spark, sf))


def slice_positions(spark: SparkSession, sf: str) -> DataFrame:
    return C.slice_columns(A.line_records(spark, sf), SLICE_THRESHOLD).select(
        "gene", "pos", "gaps", "minority"
    )


def symbol_species(spark: SparkSession, sf: str) -> DataFrame:
    return C.symbol_species(A.line_records(spark, sf)).withColumn("species", _joined(F.col("species")))


def symbol_traits(spark: SparkSession, sf: str) -> DataFrame:
    return C.symbol_traits(A.line_records(spark, sf), A.nation_groups(spark, sf))


def group_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return E.group_sizes(A.label_groups(spark, sf))


def missing_species(spark: SparkSession, sf: str) -> DataFrame:
    return E.missing_members(A.line_records(spark, sf), A.nation_groups(spark, sf)).withColumn(
        "missing", _joined(F.col("missing"))
    )


def group_evidence(spark: SparkSession, sf: str) -> DataFrame:
    evidence = E.group_evidence(A.line_records(spark, sf), A.nation_groups(spark, sf))
    return evidence.select(
        "gene", "pos", "trait",
        _joined(F.col("fg_symbols")).alias("fg_symbols"),
        _joined(F.col("bg_symbols")).alias("bg_symbols"),
        "ffgn", "fbgn", "gfg", "gbg",
    )


def verdict(spark: SparkSession, sf: str) -> DataFrame:
    judged = E.with_verdict(E.group_evidence(A.line_records(spark, sf), A.nation_groups(spark, sf)))
    return judged.select(
        "gene", "pos", "trait",
        substitution(F.col("fg_symbols"), F.col("bg_symbols")).alias("tag"),
        "is_hit", "pattern",
        (F.col("is_hit") & pattern_admitted(F.col("pattern"), "1,2,3")).alias("admitted"),
    )


def position_pvalue(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(C.column_pvalues(A.line_records(spark, sf), 4, 3), "pvalue")


def position_pvalue_even(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(C.column_pvalues(A.line_records(spark, sf), 3, 3), "pvalue")


def discovery_single(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(discovery(A.line_records(spark, sf, spread=True), A.size_groups(spark, sf)), "Pvalue")


def batch_discovery(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(discovery(A.line_records(spark, sf, spread=True), A.nation_groups(spark, sf)), "Pvalue")


def bounded_discovery(spark: SparkSession, sf: str) -> DataFrame:
    bounds = Bounds(max_fg_gaps=2, max_bg_gaps=1, max_gaps=2, max_fg_miss=1, max_bg_miss=0, max_miss=1)
    hits = discovery(A.line_records(spark, sf, spread=True), A.nation_groups(spark, sf), bounds, "1,2,3,4", 0.45)
    return _rounded(hits, "Pvalue")


def batch_hits_per_job(spark: SparkSession, sf: str) -> DataFrame:
    records, groups = A.line_records(spark, sf, spread=True), pin_groups(A.nation_groups(spark, sf))
    return batch_summary(records, groups, discovery(records, groups))


def document_profile(spark: SparkSession, sf: str) -> DataFrame:
    return C.column_profile(A.document_records(spark, sf), ragged=True)


def document_discovery(spark: SparkSession, sf: str) -> DataFrame:
    hits = discovery(A.document_records(spark, sf), A.label_groups(spark, sf), ragged=True)
    return _rounded(hits, "Pvalue")


def _random_groups(spark: SparkSession, sf: str) -> DataFrame:
    customers = A.table(spark, sf, "customer").select(F.col("c_name").alias("species"))
    return S.resample_random(customers, 5, 4, RESAMPLE_CYCLES, SEED)


def resample_random(spark: SparkSession, sf: str) -> DataFrame:
    return S.cycle_text(S.cycle_lists(_random_groups(spark, sf)))


def resample_family(spark: SparkSession, sf: str) -> DataFrame:
    groups = S.resample_family(
        A.customer_families(spark, sf), A.balance_template(spark, sf), RESAMPLE_CYCLES, SEED
    )
    return S.cycle_text(S.cycle_lists(groups))


def _selected(strategy: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        groups = S.select_by_value(
            A.permuted_values(spark, sf),
            A.species_values(spark, sf),
            A.size_groups(spark, sf),
            strategy,
            SEED,
            allow_short=True,  # some cycles of these tables have fewer candidates than the template
        )
        return S.cycle_text(S.cycle_lists(groups))

    return query


def cycles_to_configs(spark: SparkSession, sf: str) -> DataFrame:
    cycles = S.cycle_lists(_random_groups(spark, sf))
    return S.first_cycles(S.cycles_to_groups(cycles), 10)


def _species_cycles(spark: SparkSession, sf: str) -> DataFrame:
    return S.resample_random(A.part_species(spark, sf), 4, 3, BOOTSTRAP_CYCLES, SEED)


def bootstrap_default(spark: SparkSession, sf: str) -> DataFrame:
    bounds = Bounds()
    threshold = template_threshold(A.size_groups(spark, sf), bounds)
    rows = bootstrap(
        A.line_records(spark, sf, spread=True), _species_cycles(spark, sf), BOOTSTRAP_CYCLES, threshold, bounds,
        trait_config="size",
    )
    return _rounded(rows, "empval")


def bootstrap_bounded(spark: SparkSession, sf: str) -> DataFrame:
    bounds = Bounds(max_fg_gaps=1, max_bg_gaps=1, max_miss=0)
    threshold = template_threshold(A.size_groups(spark, sf), bounds)
    rows = bootstrap(
        A.line_records(spark, sf, spread=True), _species_cycles(spark, sf), BOOTSTRAP_CYCLES, threshold, bounds,
        "1,2", trait_config="size",
    )
    return _rounded(rows, "empval")


def excess_test(spark: SparkSession, sf: str) -> DataFrame:
    """One trait by size and one for each nation against the cycles."""
    observed = A.size_groups(spark, sf).unionByName(A.nation_groups(spark, sf))
    threshold = template_threshold(A.size_groups(spark, sf), Bounds())
    rows = excess(A.line_records(spark, sf, spread=True), observed, _species_cycles(spark, sf), BOOTSTRAP_CYCLES, threshold)
    return _rounded(rows, "pvalue")


def excess_bounded(spark: SparkSession, sf: str) -> DataFrame:
    bounds = Bounds(max_bg_gaps=1, max_gaps=2, max_fg_miss=0, max_miss=1)
    rows = excess(
        A.line_records(spark, sf, spread=True), A.nation_groups(spark, sf), _species_cycles(spark, sf), BOOTSTRAP_CYCLES, 2, bounds, "1,3"
    )
    return _rounded(rows, "pvalue")


def bootstrap_files(spark: SparkSession, sf: str) -> DataFrame:
    return FQ.bootstrap_files(bootstrap_default(spark, sf))


def discovery_files(spark: SparkSession, sf: str) -> DataFrame:
    return FQ.discovery_files(batch_discovery(spark, sf))


def job_folders(spark: SparkSession, sf: str) -> DataFrame:
    return FQ.job_folders(batch_discovery(spark, sf))


def newick_edges(spark: SparkSession, sf: str) -> DataFrame:
    edges = T.tree_edges(A.order_trees(spark, sf))
    return edges.select("tree", "label", "parent_label", "length", "is_tip")


def tree_tips(spark: SparkSession, sf: str) -> DataFrame:
    return T.tree_tips(A.order_trees(spark, sf))


def farthest_tip(spark: SparkSession, sf: str) -> DataFrame:
    return T.farthest_tip(A.order_trees(spark, sf, LARGE_PART_ROWS))


def distances_from_farthest(spark: SparkSession, sf: str) -> DataFrame:
    return T.distances_from_farthest(A.order_trees(spark, sf, LARGE_PART_ROWS))


def sorted_from_farthest(spark: SparkSession, sf: str) -> DataFrame:
    return T.sorted_from_farthest(A.order_trees(spark, sf, LARGE_PART_ROWS))


def patristic_distance(spark: SparkSession, sf: str) -> DataFrame:
    pairs = T.pair_distances(
        A.order_trees(spark, sf, LARGE_PART_ROWS), A.neighbour_pairs(spark, sf, LARGE_PART_ROWS)
    )
    return pairs.select("tree", pair_key(F.col("a"), F.col("b")).alias("pair"), "d")


QUERIES: dict[str, Query] = {
    "position_symbols": position_symbols,
    "gene_species": gene_species,
    "symbol_histogram": symbol_histogram,
    "column_profile": column_profile,
    "slice_positions": slice_positions,
    "symbol_species": symbol_species,
    "symbol_traits": symbol_traits,
    "group_sizes": group_sizes,
    "missing_species": missing_species,
    "group_evidence": group_evidence,
    "verdict": verdict,
    "position_pvalue": position_pvalue,
    "position_pvalue_even": position_pvalue_even,
    "discovery": discovery_single,
    "batch_discovery": batch_discovery,
    "bounded_discovery": bounded_discovery,
    "batch_hits_per_job": batch_hits_per_job,
    "document_profile": document_profile,
    "document_discovery": document_discovery,
    "resample_random": resample_random,
    "resample_family": resample_family,
    "select_inner": _selected("inner"),
    "select_edges": _selected("edges"),
    "select_random": _selected("random"),
    "cycles_to_configs": cycles_to_configs,
    "bootstrap": bootstrap_default,
    "bootstrap_bounded": bootstrap_bounded,
    "excess": excess_test,
    "excess_bounded": excess_bounded,
    "newick_edges": newick_edges,
    "tree_tips": tree_tips,
    "farthest_tip": farthest_tip,
    "distances_from_farthest": distances_from_farthest,
    "sorted_from_farthest": sorted_from_farthest,
    "patristic_distance": patristic_distance,
    "bootstrap_files": bootstrap_files,
    "discovery_files": discovery_files,
    "job_folders": job_folders,
    **FQ.QUERIES,
}
