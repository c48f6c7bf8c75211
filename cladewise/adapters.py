"""Alignments, groups, families and trees derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladewise.plans.sizing import spread_by, spread_if_small
from cladewise.schema import GAP

N_SPECIES = 100
LINE_NUMBERS = range(1, 8)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def species_name(key: Column) -> Column:
    return F.concat(F.lit("sp"), F.lpad((key % N_SPECIES).cast("string"), 3, "0"))


def line_records(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Suppliers as genes, part classes as species, line numbers as columns.

    The symbol follows the quantity; quantities ending in 9 and unused line
    numbers are gaps. Codes are compared as numbers, so the seven columns of a
    record come from one hash aggregation. With ``spread``, records of a gene end
    up side by side, so what is counted by gene and column is not shuffled again.
    """
    lines = table(spark, sf_dir, "lineitem")
    quantity = F.floor("l_quantity")
    code = F.when(quantity % 10 == 9, F.lit(ord(GAP))).otherwise(F.lit(65) + quantity % 4)
    symbols = [
        F.coalesce(
            F.chr(F.max(F.when(F.col("l_linenumber") == n, code))), F.lit(GAP)
        )
        for n in LINE_NUMBERS
    ]
    beyond = F.raise_error(F.lit(f"a line number is greater than {LINE_NUMBERS[-1]}"))
    named = lines.withColumns(
        {
            "gene": F.concat(F.lit("g"), F.col("l_suppkey").cast("string")),
            "species": species_name(F.col("l_partkey")),
        }
    )
    records = named.groupBy("gene", "species").agg(
        F.when(F.max("l_linenumber") <= LINE_NUMBERS[-1], F.concat(*symbols)).otherwise(beyond).alias("seq")
    )
    return spread_by(records, lines.count(), "gene") if spread else records


def part_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(species_name(F.col("p_partkey")).alias("species")).distinct()


def size_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trait: the four species of greatest total part size against the three of least."""
    sizes = (
        table(spark, sf_dir, "part")
        .groupBy(species_name(F.col("p_partkey")).alias("species"))
        .agg(F.sum("p_size").alias("size"))
    )
    top = sizes.orderBy(F.desc("size"), "species").limit(4).withColumn("grp", F.lit(1))
    low = sizes.orderBy("size", "species").limit(3).withColumn("grp", F.lit(0))
    return top.unionByName(low).select(F.lit("size").alias("trait"), "species", "grp")


def nation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trait per nation: seven neighbouring species from a nation's offset, four against three."""
    nth = F.explode(F.sequence(F.lit(0), F.lit(6)))
    return (
        table(spark, sf_dir, "nation")
        .select("n_nationkey", nth.alias("nth"))
        .select(
            F.concat(F.lit("n"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("trait"),
            species_name(F.col("n_nationkey") * 4 + F.col("nth")).alias("species"),
            (F.col("nth") < 4).cast("int").alias("grp"),
        )
    )


def customer_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    nations = table(spark, sf_dir, "nation")
    return customers.join(nations, customers.c_nationkey == nations.n_nationkey).select(
        F.col("c_name").alias("species"), F.col("n_name").alias("family")
    )


def balance_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of very high against very low balance."""
    customers = table(spark, sf_dir, "customer").where("c_acctbal > 9500 or c_acctbal < -500")
    return customers.select(
        F.lit("balance").alias("trait"),
        F.col("c_name").alias("species"),
        (F.col("c_acctbal") > 0).cast("int").alias("grp"),
    )


def species_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value from 1 to 50 per species."""
    return (
        table(spark, sf_dir, "part")
        .groupBy(species_name(F.col("p_partkey")).alias("species"))
        .agg((F.sum("p_size") % 50 + 1).cast("double").alias("value"))
    )


def permuted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values from 1 to 50 per supplier and species; each supplier acts as a cycle."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.concat(F.lit("b_"), F.col("l_suppkey").cast("string")).alias("cycle"),
            species_name(F.col("l_partkey")).alias("species"),
        )
        .agg((F.sum("l_quantity") % 50 + 1).alias("value"))
    )


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as ragged sequences, sources as genes."""
    documents = spread_if_small(table(spark, sf_dir, "documents"), row_bytes=4096)
    return documents.select(
        F.col("source").alias("gene"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("species"),
        F.col("text").alias("seq"),
    )


def label_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two traits per source: good against bad quality, toxic against not toxic."""
    side = F.explode(
        F.array(
            F.struct(F.lit("quality").alias("name"), F.col("quality").alias("grp")),
            F.struct(F.lit("toxic").alias("name"), F.col("toxic").alias("grp")),
        )
    )
    sources = table(spark, sf_dir, "documents").select("doc_id", "source")
    return (
        table(spark, sf_dir, "labels")
        .join(sources, "doc_id")
        .select("doc_id", "source", side.alias("s"))
        .select(
            F.concat_ws("_", "s.name", "source").alias("trait"),
            F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("species"),
            "s.grp",
        )
    )


def order_lines(spark: SparkSession, sf_dir: str, part_rows: int | None = None) -> DataFrame:
    """Customer, order and line with the branch lengths of the order trees, those of a tree side by side.

    Parts are of ``part_rows`` lines where given; what windows over tokens need is the default.
    """
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    rows = items.count()
    lines = (
        spread_by(items, rows, "l_orderkey", part_rows=part_rows)
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.max("l_quantity").cast("bigint").alias("line_length"))
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("order_length"),
    )
    placed = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("tree"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("order"),
        F.concat_ws("_", F.lit("l"), F.col("l_orderkey"), F.col("l_linenumber")).alias("tip"),
        "order_length",
        "line_length",
    )
    return spread_by(placed, rows, "tree", part_rows=part_rows)


def order_trees(spark: SparkSession, sf_dir: str, part_rows: int | None = None) -> DataFrame:
    """One Newick tree per customer: orders as inner nodes, lines as tips."""

    def bracket(names: str) -> Column:
        return F.concat(F.lit("("), F.array_join(F.sort_array(F.collect_list(names)), ","), F.lit(")"))

    tips = order_lines(spark, sf_dir, part_rows).withColumn(
        "text", F.concat("tip", F.lit(":"), F.col("line_length").cast("string"))
    )
    inner = (
        tips.groupBy("tree", "order", "order_length")
        .agg(bracket("text").alias("inside"))
        .withColumn("text", F.concat("inside", "order", F.lit(":"), F.col("order_length").cast("string")))
    )
    return inner.groupBy("tree").agg(bracket("text").alias("inside")).select(
        "tree", F.concat("inside", "tree", F.lit(";")).alias("newick")
    )


def neighbour_pairs(spark: SparkSession, sf_dir: str, part_rows: int | None = None) -> DataFrame:
    """Each tip of an order tree with the next tip in name order."""
    order = Window.partitionBy("tree").orderBy("tip")
    return (
        order_lines(spark, sf_dir, part_rows)
        .select("tree", F.col("tip").alias("a"), F.lead("tip").over(order).alias("b"))
        .where(F.col("b").isNotNull())
    )
