"""Ranks of values in a distribution by equality joins, without a sort or window over all of it.

Values from 0 up to 2^bits are leaves of a binary tree. A value is counted in its
node at every level, and the values from one on upwards are the union of that leaf and
of the right-hand siblings on its way to the root, at most one on each level.
Both sides meet on (level, node), so the work is ``bits`` rows a value, combined in
the map tasks, whatever the distribution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_count_from(df: DataFrame, value: str, distribution: DataFrame, name: str, bits: int = 63) -> DataFrame:
    """Adds ``name``: how many rows of ``distribution`` (column ``value``) are at least the row's ``value``.

    Values are whole numbers from 0 to below 2^bits; rows with another value fail.
    """
    within = F.col("v").between(F.lit(0), F.lit((1 << bits) - 1))
    checked = F.when(within, F.col("v")).otherwise(F.raise_error(F.lit(f"a value is not from 0 to 2^{bits} - 1")))
    levels = F.sequence(F.lit(0), F.lit(bits))

    def node(level: Column, place: Column) -> Column:
        return F.struct(level.alias("level"), place.alias("node"))

    counted = distribution.select(F.col(value).cast("long").alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    nodes = (
        counted.select(checked.alias("v"), "n")
        .select("n", F.explode(F.transform(levels, lambda k: node(k, _shifted("v", k)))).alias("at"))
        .groupBy("at.level", "at.node")
        .agg(F.sum("n").alias("n"))
    )
    right = F.filter(levels, lambda k: (k < bits) & (_shifted("v", k) % 2 == 0))
    above = F.transform(right, lambda k: node(k, _shifted("v", k) + 1))
    own = F.array(node(F.lit(0), F.col("v")))
    wanted = df.select(F.col(value).cast("long").alias("v")).distinct().select(checked.alias("v"))
    found = (
        wanted.select("v", F.explode(F.concat(own, above)).alias("at"))
        .select("v", "at.level", "at.node")
        .join(nodes, ["level", "node"])
        .groupBy("v")
        .agg(F.sum("n").alias(name))
    )
    # Checked here as well, since a join with an empty distribution is left out of the plan.
    own_value = F.col(value).cast("long")
    refused = F.raise_error(F.lit(f"a value is not from 0 to 2^{bits} - 1"))
    counted_from = F.when(own_value.between(F.lit(0), F.lit((1 << bits) - 1)), F.coalesce(name, F.lit(0))).otherwise(refused)
    return df.join(found, own_value == F.col("v"), "left").drop("v").withColumn(name, counted_from)


def _shifted(value: str, by: Column) -> Column:
    return F.call_function("shiftright", F.col(value), by)
