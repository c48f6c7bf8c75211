"""Resampled groups: uniform, stratified by family, and matched by value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladewise.functions.text import comma_list, hash60, names_in
from cladewise.plans.sizing import broadcast_if_small, pin


def number_members(pool: DataFrame) -> DataFrame:
    """``(stratum, species)`` with a dense 0-based ``idx`` and the stratum's ``size``.

    The order is by digest. Ranks are taken inside 256 digest buckets and
    shifted by the sizes of the buckets before, so no stratum is ranked by a
    single task.
    """
    digest = pool.select("stratum", "species").distinct().select(
        "stratum", "species", F.md5("species").alias("digest")
    ).withColumn("bucket", F.substring("digest", 1, 2))
    sizes = digest.groupBy("stratum", "bucket").agg(F.count("*").alias("n"))
    stratum = Window.partitionBy("stratum")
    before = stratum.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "stratum",
        "bucket",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
        F.sum("n").over(stratum).alias("size"),
    )
    rank = F.row_number().over(
        Window.partitionBy("stratum", "bucket").orderBy("digest", "species")
    )
    return (
        digest.withColumn("rank", rank)
        .join(offsets, ["stratum", "bucket"])
        .select("stratum", "species", (F.col("offset") + F.col("rank") - 1).alias("idx"), "size")
    )


def _seeded(seed: int, *parts: Column) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def draw_indexes(size: Column, wanted: Column, *key: Column, seed: int) -> Column:
    """``wanted`` distinct indexes below ``size``, a uniform ordered sample.

    Floyd's method picks the subset with one draw per pick, so the cost
    follows the sample and not the pool; a second digest puts it in order.

    A draw that was picked before gives way to its own step. That is so if an
    earlier step drew it, which a sort tells, or if it is itself a step that gave
    way. Steps point to the step they drew, and pointers are doubled until none
    is left, so no pick looks through the picks before it.
    """
    first = size - wanted
    draws = F.transform(
        F.sequence(first, size - 1),
        lambda j: F.struct((hash60(_seeded(seed, *key, j)) % (j + 1)).alias("i"), j.alias("j")),
    )
    repeated = _let(
        F.sort_array(draws),
        lambda s: F.transform(
            s, lambda x, n: F.struct(x["j"], x["i"], ((n > 0) & (F.get(s, n - 1)["i"] == x["i"])).alias("yields"))
        ),
    )
    # A step that drew another one yields if that one does; the place of step j is j - first.
    steps = F.transform(
        F.sort_array(repeated),
        lambda x: F.struct(
            x["j"],
            x["i"],
            x["yields"],
            F.when(~x["yields"] & (x["i"] >= first) & (x["i"] < x["j"]), (x["i"] - first).cast("int")).alias("to"),
        ),
    )

    def doubled(all_steps: Column, _: Column) -> Column:
        def followed(x: Column) -> Column:
            target = F.get(all_steps, x["to"])
            further = F.struct(x["j"], x["i"], target["yields"].alias("yields"), target["to"].alias("to"))
            return F.when(x["to"].isNull(), x).otherwise(further)

        open_steps = F.exists(all_steps, lambda x: x["to"].isNotNull())
        return F.when(open_steps, F.transform(all_steps, followed)).otherwise(all_steps)

    rounds = F.sequence(F.lit(0), F.length(F.bin(wanted)))
    picked = F.transform(
        F.aggregate(rounds, steps, doubled), lambda x: F.when(x["yields"], x["j"]).otherwise(x["i"])
    )
    ordered = F.sort_array(
        F.transform(
            picked,
            lambda i: F.struct(F.md5(_seeded(seed, *key, F.lit("order"), i)).alias("h"), i.alias("i")),
        )
    )
    return F.transform(ordered, lambda s: s["i"])


def sample_strata(
    numbered: DataFrame, quotas: DataFrame, n_cycles: int, seed: int
) -> DataFrame:
    """Per cycle and stratum, ``n_fg`` then ``n_bg`` different species of the stratum.

    ``numbered`` comes from ``number_members``, ``quotas`` is ``(stratum,
    size, n_fg, n_bg)``. A stratum too small for its quota fails the job.
    """
    wanted = F.col("n_fg") + F.col("n_bg")
    too_small = F.concat(
        F.lit("too few species to resample in stratum '"), F.col("stratum"), F.lit("'")
    )
    enough = F.coalesce("size", F.lit(0)) >= wanted
    checked = quotas.where(wanted > 0).withColumn(
        "size", F.when(enough, F.col("size")).otherwise(F.raise_error(too_small))
    )
    # Spread the cycles before drawing, in a number of parts that is not merged again: few short rows make many picks.
    parts = 4 * numbered.sparkSession.sparkContext.defaultParallelism
    cycles = checked.withColumn(
        "cycle_no", F.explode(F.sequence(F.lit(1), F.lit(n_cycles)))
    ).repartition(parts, "cycle_no", "stratum")
    draws = cycles.withColumn(
        "picks",
        draw_indexes(
            F.col("size"),
            wanted.cast("bigint"),
            F.col("cycle_no"),
            F.col("stratum"),
            seed=seed,
        ),
    ).select(
        # Outer, though no list is empty: else Spark asks for filled lists, and so draws, before it spreads the cycles.
        "cycle_no", "stratum", "n_fg", F.posexplode_outer("picks").alias("nth", "idx")
    )
    names = broadcast_if_small(numbered.drop("size"), row_bytes=96)
    return draws.join(names, ["stratum", "idx"]).select(
        F.concat(F.lit("b_"), F.col("cycle_no").cast("string")).alias("trait"),
        "species",
        (F.col("nth") < F.col("n_fg")).cast("int").alias("grp"),
    )


def resample_random(
    species: DataFrame, n_fg: int, n_bg: int, n_cycles: int, seed: int = 0
) -> DataFrame:
    """Groups of fixed sizes drawn uniformly from all species."""
    numbered = pin(number_members(species.select(F.lit("").alias("stratum"), "species")))
    quotas = numbered.groupBy("stratum").agg(
        F.max("size").alias("size"), F.lit(n_fg).alias("n_fg"), F.lit(n_bg).alias("n_bg")
    )
    return sample_strata(numbered, quotas, n_cycles, seed)


def family_quotas(template: DataFrame, families: DataFrame) -> DataFrame:
    """Foreground and background members the template has in each family."""
    homeless = F.concat(F.lit("no family for template species '"), F.col("species"), F.lit("'"))
    return (
        template.join(families, "species", "left")
        .withColumn("stratum", F.coalesce("family", F.raise_error(homeless)))
        .groupBy("stratum")
        .agg(
            F.count_if(F.col("grp") == 1).alias("n_fg"),
            F.count_if(F.col("grp") == 0).alias("n_bg"),
        )
    )


def resample_family(
    families: DataFrame, template: DataFrame, n_cycles: int, seed: int = 0
) -> DataFrame:
    """Groups that keep the template's family composition."""
    pool = families.select(F.col("family").alias("stratum"), "species")
    numbered = pin(number_members(pool))
    sizes = numbered.groupBy("stratum").agg(F.max("size").alias("size"))
    quotas = family_quotas(template, families).join(sizes, "stratum", "left")
    return sample_strata(numbered, quotas, n_cycles, seed)


def value_candidates(permuted: DataFrame, values: DataFrame, template: DataFrame) -> DataFrame:
    """Species per cycle whose permuted value occurs in a template group, as (cycle, grp, ...)."""
    template_values = (
        values.join(broadcast_if_small(template), "species").select("grp", "value").distinct()
    )
    return permuted.join(broadcast_if_small(template_values), "value").select(
        "cycle", "grp", "species", "value"
    )


def select_by_value(
    permuted: DataFrame,
    values: DataFrame,
    template: DataFrame,
    strategy: str = "random",
    seed: int = 0,
    allow_short: bool = False,
) -> DataFrame:
    """Groups per cycle among the value-matched candidates.

    ``inner`` takes the highest foreground and lowest background candidates,
    ``edges`` the reverse, ``random`` draws both groups independently, so they
    may overlap. Group sizes are the template's; a cycle with fewer candidates
    fails the job, or with ``allow_short`` keeps those it has.
    """
    sizes = template.agg(
        F.count_if(F.col("grp") == 1).alias("fg"), F.count_if(F.col("grp") == 0).alias("bg")
    ).first()
    # Sort keys that grow from the first choice to the last, per group.
    is_fg = F.col("grp") == 1
    keys = {
        "inner": F.when(is_fg, -F.col("value")).otherwise(F.col("value")),
        "edges": F.when(is_fg, F.col("value")).otherwise(-F.col("value")),
        "random": F.md5(_seeded(seed, F.col("cycle"), F.col("grp"), F.col("species"))),
    }
    if strategy not in keys:
        raise ValueError(f"strategy must be one of {sorted(keys)}")
    # A nameless candidate stands behind all others of each group; it is chosen only where they are too few.
    nameless = permuted.select("cycle").distinct().select(
        "cycle", F.explode(F.array(F.lit(1), F.lit(0))).alias("grp")
    )
    candidates = value_candidates(permuted, values, template)
    if not allow_short:
        candidates = candidates.unionByName(nameless, allowMissingColumns=True)
    order = Window.partitionBy("cycle", "grp").orderBy(
        F.col("species").isNull(), keys[strategy], "species"
    )
    ranked = candidates.withColumn("rank", F.row_number().over(order))
    too_few = F.concat(F.lit("too few candidates in cycle '"), F.col("cycle").cast("string"), F.lit("'"))
    # The literal bound lets Spark keep the first n per group before it shuffles.
    return (
        ranked.where(F.col("rank") <= max(sizes["fg"], sizes["bg"]))
        .where(F.col("rank") <= F.when(is_fg, sizes["fg"]).otherwise(sizes["bg"]))
        .select(
            F.col("cycle").alias("trait"),
            F.coalesce("species", F.raise_error(too_few)).alias("species"),
            "grp",
        )
    )


def cycle_lists(groups: DataFrame) -> DataFrame:
    """One row per cycle with sorted foreground and background names."""

    def names(grp: int) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("grp") == grp, F.col("species"))))

    return groups.groupBy(F.col("trait").alias("cycle")).agg(
        names(1).alias("fg"), names(0).alias("bg")
    )


def cycles_to_groups(cycles: DataFrame, fg_label: int = 1) -> DataFrame:
    """Cycle rows as group rows; ``fg_label=0`` swaps the labels of the two lists."""
    side = F.explode(
        F.array(
            F.struct(F.lit(fg_label).alias("grp"), F.col("fg").alias("names")),
            F.struct(F.lit(1 - fg_label).alias("grp"), F.col("bg").alias("names")),
        )
    )
    return cycles.select("cycle", side.alias("side")).select(
        F.col("cycle").alias("trait"),
        F.explode("side.names").alias("species"),
        F.col("side.grp").alias("grp"),
    )


def first_cycles(groups: DataFrame, n: int) -> DataFrame:
    """Groups of the first ``n`` cycles: numbered ones in order of their number, then the others by name."""
    number = F.regexp_extract("trait", r"(\d+)$", 1).try_cast("bigint")
    first = groups.select("trait").distinct().orderBy(number.asc_nulls_last(), "trait").limit(n)
    return groups.join(first, "trait", "left_semi")


def cycle_text(cycles: DataFrame) -> DataFrame:
    """Cycle rows with comma lists, ready for a tab file; cycles without background drop out."""
    return cycles.where(F.size("bg") > 0).select(
        "cycle", comma_list(F.col("fg")).alias("fg"), comma_list(F.col("bg")).alias("bg")
    )


def text_to_cycles(lines: DataFrame) -> DataFrame:
    return lines.select("cycle", names_in(F.col("fg")).alias("fg"), names_in(F.col("bg")).alias("bg"))
