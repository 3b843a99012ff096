"""Population strata: census counts, weights, reallocation and splitting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata_spark import fixed_values as fx
from strata_spark.functions.levels import INFECTION, PANEL_SEX, Levels, cut, fan_out, grid_size
from strata_spark.functions.scalars import mean_by_weight, ratio
from strata_spark.session import broadcast_bounded

WEIGHT_KEYS = ("age_cat", "vacc_status_3way", "inf_latest")


def population_strata(census: DataFrame, breaks: Sequence[float] = fx.AGE_BREAKS) -> DataFrame:
    """``(Sex, age_cat, strata_pop, percent)`` from counts by single year of age."""
    top = f">= {breaks[-1]}"
    age = f"CASE WHEN Age = '{top}' THEN {breaks[-1]} ELSE try_cast(Age AS INT) END"
    counts = (
        census.select("Sex", F.expr(age).alias("_age"), "Total").dropna()
        .where(F.col("_age").between(breaks[0], breaks[-1]))
        .select("Sex", cut("_age", breaks).alias("age_cat"), "Total")
        .groupBy("Sex", "age_cat").agg(F.sum("Total").alias("strata_pop"))
    )
    # the window runs over strata, of which there are levels x levels
    return counts.withColumn("percent", F.col("strata_pop") / F.sum("strata_pop").over(Window.partitionBy()))


def strata_in_sample(strata: DataFrame, sample: DataFrame, factors: Sequence[Levels]) -> DataFrame:
    """Keep strata whose every level occurs in the sample.

    One pass over the sample gathers the levels seen; they are declared, so
    the sets are short and the side to broadcast has a known bound.
    """
    names = [f.name for f in factors]
    seen = sample.agg(*[F.collect_set(k).alias(k) for k in names])
    for k in names:
        seen = seen.withColumn(k, F.explode(k))
    return strata.join(broadcast_bounded(seen, grid_size(*factors)), names, "left_semi")


def infection_shares(truth: DataFrame, keys: Sequence[str] = WEIGHT_KEYS) -> DataFrame:
    """Share of each infection status within age and vaccination, in percent."""
    age, vacc, inf = keys
    counts = truth.dropna(subset=list(keys)).groupBy(vacc, inf, age).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn(
        "total_per_vacc", F.sum("n").over(Window.partitionBy(vacc, age))
    ).withColumn("pc_inf_per_vacc", ratio(F.col("n") * 100.0, F.col("total_per_vacc")))


def complete(df: DataFrame, keys: Sequence[str], fill: dict) -> DataFrame:
    """Every combination of the key values present, with ``fill`` where absent.

    One aggregate gathers the distinct values of each key; they are declared
    levels, so the lists stay short.
    """
    present = df.agg(*[F.collect_set(k).alias(k) for k in keys])
    for k in keys:
        present = present.withColumn(k, F.explode(k))
    return present.join(df, list(keys), "left").fillna(fill)


def strata_weights(truth: DataFrame, vaccination: DataFrame, keys: Sequence[str] = WEIGHT_KEYS) -> DataFrame:
    """Stratum sizes from sample infection shares and vaccination counts."""
    age, vacc, _ = keys
    size = F.col("pc_inf_per_vacc") / 100.0 * F.col("pop_total") * F.col("percentage") / 100.0
    joined = infection_shares(truth, keys).join(vaccination, [age, vacc], "full")
    known = joined.select(*keys, size.alias("strata_size")).dropna()
    return complete(known, keys, {"strata_size": 0.0})


def with_group_totals(weights: DataFrame, infection: Levels = INFECTION) -> DataFrame:
    """Group total and infected total on each stratum row."""
    group = Window.partitionBy("age_cat", "vacc_status_3way")
    infected = F.when(F.col("inf_latest") != infection.ref, F.col("strata_size")).otherwise(0.0)
    return weights.withColumn("n_inf_sample", F.sum(infected).over(group)).withColumn(
        "n_tot_sample", F.sum("strata_size").over(group))


def pooled_mean(df: DataFrame, by: Sequence[str], value: str, weight: str, name: str) -> DataFrame:
    """Weighted mean over all draws together."""
    return df.groupBy(*by).agg(
        mean_by_weight(F.col(value), F.col(weight)).alias(name))


def _size_of(label: str) -> Column:
    return F.sum(F.when(F.col("inf_latest") == label, F.col("strata_size")).otherwise(0.0))


def _ratio_columns(df: DataFrame) -> DataFrame:
    """Sample share, share of 2022 and the ratio to the external share.

    With no infection in the sample of an age the ratio is undefined: it is
    set to 1 (no change) and flagged.
    """
    raw = ratio(F.col("pc_inf_external"), F.when(F.col("n_infected") > 0, F.col("pc_inf_sample")))
    return (
        df.withColumn("n_infected", F.col("n_inf_before") + F.col("n_inf_2022"))
        .withColumn("pc_inf_sample", (1.0 - ratio(F.col("n_uninfected"), F.col("n_total"))) * 100.0)
        .withColumn("pc_2022", ratio(F.col("n_inf_2022"), F.col("n_infected")))
        .withColumn("pc_ratio", F.coalesce(raw, F.lit(1.0))).withColumn("no_change", raw.isNull()))


AGE_SUMS = {"n_uninfected": "uninfected", "n_inf_before": "inf_bef_2022", "n_inf_2022": "inf_2022"}


def infection_ratio(weights: DataFrame, external: DataFrame, by_draw: bool = False) -> DataFrame:
    """Per age: sample infection counts and the ratio of the external share to them.

    ``external`` has ``age_cat, pc_inf_external`` and, with ``by_draw``, also
    ``sim``, so that its uncertainty is kept.
    """
    keys = ["age_cat", "sim"] if by_draw else ["age_cat"]
    sums = weights.groupBy("age_cat").agg(
        *[_size_of(x).alias(k) for k, x in AGE_SUMS.items()], F.sum("strata_size").alias("n_total"))
    return _ratio_columns(sums.join(external.select(*keys, "pc_inf_external"), "age_cat", "inner"))


def reallocate(weights: DataFrame, external: DataFrame, by_draw: bool = False) -> DataFrame:
    """Rescale infected counts inside each age and vaccination group.

    The infected total is multiplied by the ratio of its age and split by the
    sample shares: 2022 first, capped by the group; then before 2022, capped by
    what is left; the rest is uninfected. The group total does not change.
    Windows run over strata, so the weights are computed once.
    """
    draw = ["sim"] if by_draw else []
    age = Window.partitionBy("age_cat")
    group = Window.partitionBy("age_cat", "vacc_status_3way")
    summed = weights.select(
        "*", *[_size_of(x).over(age).alias(k) for k, x in AGE_SUMS.items()], F.sum("strata_size").over(age).alias("n_total"),
        F.sum("strata_size").over(group).alias("_all"),
        _size_of("inf_2022").over(group).alias("_late"), _size_of("inf_bef_2022").over(group).alias("_early"))
    sized = (
        _ratio_columns(summed.join(external.select("age_cat", *draw, "pc_inf_external"), "age_cat", "inner"))
        .withColumn("_new", (F.col("_late") + F.col("_early")) * F.col("pc_ratio"))
        .withColumn("_share", F.coalesce(ratio(F.col("_late"), F.col("_late") + F.col("_early")), F.lit(0.0)))
        .withColumn("_late_new", F.least(F.col("_new") * F.col("_share"), F.col("_all")))
        .withColumn("_early_new", F.least(F.col("_new") * (1.0 - F.col("_share")), F.col("_all") - F.col("_late_new"))))
    size = (
        F.when(F.col("inf_latest") == "inf_2022", F.col("_late_new"))
        .when(F.col("inf_latest") == "inf_bef_2022", F.col("_early_new"))
        .otherwise(F.col("_all") - F.col("_late_new") - F.col("_early_new")))
    return sized.select(*weights.columns, *draw, "pc_ratio", size.alias("strata_size_new"))


def split_by_sex(strata: DataFrame, age: Levels, vaccination: Levels, infection: Levels = INFECTION,
                 sex: Levels = PANEL_SEX, by: Sequence[str] = ()) -> DataFrame:
    """Two half strata per stratum, a category label and a row number.

    Rows are numbered by declared level order: sex (m first), age,
    vaccination, infection.
    """
    halves = fan_out(strata, Levels(sex.name, tuple(reversed(sex.labels)), sex.ref))
    order = Window.partitionBy(*by).orderBy(
        (-sex.ordinal(F.col(sex.name))), age.ordinal(F.col("age_cat")),
        vaccination.ordinal(F.col("vacc_status_3way")), infection.ordinal(F.col("inf_latest")))
    return halves.withColumn("strata_size_final", F.col("strata_size_new") / 2.0).withColumn(
        "full_cat", F.concat(
            F.lit("sex"), F.col("sex"), F.lit(":age_cat"), F.col("age_cat"),
            F.lit(":inf_latest"), F.col("inf_latest"), F.lit(":vacc"), F.col("vacc_status_3way"))
    ).withColumn("row", F.row_number().over(order))
