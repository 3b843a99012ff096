"""Report tables: prevalence, relative risk, combined and per-variant."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata_spark import fixed_values as fx
from strata_spark.functions.scalars import count_percent_text, fixed, interval_text
from strata_spark.operators.cohort import COUNTS
from strata_spark.operators.design import Design
from strata_spark.operators.draws import score_seroprevalence, stack_measures
from strata_spark.operators.poststrat import compact, conditional_estimates, marginal_estimates
from strata_spark.operators.risk import relative_risk, sign_tail, sign_vs_reference
from strata_spark.operators.status import JOINT, any_antibody, true_status
from strata_spark.operators.summary import full_summary
from strata_spark.session import literal_table

REFERENCE_TEXT = "--"


def category_rank(val: Column) -> Column:
    """Sort key of report categories: ages by number, then Male, Female, all."""
    number = F.regexp_extract(val, r"(-?\d+)", 1).try_cast("int")
    return (
        F.when(val == "Male", 1_000_001).when(val == "Female", 1_000_002).when(val == "all", 1_000_003)
        .otherwise(F.coalesce(number, F.lit(1_000_000))))


def _with_counts(df: DataFrame, counts: DataFrame) -> DataFrame:
    """Left join of observed counts on ``(var, val)``."""
    return df.join(counts, ["var", "val"], "left")


def count_texts(exclude: Sequence[str] = ("n",)) -> list[Column]:
    return [count_percent_text(F.col(c), F.col("n")).alias(f"{c}_text") for c in COUNTS if c not in exclude]


def prevalence_draws(scored: DataFrame, refs: Mapping[str, str], by: Sequence[str] = ("sim",)) -> DataFrame:
    """Marginal estimates per draw with their sign; the overall row is ``Age``/``all``."""
    stacked = marginal_estimates(scored, by)
    overall = F.col("var") == "Overall"
    named = stacked.withColumn("val", F.when(overall, "all").otherwise(F.col("val"))).withColumn(
        "var", F.when(overall, "Age").otherwise(F.col("var")))
    signed = sign_vs_reference(named, refs, by)
    return signed.withColumn("coef_sign", F.when(F.col("val") != "all", F.col("coef_sign")))


def prevalence_table(scored: DataFrame, counts: DataFrame, refs: Mapping[str, str],
                     by: Sequence[str] = ("sim",), keep: Sequence[str] = (), n_draws: int | None = None) -> DataFrame:
    """Counts, prevalence summaries and tail probability per category.

    ``by`` holds the draw key and may add a measure, which then also goes in
    ``keep``. With a declared number of draws a category is summarised in one
    array. Numbers stay beside every text column.
    """
    draws = prevalence_draws(scored, refs, by)
    keys = [*keep, "var", "val"]
    summary = full_summary(draws, keys, extra={"p_tail": sign_tail()}, draws=n_draws)
    return _with_counts(summary, counts).select(
        *keys, category_rank(F.col("val")).alias("ord"), *COUNTS,
        "median", "hdci_lo", "hdci_hi", "mean", "q025", "q975", "p_tail",
        interval_text(F.col("median"), F.col("hdci_lo"), F.col("hdci_hi"), 1, 100.0).alias("median_text"),
        interval_text(F.col("mean"), F.col("q025"), F.col("q975"), 1, 100.0).alias("mean_text"),
        F.coalesce(fixed(F.col("p_tail"), 4), F.lit(REFERENCE_TEXT)).alias("tail_text"),
        *count_texts())


def relative_risk_table(scored: DataFrame, counts: DataFrame, refs: Mapping[str, str],
                        by: Sequence[str] = ("sim",), keep: Sequence[str] = ()) -> DataFrame:
    """Relative risk per category, from conditional estimates, with counts."""
    estimates = conditional_estimates(scored, refs["Age"], refs["Sex"], by)
    risk = relative_risk(estimates, refs, by, keep)
    text = F.when(F.col("mean").isNotNull(), interval_text(F.col("mean"), F.col("q025"), F.col("q975"), 2))
    return _with_counts(risk, counts).select(
        *keep, "var", "val", category_rank(F.col("val")).alias("ord"), *COUNTS, "mean", "q025", "q975", "p_tail",
        F.coalesce(text, F.lit(REFERENCE_TEXT)).alias("risk_text"),
        F.coalesce(fixed(F.col("p_tail"), 4), F.lit(REFERENCE_TEXT)).alias("tail_text"))


def full_join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full join where null keys match; value columns must not clash."""
    match = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    return left.alias("l").join(right.alias("r"), match, "full").select(
        *[F.coalesce(f"l.{k}", f"r.{k}").alias(k) for k in keys],
        *[f"l.{c}" for c in left.columns if c not in keys],
        *[f"r.{c}" for c in right.columns if c not in keys])


def combined_report(stacked: DataFrame, counts: DataFrame, refs: Mapping[str, str],
                    measures: Mapping[str, str], tail_of: str, n_draws: int | None = None) -> DataFrame:
    """Prevalence of several measures side by side.

    ``stacked`` has a ``measure`` column; ``measures`` maps it to report names.
    All measures are summarised in one pass and laid side by side by a pivot
    over the declared names.
    """
    long = prevalence_table(
        stacked, counts, refs, by=("measure", "sim"), keep=("measure",), n_draws=n_draws)
    picked = [F.max(F.when(F.col("measure") == m, F.col("mean_text"))).alias(name) for m, name in measures.items()]
    return long.groupBy("var", "val", "ord").agg(
        *[F.first(c).alias(c) for c in COUNTS], *picked,
        F.max(F.when(F.col("measure") == tail_of, F.col("tail_text"))).alias("tail_text"))


def stacked_seroprevalence(draws: DataFrame, strata: DataFrame, design: Design, coverage: str, **model) -> DataFrame:
    """Measures of the serology model as rows ``(measure, sim, age_cat, Sex, strata_pop, seropos)``.

    ``p_any_external`` takes vaccination from the ``coverage`` column of
    ``strata``. ``model`` options go to ``score_seroprevalence``.
    """
    keys = ["sim", "age_cat", "Sex", "strata_pop"]
    response = ("resp_sn_np", "resp_sp_nn", "vacc_response")
    scored = score_seroprevalence(draws, strata, design, keep=("sim", *response), carry=(coverage,), **model)
    outside = true_status(F.col("p_infection"), F.col(coverage) * F.col("vacc_response"), F.col("resp_sn_np"), F.col("resp_sp_nn"))
    both = scored.withColumn("p_any_external", any_antibody(outside))
    return stack_measures(both, ["p_any", "p_any_external", "p_infection", "p_vaccination"], keys)


def stacked_responses(draws: DataFrame, strata: DataFrame, design: Design, coverage: str, **model) -> DataFrame:
    """The four joint responses as rows ``(measure, sim, age_cat, Sex, strata_pop, seropos)``, under the model's vaccination
    (``sp_np``, ...) and under the ``coverage`` column of ``strata`` (``sp_np_external``, ...)."""
    keys = ["sim", "age_cat", "Sex", "strata_pop"]
    response = ("resp_sn_np", "resp_sp_nn", "vacc_response")
    scored = score_seroprevalence(draws, strata, design, keep=("sim", *response), carry=(coverage,), **model)
    outside = true_status(F.col("p_infection"), F.col(coverage) * F.col("vacc_response"), F.col("resp_sn_np"), F.col("resp_sp_nn"))
    both = scored.withColumns({f"{k}_external": c for k, c in outside.items()})
    return stack_measures(both, [*JOINT, *[f"{k}_external" for k in JOINT]], keys)


def member_tags() -> Column:
    """Every ``(var_cat, var)`` a panel row counts in."""
    inf, vacc = F.col("inf_latest"), compact(F.col("vacc_status_3way"))

    def tag(cat: str, val: Column) -> Column:
        return F.when(val.isNotNull(), F.struct(F.lit(cat).alias("var_cat"), val.alias("var")))

    return F.array_compact(F.array(
        tag("all", F.lit("all")), tag("sex", F.col("sex")), tag("age_cat", F.col("age_cat")),
        tag("inf_latest", inf), tag("vacc_status_3way", vacc),
        tag("inf_latest:vacc_status_3way", F.concat(inf, F.lit(":"), vacc))))


def observed_positives(cells: DataFrame) -> DataFrame:
    """Sample size, positives and their share per variant and category, from cells."""
    tagged = cells.select("variant", "n", "y", F.explode(member_tags()).alias("_t"))
    return tagged.groupBy("variant", "_t.var_cat", "_t.var").agg(
        F.sum("n").cast("bigint").alias("n"), F.sum(F.col("n") * F.col("y")).cast("bigint").alias("n_pos"))


def variants_of_interest(df: DataFrame, names: Sequence[str], outcome: str = "neutralizing",
                         keep_cats: Sequence[str] | None = None) -> DataFrame:
    """Rows of the named variants or of other outcomes, within the kept categories."""
    kept = F.col("variant").isin(*names) | (F.col("outcome") != outcome)
    if keep_cats is not None:
        kept = kept & F.col("var_cat").isin(*keep_cats)
    return df.where(kept)


def label_tables(spark) -> tuple[DataFrame, DataFrame]:
    """Ordered lookups of covariate and level labels."""
    variables = literal_table(
        spark, [(k, v, i) for i, (k, v) in enumerate(fx.VARIABLE_LABELS)],
        "var_cat string, variable string, variable_ord int")
    levels = literal_table(
        spark, [(k, v, i) for i, (k, v) in enumerate(fx.LEVEL_LABELS)], "var string, label string, label_ord int")
    return variables, levels


def variant_report(observed: DataFrame, estimates: DataFrame, sizes: DataFrame, variants: Sequence[str]) -> DataFrame:
    """One row per labelled category; observed and estimated text per variant.

    ``variants`` is the declared column list, so the pivot needs no extra pass.
    Categories without a label are dropped.
    """
    keys = ["variant", "var_cat", "var"]
    texts = observed.join(estimates, keys, "inner").select(
        *keys, count_percent_text(F.col("n_pos"), F.col("n")).alias("obs"),
        interval_text(F.col("mean"), F.col("q025"), F.col("q975"), 1, 100.0).alias("est"))
    pivoted = texts.groupBy("var_cat", "var").pivot("variant", list(variants)).agg(
        F.first("obs").alias("obs"), F.first("est").alias("est"))
    wide = pivoted.select("var_cat", "var", *[
        F.col(f"`{v}_{c}`").alias(f"{c}_{v}") for v in variants for c in ("obs", "est")])
    variables, levels = label_tables(observed.sparkSession)
    return (
        wide.join(sizes, ["var_cat", "var"], "inner").join(variables, "var_cat", "inner").join(levels, "var", "inner")
        .select("variable", "label", "n", *[f"{c}_{v}" for v in variants for c in ("obs", "est")],
                "variable_ord", "label_ord"))


def with_group_headers(report: DataFrame, group: str, group_ord: str, row_ord: str) -> DataFrame:
    """A header row before each group, in page order by ``(group_ord, row_ord)``.

    The first row of a group is doubled into header and row; a report is short,
    so the window over a group is too.
    """
    place = F.row_number().over(Window.partitionBy(group).orderBy(row_ord))
    doubled = report.withColumn("_place", place).withColumn("is_header", F.explode(
        F.when(F.col("_place") == 1, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False))))).drop("_place")
    kept = {group, group_ord}
    blank = {c: F.when(~F.col("is_header"), F.col(c)) for c in report.columns if c not in kept | {row_ord}}
    return doubled.withColumns(
        {**blank, row_ord: F.when(F.col("is_header"), -1).otherwise(F.col(row_ord))})
