"""Cohort and panel preparation, checks, sample counts and cell collapse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata_spark import fixed_values as fx
from strata_spark.functions.levels import choose, cut
from strata_spark.functions.scalars import flatten_text, slug, snake
from strata_spark.operators.checks import Checks, watched

RESULT_CODES = {"pos": 1, "neg": 0}
SEX_NAMES = {"f": "Female", "m": "Male"}
COUNTS = ("n", "pos_s", "neg_s", "pos_n", "neg_n", "vacc")


def prepare_cohort(df: DataFrame, breaks: Sequence[float] = fx.AGE_BREAKS, checks: Checks | None = None) -> DataFrame:
    """Bin ages and recode sex, both assay results and vaccination; all narrow.

    With ``checks`` the rules of a cohort are counted by the job that computes it.
    """
    return watched(checks, df.select(
        "uid", "hh_id", "age",
        cut("age", breaks).alias("age_cat"),
        choose(F.col("sex"), SEX_NAMES).alias("Sex"),
        choose(F.col("S_interp"), RESULT_CODES).alias("s_result"),
        choose(F.col("N_interp"), RESULT_CODES).alias("n_result"),
        F.col("vaccinated").cast("int").alias("vaccinated"),
    ), "cohort", cohort_rules())


def snake_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[snake(c) for c in df.columns])


def panel_rules() -> dict[str, Column]:
    return {"bad_variant": F.col("variant").isNotNull(), "bad_ec50": F.col("ec50").isNotNull() & ~F.isnan("ec50"),
            "bad_age_cat": F.col("age_cat").isNotNull(), "bad_sex": F.col("sex").isNotNull()}


def prepare_panel(df: DataFrame, age_column: str, threshold: float = fx.EC50_THRESHOLD, checks: Checks | None = None) -> DataFrame:
    """Normalise names, flag the threshold and name the chosen age scheme ``age_cat``; ``checks`` counts the rules of a panel."""
    out = snake_names(df)
    age_column = snake(age_column)
    if age_column not in out.columns:
        raise ValueError(f"no age scheme {age_column!r} among {out.columns}")
    prepared = (
        out.withColumn("ec50_thresh", F.col("ec50") > threshold)
        .withColumn("variant", flatten_text(F.col("variant")))
        .withColumnRenamed(age_column, "age_cat")
    )
    return watched(checks, prepared, "panel", panel_rules())


def filter_variant(df: DataFrame, variant: str, names: Sequence[str] | None = None) -> DataFrame:
    """Rows of one variant by its slug, prepared or raw; an unknown slug is an error that lists the valid ones.

    ``names`` are the declared names of all variants as they are in ``df``. They decide without a job, and the filter
    compares the stored column itself, so it reaches the scan. Without them the slugs are looked up when none matches.
    """
    if names is not None:
        slugs = {n: slug(n) for n in names}
        if variant not in slugs.values():
            raise ValueError(f"unknown variant {variant!r}, there are {sorted(set(slugs.values()))}")
        return df.where(F.col("variant").isin(*[n for n, s in slugs.items() if s == variant]))
    picked = df.where(F.col("variant") == variant)
    if picked.select("variant").isEmpty():
        known = sorted(r.variant for r in df.select("variant").distinct().where("variant IS NOT NULL").collect())
        raise ValueError(f"unknown variant {variant!r}, there are {known}")
    return picked


def columns_like(df: DataFrame, *parts: str) -> list[str]:
    """Names that contain any of ``parts``, in frame order."""
    return [c for c in df.columns if any(p in c for p in parts)]


def child_flag(age: Column) -> Column:
    return age < fx.CHILD_AGE


def failure_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: row count and, per rule, the rows that break it."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()],
    )


def require(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Raise when any row breaks any rule, else return ``df``. One aggregate pass."""
    bad = failure_counts(df, rules).first().asDict()
    bad = {k: v for k, v in bad.items() if k != "n_rows" and v}
    if bad:
        raise ValueError(f"failed checks: {bad}")
    return df


def cohort_rules() -> dict[str, Column]:
    """Both results are needed, not either one."""
    return {
        "bad_s_result": F.col("s_result").isin(0, 1),
        "bad_n_result": F.col("n_result").isin(0, 1),
        "bad_age_cat": F.col("age_cat").isNotNull(),
        "bad_sex": F.col("Sex").isNotNull(),
        "bad_vaccinated": F.col("vaccinated").isNotNull(),
    }


def _count_columns() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        # a missing result is neither positive nor negative
        *[F.count_if(F.col(f"{assay}_result") == code).alias(f"{name}_{assay}")
          for assay in ("s", "n") for name, code in (("pos", 1), ("neg", 0))],
        F.count_if(F.col("vaccinated") == 1).alias("vacc"),
    ]


def sample_counts(df: DataFrame, by: str) -> DataFrame:
    """Observed counts of both assays and of vaccination per group."""
    return df.groupBy(by).agg(*_count_columns())


def sample_counts_with_total(df: DataFrame, by: str, total: str = "all") -> DataFrame:
    """Same, with one more row for the whole sample, in one pass."""
    return (
        df.groupingSets([[F.col(by)], []], F.col(by))
        .agg(F.grouping(by).alias("is_total"), *_count_columns())
        .withColumn(by, F.when(F.col("is_total") == 1, F.lit(total)).otherwise(F.col(by)))
        .drop("is_total")
    )


def stacked_counts(df: DataFrame, age: str = "age_cat", sex: str = "Sex") -> DataFrame:
    """Counts keyed by ``(var, val)`` for age levels, the total and sexes.

    One grouping-sets pass over the sample.
    """
    g_age, g_sex = F.grouping(age), F.grouping(sex)
    return (
        df.groupingSets([[F.col(age)], [F.col(sex)], []], F.col(age), F.col(sex))
        .agg(g_age.alias("ga"), g_sex.alias("gs"), *_count_columns())
        .select(
            F.when(F.col("gs") == 0, "Sex").otherwise("Age").alias("var"),
            F.when(F.col("gs") == 0, F.col(sex)).when(F.col("ga") == 0, F.col(age)).otherwise("all").alias("val"),
            *COUNTS,
        )
    )


def joint_results(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts of the four joint assay results per group."""
    s, n = F.col("s_result"), F.col("n_result")
    return df.groupBy(*by).agg(
        F.count_if((s == 1) & (n == 1)).alias("sp_np"),
        F.count_if((s == 0) & (n == 1)).alias("sn_np"),
        F.count_if((s == 1) & (n == 0)).alias("sp_nn"),
        F.count_if((s == 0) & (n == 0)).alias("sn_nn"),
    )


def collapse_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per distinct covariate and outcome combination with its count ``n``.

    Likelihood terms depend on a participant only through these columns, so
    sums over cells weighted by ``n`` are exact for a survey of any size, and
    the number of cells is bounded by the declared levels.
    """
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
