"""Survey-shaped views over the test tables.

Each view is a plain projection or aggregate of one table, so its size follows
the table. They stand in for survey files, which are not shipped.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata_spark import fixed_values as fx
from strata_spark.functions.levels import AGE, SEX, cut
from strata_spark.operators.cohort import prepare_panel
from strata_spark.operators.design import Design
from strata_spark.session import literal_table

SERO_DESIGN = Design((SEX, AGE))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One participant per order, one household per customer."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("uid"), F.col("o_custkey").alias("hh_id"),
        F.when(F.col("o_orderkey") % 2 == 0, "f").otherwise("m").alias("sex"),
        (F.floor("o_totalprice") % 106).cast("int").alias("age"),
        F.when(F.col("o_orderstatus") != "F", "pos").otherwise("neg").alias("S_interp"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "pos").otherwise("neg").alias("N_interp"),
        (F.col("o_orderpriority") != "5-LOW").alias("vaccinated"))


def labelled_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One participant per labelled document, one household per source."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.select("doc_id", "source", "lang", "n_chars").join(lab, "doc_id").select(
        F.col("doc_id").alias("uid"), F.col("source").alias("hh_id"),
        F.when(F.col("lang") == "en", "f").otherwise("m").alias("sex"),
        (F.col("n_chars") % 106).cast("int").alias("age"),
        F.when(F.col("quality") == 1, "pos").otherwise("neg").alias("S_interp"),
        F.when(F.col("toxic") == 1, "pos").otherwise("neg").alias("N_interp"),
        (F.col("doc_id") % 10 < 7).alias("vaccinated"))


def census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers counted by sex and single year of age."""
    c = table(spark, sf_dir, "customer")
    age = F.floor(F.abs("c_acctbal")) % 106
    return c.select(
        F.when(F.col("c_custkey") % 2 == 0, "Female").otherwise("Male").alias("Sex"), age.alias("a")
    ).groupBy("Sex", "a").agg(F.count(F.lit(1)).cast("double").alias("Total")).select(
        F.when(F.col("a") >= 105, ">= 105").otherwise(F.col("a").cast("string")).alias("Age"), "Sex", "Total")


#: Draws of every fit of the views below.
N_DRAWS = 200


def scored_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored draws: several weighted rows per draw and stratum, four measures."""
    li = table(spark, sf_dir, "lineitem")
    a, b = F.col("l_discount") * 10, F.col("l_tax") * 10
    return li.select(
        (F.col("l_orderkey") % N_DRAWS).alias("sim"), F.year("l_shipdate").cast("string").alias("age_cat"),
        F.when(F.col("l_linestatus") == "F", "Female").otherwise("Male").alias("Sex"),
        F.col("l_quantity").alias("strata_pop"), a.alias("seropos"),
        b.alias("infection"), (a * b).alias("vaccination"), (1.0 - a * b).alias("external"))


def shipped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed results with the same strata as ``scored_draws``."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.year("l_shipdate").cast("string").alias("age_cat"),
        F.when(F.col("l_linestatus") == "F", "Female").otherwise("Male").alias("Sex"),
        F.when(F.col("l_returnflag") != "N", 1).otherwise(0).alias("s_result"),
        F.when(F.col("l_tax") > 0.04, 1).otherwise(0).alias("n_result"),
        F.when(F.col("l_linenumber") <= 4, 1).otherwise(0).alias("vaccinated"))


def raw_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One neutralization result per event; status belongs to the user."""
    return _with_user_columns(table(spark, sf_dir, "events")).selectExpr(
        "event_id AS obs_id", "user_id AS uid", "sex", "age", "age_cat_10y", "age_cat_UEP", "inf_latest",
        "vacc_status_3way", "event_type AS variant", "value AS ec50")


def _with_user_columns(df: DataFrame) -> DataFrame:
    named = df.selectExpr(
        "*", "CASE WHEN user_id % 8 < 4 THEN 'f' ELSE 'm' END AS sex", "CAST(user_id % 106 AS INT) AS age",
        "CASE user_id % 4 WHEN 1 THEN 'uninfected' WHEN 2 THEN 'inf_bef_2022' WHEN 3 THEN 'inf_2022' END AS inf_latest",
        "CASE user_id % 3 WHEN 0 THEN 'No vacc' WHEN 1 THEN 'Dose 1 or 2 only' ELSE 'Boosted' END AS vacc_status_3way")
    return named.withColumns({
        "age_cat_10y": cut("age", fx.AGE_BREAKS_10Y), "age_cat_UEP": cut("age", fx.AGE_BREAKS)})


#: Names of all variants of the panel, as they are stored.
PANEL_VARIANTS = ("click", "error", "purchase", "signup", "view")


def panel(spark: SparkSession, sf_dir: str, age_scheme: str = "age_cat_UEP") -> DataFrame:
    return prepare_panel(raw_panel(spark, sf_dir), age_scheme)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per panel user."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return _with_user_columns(users).withColumnsRenamed({"user_id": "uid", "age_cat_UEP": "age_cat"})


def vaccination_by_age(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark, fx.VACCINATION_BY_AGE,
        "age_cat string, vacc_status_3way string, pop_total double, strata_total double, percentage double")


def coverage(spark: SparkSession) -> DataFrame:
    """External vaccination coverage keyed by sex and age."""
    return literal_table(
        spark, [(s, a, c) for s in fx.SEX_LEVELS for a, c in fx.COVERAGE_BY_AGE],
        "Sex string, age_cat string, coverage double")


def coverage_percent(spark: SparkSession) -> DataFrame:
    """External vaccination coverage of report categories, in percent."""
    return literal_table(spark, fx.COVERAGE_PERCENT, "val string, pc_coverage double")


def sero_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serology model draws, wide: each is set by the mean discount and tax of its order lines."""
    ids = table(spark, sf_dir, "lineitem").groupBy(F.expr(f"l_orderkey % {N_DRAWS}").alias("sim")).agg(F.expr(
        "(4 * sum(CAST(round(l_discount * 100) AS BIGINT)) + 3 * sum(CAST(round(l_tax * 100) AS BIGINT))) / count(*)").alias("u"))
    coefficients = []
    for i, term in enumerate(SERO_DESIGN.terms):
        coefficients.append(f"{-0.5 if i == 0 else 0.0}D + 0.4D * sin(u + {i}) AS `inf:{term}`")
        coefficients.append(f"{0.8 if i == 0 else 0.0}D + 0.5D * cos(u + {i}) AS `vacc:{term}`")
    return ids.selectExpr(
        "sim", *coefficients,
        "0.5D + 0.25D * sin(u + 3) AS sigma_inf", "0.4D + 0.2D * cos(u + 3) AS sigma_vacc",
        "0.1D + 0.05D * cos(u) AS resp_sn_np", "0.2D + 0.1D * sin(u) AS resp_sp_nn",
        "0.9D + 0.05D * sin(u) AS vacc_response",
        "0.95D + 0.02D * sin(u) AS sens_s", "0.98D + 0.01D * cos(u) AS spec_s",
        "0.9D + 0.03D * cos(u) AS sens_n", "0.97D + 0.01D * sin(u) AS spec_n")


def panel_draws(spark: SparkSession, sf_dir: str, design: Design) -> DataFrame:
    """Threshold model draws, wide, by variant: each is set by the mean value of its events."""
    return model_draws(spark, sf_dir, {"": design})


def model_draws(spark: SparkSession, sf_dir: str, designs: Mapping[str, Design]) -> DataFrame:
    """Draws of several models side by side, the coefficients of each under its prefix."""
    ids = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("fit_id"), F.expr(f"event_id % {N_DRAWS}").alias("sim")).agg(
        F.expr("sum(CAST(floor(value) AS BIGINT)) / count(value)").alias("u"))
    return ids.selectExpr(
        "fit_id", "sim",
        *[f"0.3D * sin(u + {i} + length(fit_id)) AS `{p}{t}`" for p, design in designs.items() for i, t in enumerate(design.terms)],
        "0.95D + 0.03D * sin(u) AS sens", "0.97D + 0.02D * cos(u) AS spec",
        "0.9D + 0.03D * cos(u) AS sens_child", "0.96D + 0.02D * sin(u) AS spec_child",
        "0.5D + 0.25D * sin(u + 3) AS sigma_od")
