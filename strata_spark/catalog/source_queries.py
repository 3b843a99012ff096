"""Source and sink queries: written to the shared work folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata_spark.catalog import draws_queries as dq
from strata_spark.catalog.likelihood_queries import cells
from strata_spark.catalog.registry import query, sql_cut
from strata_spark import fixed_values as fx
from strata_spark.functions.levels import cut
from strata_spark.operators import cohort as co
from strata_spark.operators.likelihood import SERO_CELL
from strata_spark.session import work_path
from strata_spark.sources import tables as tb
from strata_spark.sources import views as v
from strata_spark.sources.results import ResultStore

_SERO = f"""SELECT CAST(uid AS VARCHAR) AS uid, CAST(hh_id AS VARCHAR) AS hh_id, sex, age,
 {sql_cut('age', fx.AGE_BREAKS_10Y)} AS age_cat_10y, {sql_cut('age', fx.AGE_BREAKS)} AS "age_cat_UEP",
 S_interp, N_interp, vaccinated FROM raw_cohort"""


def sero_file(spark, d):
    return v.raw_cohort(spark, d).select(
        F.col("uid").cast("string").alias("uid"), F.col("hh_id").cast("string").alias("hh_id"), "sex", "age",
        cut("age", fx.AGE_BREAKS_10Y).alias("age_cat_10y"), cut("age", fx.AGE_BREAKS).alias("age_cat_UEP"),
        "S_interp", "N_interp", "vaccinated")


@query("csv_scan", _SERO, ["raw_cohort"])
def csv_scan(spark, d):
    path = work_path(spark, "sero_csv")
    tb.write_csv(sero_file(spark, d), path)
    return tb.read_csv(spark, path, tb.SERO_SCHEMA)


@query("csv_panel_scan", """SELECT CAST(uid AS VARCHAR) AS uid, sex, age, age_cat_10y, age_cat AS "age_cat_UEP", variant, ec50,
 inf_latest, vacc_status_3way FROM panel""", ["panel"], ["ec50"])
def csv_panel_scan(spark, d):
    path = work_path(spark, "panel_csv")
    p = v.raw_panel(spark, d).select(
        F.col("uid").cast("string").alias("uid"), "sex", "age", "age_cat_10y", "age_cat_UEP", "variant", "ec50",
        "inf_latest", "vacc_status_3way")
    tb.write_csv(p, path)
    return tb.read_csv(spark, path, tb.PANEL_SCHEMA)


@query("csv_census_scan", "SELECT Age, Sex, Total FROM census", ["census"], ["Total"])
def csv_census_scan(spark, d):
    path = work_path(spark, "census_csv")
    tb.write_csv(v.census(spark, d).select("Age", "Sex", "Total"), path)
    return tb.read_csv(spark, path, tb.CENSUS_SCHEMA, comment="#")


@query("parquet_roundtrip", "SELECT * FROM cohort", ["cohort"])
def parquet_roundtrip(spark, d):
    path = work_path(spark, "cohort")
    tb.write_parquet(co.prepare_cohort(v.raw_cohort(spark, d)), path)
    return tb.read_parquet(spark, path)


@query("json_roundtrip", """SELECT fit_id, age_cat, sex, inf_latest, vacc_status_3way, child, y, n, 0e0 AS mu_alpha, 1e0 AS sd_beta
 FROM cells""", ["cells"], ["mu_alpha", "sd_beta"])
def json_roundtrip(spark, d):
    path = work_path(spark, "model_input")
    tb.write_model_input(cells(spark, d), path, {"mu_alpha": 0.0, "sd_beta": 1.0})
    return tb.read_model_input(
        spark, path, "fit_id string, age_cat string, sex string, inf_latest string, vacc_status_3way string, "
        "child boolean, y int, n bigint, mu_alpha double, sd_beta double")


@query("partitioned_roundtrip", """SELECT fit_id AS variant, 'additive' AS model, 'age_cat_uep' AS age_scheme, age_cat, sex,
 CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY fit_id, age_cat, sex""", ["cells"])
def partitioned_roundtrip(spark, d):
    path = work_path(spark, "results")
    sums = cells(spark, d).groupBy(F.col("fit_id").alias("variant"), "age_cat", "sex").agg(F.sum("n").alias("n"))
    named = sums.withColumn("model", F.lit("additive")).withColumn("age_scheme", F.lit("age_cat_uep"))
    tb.write_parquet(named, path, ["variant", "model", "age_scheme"])
    return tb.read_parquet(spark, path).select("variant", "model", "age_scheme", "age_cat", "sex", "n")


@query("parse_result_name", """SELECT path, CASE WHEN k = 0 THEN 'additive' ELSE 'interaction' END AS model_type,
 CASE WHEN big THEN 'thresh_od' ELSE 'thresh' END AS outcome_type, variant, 'age_cat_uep' AS age_scheme, count(*) AS n FROM (
 SELECT 'data/neut_out_' || CASE WHEN big THEN 'thresh_od' ELSE 'thresh' END || CASE WHEN k = 0 THEN '_additive_' ELSE '_interaction_' END
 || variant || '_age_cat_uep.rds' AS path, k, big, variant FROM (
 SELECT obs_id % 2 AS k, ec50_thresh AS big, variant FROM panel) x) y GROUP BY ALL""", ["panel"])
def parse_result_name(spark, d):
    p = v.panel(spark, d)
    name = tb.result_name(
        F.when(F.col("ec50_thresh"), "thresh_od").otherwise("thresh"),
        F.when(F.col("obs_id") % 2 == 0, "additive").otherwise("interaction"), F.col("variant"), F.lit("age_cat_uep"))
    paths = p.select(F.concat(F.lit("data/neut_out_"), name, F.lit(".rds")).alias("path"))
    parsed = tb.parse_result_name(F.col("path"))
    return paths.groupBy("path").agg(F.count(F.lit(1)).alias("n")).select(
        "path", *[c.alias(k) for k, c in parsed.items()], "n")


@query("collapse_roundtrip", """SELECT age_cat, Sex, vaccinated, s_result, n_result, count(*) AS n FROM cohort GROUP BY ALL""", ["cohort"])
def collapse_roundtrip(spark, d):
    """Stage hand-off: collapsed cells written once and read by later jobs."""
    path = work_path(spark, "cells")
    tb.write_parquet(co.collapse_cells(co.prepare_cohort(v.raw_cohort(spark, d)), SERO_CELL), path)
    return tb.read_parquet(spark, path)


@query("result_store", """SELECT fit_id AS variant, 'additive' AS model, 'age_cat_uep' AS age_scheme, age_cat, sex,
 CAST(sum(n) AS BIGINT) * CASE WHEN fit_id = 'click' THEN 2 ELSE 1 END AS n FROM cells
 WHERE fit_id <> 'view' AND (fit_id <> 'click' OR sex = 'f') GROUP BY fit_id, age_cat, sex""", ["cells"])
def result_store(spark, d):
    """Results by name: missing ones are filled in, one is replaced, the others stay, and a name picks folders."""
    store = ResultStore(spark, work_path(spark, "store"))
    sums = cells(spark, d).groupBy(F.col("fit_id").alias("variant"), "age_cat", "sex").agg(F.sum("n").alias("n")).withColumns(
        {"model": F.lit("additive"), "age_scheme": F.lit("age_cat_uep")})

    def only(names):
        return sums.where(F.col("variant").isin(*[n[0] for n in names]))

    store.write(only([("click",), ("view",)]))
    store.fill([(x, "additive", "age_cat_uep") for x in v.PANEL_VARIANTS], only)
    store.write(only([("click",)]).where("sex = 'f'").withColumn("n", F.col("n") * 2))
    kept = [x for x in v.PANEL_VARIANTS if x != "view"]
    return store.read(variant=kept, model="additive").select("variant", "model", "age_scheme", "age_cat", "sex", "n")


def _through_csv(spark, df, name):
    path = work_path(spark, name)
    tb.write_csv(df, path)
    return tb.read_csv(spark, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))


@query("report_csv", dq.REPORT_SQL, dq.REPORT_VIEWS)
def report_csv(spark, d):
    """The final report as a CSV table; its order is the column ``ord``."""
    return _through_csv(spark, dq.final_report(spark, d), "report")


@query("risk_csv", *dq.RISK_SQL)
def risk_csv(spark, d):
    """Relative risks of three measures as a CSV table."""
    return _through_csv(spark, dq.seroprevalence_risk(spark, d), "risks")
