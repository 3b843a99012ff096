"""Cohort and panel queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strata_spark import fixed_values as fx
from strata_spark.catalog.registry import VIEWS, query, sql_count_percent, sql_cut, sql_values
from strata_spark.functions.levels import (
    AGE, INFECTION, PANEL_AGE, PANEL_SEX, SEX, VACCINATION, choose, cut, level_table)
from strata_spark.functions.scalars import count_percent_text, flatten_text
from strata_spark.operators import cohort as co
from strata_spark.operators.checks import Checks
from strata_spark.operators.design import MODELS, Design, design_rows, model_design, scenario_rows
from strata_spark.operators.likelihood import SERO_CELL
from strata_spark.operators.numbering import index_keys, number_by_id
from strata_spark.plans.report import category_rank, variants_of_interest
from strata_spark.session import work_path
from strata_spark.sources import views as v

COUNT_SQL = """count(*) AS n, CAST(sum(s_result) AS BIGINT) AS pos_s, CAST(count(*) - sum(s_result) AS BIGINT) AS neg_s,
 CAST(sum(n_result) AS BIGINT) AS pos_n, CAST(count(*) - sum(n_result) AS BIGINT) AS neg_n,
 CAST(sum(vaccinated) AS BIGINT) AS vacc"""


def cohort(spark, d):
    return co.prepare_cohort(v.raw_cohort(spark, d))


@query("cut_bins", f"""SELECT uid, age, {sql_cut('age', fx.AGE_BREAKS)} AS age_cat,
 {sql_cut('age', fx.AGE_BREAKS_10Y)} AS age_cat_10y FROM raw_cohort""", ["raw_cohort"])
def cut_bins(spark, d):
    return v.raw_cohort(spark, d).select(
        "uid", "age", cut("age", fx.AGE_BREAKS).alias("age_cat"), cut("age", fx.AGE_BREAKS_10Y).alias("age_cat_10y"))


@query("recode_levels", """SELECT uid, CASE sex WHEN 'f' THEN 'Female' WHEN 'm' THEN 'Male' END AS Sex,
 CASE sex WHEN 'f' THEN 1 WHEN 'm' THEN 2 END AS sex_code FROM raw_cohort""", ["raw_cohort"])
def recode_levels(spark, d):
    sex = choose(F.col("sex"), co.SEX_NAMES)
    return v.raw_cohort(spark, d).select("uid", sex.alias("Sex"), SEX.codes(sex).alias("sex_code"))


@query("binary_results", "SELECT uid, s_result, n_result, vaccinated FROM cohort", ["cohort"])
def binary_results(spark, d):
    return cohort(spark, d).select("uid", "s_result", "n_result", "vaccinated")


@query("cohort_prepared", "SELECT * FROM cohort", ["cohort"])
def cohort_prepared(spark, d):
    return cohort(spark, d)


@query("cohort_checks", """SELECT count(*) AS n_rows,
 count(*) FILTER (WHERE s_result IS NULL OR s_result NOT IN (0, 1)) AS bad_s_result,
 count(*) FILTER (WHERE n_result IS NULL OR n_result NOT IN (0, 1)) AS bad_n_result,
 count(*) FILTER (WHERE age_cat IS NULL) AS bad_age_cat, count(*) FILTER (WHERE Sex IS NULL) AS bad_sex,
 count(*) FILTER (WHERE vaccinated IS NULL) AS bad_vaccinated FROM cohort""", ["cohort"])
def cohort_checks(spark, d):
    return co.failure_counts(cohort(spark, d), co.cohort_rules())


_RULES = ("bad_s_result", "bad_n_result", "bad_age_cat", "bad_sex", "bad_vaccinated")


@query("observed_checks", "SELECT rule, CAST(n AS BIGINT) AS n FROM (" + " UNION ALL ".join(f"SELECT '{r}' AS rule, {e} AS n FROM cohort" for r, e in {
    "n_rows": "count(*)", "bad_s_result": "count(*) FILTER (WHERE s_result IS NULL OR s_result NOT IN (0, 1))",
    "bad_n_result": "count(*) FILTER (WHERE n_result IS NULL OR n_result NOT IN (0, 1))",
    "bad_age_cat": "count(*) FILTER (WHERE age_cat IS NULL)", "bad_sex": "count(*) FILTER (WHERE Sex IS NULL)",
    "bad_vaccinated": "count(*) FILTER (WHERE vaccinated IS NULL)"}.items()) + ") x", ["cohort"])
def observed_checks(spark, d):
    """Rules counted by the job that writes the cohort, without a pass of their own."""
    checks = Checks()
    co.prepare_cohort(v.raw_cohort(spark, d), checks=checks).write.parquet(work_path(spark, "cohort"))
    counts = checks.counts()["cohort"]
    return spark.createDataFrame([(r, int(counts[r])) for r in ("n_rows", *_RULES)], "rule string, n bigint")


@query("level_table", """SELECT * FROM (
 SELECT 'age_cat' AS var, a.label, a.ordinal, a.label = '[25,35)' AS is_ref
 FROM (VALUES {ages}) a(label, ordinal) WHERE a.label IN (SELECT age_cat FROM cohort)
 UNION ALL SELECT 'Sex', s.label, s.ordinal, s.label = 'Female'
 FROM (VALUES ('Female', 0), ('Male', 1)) s(label, ordinal) WHERE s.label IN (SELECT Sex FROM cohort)) x
 """.format(ages=sql_values([(x, i) for i, x in enumerate(AGE.labels)])), ["cohort"])
def used_levels(spark, d):
    return level_table(cohort(spark, d), [AGE, SEX])


@query("child_flag", "SELECT child, count(*) AS n FROM (SELECT age < 12 AS child FROM cohort) x GROUP BY child", ["cohort"])
def child_counts(spark, d):
    return cohort(spark, d).groupBy(co.child_flag(F.col("age")).alias("child")).agg(F.count(F.lit(1)).alias("n"))


@query("select_pattern", f"""SELECT d.doc_id AS uid, d.source AS hh_id, CAST(d.n_chars % 106 AS INT) AS age,
 {sql_cut('(d.n_chars % 106)', fx.AGE_BREAKS)} AS age_cat,
 CASE WHEN l.quality = 1 THEN 'pos' ELSE 'neg' END AS S_interp,
 CASE WHEN l.toxic = 1 THEN 'pos' ELSE 'neg' END AS N_interp
 FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def select_pattern(spark, d):
    df = v.labelled_cohort(spark, d).withColumn("age_cat", cut("age", fx.AGE_BREAKS))
    return df.select("uid", "hh_id", *co.columns_like(df, "age", "_interp"))


@query("sample_counts", f"SELECT age_cat, {COUNT_SQL} FROM cohort GROUP BY age_cat", ["cohort"])
def counts_by_age(spark, d):
    return co.sample_counts(cohort(spark, d), "age_cat")


@query("sample_counts_missing", """SELECT age_cat, count(*) AS n,
 count(*) FILTER (WHERE s_result = 1 AND uid % 7 <> 0) AS pos_s, count(*) FILTER (WHERE s_result = 0 AND uid % 7 <> 0) AS neg_s,
 count(*) FILTER (WHERE n_result = 1) AS pos_n, count(*) FILTER (WHERE n_result = 0) AS neg_n,
 count(*) FILTER (WHERE vaccinated = 1) AS vacc FROM cohort GROUP BY age_cat""", ["cohort"])
def counts_with_missing_results(spark, d):
    missing = F.when(F.col("uid") % 7 != 0, F.col("s_result"))
    return co.sample_counts(cohort(spark, d).withColumn("s_result", missing), "age_cat")


@query("sample_counts_rollup", f"""SELECT age_cat, {COUNT_SQL} FROM (
 SELECT age_cat, s_result, n_result, vaccinated FROM cohort
 UNION ALL SELECT 'all', s_result, n_result, vaccinated FROM cohort) x GROUP BY age_cat""", ["cohort"])
def counts_with_total(spark, d):
    return co.sample_counts_with_total(cohort(spark, d), "age_cat")


@query("joint_results", """SELECT age_cat, Sex,
 count(*) FILTER (WHERE s_result = 1 AND n_result = 1) AS sp_np,
 count(*) FILTER (WHERE s_result = 0 AND n_result = 1) AS sn_np,
 count(*) FILTER (WHERE s_result = 1 AND n_result = 0) AS sp_nn,
 count(*) FILTER (WHERE s_result = 0 AND n_result = 0) AS sn_nn FROM cohort GROUP BY age_cat, Sex""", ["cohort"])
def joint_counts(spark, d):
    return co.joint_results(cohort(spark, d), ["age_cat", "Sex"])


@query("count_percent", f"""SELECT age_cat, n, pos_s, pos_n, vacc, {sql_count_percent('pos_s', 'n')} AS pos_s_text,
 {sql_count_percent('pos_n', 'n')} AS pos_n_text, {sql_count_percent('vacc', 'n')} AS vacc_text
 FROM (SELECT age_cat, {COUNT_SQL} FROM cohort GROUP BY age_cat) x""", ["cohort"])
def count_percent(spark, d):
    c = co.sample_counts(cohort(spark, d), "age_cat")
    return c.select("age_cat", "n", "pos_s", "pos_n", "vacc", *[
        count_percent_text(F.col(k), F.col("n")).alias(f"{k}_text") for k in ("pos_s", "pos_n", "vacc")])


@query("collapse_cells", """SELECT age_cat, Sex, vaccinated, s_result, n_result, count(*) AS n FROM cohort
 GROUP BY ALL""", ["cohort"])
def sero_cells(spark, d):
    return co.collapse_cells(cohort(spark, d), SERO_CELL)


@query("household_index", """SELECT hh_id, row_number() OVER (ORDER BY md5(CAST(hh_id AS VARCHAR)), hh_id) AS hh_index
 FROM (SELECT DISTINCT hh_id FROM cohort) x""", ["cohort"])
def household_index(spark, d):
    return index_keys(cohort(spark, d), "hh_id", "hh_index")


@query("report_order", """SELECT val, n, CASE val WHEN 'Male' THEN 1000001 WHEN 'Female' THEN 1000002
 WHEN 'all' THEN 1000003 ELSE CAST(regexp_extract(val, '[0-9]+') AS INT) END AS ord FROM (
 SELECT age_cat AS val, count(*) AS n FROM cohort GROUP BY 1 UNION ALL
 SELECT Sex, count(*) FROM cohort GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM cohort) x""", ["cohort"])
def report_order(spark, d):
    return co.stacked_counts(cohort(spark, d)).select(
        "val", "n", category_rank(F.col("val")).alias("ord")).orderBy("ord")


@query("threshold_flag", "SELECT obs_id, ec50, ec50_thresh FROM panel", ["panel"], ["ec50"])
def threshold_flag(spark, d):
    return v.panel(spark, d).select("obs_id", "ec50", "ec50_thresh")


@query("panel_prepared", """SELECT obs_id, uid, sex, age, age_cat_10y, age_cat, inf_latest, vacc_status_3way,
 variant, ec50, ec50_thresh FROM panel""", ["panel"], ["ec50"])
def panel_prepared(spark, d):
    return v.panel(spark, d)


@query("derive_status", """SELECT uid, CASE WHEN inf_latest IS NULL THEN 'undated'
 WHEN inf_latest = 'uninfected' THEN 'never' ELSE 'dated' END AS infected_when,
 vacc_status_3way <> 'No vacc' AS vaccinated, vacc_status_3way = 'Boosted' AS boosted FROM truth""", ["truth"])
def derive_status(spark, d):
    inf, vacc = F.col("inf_latest"), F.col("vacc_status_3way")
    return v.truth(spark, d).select(
        "uid",
        F.when(inf.isNull(), "undated").when(inf == INFECTION.ref, "never").otherwise("dated").alias("infected_when"),
        (vacc != "No vacc").alias("vaccinated"), (vacc == "Boosted").alias("boosted"))


@query("drop_na_subset", """SELECT uid, age_cat, inf_latest, vacc_status_3way FROM truth
 WHERE inf_latest IS NOT NULL AND vacc_status_3way IS NOT NULL AND age_cat IS NOT NULL""", ["truth"])
def drop_na_subset(spark, d):
    keys = ["age_cat", "inf_latest", "vacc_status_3way"]
    return v.truth(spark, d).select("uid", *keys).dropna(subset=keys)


@query("split_missing", """SELECT variant, inf_latest IS NULL AS undated, count(*) AS n,
 CAST(sum(CASE WHEN ec50_thresh THEN 1 ELSE 0 END) AS BIGINT) AS n_pos FROM panel GROUP BY ALL""", ["panel"])
def split_missing(spark, d):
    return v.panel(spark, d).groupBy("variant", F.col("inf_latest").isNull().alias("undated")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("ec50_thresh").alias("n_pos"))


@query("filter_variant", "SELECT obs_id, uid, variant, ec50 FROM panel WHERE variant = 'click'", ["panel"], ["ec50"])
def filter_variant(spark, d):
    raw = co.filter_variant(v.raw_panel(spark, d), "click", v.PANEL_VARIANTS)
    return co.prepare_panel(raw, "age_cat_UEP").select("obs_id", "uid", "variant", "ec50")


@query("flatten_str", """SELECT n_name AS name, replace(replace(replace(lower(label), chr(10), '_'), '/', '-'), '.', '_') AS slug,
 count(*) AS n FROM (SELECT n_name, n_name || chr(10) || c_mktsegment || '/V.' || CAST(c_nationkey AS VARCHAR) AS label
 FROM customer JOIN nation ON c_nationkey = n_nationkey) x GROUP BY ALL""")
def flatten_str(spark, d):
    c, n = v.table(spark, d, "customer"), v.table(spark, d, "nation")
    label = F.concat("n_name", F.lit("\n"), "c_mktsegment", F.lit("/V."), F.col("c_nationkey").cast("string"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(
        F.col("n_name").alias("name"), flatten_text(label).alias("slug")).agg(F.count(F.lit(1)).alias("n"))


@query("obs_id", """SELECT obs_id AS event_id, variant, row_number() OVER (PARTITION BY variant ORDER BY obs_id) AS obs_id
 FROM panel""", ["panel"])
def obs_id(spark, d):
    p = v.panel(spark, d).select(F.col("obs_id").alias("event_id"), "variant")
    return number_by_id(p, ["variant"], "event_id", "obs_id")


@query("obs_id_missing", """SELECT obs_id AS event_id, variant, row_number() OVER (PARTITION BY variant ORDER BY obs_id) AS obs_id
 FROM (SELECT obs_id, nullif(variant, 'click') AS variant FROM panel) x""", ["panel"])
def obs_id_with_missing_group(spark, d):
    p = v.panel(spark, d).select(F.col("obs_id").alias("event_id"), F.nullif(F.col("variant"), F.lit("click")).alias("variant"))
    return number_by_id(p, ["variant"], "event_id", "obs_id")


@query("voi_filter", """SELECT variant, var_cat, outcome, count(*) AS n FROM (
 SELECT variant, CASE WHEN age < 12 THEN 'child' ELSE 'adult' END AS var_cat,
 CASE WHEN ec50_thresh THEN 'neutralizing' ELSE 'binding' END AS outcome FROM panel) x
 WHERE (variant IN ('click', 'view') OR outcome <> 'neutralizing') AND var_cat IN ('adult') GROUP BY ALL""", ["panel"])
def voi_filter(spark, d):
    p = v.panel(spark, d).select(
        "variant", F.when(co.child_flag(F.col("age")), "child").otherwise("adult").alias("var_cat"),
        F.when(F.col("ec50_thresh"), "neutralizing").otherwise("binding").alias("outcome"))
    return variants_of_interest(p, ["click", "view"], keep_cats=["adult"]).groupBy(
        "variant", "var_cat", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("except_variants", """SELECT DISTINCT variant FROM panel WHERE variant NOT IN
 (SELECT variant FROM panel GROUP BY variant HAVING avg(ec50) > (SELECT avg(ec50) FROM panel))""", ["panel"])
def except_variants(spark, d):
    """Variants without those whose mean is above the overall mean: some are left at every scale."""
    means = v.panel(spark, d).groupBy("variant").agg(F.sum("ec50").alias("s"), F.count("ec50").alias("n"))
    everything = Window.partitionBy(F.lit(1))  # a row for each declared variant
    above = means.where("variant IS NOT NULL").withColumn("mean", F.sum("s").over(everything) / F.sum("n").over(everything)).where(F.col("s") / F.col("n") > F.col("mean"))
    return means.select("variant").join(above.select("variant"), "variant", "left_anti")


def _design_sql(design: Design, scenario: str | None = None) -> str:
    out = []
    for term, pairs in design.parts().items():
        hit = " AND ".join(f"{n} = '{lv}'" for n, lv in pairs) or "TRUE"
        out.append(f'CASE WHEN {hit} THEN 1 ELSE 0 END AS "{term}"')
    return ", ".join(out)


@query("design_additive", f"""SELECT obs_id, variant, {_design_sql(MODELS['additive'])} FROM panel
 WHERE inf_latest IS NOT NULL""", ["panel"])
def design_additive(spark, d):
    dated = v.panel(spark, d).where(F.col("inf_latest").isNotNull())
    return design_rows(dated, MODELS["additive"], ["obs_id", "variant"])


@query("design_interaction", f"""SELECT obs_id, variant, {_design_sql(MODELS['interaction'])} FROM panel
 WHERE inf_latest IS NOT NULL""", ["panel"])
def design_interaction(spark, d):
    dated = v.panel(spark, d).where(F.col("inf_latest").isNotNull())
    return design_rows(dated, MODELS["interaction"], ["obs_id", "variant"])


VIEWS["panel_10y"] = ("SELECT * EXCLUDE (age_cat, age_cat_10y), age_cat_10y AS age_cat FROM panel", ("panel",))


@query("design_10y", f"""SELECT obs_id, variant, {_design_sql(model_design('interaction', 'age_cat_10y'))} FROM panel_10y
 WHERE inf_latest IS NOT NULL""", ["panel_10y"])
def design_10y(spark, d):
    """Interaction terms under the 10-year age scheme."""
    dated = v.panel(spark, d, "age_cat_10y").where(F.col("inf_latest").isNotNull())
    return design_rows(dated, model_design("interaction", "age_cat_10y"), ["obs_id", "variant"])


@query("swap_infection_term", f"""SELECT obs_id, scenario, {_design_sql(MODELS['interaction'])} FROM (
 SELECT p.* EXCLUDE (inf_latest), s.scenario, s.scenario AS inf_latest FROM panel p,
 (VALUES ('inf_bef_2022'), ('inf_2022')) s(scenario) WHERE p.inf_latest IS NULL) x""", ["panel"])
def swap_infection_term(spark, d):
    return scenario_rows(v.panel(spark, d), MODELS["interaction"], ["obs_id"])


@query("panel_expand", """SELECT t.uid, u.variant, t.sex, t.age, t.inf_latest, t.vacc_status_3way
 FROM truth t, (VALUES ('var-a'), ('var-b'), ('var-c')) u(variant)""", ["truth"])
def panel_expand(spark, d):
    variants = F.explode(F.array(*[F.lit(f"var-{x}") for x in "abc"])).alias("variant")
    return v.truth(spark, d).select("uid", variants, "sex", "age", "inf_latest", "vacc_status_3way")


@query("expand_grid", """SELECT a.inf_latest, b.vacc_status_3way FROM
 (SELECT DISTINCT inf_latest FROM panel WHERE inf_latest IS NOT NULL) a,
 (SELECT DISTINCT vacc_status_3way FROM panel WHERE vacc_status_3way IS NOT NULL) b""", ["panel"])
def expand_grid(spark, d):
    # the sets hold declared levels, so one row with two short lists is enough
    sets = v.panel(spark, d).agg(*[F.collect_set(c.name).alias(c.name) for c in (INFECTION, VACCINATION)])
    return sets.select(F.explode("inf_latest").alias("inf_latest"), "vacc_status_3way").select(
        "inf_latest", F.explode("vacc_status_3way").alias("vacc_status_3way"))


PANEL_LEVELS = (PANEL_AGE, PANEL_SEX, INFECTION, VACCINATION)
