"""Strata, weights, reallocation, subsets and post-stratification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata_spark import fixed_values as fx
from strata_spark.catalog.draws_queries import _ETA, _GRID, SCORE_VIEWS
from strata_spark.catalog.registry import (
    VIEWS, panel_draws_sql, query, sql_interval, sql_logistic, sql_ordinal, sql_predictor, sql_text, sql_values)
from strata_spark.functions.levels import AGE, INFECTION, PANEL_AGE, PANEL_SEX, SEX, VACCINATION
from strata_spark.functions.scalars import interval_text
from strata_spark.operators import cohort as co
from strata_spark.operators import draws as dr
from strata_spark.operators import poststrat as ps
from strata_spark.operators import strata as st
from strata_spark.operators.design import MODELS
from strata_spark.operators.likelihood import panel_cells
from strata_spark.operators.summary import posterior_summary
from strata_spark.plans import report as rp
from strata_spark.sources import views as v

FACTORS = (PANEL_AGE, PANEL_SEX, INFECTION, VACCINATION)
SPECS = ps.subset_specs(FACTORS, [(INFECTION, VACCINATION)])
SETS = ((), ("age_cat",), ("sex",), ("inf_latest",), ("vacc_status_3way",), ("inf_latest", "vacc_status_3way"))


def _specs_sql() -> str:
    rows = []
    for i, spec in enumerate(SPECS, 1):
        expr = " AND ".join(f"{k} = {sql_text(x)}" for k, x in spec.items())
        name = "&".join(f"{k}:{x.replace(' ', '')}" for k, x in spec.items())
        hit = " AND ".join(f"{k} = {sql_text(x)}" for k, x in spec.items())
        rows.append(f"SELECT {i} AS subset_id, {sql_text(expr)} AS expr, {sql_text(name)} AS postrat_name, "
                    f"\"row\" FROM split WHERE {hit}")
    return " UNION ALL ".join(rows)


_SUM_OF = "sum(CASE WHEN inf_latest = '{}' THEN strata_size ELSE 0e0 END)"
_REALLOC = """SELECT {{s}}age_cat, vacc_status_3way, inf_latest, strata_size, pc_ratio,
 CASE inf_latest WHEN 'inf_2022' THEN late WHEN 'inf_bef_2022' THEN least(fresh * (1 - share), n_tot - late)
 ELSE n_tot - late - least(fresh * (1 - share), n_tot - late) END AS strata_size_new FROM (
 SELECT *, least(fresh * share, n_tot) AS late FROM (
 SELECT {{s}}w.*, r.pc_ratio, g.n_tot, g.old_inf * r.pc_ratio AS fresh, coalesce(g.old_late / nullif(g.old_inf, 0), 0) AS share
 FROM weights w JOIN {{r}} r USING (age_cat) JOIN (
 SELECT age_cat, vacc_status_3way, sum(strata_size) AS n_tot, {l} AS old_late, {b} + {l} AS old_inf FROM weights
 GROUP BY age_cat, vacc_status_3way) g USING (age_cat, vacc_status_3way)) x) y""".format(
    b=_SUM_OF.format("inf_bef_2022"), l=_SUM_OF.format("inf_2022"))
VIEWS.update({
    "inf_shares": ("""SELECT vacc_status_3way, inf_latest, age_cat, count(*) AS n,
 CAST(sum(count(*)) OVER (PARTITION BY vacc_status_3way, age_cat) AS BIGINT) AS total_per_vacc,
 count(*) * 1e2 / sum(count(*)) OVER (PARTITION BY vacc_status_3way, age_cat) AS pc_inf_per_vacc
 FROM truth WHERE inf_latest IS NOT NULL AND age_cat IS NOT NULL AND vacc_status_3way IS NOT NULL
 GROUP BY vacc_status_3way, inf_latest, age_cat""", ("truth",)),
    "known_weights": ("""SELECT age_cat, vacc_status_3way, inf_latest, pc_inf_per_vacc / 1e2 * pop_total * percentage / 1e2 AS strata_size
 FROM inf_shares FULL JOIN vacc_by_age USING (age_cat, vacc_status_3way)
 WHERE pc_inf_per_vacc IS NOT NULL AND pop_total IS NOT NULL AND inf_latest IS NOT NULL""", ("inf_shares", "vacc_by_age")),
    "weights": ("""SELECT a.age_cat, b.vacc_status_3way, c.inf_latest, coalesce(k.strata_size, 0e0) AS strata_size
 FROM (SELECT DISTINCT age_cat FROM known_weights) a, (SELECT DISTINCT vacc_status_3way FROM known_weights) b,
 (SELECT DISTINCT inf_latest FROM known_weights) c LEFT JOIN known_weights k
 ON k.age_cat = a.age_cat AND k.vacc_status_3way = b.vacc_status_3way AND k.inf_latest = c.inf_latest""", ("known_weights",)),
    "sero_scored": (f"SELECT sim, age_cat, Sex, strata_pop, {sql_logistic(_ETA['inf'])} AS seropos FROM {_GRID}", tuple(SCORE_VIEWS)),
    "external_inf": ("""SELECT age_cat, 1e2 * sum(seropos * strata_pop) / sum(strata_pop) AS pc_inf_external
 FROM sero_scored GROUP BY age_cat""", ("sero_scored",)),
    "ratios": ("""SELECT age_cat, n_uninfected, n_inf_before, n_inf_2022, n_total, n_inf_before + n_inf_2022 AS n_infected,
 (1 - n_uninfected / nullif(n_total, 0)) * 1e2 AS pc_inf_sample, n_inf_2022 / nullif(n_inf_before + n_inf_2022, 0) AS pc_2022,
 pc_inf_external, CASE WHEN n_inf_before + n_inf_2022 > 0 THEN coalesce(pc_inf_external / nullif((1 - n_uninfected / nullif(n_total, 0)) * 1e2, 0), 1e0) ELSE 1e0 END AS pc_ratio,
 NOT (n_inf_before + n_inf_2022 > 0) AS no_change FROM (
 SELECT age_cat, {u} AS n_uninfected, {b} AS n_inf_before, {l} AS n_inf_2022, sum(strata_size) AS n_total FROM weights GROUP BY age_cat) x
 JOIN external_inf USING (age_cat)""".format(u=_SUM_OF.format("uninfected"), b=_SUM_OF.format("inf_bef_2022"), l=_SUM_OF.format("inf_2022")),
               ("weights", "external_inf")),
    "external_by_draw": ("""SELECT sim, age_cat, 1e2 * sum(seropos * strata_pop) / sum(strata_pop) AS pc_inf_external
 FROM sero_scored GROUP BY sim, age_cat""", ("sero_scored",)),
    "ratios_by_draw": ("""SELECT sim, age_cat, CASE WHEN n_infected > 0 THEN coalesce(e.pc_inf_external / nullif(pc_inf_sample, 0), 1e0)
 ELSE 1e0 END AS pc_ratio FROM external_by_draw e JOIN ratios USING (age_cat)""", ("external_by_draw", "ratios")),
    "realloc": (_REALLOC.format(r="ratios", s=""), ("weights", "ratios")),
    "realloc_draws": (_REALLOC.format(r="ratios_by_draw", s="sim, "), ("weights", "ratios_by_draw")),
    "split": (f"""SELECT r.*, s.sex, strata_size_new / 2 AS strata_size_final,
 'sex' || s.sex || ':age_cat' || age_cat || ':inf_latest' || inf_latest || ':vacc' || vacc_status_3way AS full_cat,
 CAST(row_number() OVER (ORDER BY s.k, {sql_ordinal(AGE, 'age_cat')}, {sql_ordinal(VACCINATION, 'vacc_status_3way')},
 {sql_ordinal(INFECTION, 'inf_latest')}) AS INT) AS "row" FROM realloc r, (VALUES ('m', 0), ('f', 1)) s(sex, k)""", ("realloc",)),
    "draws_additive": (panel_draws_sql(MODELS["additive"]), ()),
    "draws_interaction": (panel_draws_sql(MODELS["interaction"]), ()),
    "post_scored": (f"""SELECT fit_id, sim, age_cat, sex, inf_latest, vacc_status_3way, strata_size_final, "row",
 {sql_logistic(sql_predictor(MODELS['additive']))} AS p FROM draws_additive CROSS JOIN split""", ("draws_additive", "split")),
})
VIEWS["members"] = (_specs_sql(), ("split",))
VIEWS["post_sets"] = ("""SELECT fit_id, sim, CASE
 WHEN GROUPING(age_cat) = 0 THEN 'age_cat:' || age_cat WHEN GROUPING(sex) = 0 THEN 'sex:' || sex
 WHEN GROUPING(inf_latest) = 0 AND GROUPING(vacc_status_3way) = 0
 THEN 'inf_latest:' || inf_latest || '&vacc_status_3way:' || replace(vacc_status_3way, ' ', '')
 WHEN GROUPING(inf_latest) = 0 THEN 'inf_latest:' || inf_latest
 WHEN GROUPING(vacc_status_3way) = 0 THEN 'vacc_status_3way:' || replace(vacc_status_3way, ' ', '') ELSE 'all' END AS postrat_name,
 sum(p * strata_size_final) / nullif(sum(strata_size_final), 0) AS p FROM post_scored
 GROUP BY GROUPING SETS ((fit_id, sim), (fit_id, sim, age_cat), (fit_id, sim, sex), (fit_id, sim, inf_latest),
 (fit_id, sim, vacc_status_3way), (fit_id, sim, inf_latest, vacc_status_3way))""", ("post_scored",))


@query("pop_strata", "SELECT * FROM pop_strata", ["pop_strata"], ["strata_pop", "percent"])
def pop_strata(spark, d):
    return st.population_strata(v.census(spark, d))


@query("strata_in_sample", """SELECT * FROM pop_strata WHERE age_cat IN (SELECT age_cat FROM cohort WHERE n_result = 1)
 AND Sex IN (SELECT Sex FROM cohort WHERE n_result = 1)""", ["pop_strata", "cohort"], ["strata_pop", "percent"])
def strata_in_sample(spark, d):
    sample = co.prepare_cohort(v.raw_cohort(spark, d)).where(F.col("n_result") == 1)
    return st.strata_in_sample(pop_strata(spark, d), sample, (AGE, SEX))


@query("infection_shares", "SELECT * FROM inf_shares", ["inf_shares"], ["pc_inf_per_vacc"])
def infection_shares(spark, d):
    return st.infection_shares(v.truth(spark, d))


@query("strata_literal_join", """SELECT age_cat, vacc_status_3way, pop_total, percentage, count(uid) AS n FROM vacc_by_age
 LEFT JOIN truth USING (age_cat, vacc_status_3way) GROUP BY ALL""", ["vacc_by_age", "truth"], ["pop_total", "percentage"])
def strata_literal_join(spark, d):
    keys = ["age_cat", "vacc_status_3way"]
    counts = co.collapse_cells(v.truth(spark, d), keys)
    return counts.join(v.vaccination_by_age(spark), keys, "right").select(
        *keys, "pop_total", "percentage", F.coalesce("n", F.lit(0)).alias("n"))


@query("complete_strata", """SELECT a.age_cat, b.vacc_status_3way, c.inf_latest, coalesce(k.n, 0) AS n
 FROM (SELECT DISTINCT age_cat FROM inf_shares) a, (SELECT DISTINCT vacc_status_3way FROM inf_shares) b,
 (SELECT DISTINCT inf_latest FROM inf_shares) c LEFT JOIN inf_shares k ON k.age_cat = a.age_cat
 AND k.vacc_status_3way = b.vacc_status_3way AND k.inf_latest = c.inf_latest""", ["inf_shares"])
def complete_strata(spark, d):
    keys = list(st.WEIGHT_KEYS)
    return st.complete(infection_shares(spark, d).select(*keys, "n"), keys, {"n": 0})


def weights(spark, d):
    return st.strata_weights(v.truth(spark, d), v.vaccination_by_age(spark))


@query("strata_weights", "SELECT * FROM weights", ["weights"], ["strata_size"])
def strata_weights(spark, d):
    return weights(spark, d)


@query("strata_group_totals", """SELECT *, sum(CASE WHEN inf_latest <> 'uninfected' THEN strata_size ELSE 0e0 END) OVER w AS n_inf_sample,
 sum(strata_size) OVER w AS n_tot_sample FROM weights WINDOW w AS (PARTITION BY age_cat, vacc_status_3way)""", ["weights"],
       ["strata_size", "n_inf_sample", "n_tot_sample"])
def strata_group_totals(spark, d):
    return st.with_group_totals(weights(spark, d))


def external_infection(spark, d):
    scored = dr.score_strata(v.sero_draws(spark, d), pop_strata(spark, d), v.SERO_DESIGN, (AGE, SEX), "strata_pop", prefix="inf:")
    return st.pooled_mean(scored, ["age_cat"], "seropos", "strata_pop", "pc_inf_external").withColumn(
        "pc_inf_external", F.col("pc_inf_external") * 100.0)


@query("pooled_infection", "SELECT * FROM external_inf", ["external_inf"], ["pc_inf_external"])
def pooled_infection(spark, d):
    return external_infection(spark, d)


RATIO_DOUBLES = ["n_uninfected", "n_inf_before", "n_inf_2022", "n_total", "n_infected", "pc_inf_sample", "pc_2022",
                 "pc_inf_external", "pc_ratio"]


def ratios(spark, d):
    return st.infection_ratio(weights(spark, d), external_infection(spark, d))


@query("infection_ratio", "SELECT * FROM ratios", ["ratios"], RATIO_DOUBLES)
def infection_ratio(spark, d):
    return ratios(spark, d)


def reallocated(spark, d):
    return st.reallocate(weights(spark, d), external_infection(spark, d))


@query("realloc_strata", "SELECT * FROM realloc", ["realloc"], ["strata_size", "pc_ratio", "strata_size_new"])
def realloc_strata(spark, d):
    return reallocated(spark, d)


@query("realloc_by_draw", """SELECT age_cat, vacc_status_3way, inf_latest, avg(strata_size_new) AS mean,
 quantile_cont(strata_size_new, 0.025e0) AS q025, quantile_cont(strata_size_new, 0.975e0) AS q975 FROM realloc_draws
 GROUP BY age_cat, vacc_status_3way, inf_latest""", ["realloc_draws"], ["mean", "q025", "q975"])
def realloc_by_draw(spark, d):
    """Reallocation that keeps the uncertainty of the external share, as an interval per stratum."""
    sizes = st.reallocate(weights(spark, d), external_by_draw(spark, d), by_draw=True)
    return posterior_summary(sizes, st.WEIGHT_KEYS, "strata_size_new")


def external_by_draw(spark, d):
    """External infection share by age, one for each draw of the serology model."""
    scored = dr.score_strata(v.sero_draws(spark, d), pop_strata(spark, d), v.SERO_DESIGN, (AGE, SEX), "strata_pop", prefix="inf:")
    return st.pooled_mean(scored, ["sim", "age_cat"], "seropos", "strata_pop", "pc_inf_external").withColumn(
        "pc_inf_external", F.col("pc_inf_external") * 100.0)


_BY_DRAW = f"""SELECT d.fit_id, r.sim, r.age_cat, s.sex, r.inf_latest, r.vacc_status_3way, r.strata_size_new / 2 AS strata_size_final,
 {sql_logistic(sql_predictor(MODELS['additive']))} AS p FROM draws_additive d JOIN realloc_draws r ON d.sim = r.sim
 CROSS JOIN (VALUES ('m'), ('f')) s(sex)"""
VIEWS["draw_scored"] = (_BY_DRAW, ("draws_additive", "realloc_draws"))
VIEWS["draw_sets"] = (VIEWS["post_sets"][0].replace("post_scored", "draw_scored"), ("draw_scored",))


@query("poststrat_by_draw", """SELECT fit_id, postrat_name, avg(p) AS mean, quantile_cont(p, 0.025e0) AS q025, quantile_cont(p, 0.975e0) AS q975
 FROM draw_sets GROUP BY fit_id, postrat_name""", ["draw_sets"], ["mean", "q025", "q975"])
def poststrat_by_draw(spark, d):
    """Estimates whose intervals carry the uncertainty of the external share: each draw is weighted by its own sizes."""
    sizes = st.reallocate(weights(spark, d), external_by_draw(spark, d), by_draw=True)
    strata = st.split_by_sex(sizes, PANEL_AGE, VACCINATION, by=("sim",))
    draws = v.panel_draws(spark, d, MODELS["additive"])
    scored = dr.score_strata_by_draw(draws, strata, MODELS["additive"], FACTORS, "strata_size_final", ("fit_id", "sim"), name="p")
    return posterior_summary(ps.poststratify_sets(scored, SETS, ("fit_id", "sim")), ["fit_id", "postrat_name"])


def split(spark, d):
    return st.split_by_sex(reallocated(spark, d), PANEL_AGE, VACCINATION)


@query("split_strata", """SELECT age_cat, vacc_status_3way, inf_latest, sex, strata_size_new, strata_size_final, "row" FROM split""",
       ["split"], ["strata_size_new", "strata_size_final"])
def split_strata(spark, d):
    return split(spark, d).select(
        "age_cat", "vacc_status_3way", "inf_latest", "sex", "strata_size_new", "strata_size_final", "row")


@query("full_category", 'SELECT "row", full_cat FROM split', ["split"])
def full_category(spark, d):
    return split(spark, d).select("row", "full_cat")


@query("subset_map", "SELECT * FROM members", ["members"])
def subset_map(spark, d):
    return ps.subset_members(split(spark, d), SPECS)


@query("subset_offsets", """SELECT subset_id, postrat_name, n, CAST(sum(n) OVER (ORDER BY subset_id) - n + 1 AS BIGINT) AS first,
 CAST(sum(n) OVER (ORDER BY subset_id) AS BIGINT) AS last FROM (
 SELECT subset_id, postrat_name, count(*) AS n FROM members GROUP BY subset_id, postrat_name) x""", ["members"])
def subset_offsets(spark, d):
    return ps.subset_offsets(ps.subset_members(split(spark, d), SPECS))


def post_scored(spark, d, model="additive"):
    draws = v.panel_draws(spark, d, MODELS[model])
    return dr.score_strata(draws, split(spark, d), MODELS[model], FACTORS, "strata_size_final", ("fit_id", "sim"), name="p")


@query("poststrat_grouping_sets", "SELECT * FROM post_sets", ["post_sets"], ["p"])
def poststrat_grouping_sets(spark, d):
    return ps.poststratify_sets(post_scored(spark, d), SETS, ("fit_id", "sim"))


@query("poststrat_bridge", """SELECT fit_id, sim, subset_id, postrat_name,
 sum(p * strata_size_final) / nullif(sum(strata_size_final), 0) AS p FROM post_scored JOIN members USING ("row")
 GROUP BY fit_id, sim, subset_id, postrat_name""", ["post_scored", "members"], ["p"])
def poststrat_bridge(spark, d):
    return ps.poststratify_subsets(post_scored(spark, d), SPECS, ("fit_id", "sim"))


VIEWS["post_labels"] = ("""SELECT fit_id AS variant, postrat_name, CASE WHEN postrat_name = 'all' THEN 'all'
 WHEN contains(postrat_name, 'age') THEN 'age_cat' WHEN contains(postrat_name, 'sex') THEN 'sex'
 WHEN contains(postrat_name, '&') THEN 'inf_latest:vacc_status_3way' ELSE split_part(postrat_name, ':', 1) END AS var_cat,
 CASE WHEN postrat_name = 'all' THEN 'all' WHEN contains(postrat_name, '&')
 THEN replace(replace(replace(postrat_name, 'inf_latest:', ''), 'vacc_status_3way:', ''), '&', ':')
 ELSE substr(postrat_name, strpos(postrat_name, ':') + 1) END AS var, mean, q025, q975 FROM (
 SELECT fit_id, postrat_name, avg(p) AS mean, quantile_cont(p, 0.025e0) AS q025, quantile_cont(p, 0.975e0) AS q975
 FROM post_sets GROUP BY fit_id, postrat_name) x""", ("post_sets",))


def post_labels(spark, d):
    p = ps.poststratify_sets(post_scored(spark, d), SETS, ("fit_id", "sim"))
    summary = posterior_summary(p.withColumnRenamed("fit_id", "variant"), ["variant", "postrat_name"])
    return ps.label_estimates(summary)


@query("subset_labels", "SELECT * FROM post_labels", ["post_labels"], ["mean", "q025", "q975"])
def subset_labels(spark, d):
    return post_labels(spark, d)


REPORT_VARIANTS = ("click", "view")
_TAGS = """SELECT {k}, 'all' AS var_cat, 'all' AS var FROM {t} UNION ALL SELECT {k}, 'sex', sex FROM {t}
 UNION ALL SELECT {k}, 'age_cat', age_cat FROM {t} WHERE age_cat IS NOT NULL
 UNION ALL SELECT {k}, 'inf_latest', inf_latest FROM {t} WHERE inf_latest IS NOT NULL
 UNION ALL SELECT {k}, 'vacc_status_3way', replace(vacc_status_3way, ' ', '') FROM {t}
 UNION ALL SELECT {k}, 'inf_latest:vacc_status_3way', inf_latest || ':' || replace(vacc_status_3way, ' ', '') FROM {t}
 WHERE inf_latest IS NOT NULL"""
VIEWS["observed"] = (f"""SELECT variant, var_cat, var, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos FROM (
 {_TAGS.format(k="variant, CASE WHEN ec50_thresh THEN 1 ELSE 0 END AS y", t="panel")}) x GROUP BY variant, var_cat, var""", ("panel",))
VIEWS["sizes"] = (f"SELECT var_cat, var, count(*) AS n FROM ({_TAGS.format(k='uid', t='truth')}) x GROUP BY var_cat, var", ("truth",))


@query("observed_positives", "SELECT *, n_pos * 1e2 / n AS pc_pos FROM observed", ["observed"], ["pc_pos"])
def observed_positives(spark, d):
    return rp.observed_positives(panel_cells(v.panel(spark, d))).withColumn("pc_pos", F.col("n_pos") * 100.0 / F.col("n"))


def _picks(c: str, txt: str) -> str:
    return ", ".join(f"max(CASE WHEN variant = '{x}' THEN {txt} END) AS {c}_{x}" for x in REPORT_VARIANTS)


VIEWS["wide_report"] = (f"""SELECT variable, label, s.n, {', '.join(f'obs_{x}, est_{x}' for x in REPORT_VARIANTS)}, variable_ord, label_ord
 FROM (SELECT var_cat, var, {_picks('obs', 'obs')}, {_picks('est', 'est')} FROM (
 SELECT variant, var_cat, var, CAST(n_pos AS VARCHAR) || ' (' || CAST(CAST(CAST(n_pos * 1e2 / n AS DECIMAL(18,6)) AS DECIMAL(18,1)) AS VARCHAR) || '%)' AS obs,
 {sql_interval('mean', 'q025', 'q975', 1, '100e0')} AS est FROM observed JOIN post_labels USING (variant, var_cat, var)) t
 GROUP BY var_cat, var) w JOIN sizes s USING (var_cat, var)
 JOIN (VALUES {sql_values([(k, x, i) for i, (k, x) in enumerate(fx.VARIABLE_LABELS)])}) a(var_cat, variable, variable_ord) USING (var_cat)
 JOIN (VALUES {sql_values([(k, x, i) for i, (k, x) in enumerate(fx.LEVEL_LABELS)])}) b(var, label, label_ord) USING (var)""",
                        ("observed", "post_labels", "sizes"))


def wide_report(spark, d):
    cells = panel_cells(v.panel(spark, d))
    people = v.truth(spark, d).select(F.explode(rp.member_tags()).alias("_t"))
    sizes = people.groupBy("_t.var_cat", "_t.var").agg(F.count(F.lit(1)).alias("n"))
    return rp.variant_report(rp.observed_positives(cells), post_labels(spark, d), sizes, REPORT_VARIANTS)


@query("report_wide", "SELECT * FROM wide_report", ["wide_report"])
def report_wide(spark, d):
    return wide_report(spark, d).orderBy("label_ord")


@query("grouped_headers", """SELECT variable, label, n, obs_click, est_click, obs_view, est_view, variable_ord, label_ord, FALSE AS is_header
 FROM wide_report UNION ALL SELECT DISTINCT variable, CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR),
 CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), variable_ord, -1, TRUE FROM wide_report""", ["wide_report"])
def grouped_headers(spark, d):
    return rp.with_group_headers(wide_report(spark, d), "variable", "variable_ord", "label_ord").orderBy("variable_ord", "label_ord")


@query("headline", f"""SELECT variant, var_cat, var, n, n_pos, mean, q025, q975, {sql_interval('mean', 'q025', 'q975', 1, '100e0')} AS txt
 FROM post_labels LEFT JOIN observed USING (variant, var_cat, var)""", ["post_labels", "observed"], ["mean", "q025", "q975"])
def headline(spark, d):
    """Neutralization by variant and population subset with observed counts: the whole second half in one query."""
    observed = rp.observed_positives(panel_cells(v.panel(spark, d)))
    e = post_labels(spark, d).drop("postrat_name").join(observed, ["variant", "var_cat", "var"], "left")
    return e.withColumn("txt", interval_text(F.col("mean"), F.col("q025"), F.col("q975"), 1, 100.0))
