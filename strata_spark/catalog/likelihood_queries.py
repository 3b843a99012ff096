"""Likelihood queries over collapsed cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata_spark import fixed_values as fx
from strata_spark.catalog.draws_queries import _ETA, _ST, _nodes_sql
from strata_spark.catalog.registry import VIEWS, panel_draws_sql, query, sql_logistic, sql_predictor, sql_values
from strata_spark.catalog.strata_queries import FACTORS, SETS, split
from strata_spark.functions.levels import PANEL_AGE_10Y
from strata_spark.operators import cohort as co
from strata_spark.operators import fit as ft
from strata_spark.operators import likelihood as lk
from strata_spark.operators.design import MODELS, model_design
from strata_spark.operators.draws import quadrature, score_strata, spread, widen
from strata_spark.operators.poststrat import label_estimates, poststratify_sets
from strata_spark.operators.summary import posterior_summary
from strata_spark.sources import views as v

PRIOR = dict(fx.OTHER_INFECTION_PRIOR)
OD_NODES = 8
CELL_OBS = ["fit_id", "age_cat", "sex", "inf_latest", "vacc_status_3way", "child", "y"]


def cells(spark, d):
    return lk.panel_cells(v.panel(spark, d)).withColumnRenamed("variant", "fit_id")


DESIGNS = {**MODELS, "additive_10y": model_design("additive", "age_cat_10y")}
PRIOR_10Y = lk.flat_prior(PANEL_AGE_10Y)


def _mass(q: str) -> str:
    return f"CASE WHEN y = 1 THEN ln(greatest({q}, 1e-12)) ELSE ln(greatest(1 - ({q}), 1e-12)) END"


def _seen(model: str, swap: str | None, child: bool = False, od: bool = False) -> str:
    """Probability of a positive result; with ``od`` averaged over an observation effect."""
    eta = sql_predictor(DESIGNS[model], "", "d", {"inf_latest": f"'{swap}'"} if swap else None)
    sens = "(CASE WHEN child THEN sens_child ELSE sens END)" if child else "sens"
    spec = "(CASE WHEN child THEN spec_child ELSE spec END)" if child else "spec"
    p = sql_logistic(eta) if not od else "(" + " + ".join(
        f"{w!r} * {sql_logistic(f'{eta} + sigma_od * {z!r}')}" for z, w in quadrature(OD_NODES)) + ")"
    return f"({sens} * {p} + (1 - {spec}) * (1 - {p}))"


def _pointwise(model: str, child: bool = False, od: bool = False) -> str:
    lp = [f"ln(prior_before) + {_mass(_seen(model, 'inf_bef_2022', child, od))}",
          f"ln(1 - prior_before) + {_mass(_seen(model, 'inf_2022', child, od))}"]
    mix = f"ln(exp({lp[0]}) + exp({lp[1]}))"
    return f"""SELECT d.fit_id, d.sim, c.age_cat, c.sex, c.inf_latest, c.vacc_status_3way, c.child, c.y, c.n,
 CASE WHEN inf_latest IS NULL THEN {mix} ELSE {_mass(_seen(model, None, child, od))} END AS log_lik
 FROM draws_{model} d JOIN cells c ON d.fit_id = c.fit_id JOIN age_prior USING (age_cat)"""


VIEWS.update({
    "cells": ("""SELECT variant AS fit_id, age_cat, sex, inf_latest, vacc_status_3way, age < 12 AS child,
 CASE WHEN ec50_thresh THEN 1 ELSE 0 END AS y, count(*) AS n FROM panel GROUP BY ALL""", ("panel",)),
    "ll_additive": (_pointwise("additive"), ("draws_additive", "cells", "age_prior")),
    "ll_interaction": (_pointwise("interaction"), ("draws_interaction", "cells", "age_prior")),
    "ll_od": (_pointwise("additive", od=True), ("draws_additive", "cells", "age_prior")),
    "ll_od_interaction": (_pointwise("interaction", od=True), ("draws_interaction", "cells", "age_prior")),
    "ll_child": (_pointwise("additive", True), ("draws_additive", "cells", "age_prior")),
})


def pointwise(spark, d, model="additive", **options):
    return lk.pointwise_loglik(v.panel_draws(spark, d, MODELS[model]), cells(spark, d), MODELS[model], PRIOR, **options)


ALL_MODELS = {
    f"{outcome}-{name}": lk.Model(MODELS[name], f"{name}:", sigma)
    for outcome, sigma in (("thresh", None), ("thresh_od", "sigma_od")) for name in ("additive", "interaction")}


def all_models(spark, d):
    """Log-likelihood of all four models from one pass over draws and cells."""
    draws = v.model_draws(spark, d, {f"{name}:": MODELS[name] for name in MODELS})
    return lk.models_loglik(draws, cells(spark, d), ALL_MODELS, PRIOR, n_nodes=OD_NODES)


VIEWS.update({
    "cells_10y": (VIEWS["cells"][0].replace("FROM panel", "FROM panel_10y"), ("panel_10y",)),
    "age_prior_10y": (f"SELECT * FROM (VALUES {sql_values(PRIOR_10Y.items())}) v(age_cat, prior_before)", ()),
    "draws_additive_10y": (panel_draws_sql(DESIGNS["additive_10y"]), ()),
    "ll_10y": (_pointwise("additive_10y").replace("JOIN cells c", "JOIN cells_10y c").replace("JOIN age_prior", "JOIN age_prior_10y"),
               ("draws_additive_10y", "cells_10y", "age_prior_10y")),
})


@query("loglik_10y", "SELECT fit_id, sim, sum(n * log_lik) AS log_lik FROM ll_10y GROUP BY fit_id, sim", ["ll_10y"], ["log_lik"])
def loglik_10y(spark, d):
    """Log-likelihood by draw under the 10-year age scheme, with the flat prior of its levels."""
    design = DESIGNS["additive_10y"]
    collapsed = lk.panel_cells(v.panel(spark, d, "age_cat_10y")).withColumnRenamed("variant", "fit_id")
    return lk.loglik_by_draw(lk.pointwise_loglik(v.panel_draws(spark, d, design), collapsed, design, PRIOR_10Y))


@query("panel_cells", "SELECT * FROM cells", ["cells"])
def collapsed_panel(spark, d):
    return cells(spark, d)


@query("prior_lookup", """SELECT fit_id, age_cat, y, CAST(sum(n) AS BIGINT) AS n, max(ln(prior_before)) AS log_before,
 max(ln(1 - prior_before)) AS log_late FROM cells JOIN age_prior USING (age_cat) WHERE inf_latest IS NULL
 GROUP BY fit_id, age_cat, y""", ["cells", "age_prior"], ["log_before", "log_late"])
def prior_lookup(spark, d):
    before, late = lk.scenario_prior(F.col("age_cat"), PRIOR)
    undated = cells(spark, d).where(F.col("inf_latest").isNull())
    return undated.groupBy("fit_id", "age_cat", "y").agg(F.sum("n").alias("n")).withColumn(
        "log_before", before).withColumn("log_late", late)


@query("misclass_prob", f"""SELECT d.fit_id, d.sim, c.age_cat, c.sex, c.inf_latest, c.vacc_status_3way, c.child, c.y, c.n,
 {_seen('additive', None, True)} AS q FROM draws_additive d JOIN cells c ON d.fit_id = c.fit_id WHERE inf_latest IS NOT NULL""",
       ["draws_additive", "cells"], ["q"])
def misclass_prob(spark, d):
    dated = cells(spark, d).where(F.col("inf_latest").isNotNull())
    draws = v.panel_draws(spark, d, MODELS["additive"])
    joined = spread(draws, "sim").join(dated, "fit_id")
    return joined.withColumn("_eta", F.expr(MODELS["additive"].predictor())).select(
        "fit_id", "sim", *[c for c in dated.columns if c != "fit_id"], lk.positive_probability("_eta", True).alias("q"))


@query("pointwise_loglik", "SELECT * FROM ll_additive", ["ll_additive"], ["log_lik"])
def pointwise_loglik(spark, d):
    return pointwise(spark, d)


@query("pointwise_loglik_child", "SELECT fit_id, sim, sum(n * log_lik) AS log_lik FROM ll_child GROUP BY fit_id, sim",
       ["ll_child"], ["log_lik"])
def pointwise_loglik_child(spark, d):
    return lk.loglik_by_draw(pointwise(spark, d, by_child=True))


@query("pointwise_loglik_od", "SELECT fit_id, sim, sum(n * log_lik) AS log_lik FROM ll_od GROUP BY fit_id, sim",
       ["ll_od"], ["log_lik"])
def pointwise_loglik_od(spark, d):
    """Overdispersed model: an effect per observation, integrated out."""
    return lk.loglik_by_draw(pointwise(spark, d, sigma="sigma_od", n_nodes=OD_NODES))


@query("mixture_loglik", """SELECT fit_id, sim, age_cat, sum(n * log_lik) AS log_lik, CAST(sum(n) AS BIGINT) AS n FROM ll_additive
 WHERE inf_latest IS NULL GROUP BY fit_id, sim, age_cat""", ["ll_additive"], ["log_lik"])
def mixture_loglik(spark, d):
    undated = cells(spark, d).where(F.col("inf_latest").isNull())
    ll = lk.pointwise_loglik(v.panel_draws(spark, d, MODELS["additive"]), undated, MODELS["additive"], PRIOR)
    return ll.groupBy("fit_id", "sim", "age_cat").agg(
        F.sum(F.col("n") * F.col("log_lik")).alias("log_lik"), F.sum("n").alias("n"))


@query("loglik_by_draw", "SELECT fit_id, sim, sum(n * log_lik) AS log_lik FROM ll_additive GROUP BY fit_id, sim",
       ["ll_additive"], ["log_lik"])
def loglik_by_draw(spark, d):
    return lk.loglik_by_draw(pointwise(spark, d))


def _theta(s: int, n: int) -> str:
    """Observed probability of one joint result from the four true ones."""
    def side(hit: str, miss: str, want: int) -> tuple[str, str]:
        return (hit, f"(1 - {miss})") if want else (f"(1 - {hit})", miss)

    sp, sn = side("sens_s", "spec_s", s)
    np_, nn = side("sens_n", "spec_n", n)
    return f"({sp} * {np_} * sp_np + {sn} * {np_} * sn_np + {sp} * {nn} * sp_nn + {sn} * {nn} * sn_nn)"


_CHOSEN = f"""CASE WHEN s_result = 1 AND n_result = 1 THEN {_theta(1, 1)} WHEN s_result = 0 AND n_result = 1 THEN {_theta(0, 1)}
 WHEN s_result = 1 THEN {_theta(1, 0)} ELSE {_theta(0, 0)} END"""


@query("joint_loglik", f"""SELECT sim, sum(n * ln(greatest({_CHOSEN}, 1e-12))) AS ll_status,
 sum(n * ln(CASE WHEN vaccinated = 1 THEN q ELSE 1 - q END)) AS ll_vacc FROM (SELECT *, {_ST} FROM (
 SELECT d.*, c.*, {sql_logistic(_ETA['inf'])} AS p, {sql_logistic(_ETA['vacc'])} AS q, vaccinated * vacc_response AS pv
 FROM sero_draws d CROSS JOIN (SELECT age_cat, Sex, vaccinated, s_result, n_result, count(*) AS n FROM cohort GROUP BY ALL) c) x) y
 GROUP BY sim""", ["sero_draws", "cohort"], ["ll_status", "ll_vacc"])
def joint_loglik(spark, d):
    c = co.collapse_cells(co.prepare_cohort(v.raw_cohort(spark, d)), lk.SERO_CELL)
    return lk.joint_loglik(v.sero_draws(spark, d), c, v.SERO_DESIGN)


@query("household_loglik", f"""SELECT sim, sum(ll) AS ll_household FROM (
 SELECT sim, hh_id, max(l) + ln(sum(exp(l - top))) AS ll FROM (
 SELECT sim, hh_id, ln(w) + ll AS l, max(ln(w) + ll) OVER (PARTITION BY sim, hh_id) AS top FROM (
 SELECT sim, hh_id, w, sum(n * ln(greatest(theta, 1e-12))) AS ll FROM
 (SELECT hh_id, age_cat, Sex, vaccinated, s_result, n_result, count(*) AS n FROM cohort GROUP BY ALL) c JOIN (
 SELECT sim, age_cat, Sex, vaccinated, s_result, n_result, w, {_CHOSEN} AS theta FROM (SELECT *, {_ST} FROM (
 SELECT e.*, {sql_logistic('eta + sigma_inf * z')} AS p, vaccinated * vacc_response AS pv, z, w FROM (
 SELECT d.*, age_cat, Sex, vaccinated, s_result, n_result, {_ETA['inf']} AS eta FROM sero_draws d CROSS JOIN (
 SELECT DISTINCT age_cat, Sex, vaccinated, s_result, n_result FROM cohort) k) e CROSS JOIN {_nodes_sql(5)}) f) h) t
 USING (age_cat, Sex, vaccinated, s_result, n_result) GROUP BY sim, hh_id, w, z_of(w)) u) o GROUP BY sim, hh_id) r GROUP BY sim
 """.replace(", z_of(w)", ", zz").replace("SELECT sim, hh_id, w, sum(n", "SELECT sim, hh_id, w, zz, sum(n").replace(
    "n_result, w, CASE WHEN s_result = 1 AND", "n_result, w, z AS zz, CASE WHEN s_result = 1 AND"), ["sero_draws", "cohort"], ["ll_household"])
def household_loglik(spark, d):
    cohort = co.prepare_cohort(v.raw_cohort(spark, d))
    return lk.household_loglik(v.sero_draws(spark, d), cohort, v.SERO_DESIGN, "sigma_inf", 5)


def _household_ll(mass: str, eta: str, sigma: str, n: int, name: str) -> str:
    """Per draw: sum over households of the log of the integral of the members' masses, at ``n`` nodes."""
    return f"""SELECT sim, sum(top + ln(total)) AS {name} FROM (SELECT sim, hh_id, max(l) AS top, sum(exp(l - best)) AS total FROM (
 SELECT *, max(l) OVER (PARTITION BY sim, hh_id) AS best FROM (
 SELECT t.sim, c.hh_id, t.z, ln(max(t.w)) + sum(c.n * t.mass) AS l FROM hh_members c JOIN (
 SELECT sim, age_cat, Sex, vaccinated, s_result, n_result, z, w, {mass} AS mass FROM (SELECT *, {_ST} FROM (
 SELECT e.*, {sql_logistic(f'eta + {sigma} * z')} AS p, vaccinated * vacc_response AS pv, z, w FROM (
 SELECT d.*, age_cat, Sex, vaccinated, s_result, n_result, {eta} AS eta FROM sero_draws d CROSS JOIN hh_cells) e
 CROSS JOIN {_nodes_sql(n)}) f) h) t ON c.age_cat = t.age_cat AND c.Sex = t.Sex AND c.vaccinated = t.vaccinated
 AND c.s_result = t.s_result AND c.n_result = t.n_result GROUP BY t.sim, c.hh_id, t.z) u) o GROUP BY sim, hh_id) r GROUP BY sim"""


_HH_STATUS = (f"ln(greatest({_CHOSEN}, 1e-12))", _ETA["inf"], "sigma_inf")
_HH_VACC = ("CASE WHEN vaccinated = 1 THEN ln(greatest(p, 1e-12)) ELSE ln(greatest(1 - p, 1e-12)) END", _ETA["vacc"], "sigma_vacc")
HOUSEHOLD_NODES = 6
VIEWS.update({
    "hh_members": ("""SELECT hh_id, age_cat, Sex, vaccinated, s_result, n_result, count(*) AS n FROM cohort
 WHERE s_result IS NOT NULL AND n_result IS NOT NULL AND vaccinated IS NOT NULL AND age_cat IS NOT NULL AND Sex IS NOT NULL
 GROUP BY ALL""", ("cohort",)),
    "hh_cells": ("SELECT DISTINCT age_cat, Sex, vaccinated, s_result, n_result FROM hh_members", ("hh_members",)),
    **{f"hh_{kind}_{k}": (_household_ll(*terms, HOUSEHOLD_NODES * k, f"ll{k}"), ("sero_draws", "hh_members", "hh_cells"))
       for kind, terms in (("status", _HH_STATUS), ("vacc", _HH_VACC)) for k in (1, 2)},
})


@query("household_loglik_both", """SELECT a.sim, b.ll2 AS ll_household, d.ll2 AS ll_vaccination, abs(b.ll2 - a.ll1) AS error_household,
 abs(d.ll2 - c.ll1) AS error_vaccination FROM hh_status_1 a JOIN hh_status_2 b USING (sim) JOIN hh_vacc_1 c USING (sim)
 JOIN hh_vacc_2 d USING (sim)""", ["hh_status_1", "hh_status_2", "hh_vacc_1", "hh_vacc_2"],
       ["ll_household", "ll_vaccination", "error_household", "error_vaccination"])
def household_loglik_both(spark, d):
    """Both household effects, with what doubling the nodes changes."""
    cohort = co.prepare_cohort(v.raw_cohort(spark, d))
    return lk.household_loglik(v.sero_draws(spark, d), cohort, v.SERO_DESIGN, "sigma_inf", HOUSEHOLD_NODES,
                               sigma_vaccination="sigma_vacc", check=True)


@query("household_compositions", """SELECT n_cells, count(*) AS n_hh, CAST(sum(members) AS BIGINT) AS members FROM (
 SELECT hh_id, count(*) AS n_cells, sum(n) AS members FROM (
 SELECT hh_id, age_cat, Sex, vaccinated, s_result, n_result, count(*) AS n FROM cohort GROUP BY ALL) x GROUP BY hh_id) y
 GROUP BY n_cells""", ["cohort"])
def household_compositions(spark, d):
    comps = lk.household_compositions(co.prepare_cohort(v.raw_cohort(spark, d)))
    members = F.aggregate("comp.n", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return comps.groupBy(F.size("comp").cast("bigint").alias("n_cells")).agg(
        F.sum("n_hh").alias("n_hh"), F.sum(F.col("n_hh") * members).alias("members"))


@query("fit_map")
def fit_map(spark, d):
    return ft.fit_mode(cells(spark, d), MODELS["additive"], PRIOR)


@query("fitted_poststrat")
def fitted_poststrat(spark, d):
    """From panel to estimates without imported draws: fit, draw, score, post-stratify, summarise."""
    design = MODELS["additive"]
    draws = widen(ft.fit_draws(cells(spark, d), design, PRIOR, n_draws=400), design.terms)
    scored = score_strata(draws, split(spark, d), design, FACTORS, "strata_size_final", ("fit_id", "sim"), name="p")
    estimates = posterior_summary(poststratify_sets(scored, SETS, ("fit_id", "sim")), ["fit_id", "postrat_name"])
    return label_estimates(estimates.withColumnRenamed("fit_id", "variant"))


@query("fit_draws_summary")
def fit_draws_summary(spark, d):
    draws = ft.fit_draws(cells(spark, d), MODELS["additive"], PRIOR, n_draws=400)
    return draws.groupBy("fit_id", "term").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev("value").alias("sd"))


