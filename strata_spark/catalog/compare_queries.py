"""Model comparison queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from strata_spark import fixed_values as fx
from strata_spark.catalog.likelihood_queries import CELL_OBS, all_models, pointwise
from strata_spark.catalog.registry import VIEWS, query
from strata_spark.operators import compare as cp

OBS = ["age_cat", "sex", "inf_latest", "vacc_status_3way", "child", "y"]
_OBS = "fit_id, age_cat, sex, inf_latest, vacc_status_3way, child, y, n"


def _waic(model: str) -> str:
    return f"""SELECT {_OBS}, ln(avg(exp(log_lik))) AS lppd, var_samp(log_lik) AS p_eff,
 ln(avg(exp(log_lik))) - var_samp(log_lik) AS elpd FROM ll_{model} GROUP BY {_OBS}"""


_SPREAD = "sqrt(greatest(sum(n) * (sum(n * {0} * {0}) - sum(n * {0}) * sum(n * {0}) / sum(n)) / (sum(n) - 1), 0))"
VIEWS.update({
    "waic_additive": (_waic("additive"), ("ll_additive",)),
    "waic_interaction": (_waic("interaction"), ("ll_interaction",)),
    "waic_all": ("""SELECT *, 'thresh-additive' AS model_id FROM waic_additive
 UNION ALL SELECT *, 'thresh-interaction' FROM waic_interaction""", ("waic_additive", "waic_interaction")),
    "totals": (f"""SELECT fit_id, model_id, CAST(sum(n) AS BIGINT) AS n_obs, sum(n * elpd) AS elpd, {_SPREAD.format('elpd')} AS se_elpd,
 sum(n * p_eff) AS p_eff, {_SPREAD.format('p_eff')} AS se_p_eff FROM waic_all GROUP BY fit_id, model_id""", ("waic_all",)),
    "compared": (f"""SELECT t.*, elpd_diff, se_diff, -2 * elpd AS ic, 2 * se_elpd AS se_ic,
 CAST(row_number() OVER (PARTITION BY fit_id ORDER BY elpd_diff DESC, model_id) AS INT) AS rank FROM totals t JOIN (
 SELECT fit_id, model_id, sum(n * g) AS elpd_diff, {_SPREAD.format('g')} AS se_diff FROM (
 SELECT a.fit_id, a.model_id, a.n, a.elpd - b.elpd AS g FROM waic_all a JOIN waic_all b ON a.fit_id = b.fit_id
 AND a.age_cat = b.age_cat AND a.sex = b.sex AND a.inf_latest IS NOT DISTINCT FROM b.inf_latest
 AND a.vacc_status_3way = b.vacc_status_3way AND a.child = b.child AND a.y = b.y JOIN (
 SELECT fit_id, arg_max(model_id, elpd) AS best_id FROM totals GROUP BY fit_id) k ON k.fit_id = b.fit_id AND k.best_id = b.model_id) x
 GROUP BY fit_id, model_id) y USING (fit_id, model_id)""", ("totals", "waic_all")),
})
DOUBLES = ["elpd", "se_elpd", "p_eff", "se_p_eff", "elpd_diff", "se_diff", "ic", "se_ic"]


@query("waic", "SELECT * FROM waic_additive", ["waic_additive"], ["lppd", "p_eff", "elpd"])
def waic(spark, d):
    return cp.waic_pointwise(pointwise(spark, d), CELL_OBS)


@query("is_loo", f"""SELECT {_OBS}, ln(avg(exp(log_lik))) AS lppd, -ln(avg(exp(-log_lik))) AS elpd,
 ln(avg(exp(log_lik))) + ln(avg(exp(-log_lik))) AS p_eff FROM ll_additive GROUP BY {_OBS}""", ["ll_additive"], ["lppd", "elpd", "p_eff"])
def is_loo(spark, d):
    return cp.is_loo_pointwise(pointwise(spark, d), CELL_OBS)


_CELL = "concat_ws('|', fit_id, age_cat, sex, coalesce(inf_latest, '-'), vacc_status_3way, child, y)"


def _psis(ll: str) -> dict:
    """Smoothed leave-one-out over the view ``ll``, one relation a step: draws in order, tail, grid, shape, weights."""
    return {
        f"{ll}_ranked": (f"""SELECT *, CAST(floor(least(2e-1 * s, 3 * sqrt(s))) AS BIGINT) AS m FROM (
 SELECT *, {_CELL} AS cell, row_number() OVER (PARTITION BY {_CELL} ORDER BY log_lik) AS rk,
 count(*) OVER (PARTITION BY {_CELL}) AS s, min(log_lik) OVER (PARTITION BY {_CELL}) AS lo,
 max(log_lik) OVER (PARTITION BY {_CELL}) AS hi FROM {ll}) x""", (ll,)),
        f"{ll}_tail": (f"""SELECT cell, m, m - rk + 1 AS i, log_lik AS x, lo, exp(lo - cut) AS c, exp(lo - log_lik) - exp(lo - cut) AS e FROM (
 SELECT *, max(CASE WHEN rk = m + 1 THEN log_lik END) OVER (PARTITION BY cell) AS cut FROM {ll}_ranked) x WHERE rk <= m""", (f"{ll}_ranked",)),
        f"{ll}_smooth": (f"""SELECT cell, m, max(e) AS top, max(CASE WHEN i = CAST(floor(m / 4e0 + 5e-1) AS BIGINT) THEN e END) AS quarter,
 30 + CAST(floor(sqrt(m)) AS BIGINT) AS g FROM {ll}_tail GROUP BY cell, m HAVING m >= 5 AND min(e) > 0""", (f"{ll}_tail",)),
        f"{ll}_grid": (f"""SELECT cell, m, b, m * (ln(-b / k) - k - 1) AS fit FROM (SELECT g.cell, g.m, b, avg(ln(1 - b * e)) AS k FROM (
 SELECT cell, m, j, 1 / top + (1 - sqrt(g / (j - 5e-1))) / (3 * quarter) AS b FROM (
 SELECT *, unnest(range(1, g + 1)) AS j FROM {ll}_smooth) x) g JOIN {ll}_tail t ON g.cell = t.cell GROUP BY g.cell, g.m, j, b) y""",
                       (f"{ll}_smooth", f"{ll}_tail")),
        f"{ll}_shape": (f"""SELECT cell, raw, (m * raw + 5) / (m + 10) AS k, -raw / b AS scale FROM (SELECT b.cell, b.m, b, avg(ln(1 - b * e)) AS raw FROM (
 SELECT cell, m, sum(b * exp(fit - best)) / sum(exp(fit - best)) AS b FROM (
 SELECT *, max(fit) OVER (PARTITION BY cell) AS best FROM {ll}_grid) x GROUP BY cell, m) b JOIN {ll}_tail t ON b.cell = t.cell
 GROUP BY b.cell, b.m, b) y""", (f"{ll}_grid", f"{ll}_tail")),
        f"{ll}_weights": (f"""SELECT r.*, least(CASE WHEN rk <= r.m AND k IS NOT NULL THEN ln(c + scale * CASE WHEN abs(k) > 1e-12
 THEN (exp(-k * ln(1 - (i - 5e-1) / r.m)) - 1) / k ELSE -ln(1 - (i - 5e-1) / r.m) END) ELSE r.lo - log_lik END, 0) AS w,
 CASE WHEN k IS NOT NULL THEN k WHEN r.m >= 5 THEN CAST('-inf' AS DOUBLE) ELSE CAST('inf' AS DOUBLE) END AS pareto_k
 FROM {ll}_ranked r LEFT JOIN {ll}_shape h ON r.cell = h.cell LEFT JOIN {ll}_tail t ON r.cell = t.cell AND rk = r.m - i + 1""",
                          (f"{ll}_ranked", f"{ll}_shape", f"{ll}_tail")),
        f"{ll}_psis": (f"""SELECT {{keys}}, lppd, elpd, pareto_k, lppd - elpd AS p_eff FROM (SELECT {{keys}}, pareto_k,
 max(hi) + ln(avg(exp(log_lik - hi))) AS lppd, max(lo) + ln(sum(exp(w + log_lik - lo))) - ln(sum(exp(w))) AS elpd
 FROM {ll}_weights GROUP BY {{keys}}, pareto_k) x""".replace("{keys}", _OBS), (f"{ll}_weights",)),
    }


VIEWS.update(_psis("ll_additive"))


@query("psis_loo", "SELECT * FROM ll_additive_psis", ["ll_additive_psis"], ["lppd", "elpd", "pareto_k", "p_eff"])
def psis_loo(spark, d):
    return cp.psis_loo_pointwise(pointwise(spark, d), CELL_OBS)


def all_pointwise(spark, d, models=("additive", "interaction")):
    parts = [
        cp.waic_pointwise(pointwise(spark, d, m), CELL_OBS).withColumn("model_id", F.lit(f"thresh-{m}")) for m in models]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("model_compare", "SELECT * FROM compared", ["compared"], DOUBLES)
def model_compare(spark, d):
    return cp.compare_models(all_pointwise(spark, d), OBS, ["fit_id"])


@query("model_rank", f"""SELECT c.*, row_number() OVER (PARTITION BY fit_id ORDER BY
 CASE WHEN elpd_diff = 0 OR abs(elpd_diff) < se_diff * 1.9e0 THEN 0 ELSE 1 END,
 CASE model_id {' '.join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(fx.MODEL_COMPLEXITY))} END, rank) = 1 AS best FROM compared c""",
       ["compared"], DOUBLES)
def model_rank(spark, d):
    return cp.select_best_model(cp.compare_models(all_pointwise(spark, d), OBS, ["fit_id"]), ["fit_id"])


_FOUR = {"thresh-additive": "ll_additive", "thresh-interaction": "ll_interaction", "thresh_od-additive": "ll_od",
         "thresh_od-interaction": "ll_od_interaction"}
for _ll in _FOUR.values():
    VIEWS.update(_psis(_ll))
VIEWS["loo_all"] = (" UNION ALL ".join(f"SELECT *, '{m}' AS model_id FROM {ll}_psis" for m, ll in _FOUR.items()),
                    tuple(f"{ll}_psis" for ll in _FOUR.values()))
VIEWS["loo_totals"] = (VIEWS["totals"][0].replace("waic_all", "loo_all"), ("loo_all",))
VIEWS["loo_compared"] = (VIEWS["compared"][0].replace("waic_all", "loo_all").replace("totals", "loo_totals"), ("loo_totals", "loo_all"))


@query("model_choice", f"""SELECT c.*, row_number() OVER (PARTITION BY fit_id ORDER BY
 CASE WHEN elpd_diff = 0 OR abs(elpd_diff) < se_diff * 1.9e0 THEN 0 ELSE 1 END,
 CASE model_id {' '.join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(fx.MODEL_COMPLEXITY))} END, rank) = 1 AS best FROM loo_compared c""",
       ["loo_compared"], DOUBLES)
def model_choice(spark, d):
    """The simplest of four models that is not clearly worse than the best, by smoothed leave-one-out, in one pass."""
    accuracy = cp.psis_loo_pointwise(all_models(spark, d), ["model_id", *CELL_OBS])
    return cp.select_best_model(cp.compare_models(accuracy, OBS, ["fit_id"]), ["fit_id"])
