"""Queries on scored draws: weighted means, summaries, risks, report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata_spark.catalog.cohort_queries import COUNT_SQL
from strata_spark.catalog.registry import (
    VIEWS, query, sql_count_percent, sql_fixed, sql_interval, sql_logistic, sql_predictor, sql_values)
from strata_spark.functions.levels import AGE, SEX, fan_out
from strata_spark.functions.scalars import interval_text, logistic, logit
from strata_spark import fixed_values as fx
from strata_spark.operators import cohort as co
from strata_spark.operators import convergence as cv
from strata_spark.operators import draws as dr
from strata_spark.operators import poststrat as ps
from strata_spark.operators import risk
from strata_spark.operators import summary as sm
from strata_spark.operators.status import JOINT, any_antibody, observed_status, true_status
from strata_spark.operators.strata import population_strata
from strata_spark.plans import report as rp
from strata_spark.sources import views as v

AGE_REF, SEX_REF = "1998", "Female"
REFS = {"Age": AGE_REF, "Sex": SEX_REF}
MEASURES = ("seropos", "infection", "vaccination", "external")

_COND = """SELECT sim, 'Overall' AS var, '' AS val, {e} AS p FROM scored GROUP BY sim
 UNION ALL SELECT sim, 'Age', age_cat, {e} FROM scored WHERE Sex = 'Female' GROUP BY sim, age_cat
 UNION ALL SELECT sim, 'Sex', Sex, {e} FROM scored WHERE age_cat = '1998' GROUP BY sim, Sex"""
_MARG = """SELECT sim, 'Overall' AS var, '' AS val, {e} AS p FROM scored GROUP BY sim
 UNION ALL SELECT sim, 'Age', age_cat, {e} FROM scored GROUP BY sim, age_cat
 UNION ALL SELECT sim, 'Sex', Sex, {e} FROM scored GROUP BY sim, Sex"""
_MEAN = "sum(seropos * strata_pop) / sum(strata_pop)"
_REF = "((var = 'Age' AND val = '1998') OR (var = 'Sex' AND val = 'Female'))"

VIEWS.update({
    "conditional": (_COND.format(e=_MEAN), ("scored",)),
    "marginal": (_MARG.format(e=_MEAN), ("scored",)),
    "signed": (f"""SELECT m.*, {_REF} AS is_ref, r.p AS p_ref,
 CASE WHEN {_REF.replace('var', 'm.var').replace('val =', 'm.val =')} OR r.p IS NULL THEN NULL WHEN m.p > r.p THEN 1 ELSE -1 END AS coef_sign
 FROM marginal m LEFT JOIN (SELECT sim AS rsim, var AS rvar, p FROM marginal WHERE {_REF}) r
 ON m.sim = r.rsim AND m.var = r.rvar""", ("marginal",)),
        "interval": ("""
 SELECT var, val, lo AS hdci_lo, hi AS hdci_hi FROM (
 SELECT a.var, a.val, a.p AS lo, b.p AS hi,
 row_number() OVER (PARTITION BY a.var, a.val ORDER BY round(b.p - a.p, 10), a.p) AS k
 FROM sorted a JOIN sorted b ON a.var = b.var AND a.val = b.val AND b.i = a.i + CAST(floor(0.95e0 * a.n) AS BIGINT)) x
 WHERE k = 1""", ("sorted",)),
    "sorted": ("""SELECT var, val, p, row_number() OVER (PARTITION BY var, val ORDER BY p) AS i,
 count(*) OVER (PARTITION BY var, val) AS n FROM marginal""", ("marginal",)),
    "shipped_counts": (f"""SELECT 'Age' AS var, age_cat AS val, {COUNT_SQL} FROM shipped GROUP BY age_cat
 UNION ALL SELECT 'Sex', Sex, {COUNT_SQL} FROM shipped GROUP BY Sex
 UNION ALL SELECT 'Age', 'all', {COUNT_SQL} FROM shipped""", ("shipped",)),
})


def scored(spark, d):
    return v.scored_draws(spark, d)


def shipped_counts(spark, d):
    return co.stacked_counts(v.shipped_sample(spark, d))


@query("weighted_mean_by_sim", f"SELECT sim, age_cat, {_MEAN} AS p FROM scored GROUP BY sim, age_cat", ["scored"], ["p"])
def weighted_mean_by_sim(spark, d):
    return ps.weighted_mean(scored(spark, d), ["sim", "age_cat"])


@query("weighted_mean_missing", """SELECT sim, age_cat,
 CASE WHEN count(*) = count(v) THEN sum(v * strata_pop) / sum(strata_pop) END AS p FROM (
 SELECT sim, age_cat, strata_pop, CASE WHEN strata_pop >= 50 AND age_cat = '1998' THEN NULL ELSE seropos END AS v
 FROM scored) x GROUP BY sim, age_cat""", ["scored"], ["p"])
def weighted_mean_missing(spark, d):
    known = F.when(~((F.col("strata_pop") >= 50) & (F.col("age_cat") == "1998")), F.col("seropos"))
    return ps.weighted_mean(scored(spark, d).withColumn("seropos", known), ["sim", "age_cat"])


@query("weighted_estimates", "SELECT * FROM conditional", ["conditional"], ["p"])
def weighted_estimates(spark, d):
    return ps.conditional_estimates(scored(spark, d), AGE_REF, SEX_REF)


@query("conditional_age", f"""SELECT sim, age_cat AS val, {_MEAN} AS p FROM scored WHERE Sex = 'Female'
 GROUP BY sim, age_cat""", ["scored"], ["p"])
def conditional_age(spark, d):
    return ps.weighted_mean(scored(spark, d).where(F.col("Sex") == SEX_REF), ["sim", "age_cat"]).withColumnRenamed("age_cat", "val")


@query("marginal_vs_ref", "SELECT sim, var, val, p, is_ref, p_ref, coef_sign FROM signed WHERE var <> 'Overall'",
       ["signed"], ["p", "p_ref"])
def marginal_vs_ref(spark, d):
    m = ps.marginal_estimates(scored(spark, d)).where(F.col("var") != "Overall")
    return risk.sign_vs_reference(m, REFS)


_SUMMARY = """avg(p) AS mean, quantile_cont(p, 0.025e0) AS q025, quantile_cont(p, 0.975e0) AS q975"""


@query("posterior_summary", f"SELECT var, val, {_SUMMARY} FROM conditional GROUP BY var, val", ["conditional"],
       ["mean", "q025", "q975"])
def posterior_summary(spark, d):
    return sm.posterior_summary(ps.conditional_estimates(scored(spark, d), AGE_REF, SEX_REF), ["var", "val"])


@query("full_summary", """SELECT s.*, i.hdci_lo, i.hdci_hi FROM (
 SELECT var, val, avg(p) AS mean, quantile_cont(p, 0.5e0) AS median, quantile_cont(p, 0.025e0) AS q025,
 quantile_cont(p, 0.975e0) AS q975 FROM marginal GROUP BY var, val) s JOIN interval i USING (var, val)""",
       ["marginal", "interval"], ["mean", "median", "q025", "q975", "hdci_lo", "hdci_hi"])
def full_summary(spark, d):
    m = ps.marginal_estimates(scored(spark, d))
    return sm.full_summary(m, ["var", "val"], draws=v.N_DRAWS)


@query("hdci", "SELECT * FROM interval", ["interval"], ["hdci_lo", "hdci_hi"])
def hdci(spark, d):
    m = ps.marginal_estimates(scored(spark, d))
    return sm.hdci(m, ["var", "val"], draws=v.N_DRAWS)


@query("ranked_summary", """SELECT s.*, i.hdci_lo, i.hdci_hi FROM (
 SELECT var, val, avg(p) AS mean, quantile_cont(p, 0.5e0) AS median, quantile_cont(p, 0.025e0) AS q025,
 quantile_cont(p, 0.975e0) AS q975 FROM marginal GROUP BY var, val) s JOIN interval i USING (var, val)""",
       ["marginal", "interval"], ["mean", "median", "q025", "q975", "hdci_lo", "hdci_hi"])
def ranked_summary(spark, d):
    return sm.ranked_summary(ps.marginal_estimates(scored(spark, d)), ["var", "val"])


@query("rank_quantiles", """SELECT age_cat, Sex, avg(x) AS mean, quantile_cont(x, 0.5e0) AS median,
 quantile_cont(x, 0.025e0) AS q025, quantile_cont(x, 0.975e0) AS q975 FROM (
 SELECT age_cat, Sex, (l_extendedprice / 1e5) AS x FROM (SELECT CAST(year(l_shipdate) AS VARCHAR) AS age_cat,
 CASE WHEN l_linestatus = 'F' THEN 'Female' ELSE 'Male' END AS Sex, l_extendedprice FROM lineitem) a) y
 GROUP BY age_cat, Sex""", [], ["mean", "median", "q025", "q975"])
def rank_quantiles(spark, d):
    li = v.table(spark, d, "lineitem").select(
        F.year("l_shipdate").cast("string").alias("age_cat"),
        F.when(F.col("l_linestatus") == "F", "Female").otherwise("Male").alias("Sex"),
        (F.col("l_extendedprice") / 1e5).alias("x"))
    return sm.ranked_quantiles(li, ["age_cat", "Sex"], "x")


@query("tail_probability", """SELECT var, val, least(2e0 * avg(CASE WHEN coef_sign > 0 THEN 1 ELSE 0 END),
 2e0 * avg(CASE WHEN coef_sign < 0 THEN 1 ELSE 0 END)) AS p_tail FROM signed WHERE var <> 'Overall' AND NOT is_ref
 AND coef_sign IS NOT NULL GROUP BY var, val""", ["signed"], ["p_tail"])
def tail_probability(spark, d):
    m = ps.marginal_estimates(scored(spark, d)).where(F.col("var") != "Overall")
    return risk.sign_vs_reference(m, REFS).where(F.col("coef_sign").isNotNull()).groupBy("var", "val").agg(
        risk.sign_tail().alias("p_tail"))


_RISK = f"""SELECT var, val, avg(rr) AS mean, quantile_cont(rr, 0.025e0) AS q025, quantile_cont(rr, 0.975e0) AS q975,
 least(2e0 * avg(CASE WHEN rr > 1 THEN 1 WHEN rr IS NOT NULL THEN 0 END),
 2e0 * avg(CASE WHEN rr < 1 THEN 1 WHEN rr IS NOT NULL THEN 0 END)) AS p_tail FROM (
 SELECT c.var, c.val, CASE WHEN NOT {_REF} THEN c.p / nullif(r.p, 0) END AS rr FROM conditional c LEFT JOIN (
 SELECT sim AS rsim, var AS rvar, p FROM conditional WHERE {_REF}) r ON c.sim = r.rsim AND c.var = r.rvar
 WHERE c.var <> 'Overall') x GROUP BY var, val"""
VIEWS["risk"] = (_RISK, ("conditional",))


@query("relative_risk", """SELECT k.var, k.val, CASE k.val WHEN 'Male' THEN 1000001 WHEN 'Female' THEN 1000002
 ELSE CAST(regexp_extract(k.val, '[0-9]+') AS INT) END AS ord, n, pos_s, neg_s, pos_n, neg_n, vacc, mean, q025, q975, p_tail,
 coalesce({t}, '--') AS risk_text, coalesce({p}, '--') AS tail_text
 FROM risk k LEFT JOIN shipped_counts c ON k.var = c.var AND k.val = c.val""".format(
    t=sql_interval("mean", "q025", "q975", 2), p=sql_fixed("p_tail", 4)),
       ["risk", "shipped_counts"], ["mean", "q025", "q975", "p_tail"])
def relative_risk(spark, d):
    return rp.relative_risk_table(scored(spark, d), shipped_counts(spark, d), REFS)


@query("estimates_with_counts", f"""SELECT s.*, c.n, c.pos_s, c.neg_s, c.pos_n, c.neg_n, c.vacc FROM (
 SELECT var, val, {_SUMMARY} FROM conditional GROUP BY var, val) s
 LEFT JOIN shipped_counts c ON s.var = c.var AND s.val = c.val""", ["conditional", "shipped_counts"], ["mean", "q025", "q975"])
def estimates_with_counts(spark, d):
    e = sm.posterior_summary(ps.conditional_estimates(scored(spark, d), AGE_REF, SEX_REF), ["var", "val"])
    return e.join(shipped_counts(spark, d), ["var", "val"], "left")


_ORD = """CASE val WHEN 'Male' THEN 1000001 WHEN 'Female' THEN 1000002 WHEN 'all' THEN 1000003
 ELSE CAST(regexp_extract(val, '[0-9]+') AS INT) END AS ord"""
_TEXTS = ", ".join(f"{sql_count_percent(c, 'n')} AS {c}_text" for c in ("pos_s", "neg_s", "pos_n", "neg_n", "vacc"))


@query("prevalence_table", """SELECT var, val, {o}, n, pos_s, neg_s, pos_n, neg_n, vacc, median, hdci_lo, hdci_hi,
 mean, q025, q975, p_tail, {m} AS median_text, {a} AS mean_text, coalesce({p}, '--') AS tail_text, {t} FROM (
 SELECT CASE var WHEN 'Overall' THEN 'Age' ELSE var END AS var, CASE var WHEN 'Overall' THEN 'all' ELSE val END AS val,
 median, mean, q025, q975, hdci_lo, hdci_hi, p_tail FROM (
 SELECT var, val, avg(p) AS mean, quantile_cont(p, 0.5e0) AS median, quantile_cont(p, 0.025e0) AS q025,
 quantile_cont(p, 0.975e0) AS q975 FROM marginal GROUP BY var, val) s JOIN interval i USING (var, val) JOIN (
 SELECT var, val, least(2e0 * avg(CASE WHEN coef_sign > 0 THEN 1 WHEN coef_sign < 0 THEN 0 END),
 2e0 * avg(CASE WHEN coef_sign < 0 THEN 1 WHEN coef_sign > 0 THEN 0 END)) AS p_tail FROM signed GROUP BY var, val) t
 USING (var, val)) e LEFT JOIN shipped_counts c USING (var, val)""".format(
    o=_ORD, m=sql_interval("median", "hdci_lo", "hdci_hi", 1, "100e0"),
    a=sql_interval("mean", "q025", "q975", 1, "100e0"), p=sql_fixed("p_tail", 4), t=_TEXTS),
       ["marginal", "interval", "signed", "shipped_counts"],
       ["median", "hdci_lo", "hdci_hi", "mean", "q025", "q975", "p_tail"])
def prevalence_table(spark, d):
    return rp.prevalence_table(scored(spark, d), shipped_counts(spark, d), REFS, n_draws=v.N_DRAWS)


_STACK = " UNION ALL ".join(
    f"SELECT '{m}' AS measure, sim, age_cat, Sex, strata_pop, \"{m}\" AS seropos FROM scored" for m in MEASURES)
VIEWS["stacked"] = (_STACK, ("scored",))
REPORT_NAMES = {"seropos": "any_antibody", "external": "any_antibody_external", "infection": "natural_infection",
                "vaccination": "estimated_vaccination"}


def stacked(spark, d):
    s = scored(spark, d)
    return dr.stack_measures(s, MEASURES, ["sim", "age_cat", "Sex", "strata_pop"])


@query("unpivot_responses", f"SELECT measure, sim, {_MEAN} AS p FROM stacked GROUP BY measure, sim", ["stacked"], ["p"])
def unpivot_responses(spark, d):
    return ps.weighted_mean(stacked(spark, d), ["measure", "sim"])


_REPORT = """SELECT var, val, mean, q025, q975, p_tail, {t} AS txt FROM (
 SELECT var, val, avg(p) AS mean, quantile_cont(p, 0.025e0) AS q025, quantile_cont(p, 0.975e0) AS q975,
 least(2e0 * avg(CASE WHEN p > p_ref THEN 1 WHEN p_ref IS NOT NULL AND NOT is_ref THEN 0 END),
 2e0 * avg(CASE WHEN p <= p_ref AND NOT is_ref THEN 1 WHEN p_ref IS NOT NULL AND NOT is_ref THEN 0 END)) AS p_tail FROM (
 SELECT a.*, {ref} AS is_ref, CASE WHEN {ref} THEN NULL ELSE b.p END AS p_ref FROM {k}m_{m} a LEFT JOIN (SELECT sim AS rsim, var AS rvar, p
 FROM {k}m_{m} WHERE {ref}) b ON a.sim = b.rsim AND a.var = b.rvar) x GROUP BY var, val) y"""


def _report_views(kind: str, table: str, measures, ref: str) -> None:
    """Views ``<kind>m_<measure>`` (draws) and ``<kind>r_<measure>`` (report rows) over one table of measures."""
    for m in measures:
        mean = f'sum("{m}" * strata_pop) / sum(strata_pop)'
        VIEWS[f"{kind}m_{m}"] = (
            f"""SELECT sim, 'Age' AS var, 'all' AS val, {mean} AS p FROM {table} GROUP BY sim
 UNION ALL SELECT sim, 'Age', age_cat, {mean} FROM {table} GROUP BY sim, age_cat
 UNION ALL SELECT sim, 'Sex', Sex, {mean} FROM {table} GROUP BY sim, Sex""", (table,))
        VIEWS[f"{kind}r_{m}"] = (
            _REPORT.format(m=m, k=kind, ref=ref, t=sql_interval("mean", "q025", "q975", 1, "100e0")), (f"{kind}m_{m}",))


_report_views("", "scored", MEASURES, _REF)
_FINAL = """SELECT a.var, a.val, {o}, n, pos_s, neg_s, pos_n, neg_n, vacc, a.txt AS any_antibody,
 e.txt AS any_antibody_external, i.txt AS natural_infection, w.txt AS estimated_vaccination,
 CASE WHEN a.val = 'all' THEN '--' ELSE coalesce({p}, '--') END AS tail_text
 FROM {{a}} a FULL JOIN {{e}} e ON a.var = e.var AND a.val = e.val
 FULL JOIN {{i}} i ON a.var = i.var AND a.val = i.val FULL JOIN {{w}} w ON a.var = w.var AND a.val = w.val
 LEFT JOIN {{c}} c ON a.var = c.var AND a.val = c.val""".format(
    o=_ORD.replace("CASE val", "CASE a.val").replace("(val,", "(a.val,"), p=sql_fixed("i.p_tail", 4))


REPORT_SQL = _FINAL.format(a="r_seropos", e="r_external", i="r_infection", w="r_vaccination", c="shipped_counts")
REPORT_VIEWS = ["r_seropos", "r_external", "r_infection", "r_vaccination", "shipped_counts"]


@query("final_report", REPORT_SQL, REPORT_VIEWS)
def final_report(spark, d):
    return rp.combined_report(stacked(spark, d), shipped_counts(spark, d), REFS, REPORT_NAMES, "infection", v.N_DRAWS)


@query("full_join_nullsafe", """SELECT coalesce(a.age_cat, b.age_cat) AS age_cat, coalesce(a.Sex, b.Sex) AS Sex, a.p_any, b.p_infection
 FROM (SELECT age_cat, Sex, sum(seropos * strata_pop) / sum(strata_pop) AS p_any FROM scored
 GROUP BY GROUPING SETS ((age_cat), (Sex), (age_cat, Sex))) a
 FULL JOIN (SELECT age_cat, Sex, sum(infection * strata_pop) / sum(strata_pop) AS p_infection FROM scored
 GROUP BY GROUPING SETS ((), (age_cat), (Sex))) b
 ON a.age_cat IS NOT DISTINCT FROM b.age_cat AND a.Sex IS NOT DISTINCT FROM b.Sex""", ["scored"], ["p_any", "p_infection"])
def full_join_nullsafe(spark, d):
    s, age, sex = scored(spark, d), F.col("age_cat"), F.col("Sex")

    def means(sets, value, name):
        return s.groupingSets(sets, age, sex).agg(
            (F.sum(F.col(value) * F.col("strata_pop")) / F.sum("strata_pop")).alias(name))

    left = means([[age], [sex], [age, sex]], "seropos", "p_any")
    right = means([[], [age], [sex]], "infection", "p_infection")
    return rp.full_join_null_safe(left, right, ["age_cat", "Sex"])


@query("format_ci", f"""SELECT var, val, mean, q025, q975, {sql_interval('mean', 'q025', 'q975', 1, '100e0')} AS txt
 FROM (SELECT var, val, {_SUMMARY} FROM conditional GROUP BY var, val) x""", ["conditional"], ["mean", "q025", "q975"])
def format_ci(spark, d):
    e = sm.posterior_summary(ps.conditional_estimates(scored(spark, d), AGE_REF, SEX_REF), ["var", "val"])
    return e.withColumn("txt", interval_text(F.col("mean"), F.col("q025"), F.col("q975"), 1, 100.0))


@query("union_by_name", f"""SELECT 'all' AS age_cat, CAST(NULL AS VARCHAR) AS Sex, sim, {_MEAN} AS p FROM scored GROUP BY sim
 UNION ALL SELECT age_cat, Sex, sim, {_MEAN} FROM scored GROUP BY sim, age_cat, Sex""", ["scored"], ["p"])
def union_by_name(spark, d):
    s = scored(spark, d)
    overall = ps.weighted_mean(s, ["sim"]).withColumn("age_cat", F.lit("all"))
    return ps.weighted_mean(s, ["sim", "age_cat", "Sex"]).unionByName(overall, allowMissingColumns=True)


# serology model draws at census strata

_ETA = {p: sql_predictor(v.SERO_DESIGN, f"{p}:", "d") for p in ("inf", "vacc")}
_GRID = "sero_draws d CROSS JOIN ages CROSS JOIN sexes JOIN pop_strata USING (age_cat, Sex)"
_ST = """1e0 - (pv * (1 - p) + p * resp_sp_nn + p * resp_sn_np * (1 - pv) + 1 - pv * (1 - p) - p) AS sp_np,
 p * resp_sn_np * (1 - pv) AS sn_np, pv * (1 - p) + p * resp_sp_nn AS sp_nn, 1 - pv * (1 - p) - p AS sn_nn"""


def census_strata(spark, d):
    return population_strata(v.census(spark, d))


@query("score_strata", f"""SELECT sim, age_cat, Sex, strata_pop, {sql_logistic(_ETA['inf'])} AS seropos FROM {_GRID}""",
       ["sero_draws", "ages", "sexes", "pop_strata"], ["seropos"])
def score_strata(spark, d):
    return dr.score_strata(v.sero_draws(spark, d), census_strata(spark, d), v.SERO_DESIGN, (AGE, SEX), "strata_pop", prefix="inf:")


def _score_sql(q: str, extra: str = "") -> str:
    return f"""SELECT sim, age_cat, Sex, strata_pop, p AS p_infection, q AS p_vaccination, sp_np, sn_np, sp_nn, sn_nn,
 1e0 - sn_nn AS p_any FROM (SELECT *, {_ST} FROM (SELECT *, q * vacc_response AS pv FROM (
 SELECT sim, age_cat, Sex, strata_pop, resp_sn_np, resp_sp_nn, vacc_response,
 {sql_logistic(_ETA['inf'])} AS p, {q} AS q FROM {_GRID} {extra}) x) y) z"""


SCORED = ["p_infection", "p_vaccination", *JOINT, "p_any"]
SCORE_VIEWS = ["sero_draws", "ages", "sexes", "pop_strata"]


@query("score_seroprev", _score_sql(sql_logistic(_ETA["vacc"])), SCORE_VIEWS, SCORED)
def score_seroprev(spark, d):
    return dr.score_seroprevalence(v.sero_draws(spark, d), census_strata(spark, d), v.SERO_DESIGN)


@query("score_seroprev_external", _score_sql("coverage", "JOIN coverage USING (age_cat, Sex)"), [*SCORE_VIEWS, "coverage"], SCORED)
def score_seroprev_external(spark, d):
    strata = census_strata(spark, d).join(v.coverage(spark), ["Sex", "age_cat"])
    return dr.score_seroprevalence(v.sero_draws(spark, d), strata, v.SERO_DESIGN, coverage="coverage")


SERO_REFS = {"Age": AGE.ref, "Sex": SEX.ref}
SERO_NAMES = {"p_any": "any_antibody", "p_any_external": "any_antibody_external", "p_infection": "natural_infection",
              "p_vaccination": "estimated_vaccination"}
_SERO_REF = "((var = 'Age' AND val = '[25,35)') OR (var = 'Sex' AND val = 'Female'))"
VIEWS.update({
    "sero_own": (_score_sql(sql_logistic(_ETA["vacc"])), tuple(SCORE_VIEWS)),
    "sero_ext": (_score_sql("coverage", "JOIN coverage USING (age_cat, Sex)"), (*SCORE_VIEWS, "coverage")),
    "sero_measures": ("""SELECT o.sim, o.age_cat, o.Sex, o.strata_pop, o.p_any, x.p_any AS p_any_external, o.p_infection, o.p_vaccination
 FROM sero_own o JOIN sero_ext x ON o.sim = x.sim AND o.age_cat = x.age_cat AND o.Sex = x.Sex""", ("sero_own", "sero_ext")),
    "cohort_counts": (f"""SELECT 'Age' AS var, age_cat AS val, {COUNT_SQL} FROM cohort GROUP BY age_cat
 UNION ALL SELECT 'Sex', Sex, {COUNT_SQL} FROM cohort GROUP BY Sex UNION ALL SELECT 'Age', 'all', {COUNT_SQL} FROM cohort""", ("cohort",)),
})
_report_views("sero_", "sero_measures", SERO_NAMES, _SERO_REF)


def sero_measures(spark, d):
    """All measures of the serology model as rows, own and external vaccination."""
    strata = census_strata(spark, d).join(v.coverage(spark), ["Sex", "age_cat"])
    return rp.stacked_seroprevalence(v.sero_draws(spark, d), strata, v.SERO_DESIGN, "coverage")


def cohort_counts(spark, d):
    return co.stacked_counts(co.prepare_cohort(v.raw_cohort(spark, d)))


@query("seroprevalence_report", _FINAL.format(
    a="sero_r_p_any", e="sero_r_p_any_external", i="sero_r_p_infection", w="sero_r_p_vaccination", c="cohort_counts"),
       [*[f"sero_r_{m}" for m in SERO_NAMES], "cohort_counts"])
def seroprevalence_report(spark, d):
    """The first half in one query: cohort, census, draws and coverage to the final table."""
    return rp.combined_report(
        sero_measures(spark, d), cohort_counts(spark, d), SERO_REFS, SERO_NAMES, "p_infection", v.N_DRAWS)


# households: both probabilities integrated over their own effect

_INTEGRATED = {k: sql_logistic(f"e_{k} + sigma_{k} * z") for k in ("inf", "vacc")}
_JOINTS = [f"{k}{x}" for x in ("", "_external") for k in JOINT]
VIEWS.update({
    "hh_scored": (f"""SELECT sim, age_cat, Sex, strata_pop, resp_sn_np, resp_sp_nn, vacc_response, coverage,
 sum(w * {_INTEGRATED['inf']}) AS p, sum(w * {_INTEGRATED['vacc']}) AS q FROM (
 SELECT d.*, age_cat, Sex, strata_pop, coverage, {_ETA['inf']} AS e_inf, {_ETA['vacc']} AS e_vacc
 FROM {_GRID} JOIN coverage USING (age_cat, Sex)) x CROSS JOIN (VALUES {sql_values(dr.quadrature(32))}) g(z, w)
 GROUP BY sim, age_cat, Sex, strata_pop, resp_sn_np, resp_sp_nn, vacc_response, coverage""", (*SCORE_VIEWS, "coverage")),
    "hh_joint": (f"""SELECT o.*, x.sp_np AS sp_np_external, x.sn_np AS sn_np_external, x.sp_nn AS sp_nn_external, x.sn_nn AS sn_nn_external FROM (
 SELECT sim, age_cat, Sex, strata_pop, p, q, {_ST} FROM (SELECT *, q * vacc_response AS pv FROM hh_scored) a) o JOIN (
 SELECT sim, age_cat, Sex, {_ST} FROM (SELECT *, coverage * vacc_response AS pv FROM hh_scored) a) x
 ON o.sim = x.sim AND o.age_cat = x.age_cat AND o.Sex = x.Sex""", ("hh_scored",)),
    "hh_measures": ("""SELECT sim, age_cat, Sex, strata_pop, 1 - sn_nn AS p_any, 1 - sn_nn_external AS p_any_external, p AS p_infection,
 q AS p_vaccination FROM hh_joint""", ("hh_joint",)),
    "hh_responses": (" UNION ALL ".join(f"SELECT '{m}' AS measure, sim, age_cat, Sex, strata_pop, {m} AS x FROM hh_joint" for m in _JOINTS), ("hh_joint",)),
})
_report_views("hh_", "hh_measures", SERO_NAMES, _SERO_REF)
HOUSEHOLD = {"sigma_infection": "sigma_inf", "sigma_vaccination": "sigma_vacc", "tol": dr.TOLERANCE}


def covered_strata(spark, d):
    return census_strata(spark, d).join(v.coverage(spark), ["Sex", "age_cat"])


@query("household_report", _FINAL.format(
    a="hh_r_p_any", e="hh_r_p_any_external", i="hh_r_p_infection", w="hh_r_p_vaccination", c="cohort_counts"),
       [*[f"hh_r_{m}" for m in SERO_NAMES], "cohort_counts"])
def household_report(spark, d):
    """The first half end to end with household effects: both probabilities are averages over households, refined to 1e-8."""
    measures = rp.stacked_seroprevalence(v.sero_draws(spark, d), covered_strata(spark, d), v.SERO_DESIGN, "coverage", **HOUSEHOLD)
    return rp.combined_report(measures, cohort_counts(spark, d), SERO_REFS, SERO_NAMES, "p_infection", v.N_DRAWS)


_RESPONSE_MEAN = "sum(x * strata_pop) / sum(strata_pop)"


@query("joint_response_estimates", f"""SELECT measure, var, val, {_SUMMARY} FROM (
 SELECT measure, sim, 'Overall' AS var, '' AS val, {_RESPONSE_MEAN} AS p FROM hh_responses GROUP BY measure, sim
 UNION ALL SELECT measure, sim, 'Age', age_cat, {_RESPONSE_MEAN} FROM hh_responses WHERE Sex = 'Female' GROUP BY measure, sim, age_cat
 UNION ALL SELECT measure, sim, 'Sex', Sex, {_RESPONSE_MEAN} FROM hh_responses WHERE age_cat = '[25,35)' GROUP BY measure, sim, Sex) x
 GROUP BY measure, var, val""", ["hh_responses"], ["mean", "q025", "q975"])
def joint_response_estimates(spark, d):
    """Weighted estimates of the four joint responses, own and external vaccination, in one pass over all of them."""
    stacked = rp.stacked_responses(v.sero_draws(spark, d), covered_strata(spark, d), v.SERO_DESIGN, "coverage", **HOUSEHOLD)
    estimates = ps.conditional_estimates(stacked, AGE.ref, SEX.ref, ("measure", "sim"))
    return sm.posterior_summary(estimates, ["measure", "var", "val"])


@query("adaptive_integral", f"""SELECT sim, age_cat, Sex, sum(w * {sql_logistic('e + sigma_inf * z')}) AS p, true AS converged FROM (
 SELECT sim, age_cat, Sex, sigma_inf, {_ETA['inf']} AS e FROM sero_draws d CROSS JOIN ages CROSS JOIN sexes) x CROSS JOIN (
 SELECT i / 16e0 AS z, exp(-i * i / 512e0) / sqrt(2 * pi()) / 16e0 AS w FROM range(-144, 145) t(i)) g GROUP BY sim, age_cat, Sex""",
       ["sero_draws", "ages", "sexes"], ["p"])
def adaptive_integral(spark, d):
    rows = fan_out(v.sero_draws(spark, d), AGE, SEX).withColumn("eta", F.expr(v.SERO_DESIGN.predictor("inf:")))
    found = rows.withColumn("_i", dr.adaptive_average(F.col("eta"), F.col("sigma_inf")))
    return found.select("sim", "age_cat", "Sex", "_i.p", (F.col("_i.error") <= dr.TOLERANCE).alias("converged"))


_SERO_RISK = " UNION ALL ".join(f"""SELECT '{m}' AS measure, var, val, avg(rr) AS mean, quantile_cont(rr, 0.025e0) AS q025,
 quantile_cont(rr, 0.975e0) AS q975, least(2e0 * avg(CASE WHEN rr > 1 THEN 1 WHEN rr IS NOT NULL THEN 0 END),
 2e0 * avg(CASE WHEN rr < 1 THEN 1 WHEN rr IS NOT NULL THEN 0 END)) AS p_tail FROM (
 SELECT 'Age' AS var, a.age_cat AS val, CASE WHEN a.age_cat <> '[25,35)' THEN a."{m}" / b."{m}" END AS rr
 FROM sero_measures a JOIN sero_measures b ON a.sim = b.sim AND a.Sex = 'Female' AND b.Sex = 'Female' AND b.age_cat = '[25,35)'
 UNION ALL SELECT 'Sex', a.Sex, CASE WHEN a.Sex <> 'Female' THEN a."{m}" / b."{m}" END
 FROM sero_measures a JOIN sero_measures b ON a.sim = b.sim AND a.age_cat = '[25,35)' AND b.age_cat = '[25,35)' AND b.Sex = 'Female') x
 GROUP BY var, val""" for m in ("p_any", "p_any_external", "p_infection"))


RISK_SQL = (f"SELECT k.*, n FROM ({_SERO_RISK}) k LEFT JOIN cohort_counts c ON k.var = c.var AND k.val = c.val",
            ["sero_measures", "cohort_counts"], ["mean", "q025", "q975", "p_tail"])


@query("seroprevalence_risk", *RISK_SQL)
def seroprevalence_risk(spark, d):
    """Relative risks of three measures by age and sex in one pass."""
    measures = sero_measures(spark, d).where(F.col("measure") != "p_vaccination")
    table = rp.relative_risk_table(measures, cohort_counts(spark, d), SERO_REFS, ("measure", "sim"), ("measure",))
    return table.select("measure", "var", "val", "mean", "q025", "q975", "p_tail", "n")


@query("coverage_by_category", """SELECT c.var, c.val, n, vacc, vacc * 1e2 / n AS pc_vacc, pc_coverage FROM cohort_counts c
 JOIN coverage_percent p ON p.val = CASE c.val WHEN 'all' THEN 'All' ELSE c.val END""", ["cohort_counts", "coverage_percent"],
       ["pc_vacc", "pc_coverage"])
def coverage_by_category(spark, d):
    """Vaccination in the sample next to the external coverage of each report category."""
    outside = v.coverage_percent(spark).withColumn("val", F.when(F.col("val") == "All", "all").otherwise(F.col("val")))
    return cohort_counts(spark, d).join(outside, "val").select(
        "var", "val", "n", "vacc", (F.col("vacc") * 100.0 / F.col("n")).alias("pc_vacc"), "pc_coverage")


def _nodes_sql(n: int) -> str:
    return f"(VALUES {sql_values(dr.quadrature(n))}) g(z, w)"


@query("marginal_integral", f"""SELECT sim, age_cat, Sex, strata_pop, sum(w * {sql_logistic('e + sigma_inf * z')}) AS seropos FROM (
 SELECT sim, age_cat, Sex, strata_pop, sigma_inf, {_ETA['inf']} AS e FROM {_GRID}) x CROSS JOIN {_nodes_sql(32)}
 GROUP BY sim, age_cat, Sex, strata_pop""", SCORE_VIEWS, ["seropos"])
def marginal_integral(spark, d):
    s = dr.score_seroprevalence(v.sero_draws(spark, d), census_strata(spark, d), v.SERO_DESIGN,
                                sigma_infection="sigma_inf", sigma_vaccination="sigma_vacc")
    return s.select("sim", "age_cat", "Sex", "strata_pop", F.col("p_infection").alias("seropos"))


@query("integration_check", f"""SELECT age_cat, Sex, count(*) AS n_draws, count(*) FILTER (WHERE error > 1e-6) AS n_failed,
 max(error) AS max_error FROM (SELECT sim, age_cat, Sex, abs(sum(CASE WHEN k = 4 THEN y ELSE -y END)) AS error FROM (
 SELECT sim, age_cat, Sex, k, w * {sql_logistic('e + sigma_inf * z')} AS y FROM (
 SELECT sim, age_cat, Sex, sigma_inf, {_ETA['inf']} AS e FROM sero_draws d CROSS JOIN ages CROSS JOIN sexes) x
 CROSS JOIN (VALUES {sql_values([(4, *r) for r in dr.quadrature(4)] + [(32, *r) for r in dr.quadrature(32)])}) g(k, z, w)) q
 GROUP BY sim, age_cat, Sex) r GROUP BY age_cat, Sex""", ["sero_draws", "ages", "sexes"], ["max_error"])
def integration_check(spark, d):
    return dr.integration_errors(v.sero_draws(spark, d), v.SERO_DESIGN, "sigma_inf", "inf:", nodes=(4, 32))


def _status_draws(spark, d):
    """Infection probability per draw and stratum, with pv from the vaccination coefficients."""
    inf, vacc = (logistic(F.expr(v.SERO_DESIGN.predictor(p))) for p in ("inf:", "vacc:"))
    grid = fan_out(v.sero_draws(spark, d), AGE, SEX).withColumn("p", inf).withColumn("pv", vacc * F.col("vacc_response"))
    return grid, true_status(F.col("p"), F.col("pv"), F.col("resp_sn_np"), F.col("resp_sp_nn"))


_STATUS = f"""SELECT *, {_ST} FROM (SELECT d.*, age_cat, Sex, {sql_logistic(_ETA['inf'])} AS p,
 {sql_logistic(_ETA['vacc'])} * vacc_response AS pv FROM sero_draws d CROSS JOIN ages CROSS JOIN sexes) x"""
VIEWS["status"] = (_STATUS, ("sero_draws", "ages", "sexes"))


@query("true_status_probs", "SELECT sim, age_cat, Sex, sp_np, sn_np, sp_nn, sn_nn, 1e0 - sn_nn AS p_any FROM status",
       ["status"], [*JOINT, "p_any"])
def true_status_probs(spark, d):
    grid, true = _status_draws(spark, d)
    return grid.select("sim", "age_cat", "Sex", *[c.alias(k) for k, c in true.items()], any_antibody(true).alias("p_any"))


@query("observed_probs", """SELECT sim, age_cat, Sex,
 sens_s * sens_n * sp_np + (1 - spec_s) * sens_n * sn_np + sens_s * (1 - spec_n) * sp_nn + (1 - spec_s) * (1 - spec_n) * sn_nn AS sp_np,
 (1 - sens_s) * sens_n * sp_np + spec_s * sens_n * sn_np + (1 - sens_s) * (1 - spec_n) * sp_nn + spec_s * (1 - spec_n) * sn_nn AS sn_np,
 sens_s * (1 - sens_n) * sp_np + (1 - spec_s) * (1 - sens_n) * sn_np + sens_s * spec_n * sp_nn + (1 - spec_s) * spec_n * sn_nn AS sp_nn,
 (1 - sens_s) * (1 - sens_n) * sp_np + spec_s * (1 - sens_n) * sn_np + (1 - sens_s) * spec_n * sp_nn + spec_s * spec_n * sn_nn AS sn_nn
 FROM status""", ["status"], JOINT)
def observed_probs(spark, d):
    grid, true = _status_draws(spark, d)
    seen = observed_status(true, *[F.col(c) for c in ("sens_s", "spec_s", "sens_n", "spec_n")])
    return grid.select("sim", "age_cat", "Sex", *[c.alias(k) for k, c in seen.items()])


@query("logit_roundtrip", "SELECT sim, sens_s AS p, ln(sens_s / (1 - sens_s)) AS x, sens_s AS back FROM sero_draws",
       ["sero_draws"], ["p", "x", "back"])
def logit_roundtrip(spark, d):
    x = logit(F.col("sens_s"))
    return v.sero_draws(spark, d).select("sim", F.col("sens_s").alias("p"), x.alias("x"), logistic(x).alias("back"))


VIEWS["long_draws"] = (" UNION ALL ".join(
    f"""SELECT 'sero' AS fit_id, CAST(sim % 4 AS INT) AS chain, CAST(sim AS INT) AS sim, '{t}' AS term, "inf:{t}" AS value
 FROM sero_draws""" for t in v.SERO_DESIGN.terms), ("sero_draws",))


def long_draws(spark, d):
    """Draws contract: one row per draw and term, four chains."""
    wide = v.sero_draws(spark, d).select(
        F.lit("sero").alias("fit_id"), (F.col("sim") % 4).cast("int").alias("chain"), F.col("sim").cast("int").alias("sim"),
        *[F.col(f"`inf:{t}`").alias(t) for t in v.SERO_DESIGN.terms])
    return wide.unpivot(["fit_id", "chain", "sim"], [f"`{t}`" for t in v.SERO_DESIGN.terms], "term", "value")


@query("odds_ratios", "SELECT sim, term, value AS beta, exp(value) AS odds_ratio FROM long_draws", ["long_draws"], ["beta", "odds_ratio"])
def odds_ratios(spark, d):
    return long_draws(spark, d).select("sim", "term", F.col("value").alias("beta"), F.exp("value").alias("odds_ratio"))


@query("coef_summary", """SELECT fit_id, term, avg(value) AS mean, quantile_cont(value, 0.025e0) AS q025,
 quantile_cont(value, 0.975e0) AS q975, avg(exp(value)) AS or_mean, quantile_cont(exp(value), 0.025e0) AS or_q025,
 quantile_cont(exp(value), 0.975e0) AS or_q975, 'additive' AS model_type, 'thresh' AS outcome_type
 FROM long_draws GROUP BY fit_id, term""", ["long_draws"], ["mean", "q025", "q975", "or_mean", "or_q025", "or_q975"])
def coef_summary(spark, d):
    return sm.coefficient_summary(long_draws(spark, d), {"model_type": "additive", "outcome_type": "thresh"})


@query("rhat", """SELECT fit_id, term, count(*) AS n_chains, min(n) AS n_per_chain, avg(v) AS within, var_samp(m) AS between,
 sqrt(((min(n) - 1) / min(n) * avg(v) + var_samp(m)) / avg(v)) AS rhat,
 least(CAST(count(*) * min(n) AS DOUBLE), count(*) * ((min(n) - 1) / min(n) * avg(v) + var_samp(m)) / var_samp(m)) AS ess
 FROM (SELECT fit_id, term, chain, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM long_draws GROUP BY ALL) x
 GROUP BY fit_id, term""", ["long_draws"], ["within", "between", "rhat", "ess"])
def rhat(spark, d):
    return dr.convergence(long_draws(spark, d))


def _polynomial_sql(coefficients, x: str) -> str:
    out = repr(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {c!r})"
    return out


def _normal_sql(p: str) -> str:
    tail = f"sqrt(-ln(least({p}, 1 - {p})))"
    parts = [f"{_polynomial_sql(a, x)} / {_polynomial_sql(b, x)}" for (a, b), x in zip(
        fx.NORMAL_QUANTILE, (f"(0.180625e0 - ({p} - 5e-1) * ({p} - 5e-1))", f"({tail} - 1.6e0)", f"({tail} - 5e0)"))]
    return (f"CASE WHEN abs({p} - 5e-1) <= 0.425e0 THEN ({p} - 5e-1) * {parts[0]} "
            f"WHEN {tail} <= 5 THEN sign({p} - 5e-1) * {parts[1]} ELSE sign({p} - 5e-1) * {parts[2]} END")


VIEWS.update({
    "chain_halves": ("""SELECT fit_id, term, chain, CASE WHEN pos > n - n // 2 THEN 1 ELSE 0 END AS half,
 CASE WHEN pos > n - n // 2 THEN pos - n + n // 2 ELSE pos END AS pos, value FROM (SELECT *,
 row_number() OVER (PARTITION BY fit_id, term, chain ORDER BY sim) AS pos, count(*) OVER (PARTITION BY fit_id, term, chain) AS n
 FROM long_draws) x WHERE n >= 4 AND (pos <= n // 2 OR pos > n - n // 2)""", ("long_draws",)),
    "chain_values": ("""SELECT h.*, 'bulk' AS kind, value AS x FROM chain_halves h UNION ALL
 SELECT h.*, 'folded', abs(value - c) FROM chain_halves h JOIN (SELECT fit_id, term, quantile_cont(value, 5e-1) AS c FROM chain_halves
 GROUP BY fit_id, term) m USING (fit_id, term)""", ("chain_halves",)),
    "chain_scores": (f"""SELECT fit_id, term, kind, chain, half, pos, {_normal_sql('p')} AS z FROM (SELECT *,
 (rank() OVER (PARTITION BY fit_id, term, kind ORDER BY x) + (count(*) OVER (PARTITION BY fit_id, term, kind, x) - 1) / 2e0 - 0.375e0)
 / (count(*) OVER (PARTITION BY fit_id, term, kind) + 0.25e0) AS p FROM chain_values) y""", ("chain_values",)),
    "chain_stats": ("""SELECT fit_id, term, kind, count(*) AS halves, min(n) AS n, avg(v) AS w, (min(n) - 1) / min(n) * avg(v) + var_samp(m) AS total FROM (
 SELECT fit_id, term, kind, chain, half, count(*) AS n, avg(z) AS m, var_samp(z) AS v FROM chain_scores GROUP BY ALL) x
 GROUP BY fit_id, term, kind""", ("chain_scores",)),
    "chain_lags": ("""SELECT fit_id, term, lag, sum(acov) AS acov FROM (
 SELECT a.fit_id, a.term, a.chain, a.half, b.pos - a.pos AS lag, sum(a.d * b.d) / max(a.n) AS acov FROM chain_centred a JOIN chain_centred b
 ON a.fit_id = b.fit_id AND a.term = b.term AND a.chain = b.chain AND a.half = b.half AND b.pos >= a.pos GROUP BY ALL) x
 GROUP BY fit_id, term, lag""", ("chain_centred",)),
    "chain_centred": ("""SELECT *, z - avg(z) OVER (PARTITION BY fit_id, term, chain, half) AS d,
 count(*) OVER (PARTITION BY fit_id, term, chain, half) AS n FROM chain_scores WHERE kind = 'bulk'""", ("chain_scores",)),
    "chain_pairs": ("""SELECT fit_id, term, k, p, min(p) OVER (PARTITION BY fit_id, term ORDER BY k) AS low FROM (
 SELECT l.fit_id, l.term, lag // 2 AS k, sum(1 - (w - acov / halves) / total) AS p FROM chain_lags l JOIN chain_stats s
 ON l.fit_id = s.fit_id AND l.term = s.term AND s.kind = 'bulk' WHERE lag < n AND lag // 2 < n // 2 GROUP BY l.fit_id, l.term, lag // 2) x""",
                    ("chain_lags", "chain_stats")),
})


@query("convergence", """SELECT s.fit_id, s.term, s.n_halves, s.n_per_half, s.rhat, least(size / tau, size * log10(size)) AS ess FROM (
 SELECT fit_id, term, max(halves) AS n_halves, max(n) AS n_per_half, max(sqrt(total / w)) AS rhat,
 CAST(max(halves * n) AS DOUBLE) AS size FROM chain_stats GROUP BY fit_id, term) s JOIN (
 SELECT fit_id, term, 2 * sum(CASE WHEN low >= 0 THEN low ELSE 0 END) - 1 AS tau FROM chain_pairs GROUP BY fit_id, term) t
 ON s.fit_id = t.fit_id AND s.term = t.term""", ["chain_stats", "chain_pairs"], ["rhat", "ess"])
def convergence(spark, d):
    return cv.convergence(long_draws(spark, d))


@query("draws_widened", """SELECT 'sero' AS fit_id, CAST(sim % 4 AS INT) AS chain, CAST(sim AS INT) AS sim, {c} FROM sero_draws""".format(
    c=", ".join(f'"inf:{t}" AS "{t}"' for t in v.SERO_DESIGN.terms)), ["sero_draws"], v.SERO_DESIGN.terms)
def draws_widened(spark, d):
    return dr.widen(long_draws(spark, d), v.SERO_DESIGN.terms)


