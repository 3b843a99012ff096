"""Properties and brute-force checks."""

import math
from itertools import groupby

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hst
from pyspark.sql import functions as F

from strata_spark import fixed_values as fx
from strata_spark.catalog.cohort_queries import cohort
from strata_spark.catalog.likelihood_queries import PRIOR, cells, pointwise
from strata_spark.catalog.strata_queries import SETS, SPECS, post_scored, reallocated
from strata_spark.functions.levels import AGE, SEX, bin_labels
from strata_spark.operators import compare as cp
from strata_spark.operators import draws as dr
from strata_spark.operators import fit as ft
from strata_spark.operators import likelihood as lk
from strata_spark.operators import poststrat as ps
from strata_spark.operators.design import MODELS
from strata_spark.operators.numbering import index_keys, number_by_id, rank_draws
from strata_spark.operators.summary import full_summary, posterior_summary, ranked_quantiles
from strata_spark.sources import views as v


def test_four_probabilities_sum_to_one(spark, sf_dir):
    strata = spark.createDataFrame([(s, a, 1.0) for s in SEX.labels for a in AGE.labels], "Sex string, age_cat string, strata_pop double")
    s = dr.score_seroprevalence(v.sero_draws(spark, sf_dir), strata, v.SERO_DESIGN)
    total = F.col("sp_np") + F.col("sn_np") + F.col("sp_nn") + F.col("sn_nn")
    low = F.least("sp_np", "sn_np", "sp_nn", "sn_nn")
    r = s.agg(F.max(F.abs(total - 1)), F.min(low), F.max(F.abs(1 - F.col("sn_nn") - F.col("p_any")))).first()
    assert r[0] < 1e-12 and r[1] >= -1e-12 and r[2] < 1e-12


def test_reallocation_keeps_group_totals(spark, sf_dir):
    g = reallocated(spark, sf_dir).groupBy("age_cat", "vacc_status_3way").agg(
        F.sum("strata_size").alias("a"), F.sum("strata_size_new").alias("b"), F.min("strata_size_new").alias("m"))
    r = g.agg(F.max(F.abs(F.col("a") - F.col("b"))), F.min("m")).first()
    assert r[0] < 1e-6 and r[1] >= -1e-9


def test_sets_and_subset_lists_agree(spark, sf_dir):
    scored = post_scored(spark, sf_dir)
    a = ps.poststratify_sets(scored, SETS, ("fit_id", "sim"))
    b = ps.poststratify_subsets(scored, SPECS, ("fit_id", "sim"))
    both = a.where("postrat_name <> 'all'").join(b.withColumnRenamed("p", "q"), ["fit_id", "sim", "postrat_name"], "full")
    r = both.agg(F.count(F.lit(1)), F.max(F.abs(F.col("p") - F.col("q"))), F.count_if(F.col("p").isNull() & F.col("q").isNotNull())).first()
    assert r[0] > 0 and r[1] < 1e-12 and r[2] == 0


def test_overall_is_the_weighted_mean_of_a_partition(spark, sf_dir):
    s = v.scored_draws(spark, sf_dir)
    parts = ps.cell_sums(s, ["sim", "age_cat"])
    whole = ps.weighted_mean(s, ["sim"])
    back = parts.groupBy("sim").agg((F.sum("wx") / F.sum("w")).alias("q")).join(whole, "sim")
    assert back.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-12


def test_interval_is_no_wider_than_equal_tails(spark, sf_dir):
    m = ps.marginal_estimates(v.scored_draws(spark, sf_dir))
    r = full_summary(m, ["var", "val"])
    # the interval spans floor(0.95 n) steps, so it may cover one step more than equal tails
    assert r.where((F.col("hdci_hi") - F.col("hdci_lo")) > (F.col("q975") - F.col("q025")) * 1.1 + 0.02).count() == 0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hst.lists(hst.integers(0, 100), min_size=2, max_size=8, unique=True))
def test_bins_partition_the_range(breaks):
    breaks = sorted(breaks)
    labels = bin_labels(breaks)
    assert len(labels) == len(breaks) - 1 == len(set(labels))
    assert labels[-1].endswith("]") and all(x.endswith(")") for x in labels[:-1])


def test_cells_equal_rows(spark, sf_dir):
    """Log-likelihood from cells equals the sum over participants."""
    totals = {(r.fit_id, r.sim): r.log_lik for r in lk.loglik_by_draw(pointwise(spark, sf_dir)).collect()}
    rows = v.panel(spark, sf_dir).select(
        F.col("variant").alias("fit_id"), "age_cat", "sex", "inf_latest", "vacc_status_3way",
        (F.col("age") < 12).alias("child"), F.col("ec50_thresh").cast("int").alias("y"), F.lit(1).cast("bigint").alias("n"))
    direct = lk.loglik_by_draw(lk.pointwise_loglik(
        v.panel_draws(spark, sf_dir, MODELS["additive"]), rows, MODELS["additive"], PRIOR)).collect()
    assert len(direct) == len(totals)
    assert max(abs(r.log_lik - totals[r.fit_id, r.sim]) for r in direct) < 1e-8


def test_overdispersion_with_zero_scale_changes_nothing(spark, sf_dir):
    draws = v.panel_draws(spark, sf_dir, MODELS["additive"]).withColumn("zero", F.lit(0.0))
    c = cells(spark, sf_dir)
    plain = lk.loglik_by_draw(lk.pointwise_loglik(draws, c, MODELS["additive"], PRIOR))
    wide = lk.loglik_by_draw(lk.pointwise_loglik(draws, c, MODELS["additive"], PRIOR, sigma="zero", n_fits=5)).withColumnRenamed("log_lik", "b")
    assert plain.join(wide, ["fit_id", "sim"]).agg(F.max(F.abs(F.col("log_lik") - F.col("b")))).first()[0] < 1e-8


def test_numbering_with_a_hot_group(spark):
    rows = [("hot", i * 7) for i in range(3000)] + [(f"g{i % 5}", i * 3 + 1) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, id long")
    got = {(r.g, r.id): r.k for r in number_by_id(df, ["g"], "id", "k").collect()}
    want = {}
    for g, grp in groupby(sorted(rows), key=lambda x: x[0]):
        for i, (_, x) in enumerate(grp, 1):
            want[g, x] = i
    assert got == want


def test_ranks_and_index(spark):
    df = spark.createDataFrame([("a", float(x) / 97) for x in range(-50, 200)], "g string, p double")
    got = [r["rank"] for r in rank_draws(df, ["g"], "p", per_octave=1).orderBy("p").collect()]
    assert got == list(range(1, 251))
    keys = spark.createDataFrame([(f"h{i % 40}",) for i in range(200)], "h string")
    idx = index_keys(keys, "h", "i").collect()
    assert sorted(r.i for r in idx) == list(range(1, 41)) and len({r.h for r in idx}) == 40


@pytest.mark.parametrize("n", [1, 2, 5, 500])
def test_histogram_quantiles_of_a_hot_value(spark, n):
    x = np.concatenate([np.full(n // 3, 0.5), np.sin(np.arange(n - n // 3)) * 3])
    df = spark.createDataFrame([("g", float(a)) for a in x] + [("h", 1.0)], "g string, p double")
    for groups in (None, 10):
        r = {row.g: row for row in ranked_quantiles(df, ["g"], "p", groups, per_octave=1).collect()}
        assert [r["g"].median, r["g"].q025, r["g"].q975] == pytest.approx(list(np.quantile(x, [0.5, 0.025, 0.975])))
        assert r["g"]["mean"] == pytest.approx(x.mean()) and r["h"].median == 1.0


@pytest.mark.parametrize("sigma", [0.0, 0.3, 2.5])
def test_household_average_equals_a_fine_integral(spark, sigma):
    z = np.linspace(-9, 9, 40001)
    want = np.trapezoid(np.exp(-z * z / 2) / math.sqrt(2 * math.pi) / (1 + np.exp(-(0.7 + sigma * z))), z)
    got = spark.createDataFrame([(0.7, sigma)], "eta double, s double").select(dr.household_average("eta", "s", 64)).first()[0]
    assert got == pytest.approx(want, abs=1e-6)


def test_household_likelihood_by_hand(spark, sf_dir):
    """Against a direct product over members at each node."""
    people = cohort(spark, sf_dir).where("hh_id < 30")
    draws = v.sero_draws(spark, sf_dir).where("sim < 3")
    got = {r.sim: r.ll_household for r in lk.household_loglik(draws, people, v.SERO_DESIGN, "sigma_inf", 5, comp_tile=4, draw_tile=2).collect()}
    nodes = dr.quadrature(5)
    members = [r.asDict() for r in people.collect()]
    for d in draws.collect():
        total = 0.0
        for _, grp in groupby(sorted(members, key=lambda r: r["hh_id"]), key=lambda r: r["hh_id"]):
            grp, acc = list(grp), 0.0
            for z, w in nodes:
                prod = 1.0
                for r in grp:
                    eta = d["inf:(Intercept)"] + (d["inf:SexMale"] if r["Sex"] == "Male" else 0.0)
                    if r["age_cat"] != fx.SERO_AGE_REF:
                        eta += d[f"inf:age_cat{r['age_cat']}"]
                    p = 1 / (1 + math.exp(-(eta + d.sigma_inf * z)))
                    pv = r["vaccinated"] * d.vacc_response
                    true = {(1, 0): pv * (1 - p) + p * d.resp_sp_nn, (0, 1): p * d.resp_sn_np * (1 - pv), (0, 0): 1 - pv * (1 - p) - p}
                    true[1, 1] = 1 - sum(true.values())
                    mass = 0.0
                    for (s, n), q in true.items():
                        ps_ = d.sens_s if s else 1 - d.spec_s
                        pn = d.sens_n if n else 1 - d.spec_n
                        mass += q * (ps_ if r["s_result"] else 1 - ps_) * (pn if r["n_result"] else 1 - pn)
                    prod *= mass
                acc += w * prod
            total += math.log(acc)
        assert got[d.sim] == pytest.approx(total, abs=1e-8)


def test_household_effects_of_both_kinds(spark, sf_dir):
    """Vaccination against a direct product over members, tiles of any size alike, and errors that shrink with the nodes."""
    people = cohort(spark, sf_dir).where("hh_id < 40")
    draws = v.sero_draws(spark, sf_dir).where("sim < 5")

    def run(n, **tiles):
        df = lk.household_loglik(draws, people, v.SERO_DESIGN, "sigma_inf", n, sigma_vaccination="sigma_vacc", check=True, **tiles)
        return {r.sim: r for r in df.collect()}

    got, small, fine = run(6), run(6, comp_tile=1, draw_tile=1), run(16)
    members = sorted((r.asDict() for r in people.dropna(subset=list(lk.SERO_CELL)).collect()), key=lambda r: r["hh_id"])
    for d in draws.collect():
        total = 0.0
        for _, grp in groupby(members, key=lambda r: r["hh_id"]):
            grp, acc = list(grp), 0.0
            for z, w in dr.quadrature(12):
                prod = 1.0
                for r in grp:
                    eta = d["vacc:(Intercept)"] + (d["vacc:SexMale"] if r["Sex"] == "Male" else 0.0)
                    eta += 0.0 if r["age_cat"] == fx.SERO_AGE_REF else d[f"vacc:age_cat{r['age_cat']}"]
                    q = 1 / (1 + math.exp(-(eta + d.sigma_vacc * z)))
                    prod *= q if r["vaccinated"] else 1 - q
                acc += w * prod
            total += math.log(acc)
        r = got[d.sim]
        assert r.ll_vaccination == pytest.approx(total, abs=1e-8)
        assert tuple(small[d.sim]) == pytest.approx(tuple(r), abs=1e-9)
        assert fine[d.sim].error_household < 1e-6 and fine[d.sim].error_vaccination < 1e-6
        assert r.ll_household == pytest.approx(fine[d.sim].ll_household, abs=max(2 * r.error_household, 1e-6))


def test_no_household_and_no_draw(spark, sf_dir):
    people, draws = cohort(spark, sf_dir), v.sero_draws(spark, sf_dir)
    assert lk.household_loglik(draws.where("sim < 0"), people.where("hh_id < 9"), v.SERO_DESIGN, "sigma_inf").collect() == []
    assert all(r.ll_household in (0.0, None) for r in lk.household_loglik(
        draws.where("sim < 2"), people.where("hh_id < 0"), v.SERO_DESIGN, "sigma_inf").collect())


@pytest.mark.parametrize("sigma", [0.0, 0.3, 0.75, 2.5, 10.0, 40.0])
def test_adaptive_integral(spark, sigma):
    """Within the tolerance for small and large scales, with more nodes for the large ones."""
    z = np.linspace(-9, 9, 400_001)
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    rows = [(e, sigma) for e in (-6.0, -0.4, 0.7, 3.0)]
    got = spark.createDataFrame(rows, "eta double, s double").select("eta", dr.adaptive_average(F.col("eta"), F.col("s"), tol=1e-9).alias("r")).collect()
    for r in got:
        want = np.trapezoid(density / (1 + np.exp(-(r.eta + sigma * z))), z)
        assert r.r.p == pytest.approx(want, abs=1e-9) and r.r.error <= 1e-9 and r.r.nodes <= (73 if sigma < 1 else 2305)


def test_failed_integrals_are_named(spark, sf_dir):
    """With too few refinements the rows of a large scale are listed, and scoring raises an error that names one."""
    draws = v.sero_draws(spark, sf_dir).where("sim < 4").withColumn("sigma_inf", F.when(F.col("sim") == 2, 60.0).otherwise(0.4))
    rows = dr.integration_failures(draws, v.SERO_DESIGN, "sigma_inf", "inf:", refinements=2).collect()
    assert {r.sim for r in rows} == {2} and len(rows) == 18 and all(r.error > 1e-8 and r.nodes == 73 for r in rows)
    assert dr.integration_failures(draws, v.SERO_DESIGN, "sigma_inf", "inf:", refinements=9).count() == 0


def brute_smoothed(log_lik):
    """Leave-one-out density with Pareto-smoothed weights of one observation, and the tail shape, step by step in numpy."""
    log_w = -log_lik - (-log_lik).max()
    s = len(log_w)
    tail, shape = int(min(0.2 * s, 3.0 * np.sqrt(s))), np.inf
    if tail >= 5:
        order = np.argsort(log_w, kind="stable")
        top, cutoff = order[-tail:], log_w[order[-tail - 1]]
        excess = np.exp(log_w[top]) - np.exp(cutoff)
        shape = -np.inf
        if excess[0] > 0:
            m = 30 + int(np.sqrt(tail))
            b = 1 / excess[-1] + (1 - np.sqrt(m / (np.arange(1, m + 1) - 0.5))) / (3 * excess[int(tail / 4 + 0.5) - 1])
            k = np.log1p(-b[:, None] * excess).mean(axis=1)
            fit = tail * (np.log(-b / k) - k - 1)
            weight = np.exp(fit - fit.max())
            b = (b * weight).sum() / weight.sum()
            raw = np.log1p(-b * excess).mean()
            shape = (tail * raw + 5) / (tail + 10)
            prob = (np.arange(1, tail + 1) - 0.5) / tail
            log_w = log_w.copy()
            log_w[top] = np.minimum(np.log(np.exp(cutoff) - raw / b * np.expm1(-shape * np.log1p(-prob)) / shape), 0)
    both = log_w + log_lik
    return both.max() + np.log(np.exp(both - both.max()).sum()) - np.log(np.exp(log_w).sum()), shape


def test_accuracy_measures_by_brute_force(spark):
    rng = np.random.default_rng(5)
    cases = {"normal": rng.normal(-0.7, 0.05, 4000), "wide": rng.normal(-3, 1.5, 1000), "flat": np.full(50, -0.3), "few": rng.normal(-1, 0.1, 12),
             "deep": rng.normal(-800, 2, 300), "heavy": -rng.pareto(1.2, 600), "spread": np.linspace(-2000, 0, 200), "one": np.array([-0.5]),
             "ties": np.repeat(rng.normal(-1, 0.3, 30), 20)}
    rows = [(g, 3, float(x)) for g, xs in cases.items() for x in xs] + [("flat", 3, None)]
    df = spark.createDataFrame(rows, "g string, n bigint, log_lik double").repartition(5)
    smooth = {r.g: r for r in cp.psis_loo_pointwise(df, ["g"]).collect()}
    waic = {r.g: r for r in cp.waic_pointwise(df, ["g"]).collect()}
    plain = {r.g: r for r in cp.is_loo_pointwise(df, ["g"]).collect()}
    for g, x in cases.items():
        lppd = x.max() + np.log(np.mean(np.exp(x - x.max())))
        elpd, k = brute_smoothed(x)
        assert smooth[g].n == 3 and smooth[g].lppd == pytest.approx(lppd), g
        assert (smooth[g].elpd, smooth[g].pareto_k) == pytest.approx((elpd, k), rel=1e-6, abs=1e-8), g
        loo = -((-x).max() + np.log(np.mean(np.exp(-x - (-x).max()))))
        assert (plain[g].lppd, plain[g].elpd) == pytest.approx((lppd, loo)), g
        assert waic[g].lppd == pytest.approx(lppd), g
        assert waic[g].p_eff == (pytest.approx(x.var(ddof=1), rel=1e-6, abs=1e-9) if len(x) > 1 else None), g
    assert smooth["normal"].elpd == pytest.approx(plain["normal"].elpd, abs=1e-3) and smooth["normal"].pareto_k < 0.5


def test_best_model_is_the_simplest_that_is_close(spark):
    rows = [("v", "thresh-additive", -10.5, -0.5, 1.0), ("v", "thresh-interaction", -10.0, 0.0, 0.0), ("v", "thresh_od-additive", -40.0, -30.0, 2.0)]
    df = spark.createDataFrame(rows, "variant string, model_id string, elpd double, elpd_diff double, se_diff double").withColumn(
        "rank", F.expr("CAST(-elpd_diff AS INT)"))
    best = {r.model_id: r.best for r in cp.select_best_model(df).collect()}
    assert best == {"thresh-additive": True, "thresh-interaction": False, "thresh_od-additive": False}


def test_four_model_comparison(spark, sf_dir):
    parts = None
    for m in ("additive", "interaction"):
        for name, opt in (("thresh", {}), ("thresh_od", {"sigma": "sigma_od"})):
            obs = ["fit_id", "age_cat", "sex", "inf_latest", "vacc_status_3way", "child", "y"]
            w = cp.waic_pointwise(pointwise(spark, sf_dir, m, **opt), obs).withColumn("model_id", F.lit(f"{name}-{m}"))
            parts = w if parts is None else parts.unionByName(w)
    ranked = cp.select_best_model(cp.compare_models(parts, obs[1:], ["fit_id"]), ["fit_id"]).collect()
    fits = {r.fit_id for r in ranked}
    assert len(ranked) == 4 * len(fits)
    assert all(sum(r.best for r in ranked if r.fit_id == f) == 1 for f in fits)
    assert all(r.elpd_diff <= 0 for r in ranked) and sum(r["rank"] == 1 for r in ranked) == len(fits)


def test_fit_recovers_planted_coefficients(spark):
    """Outcomes drawn from known coefficients by a hash of the id."""
    d = MODELS["additive"]
    truth = {t: 0.0 for t in d.terms}
    truth.update({"(Intercept)": -0.4, "sexm": 0.5, "inf_latestinf_bef_2022": 1.0, "inf_latestinf_2022": 1.6, "vacc_status_3wayBoosted": 0.7})
    sens, spec = 0.96, 0.98
    n = 60_000
    base = spark.range(n).select(
        "id", F.element_at(F.array(*[F.lit(x) for x in AGE.labels]), (F.col("id") % 9 + 1).cast("int")).alias("age_cat"),
        F.when(F.floor(F.col("id") / 9) % 2 == 0, "f").otherwise("m").alias("sex"),
        F.element_at(F.array(*[F.lit(x) for x in fx.INFECTION_LEVELS]), (F.floor(F.col("id") / 18) % 3 + 1).cast("int")).alias("inf_latest"),
        F.element_at(F.array(*[F.lit(x) for x in fx.VACCINATION_LEVELS]), (F.floor(F.col("id") / 54) % 3 + 1).cast("int")).alias("vacc_status_3way"))
    named = base.select("*", *[F.lit(x).alias(t) for t, x in truth.items()]).withColumn("eta", F.expr(d.predictor()))
    u = (F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_003)) + 0.5) / 1_000_003
    q = sens / (1 + F.exp(-F.col("eta"))) + (1 - spec) * (1 - 1 / (1 + F.exp(-F.col("eta"))))
    hidden = (F.col("id") % 11 == 0) & (F.col("inf_latest") != "uninfected")
    c = named.select(
        F.lit("one").alias("fit_id"), "age_cat", "sex", F.when(~hidden, F.col("inf_latest")).alias("inf_latest"), "vacc_status_3way",
        F.lit(False).alias("child"), F.when(u < q, 1).otherwise(0).alias("y")).groupBy(
        "fit_id", "age_cat", "sex", "inf_latest", "vacc_status_3way", "child", "y").agg(F.count(F.lit(1)).alias("n"))
    prior = {a: 0.5 for a in AGE.labels}
    got = {r.term: r for r in ft.fit_mode(c, d, prior).collect()}
    assert got["sexm"].steps > 0
    for t, want in truth.items():
        assert abs(got[t].estimate - want) < 3.5 * got[t].se + 0.03, t
    assert 0.9 < got["sens"].estimate <= 1.0 and 0.9 < got["spec"].estimate <= 1.0
    draws = ft.fit_draws(c, d, prior, n_draws=500)
    dr.check_draw_terms(draws, d, ["sens", "spec"])
    s = {r.term: r for r in posterior_summary(draws, ["term"], "value").collect()}
    for t in d.terms:
        assert abs(s[t]["mean"] - got[t].estimate) < 5 * got[t].se / math.sqrt(500) + 1e-6
    again = ft.fit_draws(c, d, prior, n_draws=500)
    assert draws.exceptAll(again).count() == 0
