"""One test per semantic trap, on small literals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata_spark import fixed_values as fx
from strata_spark.functions.levels import (
    AGE, INFECTION, PANEL_AGE, PANEL_SEX, VACCINATION, Levels, cut, level_table, lower_bound, within_levels)
from strata_spark.functions.scalars import bernoulli_log_mass, count_percent_text, fixed, flatten_text, interval_text, logit, snake
from strata_spark.operators import cohort as co
from strata_spark.operators import poststrat as ps
from strata_spark.operators import risk
from strata_spark.operators import strata as st
from strata_spark.operators import summary as sm
from strata_spark.operators.design import MODELS, Design, design_rows, model_design, require_same_terms, scenario_rows
from strata_spark.operators.draws import check_draw_terms
from strata_spark.operators.likelihood import flat_prior, scenario_prior
from strata_spark.operators.numbering import number_by_id, rank_draws
from strata_spark.operators.status import JOINT_LABELS, observed_status, result_mass, true_status
from strata_spark.operators.summary import ranked_quantiles
from strata_spark.plans.report import category_rank, full_join_null_safe, prevalence_table, with_group_headers
from strata_spark.sources.tables import parse_result_name, read_csv


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_cut_is_left_closed_and_closes_the_last_bin(spark):
    df = spark.createDataFrame([(x,) for x in (-1, 0, 5, 6, 74, 75, 105, 106, None)], "age int")
    got = [r[0] for r in df.select(cut("age", fx.AGE_BREAKS)).collect()]
    assert got == [None, "[0,6)", "[0,6)", "[6,12)", "[65,75)", "[75,105]", "[75,105]", None, None]


def test_level_order_and_reference_are_declared(spark):
    df = spark.createDataFrame([("[75,105]", "b"), ("[0,6)", "a")], "age_cat string, g string")
    g = Levels("g", ("a", "b", "c"), "b")
    rows = {(r.var, r.label): (r.ordinal, r.is_ref) for r in level_table(df, [AGE, g]).collect()}
    assert rows == {("age_cat", "[0,6)"): (0, False), ("age_cat", "[75,105]"): (8, False), ("g", "a"): (0, False), ("g", "b"): (1, True)}
    with pytest.raises(ValueError):
        Levels("g", ("a",), "z")


def test_codes_start_at_the_reference(spark):
    df = spark.createDataFrame([("[35,50)",), ("[0,6)",), ("x",)], "a string")
    assert [r[0] for r in df.select(PANEL_AGE.codes(F.col("a"))).collect()] == [1, 2, None]


def scored(spark):
    return spark.createDataFrame([
        (1, "a", "Female", 1.0, 0.2), (1, "a", "Male", 3.0, 0.6), (1, "b", "Female", 2.0, 0.5), (1, "b", "Male", 2.0, 0.1),
        (2, "a", "Female", 1.0, 0.4), (2, "a", "Male", 3.0, 0.4), (2, "b", "Female", 2.0, 0.4), (2, "b", "Male", 2.0, 0.8),
    ], "sim int, age_cat string, Sex string, strata_pop double, seropos double")


def test_conditional_and_marginal_estimates_differ(spark):
    cond = {(r.sim, r["var"], r["val"]): r.p for r in ps.conditional_estimates(scored(spark), "a", "Female").collect()}
    marg = {(r.sim, r["var"], r["val"]): r.p for r in ps.marginal_estimates(scored(spark)).collect()}
    assert cond[1, "Age", "a"] == pytest.approx(0.2) and marg[1, "Age", "a"] == pytest.approx(0.5)
    assert cond[1, "Sex", "Male"] == pytest.approx(0.6) and marg[1, "Sex", "Male"] == pytest.approx(2.0 / 5)
    assert cond[1, "Overall", ""] == pytest.approx(marg[1, "Overall", ""]) == pytest.approx(3.2 / 8)


def test_ties_count_below_for_signs_and_in_no_tail_for_risks(spark):
    draws = spark.createDataFrame(
        [(1, "Sex", "F", 0.4), (1, "Sex", "M", 0.4), (2, "Sex", "F", 0.4), (2, "Sex", "M", 0.5)],
        "sim int, var string, val string, p double")
    signs = {(r.sim, r.val): r.coef_sign for r in risk.sign_vs_reference(draws, {"Sex": "F"}).collect()}
    assert signs == {(1, "F"): None, (2, "F"): None, (1, "M"): -1, (2, "M"): 1}
    rr = {r.val: r for r in risk.relative_risk(draws, {"Sex": "F"}).collect()}
    assert rr["M"].p_tail == 0.0 and rr["M"]["mean"] == pytest.approx(1.125)
    assert rr["F"]["mean"] is None and rr["F"].p_tail is None


def test_null_keys_match_in_the_full_join(spark):
    a = spark.createDataFrame([("x", None, 1), ("y", "k", 2)], "g string, h string, a int")
    b = spark.createDataFrame([("x", None, 10), ("z", "k", 20)], "g string, h string, b int")
    got = sorted(values(full_join_null_safe(a, b, ["g", "h"]), "g", "h", "a", "b"), key=str)
    assert got == sorted([("x", None, 1, 10), ("y", "k", 2, None), ("z", "k", None, 20)], key=str)


def weights_of(spark, rows):
    return spark.createDataFrame(rows, "age_cat string, vacc_status_3way string, inf_latest string, strata_size double")


def test_reallocation_edges(spark):
    levels = ("uninfected", "inf_bef_2022", "inf_2022")
    sizes = {("a", "v"): (50.0, 30.0, 20.0), ("a", "w"): (100.0, 0.0, 0.0), ("b", "v"): (60.0, 0.0, 0.0), ("c", "v"): (10.0, 10.0, 30.0)}
    w = weights_of(spark, [(a, v, lv, s) for (a, v), ss in sizes.items() for lv, s in zip(levels, ss)])
    ext = spark.createDataFrame([("a", 50.0), ("b", 30.0), ("c", 400.0)], "age_cat string, pc_inf_external double")
    got = {(r.age_cat, r.vacc_status_3way, r.inf_latest): r.strata_size_new for r in st.reallocate(w, ext).collect()}
    # a: the sample has 25% infected, the outside share is twice that
    assert [got["a", "v", x] for x in levels] == pytest.approx([0.0, 60.0, 40.0])
    assert [got["a", "w", x] for x in levels] == pytest.approx([100.0, 0.0, 0.0])
    # b: nothing infected in the sample, so no change, and flagged
    assert [got["b", "v", x] for x in levels] == pytest.approx([60.0, 0.0, 0.0])
    # c: more than the group holds: 2022 first, then what is left
    assert [got["c", "v", x] for x in levels] == pytest.approx([0.0, 0.0, 50.0])
    flags = {r.age_cat: (r.no_change, r.pc_ratio) for r in st.infection_ratio(w, ext).collect()}
    assert flags["b"] == (True, 1.0) and flags["a"] == (False, pytest.approx(2.0))


def test_reallocation_keeps_draws_when_asked(spark):
    w = weights_of(spark, [("a", "v", "uninfected", 60.0), ("a", "v", "inf_bef_2022", 20.0), ("a", "v", "inf_2022", 20.0)])
    ext = spark.createDataFrame([(1, "a", 20.0), (2, "a", 60.0)], "sim int, age_cat string, pc_inf_external double")
    got = {(r.sim, r.inf_latest): r.strata_size_new for r in st.reallocate(w, ext, by_draw=True).collect()}
    assert got[1, "uninfected"] == pytest.approx(80.0) and got[2, "uninfected"] == pytest.approx(40.0)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 101])
def test_quantile_rule(spark, n):
    np = pytest.importorskip("numpy")
    x = np.sin(np.arange(n) * 1.7) * 0.4 + 0.5
    df = spark.createDataFrame([("g", float(v)) for v in x], "g string, p double")
    want = np.quantile(x, [0.5, 0.025, 0.975])
    r = sm.full_summary(df, ["g"]).first()
    c = sm.posterior_summary(df, ["g"]).first()
    assert [r.median, r.q025, r.q975] == pytest.approx(list(want))
    assert [c.q025, c.q975] == pytest.approx(list(want[1:]))
    s, k = np.sort(x), int(np.floor(0.95 * n))
    best = min(range(n - k), key=lambda i: (round(s[i + k] - s[i], 10), s[i]))
    assert (r.hdci_lo, r.hdci_hi) == pytest.approx((s[best], s[best + k]))


def test_name_without_match_gives_null(spark):
    df = spark.createDataFrame([("nothing/here.rds",), ("neut_stan_output_thresh_od_interaction_var-a_age_cat_10y.rds",)], "path string")
    rows = df.select(*[c.alias(k) for k, c in parse_result_name(F.col("path")).items()]).collect()
    assert tuple(rows[0]) == (None, None, None, None)
    assert tuple(rows[1]) == ("interaction", "thresh_od", "var-a", "age_cat_10y")


def test_display_rounding(spark):
    df = spark.createDataFrame([(0.25,), (0.35,), (2.5,), (99.95,)], "x double")
    assert [r[0] for r in df.select(fixed(F.col("x"), 1)).collect()] == ["0.3", "0.4", "2.5", "100.0"]
    one = spark.range(1)
    assert one.select(interval_text(F.lit(0.123), F.lit(0.1), F.lit(0.2), 1, 100.0)).first()[0] == "12.3 (10.0-20.0)"
    assert one.select(count_percent_text(F.lit(1), F.lit(3))).first()[0] == "1 (33.3%)"
    assert one.select(count_percent_text(F.lit(0), F.lit(0))).first()[0] is None


def test_tail_probability_never_exceeds_one(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, -0.5, 0.2, 3.0)], "x double")
    x = F.col("x")
    assert df.agg(sm.tail_probability(x > 0, x < 0)).first()[0] == 1.0


def counts_for(spark):
    rows = [("a", "Female", 1, 0, 1), ("a", "Male", 0, 0, 0), ("b", "Male", 1, 1, 1)]
    return co.stacked_counts(spark.createDataFrame(rows, "age_cat string, Sex string, s_result int, n_result int, vaccinated int"))


def test_reference_rows_have_null_and_dashes(spark):
    rows = {(r["var"], r.val): r for r in prevalence_table(
        scored(spark), counts_for(spark), {"Age": "a", "Sex": "Female"}).collect()}
    assert rows["Age", "a"].tail_text == "--" and rows["Age", "a"].p_tail is None
    assert rows["Age", "all"].tail_text == "--" and rows["Age", "all"].n == 3
    assert rows["Sex", "Male"].p_tail is not None


def test_empty_subset_is_null(spark):
    df = spark.createDataFrame([(1, 0.5, 0.0)], "sim int, p double, w double")
    assert ps.weighted_mean(df, ["sim"], "p", "w").first().p is None


def test_literal_only_levels_vanish_on_completion(spark):
    truth = spark.createDataFrame([("[0,6)", "No vacc", "uninfected"), ("[6,12)", "No vacc", "inf_2022")],
                                  "age_cat string, vacc_status_3way string, inf_latest string")
    vacc = spark.createDataFrame(
        [("[0,6)", "No vacc", 100.0, 50.0), ("[6,12)", "No vacc", 200.0, 10.0), ("all", "No vacc", 300.0, 20.0)],
        "age_cat string, vacc_status_3way string, pop_total double, percentage double")
    got = {tuple(r)[:3]: r.strata_size for r in st.strata_weights(truth, vacc).collect()}
    assert got == {
        ("[0,6)", "No vacc", "uninfected"): pytest.approx(50.0), ("[0,6)", "No vacc", "inf_2022"): 0.0,
        ("[6,12)", "No vacc", "inf_2022"): pytest.approx(20.0), ("[6,12)", "No vacc", "uninfected"): 0.0}


def test_joint_statuses_are_named_not_placed(spark):
    # resp_sn_np = 0.1 of infections answer with N only, 0.3 with S only
    true = true_status(F.lit(1.0), F.lit(0.0), F.lit(0.1), F.lit(0.3))
    row = spark.range(1).select(*[c.alias(JOINT_LABELS[k]) for k, c in true.items()]).first()
    assert row["S-N+"] == pytest.approx(0.1) and row["S+N-"] == pytest.approx(0.3)
    assert row["S+N+"] == pytest.approx(0.6) and row["S-N-"] == pytest.approx(0.0)


def test_result_mass_is_the_observed_probability_of_the_row(spark):
    true = true_status(F.lit(0.4), F.lit(0.3), F.lit(0.1), F.lit(0.2))
    acc = [F.lit(x) for x in (0.95, 0.98, 0.9, 0.97)]
    seen = observed_status(true, *acc)
    one = spark.range(1)
    total = one.select(*[c.alias(k) for k, c in seen.items()]).first().asDict()
    assert sum(total.values()) == pytest.approx(1.0)
    for s, n, name in ((1, 1, "sp_np"), (0, 1, "sn_np"), (1, 0, "sp_nn"), (0, 0, "sn_nn")):
        got = one.select(result_mass(true, F.lit(s), F.lit(n), *acc)).first()[0]
        assert got == pytest.approx(total[name])


def test_both_designs_share_one_reference(spark):
    base = [("[35,50)", "f", lv, "Dose 1 or 2 only") for lv in (*INFECTION.labels, None)]
    df = spark.createDataFrame(base, "age_cat string, sex string, inf_latest string, vacc_status_3way string")
    d = MODELS["additive"]
    full = design_rows(df.where("inf_latest IS NOT NULL"), d, ["inf_latest"]).collect()
    both = scenario_rows(df, d).collect()
    on = {r.inf_latest: (r["inf_latestinf_bef_2022"], r["inf_latestinf_2022"]) for r in full}
    assert on == {"uninfected": (0, 0), "inf_bef_2022": (1, 0), "inf_2022": (0, 1)}
    assert {r.scenario: (r["inf_latestinf_bef_2022"], r["inf_latestinf_2022"]) for r in both} == {
        "inf_bef_2022": (1, 0), "inf_2022": (0, 1)}
    assert len(d.terms) == 14 and len(MODELS["interaction"].terms) == 18


def test_terms_are_compared_by_name(spark):
    require_same_terms(["a", "b"], ["b", "a"])
    with pytest.raises(ValueError, match="only left"):
        require_same_terms(["a", "c"], ["a", "b"])
    d = Design((Levels("g", ("x", "y"), "x"),))
    good = spark.createDataFrame([("f", 0, 0, "(Intercept)", 0.0), ("f", 0, 0, "gy", 1.0)], "fit_id string, chain int, sim int, term string, value double")
    check_draw_terms(good, d)
    with pytest.raises(ValueError):
        check_draw_terms(good.where("term = 'gy'"), d)


def test_prior_is_looked_up_by_label(spark):
    df = spark.createDataFrame([("[35,50)",), ("[0,6)",)], "age_cat string")
    before, late = scenario_prior(F.col("age_cat"), dict(fx.OTHER_INFECTION_PRIOR))
    got = df.select(F.exp(before), F.exp(late)).collect()
    assert set(flat_prior().values()) == {0.45} and len(flat_prior()) == 9
    assert tuple(got[0]) == pytest.approx((0.546, 0.454)) and tuple(got[1]) == pytest.approx((0.417, 0.583))


def test_unknown_names_are_errors(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "variant string, x int")
    assert co.filter_variant(df, "b").count() == 1
    with pytest.raises(ValueError, match="unknown variant 'c'"):
        co.filter_variant(df, "c")
    with pytest.raises(ValueError, match="additive, interaction"):
        model_design("cubic")
    with pytest.raises(ValueError, match="no age scheme"):
        co.prepare_panel(df, "age_cat_none")


def test_both_results_are_required(spark):
    rows = [("1", "1", "f", 3, "pos", None, True)]
    df = co.prepare_cohort(spark.createDataFrame(
        rows, "uid string, hh_id string, sex string, age int, S_interp string, N_interp string, vaccinated boolean"))
    with pytest.raises(ValueError, match="bad_n_result"):
        co.require(df, co.cohort_rules())


def test_names_and_slugs(spark):
    assert [snake(x) for x in ("age_cat_UEP", "vacc_status_3way", "S interp", "ageCat")] == [
        "age_cat_uep", "vacc_status_3way", "s_interp", "age_cat"]
    df = spark.createDataFrame([("Omicron\nBA.4/BA.5",)], "v string")
    assert df.select(flatten_text(F.col("v"))).first()[0] == "omicron_ba_4-ba_5"


def test_subset_names_and_labels(spark):
    specs = ps.subset_specs([VACCINATION], [(INFECTION, VACCINATION)])
    assert len(specs) == 12
    cat = {r.subset_id: r for r in ps.subset_catalog(spark, specs).collect()}
    assert cat[1].expr == "vacc_status_3way = 'No vacc'" and cat[1].postrat_name == "vacc_status_3way:Novacc"
    assert cat[4].postrat_name == "inf_latest:uninfected&vacc_status_3way:Novacc"
    assert cat[5].postrat_name.startswith("inf_latest:inf_bef_2022")
    df = spark.createDataFrame([("all",), ("age_cat:[0,6)",), ("sex:f",), ("inf_latest:inf_2022",), (cat[4].postrat_name,)], "postrat_name string")
    assert values(ps.label_estimates(df), "var_cat", "var") == [
        ("all", "all"), ("age_cat", "[0,6)"), ("sex", "f"), ("inf_latest", "inf_2022"),
        ("inf_latest:vacc_status_3way", "uninfected:Novacc")]


def test_report_order_and_headers(spark):
    df = spark.createDataFrame([(x,) for x in ("all", "[75,105]", "Female", "[0,6)", "Male", "[12,18)")], "val string")
    assert [r[0] for r in df.orderBy(category_rank(F.col("val"))).collect()] == ["[0,6)", "[12,18)", "[75,105]", "Male", "Female", "all"]
    assert df.where("val = '[12,18)'").select(lower_bound(F.col("val"))).first()[0] == 12
    rep = spark.createDataFrame([("Sex", 1, "women", 1), ("Sex", 1, "men", 2), ("All", 0, "all", 0)], "variable string, vo int, label string, lo int")
    got = [tuple(r) for r in with_group_headers(rep, "variable", "vo", "lo").orderBy("vo", "lo").select("variable", "label", "is_header").collect()]
    assert got == [("All", None, True), ("All", "all", False), ("Sex", None, True), ("Sex", "women", False), ("Sex", "men", False)]


def test_census_comments_and_top_age(spark, tmp_path):
    (tmp_path / "c.csv").write_text("# source\nAge,Sex,Total\n3,Female,10\n>= 105,Female,5\nx,Male,7\n80,Male,NA\n104,Male,2\n")
    census = read_csv(spark, str(tmp_path / "c.csv"), "Age string, Sex string, Total double", comment="#")
    got = {(r.Sex, r.age_cat): (r.strata_pop, r.percent) for r in st.population_strata(census).collect()}
    assert got == {("Female", "[0,6)"): (10.0, 10 / 17), ("Female", "[75,105]"): (5.0, 5 / 17), ("Male", "[75,105]"): (2.0, 2 / 17)}


def test_logit(spark):
    assert spark.range(1).select(logit(F.lit(0.5))).first()[0] == 0.0


def test_missing_values_are_not_zeros(spark):
    df = spark.createDataFrame([(1, None, 1.0), (1, 1.0, 1.0), (2, 0.5, 2.0), (3, 0.5, None)], "sim int, seropos double, strata_pop double")
    assert values(ps.weighted_mean(df, ["sim"]).orderBy("sim"), "sim", "p") == [(1, None), (2, 0.5), (3, None)]
    cohort = spark.createDataFrame([("a", None, 1, 1), ("a", 0, None, 0), ("a", 1, 0, None)], "g string, s_result int, n_result int, vaccinated int")
    assert tuple(co.sample_counts(cohort, "g").first()) == ("a", 3, 1, 1, 1, 1, 1)
    mass = spark.createDataFrame([(None,), (1,), (0,)], "y int").select(F.exp(bernoulli_log_mass(F.col("y"), F.lit(0.25)))).collect()
    assert [r[0] for r in mass] == [None, pytest.approx(0.25), pytest.approx(0.75)]


def test_missing_keys_are_numbered(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 5), (None, 3)], "g string, id bigint")
    got = {(r.g, r.id): r.k for r in number_by_id(df, ["g"], "id", "k").collect()}
    assert got == {("a", None): 1, ("a", 1): 2, (None, 3): 1, (None, 5): 2}


@pytest.mark.parametrize("values_", [[0.25] * 400, [1e-9 * i for i in range(1, 400)], [1e6 + 7.5 * i for i in range(400)], [2.0 ** (i - 200) for i in range(400)], [-3.0, 0.0, 1e-320, 2.0]])
def test_ranks_of_any_distribution(spark, values_):
    df = spark.createDataFrame([(x,) for x in reversed(values_)], "p double").withColumn("g", F.lit(1))
    ranked = sorted((r["rank"], r.p) for r in rank_draws(df, ["g"], "p").collect())
    assert ranked == list(enumerate(sorted(values_), start=1))
    q = ranked_quantiles(df, ["g"], "p").first()
    assert [q.q025, q["median"], q.q975] == pytest.approx(list(np.quantile(values_, [0.025, 0.5, 0.975])))


def test_labels_that_are_not_declared_are_errors(spark):
    df = spark.createDataFrame([("f",), ("x",)], "sex string")
    with pytest.raises(Exception, match="label not declared: x"):
        within_levels(df, [PANEL_SEX]).collect()
