"""Result store and checks that ride on the writing job."""

import pytest
from pyspark.sql import functions as F

from strata_spark.operators import cohort as co
from strata_spark.operators import draws as dr
from strata_spark.operators.checks import Checks, write_checked
from strata_spark.operators.strata import population_strata
from strata_spark.session import work_path
from strata_spark.sources import views as v
from strata_spark.sources.results import ResultStore

ROWS = "variant string, model string, age_scheme string, k int, x double"


@pytest.fixture()
def store(spark):
    return ResultStore(spark, work_path(spark, "store"))


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), ROWS)


def content(df):
    return sorted(tuple(r[c] for c in ("variant", "model", "age_scheme", "k", "x")) for r in df.collect())


def test_one_result_is_replaced_and_others_stay(spark, store):
    a, b = ("a", "m1", "10y", 1, 0.5), ("b", "m1", "10y", 2, 0.25)
    store.write(frame(spark, a, b, ("a", "m2", "10y", 3, 0.75)))
    store.write(frame(spark, ("a", "m1", "10y", 9, 0.0)))
    assert content(store.read()) == sorted([("a", "m1", "10y", 9, 0.0), b, ("a", "m2", "10y", 3, 0.75)])
    assert content(store.read(variant="a", model=["m1", "m2"])) == [("a", "m1", "10y", 9, 0.0), ("a", "m2", "10y", 3, 0.75)]
    assert store.names() == [("a", "m1", "10y"), ("a", "m2", "10y"), ("b", "m1", "10y")]


def test_names_of_any_kind(spark, store):
    """Names that look like numbers, need escapes or are missing."""
    names = ["007", "a b", "x/y=z", "é%", None]
    store.write(frame(spark, *[(n, "m", "s", i, 0.0) for i, n in enumerate(names)]))
    assert {n[0] for n in store.names()} == set(names)
    assert {r.variant for r in store.read().collect()} == set(names)
    assert [r.k for r in store.read(variant="007").collect()] == [0] and [r.k for r in store.read(variant="x/y=z").collect()] == [2]


def test_a_wrong_name_lists_the_right_ones_without_a_job(spark, store):
    with pytest.raises(ValueError, match="no results"):
        store.read()
    store.write(frame(spark, ("a", "m1", "10y", 1, 0.5), ("b", "m1", "10y", 2, 0.25)))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("wrong-name", "")
    with pytest.raises(ValueError, match=r"unknown variant \['c'\], there are \['a', 'b'\]"):
        store.read(variant=["a", "c"])
    with pytest.raises(ValueError, match="no name part"):
        store.read(colour="red")
    assert not tracker.getJobIdsForGroup("wrong-name")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    with pytest.raises(ValueError, match="no name column"):
        store.write(frame(spark, ("a", "m1", "10y", 1, 0.5)).drop("model"))


def test_complete_results_are_skipped(spark, store):
    store.write(frame(spark, ("a", "m", "s", 1, 0.0)))
    asked = []

    def compute(names):
        asked.extend(names)
        return frame(spark, *[(*n, 5, 0.0) for n in names])

    wanted = [("a", "m", "s"), ("b", "m", "s"), ("c", "m", "s")]
    assert store.fill(wanted, compute) == 2 and asked == wanted[1:]
    assert store.fill(wanted, compute) == 0 and content(store.read(variant="a")) == [("a", "m", "s", 1, 0.0)]


def test_a_large_result_is_written_by_several_tasks(spark, store):
    rows = spark.range(4000).select(F.lit("a").alias("variant"), F.lit("m").alias("model"), F.lit("s").alias("age_scheme"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.write(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = store.read().groupBy(F.input_file_name()).count().collect()
    assert len(files) > 2 and max(f["count"] for f in files) < 3000


RAW = "uid string, hh_id string, sex string, age int, S_interp string, N_interp string, vaccinated boolean"


def test_checks_count_in_the_writing_job(spark):
    good, bad = ("u", "h", "f", 30, "pos", "neg", True), ("w", "h", "x", 30, "pos", None, None)
    path, checks = work_path(spark, "cohort"), Checks()
    df = co.prepare_cohort(spark.createDataFrame([good, bad, bad], RAW), checks=checks)
    spark.sparkContext.setJobGroup("writing", "")
    with pytest.raises(ValueError, match="cohort.bad_n_result': 2, 'cohort.bad_sex': 2, 'cohort.bad_vaccinated': 2"):
        write_checked(df, lambda x: x.write.parquet(path), checks)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("writing")) == 1
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    checks = Checks()
    write_checked(co.prepare_cohort(spark.createDataFrame([good], RAW), checks=checks), lambda x: x.write.parquet(work_path(spark, "c")), checks)
    assert checks.counts()["cohort"]["n_rows"] == 1
    with pytest.raises(ValueError, match="watched already"):
        checks.watch(df, "cohort", {})


def test_panel_and_scores_are_checked(spark, sf_dir):
    checks = Checks()
    raw = v.raw_panel(spark, sf_dir).withColumn("ec50", F.when(F.col("obs_id") % 2 == 0, F.col("ec50")))
    with pytest.raises(ValueError, match="panel.bad_ec50"):
        write_checked(co.prepare_panel(raw, "age_cat_UEP", checks=checks), lambda x: x.write.parquet(work_path(spark, "p")), checks)
    checks = Checks()
    strata = population_strata(v.census(spark, sf_dir))
    draws = v.sero_draws(spark, sf_dir).withColumn("vacc_response", F.when(F.col("sim") == 1, 7.0).otherwise(F.col("vacc_response")))
    scored = dr.score_seroprevalence(draws, strata, v.SERO_DESIGN, checks=checks)
    with pytest.raises(ValueError, match="scored measures.bad_sn_nn"):
        write_checked(scored, lambda x: x.write.format("noop").mode("overwrite").save(), checks)
    assert checks.counts()["scored measures"]["bad_p_infection"] == 0


def test_terms_are_checked_in_the_same_pass(spark):
    rows = [("f", 1, 1, "a", 0.1), ("f", 1, 1, "b", 0.2), ("f", 1, 2, "a", 0.3), ("f", 1, 2, "c", 0.4)]
    checks = Checks()
    wide = dr.widen(spark.createDataFrame(rows, "fit_id string, chain int, sim int, term string, value double"), ["a", "b"], checks=checks)
    with pytest.raises(ValueError, match="'long draws.unknown_term': 1, 'draws.missing_b': 1"):
        write_checked(wide, lambda x: x.write.format("noop").mode("overwrite").save(), checks)


def test_filter_variant_names(spark):
    df = spark.createDataFrame([("BA.1/x",), ("ba.1/X",), ("B",), (None,)], "variant string")
    names = ["BA.1/x", "ba.1/X", "B"]
    assert co.filter_variant(df, "ba_1-x", names).count() == 2
    for how in ({"names": names}, {}):
        with pytest.raises(ValueError, match="unknown variant 'zz', there are"):
            co.filter_variant(df, "zz", **how)


def test_weights_by_draw(spark):
    """Each draw takes its own weights; strata and draws without weights are left out."""
    from strata_spark.functions.levels import Levels
    from strata_spark.operators.design import Design

    g, h = Levels("g", ("x", "y"), "x"), Levels("h", ("p", "q"), "p")
    design = Design((g, h))
    draws = spark.createDataFrame([("f", s, 0.1 * s, 0.2, -0.3) for s in range(5)], "fit_id string, sim bigint, a double, b double, c double").toDF(
        "fit_id", "sim", *design.terms)
    weights = {(s, a, b): 1.0 + s + (a == "x") for s in range(4) for a in "xy" for b in "pq" if (s, a, b) != (2, "y", "q")}
    strata = spark.createDataFrame([(*k, w) for k, w in weights.items()], "sim bigint, g string, h string, w double")
    got = {(r.sim, r.g, r.h): (r.seropos, r.w) for r in dr.score_strata_by_draw(draws, strata, design, (g, h), "w").collect()}
    assert {k: w for k, (_, w) in got.items()} == weights
    for (s, a, b), (p, _) in got.items():
        assert p == pytest.approx(1 / (1 + 2.718281828459045 ** -(0.1 * s + 0.2 * (a == "y") - 0.3 * (b == "q"))))
    plan = dr.score_strata_by_draw(draws, strata, design, (g, h), "w")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan.lower().replace("autobroadcast", "")
