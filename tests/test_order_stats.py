"""Ranks, quantiles and narrowest intervals against numpy, with hot values, hot groups and small blocks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata_spark.operators import order_stats as os_
from strata_spark.operators import summary as sm

STATS = ["mean", "median", "q025", "q975", "hdci_lo", "hdci_hi"]


def brute(values, prob=0.95):
    x = np.sort(np.asarray([v for v in values if v is not None], float))
    n = len(x)
    step = min(math.floor(n * prob), n - 1)
    lo, hi = min(((x[i], x[i + step]) for i in range(n - step)), key=lambda p: (round(p[1] - p[0], 10), p[0]))
    return [x.mean(), *np.quantile(x, [0.5, 0.025, 0.975]), lo, hi]


def groups(seed):
    rng = random.Random(seed)
    return {
        "one": [0.25], "two": [0.5, 0.1], "equal": [0.3] * 500, "normal": [rng.gauss(0, 1) for _ in range(997)],
        "ties": [round(rng.random(), 1) for _ in range(700)], "tail": [rng.paretovariate(0.5) for _ in range(400)],
        "narrow": [1e6 + rng.random() * 1e-3 for _ in range(300)], "signs": [rng.choice([-1.0, 0.0, -0.0, 1.0]) for _ in range(100)],
        "hot": [0.5] * 5000 + [rng.random() for _ in range(300)], "holes": [None, 0.1, None, 0.7, 0.2], None: [0.4, 0.9, 0.5, 0.1]}


@pytest.fixture(scope="module")
def draws(spark):
    rows = [(g, x) for g, xs in groups(2).items() for x in xs] + [("nothing", None)]
    return spark.createDataFrame(rows, "g string, p double").repartition(6).cache()


@pytest.mark.parametrize("prob", [0.5, 0.95, 1.0])
def test_ranked_and_declared_agree_with_numpy(draws, prob):
    for frame in (sm.ranked_summary(draws, ["g"], prob=prob), sm.full_summary(draws, ["g"], prob=prob, draws=6000)):
        got = {r.g: [r[c] for c in STATS] for r in frame.collect()}
        assert set(got) == set(groups(2))
        for g, xs in groups(2).items():
            assert got[g] == pytest.approx(brute(xs, prob), abs=1e-9), (g, prob)


@pytest.mark.parametrize("block", [1, 3, 64])
def test_small_blocks(draws, block):
    """Starts and ends meet whatever the block size, and an end with many copies serves all its blocks."""
    ranked = os_.ranked_values(draws, ["g"], "p")
    got = {r.g: (r.hdci_lo, r.hdci_hi) for r in os_.narrowest(ranked, ["g"], "p", 0.8, block_ranks=block).collect()}
    for g, xs in groups(2).items():
        assert got[g] == pytest.approx(brute(xs, 0.8)[4:], abs=1e-9), (g, block)


def test_quantiles_of_a_hot_value_and_null_groups(draws):
    got = {r.g: [r[c] for c in STATS[:4]] for r in sm.ranked_quantiles(draws, ["g"], "p").collect()}
    for g, xs in groups(2).items():
        assert got[g] == pytest.approx(brute(xs)[:4], abs=1e-9), g


def test_a_million_equal_values_are_one_row(spark):
    """The rows of one value are combined before they move, and the other values of its group are spread."""
    n = 1_000_000
    df = spark.range(0, n + 40_000, 1, 8).select(
        F.lit("g").alias("g"), F.when(F.col("id") < n, 0.5).otherwise(F.col("id") * 1e-7).alias("p"))
    # parts this small would be put together again
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = os_.ranked_values(df, ["g"], "p")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranked.count() == 40_001 and ranked.agg(F.max("n")).first()[0] == n
    parts = ranked.sparkSession.read.parquet(*{f.rsplit("/", 1)[0] for f in ranked.inputFiles()})
    sizes = [r["count"] for r in parts.groupBy("_part").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 3 * sum(sizes) / len(sizes)
    xs = np.concatenate([np.full(n, 0.5), np.arange(n, n + 40_000) * 1e-7])
    r = sm.ranked_summary(df, ["g"]).first()
    assert [r[c] for c in STATS[:4]] == pytest.approx([xs.mean(), *np.quantile(xs, [0.5, 0.025, 0.975])])


def test_no_join_of_ranks(draws):
    """The interval joins ranked values with counts of parts only: no join key is a rank."""
    plan = sm.hdci(draws, ["g"])._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 1 and "upto" not in joins[0] and "Cartesian" not in plan and "NestedLoop" not in plan


def test_declared_number_is_checked(draws):
    for frame in (sm.full_summary(draws, ["g"], draws=100), sm.posterior_summary(draws, ["g"], draws=100)):
        with pytest.raises(Exception, match="declared"):
            frame.collect()


def test_extra_aggregates_with_null_groups(draws):
    for how in ({}, {"draws": 6000}):
        rows = {r.g: r.k for r in sm.full_summary(draws, ["g"], extra={"k": F.count("*")}, **how).collect()}
        assert rows["holes"] == 5 and rows[None] == 4
