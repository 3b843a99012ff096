"""Convergence measures against a step-by-step numpy version."""

import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata_spark.operators import convergence as cv

DRAWS = "fit_id string, term string, chain int, sim int, value double"


def scores(x):
    x = np.asarray(x)
    order = np.sort(x)
    rank = (np.searchsorted(order, x, "left") + 1 + np.searchsorted(order, x, "right")) / 2
    return np.array([NormalDist().inv_cdf((r - 0.375) / (len(x) + 0.25)) for r in rank])


def brute(chains):
    halves = [h for c in chains if len(c) >= 4 for h in (c[: len(c) // 2], c[len(c) - len(c) // 2:])]
    pooled = np.concatenate(halves)
    cut = np.cumsum([len(h) for h in halves])[:-1]
    n = min(map(len, halves))

    def parts(z):
        zs = np.split(z, cut)
        w, b = np.mean([x.var(ddof=1) for x in zs]), np.var([x.mean() for x in zs], ddof=1)
        return zs, w, (n - 1) / n * w + b

    zs, w, total = parts(scores(pooled))
    _, wf, totalf = parts(scores(abs(pooled - np.median(pooled))))
    acov = [np.mean([np.dot((x - x.mean())[: len(x) - t], (x - x.mean())[t:]) / len(x) for x in zs]) for t in range(n)]
    rho = [1 - (w - a) / total for a in acov]
    tau, last = -1.0, np.inf
    for k in range(n // 2):
        p = rho[2 * k] + rho[2 * k + 1]
        if p < 0:
            break
        last = min(last, p)
        tau += 2 * last
    size = len(halves) * n
    return max(np.sqrt(total / w), np.sqrt(totalf / wf)), min(size / tau if tau > 0 else np.inf, size * np.log10(size))


def walk(rng, n, keep, start=0.0):
    x, out = start, []
    for _ in range(n):
        x = keep * x + rng.gauss(0, 1)
        out.append(x)
    return out


def cases():
    rng = random.Random(4)
    return {
        "one": [walk(rng, 200, 0.0)], "sticky": [walk(rng, 300, 0.95) for _ in range(4)], "anti": [walk(rng, 200, -0.6) for _ in range(2)],
        "apart": [[x + 3 * c for x in walk(rng, 100, 0.0)] for c in range(4)], "drift": [[i / 20 + rng.gauss(0, 1) for i in range(101)]],
        "ties": [[float(round(x)) for x in walk(rng, 90, 0.5)] for _ in range(3)], "heavy": [[rng.paretovariate(0.7) for _ in range(80)] for _ in range(4)],
        "uneven": [walk(rng, 50, 0.3), walk(rng, 71, 0.3)], "spread": [[x * (1 + 4 * c) for x in walk(rng, 100, 0.0)] for c in range(4)]}


def frame(spark, table):
    return spark.createDataFrame([("f", t, c, i, x) for t, chains in table.items() for c, xs in enumerate(chains) for i, x in enumerate(xs)], DRAWS)


def test_against_brute_force(spark):
    table = cases()
    got = {r.term: r for r in cv.convergence(frame(spark, table).orderBy(F.rand(3))).collect()}
    for term, chains in table.items():
        assert (got[term].rhat, got[term].ess) == pytest.approx(brute([np.asarray(c) for c in chains]), rel=1e-7), term
    assert got["one"].n_halves == 2 and got["one"].rhat < 1.05 and got["one"].ess > 100
    # correlated draws count for far less than their number, and trouble shows in R-hat
    assert got["sticky"].ess < 0.1 * 1200 and got["apart"].rhat > 1.3 and got["drift"].rhat > 1.3 and got["spread"].rhat > 1.1


def test_no_measure_without_spread_or_draws(spark):
    table = {"flat": [[1.0] * 20] * 2, "short": [[1.0, 2.0, 3.0]], "good": [[1.0, 3.0, 2.0, 5.0]]}
    got = {r.term: r for r in cv.convergence(frame(spark, table)).collect()}
    assert got["flat"].rhat is None and got["flat"].ess is None and "short" not in got and got["good"].rhat is not None


def test_chain_length_is_checked(spark):
    with pytest.raises(Exception, match="declared"):
        cv.convergence(frame(spark, {"t": [[1.0, 2.0] * 20]}), max_chain=30).collect()


def test_normal_quantile(spark):
    ps = [1e-300, 1e-30, 1e-12, 1e-5, 0.02, 0.07, 0.0751, 0.3, 0.5, 0.8, 0.93, 0.999, 1 - 1e-10]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(cv.normal_quantile(F.col("p"))).collect()
    assert [r[0] for r in got] == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-12)
