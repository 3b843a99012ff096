"""Posterior draws: contract, scoring at strata, household integral, convergence.

Long draws are ``(fit_id, chain, sim, term, value)``. Scoring uses the wide
form, one row per draw with a column per coefficient, so a linear predictor is
one expression and no ``(draw, stratum, term)`` rows are ever shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata_spark.functions.levels import AGE, SEX, Levels, fan_out, grid_size, within_levels
from strata_spark.functions.scalars import logistic, ratio
from strata_spark.operators.checks import Checks, probability_rules, watched
from strata_spark.operators.design import Design, require_same_terms
from strata_spark.operators.status import any_antibody, true_status
from strata_spark.session import broadcast_bounded

DRAW_KEYS = ("fit_id", "chain", "sim")


def widen(draws: DataFrame, terms: Sequence[str], prefix: str = "", checks: Checks | None = None) -> DataFrame:
    """Long draws to one row per draw. The term list is declared, not read.

    With ``checks`` terms that are not declared, and draws that lack a declared one, are counted in the same pass.
    """
    draws = watched(checks, draws, f"{prefix}long draws", {"unknown_term": F.col("term").isin(*terms)})
    wide = draws.groupBy(*DRAW_KEYS).agg(
        *[F.max(F.when(F.col("term") == t, F.col("value"))).alias(f"{prefix}{t}") for t in terms])
    return watched(checks, wide, f"{prefix}draws", {f"missing_{t}": F.col(f"`{prefix}{t}`").isNotNull() for t in terms})


def check_draw_terms(draws: DataFrame, design: Design, extra: Sequence[str] = ()) -> None:
    """Raise unless the terms of ``draws`` are those of the design plus ``extra``."""
    declared = [*design.terms, *extra]
    terms = draws.select("term").distinct()
    found = [r.term for r in terms.where(F.col("term").isin(*declared)).collect()]
    # one name is enough to tell that there are others
    other = terms.agg(F.min(F.when(~F.col("term").isin(*declared), F.col("term"))).alias("term")).first().term
    require_same_terms(found + ([other] if other is not None else []), declared)


def spread(draws: DataFrame, *keys: str) -> DataFrame:
    """Draws over all cores, by fit and the given keys.

    A draws table is small in bytes but every row is scored many times, so its
    partitions follow the number of shuffle partitions and not its size; runtime
    would put partitions this small together. The cores that are there
    just now do not matter, they may become more.
    """
    keys = [*(["fit_id"] if "fit_id" in draws.columns and "fit_id" not in keys else []), *keys]
    return draws.repartition(int(draws.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def quadrature(n_nodes: int) -> list[tuple[float, float]]:
    """Gauss-Hermite nodes and weights for an average over a standard normal."""
    x, w = np.polynomial.hermite.hermgauss(n_nodes)
    return [(float(a * np.sqrt(2.0)), float(b / np.sqrt(np.pi))) for a, b in zip(x, w)]


def household_average(eta: str, sigma: str, n_nodes: int = 32) -> Column:
    """``E[logistic(eta + sigma * Z)]`` for a standard normal ``Z``: prevalence over households.

    ``eta`` and ``sigma`` are column names; the nodes are inlined as one sum.
    """
    return F.expr(" + ".join(
        f"{w!r}D / (1D + exp(-(`{eta}` + `{sigma}` * {z!r}D)))" for z, w in quadrature(n_nodes)))


#: Equidistant nodes reach this far from zero on either side, where the normal density is below 1e-18 of its top.
REACH = 9
TOLERANCE = 1e-8
REFINEMENTS = 8


def adaptive_average(eta: Column, sigma: Column, tol: float = TOLERANCE, refinements: int = REFINEMENTS) -> Column:
    """``E[logistic(eta + sigma * Z)]`` as ``(p, error, nodes)``, refined row by row until a halved step changes it by at most ``tol``.

    The trapezoidal rule over the whole line converges exponentially, and a halved step uses all earlier nodes again.
    A row that has converged evaluates no further nodes; one that has not after ``refinements`` keeps its ``error`` above
    ``tol``.
    """
    def summed(step: float, odd: bool) -> Column:
        reach = round(REACH / step)
        first = -reach + (reach + 1) % 2 if odd else -reach
        # nodes are computed from their numbers, so the expression stays small however many there are
        numbers = F.sequence(F.lit(first), F.lit(reach), F.lit(2 if odd else 1))

        def term(i: Column) -> Column:
            z = i * step
            return F.exp(z * z * -0.5) * (step / math.sqrt(2.0 * math.pi)) / (1.0 + F.exp(-(eta + sigma * z)))

        return F.aggregate(numbers, F.lit(0.0), lambda a, i: a + term(i))

    def bound(value: Column, function) -> Column:
        return F.transform(F.array(value), function)[0]

    def refined(coarse: Column, level: int) -> Column:
        step = 0.5 ** level

        def judged(fine: Column) -> Column:
            done = F.struct(fine.alias("p"), F.abs(fine - coarse).alias("error"), F.lit(2 * round(REACH / step) + 1).alias("nodes"))
            if level == refinements:
                return done
            return F.when(F.abs(fine - coarse) <= tol, done).otherwise(refined(fine, level + 1))

        return bound(coarse / 2.0 + summed(step, odd=True), judged)

    return bound(summed(1.0, odd=False), lambda first: refined(first, 1))


def integration_failures(draws: DataFrame, design: Design, sigma: str, prefix: str = "", factors: Sequence[Levels] = (AGE, SEX),
                         keep: Sequence[str] = ("sim",), tol: float = TOLERANCE, refinements: int = REFINEMENTS) -> DataFrame:
    """The draws and strata whose integral has not reached ``tol``, with predictor, scale, error and nodes."""
    keys = [f.name for f in factors]
    rows = fan_out(spread(draws, "sim"), *factors).select(*keep, *keys, F.expr(design.predictor(prefix)).alias("eta"), F.col(sigma).alias("sigma"))
    found = rows.withColumn("_i", adaptive_average(F.col("eta"), F.col("sigma"), tol, refinements))
    return found.select(*keep, *keys, "eta", "sigma", "_i.p", "_i.error", "_i.nodes").where(F.col("error") > tol)


def integration_errors(draws: DataFrame, design: Design, sigma: str, prefix: str = "",
                       factors: Sequence[Levels] = (AGE, SEX), nodes: tuple[int, int] = (16, 32),
                       tol: float = 1e-6) -> DataFrame:
    """Per stratum: draws whose integral changes by more than ``tol`` between node counts."""
    scored = fan_out(spread(draws, "sim"), *factors).withColumn("_eta", F.expr(design.predictor(prefix))).withColumn(
        "error", F.abs(household_average("_eta", sigma, nodes[0]) - household_average("_eta", sigma, nodes[1])))
    return scored.groupBy(*[f.name for f in factors]).agg(
        F.count(F.lit(1)).alias("n_draws"),
        F.count_if(F.col("error") > tol).alias("n_failed"),
        F.max("error").alias("max_error"))


def score_strata(draws: DataFrame, strata: DataFrame, design: Design, factors: Sequence[Levels],
                 weight: str, keep: Sequence[str] = ("sim",), prefix: str = "", name: str = "seropos",
                 checks: Checks | None = None) -> DataFrame:
    """Probability of every draw at every stratum, with the stratum weight; ``checks`` counts values that are no probability.

    Strata have one row per combination of declared levels (other labels are
    an error), so their number is bounded and they are broadcast; the draws
    stay where they are.
    """
    keys = [f.name for f in factors]
    strata = within_levels(strata, factors)
    scored = fan_out(spread(draws, "sim"), *factors).select(*keep, *keys, logistic(F.expr(design.predictor(prefix))).alias(name))
    joined = scored.join(broadcast_bounded(strata.select(*keys, weight), grid_size(*factors)), keys, "inner")
    return watched(checks, joined, "scored strata", {**probability_rules([name]), "bad_weight": F.col(weight) >= 0})


def score_strata_by_draw(draws: DataFrame, strata: DataFrame, design: Design, factors: Sequence[Levels],
                         weight: str, keep: Sequence[str] = ("sim",), prefix: str = "", name: str = "seropos",
                         draw: str = "sim") -> DataFrame:
    """Like ``score_strata`` for strata whose weights differ from draw to draw.

    The weights of a draw are one row, an array over the declared grid of levels, so the join is one row a draw on
    either side, shuffled by draw whatever their number; draws are fanned out over the grid after it. A stratum that a draw
    has no weight for is left out, a draw without weights too.
    """
    keys = [f.name for f in factors]

    def place(frame_factors: Sequence[Levels]) -> Column:
        out = F.lit(0)
        for f in frame_factors:
            out = out * len(f.labels) + f.ordinal(F.col(f.name))
        return out

    listed = within_levels(strata, factors).groupBy(draw).agg(F.map_from_entries(F.collect_list(
        F.struct(place(factors).alias("at"), F.col(weight).alias("w")))).alias("_weights"))
    paired = spread(draws, draw).join(listed, draw, "inner")
    rows = fan_out(paired, *factors).select(
        *keep, *keys, logistic(F.expr(design.predictor(prefix))).alias(name), F.col("_weights")[place(factors)].alias(weight))
    return rows.where(F.col(weight).isNotNull())


def score_seroprevalence(
    draws: DataFrame, strata: DataFrame, design: Design, *, keep: Sequence[str] = ("sim",),
    factors: Sequence[Levels] = (AGE, SEX), weight: str = "strata_pop",
    infection_prefix: str = "inf:", vaccination_prefix: str = "vacc:",
    sigma_infection: str | None = None, sigma_vaccination: str | None = None,
    coverage: str | None = None, n_nodes: int = 32, carry: Sequence[str] = (), tol: float | None = None,
    checks: Checks | None = None,
) -> DataFrame:
    """Infection, vaccination, joint and any-antibody probabilities per draw and stratum.

    Draws carry both coefficient sets and ``resp_sn_np``, ``resp_sp_nn`` and
    ``vacc_response``. With a sigma column the probability is integrated over
    households, with ``n_nodes`` or, given ``tol``, refined row by row; a row that does not reach
    it is an error that names its draw. With ``coverage`` (a column of ``strata``) vaccination comes
    from outside instead of from the model. ``carry`` names further strata
    columns to keep; ``checks`` counts values that are no probability.
    """
    keys = [f.name for f in factors]

    def probability(eta: str, sigma: str | None) -> Column:
        if sigma is None or tol is None:
            return logistic(F.col(eta)) if sigma is None else household_average(eta, sigma, n_nodes)
        told = F.concat(F.lit("no convergence of the household integral of draw "), F.concat_ws("/", *[F.col(k).cast("string") for k in keep]),
                        F.lit(", scale "), F.col(sigma).cast("string"))
        return F.transform(F.array(adaptive_average(F.col(eta), F.col(sigma), tol)), lambda r: F.when(
            r["error"] <= tol, r["p"]).otherwise(F.raise_error(told).cast("double")))[0]

    etas = fan_out(spread(draws, "sim"), *factors).withColumns({
        "_inf": F.expr(design.predictor(infection_prefix)),
        **({} if coverage else {"_vacc": F.expr(design.predictor(vaccination_prefix))})})
    given = [c for c in ("resp_sn_np", "resp_sp_nn", "vacc_response") if c not in keep]
    scored = etas.select(
        *keep, *keys, *given,
        probability("_inf", sigma_infection).alias("p_infection"),
        *([] if coverage else [probability("_vacc", sigma_vaccination).alias("p_vaccination")]))
    side = within_levels(strata, factors).select(
        *keys, weight, *carry, *([F.col(coverage).alias("p_vaccination")] if coverage else []))
    joined = scored.join(broadcast_bounded(side, grid_size(*factors)), keys, "inner")
    true = true_status(F.col("p_infection"), F.col("p_vaccination") * F.col("vacc_response"),
                       F.col("resp_sn_np"), F.col("resp_sp_nn"))
    scored = joined.select(
        *keep, *keys, weight, *carry, "p_infection", "p_vaccination",
        *[c.alias(k) for k, c in true.items()], any_antibody(true).alias("p_any"))
    return watched(checks, scored, "scored measures", probability_rules(["p_infection", "p_vaccination", *true, "p_any"]))


def stack_measures(scored: DataFrame, measures: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Measures as rows ``(measure, seropos)``, so one pass serves them all."""
    return scored.select(*keys, *measures).unpivot(list(keys), list(measures), "measure", "seropos")


def convergence(draws: DataFrame, by: Sequence[str] = ("fit_id", "term")) -> DataFrame:
    """R-hat and effective draws from within- and between-chain variances, which takes two chains and sees no autocorrelation.

    ``operators.convergence`` has the measures for one chain, drifting chains and correlated draws.
    """
    chains = draws.groupBy(*by, "chain").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("value").alias("_m"), F.var_samp("value").alias("_v"))
    pooled = chains.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_chains"), F.min("_n").alias("n_per_chain"),
        F.avg("_v").alias("within"), F.var_samp("_m").alias("between"))
    total = (F.col("n_per_chain") - 1) / F.col("n_per_chain") * F.col("within") + F.col("between")
    size = F.col("n_chains") * F.col("n_per_chain")
    return pooled.withColumn("rhat", F.sqrt(ratio(total, F.col("within")))).withColumn(
        "ess", F.least(size.cast("double"), F.col("n_chains") * ratio(total, F.col("between"))))
