"""Likelihood jobs over collapsed cells.

A participant enters a likelihood only through covariates and outcomes, so the
survey is collapsed to cells first and each draw is scored once per cell.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata_spark import fixed_values as fx
from strata_spark.functions.levels import AGE, PANEL_AGE, SEX, Levels, choose, fan_out, grid_size
from strata_spark.functions.scalars import (
    bernoulli_log_mass, log_sum_exp, logistic, misclassified, safe_ln)
from strata_spark.operators.cohort import child_flag
from strata_spark.operators.design import Design
from strata_spark.operators.draws import household_average, quadrature, spread
from strata_spark.operators.status import result_mass, true_status
from strata_spark.session import broadcast_bounded, written

UNDATED_SCENARIOS = ("inf_bef_2022", "inf_2022")
#: Compositions and draws of one tile of the household likelihood.
COMP_TILE, DRAW_TILE = 2048, 64
PANEL_CELL = ("variant", "age_cat", "sex", "inf_latest", "vacc_status_3way", "child", "y")
SERO_CELL = ("age_cat", "Sex", "vaccinated", "s_result", "n_result")


def flat_prior(age: Levels = PANEL_AGE) -> dict[str, float]:
    """The default prior: the same for every age label."""
    return dict.fromkeys(age.labels, fx.OTHER_INFECTION_PRIOR_FLAT)


def scenario_prior(age: Column, prior_before: Mapping[str, float]) -> tuple[Column, Column]:
    """Log prior of both scenarios of an undated infection, looked up by age label."""
    p = choose(age, prior_before)
    return F.ln(p), F.log1p(-p)


def accuracy(name: str, by_child: bool) -> Column:
    """Sensitivity or specificity column; children may have their own."""
    if not by_child:
        return F.col(name)
    return F.when(F.col("child"), F.col(f"{name}_child")).otherwise(F.col(name))


def positive_probability(eta: str, by_child: bool = False, sigma: str | None = None, n_nodes: int = 32) -> Column:
    """Probability of a positive assay result, given the column of the linear predictor.

    ``sigma`` names the scale of an observation-level effect (overdispersion).
    The result is linear in the probability, so averaging the probability over
    that effect gives the exact marginal.
    """
    p = logistic(F.col(eta)) if sigma is None else household_average(eta, sigma, n_nodes)
    return misclassified(p, accuracy("sens", by_child), accuracy("spec", by_child))


def with_log_mass(rows: DataFrame, design: Design, prior_before: Mapping[str, float], prefix: str = "",
                  by_child: bool = False, sigma: str | None = None, n_nodes: int = 32) -> DataFrame:
    """Add ``log_lik``, the log mass of outcome ``y`` on each draw and cell row.

    A dated row is a Bernoulli. A row with no infection date is a mixture of
    both scenarios, weighted by the prior of its age label. A dated row has
    the same predictor in both scenarios, so two predictors serve every row;
    they are columns of their own so that generated code stays small.
    """
    inf = F.col("inf_latest")
    rows = rows.withColumns({
        f"_eta{i}": F.expr(design.predictor(prefix, {"inf_latest": f"coalesce(inf_latest, '{x}')"}))
        for i, x in enumerate(UNDATED_SCENARIOS)})
    rows = rows.withColumns({f"_q{i}": positive_probability(f"_eta{i}", by_child, sigma, n_nodes) for i in (0, 1)})
    rows = rows.withColumns({f"_m{i}": bernoulli_log_mass(F.col("y"), F.col(f"_q{i}")) for i in (0, 1)})
    before, late = scenario_prior(F.col("age_cat"), prior_before)
    rows = rows.withColumns({
        "_m0": F.when(inf.isNull(), before + F.col("_m0")).otherwise(F.col("_m0")),
        "_m1": F.when(inf.isNull(), late + F.col("_m1"))})
    ll = F.when(inf.isNull(), log_sum_exp(F.col("_m0"), F.col("_m1"))).otherwise(F.col("_m0"))
    return rows.withColumn("log_lik", ll).drop(*[f"_{x}{i}" for x in ("eta", "q", "m") for i in (0, 1)])


def panel_cells(panel: DataFrame) -> DataFrame:
    """Cells of a prepared panel, with outcome ``y`` and child flag."""
    return (
        panel.select("variant", "age_cat", "sex", "inf_latest", "vacc_status_3way",
                     child_flag(F.col("age")).alias("child"), F.col("ec50_thresh").cast("int").alias("y"))
        .groupBy(*PANEL_CELL).agg(F.count(F.lit(1)).alias("n")))


def pointwise_loglik(draws: DataFrame, cells: DataFrame, design: Design, prior_before: Mapping[str, float],
                     prefix: str = "", keep: Sequence[str] = ("fit_id", "sim"), n_fits: int | None = None,
                     **model) -> DataFrame:
    """Log-likelihood of one observation of every cell under every draw of its fit.

    A fit has at most one cell per level combination, so with a declared number
    of fits the cells have a bound and are broadcast; without it the join is
    planned from runtime sizes. ``model`` options: ``by_child`` for separate
    child accuracy, ``sigma`` for overdispersion.
    """
    if n_fits is not None:
        cells = broadcast_bounded(cells, grid_size(*design.factors, extra=1) * 4 * n_fits)
    joined = spread(draws, "sim").join(cells, "fit_id", "inner")
    cell_columns = [c for c in cells.columns if c not in keep]
    return with_log_mass(joined, design, prior_before, prefix, **model).select(*keep, *cell_columns, "log_lik")


@dataclass(frozen=True)
class Model:
    """A threshold model: design, prefix of its coefficients in a draws row, scale of its observation effect, child accuracy."""

    design: Design
    prefix: str = ""
    sigma: str | None = None
    by_child: bool = False


def models_loglik(draws: DataFrame, cells: DataFrame, models: Mapping[str, Model], prior_before: Mapping[str, float],
                  keep: Sequence[str] = ("fit_id", "sim"), n_nodes: int = 32, n_fits: int | None = None) -> DataFrame:
    """Log-likelihood of one observation of every cell under every draw and model: rows ``(model_id, ..., log_lik)``.

    Draws and cells meet once for all models. A linear predictor is summed once for all models with the same design and
    coefficients; an observation effect or another accuracy is applied to it.
    """
    if n_fits is not None:
        factors = next(iter(models.values())).design.factors
        cells = broadcast_bounded(cells, grid_size(*factors, extra=1) * 4 * n_fits)
    joined = spread(draws, "sim").join(cells, "fit_id", "inner")
    ids = list(models)

    def predictors(m: Model) -> tuple[str, ...]:
        return tuple(m.design.predictor(m.prefix, {"inf_latest": f"coalesce(inf_latest, '{x}')"}) for x in UNDATED_SCENARIOS)

    number = {p: k for k, p in enumerate(dict.fromkeys(predictors(m) for m in models.values()))}
    eta = [f"_eta{number[predictors(models[i])]}" for i in ids]
    rows = joined.withColumns({f"_eta{k}_{s}": F.expr(x) for pair, k in number.items() for s, x in enumerate(pair)})
    rows = rows.withColumns({
        f"_q{j}_{s}": positive_probability(f"{eta[j]}_{s}", models[i].by_child, models[i].sigma, n_nodes)
        for j, i in enumerate(ids) for s in (0, 1)})
    rows = rows.withColumns({f"_m{j}_{s}": bernoulli_log_mass(F.col("y"), F.col(f"_q{j}_{s}")) for j in range(len(ids)) for s in (0, 1)})
    before, late = scenario_prior(F.col("age_cat"), prior_before)
    undated = F.col("inf_latest").isNull()

    def log_lik(j: int) -> Column:
        mixed = log_sum_exp(before + F.col(f"_m{j}_0"), late + F.col(f"_m{j}_1"))
        return F.when(undated, mixed).otherwise(F.col(f"_m{j}_0"))

    accuracies = F.array(*[F.struct(F.lit(i).alias("model_id"), log_lik(j).alias("log_lik")) for j, i in enumerate(ids)])
    cell_columns = [c for c in cells.columns if c not in keep]
    return rows.select(*keep, *cell_columns, F.explode(accuracies).alias("_a")).select("_a.model_id", *keep, *cell_columns, "_a.log_lik")


def loglik_by_draw(pointwise: DataFrame, by: Sequence[str] = ("fit_id", "sim")) -> DataFrame:
    """Total log-likelihood of each draw."""
    return pointwise.groupBy(*by).agg(F.sum(F.col("n") * F.col("log_lik")).alias("log_lik"))


def _sero_grid(draws: DataFrame, age: Levels, sex: Levels) -> DataFrame:
    """Draws at every cell of the serology model: age, sex, vaccinated and both results."""
    grid = fan_out(spread(draws, "sim"), age, sex)
    for name in ("vaccinated", "s_result", "n_result"):
        grid = grid.withColumn(name, F.expr("explode(array(0, 1))"))
    return grid


def _result_log_mass(p: Column) -> Column:
    true = true_status(p, F.col("vaccinated") * F.col("vacc_response"), F.col("resp_sn_np"), F.col("resp_sp_nn"))
    return safe_ln(result_mass(true, *[F.col(c) for c in ("s_result", "n_result", "sens_s", "spec_s", "sens_n", "spec_n")]))


def joint_loglik(draws: DataFrame, cells: DataFrame, design: Design, age: Levels = AGE, sex: Levels = SEX,
                 infection_prefix: str = "inf:", vaccination_prefix: str = "vacc:") -> DataFrame:
    """Log-likelihood of joint results and of vaccination per draw, no household effect."""
    p = logistic(F.expr(design.predictor(infection_prefix)))
    q = logistic(F.expr(design.predictor(vaccination_prefix)))
    masses = _sero_grid(draws, age, sex).withColumns({"_p": p, "_q": q}).select(
        "sim", age.name, sex.name, "vaccinated", "s_result", "n_result",
        bernoulli_log_mass(F.col("vaccinated"), F.col("_q")).alias("ll_vacc"),
        _result_log_mass(F.col("_p")).alias("ll_status"))
    joined = masses.join(broadcast_bounded(cells, grid_size(age, sex, extra=1) * 27), list(SERO_CELL), "inner")
    return joined.groupBy("sim").agg(
        *[F.sum(F.col("n") * F.col(c)).alias(c) for c in ("ll_status", "ll_vacc")])


def cell_number(age: Levels, sex: Levels) -> Column:
    """Position of a serology cell in the grid of declared levels; null outside it."""
    place = age.ordinal(F.col(age.name)) * len(sex.labels) + sex.ordinal(F.col(sex.name))
    return ((place * 2 + F.col("vaccinated")) * 2 + F.col("s_result")) * 2 + F.col("n_result")


def household_compositions(cohort: DataFrame, age: Levels = AGE, sex: Levels = SEX) -> DataFrame:
    """Distinct household make-ups ``comp`` and the number ``n_hh`` of households sharing each.

    Members with a missing covariate or result are left out. Two households
    with the same members by cell have the same marginal likelihood. Members
    are summed per household and cell first, so a
    household lists each cell once however many members it has.
    """
    known = cohort.dropna(subset=list(SERO_CELL))
    members = known.groupBy("hh_id", cell_number(age, sex).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    listed = members.groupBy("hh_id").agg(F.sort_array(F.collect_list(F.struct("cell", "n"))).alias("comp"))
    return listed.groupBy("comp").agg(F.count(F.lit(1)).alias("n_hh"))


def _tile_marginals(n_cells: int, log_weights: Sequence[Sequence[float]]):
    """Sums of log marginals of one tile: a block of compositions by a block of draws, for each rule of ``log_weights``."""
    def run(comps: pd.DataFrame, theta: pd.DataFrame) -> pd.DataFrame:
        if not len(theta):  # no draw has this block
            return pd.DataFrame({"sim": [], **{f"ll{k}": [] for k in range(len(log_weights))}})
        lengths = comps["cells"].str.len().to_numpy()
        counts = np.zeros((len(comps), n_cells))
        if len(comps):
            counts[np.repeat(np.arange(len(comps)), lengths), np.concatenate(comps["cells"].to_list())] = np.concatenate(comps["counts"].to_list())
        weight, out = comps["n_hh"].to_numpy(float), {"sim": theta["sim"]}
        for k, rule in enumerate(log_weights):
            # cells x (node, draw)
            t = np.stack([np.asarray(x) for x in theta[f"m{k}"]]).reshape(len(theta), n_cells, len(rule))
            t = t.transpose(1, 2, 0).reshape(n_cells, -1)
            total = np.zeros(len(theta))
            for start in range(0, len(comps), 512):
                ll = (counts[start:start + 512] @ t).reshape(-1, len(rule), len(theta)) + np.asarray(rule)[None, :, None]
                top = ll.max(axis=1)
                total += weight[start:start + 512] @ (top + np.log(np.exp(ll - top[:, None, :]).sum(axis=1)))
            out[f"ll{k}"] = total
        return pd.DataFrame(out)

    return run


def household_loglik(draws: DataFrame, cohort: DataFrame, design: Design, sigma: str, n_nodes: int = 5,
                     age: Levels = AGE, sex: Levels = SEX, infection_prefix: str = "inf:",
                     sigma_vaccination: str | None = None, vaccination_prefix: str = "vacc:", check: bool = False,
                     comp_tile: int = COMP_TILE, draw_tile: int = DRAW_TILE) -> DataFrame:
    """Log marginal likelihood of a cohort per draw, household effects integrated out: ``ll_household``.

    With ``sigma_vaccination`` households have a second effect, on vaccination, and ``ll_vaccination`` is added. Test
    results depend on the vaccination that was seen and not on its probability, and the two effects are independent, so
    the double integral is the product of two. With ``check`` every rule is also taken with twice the nodes, whose
    results are returned, and ``error_*`` is what the doubling changed.

    A draw is one row with the log mass of every cell at every node. Compositions and draws are cut into blocks, and
    a tile, one block of each, is a matrix product in its task: compositions are copied once for each block of draws
    and draws once for each block of compositions, so what a task holds depends on neither number. Neither a large
    household nor a frequent composition makes a block large.
    """
    rules = [quadrature(n) for n in ((n_nodes, 2 * n_nodes) if check else (n_nodes,))]
    n_cells = grid_size(age, sex) * 8
    grid = _sero_grid(draws, age, sex).withColumn("_eta", F.expr(design.predictor(infection_prefix)))
    if sigma_vaccination:
        grid = grid.withColumn("_eta_vacc", F.expr(design.predictor(vaccination_prefix)))

    def at_nodes(eta: str, scale: str, rule, mass) -> Column:
        nodes = F.array(*[F.lit(z) for z, _ in rule])
        return F.transform(F.transform(nodes, lambda z: logistic(F.col(eta) + F.col(scale) * z)), mass)

    def vaccination_mass(q: Column) -> Column:
        return bernoulli_log_mass(F.col("vaccinated"), q)

    effects = [("household", "_eta", sigma, _result_log_mass)]
    if sigma_vaccination:
        effects.append(("vaccination", "_eta_vacc", sigma_vaccination, vaccination_mass))
    kinds = [(name, rule, at_nodes(eta, scale, rule, mass)) for name, eta, scale, mass in effects for rule in rules]
    theta = grid.select("sim", F.struct(cell_number(age, sex).alias("cell"), *[c.alias(f"m{k}") for k, (*_, c) in enumerate(kinds)]).alias("at"))
    theta = theta.groupBy("sim").agg(F.sort_array(F.collect_list("at")).alias("at")).select(
        "sim", *[F.flatten(F.col("at")[f"m{k}"]).alias(f"m{k}") for k in range(len(kinds))])
    # counted once and read again as blocks
    comps = written(household_compositions(cohort, age, sex), "compositions")
    comp_blocks, draw_blocks = max(1, -(-comps.count() // comp_tile)), max(1, -(-draws.count() // draw_tile))

    def blocks(key: str, n: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    theta = theta.select(blocks("sim", draw_blocks).alias("draws"), every(comp_blocks).alias("comps"), *theta.columns)
    comps = comps.select(blocks("comp", comp_blocks).alias("comps"), every(draw_blocks).alias("draws"),
                         F.col("comp.cell").alias("cells"), F.col("comp.n").alias("counts"), "n_hh")
    tile = ["comps", "draws"]
    partial = comps.groupBy(*tile).cogroup(theta.groupBy(*tile)).applyInPandas(
        _tile_marginals(n_cells, [[math.log(w) for _, w in rule] for _, rule, _ in kinds]),
        "sim bigint, " + ", ".join(f"ll{k} double" for k in range(len(kinds))))
    # a draw that meets no composition of a block adds nothing for it
    total = partial.groupBy("sim").agg(*[F.sum(f"ll{k}").alias(f"ll{k}") for k in range(len(kinds))])
    per = len(rules)
    best = [F.col(f"ll{per * i + per - 1}").alias(f"ll_{name}") for i, (name, *_) in enumerate(effects)]
    errors = [F.abs(F.col(f"ll{per * i + 1}") - F.col(f"ll{per * i}")).alias(f"error_{name}") for i, (name, *_) in enumerate(effects)] if check else []
    return total.select("sim", *best, *errors)
