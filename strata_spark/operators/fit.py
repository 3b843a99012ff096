"""Posterior mode and normal approximation of the threshold model, many fits at once.

The survey is collapsed to cells by Spark; each fit then has at most one row
per level combination, and fits are spread over tasks by ``fit_id``.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata_spark import fixed_values as fx
from strata_spark.operators.design import Design
from strata_spark.operators.likelihood import UNDATED_SCENARIOS, scenario_prior

CONTROLS = next(r[2:] for r in fx.ASSAY_CONTROLS if r[0] == "neutralization")


def fit_rows(cells: DataFrame, design: Design, prior_before: Mapping[str, float]) -> DataFrame:
    """Design rows per cell; an undated cell gives one row per scenario with its log prior."""
    before, late = scenario_prior(F.col("age_cat"), prior_before)
    scenarios = F.array(*[
        F.struct(F.lit(s).alias("inf"), lp.alias("log_prior")) for s, lp in zip(UNDATED_SCENARIOS, (before, late))])
    dated = F.array(F.struct(F.col("inf_latest").alias("inf"), F.lit(0.0).alias("log_prior")))
    cell = F.xxhash64("age_cat", "sex", "inf_latest", "vacc_status_3way", "child", "y")
    spread = cells.withColumn("cell", cell).withColumn(
        "_s", F.explode(F.when(F.col("inf_latest").isNull(), scenarios).otherwise(dated)))
    named = spread.withColumn("inf_latest", F.col("_s.inf")).withColumn("log_prior", F.col("_s.log_prior"))
    x = F.array(*[design.indicator(t).cast("double") for t in design.terms])
    return named.select("fit_id", "cell", "y", "n", "log_prior", x.alias("x"))


class _Posterior:
    """Log posterior of one fit on the unconstrained scale (coefficients, sens, spec)."""

    def __init__(self, pdf: pd.DataFrame):
        self.x = np.stack(pdf["x"].to_numpy())
        self.y = pdf["y"].to_numpy(float)
        self.n = pdf["n"].to_numpy(float)
        self.log_prior = pdf["log_prior"].to_numpy()
        self.cell = pd.factorize(pdf["cell"])[0]
        self.size = self.x.shape[1] + 2

    def evaluate(self, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Value, gradient and expected curvature."""
        low = fx.ACCURACY_LOWER
        s = 1.0 / (1.0 + np.exp(-theta[-2:]))
        sens, spec = low + (1.0 - low) * s
        d_acc = (1.0 - low) * s * (1.0 - s)
        p = 1.0 / (1.0 + np.exp(-self.x @ theta[:-2]))
        q = np.clip(sens * p + (1.0 - spec) * (1.0 - p), 1e-12, 1.0 - 1e-12)
        mass = self.log_prior + np.where(self.y == 1, np.log(q), np.log1p(-q))
        top = np.full(self.cell.max() + 1, -np.inf)
        np.maximum.at(top, self.cell, mass)
        share = np.exp(mass - top[self.cell])
        total = np.bincount(self.cell, share)
        share = share / total[self.cell]
        n_cell = np.bincount(self.cell, self.n * share)
        jac = np.column_stack([
            ((sens + spec - 1.0) * p * (1.0 - p))[:, None] * self.x, p * d_acc[0], -(1.0 - p) * d_acc[1]])
        w = self.n * share
        grad = jac.T @ (w * (self.y / q - (1.0 - self.y) / (1.0 - q)))
        info = (jac * (w / (q * (1.0 - q)))[:, None]).T @ jac
        value = float(n_cell @ (top + np.log(total)))
        value -= 0.5 * float(theta[:-2] @ theta[:-2]) / fx.PRIOR_SD**2
        grad[:-2] -= theta[:-2] / fx.PRIOR_SD**2
        info[np.arange(self.size - 2), np.arange(self.size - 2)] += 1.0 / fx.PRIOR_SD**2
        n_pos, tp, n_neg, fp = CONTROLS
        for j, (acc, hits, trials) in enumerate(((sens, tp, n_pos), (spec, n_neg - fp, n_neg))):
            i = self.size - 2 + j
            miss = trials - hits
            value += hits * np.log(acc) + (miss * np.log1p(-acc) if miss else 0.0) + np.log(s[j] * (1.0 - s[j]))
            grad[i] += d_acc[j] * (hits / acc - miss / (1.0 - acc)) + 1.0 - 2.0 * s[j]
            info[i, i] += d_acc[j] ** 2 * trials / (acc * (1.0 - acc)) + 2.0 * s[j] * (1.0 - s[j])
        return value, grad, info

    def mode(self, max_steps: int = 200, tol: float = 1e-9) -> tuple[np.ndarray, int]:
        """Scoring steps, halved until the value does not drop."""
        theta = np.zeros(self.size)
        theta[-2:] = 2.0
        value, grad, info = self.evaluate(theta)
        for step in range(1, max_steps + 1):
            move = np.linalg.solve(info, grad)
            scale = 1.0
            while True:
                new = theta + scale * move
                new_value, new_grad, new_info = self.evaluate(new)
                if new_value >= value or scale < 1e-10:
                    break
                scale /= 2.0
            theta, value, grad, info = new, new_value, new_grad, new_info
            if np.abs(scale * move).max() < tol:
                return theta, step
        return theta, -1

    def covariance(self, theta: np.ndarray) -> np.ndarray:
        """Inverse curvature at the mode: observed where positive definite, else expected."""
        h = 1e-5
        columns = [
            (self.evaluate(theta - h * e)[1] - self.evaluate(theta + h * e)[1]) / (2.0 * h) for e in np.eye(self.size)]
        observed = np.column_stack(columns)
        observed = (observed + observed.T) / 2.0
        if np.linalg.eigvalsh(observed)[0] <= 0:
            observed = self.evaluate(theta)[2]
        return np.linalg.inv(observed)


def _natural(theta: np.ndarray) -> np.ndarray:
    """Coefficients as they are, accuracies back on the probability scale."""
    out = theta.copy()
    low = fx.ACCURACY_LOWER
    out[..., -2:] = low + (1.0 - low) / (1.0 + np.exp(-theta[..., -2:]))
    return out


def fit_mode(cells: DataFrame, design: Design, prior_before: Mapping[str, float]) -> DataFrame:
    """``(fit_id, term, estimate, se, steps)``; ``se`` of accuracies is on the logit scale."""
    terms = [*design.terms, "sens", "spec"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        post = _Posterior(pdf.sort_values(["cell", "log_prior"]))
        theta, steps = post.mode()
        se = np.sqrt(np.diag(post.covariance(theta)))
        return pd.DataFrame({
            "fit_id": pdf["fit_id"].iloc[0], "term": terms, "estimate": _natural(theta), "se": se, "steps": steps})

    return fit_rows(cells, design, prior_before).groupBy("fit_id").applyInPandas(
        one, "fit_id string, term string, estimate double, se double, steps int")


def fit_draws(cells: DataFrame, design: Design, prior_before: Mapping[str, float], n_draws: int = 1000,
              seed: int = 1) -> DataFrame:
    """Long draws from the normal approximation; the seed is fixed per fit."""
    terms = [*design.terms, "sens", "spec"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        fit_id = pdf["fit_id"].iloc[0]
        post = _Posterior(pdf.sort_values(["cell", "log_prior"]))
        theta, _ = post.mode()
        rng = np.random.default_rng([seed, zlib.crc32(str(fit_id).encode())])
        z = rng.standard_normal((n_draws, post.size))
        draws = _natural(theta + z @ np.linalg.cholesky(post.covariance(theta)).T)
        return pd.DataFrame({
            "fit_id": fit_id, "chain": 0, "sim": np.repeat(np.arange(n_draws), len(terms)),
            "term": np.tile(terms, n_draws), "value": draws.ravel()})

    return fit_rows(cells, design, prior_before).groupBy("fit_id").applyInPandas(
        one, "fit_id string, chain int, sim int, term string, value double")
