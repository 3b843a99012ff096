"""Pointwise predictive accuracy and model choice.

Observations of one cell share their log-likelihood, so accuracy is computed
per cell and weighted by the cell count ``n``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata_spark import fixed_values as fx
from strata_spark.functions.levels import choose

PAIR_TOLERANCE = 2.0 - 0.1


#: Width of the ranges of log-likelihood inside which sums of exponentials neither under- nor overflow.
RANGE = 512.0
#: Shares and counts of the smoothed tail: least(share * s, factor * sqrt(s)) draws, and the fewest that are smoothed.
TAIL_SHARE, TAIL_FACTOR, TAIL_FEWEST = 0.2, 3.0, 5
#: Profile grid of the tail's shape: its least size, its spread, and the weight of the prior shape one half.
GRID_LEAST, GRID_SPREAD, PRIOR_WEIGHT = 30, 3.0, 10.0


def _total(values: Column, term: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + term(x))


def _bound(value: Column, function: Callable[[Column], Column]) -> Column:
    """``function`` of ``value``, which is evaluated once a row however often, and however deep, the function names it."""
    return F.transform(F.array(value), function)[0]


def _range_sums(loglik: DataFrame, obs: Sequence[str]) -> DataFrame:
    """Per cell: ``n``, number and mean of draws, their squared deviations, and shifted sums by range of ``log_lik``.

    Sums of one range of a cell are made on the map side; a cell has a handful of ranges.
    """
    # missing values are left out after the first sums: a filter before them would repeat the likelihood's whole expression
    within = loglik.withColumn("_k", F.floor(F.col("log_lik") / RANGE)).groupBy(*obs, "_k").agg(
        F.first("n").alias("n"), F.count("log_lik").alias("_c"), F.avg("log_lik").alias("_m"),
        (F.var_pop("log_lik") * F.count("log_lik")).alias("_d"),
        F.sum(F.exp(F.col("log_lik") - F.col("_k") * RANGE)).alias("_up"),
        F.sum(F.exp(F.col("_k") * RANGE - F.col("log_lik"))).alias("_down"))
    mean = F.sum(F.col("_c") * F.col("_m")) / F.sum("_c")
    return within.where("_c > 0").groupBy(*obs).agg(
        F.first("n").alias("n"), F.sum("_c").alias("_draws"),
        F.greatest(F.sum("_d") + F.sum(F.col("_c") * F.col("_m") * F.col("_m")) - F.sum("_c") * mean * mean, F.lit(0.0)).alias("_dev"),
        F.collect_list(F.struct("_k", "_up", "_down")).alias("_parts"))


def _log_mean_exp(sign: int) -> Column:
    """Log of the mean of ``exp(sign * log_lik)``, shifted by the largest range."""
    parts, name = F.col("_parts"), "_up" if sign > 0 else "_down"
    top = F.array_max(F.transform(parts, lambda p: p["_k"] * float(sign)))
    return top * RANGE + F.ln(_total(parts, lambda p: p[name] * F.exp((p["_k"] * float(sign) - top) * RANGE)) / F.col("_draws"))


def waic_pointwise(loglik: DataFrame, obs: Sequence[str]) -> DataFrame:
    """Per observation cell: log predictive density, effective parameters, elpd."""
    variance = F.when(F.col("_draws") > 1, F.col("_dev") / (F.col("_draws") - 1))
    return _range_sums(loglik, obs).select(*obs, "n", _log_mean_exp(1).alias("lppd"), variance.alias("p_eff")).withColumn(
        "elpd", F.col("lppd") - F.col("p_eff"))


def is_loo_pointwise(loglik: DataFrame, obs: Sequence[str]) -> DataFrame:
    """Importance-sampling leave-one-out density per observation cell."""
    return _range_sums(loglik, obs).select(
        *obs, "n", _log_mean_exp(1).alias("lppd"), (-_log_mean_exp(-1)).alias("elpd")).withColumn(
        "p_eff", F.col("lppd") - F.col("elpd"))


def _pareto_tail(excess: Column, m: Column) -> Column:
    """``shape`` and ``scale`` of a generalised Pareto tail of ``m`` ascending excesses, by a profile over a grid."""
    size = F.lit(GRID_LEAST) + F.floor(F.sqrt(m.cast("double"))).cast("int")
    ends = F.struct(F.element_at(excess, -1).alias("top"), F.get(excess, F.floor(m / 4 + 0.5).cast("int") - 1).alias("quarter"), size.alias("size"))

    def mean_log(b: Column) -> Column:
        return _total(excess, lambda e: F.log1p(-b * e)) / m

    def grid(x: Column) -> Column:
        points = F.transform(F.sequence(F.lit(1), x["size"]), lambda j: 1.0 / x["top"] + (
            1.0 - F.sqrt(x["size"] / (j - 0.5))) / (GRID_SPREAD * x["quarter"]))
        return F.transform(points, lambda b: F.struct(b.alias("b"), _bound(
            mean_log(b), lambda k: m * (F.ln(-b / k) - k - 1.0)).alias("fit")))

    def weighted(profile: Column) -> Column:
        return _bound(F.array_max(F.transform(profile, lambda g: g["fit"])), lambda top: _total(
            profile, lambda g: g["b"] * F.exp(g["fit"] - top)) / _total(profile, lambda g: F.exp(g["fit"] - top)))

    def fitted(b: Column) -> Column:
        return _bound(mean_log(b), lambda raw: F.struct(
            ((m * raw + PRIOR_WEIGHT / 2) / (m + PRIOR_WEIGHT)).alias("shape"), (-raw / b).alias("scale")))

    return _bound(ends, lambda x: _bound(grid(x), lambda profile: _bound(weighted(profile), fitted)))


def _smoothed(tail: Column, m: Column, lo: Column, cut: Column, draws: Column, every: Column) -> Column:
    """``elpd`` and ``shape`` with the weights of ``tail`` (descending log-likelihoods) replaced by Pareto quantiles."""
    def density(excess: Column, fit: Column) -> Column:
        def weight(i: Column) -> Column:
            upper = F.log1p(-(i - 0.5) / m)
            body = F.when(F.abs(fit["shape"]) > 1e-12, F.expm1(-fit["shape"] * upper) / fit["shape"]).otherwise(-upper)
            return F.least(F.ln(cut + fit["scale"] * body), F.lit(0.0))

        weights = F.transform(tail, lambda x, i: F.struct(x.alias("x"), weight(i + 1).alias("w")))
        rest = every - _total(tail, lambda x: F.exp(lo - x))
        return _bound(weights, lambda ws: F.struct(
            (lo + F.ln(draws - m + _total(ws, lambda t: F.exp(t["w"] + t["x"] - lo)))
             - F.ln(rest + _total(ws, lambda t: F.exp(t["w"])))).alias("elpd"), fit["shape"].alias("shape")))

    return _bound(F.transform(tail, lambda x: F.exp(lo - x) - cut), lambda excess: F.when(
        excess[0] > 0, _bound(_pareto_tail(excess, m), lambda fit: density(excess, fit))))


def psis_loo_pointwise(loglik: DataFrame, obs: Sequence[str]) -> DataFrame:
    """Pareto-smoothed leave-one-out density per observation cell, and the tail shape ``pareto_k``.

    Draws of a cell meet once, sorted by log-likelihood. All of them enter as shifted sums; only the tail, at most
    ``3 * sqrt(draws) + 1`` values, is kept as an array, and the rest is arithmetic on it. A cell with a tail of fewer
    than five draws is not smoothed (shape infinity), nor is one whose tail does not rise above its cutoff (minus infinity).
    """
    cell = Window.partitionBy(*obs)
    rows = loglik.select(
        *obs, "n", "log_lik", F.row_number().over(cell.orderBy(F.col("log_lik").asc_nulls_last())).alias("_rank"),
        F.count("log_lik").over(cell).alias("_draws"),
        F.min("log_lik").over(cell).alias("_lo"), F.max("log_lik").over(cell).alias("_hi"))
    tail = F.floor(F.least(F.col("_draws") * F.lit(TAIL_SHARE), F.sqrt(F.col("_draws").cast("double")) * F.lit(TAIL_FACTOR))).cast("int")
    ll, lo, hi = F.col("log_lik"), F.col("_lo"), F.col("_hi")
    cells = rows.groupBy(*obs).agg(
        F.first("n").alias("n"), F.first("_draws").alias("_draws"), F.first("_lo").alias("_lo"),
        (F.first("_hi") + F.ln(F.avg(F.exp(ll - hi)))).alias("lppd"), F.sum(F.exp(lo - ll)).alias("_all"),
        F.sort_array(F.collect_list(F.when(F.col("_rank") <= tail + 1, ll))).alias("_low")).where("_draws > 0")
    # the smallest log-likelihoods have the largest weights; the last of the list is the cutoff
    m, enough = F.size("_low") - 1, F.size("_low") > TAIL_FEWEST
    smooth = _bound(F.struct(F.reverse(F.slice("_low", F.lit(1), m)).alias("tail"), F.exp(lo - F.element_at("_low", -1)).alias("cut"),
                             m.alias("m")), lambda t: _smoothed(t["tail"], t["m"], lo, t["cut"], F.col("_draws"), F.col("_all")))
    plain = lo + F.ln(F.col("_draws").cast("double")) - F.ln("_all")
    shapeless = F.when(enough, F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return cells.withColumn("_fit", F.when(enough, smooth)).select(
        *obs, "n", "lppd", F.coalesce("_fit.elpd", plain).alias("elpd"), F.coalesce("_fit.shape", shapeless).alias("pareto_k")).withColumn(
        "p_eff", F.col("lppd") - F.col("elpd"))


def compare_models(pointwise: DataFrame, obs: Sequence[str], by: Sequence[str] = ("variant",),
                   model: str = "model_id") -> DataFrame:
    """Total accuracy per model, difference to the best model of its group, and rank.

    ``pointwise`` has ``by``, ``model``, the ``obs`` columns, ``n``, ``elpd``
    and ``p_eff``. The standard error of a difference comes from pointwise
    differences over all observations. Windows run over cells, of which a
    group has at most levels x models, and the costly pointwise table is read
    once.
    """
    by, obs = list(by), list(obs)
    n, e, p, d = F.col("n"), F.col("elpd"), F.col("p_eff"), F.col("_d")

    def spread(x, count):
        return F.sqrt(F.greatest(count * (F.sum(n * x * x) - F.sum(n * x) * F.sum(n * x) / count) / (count - 1), F.lit(0.0)))

    ranked = Window.partitionBy(*by).orderBy(F.desc("_total"), model)
    same = Window.partitionBy(*by, *obs)
    gaps = (
        pointwise.withColumn("_total", F.sum(n * e).over(Window.partitionBy(*by, model)))
        .withColumn("_best", F.first(model).over(ranked))
        .withColumn("_d", e - F.max(F.when(F.col(model) == F.col("_best"), e)).over(same)))
    count = F.sum("n")
    totals = gaps.groupBy(*by, model).agg(
        count.alias("n_obs"), F.sum(n * e).alias("elpd"), spread(e, count).alias("se_elpd"),
        F.sum(n * p).alias("p_eff"), spread(p, count).alias("se_p_eff"),
        F.sum(n * d).alias("elpd_diff"), spread(d, count).alias("se_diff"))
    return totals.withColumn("ic", -2.0 * F.col("elpd")).withColumn("se_ic", 2.0 * F.col("se_elpd")).withColumn(
        "rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("elpd_diff"), model)))


def select_best_model(compared: DataFrame, by: Sequence[str] = ("variant",), model: str = "model_id",
                      complexity: Sequence[str] = fx.MODEL_COMPLEXITY, tolerance: float = PAIR_TOLERANCE) -> DataFrame:
    """Flag the simplest model that is not clearly worse than the best one."""
    close = (F.col("elpd_diff") == 0) | (F.abs("elpd_diff") < F.col("se_diff") * tolerance)
    order = choose(F.col(model), {m: i for i, m in enumerate(complexity)})
    pick = Window.partitionBy(*by).orderBy(F.desc("_close"), F.asc_nulls_last("_order"), "rank")
    return compared.withColumn("_close", close.cast("int")).withColumn("_order", order).withColumn(
        "best", F.row_number().over(pick) == 1).drop("_close", "_order")
