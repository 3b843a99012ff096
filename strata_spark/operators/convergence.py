"""Convergence of chains: rank-normalised split R-hat and effective draws from autocorrelations.

Every chain is cut into halves, so one chain is enough and a drifting chain is seen. Draws are replaced by normal scores
of their pooled ranks, which makes both measures meaningful for heavy tails; R-hat is the larger one of the scores and
of the scores of distances from the median. Effective draws come from the halves' autocovariances at all lags, summed in
pairs up to the first negative pair and kept from rising (initial monotone sequence).

A half chain is one array: its length is the number of draws that a chain declares (``max_chain``, checked), and its
autocovariances cost the square of it. Halves of unequal length are judged at the shortest. A chain with fewer than four draws, a
constant parameter, or missing values only have no measures: null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata_spark import fixed_values as fx
from strata_spark.functions.scalars import ratio

MAX_CHAIN = 20_000
FEWEST = 4


def _polynomial(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """Quantile of the standard normal for 0 < p < 1."""
    q = p - 0.5
    tail = F.sqrt(-F.ln(F.least(p, 1.0 - p)))
    (a, b), (c, d), (e, f) = fx.NORMAL_QUANTILE
    near, middle, far = 0.180625 - q * q, tail - 1.6, tail - 5.0
    outside = F.when(tail <= 5, _polynomial(c, middle) / _polynomial(d, middle)).otherwise(_polynomial(e, far) / _polynomial(f, far))
    return F.when(F.abs(q) <= 0.425, q * _polynomial(a, near) / _polynomial(b, near)).otherwise(F.signum(q) * outside)


def _bound(value: Column, function: Callable[[Column], Column]) -> Column:
    """``function`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), function)[0]


def rank_scores(df: DataFrame, by: Sequence[str], value: str) -> Column:
    """Normal score of a value's average rank in its group."""
    group = Window.partitionBy(*by)
    middle = F.rank().over(group.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2.0
    return normal_quantile((middle - 0.375) / (F.count(F.lit(1)).over(group) + 0.25))


def split_halves(draws: DataFrame, by: Sequence[str], max_chain: int = MAX_CHAIN) -> DataFrame:
    """Draws with ``pos`` in their half and ``half``; the middle draw of an odd chain is in neither."""
    chain = Window.partitionBy(*by, "chain")
    known = draws.where(F.col("value").isNotNull()).withColumns({
        "_pos": F.row_number().over(chain.orderBy("sim")), "_n": F.count(F.lit(1)).over(chain)})
    size = F.call_function("div", F.col("_n"), F.lit(2))
    checked = F.when(F.col("_n") > max_chain, F.raise_error(F.concat(
        F.lit(f"more than the {max_chain} draws a chain that were declared: "), F.col("_n").cast("string")))).otherwise(size)
    placed = known.withColumn("_size", checked).where(F.col("_n") >= FEWEST)
    late = F.col("_pos") > F.col("_n") - F.col("_size")
    return placed.where((F.col("_pos") <= F.col("_size")) | late).select(
        *by, "chain", late.cast("int").alias("half"), F.when(late, F.col("_pos") - F.col("_n") + F.col("_size")).otherwise(F.col("_pos")).alias("pos"),
        "value")


def _autocovariance(scores: Column) -> Column:
    """Autocovariance at every lag of one array, divided by its length."""
    n = F.size(scores)
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / n
    return _bound(mean, lambda m: _bound(F.transform(scores, lambda x: x - m), lambda c: F.transform(
        F.sequence(F.lit(0), n - 1), lambda t: F.aggregate(F.zip_with(
            F.slice(c, F.lit(1), n - t), F.slice(c, t + 1, n - t), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x) / n)))


def _pairs_total(rho: Column) -> Column:
    """Sum of pairs of neighbouring autocorrelations up to the first negative pair, none larger than the one before."""
    pairs = F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(rho), F.lit(2)).cast("int") - 1),
                        lambda k: F.get(rho, k * 2) + F.get(rho, k * 2 + 1))
    start = F.struct(F.lit(0.0).alias("total"), F.lit(float("inf")).alias("last"), F.lit(True).alias("open"))

    def step(a: Column, p: Column) -> Column:
        kept = a["open"] & (p >= 0)
        least = F.least(a["last"], p)
        return F.struct((a["total"] + F.when(kept, least).otherwise(0.0)).alias("total"),
                        F.when(kept, least).otherwise(a["last"]).alias("last"), kept.alias("open"))

    return F.aggregate(pairs, start, step, lambda a: a["total"])


def convergence(draws: DataFrame, by: Sequence[str] = ("fit_id", "term"), max_chain: int = MAX_CHAIN) -> DataFrame:
    """Per parameter: ``n_halves``, ``n_per_half``, ``rhat`` and ``ess`` of draws ``(*by, chain, sim, value)``."""
    by = list(by)
    halves = split_halves(draws, by, max_chain)
    # exact, over the draws of one parameter, whose chains are declared in number and length
    centre = halves.groupBy(*by).agg(F.percentile("value", 0.5).alias("_centre"))
    both = halves.join(centre, by).select(*by, "chain", "half", "pos", F.explode(F.array(
        F.struct(F.lit("bulk").alias("kind"), F.col("value").alias("x")),
        F.struct(F.lit("folded").alias("kind"), F.abs(F.col("value") - F.col("_centre")).alias("x")))).alias("_k")).select(
        *by, "chain", "half", "pos", "_k.*")
    scored = both.withColumn("z", rank_scores(both, [*by, "kind"], "x"))
    chains = scored.groupBy(*by, "kind", "chain", "half").agg(
        F.sort_array(F.collect_list(F.struct("pos", "z")))["z"].alias("_z"), F.avg("z").alias("_m"), F.var_samp("z").alias("_v"))
    bulk = F.col("kind") == "bulk"
    pooled = chains.groupBy(*by, "kind").agg(
        F.count(F.lit(1)).alias("n_halves"), F.min(F.size("_z")).cast("bigint").alias("n_per_half"), F.avg("_v").alias("within"),
        F.var_samp("_m").alias("between"), F.collect_list(F.when(bulk, _autocovariance(F.col("_z")))).alias("_acov"))
    n = F.col("n_per_half")
    total = (n - 1) / n * F.col("within") + F.col("between")
    rho = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda t: 1.0 - (F.col("within") - F.aggregate(
        F.col("_acov"), F.lit(0.0), lambda a, c: a + F.get(c, t)) / F.col("n_halves")) / F.col("_total"))
    size = (F.col("n_halves") * n).cast("double")
    measured = pooled.withColumn("_total", F.when(total > 0, total)).withColumn(
        "_rhat", F.sqrt(ratio(F.col("_total"), F.col("within"))))
    tau = F.when(bulk & F.col("_total").isNotNull(), 2.0 * _pairs_total(rho) - 1.0)
    measured = measured.withColumn("_ess", F.when(tau.isNotNull(), F.least(
        F.when(tau > 0, size / tau).otherwise(size * F.log10(size)), size * F.log10(size))))
    return measured.groupBy(*by).agg(
        F.max("n_halves").alias("n_halves"), F.max("n_per_half").alias("n_per_half"), F.max("_rhat").alias("rhat"), F.max("_ess").alias("ess"))
