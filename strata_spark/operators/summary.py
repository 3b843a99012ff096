"""Summaries over draws: mean, quantiles, highest-density interval, tail probability."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata_spark.operators.numbering import value_bucket
from strata_spark.operators.order_stats import array_summary, moments, narrowest, rank_quantile, ranked_values, same_keys
from strata_spark.session import broadcast_bounded

LOWER, UPPER = 0.025, 0.975
QUANTILES = {"median": 0.5, "q025": LOWER, "q975": UPPER}
#: Values of a group that one aggregation buffer may hold; more of them are an error that names the way for them.
MAX_DRAWS = 1_000_000


def _within(draws: int, column: Column, value: str) -> Column:
    """``column``, or an error where a group has more values than ``draws``."""
    told = F.concat(F.lit(f"more than the {draws} draws a group that were declared: "), F.count(value).cast("string"),
                    F.lit("; ranked_summary and ranked_quantiles take groups of any size"))
    return F.when(F.count(value) > draws, F.raise_error(told)).otherwise(column)


def posterior_summary(df: DataFrame, by: Sequence[str], value: str = "p",
                      extra: Mapping[str, Column] | None = None, draws: int = MAX_DRAWS) -> DataFrame:
    """Mean, 2.5% and 97.5% quantile in one aggregate, with ``extra`` aggregates beside them.

    A group holds one value per draw, at most ``draws`` of them, which is checked. For groups of unknown size use
    ``ranked_quantiles``.
    """
    q = F.percentile(value, F.array(F.lit(LOWER), F.lit(UPPER)))
    extra = extra or {}
    return df.groupBy(*by).agg(
        _within(draws, F.avg(value), value).alias("mean"), q.alias("_q"), *[c.alias(k) for k, c in extra.items()]
    ).select(*by, "mean", F.col("_q")[0].alias("q025"), F.col("_q")[1].alias("q975"), *extra)


def full_summary(df: DataFrame, by: Sequence[str], value: str = "p", *, prob: float = 0.95,
                 extra: Mapping[str, Column] | None = None, draws: int | None = None) -> DataFrame:
    """Mean, median, quantiles and highest-density interval over draws, and ``extra`` aggregates of the group.

    With a declared number of ``draws`` a group is one sorted array, and a larger group is an error. Without it groups
    of any size are ranked over many tasks.
    """
    extra = extra or {}
    if draws is not None:
        kept = F.sort_array(F.collect_list(value))
        grouped = df.groupBy(*by).agg(F.avg(value).alias("mean"), _within(draws, kept, value).alias("_x"),
                                      *[c.alias(k) for k, c in extra.items()]).where(F.size("_x") > 0)
        stats = array_summary(F.col("_x"), QUANTILES, prob)
        return grouped.select(*by, "mean", *[c.alias(k) for k, c in stats.items()], *extra)
    ranked = ranked_summary(df, by, value, prob)
    if not extra:
        return ranked
    more = df.groupBy(*by).agg(*[c.alias(k) for k, c in extra.items()])
    return ranked.alias("s").join(more.alias("e"), same_keys("s", "e", by)).select("s.*", *[f"e.{k}" for k in extra])


def ranked_quantiles(df: DataFrame, by: Sequence[str], value: str, n_groups: int | None = None,
                     per_octave: int = 256) -> DataFrame:
    """Mean, median and interval quantiles, exact, of groups of any size.

    A histogram over value buckets tells which few buckets hold the wanted
    ranks; only their rows move, and equal values among them are collapsed
    before they do. With a declared number of groups the wanted buckets are
    broadcast.
    """
    tagged = df.select(*by, value, value_bucket(F.col(value), per_octave).alias("_bucket"))
    group = Window.partitionBy(*by)
    ahead = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    histogram = tagged.groupBy(*by, "_bucket").agg(F.count(value).alias("_n"), F.sum(value).alias("_s")).select(
        *by, "_bucket", "_n", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_offset"),
        F.sum("_n").over(group).alias("n_draws"), (F.sum("_s").over(group) / F.sum("_n").over(group)).alias("mean"))
    wanted = [f((F.col("n_draws") - 1) * q) + 1 for q in (LOWER, 0.5, UPPER) for f in (F.floor, F.ceil)]
    holds = reduce(lambda a, b: a | b, [(r > F.col("_offset")) & (r <= F.col("_offset") + F.col("_n")) for r in wanted])
    need = histogram.where(holds).drop("_n")
    if n_groups is not None:
        need = broadcast_bounded(need, len(wanted) * n_groups)
    keys = [*by, "_bucket"]
    held = tagged.where(F.col(value).isNotNull()).alias("t").join(need.alias("h"), same_keys("t", "h", keys)).select(
        *[F.col(f"t.`{c}`") for c in (*keys, value)], "h._offset", "h.n_draws", "h.mean")
    # a value that many rows share is one row from here on
    held = held.groupBy(*keys, value, "_offset", "n_draws", "mean").agg(F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = held.withColumn("upto", F.sum("n").over(inside) + F.col("_offset"))
    return ranked.groupBy(*by).agg(F.first("mean").alias("mean"), *[rank_quantile(value, q).alias(k) for k, q in QUANTILES.items()])


def ranked_summary(df: DataFrame, by: Sequence[str], value: str = "p", prob: float = 0.95) -> DataFrame:
    """Mean, median, quantiles and highest-density interval of groups of any size, from ranked values."""
    ranked = ranked_values(df, by, value)
    stats, interval = moments(ranked, by, value, QUANTILES), narrowest(ranked, by, value, prob)
    return stats.alias("m").join(interval.alias("i"), same_keys("m", "i", by)).select("m.*", "i.hdci_lo", "i.hdci_hi")


def hdci(df: DataFrame, by: Sequence[str], value: str = "p", prob: float = 0.95, draws: int | None = None) -> DataFrame:
    """Narrowest interval over sorted draws that spans ``floor(prob * n)`` steps; the first on ties.

    A declared number of ``draws`` is checked and makes a group one array; without it groups have any size.
    """
    if draws is not None:
        return full_summary(df, by, value, prob=prob, draws=draws).select(*by, "hdci_lo", "hdci_hi")
    return narrowest(ranked_values(df, by, value), by, value, prob)


def tail_probability(above: Column, below: Column) -> Column:
    """Twice the smaller tail. The two tests decide where ties go."""
    return F.least(2.0 * F.avg(above.cast("int")), 2.0 * F.avg(below.cast("int")))


def coefficient_summary(draws: DataFrame, metadata: Mapping[str, str] | None = None, max_draws: int = MAX_DRAWS) -> DataFrame:
    """Coefficient and odds ratio per term: mean and 95% interval, with result metadata.

    A term has at most ``max_draws`` values a fit, which is checked.
    """
    q = F.array(F.lit(LOWER), F.lit(UPPER))
    out = draws.groupBy("fit_id", "term").agg(
        _within(max_draws, F.avg("value"), "value").alias("mean"), F.percentile("value", q).alias("_q"),
        F.avg(F.exp("value")).alias("or_mean"), F.percentile(F.exp("value"), q).alias("_o"))
    return out.select(
        "fit_id", "term", "mean", F.col("_q")[0].alias("q025"), F.col("_q")[1].alias("q975"),
        "or_mean", F.col("_o")[0].alias("or_q025"), F.col("_o")[1].alias("or_q975"),
        *[F.lit(x).alias(k) for k, x in (metadata or {}).items()])
