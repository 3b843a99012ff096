"""Exact ranks, quantiles and narrowest intervals of groups of any size.

Equal values are collapsed to one row with a count, on the map side first, so a value that a third of all rows share
is one row. The collapsed values are range-partitioned by (group, value) and written in that order; counts of the parts
of a group give each part its offset, and ranks are running sums inside a part. A group of any size is spread over as
many parts as its values need, and many small groups share one.

The narrowest interval pairs rank r with rank r + step. Only the first ``n - step`` ranks can start an interval and only
the last ``n - step`` can end one; both are cut into blocks of r, and inside a block one descending pass gives every start
the nearest end. No rank is joined with another.

Null values have no rank, and a group of nulls only is absent. Null group keys are groups like any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata_spark.session import written

#: Ranks of one block of starts and ends.
BLOCK_RANKS = 65_536
#: ``monotonically_increasing_id`` has the partition above this bit and counts rows below it.
PART_BIT = 33


def same_keys(left: str, right: str, keys: Sequence[str]) -> Column:
    """Equality of the keys of two aliased frames, nulls included."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`")) for k in keys])


def ranked_values(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``(*by, value, n, upto, n_draws)``: each distinct value with its count and the rank of its last copy."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    # parts are numbers in a written table: a lost task or a second reader cannot see other bounds
    ranged = written(
        counts.repartitionByRange(*by, value).sortWithinPartitions(*by, value)
        .withColumn("_part", F.shiftright(F.monotonically_increasing_id(), PART_BIT)), "ranked-values")
    keys = [*by, "_part"]
    group = Window.partitionBy(*by)
    ahead = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(*keys).agg(F.sum("n").alias("_n")).select(
        *keys, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_offset"), F.sum("_n").over(group).alias("n_draws"))
    inside = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumn("_upto", F.sum("n").over(inside))
    return summed.alias("v").join(parts.alias("p"), same_keys("v", "p", keys)).select(
        *[F.col(f"v.`{c}`") for c in (*by, value)], "v.n", (F.col("v._upto") + F.col("p._offset")).alias("upto"), "p.n_draws")


def rank_quantile(value: str, prob: float) -> Column:
    """Linear-interpolation quantile of ranked values as a plain sum."""
    position = (F.col("n_draws") - 1) * F.lit(prob) + 1
    low = F.floor(position)
    part = position - low

    def here(rank: Column) -> Column:
        return (rank > F.col("upto") - F.col("n")) & (rank <= F.col("upto"))

    weight = F.when(here(low), 1.0 - part).otherwise(0.0) + F.when(here(low + 1), part).otherwise(0.0)
    return F.sum(F.when(here(low) | here(low + 1), weight * F.col(value)))


def moments(ranked: DataFrame, by: Sequence[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Mean and named quantiles of ranked values."""
    mean = F.sum(F.col(value) * F.col("n")) / F.sum("n")
    return ranked.groupBy(*by).agg(mean.alias("mean"), *[rank_quantile(value, q).alias(k) for k, q in quantiles.items()])


def narrowest(ranked: DataFrame, by: Sequence[str], value: str, prob: float, block_ranks: int = BLOCK_RANKS) -> DataFrame:
    """Ends ``hdci_lo``, ``hdci_hi`` of the narrowest interval that spans ``floor(prob * n)`` steps (at most all); the first on ties.

    Of equal starts the first copy has the nearest end, so one start a distinct value is enough.
    """
    step = F.least(F.floor(F.col("n_draws") * F.lit(prob)).cast("bigint"), F.col("n_draws") - 1)
    sized = ranked.withColumns({"_step": step, "_starts": F.col("n_draws") - step, "_first": F.col("upto") - F.col("n") + 1})

    def block(rank: Column) -> Column:
        return F.call_function("div", rank - 1, F.lit(block_ranks))

    start = F.struct(block(F.col("_first")).alias("block"), F.lit(0).alias("is_end"), F.col("_first").alias("key"))
    first_end = F.greatest(F.col("_first") - F.col("_step"), F.lit(1))
    last_end = F.col("upto") - F.col("_step")
    # an end serves all starts whose partners are copies of it; the copies may reach over several blocks
    ends = F.transform(F.sequence(block(first_end), block(last_end)), lambda b: F.struct(
        b.alias("block"), F.lit(1).alias("is_end"), F.least(last_end, (b + 1) * block_ranks).alias("key")))
    none = F.array().cast("array<struct<block:bigint,is_end:int,key:bigint>>")
    events = F.concat(F.when(F.col("_first") <= F.col("_starts"), F.array(start)).otherwise(none),
                      F.when(F.col("upto") > F.col("_step"), ends).otherwise(none))
    spread = sized.select(*by, F.col(value).alias("_x"), F.explode(events).alias("_e")).select(*by, "_x", "_e.*")
    above = (Window.partitionBy(*by, "block").orderBy(F.col("key").desc(), F.col("is_end").desc())
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    nearest = F.last(F.when(F.col("is_end") == 1, F.col("_x")), ignorenulls=True).over(above)
    pairs = spread.withColumn("_hi", nearest).where("is_end = 0")
    # widths equal up to rounding noise are ties
    width = F.round(F.col("_hi") - F.col("_x"), 10)
    best = F.min_by(F.struct(F.col("_x").alias("lo"), F.col("_hi").alias("hi")), F.struct(width.alias("w"), F.col("_x").alias("lo")))
    return pairs.groupBy(*by).agg(best.alias("_b")).select(*by, F.col("_b.lo").alias("hdci_lo"), F.col("_b.hi").alias("hdci_hi"))


def array_summary(values: Column, quantiles: dict[str, float], prob: float) -> dict[str, Column]:
    """The same statistics of one sorted array, for groups whose size is declared and checked."""
    n = F.size(values)

    def at(position: Column) -> Column:
        low = F.floor(position).cast("int")
        below, over = F.get(values, low), F.get(values, F.least(low + 1, n - 1))
        return below + (over - below) * (position - low)

    step = F.least(F.floor(n * F.lit(prob)).cast("int"), n - 1)
    pairs = F.transform(F.slice(values, F.lit(1), n - step), lambda x, i: F.struct(
        F.round(F.get(values, i + step) - x, 10).alias("w"), x.alias("lo"), F.get(values, i + step).alias("hi")))
    best = F.array_min(pairs)
    return {**{k: at((n - 1) * F.lit(q)) for k, q in quantiles.items()}, "hdci_lo": best["lo"], "hdci_hi": best["hi"]}
