"""Row numbers and ranks that do not gather a whole group in one task.

A group is cut into buckets that follow the sort order. Bucket counts give
each bucket its offset, and rows are numbered inside their bucket only, so a
group with a third of all rows is still spread over its buckets.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata_spark.session import written


def number_rows(
    df: DataFrame, group: Sequence[str], bucket: Column, order: Sequence[Column], name: str,
    total: str | None = None,
) -> DataFrame:
    """Dense 1-based number per group in the order of ``(bucket, *order)``.

    ``bucket`` must not decrease along ``order`` and must be a function of the
    row alone, so that a recomputed task gives the same buckets.
    """
    tagged = df.withColumn("_bucket", bucket)
    keys = [*group, "_bucket"]
    ahead = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = tagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_offset", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    if total:
        counts = counts.withColumn(total, F.sum("_n").over(Window.partitionBy(*group)))
    inside = Window.partitionBy(*keys).orderBy(*order)
    # null groups and buckets are groups and buckets like any other
    joined = tagged.alias("t").join(
        counts.drop("_n").alias("c"), reduce(lambda a, b: a & b, [F.col(f"t.`{k}`").eqNullSafe(F.col(f"c.`{k}`")) for k in keys]))
    return (
        joined.select("t.*", "c._offset", *([f"c.{total}"] if total else []))
        .withColumn(name, (F.row_number().over(inside) + F.col("_offset")).cast("bigint"))
        .drop("_bucket", "_offset")
    )


def number_in_order(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Dense 1-based number per group in the order of the columns ``order``, missing values first.

    Rows are range-partitioned by (group, order), sorted and written once; only then are they numbered, by the place in
    their partition and the counts of the group's partitions before it. The source is read for the ranges and for the
    write and never joined; what is joined is one row for each partition and group in it. A group with a third of all
    rows lies in many partitions.
    """
    if not order:
        raise ValueError("a total order is needed")
    ranged = written(df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
                     .withColumn("_at", F.monotonically_increasing_id()), "numbered")
    # the number has the partition above its 33rd bit and counts the rows of a partition below it
    part = F.shiftright("_at", 33)
    spans = ranged.groupBy(*group, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    keys = [*group, "_part"]
    match = reduce(lambda a, b: a & b, [F.col(f"r.`{k}`").eqNullSafe(F.col(f"s.`{k}`")) for k in keys])
    joined = ranged.withColumn("_part", part).alias("r").join(spans.alias("s"), match)
    return joined.select(*[F.col(f"r.`{c}`") for c in df.columns if c != name],
                         (F.col("r._at") - F.col("s._first") + F.col("s._before") + 1).cast("bigint").alias(name))


def number_by_id(df: DataFrame, group: Sequence[str], id_column: str, name: str) -> DataFrame:
    """Number rows by a unique id."""
    return number_in_order(df, group, [id_column], name)


def index_keys(df: DataFrame, key: str, name: str) -> DataFrame:
    """Dense index of distinct keys in the order of their hash.

    The order of an index carries no meaning, and hash prefixes are even
    whatever the keys look like.
    """
    keys = df.select(key).distinct().withColumn("_h", F.md5(F.col(key).cast("string")))
    group = F.lit(1)
    return number_rows(
        keys.withColumn("_g", group), ["_g"], F.substring("_h", 1, 3), [F.col("_h"), F.col(key)], name
    ).drop("_g", "_h")


def value_bucket(x: Column, per_octave: int = 256) -> Column:
    """Bucket of a number that never decreases with it: ``per_octave`` equal steps between powers of two.

    So buckets are fine for rare probabilities and few for large values. A power of two that the logarithm misses by
    its last bit gives the same bucket from either side.
    """
    size = F.abs(x)
    octave = F.floor(F.log2(size))
    step = (octave + 1100) * per_octave + F.floor((size / F.pow(F.lit(2.0), octave) - 1) * per_octave)
    return F.when(x == 0, F.lit(0)).when(x > 0, step).otherwise(-step).cast("bigint")


def rank_draws(df: DataFrame, by: Sequence[str], value: str, per_octave: int = 256) -> DataFrame:
    """Rank of each draw inside its group, with the group size ``n_draws``; missing draws have no rank."""
    known = df.where(F.col(value).isNotNull())
    return number_rows(known, by, value_bucket(F.col(value), per_octave), [F.col(value)], "rank", total="n_draws")
