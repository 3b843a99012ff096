"""Comparison with a reference level inside each draw."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata_spark.functions.levels import choose
from strata_spark.functions.scalars import ratio
from strata_spark.operators.summary import posterior_summary, tail_probability


def with_reference(df: DataFrame, refs: Mapping[str, str], by: Sequence[str] = ("sim",)) -> DataFrame:
    """Add ``is_ref`` and ``p_ref``, the reference level's value in the same draw.

    A window holds the levels of one variable in one draw.
    """
    is_ref = F.col("val") == choose(F.col("var"), refs)
    group = Window.partitionBy(*by, "var")
    return df.withColumn("is_ref", F.coalesce(is_ref, F.lit(False))).withColumn(
        "p_ref", F.max(F.when(F.col("is_ref"), F.col("p"))).over(group))


def sign_vs_reference(df: DataFrame, refs: Mapping[str, str], by: Sequence[str] = ("sim",)) -> DataFrame:
    """+1 above the reference, else -1 (a tie is -1), null for the reference itself."""
    sign = F.when(F.col("is_ref") | F.col("p_ref").isNull(), None).when(F.col("p") > F.col("p_ref"), 1).otherwise(-1)
    return with_reference(df, refs, by).withColumn("coef_sign", sign)


def sign_tail() -> Column:
    return tail_probability(F.col("coef_sign") > 0, F.col("coef_sign") < 0)


def relative_risk(estimates: DataFrame, refs: Mapping[str, str], by: Sequence[str] = ("sim",),
                  keep: Sequence[str] = ()) -> DataFrame:
    """Risk relative to the reference: mean, 95% interval, tail probability.

    Ties count in neither tail. The reference level has nulls.
    """
    variables = estimates.where(F.col("var").isin(*refs))
    rr = F.when(~F.col("is_ref"), ratio(F.col("p"), F.col("p_ref")))
    draws = with_reference(variables, refs, by).withColumn("rr", rr)
    keys = [*keep, "var", "val"]
    return posterior_summary(draws, keys, "rr", {"p_tail": tail_probability(F.col("rr") > 1, F.col("rr") < 1)})
