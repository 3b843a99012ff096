"""Factor levels: declared order, reference level, binning and recoding.

A factor is a string column plus a declared ``Levels``. Order and reference
never come from the order of rows in a file.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata_spark import fixed_values as fx
from strata_spark.session import literal_table


@dataclass(frozen=True)
class Levels:
    """Name, labels in report order, and reference label of one factor."""

    name: str
    labels: tuple[str, ...]
    ref: str

    def __post_init__(self):
        if self.ref not in self.labels:
            raise ValueError(f"{self.name}: reference {self.ref!r} is not one of {self.labels}")
        if len(set(self.labels)) != len(self.labels):
            raise ValueError(f"{self.name}: repeated labels")

    @property
    def contrasts(self) -> tuple[str, ...]:
        """Labels other than the reference."""
        return tuple(x for x in self.labels if x != self.ref)

    def ordinal(self, col: Column) -> Column:
        """Position of a label in report order, null when unknown."""
        return position(col, self.labels) - 1

    def codes(self, col: Column) -> Column:
        """1-based code with the reference first, as contrast coding counts."""
        return position(col, (self.ref, *self.contrasts))


def position(col: Column, labels: Sequence[str]) -> Column:
    """1-based place of ``col`` in a list, null when unknown; mentions ``col`` once."""
    listed = F.expr(f"array({', '.join(map(sql_literal, labels))})")
    return F.nullif(F.array_position(listed, col), F.lit(0)).cast("int")


def choose(col: Column, mapping: Mapping) -> Column:
    """Value of ``mapping`` for ``col``; null for anything else."""
    (key, value), *rest = mapping.items()
    return reduce(lambda acc, kv: acc.when(col == kv[0], kv[1]), rest, F.when(col == key, value))


def bin_labels(breaks: Sequence[float]) -> tuple[str, ...]:
    """``[a,b)`` for each pair of breaks; the last bin is ``[a,b]``."""
    last = len(breaks) - 2
    return tuple(
        f"[{breaks[i]},{breaks[i + 1]}{']' if i == last else ')'}" for i in range(last + 1)
    )


def sql_literal(text: str) -> str:
    """String literal for a SQL expression."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def cut(value: str, breaks: Sequence[float]) -> Column:
    """Left-closed interval label of a SQL expression; the last bin also holds its upper end."""
    labels = bin_labels(breaks)
    arms = [
        f"WHEN {value} >= {breaks[i]} AND {value} {'<=' if i == len(labels) - 1 else '<'} {breaks[i + 1]} "
        f"THEN {sql_literal(label)}" for i, label in enumerate(labels)]
    return F.expr(f"CASE {' '.join(arms)} END")


def lower_bound(label: Column) -> Column:
    """Numeric lower bound of an interval label, for natural sorting."""
    return F.regexp_extract(label, r"^\[(-?\d+)", 1).try_cast("int")


def level_table(df: DataFrame, factors: Sequence[Levels]) -> DataFrame:
    """``(var, label, ordinal, is_ref)`` for levels that occur in ``df``.

    One pass: the factor columns are unpivoted, so the distinct set has at
    most as many rows as there are declared levels.
    """
    spark = df.sparkSession
    declared = literal_table(
        spark,
        [(f.name, x, i, x == f.ref) for f in factors for i, x in enumerate(f.labels)],
        "var string, label string, ordinal int, is_ref boolean",
    )
    used = (
        df.select(F.explode(F.array(*[
            F.struct(F.lit(f.name).alias("var"), F.col(f.name).alias("label")) for f in factors
        ])).alias("x"))
        .select("x.var", "x.label").where(F.col("label").isNotNull()).distinct()
    )
    return used.join(declared, ["var", "label"], "inner").select("var", "label", "ordinal", "is_ref")


def fan_out(df: DataFrame, *factors: Levels) -> DataFrame:
    """One row per input row and combination of declared levels.

    The fan-out is a constant of the declaration, so it is written as
    ``explode`` of literal arrays rather than as a join.
    """
    for f in factors:
        df = df.withColumn(f.name, F.expr(f"explode(array({', '.join(map(sql_literal, f.labels))}))"))
    return df


def within_levels(df: DataFrame, factors: Sequence[Levels]) -> DataFrame:
    """``df``; a row with a label that is not declared (or none) is an error when it is read."""
    for f in factors:
        wrong = F.raise_error(F.concat(F.lit(f"{f.name}: label not declared: "), F.coalesce(F.col(f.name), F.lit("null"))))
        df = df.withColumn(f.name, F.when(F.col(f.name).isin(*f.labels), F.col(f.name)).otherwise(wrong.cast("string")))
    return df


def grid_size(*factors: Levels, extra: int = 0) -> int:
    """Number of level combinations; ``extra`` counts a null level per factor."""
    return reduce(lambda acc, f: acc * (len(f.labels) + extra), factors, 1)


AGE = Levels("age_cat", bin_labels(fx.AGE_BREAKS), fx.SERO_AGE_REF)
SEX = Levels("Sex", fx.SEX_LEVELS, fx.SEX_REF)
PANEL_AGE = Levels("age_cat", bin_labels(fx.AGE_BREAKS), fx.PANEL_AGE_REF)
PANEL_AGE_10Y = Levels("age_cat", bin_labels(fx.AGE_BREAKS_10Y), fx.PANEL_AGE_10Y_REF)
PANEL_SEX = Levels("sex", fx.SEX_CODES, fx.SEX_CODE_REF)
INFECTION = Levels("inf_latest", fx.INFECTION_LEVELS, fx.INFECTION_REF)
VACCINATION = Levels("vacc_status_3way", fx.VACCINATION_LEVELS, fx.VACCINATION_REF)
