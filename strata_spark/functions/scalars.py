"""Scalar column functions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.ln(p / (1.0 - p))


def safe_ln(x: Column) -> Column:
    """``ln`` kept away from zero, which rounding of complements can reach."""
    return F.ln(F.greatest(x, F.lit(TINY)))


def log_sum_exp(*cols: Column) -> Column:
    """``ln(sum(exp(c)))`` over columns, shifted by the largest."""
    top = F.greatest(*cols) if len(cols) > 1 else cols[0]
    return top + F.ln(reduce(lambda a, b: a + b, [F.exp(c - top) for c in cols]))


def bernoulli_log_mass(y: Column, q: Column) -> Column:
    """Log probability of the outcome; null where the outcome is missing."""
    return F.when(y == 1, safe_ln(q)).when(y == 0, safe_ln(1.0 - q))


def misclassified(p: Column, sens: Column, spec: Column) -> Column:
    """Probability of a positive result given true probability ``p``."""
    return sens * p + (1.0 - spec) * (1.0 - p)


def ratio(num: Column, den: Column) -> Column:
    """Division that gives null for a zero denominator."""
    return F.try_divide(num, den)


def whole_sum(x: Column) -> Column:
    """Sum that is null as soon as one value is: a missing value is not a zero."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.sum(x))


def mean_by_weight(value: Column, weight: Column) -> Column:
    """Weighted mean of a group; null where a value or weight is missing or the group has no weight."""
    return ratio(whole_sum(value * weight), whole_sum(weight))


def flatten_text(col: Column) -> Column:
    """Lowercase slug: newline and dot become ``_``, slash becomes ``-``."""
    return F.translate(F.lower(col), "\n/.", "_-_")


def slug(name: str) -> str:
    """``flatten_text`` of a name that is known here."""
    return name.lower().translate(str.maketrans("\n/.", "_-_"))


def snake(name: str) -> str:
    """Column name in snake case."""
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    return re.sub(r"[^0-9A-Za-z]+", "_", name).strip("_").lower()


def fixed(x: Column, digits: int) -> Column:
    """Decimal text, rounded half up from six places."""
    return x.cast("decimal(18,6)").cast(f"decimal(18,{digits})").cast("string")


def interval_text(mid: Column, lo: Column, hi: Column, digits: int, scale: float = 1.0) -> Column:
    """``mid (lo-hi)``."""
    m, a, b = (fixed(c * scale, digits) for c in (mid, lo, hi))
    return F.concat(m, F.lit(" ("), a, F.lit("-"), b, F.lit(")"))


def count_percent_text(n: Column, total: Column) -> Column:
    """``n (percent%)``."""
    pct = fixed(ratio(n * 100.0, total), 1)
    return F.concat(n.cast("string"), F.lit(" ("), pct, F.lit("%)"))


def extract(col: Column, pattern: str, group: int = 0) -> Column:
    """Regular-expression extract that gives null when nothing matches."""
    return F.nullif(F.regexp_extract(col, pattern, group), F.lit(""))


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded double without negative zero.

    The boundary lies just below the half, where ratios of small numbers do
    not fall, so sums that differ in their last bits round alike.
    """
    scale = 10.0**digits
    return F.when(F.abs(x) < 1e12, F.floor(x * scale + 0.500001) / scale).otherwise(x)
