"""Checks that ride on the pass that computes a table.

Rules are counted by the job that writes the rows, as observed metrics, and judged when it has ended: no extra job, no
second read of the input.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Checks:
    """Rules on the frames of one job. A row that breaks a rule, or for which it is unknown, counts as failed."""

    def __init__(self) -> None:
        self.watched: dict[str, Observation] = {}

    def watch(self, df: DataFrame, name: str, rules: Mapping[str, Column]) -> DataFrame:
        """``df``, whose rows are counted under ``name`` by the first action that computes them."""
        if name in self.watched:
            raise ValueError(f"frame {name!r} is watched already")
        self.watched[name] = Observation(name)
        return df.observe(self.watched[name], F.count(F.lit(1)).alias("n_rows"), *[
            F.count_if(~F.coalesce(ok, F.lit(False))).alias(rule) for rule, ok in rules.items()])

    def counts(self) -> dict[str, dict[str, int]]:
        """Per watched frame its rows and the failures of each rule; only after the action."""
        return {name: observation.get for name, observation in self.watched.items()}

    def require(self) -> None:
        """Raise when any rule of any frame has failed."""
        bad = {f"{name}.{rule}": n for name, counts in self.counts().items() for rule, n in counts.items() if rule != "n_rows" and n}
        if bad:
            raise ValueError(f"failed checks: {bad}")


def write_checked(df: DataFrame, write: Callable[[DataFrame], None], checks: Checks) -> None:
    """Write ``df`` and judge the rules that were counted meanwhile; what has been written is the caller's to discard."""
    write(df)
    checks.require()


def watched(checks: Checks | None, df: DataFrame, name: str, rules: Mapping[str, Column]) -> DataFrame:
    return df if checks is None else checks.watch(df, name, rules)


def probability_rules(columns: Sequence[str]) -> dict[str, Column]:
    """Every column is a probability, not missing and not a not-a-number."""
    return {f"bad_{c}": F.col(c).between(0.0, 1.0) & ~F.isnan(c) for c in columns}
