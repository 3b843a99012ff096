"""Named queries over the test tables, each with an independent SQL statement."""

from __future__ import annotations

from strata_spark.catalog import (  # noqa: F401
    cohort_queries, compare_queries, draws_queries, likelihood_queries, source_queries, strata_queries)
from strata_spark.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
