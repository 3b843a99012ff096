"""Every query against its SQL statement on the smallest tables."""

import pytest

from check_queries import compare, connect
from strata_spark.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in ORACLES:
        assert compare(df, con, ORACLES[name], rows) == []


def test_only_fits_lack_a_statement():
    assert set(QUERIES) - set(ORACLES) == {"fit_map", "fit_draws_summary", "fitted_poststrat"}
