"""Physical plans: no cross joins, pushed filters, pruned columns, no row-at-a-time Python."""


import pytest

from strata_spark.catalog import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_cross_joins_or_row_python(spark, sf_dir, name):
    p = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "BatchEvalPython" not in p


def test_filter_and_columns_reach_the_scan(spark, sf_dir):
    p = plan(QUERIES["filter_variant"](spark, sf_dir))
    pushed = next(x for x in p.splitlines() if "FileScan" in x).split("PushedFilters: ")[1]
    assert "EqualTo(event_type,click)" in pushed or "In(event_type, [click])" in pushed
    p = plan(QUERIES["weighted_mean_by_sim"](spark, sf_dir))
    scan = next(x for x in p.splitlines() if "FileScan" in x)
    for column in ("l_extendedprice", "l_tax", "l_returnflag", "l_suppkey"):
        assert column not in scan


def test_one_shuffle_aggregates(spark, sf_dir):
    for name in ("collapse_cells", "sample_counts_rollup", "joint_results", "weighted_mean_by_sim"):
        assert plan(QUERIES[name](spark, sf_dir)).count("Exchange hashpartitioning") == 1


def test_scoring_does_not_shuffle_scored_rows(spark, sf_dir):
    p = plan(QUERIES["score_strata"](spark, sf_dir))
    assert "SortMergeJoin" not in p and "BroadcastHashJoin" in p


def test_a_result_name_prunes_folders(spark, sf_dir):
    p = plan(QUERIES["result_store"](spark, sf_dir))
    filters = next(x for x in p.splitlines() if "FileScan" in x).split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "variant" in filters and "(model" in filters and "DataFilters: []" in p


def test_partition_pruning(spark, sf_dir):
    one = QUERIES["partitioned_roundtrip"](spark, sf_dir).where("variant = 'click'")
    assert "PartitionFilters: [isnotnull(variant" in plan(one)
