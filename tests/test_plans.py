"""Plans: native expressions only, pruned scans, no product joins."""

import pytest

from rankmill.checks.queries import all_queries

QUERIES = all_queries()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["dataset", "features_with_ctr", "testset_dataset", "ctr", "ndcg_prediction", "job_processed"])
def test_no_python_and_no_product_join(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan


def test_only_needed_columns_are_read(spark, sf_dir):
    plan = plan_of(QUERIES["ndcg_prediction"](spark, sf_dir))
    assert "l_orderkey" in plan and "l_extendedprice" not in plan and "l_shipdate" not in plan


def test_counts_are_combined_before_the_shuffle(spark, sf_dir):
    assert "partial_count" in plan_of(QUERIES["action_count"](spark, sf_dir))
