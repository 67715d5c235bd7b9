"""Plan regressions: the physical plans keep the properties the design relies on."""

import os

import pytest

from tabsight.catalog import TableSet, load_tables
from tabsight.operators.inclusion import inclusion_dependencies
from tabsight.operators.profile import profile_columns
from tabsight.plans.executor import PlanExecutor
from tabsight.suite.plan_checks import FLAGSHIP_PLAN
from tabsight.suite.views import sales_view

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().optimizedPlan().toString()


def _final_plan(df) -> str:
    df.collect()   # adaptive plans are final after execution
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_pushes_filter_and_uses_top_k(spark):
    t = load_tables(spark, SF, ["orders", "customer", "nation"])
    df = PlanExecutor(TableSet({"sales": sales_view(t)})).build(FLAGSHIP_PLAN).df
    plan = _final_plan(df)
    assert "EqualNullSafe(o_orderstatus,F)" in plan          # != pushed to the Parquet scan
    assert "TakeOrderedAndProject" in plan                   # sort + limit is a top-k
    assert "SortAggregate" not in plan


def test_profile_and_inclusion_aggregations_are_hash_based(spark):
    t = load_tables(spark, SF, ["region", "nation", "customer", "orders"])
    for df in (profile_columns(t), inclusion_dependencies(t)):
        plan = _final_plan(df)
        assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan.replace(
            "ObjectHashAggregate(keys=[cid", "")  # the samples collect_list runs on <=5 rows per column
    assert "WindowGroupLimit" in _final_plan(profile_columns(t))   # samples: partial top-k before exchange
