"""Plan executor against pandas on tables made for what each test needs: nulls, NaN, ties, single rows."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsight.catalog import TableSet
from tabsight.functions.aggregates import PlanError
from tabsight.plans.executor import PlanExecutor
from tabsight.plans.validate import validate_plan

#: parcels: a null weight, a NaN fee, a tie in the totals, a depot of one row and an empty lane
PARCELS = (["depot", "lane", "kilos", "fee"],
           [("north", "air", 4, 2.5), ("north", "sea", 10, float("nan")), ("east", None, 3, 8.0), ("west", "air", 7, 0.5),
            ("east", "sea", None, 1.25), ("north", "air", 6, 2.5), ("west", "rail", 13, 4.0), ("south", "sea", 20, 9.75)])


def _tables(spark, name, fx, with_pos=True):
    cols, rows = fx
    df = spark.createDataFrame(rows, cols)
    if with_pos:
        df = df.withColumn("_row_id", F.monotonically_increasing_id())
    return TableSet({name: df})


def _rows(df):
    return [tuple(r) for r in df.collect()]


def _frame():
    cols, rows = PARCELS
    return pd.DataFrame(rows, columns=cols)


def test_groups_equal_pandas(spark):
    t = _tables(spark, "parcels", PARCELS)
    res = PlanExecutor(t).build({"table": "parcels", "groupby": ["depot"], "agg_functions": {"kilos": ["sum", "mean", "count", "median", "std"],
                                                                                           "fee": ["sum", "max"]}})
    assert res.df.columns == ["depot", "kilos_sum", "kilos_mean", "kilos_count", "kilos_median", "kilos_std", "fee_sum", "fee_max"]
    want = _frame().groupby("depot").agg({"kilos": ["sum", "mean", "count", "median", "std"], "fee": ["sum", "max"]}).reset_index()
    for got, exp in zip(_rows(res.ordered()), want.itertuples(index=False)):
        assert got[0] == exp[0] and len(got) == len(exp)
        for x, y in zip(got[1:], exp[1:]):
            assert (x is None and pd.isna(y)) or math.isclose(x, y, abs_tol=1e-9)


def test_null_group_and_tied_totals(spark):
    ex = PlanExecutor(_tables(spark, "parcels", PARCELS))
    lanes = ex.build({"table": "parcels", "groupby": ["lane"], "agg_functions": {"kilos": ["sum"]},
                      "sort": [{"column": "kilos_sum", "ascending": False}], "limit": 2}).df
    assert _rows(lanes) == [("sea", 30), ("air", 17)]
    depots = ex.build({"table": "parcels", "groupby": ["depot"], "agg_functions": {"kilos": ["sum"]},
                       "sort": {"column": "kilos_sum", "ascending": False}}).df      # north, south and west tie: by key
    got = _rows(PlanExecutor(TableSet({"d": depots})).build({"table": "d", "sort": {"column": "kilos_sum", "ascending": False}, "limit": 9}).df)
    assert sorted(got) == [("east", 3), ("north", 20), ("south", 20), ("west", 20)] and got[-1] == ("east", 3)


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("limit", [1, 3, 7, 8])
def test_missing_values_sort_last_both_ways(spark, ascending, limit):
    rows = [(k, v) for k, v in enumerate([1.0, float("nan"), 3.0, None, -2.0, float("inf"), float("nan"), 3.0])]
    t = TableSet({"t": spark.createDataFrame(rows, "k int, v double")})
    got = PlanExecutor(t).build({"table": "t", "sort": {"column": "v", "ascending": ascending}, "limit": limit}).df.collect()
    want = pd.DataFrame(rows, columns=["k", "v"]).sort_values("v", ascending=ascending)["v"].head(limit)
    clean = lambda v: None if v is None or v != v else v
    assert [clean(r["v"]) for r in got] == [clean(v) for v in want]


def test_single_row_std_is_null(spark):
    t = TableSet({"t": spark.createDataFrame([("2024-01-01", 1000)], ["Date", "Sales"])})
    r = PlanExecutor(t).build({"table": "t", "aggregate": {"Sales": ["std", "sum"]}}).df.collect()[0]
    assert r["Sales_std"] is None and r["Sales_sum"] == 1000


@pytest.fixture
def nulls(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), ("b", None), ("a", 3.0), ("c", None)], "k string, v double")
    return TableSet({"t": df})


def test_null_key_dropped_and_all_null_sum_zero(nulls):
    r = PlanExecutor(nulls).build({"table": "t", "groupby": ["k"], "agg_functions": {"v": ["sum", "mean", "count"]}})
    got = {x[0]: tuple(x[1:]) for x in r.ordered().collect()}
    assert set(got) == {"a", "b", "c"}
    assert got["b"] == (0.0, None, 0)
    assert got["a"] == (4.0, 2.0, 2)


def test_not_equal_keeps_nulls(nulls):
    r = PlanExecutor(nulls).build({"table": "t", "filters": [{"column": "v", "operator": "!=", "value": 1.0}]})
    assert r.df.count() == 4
    eq_null = PlanExecutor(nulls).build({"table": "t", "filters": [{"column": "v", "operator": "==", "value": None}]})
    assert eq_null.df.count() == 0
    ne_null = PlanExecutor(nulls).build({"table": "t", "filters": [{"column": "v", "operator": "!=", "value": None}]})
    assert ne_null.df.count() == 5


def test_type_mismatch_and_in_scalar(nulls):
    ex = PlanExecutor(nulls)
    assert ex.build({"table": "t", "filters": [{"column": "v", "operator": "==", "value": "x"}]}).df.count() == 0
    with pytest.raises(PlanError):
        ex.build({"table": "t", "filters": [{"column": "v", "operator": ">", "value": "x"}]})
    with pytest.raises(PlanError):
        ex.build({"table": "t", "filters": [{"column": "k", "operator": "in", "value": "a"}]})


def test_op_errors_are_isolated_and_shapes(spark, nulls):
    run = PlanExecutor(nulls).run({"operations": [
        {"table": "t", "filters": [{"column": "v", "operator": ">", "value": "x"}]},
        {"table": "t", "groupby": "k", "agg_functions": {"nope": "sum"}}]})
    assert run.results["operation_1"].error and run.results["operation_2"].ok
    assert run.results["operation_2"].df.columns == ["k", "count"]
    assert run.issues_df(spark).filter("severity = 'error'").count() == 1
    assert run.metadata_df(spark).collect()[0]["total_rows_processed"] == 5


def test_missing_table_strict_and_fallback(nulls):
    with pytest.raises(PlanError):
        PlanExecutor(nulls, strict=True).build({"table": "nope"})
    issues = []
    r = PlanExecutor(nulls).build({"table": "nope"}, issues=issues)
    assert r.table == "t" and issues and issues[0][1] == "warning"


def test_negative_limit_rejected(nulls):
    with pytest.raises(PlanError):
        PlanExecutor(nulls).build({"table": "t", "limit": -1})


def test_validate_plan_flags_constraints(nulls):
    issues = validate_plan({"operations": [{"table": "t", "groupby": ["k"], "agg_functions": {"v": ["skew"]},
                                            "limit": 50}]}, nulls)
    msgs = " ".join(m for _, _, m in issues)
    assert "expected 3-4" in msgs and "skew" in msgs and "limit 50" in msgs and "no sort" in msgs


def test_skew_kurt_quantile_goldens(spark):
    df = spark.createDataFrame([(1, float(x)) for x in [1, 2, 4, 8, 16, 100, 3]], "g int, x double")
    t = TableSet({"t": df})
    r = PlanExecutor(t).build({"table": "t", "groupby": ["g"],
                               "agg_functions": {"x": ["skew", "kurt", "median"]}}).df.collect()[0]
    assert math.isclose(r["x_skew"], 2.538895, abs_tol=1e-6)
    assert math.isclose(r["x_kurt"], 6.540674, abs_tol=1e-6)
    assert r["x_median"] == 4.0


def test_semantic_types_and_result_context(spark):
    from tabsight.operators.report_context import result_context, semantic_types
    df = spark.createDataFrame([("2024-01-01", None, 1.5, True), ("x", "a", 2.0, False)],
                               "order_date string, name string, v double, flag boolean")
    got = {r["column"]: r["semantic_type"] for r in semantic_types(df).collect()}
    assert got == {"order_date": "temporal", "name": "nominal", "v": "quantitative", "flag": "quantitative"}
    t = _tables(spark, "parcels", PARCELS)
    run = PlanExecutor(t).run({"operations": [{"table": "parcels", "groupby": ["depot"], "agg_functions": {"kilos": ["sum"]}}]})
    ctx = result_context(run.results).collect()[0]
    assert ctx["row_count"] == 4 and ctx["columns"] == ["depot", "kilos_sum"]
    assert len(ctx["sample_data"]) == 3 and ctx["semantic_types"]["depot"] == "nominal"


def test_reuse_scans_persists_shared_table(spark):
    t = _tables(spark, "parcels", PARCELS)
    plan = {"operations": [{"table": "parcels", "groupby": ["depot"], "agg_functions": {"kilos": "sum"}},
                           {"table": "parcels", "groupby": ["lane"], "agg_functions": {"kilos": "sum"}}]}
    run = PlanExecutor(t, reuse_scans=True).run(plan)
    assert len(run.persisted) == 1
    assert run.results["operation_1"].df.count() == 4 and run.results["operation_2"].df.count() == 3
    run.release()
    assert run.persisted == []


def test_an_op_that_cannot_be_analysed_stops_alone(spark):
    t = TableSet({"t": spark.createDataFrame([(1, [1]), (2, [2])], "k int, a array<int>")})
    run = PlanExecutor(t).run({"operations": [{"table": "t", "groupby": ["k"], "agg_functions": {"a": "any"}},
                                              {"table": "t", "groupby": ["k"], "agg_functions": {"k": "sum"}}]})
    assert run.results["operation_1"].error and run.results["operation_2"].df.count() == 2


def test_row_numbers_over_many_files(spark, tmp_path):
    from tabsight.catalog import edge_rows, with_row_numbers
    path = str(tmp_path / "many")
    spark.range(1000).repartitionByRange(20, "id").sortWithinPartitions("id").write.parquet(path)
    scan = spark.read.parquet(path)
    assert with_row_numbers(scan).filter("_row_id <> id").count() == 0
    edge = edge_rows(scan, 3, 2)
    assert sorted(r["id"] for r in edge.collect()) == [0, 1, 2, 998, 999] and len(edge.inputFiles()) >= 1


def test_rule_plan_lists_what_it_leaves_out(spark):
    from tabsight.plans.rules import rule_plan
    rows = [(f"k{i}", "ab"[i % 2], i, i * 2.0) for i in range(60)]
    t = TableSet({"t": spark.createDataFrame(rows, "name string, grp string, sales_total int, price double")})
    plan = rule_plan(t, max_ops=1)
    assert len(plan["operations"]) == 1 and {s[1] for s in plan["skipped"]} == {"name", "price_by_grp"}
