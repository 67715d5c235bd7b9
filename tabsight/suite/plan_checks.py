"""Checks for the plan executor (Q*, F*, G*, T*, A1/A2): each runs a JSON plan op."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.catalog import TableSet
from tabsight.plans.executor import PlanExecutor
from tabsight.suite.base import register, rounded, tables
from tabsight.suite.views import DOC_LABELS_SQL, SALES_SQL, doc_labels_view, sales_view


def _op(t: TableSet, spec: dict, digits: int = 4) -> DataFrame:
    res = PlanExecutor(t).build(spec)
    return rounded(res.df, digits)


def _sales(spark: SparkSession, sf_dir: str) -> TableSet:
    t = tables(spark, sf_dir, "orders", "customer", "nation")
    return TableSet({"sales": sales_view(t)})


def _doc_labels(spark: SparkSession, sf_dir: str) -> TableSet:
    t = tables(spark, sf_dir, "documents", "labels")
    return TableSet({"doc_labels": doc_labels_view(t)})


FLAGSHIP_PLAN = {
    "table": "sales",
    "filters": [{"column": "status", "operator": "!=", "value": "F"}],
    "groupby": ["location"],
    "agg_functions": {"sales": ["sum", "mean", "count"]},
    "sort": [{"column": "sales_sum", "ascending": False}],
    "limit": 10,
}


@register("Q1_flagship_sales_by_location", f"""
SELECT location, ROUND(SUM(sales), 4) AS sales_sum, ROUND(AVG(sales), 4) AS sales_mean,
       COUNT(sales) AS sales_count
FROM {SALES_SQL} s
WHERE status IS DISTINCT FROM 'F'
GROUP BY location ORDER BY SUM(sales) DESC, location LIMIT 10""")
def flagship(spark, sf_dir):
    return _op(_sales(spark, sf_dir), FLAGSHIP_PLAN)


@register("Q2_table_by_normalized_name", """
SELECT r_regionkey, r_name FROM region""")
def q2(spark, sf_dir):
    t = TableSet({"Region.csv": tables(spark, sf_dir, "region")["region"]})
    return _op(t, {"table": "region"})


@register("Q3_scan_only", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def q3(spark, sf_dir):
    return _op(tables(spark, sf_dir, "nation"), {"table": "nation"})


@register("F1_filter_eq", """
SELECT l_linestatus, ROUND(SUM(l_quantity), 4) AS l_quantity_sum, COUNT(l_quantity) AS l_quantity_count
FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_linestatus""")
def f1(spark, sf_dir):
    return _op(tables(spark, sf_dir, "lineitem"), {
        "table": "lineitem", "filters": [{"column": "l_returnflag", "value": "R"}],
        "group_by": ["l_linestatus"], "aggregate": {"l_quantity": ["sum", "count"]}})


@register("F2_filter_ne_keeps_nulls", f"""
SELECT lang, COUNT(doc_id) AS doc_id_count, COUNT(toxic) AS toxic_count, COUNT(*) AS toxic_size
FROM {DOC_LABELS_SQL} d WHERE quality IS DISTINCT FROM 1 GROUP BY lang""")
def f2(spark, sf_dir):
    return _op(_doc_labels(spark, sf_dir), {
        "table": "doc_labels", "filters": [{"column": "quality", "operator": "!=", "value": 1}],
        "group_by": ["lang"], "aggregate": {"doc_id": "count", "toxic": ["count", "size"]}})


@register("F3_filter_gt", """
SELECT o_orderpriority, COUNT(o_totalprice) AS o_totalprice_count, ROUND(MIN(o_totalprice), 4) AS o_totalprice_min
FROM orders WHERE o_totalprice > 250000 GROUP BY o_orderpriority""")
def f3(spark, sf_dir):
    return _op(tables(spark, sf_dir, "orders"), {
        "table": "orders", "filters": [{"column": "o_totalprice", "operator": ">", "value": 250000}],
        "group_by": ["o_orderpriority"], "aggregate": {"o_totalprice": ["count", "min"]}})


@register("F4_filter_lt", """
SELECT o_orderpriority, COUNT(o_totalprice) AS o_totalprice_count, ROUND(MAX(o_totalprice), 4) AS o_totalprice_max
FROM orders WHERE o_totalprice < 50000 GROUP BY o_orderpriority""")
def f4(spark, sf_dir):
    return _op(tables(spark, sf_dir, "orders"), {
        "table": "orders", "filters": [{"column": "o_totalprice", "operator": "<", "value": 50000}],
        "group_by": ["o_orderpriority"], "aggregate": {"o_totalprice": ["count", "max"]}})


@register("F5_filter_ge_timestamp", """
SELECT o_orderstatus, COUNT(o_orderkey) AS o_orderkey_count
FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY o_orderstatus""")
def f5(spark, sf_dir):
    return _op(tables(spark, sf_dir, "orders"), {
        "table": "orders", "filters": [{"column": "o_orderdate", "operator": ">=", "value": "1998-01-01"}],
        "group_by": "o_orderstatus", "aggregate": {"o_orderkey": "count"}})


@register("F6_filter_le", """
SELECT l_returnflag, CAST(SUM(l_linenumber) AS BIGINT) AS l_linenumber_sum
FROM lineitem WHERE l_discount <= 0.03 GROUP BY l_returnflag""")
def f6(spark, sf_dir):
    return _op(tables(spark, sf_dir, "lineitem"), {
        "table": "lineitem", "filters": [{"column": "l_discount", "operator": "<=", "value": 0.03}],
        "group_by": ["l_returnflag"], "aggregate": {"l_linenumber": "sum"}})


@register("F7_filter_in", """
SELECT o_orderstatus, COUNT(o_orderkey) AS o_orderkey_count
FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY o_orderstatus""")
def f7(spark, sf_dir):
    return _op(tables(spark, sf_dir, "orders"), {
        "table": "orders",
        "filters": [{"column": "o_orderpriority", "operator": "in", "value": ["1-URGENT", "2-HIGH"]}],
        "group_by": ["o_orderstatus"], "aggregate": {"o_orderkey": ["count"]}})


@register("F8_filter_conjunction", """
SELECT o_orderpriority, ROUND(SUM(o_totalprice), 4) AS o_totalprice_sum, COUNT(o_totalprice) AS o_totalprice_count
FROM orders
WHERE o_totalprice > 1000 AND o_totalprice <= 300000
  AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'
  AND o_orderstatus != 'P'
GROUP BY o_orderpriority""")
def f8(spark, sf_dir):
    return _op(tables(spark, sf_dir, "orders"), {
        "table": "orders",
        "filters": [{"column": "o_totalprice", "operator": ">", "value": 1000},
                    {"column": "o_totalprice", "operator": "<=", "value": 300000},
                    {"column": "o_orderdate", "operator": ">=", "value": "1996-01-01"},
                    {"column": "o_orderdate", "operator": "<", "value": "1998-01-01"},
                    {"column": "o_orderstatus", "operator": "!=", "value": "P"}],
        "group_by": ["o_orderpriority"], "aggregate": {"o_totalprice": ["sum", "count"]}})


@register("F9_unknown_filter_ignored", """
SELECT o_orderstatus, COUNT(o_orderkey) AS o_orderkey_count FROM orders GROUP BY o_orderstatus""")
def f9(spark, sf_dir):
    return _op(tables(spark, sf_dir, "orders"), {
        "table": "orders",
        "filters": [{"column": "no_such_column", "operator": "==", "value": 1},
                    {"column": "o_totalprice", "operator": "~=", "value": 1}],
        "group_by": ["o_orderstatus"], "aggregate": {"o_orderkey": "count"}})


@register("F10_type_mismatch_beside_a_real_filter", """
SELECT 'mismatch_eq' AS step, CAST(NULL AS VARCHAR) AS o_orderstatus, COUNT(*) AS rows FROM orders WHERE FALSE
HAVING COUNT(*) > 0
UNION ALL SELECT 'mismatch_ne', o_orderstatus, COUNT(*) FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus
UNION ALL SELECT 'int_eq_true', o_orderstatus, COUNT(*) FROM orders WHERE o_custkey = 1 GROUP BY o_orderstatus
UNION ALL SELECT 'int_ne_true', o_orderstatus, COUNT(*) FROM orders WHERE o_custkey <> 1 GROUP BY o_orderstatus""")
def f10(spark, sf_dir):
    t = tables(spark, sf_dir, "orders")
    steps = {"mismatch_eq": [{"column": "o_totalprice", "operator": "==", "value": "high"},
                             {"column": "o_totalprice", "operator": ">", "value": 1000}],
             "mismatch_ne": [{"column": "o_totalprice", "operator": "!=", "value": "high"},
                             {"column": "o_totalprice", "operator": ">", "value": 1000}],
             "int_eq_true": [{"column": "o_custkey", "operator": "==", "value": True}],
             "int_ne_true": [{"column": "o_custkey", "operator": "!=", "value": True}]}
    out = None
    for name, filters in steps.items():
        r = _op(t, {"table": "orders", "filters": filters, "group_by": ["o_orderstatus"], "aggregate": {"nope": "sum"}})
        r = r.select(F.lit(name).alias("step"), "o_orderstatus", F.col("count").alias("rows"))
        out = r if out is None else out.unionByName(r)
    return out


@register("Q4_Q6_run_summary_with_bad_ops", """
SELECT 'operation_1' AS op, 'orders' AS table, COUNT(DISTINCT o_orderstatus) AS rows, FALSE AS failed FROM orders
UNION ALL SELECT 'operation_2', 'orders', NULL, TRUE
UNION ALL SELECT 'operation_3', 'orders', NULL, TRUE
UNION ALL SELECT 'operation_4', 'orders', COUNT(DISTINCT o_orderpriority), FALSE FROM orders
UNION ALL SELECT 'operation_5', NULL, NULL, TRUE""")
def q4(spark, sf_dir):
    t = tables(spark, sf_dir, "orders")
    run = PlanExecutor(t).run({"operations": [
        {"table": "orders", "groupby": ["o_orderstatus"], "agg_functions": {"o_totalprice": "sum"}},
        {"table": "orders", "groupby": ["o_orderstatus"], "agg_functions": {"o_orderpriority": "sum"}},
        {"table": "orders", "filters": [{"column": "o_totalprice", "operator": ">", "value": "x"}]},
        {"table": "orders", "groupby": ["o_orderpriority"], "agg_functions": {"o_totalprice": "median"}},
        "not an op"]})
    return run.summary_df(spark).select("op", "table", "rows", F.col("error").isNotNull().alias("failed"))


@register("Q5_run_metadata", """
SELECT 2 AS tables_processed, 2 AS aggregations_executed,
       (SELECT COUNT(*) FROM orders) + (SELECT COUNT(*) FROM customer) AS total_rows_processed""")
def q5(spark, sf_dir):
    t = tables(spark, sf_dir, "orders", "customer")
    run = PlanExecutor(t).run({"operations": [
        {"table": "orders", "groupby": ["o_orderstatus"], "agg_functions": {"o_totalprice": "sum"}},
        {"table": "customer", "limit": 3}]})
    return run.metadata_df(spark)


@register("A20_plan_validation_issues", """
SELECT 'plan' AS op, 'warning' AS severity, COUNT(*) AS issues FROM region WHERE r_regionkey = 0
UNION ALL SELECT 'operation_1', 'error', COUNT(DISTINCT c_mktsegment) - COUNT(DISTINCT c_mktsegment) + 2 FROM customer
UNION ALL SELECT 'operation_1', 'warning', 3 FROM region WHERE r_regionkey = 0""")
def a20(spark, sf_dir):
    from tabsight.plans.validate import validate_plan
    t = tables(spark, sf_dir, "customer", "region")
    issues = validate_plan({"operations": [{"table": "customer", "groupby": ["nope"], "agg_functions": {"c_acctbal": ["skew", "bad"]}}]}, t)
    df = spark.createDataFrame(issues, "op string, severity string, message string")
    return df.groupBy("op", "severity").agg(F.count(F.lit(1)).alias("issues"))


@register("G1_null_group_key_dropped", f"""
SELECT quality, CAST(SUM(n_chars) AS BIGINT) AS n_chars_sum, ROUND(AVG(n_chars), 4) AS n_chars_mean
FROM {DOC_LABELS_SQL} d WHERE quality IS NOT NULL GROUP BY quality""")
def g1(spark, sf_dir):
    return _op(_doc_labels(spark, sf_dir), {
        "table": "doc_labels", "groupby": ["quality"], "agg_functions": {"n_chars": ["sum", "mean"]}})


@register("G2_sum_all_null_group_is_zero", f"""
SELECT doc_id, CAST(COALESCE(SUM(toxic), 0) AS BIGINT) AS toxic_sum, COUNT(toxic) AS toxic_count,
       ROUND(AVG(toxic), 4) AS toxic_mean
FROM {DOC_LABELS_SQL} d GROUP BY doc_id""")
def g2(spark, sf_dir):
    return _op(_doc_labels(spark, sf_dir), {
        "table": "doc_labels", "groupby": ["doc_id"], "agg_functions": {"toxic": ["sum", "count", "mean"]}})


@register("G3_G7_basic_aggregates_two_keys", """
SELECT l_returnflag, l_linestatus,
       ROUND(SUM(l_quantity), 4) AS l_quantity_sum, ROUND(AVG(l_quantity), 4) AS l_quantity_mean,
       COUNT(l_quantity) AS l_quantity_count, ROUND(MIN(l_quantity), 4) AS l_quantity_min,
       ROUND(MAX(l_quantity), 4) AS l_quantity_max, ROUND(STDDEV_SAMP(l_quantity), 4) AS l_quantity_std,
       ROUND(AVG(l_discount), 4) AS l_discount_mean
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def g3(spark, sf_dir):
    return _op(tables(spark, sf_dir, "lineitem"), {
        "table": "lineitem", "groupby": ["l_returnflag", "l_linestatus"],
        "agg_functions": {"l_quantity": ["sum", "mean", "count", "min", "max", "std"], "l_discount": "mean"}})


@register("G7_std_single_row_group_null", """
SELECT n_nationkey, ROUND(STDDEV_SAMP(n_regionkey), 4) AS n_regionkey_std FROM nation GROUP BY n_nationkey""")
def g7(spark, sf_dir):
    return _op(tables(spark, sf_dir, "nation"), {
        "table": "nation", "groupby": ["n_nationkey"], "agg_functions": {"n_regionkey": "std"}})


@register("G8_median_exact", """
SELECT o_orderpriority, ROUND(MEDIAN(o_totalprice), 4) AS o_totalprice_median
FROM orders GROUP BY o_orderpriority""")
def g8(spark, sf_dir):
    return _op(tables(spark, sf_dir, "orders"), {
        "table": "orders", "groupby": ["o_orderpriority"], "agg_functions": {"o_totalprice": "median"}})


@register("G8_median_keys_with_reserved_looking_names", """
SELECT o_orderpriority AS n, o_orderstatus AS "a.1", ROUND(MEDIAN(CASE WHEN o_orderkey % 50 = 0 THEN NULL
       WHEN o_orderkey = (SELECT MIN(o_orderkey) FROM orders) THEN 1e15 ELSE o_totalprice END), 4) AS v_median
FROM orders GROUP BY 1, 2""")
def g8_names(spark, sf_dir):
    o = tables(spark, sf_dir, "orders").plain("orders")
    first = o.agg(F.min("o_orderkey")).scalar()
    v = (F.when(F.col("o_orderkey") % 50 == 0, F.lit(float("nan"))).when(F.col("o_orderkey") == first, F.lit(1e15))
         .otherwise(F.col("o_totalprice")))
    t = TableSet({"t": o.select(F.col("o_orderpriority").alias("n"), F.col("o_orderstatus").alias("a.1"), v.alias("v"))})
    return rounded(PlanExecutor(t).build({"table": "t", "groupby": ["n", "a.1"], "agg_functions": {"v": "median"}}).df)


@register("G1_nan_group_key_dropped", """
SELECT l_discount AS k, COUNT(*) AS l_orderkey_count FROM lineitem WHERE l_discount <> 0.05 GROUP BY 1""")
def g1_nan(spark, sf_dir):
    li = tables(spark, sf_dir, "lineitem").plain("lineitem")
    k = F.when(F.col("l_discount") == 0.05, F.lit(float("nan"))).otherwise(F.col("l_discount"))
    t = TableSet({"t": li.select(k.alias("k"), "l_orderkey")})
    return PlanExecutor(t).build({"table": "t", "groupby": ["k"], "agg_functions": {"l_orderkey": "count"}}).df


@register("G18_G21_order_functions_on_several_files", """
SELECT o_orderstatus, ROUND(ARG_MIN(o_totalprice, o_orderkey), 4) AS o_totalprice_first,
       ROUND(ARG_MAX(o_totalprice, o_orderkey), 4) AS o_totalprice_last,
       ARG_MAX(o_rownum, o_totalprice) AS o_totalprice_idxmax
FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 AS o_rownum FROM orders) o GROUP BY o_orderstatus""")
def g18_files(spark, sf_dir):
    from tabsight.session import scratch_path
    path = scratch_path(spark, "orders-in-files")
    tables(spark, sf_dir, "orders").plain("orders").repartitionByRange(7, "o_orderkey").sortWithinPartitions(
        "o_orderkey").write.parquet(path)
    t = TableSet({}, {"orders": spark.read.parquet(path)})
    return _op(t, {"table": "orders", "groupby": ["o_orderstatus"],
                   "agg_functions": {"o_totalprice": ["first", "last", "idxmax"]}})


@register("A2_nth_row_of_group", """
SELECT o_orderpriority, ROUND(o_totalprice, 4) AS "o_totalprice_nth(2)" FROM orders
QUALIFY ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) = 3""")
def a2_nth(spark, sf_dir):
    return _op(tables(spark, sf_dir, "orders"), {
        "table": "orders", "groupby": ["o_orderpriority"], "agg_functions": {"o_totalprice": "nth(2)"}})


@register("G19_quantile_with_probability", """
SELECT l_linestatus, ROUND(QUANTILE_CONT(l_extendedprice, 0.9), 4) AS "l_extendedprice_quantile(0.9)"
FROM lineitem GROUP BY l_linestatus""")
def g19_q(spark, sf_dir):
    return _op(tables(spark, sf_dir, "lineitem"), {
        "table": "lineitem", "groupby": ["l_linestatus"], "agg_functions": {"l_extendedprice": "quantile(0.9)"}})


@register("G9_G10_multi_functions_unknown_column", """
SELECT o_orderstatus, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS o_totalprice_sum,
       CAST(MAX(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS o_totalprice_max,
       COUNT(DISTINCT o_custkey) AS o_custkey_nunique
FROM orders GROUP BY o_orderstatus""")
def g9(spark, sf_dir):
    o = tables(spark, sf_dir, "orders").plain("orders")
    # money as decimal: the sum does not depend on the order of the rows
    t = TableSet({"orders": o.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))})
    out = _op(t, {
        "table": "orders", "groupby": ["o_orderstatus"],
        "agg_functions": {"o_totalprice": ["sum", "max"], "not_a_column": "sum", "o_custkey": "nunique"}})
    return out.withColumns({c: F.col(c).cast("double") for c in ("o_totalprice_sum", "o_totalprice_max")})


@register("G11_group_size_when_no_valid_aggregate", """
SELECT c_mktsegment, COUNT(*) AS count FROM customer GROUP BY c_mktsegment""")
def g11(spark, sf_dir):
    return _op(tables(spark, sf_dir, "customer"), {
        "table": "customer", "groupby": ["c_mktsegment"], "agg_functions": {"not_a_column": "sum"}})


@register("G12_no_valid_group_key_passthrough", "SELECT r_regionkey, r_name FROM region")
def g12(spark, sf_dir):
    return _op(tables(spark, sf_dir, "region"), {
        "table": "region", "groupby": ["nope"], "agg_functions": {"r_regionkey": "sum"}})


@register("G13_limit_without_sort_takes_first_keys", """
SELECT o_custkey, ROUND(SUM(o_totalprice), 4) AS o_totalprice_sum FROM orders
GROUP BY o_custkey ORDER BY o_custkey LIMIT 7""")
def g13(spark, sf_dir):
    return _op(tables(spark, sf_dir, "orders"), {
        "table": "orders", "groupby": ["o_custkey"], "agg_functions": {"o_totalprice": "sum"}, "limit": 7})


@register("G14_global_aggregate", """
SELECT ROUND(SUM(o_totalprice), 4) AS o_totalprice_sum, ROUND(AVG(o_totalprice), 4) AS o_totalprice_mean,
       COUNT(o_totalprice) AS o_totalprice_count, ROUND(MAX(o_totalprice), 4) AS o_totalprice_max,
       ROUND(MIN(o_totalprice), 4) AS o_totalprice_min, COUNT(o_orderkey) AS o_orderkey_count
FROM orders""")
def g14(spark, sf_dir):
    return _op(tables(spark, sf_dir, "orders"), {
        "table": "orders",
        "aggregate": {"o_totalprice": ["sum", "mean", "count", "max", "min"], "o_orderkey": "count"}})


@register("G15_G17_var_nunique_size", """
SELECT l_returnflag, ROUND(VAR_SAMP(l_quantity), 4) AS l_quantity_var,
       COUNT(DISTINCT l_quantity) AS l_quantity_nunique, COUNT(*) AS l_quantity_size
FROM lineitem GROUP BY l_returnflag""")
def g15(spark, sf_dir):
    return _op(tables(spark, sf_dir, "lineitem"), {
        "table": "lineitem", "groupby": ["l_returnflag"],
        "agg_functions": {"l_quantity": ["var", "nunique", "size"]}})


@register("G18_first_last_file_order", """
SELECT o_orderstatus, ROUND(ARG_MIN(o_totalprice, o_orderkey), 4) AS o_totalprice_first,
       ROUND(ARG_MAX(o_totalprice, o_orderkey), 4) AS o_totalprice_last
FROM orders GROUP BY o_orderstatus""")
def g18(spark, sf_dir):
    return _op(tables(spark, sf_dir, "orders"), {
        "table": "orders", "groupby": ["o_orderstatus"], "agg_functions": {"o_totalprice": ["first", "last"]}})


@register("G19_quantile_default", """
SELECT l_linestatus, ROUND(QUANTILE_CONT(l_extendedprice, 0.5), 4) AS l_extendedprice_quantile
FROM lineitem GROUP BY l_linestatus""")
def g19(spark, sf_dir):
    return _op(tables(spark, sf_dir, "lineitem"), {
        "table": "lineitem", "groupby": ["l_linestatus"], "agg_functions": {"l_extendedprice": "quantile"}})


@register("G20_skew_bias_corrected", """
SELECT l_returnflag, ROUND(SKEWNESS(l_extendedprice), 4) AS l_extendedprice_skew
FROM lineitem GROUP BY l_returnflag""")
def g20(spark, sf_dir):
    return _op(tables(spark, sf_dir, "lineitem"), {
        "table": "lineitem", "groupby": ["l_returnflag"], "agg_functions": {"l_extendedprice": "skew"}})


@register("G21_prod_sem_any_idxmax", """
SELECT n_regionkey, ROUND(PRODUCT(n_nationkey), 4) AS n_nationkey_prod,
       ROUND(STDDEV_SAMP(n_nationkey) / SQRT(COUNT(n_nationkey)), 4) AS n_nationkey_sem,
       BOOL_OR(n_nationkey <> 0) AS n_nationkey_any,
       CAST(ARG_MAX(n_nationkey, n_nationkey) AS BIGINT) AS n_nationkey_idxmax
FROM nation GROUP BY n_regionkey""")
def g21(spark, sf_dir):
    return _op(tables(spark, sf_dir, "nation"), {
        "table": "nation", "groupby": ["n_regionkey"],
        "agg_functions": {"n_nationkey": ["prod", "sem", "any", "idxmax"]}})


@register("A1_kurt_bias_corrected", """
SELECT l_returnflag, ROUND(KURTOSIS(l_extendedprice), 4) AS l_extendedprice_kurt
FROM lineitem GROUP BY l_returnflag""")
def a1(spark, sf_dir):
    return _op(tables(spark, sf_dir, "lineitem"), {
        "table": "lineitem", "groupby": ["l_returnflag"], "agg_functions": {"l_extendedprice": "kurt"}})


@register("A2_mode", """
SELECT l_returnflag, MODE(l_linenumber) AS l_linenumber_mode FROM lineitem GROUP BY l_returnflag""")
def a2(spark, sf_dir):
    return _op(tables(spark, sf_dir, "lineitem"), {
        "table": "lineitem", "groupby": ["l_returnflag"], "agg_functions": {"l_linenumber": "mode"}})


@register("T1_sort_all_keys_nulls_last", """
SELECT location, COUNT(sales) AS sales_count, ROUND(MAX(sales), 4) AS sales_max
FROM """ + SALES_SQL + """ s GROUP BY location
ORDER BY COUNT(sales) DESC, location ASC LIMIT 6""")
def t1(spark, sf_dir):
    return _op(_sales(spark, sf_dir), {
        "table": "sales", "groupby": ["location"], "agg_functions": {"sales": ["count", "max"]},
        "sort": [{"column": "sales_count", "ascending": False}, {"column": "location"}], "limit": 6})


@register("T2_T3_top_k_rows", """
SELECT c_custkey, c_name, c_nationkey, ROUND(c_acctbal, 4) AS c_acctbal, c_mktsegment
FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10""")
def t2(spark, sf_dir):
    return _op(tables(spark, sf_dir, "customer"), {
        "table": "customer", "sort": {"column": "c_acctbal", "ascending": False}, "limit": 10})


@register("T2_limit_file_order", """
SELECT s_suppkey, s_name, s_nationkey, ROUND(s_acctbal, 4) AS s_acctbal FROM supplier ORDER BY s_suppkey LIMIT 5""")
def t2b(spark, sf_dir):
    return _op(tables(spark, sf_dir, "supplier"), {"table": "supplier", "limit": 5})


@register("Q7_table_scoped_steps", """
SELECT o_orderpriority, COUNT(o_orderkey) AS o_orderkey_count FROM orders
WHERE o_orderstatus = 'O' GROUP BY o_orderpriority""")
def q7(spark, sf_dir):
    t = tables(spark, sf_dir, "nation", "orders")
    run = PlanExecutor(t).run({"tables": {"orders": [
        {"filters": [{"column": "o_orderstatus", "value": "O"}],
         "groupby": ["o_orderpriority"], "agg_functions": {"o_orderkey": "count"}},
        {"limit": 3}]}})
    return rounded(run.results["orders.step_1"].df)


def _describe_sql(table: str, cols: list[str]) -> str:
    stats = [("count", "CAST(COUNT({c}) AS DOUBLE)"), ("mean", "AVG({c})"), ("std", "STDDEV_SAMP({c})"),
             ("min", "CAST(MIN({c}) AS DOUBLE)"), ("25%", "QUANTILE_CONT({c}, 0.25)"),
             ("50%", "QUANTILE_CONT({c}, 0.5)"), ("75%", "QUANTILE_CONT({c}, 0.75)"),
             ("max", "CAST(MAX({c}) AS DOUBLE)")]
    parts = []
    for label, e in stats:
        sel = ", ".join(f"ROUND({e.format(c=c)}, 4) AS {c}" for c in cols)
        parts.append(f"SELECT '{label}' AS statistic, {sel} FROM {table}")
    return "\nUNION ALL\n".join(parts)


LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax"]


@register("Q8_flexible_plan_describe", _describe_sql("lineitem", LINEITEM_NUMERIC))
def q8(spark, sf_dir):
    run = PlanExecutor(tables(spark, sf_dir, "lineitem")).run({})
    return rounded(run.results["main_aggregation"].df)


@register("A21_rule_made_plan_first_op", """
SELECT o_orderstatus, ROUND(SUM(o_totalprice), 4) AS o_totalprice_sum, ROUND(AVG(o_totalprice), 4) AS o_totalprice_mean,
       COUNT(o_totalprice) AS o_totalprice_count
FROM orders GROUP BY o_orderstatus ORDER BY SUM(o_totalprice) DESC LIMIT 10""")
def a21(spark, sf_dir):
    from tabsight.plans.rules import rule_plan
    t = tables(spark, sf_dir, "orders")
    run = PlanExecutor(t).run(rule_plan(t))
    return rounded(run.results["operation_1"].df)


@register("A21_rule_made_plan_second_op", """
SELECT o_orderpriority, ROUND(SUM(o_totalprice), 4) AS o_totalprice_sum,
       ROUND(AVG(o_totalprice), 4) AS o_totalprice_mean, COUNT(o_totalprice) AS o_totalprice_count
FROM orders GROUP BY o_orderpriority ORDER BY SUM(o_totalprice) DESC LIMIT 10""")
def a21b(spark, sf_dir):
    from tabsight.plans.rules import rule_plan
    t = tables(spark, sf_dir, "orders")
    run = PlanExecutor(t).run(rule_plan(t))
    return rounded(run.results["operation_2"].df)


@register("G8_G14_global_median_and_sum", """
SELECT ROUND(MEDIAN(l_extendedprice), 4) AS l_extendedprice_median, ROUND(SUM(l_quantity), 4) AS l_quantity_sum,
       ROUND(MEDIAN(l_quantity), 4) AS l_quantity_median
FROM lineitem""")
def g8_global(spark, sf_dir):
    return _op(tables(spark, sf_dir, "lineitem"), {
        "table": "lineitem", "aggregate": {"l_extendedprice": "median", "l_quantity": ["sum", "median"]}})


@register("A4_between_and_isin_filters", """
SELECT o_orderpriority, COUNT(o_orderkey) AS o_orderkey_count, ROUND(SUM(o_totalprice), 4) AS o_totalprice_sum
FROM orders
WHERE o_totalprice BETWEEN 100000 AND 200000 AND o_orderstatus IN ('O', 'P') AND o_orderpriority NOT IN ('5-LOW')
GROUP BY o_orderpriority""")
def a4(spark, sf_dir):
    return _op(tables(spark, sf_dir, "orders"), {
        "table": "orders",
        "filters": [{"column": "o_totalprice", "operator": "between", "value": [100000, 200000]},
                    {"column": "o_orderstatus", "operator": "isin", "value": ["O", "P"]},
                    {"column": "o_orderpriority", "operator": "not_in", "value": ["5-LOW"]}],
        "groupby": ["o_orderpriority"], "agg_functions": {"o_orderkey": "count", "o_totalprice": "sum"}})


_NAN_PRICES = "(SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders)"


@register("T1_T2_T3_missing_prices_sort_last", " UNION ALL ".join(f"""
SELECT * FROM (SELECT '{way}' AS way, o_orderkey, ROUND(price, 4) AS price FROM {_NAN_PRICES} x ORDER BY price {way} NULLS LAST, o_orderkey {way} LIMIT 25)"""
                                                                  for way in ("ASC", "DESC")) + f"""
UNION ALL SELECT * FROM (SELECT 'group', o_custkey, ROUND(MAX(CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_totalprice END), 4) AS price FROM orders
                         GROUP BY o_custkey ORDER BY MAX(CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_totalprice END) DESC NULLS LAST LIMIT 5)""")
def t_nan(spark, sf_dir):
    """NaN prices, both directions with a limit, and a group-by whose top groups are all NaN."""
    o = tables(spark, sf_dir, "orders").plain("orders")
    nan = F.lit(float("nan"))
    t = TableSet({"o": o.select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, nan).otherwise(F.col("o_totalprice")).alias("price")),
                  "g": o.select("o_custkey", F.when(F.col("o_custkey") % 3 == 0, nan).otherwise(F.col("o_totalprice")).alias("price"))})
    out = []
    for way, asc in (("ASC", True), ("DESC", False)):
        spec = {"table": "o", "sort": [{"column": "price", "ascending": asc}, {"column": "o_orderkey", "ascending": asc}], "limit": 25}
        out.append(PlanExecutor(t).build(spec).df.select(F.lit(way).alias("way"), "o_orderkey", "price"))
    top = PlanExecutor(t).build({"table": "g", "groupby": ["o_custkey"], "agg_functions": {"price": ["max"]},
                                 "sort": {"column": "price_max", "ascending": False}, "limit": 5}).df
    out.append(top.select(F.lit("group").alias("way"), F.col("o_custkey").alias("o_orderkey"), F.col("price_max").alias("price")))
    both = out[0].unionByName(out[1]).unionByName(out[2])
    return rounded(both.withColumn("price", F.nanvl("price", F.lit(None).cast("double"))))
