"""Checks for sinks (K1, K3, K5) and the streaming folder ingest."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tabsight.catalog import TableSet
from tabsight.plans.executor import PlanExecutor
from tabsight.session import scratch_path
from tabsight.sinks.writers import records, report_prefix, write_report_bundle, write_results
from tabsight.sources.csv import read_csv_table
from tabsight.sources.files import outcome_summary
from tabsight.streaming.folder_ingest import run_folder_ingest
from tabsight.suite.base import register, rounded, tables
from tabsight.suite.plan_checks import FLAGSHIP_PLAN
from tabsight.suite.views import SALES_SQL, sales_view


def _write_flagship(spark, sf_dir):
    t = TableSet({"sales": sales_view(tables(spark, sf_dir, "orders", "customer", "nation"))})
    ex = PlanExecutor(t)
    results = {"operation_1": ex.build(FLAGSHIP_PLAN).df,
               "operation_2": ex.build({"table": "sales", "filters": [{"column": "sales", "value": "x"}],
                                        "groupby": ["location"], "agg_functions": {"sales": "sum"}}).df}
    prefix, rid = report_prefix(scratch_path(spark, "reports"))
    manifest = write_results(spark, results, prefix, rid)
    return prefix, manifest


@register("K1_result_csv_roundtrip", f"""
SELECT location, ROUND(SUM(sales), 4) AS sales_sum, ROUND(AVG(sales), 4) AS sales_mean, COUNT(sales) AS sales_count
FROM {SALES_SQL} s WHERE status IS DISTINCT FROM 'F'
GROUP BY location ORDER BY SUM(sales) DESC, location LIMIT 10""")
def k1(spark, sf_dir):
    prefix, _ = _write_flagship(spark, sf_dir)
    back = read_csv_table(spark, f"{prefix}/data/operation_1_data.csv", with_row_id=False).df
    return rounded(back)


@register("K1_quoted_texts_roundtrip", r"""
SELECT conv_id, turn, '"' || text || '",\' AS text FROM conversations""")
def k1_quotes(spark, sf_dir):
    c = tables(spark, sf_dir, "conversations").plain("conversations")
    prefix, rid = report_prefix(scratch_path(spark, "reports"))
    write_results(spark, {"r": c.select("conv_id", "turn", F.concat(F.lit('"'), "text", F.lit('",\\')).alias("text"))}, prefix, rid)
    return read_csv_table(spark, f"{prefix}/data/r_data.csv", with_row_id=False).df


@register("K2_report_layout", """
SELECT COUNT(*) AS rows, TRUE AS dated, TRUE AS named FROM nation""")
def k2(spark, sf_dir):
    t = tables(spark, sf_dir, "nation").plain("nation")
    prefix, rid = report_prefix(scratch_path(spark, "reports"))
    write_results(spark, {"n": t}, prefix, rid)
    path = spark.read.options(header=True).csv(f"{prefix}/data/n_data.csv").select(F.col("_metadata.file_path").alias("p"))
    return path.agg(F.count(F.lit(1)).alias("rows"),
                    F.bool_and(F.col("p").rlike(r"/reports/\d{4}-\d{2}-\d{2}/")).alias("dated"),
                    F.bool_and(F.col("p").rlike(rf"/{rid}/data/n_data\.csv/")).alias("named")).filter(
        F.lit(bool(re.fullmatch(r"req_\d{6}_[0-9a-f]{8}", rid))))


@register("K4_report_bundle_sheets", """
SELECT 'original_data' AS sheet, COUNT(*) AS rows FROM orders
UNION ALL SELECT 'summary_statistics', 8 FROM region WHERE r_regionkey = 0
UNION ALL SELECT 'insights', 5 FROM region WHERE r_regionkey = 0
UNION ALL SELECT 'recommendations', 1 FROM region WHERE r_regionkey = 0""")
def k4(spark, sf_dir):
    o = tables(spark, sf_dir, "orders").plain("orders")
    out = write_report_bundle(spark, "orders", o, scratch_path(spark, "bundle"))
    rows = None
    for sheet, path in out.items():
        df = spark.read.parquet(path) if sheet == "original_data" else read_csv_table(spark, path, with_row_id=False).df
        n = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(sheet).alias("sheet"), "rows")
        rows = n if rows is None else rows.unionByName(n)
    return rows


@register("P16_issue_summary_of_a_run", """
SELECT 1 AS total_reports, COUNT(DISTINCT o_orderstatus) AS errors, 0 AS warnings, TRUE AS has_errors, FALSE AS has_warnings,
       FALSE AS success FROM orders""")
def p16(spark, sf_dir):
    t = tables(spark, sf_dir, "orders")
    kinds = sorted(r[0] for r in t.plain("orders").select("o_orderstatus").distinct().collect())
    run = PlanExecutor(t).run({"operations": [{"table": "orders", "filters": [{"column": "o_totalprice", "operator": ">", "value": k}]}
                                              for k in kinds]})
    return outcome_summary(run.issues_df(spark), len(run.tables))


@register("K3_manifest_rows_per_result", f"""
SELECT 'operation_1' AS result_key, LEAST(COUNT(DISTINCT location), 10) AS rows, TRUE AS written
FROM {SALES_SQL} s WHERE status IS DISTINCT FROM 'F'
UNION ALL SELECT 'operation_2', 0, FALSE""")
def k3(spark, sf_dir):
    _, manifest = _write_flagship(spark, sf_dir)
    return manifest.select("result_key", "rows", "written")


@register("K5_K6_json_records", """
SELECT TO_JSON({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey}) AS record FROM nation""")
def k5(spark, sf_dir):
    return records(tables(spark, sf_dir, "nation").plain("nation"))


@register("S14_streaming_folder_ingest", """
SELECT 'nation' AS table_name, COUNT(*) AS rows, 3 AS columns FROM nation
UNION ALL SELECT 'region', COUNT(*), 2 FROM region
UNION ALL SELECT 'supplier', COUNT(*), 4 FROM supplier""")
def s14(spark, sf_dir):
    t = tables(spark, sf_dir, "nation", "region", "supplier")
    inbox = scratch_path(spark, "inbox")
    for n in ("nation", "region", "supplier"):
        t.plain(n).repartition(2).write.option("header", True).csv(f"{inbox}/{n}")
    prof = run_folder_ingest(spark, inbox, scratch_path(spark, "stream-out"), max_files_per_trigger=2)
    per_file = prof.select("source_path", "row_count", "column_name").groupBy("source_path").agg(
        F.max("row_count").alias("rows"), F.count(F.lit(1)).alias("columns"))
    table = F.regexp_extract("source_path", r"/([^/]+)/[^/]+$", 1)
    return per_file.groupBy(table.alias("table_name")).agg(F.sum("rows").alias("rows"),
                                                           F.max("columns").cast("int").alias("columns"))
