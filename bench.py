"""

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs once as warm-up, then ``BENCH_REPEATS`` times (default 3); the
median wall-clock seconds per query are reported.  Inputs that the ingest
benchmarks need (lineitem as CSV, a 20-member ZIP built and checkpointed by Spark)
are prepared before timing starts.  Prints one JSON line on stdout.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tabsight.catalog import TableSet, load_tables  # noqa: E402
from tabsight.operators.describe import describe_columns  # noqa: E402
from tabsight.operators.inclusion import inclusion_dependencies  # noqa: E402
from tabsight.operators.insights import insights_frame, recommendations_frame  # noqa: E402
from tabsight.operators.profile import profile_columns  # noqa: E402
from tabsight.operators.quality import duplicate_rows, missing_alert  # noqa: E402
from tabsight.plans.executor import PlanExecutor  # noqa: E402
from tabsight.session import get_spark, scratch_path  # noqa: E402
from tabsight.sources.archive_builder import build_archive_frame  # noqa: E402
from tabsight.sources.csv import read_csv_table  # noqa: E402
from tabsight.sources.zipfiles import ingest_archives, release  # noqa: E402
from tabsight.suite.views import doc_labels_view, sales_view  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))

PLAN = {"operations": [
    {"name": "sales_by_location", "type": "groupby", "table": "sales",
     "filters": [{"column": "status", "operator": "!=", "value": "F"}],
     "groupby": ["location"], "agg_functions": {"sales": ["sum", "mean", "count"]},
     "sort": [{"column": "sales_sum", "ascending": False}], "limit": 10},
    {"name": "sales_by_category", "type": "groupby", "table": "sales", "groupby": ["category"],
     "agg_functions": {"sales": ["sum", "mean", "median", "std"]},
     "sort": [{"column": "sales_sum", "ascending": False}], "limit": 10},
    {"name": "lines_by_flag", "type": "groupby", "table": "lineitem", "groupby": ["l_returnflag", "l_linestatus"],
     "agg_functions": {"l_quantity": ["sum", "mean", "count"], "l_extendedprice": ["sum", "max"]},
     "sort": [{"column": "l_quantity_sum", "ascending": False}], "limit": 10},
    {"name": "top_priorities", "type": "groupby", "table": "sales", "groupby": ["priority"],
     "agg_functions": {"sales": ["sum", "count"]},
     "sort": [{"column": "sales_count", "ascending": False}], "limit": 5},
]}


def main() -> None:
    spark = get_spark("tabsight-bench", cpus=CPUS, shuffle_partitions=int(CPUS) * 2)
    t = load_tables(spark, SF_DIR)
    sales = TableSet({"sales": sales_view(t), "lineitem": t.plain("lineitem")})

    # inputs for the ingest benchmarks (written by Spark, not timed)
    csv_dir = scratch_path(spark, "bench-csv")
    t.plain("lineitem").write.option("header", True).csv(csv_dir)
    rows = {n: t.plain(n).count() for n in ("orders", "customer", "part", "supplier")}
    archives = [build_archive_frame(spark, {n: t[n]}, "bench.zip", rows_per_member=-(-rows[n] // 5)) for n in rows]
    archive = archives[0]
    for a in archives[1:]:
        archive = archive.unionByName(a)

    def plan_4op():
        run = PlanExecutor(sales, reuse_scans=True).run(PLAN)
        for r in run.results.values():
            r.df.collect()
        run.release()

    def profile_all():
        profile_columns(t).collect()

    def inclusion():
        inclusion_dependencies(t).collect()

    def describe_lineitem():
        describe_columns(t["lineitem"]).collect()

    def quality_insights():
        insights_frame("orders", t.plain("orders")).collect()
        recommendations_frame(t.plain("lineitem")).collect()
        duplicate_rows(t.plain("lineitem")).collect()
        missing_alert(doc_labels_view(t).drop("_row_id")).collect()

    def csv_ingest():
        read_csv_table(spark, csv_dir).df.agg(F.count(F.lit(1)), F.sum("l_quantity")).collect()

    def zip_ingest():
        _, tables = ingest_archives(spark, archive)
        for tab in tables.values():
            tab.df.agg(F.count(F.lit(1))).collect()
        release(spark, tables)

    queries = {"plan_4op": plan_4op, "profile_all_tables": profile_all, "inclusion_dependencies": inclusion,
               "describe_lineitem": describe_lineitem, "quality_insights": quality_insights,
               "csv_ingest_lineitem": csv_ingest, "zip_ingest_20_members": zip_ingest}
    times = {}
    for name, fn in queries.items():
        fn()   # warm-up
        runs = []
        for _ in range(REPEATS):
            t0 = time.perf_counter()
            fn()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    out = {"metric": "total_median_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).replace("sf", ""),
           "cpus": CPUS, "spark": spark.version, "repeats": REPEATS}
    spark.stop()
    print(json.dumps(out), flush=True)


if __name__ == "__main__":
    main()
