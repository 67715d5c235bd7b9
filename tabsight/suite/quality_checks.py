"""Checks for the data-quality and insight rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsight.operators.describe import describe_columns
from tabsight.operators.insights import (combined_summary, date_ranges, insights_frame, kpi_summary,
                                         recommendations_frame, sales_insight, skew_recommendations,
                                         strict_date_range)
from tabsight.operators.quality import (duplicate_rows, missing_alert, missing_counts, missing_warnings,
                                        table_warnings)
from tabsight.suite.base import register, rounded, tables
from tabsight.suite.profile_checks import DRIVER_SCHEMA
from tabsight.suite.views import DOC_LABELS_SQL, SALES_SQL, doc_labels_view, sales_view

_DL_COLS = [("doc_id", 0), ("lang", 1), ("source", 2), ("n_chars", 3), ("quality", 4), ("toxic", 5)]


def _doc_labels(spark, sf_dir):
    return doc_labels_view(tables(spark, sf_dir, "documents", "labels"))


@register("X1_missing_counts_doc_labels", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS missing FROM {DOC_LABELS_SQL} d" for c, _ in _DL_COLS))
def x1(spark, sf_dir):
    return missing_counts(_doc_labels(spark, sf_dir)).select("column_name", "missing")


@register("X2_missing_percent_alert", f"""
WITH m AS (
  {" UNION ALL ".join(f"SELECT '{c}' AS c, {i} AS o, (COUNT(*) - COUNT({c})) * 100.0 / COUNT(*) AS pct FROM {DOC_LABELS_SQL} d"
                      for c, i in _DL_COLS)}
)
SELECT 'Data Quality' AS type, 'Warning' AS severity,
       'High missing values detected in: ' || STRING_AGG(c, ', ' ORDER BY o) AS message
FROM m WHERE pct > 20 HAVING COUNT(*) > 0""")
def x2(spark, sf_dir):
    return missing_alert(_doc_labels(spark, sf_dir))


@register("X3_half_missing_warning", f"""
WITH m AS (
  {" UNION ALL ".join(f"SELECT '{c}' AS c, {i} AS o, COUNT(*) - COUNT({c}) AS miss, COUNT(*) AS n FROM {DOC_LABELS_SQL} d"
                      for c, i in _DL_COLS)}
)
SELECT 'High missing values (>50%) in columns: ' || STRING_AGG(c, ', ' ORDER BY o) AS message
FROM m WHERE miss > n * 0.5 HAVING COUNT(*) > 0""")
def x3(spark, sf_dir):
    return missing_warnings(_doc_labels(spark, sf_dir))


@register("X4_duplicate_rows", """
SELECT CAST((SELECT COUNT(*) FROM lineitem)
          - (SELECT COUNT(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem)) AS BIGINT)
       AS duplicate_rows""")
def x4(spark, sf_dir):
    li = tables(spark, sf_dir, "lineitem")["lineitem"].select("l_returnflag", "l_linestatus", "l_linenumber")
    return duplicate_rows(li)


@register("X4_duplicate_rows_full_table", """
SELECT CAST((SELECT COUNT(*) FROM lineitem) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM lineitem)) AS BIGINT)
       AS duplicate_rows""")
def x4b(spark, sf_dir):
    return duplicate_rows(tables(spark, sf_dir, "lineitem").plain("lineitem"))


def _table_warnings_sql() -> str:
    parts = []
    for t, cols in DRIVER_SCHEMA.items():
        n = len(cols)
        parts.append(f"SELECT '{t}' AS table_name, 'warning' AS severity, 'CSV file contains no data rows' AS message "
                     f"FROM {t} HAVING COUNT(*) = 0")
        if n > 50:
            parts.append(f"SELECT '{t}', 'warning', 'Large number of columns ({n}) - verify CSV format is correct' "
                         f"FROM {t} HAVING COUNT(*) > 0")
        if n < 2:
            parts.append(f"SELECT '{t}', 'warning', 'CSV has very few columns - verify data is structured correctly' "
                         f"FROM {t} HAVING COUNT(*) > 0")
    return "\nUNION ALL\n".join(parts)


_WIDE = 51

@register("X5_X6_table_shape_warnings", _table_warnings_sql() + f"""
UNION ALL SELECT 'wide', 'warning', 'Large number of columns ({_WIDE}) - verify CSV format is correct' FROM orders HAVING COUNT(*) > 0
UNION ALL SELECT 'narrow', 'warning', 'CSV has very few columns - verify data is structured correctly' FROM orders HAVING COUNT(*) > 0
UNION ALL SELECT 'none', 'warning', 'CSV file contains no data rows' FROM orders WHERE o_totalprice < 0 HAVING COUNT(*) = 0""")
def x5(spark, sf_dir):
    t = tables(spark, sf_dir)
    o = t.plain("orders")
    return table_warnings(t.replaced({
        "wide": o.select(*[F.col("o_orderkey").alias(f"c{i}") for i in range(_WIDE)]),
        "narrow": o.select("o_orderkey"), "none": o.filter("o_totalprice < 0")}))


_KPI = [("orders", "o_totalprice"), ("part", "p_retailprice"), ("lineitem", "l_extendedprice")]


def _money(e: str) -> str:
    return f"CASE WHEN {e} > 1000 THEN '$' || FORMAT('{{:,.2f}}', {e}) ELSE PRINTF('%.2f', {e}) END"


@register("X7_X8_kpi_summary", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column, ROUND(SUM({c}), 4) AS total, ROUND(AVG({c}), 4) AS mean, "
    f"ROUND(MEDIAN({c}), 4) AS median, {_money(f'ROUND(SUM({c}), 6)')} AS total_text FROM {t}" for t, c in _KPI))
def x7(spark, sf_dir):
    t = tables(spark, sf_dir, *[n for n, _ in _KPI])
    parts = []
    for name, _ in _KPI:
        parts.append(kpi_summary(t[name]).select(F.lit(name).alias("table_name"), "column", "total", "mean",
                                                 "median", "total_text"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out)


@register("X9_describe_lineitem", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, {i} AS ordinal, COUNT({c}) AS count, ROUND(AVG({c}), 4) AS mean, "
    f"ROUND(STDDEV_SAMP({c}), 4) AS std, ROUND(MIN({c}), 4) AS min, ROUND(QUANTILE_CONT({c}, 0.25), 4) AS p25, "
    f"ROUND(QUANTILE_CONT({c}, 0.5), 4) AS p50, ROUND(QUANTILE_CONT({c}, 0.75), 4) AS p75, "
    f"ROUND(MAX({c}), 4) AS max FROM lineitem"
    for i, c in enumerate(["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                           "l_extendedprice", "l_discount", "l_tax"])))
def x9(spark, sf_dir):
    return rounded(describe_columns(tables(spark, sf_dir, "lineitem")["lineitem"]))


_SKEW = [("orders", "o_totalprice"), ("part", "p_retailprice"), ("lineitem", "l_extendedprice"),
         ("lineitem", "l_quantity"), ("events", "value"), ("customer", "c_acctbal"), ("documents", "n_chars")]


@register("X10_skew_recommendations", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, 'Revenue Distribution' AS Category, "
    f"'High variation in {c} detected. Consider analyzing top performers to identify success patterns.' "
    f"AS Recommendation, 'Medium' AS Priority FROM {t} HAVING AVG({c}) > 1.5 * MEDIAN({c})" for t, c in _SKEW))
def x10(spark, sf_dir):
    t = tables(spark, sf_dir, *sorted({n for n, _ in _SKEW}))
    out = None
    for name, col in _SKEW:
        r = skew_recommendations(kpi_summary(t[name], [col])).select(
            F.lit(name).alias("table_name"), "Category", "Recommendation", "Priority")
        out = r if out is None else out.unionByName(r)
    return out


@register("X11_first_sales_column_insight", f"""
SELECT 'Sales Analysis' AS metric, PRINTF('%.2f', ROUND(SUM(sales), 6)) AS total,
       PRINTF('%.2f', AVG(sales)) AS average, PRINTF('%.2f', MEDIAN(sales)) AS median
FROM {SALES_SQL} s""")
def x11(spark, sf_dir):
    t = tables(spark, sf_dir, "orders", "customer", "nation")
    return sales_insight(sales_view(t).drop("_row_id"))


@register("X12_date_range_datetime_columns", """
SELECT 'o_orderdate' AS column, CAST(MIN(o_orderdate) AS VARCHAR) || ' to ' || CAST(MAX(o_orderdate) AS VARCHAR) AS value
FROM orders
UNION ALL
SELECT 'l_shipdate', CAST(MIN(l_shipdate) AS VARCHAR) || ' to ' || CAST(MAX(l_shipdate) AS VARCHAR) FROM lineitem""")
def x12(spark, sf_dir):
    t = tables(spark, sf_dir, "orders", "lineitem")
    return date_ranges(t["orders"]).unionByName(date_ranges(t["lineitem"])).select("column", "value")


@register("X12_date_range_lenient_strings", """
SELECT 'order_date' AS column,
       CAST(MIN(TRY_CAST(d AS TIMESTAMP)) AS VARCHAR) || ' to ' || CAST(MAX(TRY_CAST(d AS TIMESTAMP)) AS VARCHAR) AS value
FROM (SELECT CASE WHEN o_orderkey % 10 = 3 THEN 'bad' ELSE STRFTIME(o_orderdate, '%Y-%m-%d') END AS d FROM orders)""")
def x12b(spark, sf_dir):
    o = tables(spark, sf_dir, "orders")["orders"]
    s = o.select(F.when(F.col("o_orderkey") % 10 == 3, F.lit("bad"))
                 .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("order_date"))
    return date_ranges(s).select("column", "value")


def _formatted(spark, sf_dir, pattern):
    o = tables(spark, sf_dir, "orders")["orders"]
    return o.select(F.date_format("o_orderdate", pattern).alias("order_date"), "_row_id")


_DAY_RANGE = "STRFTIME(MIN(o_orderdate), '%Y-%m-%d 00:00:00') || ' to ' || STRFTIME(MAX(o_orderdate), '%Y-%m-%d 00:00:00')"


@register("X12_X13_us_and_month_name_dates", f"""
SELECT 'lenient' AS rule, {_DAY_RANGE} AS us, {_DAY_RANGE} AS named FROM orders
UNION ALL SELECT 'strict', {_DAY_RANGE}, {_DAY_RANGE} FROM orders""")
def x12_formats(spark, sf_dir):
    us, named = (_formatted(spark, sf_dir, p) for p in ("MM/dd/yyyy", "dd-MMM-yyyy"))
    rows = []
    for rule, fn in (("lenient", date_ranges), ("strict", strict_date_range)):
        one = fn(us).select(F.col("value").alias("us"))
        rows.append(one.select(F.lit(rule).alias("rule"), "us", fn(named).select("value").scalar().alias("named")))
    return rows[0].unionByName(rows[1])


@register("X2_X14_us_dates_give_no_alert", f"""
SELECT 'File Information' AS Category, 'File Name' AS Metric, 'us' AS Value, 0 AS seq
UNION ALL SELECT 'File Information', 'Total Rows', CAST(COUNT(*) AS VARCHAR), 10 FROM orders
UNION ALL SELECT 'File Information', 'Total Columns', '1', 11
UNION ALL SELECT 'Key Insights', 'order_date Range', {_DAY_RANGE}, 200 FROM orders
UNION ALL SELECT 'Alert (Info)', 'Data Quality',
       CAST(COUNT(*) - COUNT(DISTINCT STRFTIME(o_orderdate, '%m/%d/%Y')) AS VARCHAR) || ' duplicate rows found', 301 FROM orders
       HAVING COUNT(*) > COUNT(DISTINCT STRFTIME(o_orderdate, '%m/%d/%Y'))""")
def x14_us(spark, sf_dir):
    return insights_frame("us", _formatted(spark, sf_dir, "MM/dd/yyyy"))


@register("X13_strict_date_range", """
SELECT 'Date Range' AS metric, CAST(MIN(o_orderdate) AS VARCHAR) || ' to ' || CAST(MAX(o_orderdate) AS VARCHAR) AS value
FROM orders""")
def x13(spark, sf_dir):
    return strict_date_range(tables(spark, sf_dir, "orders").plain("orders"))


@register("X13_strict_date_range_bad_value_no_insight", """
SELECT COUNT(*) AS rows, 0 AS insights FROM orders""")
def x13b(spark, sf_dir):
    o = tables(spark, sf_dir, "orders")["orders"]
    s = o.select(F.when(F.col("o_orderkey") == 7, F.lit("bad"))
                 .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("ship_date"), "_row_id")
    found = strict_date_range(s).agg(F.count(F.lit(1)).alias("n")).scalar()
    return o.agg(F.count(F.lit(1)).alias("rows")).select("rows", found.alias("insights"))


@register("X14_insights_rows_orders", f"""
SELECT 'File Information' AS Category, 'File Name' AS Metric, 'orders' AS Value, 0 AS seq
UNION ALL SELECT 'File Information', 'Total Rows', CAST(COUNT(*) AS VARCHAR), 10 FROM orders
UNION ALL SELECT 'File Information', 'Total Columns', '6', 11
UNION ALL SELECT 'Key Insights', 'o_totalprice Analysis', {_money('ROUND(SUM(o_totalprice), 6)')}, 100 FROM orders
UNION ALL SELECT 'Key Insights', 'o_orderdate Range',
                 CAST(MIN(o_orderdate) AS VARCHAR) || ' to ' || CAST(MAX(o_orderdate) AS VARCHAR), 200 FROM orders""")
def x14(spark, sf_dir):
    return insights_frame("orders", tables(spark, sf_dir, "orders").plain("orders"))


@register("X14_insights_rows_with_alerts", f"""
SELECT 'File Information' AS Category, 'File Name' AS Metric, 'doc_labels' AS Value, 0 AS seq
UNION ALL SELECT 'File Information', 'Total Rows', CAST(COUNT(*) AS VARCHAR), 10 FROM {DOC_LABELS_SQL} d
UNION ALL SELECT 'File Information', 'Total Columns', '6', 11
UNION ALL SELECT 'Alert (Warning)', 'Data Quality', 'High missing values detected in: quality, toxic', 300""")
def x14b(spark, sf_dir):
    return insights_frame("doc_labels", _doc_labels(spark, sf_dir).drop("_row_id"))


@register("X15_recommendations_or_default", "\nUNION ALL\n".join(
    [f"SELECT 'Revenue Distribution' AS Category, "
     f"'High variation in {c} detected. Consider analyzing top performers to identify success patterns.' "
     f"AS Recommendation, 'Medium' AS Priority FROM orders HAVING AVG({c}) > 1.5 * MEDIAN({c})"
     for c in ["o_totalprice"]]
    + ["SELECT 'Message', 'No specific recommendations generated', 'Low' FROM orders "
       "HAVING NOT (AVG(o_totalprice) > 1.5 * MEDIAN(o_totalprice))"]))
def x15(spark, sf_dir):
    return recommendations_frame(tables(spark, sf_dir, "orders").plain("orders"))


@register("X16_combined_multi_file_summary", "\nUNION ALL\n".join(
    [f"SELECT '{t}' AS file_name, 1 AS files, COUNT(*) AS rows, {len(c)} AS columns FROM {t}"
     for t, c in DRIVER_SCHEMA.items()]
    + ["SELECT NULL, " + str(len(DRIVER_SCHEMA)) + ", ("
       + " + ".join(f"(SELECT COUNT(*) FROM {t})" for t in DRIVER_SCHEMA) + "), "
       + str(sum(len(c) for c in DRIVER_SCHEMA.values()))]))
def x16(spark, sf_dir):
    return combined_summary(tables(spark, sf_dir))


_CLOCKED = "STRFTIME(MIN({0}), '%Y-%m-%d %H:%M:%S') || '{1} to ' || STRFTIME(MAX({0}), '%Y-%m-%d %H:%M:%S') || '{1}'"
_AT = "o_orderdate + INTERVAL 1 MINUTE * (o_orderkey % 1440)"
#: date_format pattern of the column, the value's time of day kept or not, zone of the range
_LAYOUT_CHECKS = {"us_clock_date": ("MM/dd/yyyy hh:mm a", True, ""), "short_year_date": ("dd-MMM-yy", False, ""),
                  "weekday_date": ("EEE, dd MMM yyyy", False, ""), "zoned_date": ("yyyy-MM-dd'T'HH:mm:ss'+02:00'", True, "+02:00"),
                  "month_name_date": ("MMMM d, yyyy", False, ""), "compact_date": ("yyyyMMdd'T'HHmmss", True, "")}


@register("X2_X12_X13_layouts_of_one_column", " UNION ALL ".join(
    f"SELECT '{name}' AS column, {_CLOCKED.format(_AT if clock else 'o_orderdate', zone)} AS value, {_CLOCKED.format(_AT if clock else 'o_orderdate', zone)} AS strict, 0 AS missing FROM orders"
    for name, (_, clock, zone) in _LAYOUT_CHECKS.items()))
def x_layouts(spark, sf_dir):
    """One layout a column: the lenient range, the strict range, and no value missing after coercion."""
    o = tables(spark, sf_dir, "orders")["orders"]
    at = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("o_orderkey") % 1440).cast("int"))
    out = None
    for name, (pattern, clock, _) in _LAYOUT_CHECKS.items():
        df = o.select(F.date_format(at if clock else F.col("o_orderdate"), pattern).alias(name), "_row_id")
        one = date_ranges(df).select("column", "value").withColumn("strict", strict_date_range(df).select("value").scalar())
        one = one.withColumn("missing", missing_counts(df, True).select("missing").scalar().cast("int"))
        out = one if out is None else out.unionByName(one)
    return out
