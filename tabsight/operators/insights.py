"""Insight rules (X7-X16) as aggregations over a table.

KPI statistics are one wide ``agg`` plus one distributed exact-median job
(:func:`tabsight.operators.quantiles.exact_quantiles`); the insight and
recommendation tables are unions of small aggregated frames with literal labels.
Column choice (names, keywords) is schema-level work on the driver; every number
is computed by Spark.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.catalog import ROW_ID, TableSet, data_columns
from tabsight.functions.dates import date_zone, parsed_date
from tabsight.functions.names import fill, fixed2_text, is_date_named, money_text
from tabsight.operators.profile import row_counts
from tabsight.operators.quality import duplicate_alert
from tabsight.operators.quantiles import exact_quantiles

# Keyword lists, limits and texts of the reference's insight rules.
KPI_KEYWORDS = ("revenue", "sales", "total", "amount", "price")
REPORT_KPI_LIMIT = 3          # opt-in: the report shows so many KPI columns
SKEW_FACTOR = 1.5
SALES_KEYWORD = "sales"
STRICT_DATE_KEYWORD = "date"
REC_CATEGORY = "Revenue Distribution"
REC_TEXT = "High variation in {col} detected. Consider analyzing top performers to identify success patterns."
REC_PRIORITY = "Medium"
NO_RECOMMENDATIONS = "No specific recommendations generated"


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if f.name != ROW_ID and isinstance(f.dataType, T.NumericType)]


def kpi_columns(df: DataFrame, keywords=KPI_KEYWORDS, limit: int | None = None) -> list[str]:
    """Numeric columns whose lower-case name contains a KPI keyword (with ``limit``: the first ones)."""
    cols = [c for c in _numeric(df) if any(k in c.lower() for k in keywords)]
    return cols if limit is None else cols[:limit]


def kpi_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """X7 + X8: (column, ordinal, total, mean, median, total_text, mean_text, median_text)."""
    cols = kpi_columns(df) if columns is None else columns
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column string, ordinal int, total double, mean double, median double, "
                                         "total_text string, mean_text string, median_text string")
    exprs = []
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`").cast("double")
        x = F.when(~F.isnan(x), x)
        exprs += [F.coalesce(F.sum(x), F.lit(0.0)).alias(f"t{i}"), F.avg(x).alias(f"m{i}")]
    wide = df.agg(*exprs).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("ordinal"),
                 F.col(f"t{i}").alias("total"), F.col(f"m{i}").alias("mean"))
        for i, c in enumerate(cols)])).alias("e")).select("e.*")
    med = exact_quantiles(df, cols, [0.5]).select("column", F.col("value").alias("median"))
    out = wide.join(med, "column", "left")
    return out.select("column", "ordinal", "total", "mean", "median",
                      money_text(F.col("total")).alias("total_text"),
                      money_text(F.col("mean")).alias("mean_text"),
                      money_text(F.col("median")).alias("median_text"))


def skew_recommendations(kpi: DataFrame) -> DataFrame:
    """One recommendation per KPI column whose mean exceeds 1.5 x median."""
    return (kpi.filter(F.col("mean") > F.col("median") * SKEW_FACTOR)
               .select(F.lit(REC_CATEGORY).alias("Category"),
                       fill(REC_TEXT, col=F.col("column")).alias("Recommendation"),
                       F.lit(REC_PRIORITY).alias("Priority"), "ordinal"))


def recommendations_frame(df: DataFrame, kpi: DataFrame | None = None) -> DataFrame:
    """(Category, Recommendation, Priority); one default row when the rules give none."""
    kpi = kpi_summary(df) if kpi is None else kpi
    recs = skew_recommendations(kpi)
    spark = df.sparkSession
    default = spark.createDataFrame([("Message", NO_RECOMMENDATIONS, "Low", -1)],
                                    "Category string, Recommendation string, Priority string, ordinal int")
    n_recs = recs.agg(F.count(F.lit(1))).scalar()
    return (recs.unionByName(default.filter(n_recs == 0))
                .select("Category", "Recommendation", "Priority"))


def sales_insight(df: DataFrame) -> DataFrame:
    """X11: the first column named like ``sales``, if numeric: total / average / median as %.2f."""
    spark = df.sparkSession
    names = [c for c in data_columns(df) if SALES_KEYWORD in c.lower()]
    schema = "metric string, total string, average string, median string"
    if not names or names[0] not in _numeric(df):
        return spark.createDataFrame([], schema)
    k = kpi_summary(df, [names[0]])
    return k.select(F.lit("Sales Analysis").alias("metric"),
                    fixed2_text(F.col("total")).alias("total"),
                    fixed2_text(F.col("mean")).alias("average"),
                    fixed2_text(F.col("median")).alias("median"))


def _ts_text(c: Column, zone: str = "") -> Column:
    """pandas ``str(Timestamp)``: seconds, plus six digits of the fraction when it is not zero, plus the column's offset."""
    ts = c.cast("timestamp_ntz")
    return F.concat(F.regexp_replace(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.000000$", ""), F.lit(zone))


def date_columns(df: DataFrame) -> list[str]:
    """X12 candidates: string or datetime columns whose name holds date/time/created/updated."""
    out = []
    for f in df.schema.fields:
        if f.name == ROW_ID or not is_date_named(f.name):
            continue
        if isinstance(f.dataType, (T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType)):
            out.append(f.name)
    return out


def date_ranges(df: DataFrame) -> DataFrame:
    """(column, ordinal, min_ts, max_ts, value='min to max') for every date-named column
    with at least one parseable value; one scan for all columns."""
    cols = date_columns(df)
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column string, ordinal int, value string")
    # parsed once a row, then aggregated
    parsed = df.select(*[parsed_date(df, c).alias(f"p{i}") for i, c in enumerate(cols)])
    wide = parsed.agg(*[g(f"p{i}").alias(f"{n}{i}") for i in range(len(cols)) for g, n in ((F.min, "lo"), (F.max, "hi"))])
    rows = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("ordinal"),
                 F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi"), F.lit(date_zone(df, c)).alias("zone"))
        for i, c in enumerate(cols)])).alias("e")).select("e.*")
    return (rows.filter(F.col("lo").isNotNull())
                .select("column", "ordinal",
                        F.concat(_ts_text(F.col("lo")), "zone", F.lit(" to "), _ts_text(F.col("hi")), "zone").alias("value")))


def strict_date_range(df: DataFrame) -> DataFrame:
    """The first column with 'date' in its name; any unparseable value -> no row."""
    spark = df.sparkSession
    names = [c for c in data_columns(df) if STRICT_DATE_KEYWORD in c.lower()]
    if not names:
        return spark.createDataFrame([], "metric string, value string")
    c = names[0]
    raw = F.col(f"`{c}`")
    p, zone = parsed_date(df, c), date_zone(df, c)
    return (df.select(raw.alias("raw"), p.alias("p"))
              .agg(F.count("raw").alias("n"), F.count("p").alias("ok"), F.min("p").alias("lo"), F.max("p").alias("hi"))
              .filter((F.col("n") == F.col("ok")) & F.col("lo").isNotNull())
              .select(F.lit("Date Range").alias("metric"),
                      F.concat(_ts_text(F.col("lo"), zone), F.lit(" to "), _ts_text(F.col("hi"), zone)).alias("value")))


def insights_frame(name: str, df: DataFrame, processed_at: str | None = None) -> DataFrame:
    """(Category, Metric, Value, seq) rows: file information, key insights (KPI totals
    then date ranges), alerts (missing, duplicates).  ``seq`` keeps the reference order.

    Row count, missing counts (after the date coercion, as the reference computes
    them), KPI totals and date ranges come from ONE wide aggregate over the table;
    duplicates are the only other job."""
    from tabsight.operators.quality import MISSING_ALERT_PERCENT, MSG_HIGH_MISSING, coerced_missing
    spark = df.sparkSession
    fields = [f for f in df.schema.fields if f.name != ROW_ID]
    kpis = kpi_columns(df)
    dcols = date_columns(df)
    exprs = [F.count(F.lit(1)).alias("__rows")]
    exprs += [F.sum(coerced_missing(df, f).cast("long")).alias(f"__m{i}")
              for i, f in enumerate(fields)]
    for j, c in enumerate(kpis):
        x = F.col(f"`{c}`").cast("double")
        exprs.append(F.coalesce(F.sum(F.when(~F.isnan(x), x)), F.lit(0.0)).alias(f"__t{j}"))
    for k, c in enumerate(dcols):
        p = parsed_date(df, c)
        exprs += [F.min(p).alias(f"__lo{k}"), F.max(p).alias(f"__hi{k}")]
    wide = df.agg(*exprs)
    if kpis:   # pandas-exact money text, computed on the one-row aggregate
        wide = wide.select("*", *[money_text(F.col(f"__t{j}")).alias(f"__tt{j}") for j in range(len(kpis))])
    rows = [F.struct(F.lit("File Information").alias("Category"), F.lit("Total Rows").alias("Metric"),
                     F.col("__rows").cast("string").alias("Value"), F.lit(10).alias("seq")),
            F.struct(F.lit("File Information").alias("Category"), F.lit("Total Columns").alias("Metric"),
                     F.lit(str(len(fields))).alias("Value"), F.lit(11).alias("seq"))]
    rows += [F.struct(F.lit("Key Insights").alias("Category"), F.lit(f"{c} Analysis").alias("Metric"),
                      F.col(f"__tt{j}").alias("Value"), F.lit(100 + j).alias("seq"))
             for j, c in enumerate(kpis)]
    rows += [F.struct(F.lit("Key Insights").alias("Category"), F.lit(f"{c} Range").alias("Metric"),
                      F.when(F.col(f"__lo{k}").isNotNull(),
                             F.concat(_ts_text(F.col(f"__lo{k}"), date_zone(df, c)), F.lit(" to "),
                                      _ts_text(F.col(f"__hi{k}"), date_zone(df, c))))
                      .alias("Value"), F.lit(200 + k).alias("seq"))
             for k, c in enumerate(dcols)]
    hot = [F.when((F.col("__rows") > 0) & (F.col(f"__m{i}") * 100.0 / F.col("__rows") > MISSING_ALERT_PERCENT),
                  F.lit(f.name)) for i, f in enumerate(fields)]
    names = F.concat_ws(", ", *hot) if hot else F.lit("")
    rows.append(F.struct(F.lit("Alert (Warning)").alias("Category"), F.lit("Data Quality").alias("Metric"),
                         F.when(names != "", fill(MSG_HIGH_MISSING, columns=names)).alias("Value"),
                         F.lit(300).alias("seq")))
    body = wide.select(F.explode(F.array(*rows)).alias("e")).select("e.*").filter(F.col("Value").isNotNull())
    info = [("File Information", "File Name", name)]
    if processed_at is not None:
        info.append(("File Information", "Processed At", processed_at))
    head = spark.createDataFrame([(a, b, c, i) for i, (a, b, c) in enumerate(info)],
                                 "Category string, Metric string, Value string, seq int")
    dups = duplicate_alert(df).select(
        F.concat(F.lit("Alert ("), F.col("severity"), F.lit(")")).alias("Category"),
        F.col("type").alias("Metric"), F.col("message").alias("Value"), F.lit(301).alias("seq"))
    return reduce(DataFrame.unionByName, [head, body, dups])


def combined_summary(tables: TableSet, names: list[str] | None = None) -> DataFrame:
    """Per-file rows and columns plus a total row (``file_name`` null) via ``rollup``."""
    names = names or list(tables)
    spark = tables.spark
    ncols = spark.createDataFrame([(n, len(tables.plain(n).columns)) for n in names],
                                  "table_name string, columns int")
    per = row_counts(tables, names).join(ncols, "table_name")
    return (per.rollup("table_name")
               .agg(F.count(F.lit(1)).alias("files"), F.sum("row_count").alias("rows"),
                    F.sum("columns").alias("columns"))
               .select(F.col("table_name").alias("file_name"), "files", "rows", "columns"))
