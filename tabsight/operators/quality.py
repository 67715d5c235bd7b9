"""Data-quality rules (X1-X6) as single-pass aggregations.

Each rule reads the table once (one wide ``agg``) or, for duplicates, one
``groupBy`` on all columns with map-side partial counts.  Results are small
DataFrames of findings; nothing is collected to decide the next step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.catalog import ROW_ID, TableSet, data_columns
from tabsight.functions.dates import parsed_date
from tabsight.functions.names import fill, is_date_named
from tabsight.operators.profile import is_missing, row_counts

# Rule thresholds and message texts of the reference.
MISSING_ALERT_PERCENT = 20          # X2: alert when a column misses more than 20 %
MISSING_WARNING_FRACTION = 0.5      # X3: warning when a column misses more than half the rows
MAX_COLUMNS = 50                    # X6
MIN_COLUMNS = 2                     # X6
MSG_HIGH_MISSING = "High missing values detected in: {columns}"
MSG_DUPLICATES = "{n} duplicate rows found"
MSG_EMPTY = "CSV file contains no data rows"
MSG_HALF_MISSING = "High missing values (>50%) in columns: {columns}"
MSG_FOUND_DUPLICATES = "Found {n} duplicate rows"
MSG_TOO_MANY_COLUMNS = "Large number of columns ({n}) - verify CSV format is correct"
MSG_TOO_FEW_COLUMNS = "CSV has very few columns - verify data is structured correctly"


def _fields(df: DataFrame):
    return [f for f in df.schema.fields if f.name != ROW_ID]


def coerced_missing(df: DataFrame, f: T.StructField) -> Column:
    """Missing after the reference's date coercion: a date-named string column counts
    unparseable values as missing (X2 is computed after ``to_datetime(errors='coerce')``)."""
    if isinstance(f.dataType, T.StringType) and is_date_named(f.name):
        return parsed_date(df, f.name).isNull()
    return is_missing(F.col(f"`{f.name}`"), f.dataType)


def missing_counts(df: DataFrame, after_date_coercion: bool = False) -> DataFrame:
    """(column_name, ordinal, missing, rows) in one scan."""
    fields = _fields(df)
    exprs = [F.count(F.lit(1)).alias("__rows")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        m = coerced_missing(df, f) if after_date_coercion else is_missing(c, f.dataType)
        exprs.append(F.sum(m.cast("long")).alias(f"__m{i}"))
    wide = df.agg(*exprs)
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(f.name).alias("column_name"), F.lit(i).alias("ordinal"),
                 F.coalesce(F.col(f"__m{i}"), F.lit(0)).alias("missing"), F.col("__rows").alias("rows"))
        for i, f in enumerate(fields)])).alias("e")).select("e.*")


def missing_alert(df: DataFrame, after_date_coercion: bool = True) -> DataFrame:
    """At most one row (type, severity, message) naming every column above 20 % missing."""
    mc = missing_counts(df, after_date_coercion)
    hot = mc.filter((F.col("rows") > 0) & (F.col("missing") / F.col("rows") * 100 > MISSING_ALERT_PERCENT))
    return (hot.agg(F.count(F.lit(1)).alias("n"), _joined_columns(hot).alias("cols"))
               .filter(F.col("n") > 0)
               .select(F.lit("Data Quality").alias("type"), F.lit("Warning").alias("severity"),
                       fill(MSG_HIGH_MISSING, columns=F.col("cols")).alias("message")))


def _joined_columns(df: DataFrame) -> Column:
    """Column names of the rows of ``df`` joined with ', ' in ordinal order (aggregate)."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column_name"))),
                                    lambda s: s["column_name"]), ", ")


def missing_warnings(df: DataFrame) -> DataFrame:
    """At most one warning naming every column that misses more than half of the rows."""
    mc = missing_counts(df)
    hot = mc.filter(F.col("missing") > F.col("rows") * MISSING_WARNING_FRACTION)
    return (hot.agg(F.count(F.lit(1)).alias("n"), _joined_columns(hot).alias("cols"))
               .filter(F.col("n") > 0)
               .select(fill(MSG_HALF_MISSING, columns=F.col("cols")).alias("message")))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows minus distinct rows (null equals null), as one row ``duplicate_rows``.

    ``groupBy`` on every column with partial counts: a row repeated a billion times
    is combined inside each task before the shuffle."""
    cols = [F.col(f"`{c}`") for c in data_columns(df)]
    return (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
              .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicate_rows")))


def duplicate_alert(df: DataFrame) -> DataFrame:
    """X4 alert row (type, severity, message) when duplicates exist."""
    return (duplicate_rows(df).filter(F.col("duplicate_rows") > 0)
            .select(F.lit("Data Quality").alias("type"), F.lit("Info").alias("severity"),
                    fill(MSG_DUPLICATES, n=F.col("duplicate_rows")).alias("message")))


def table_warnings(tables: TableSet, names: list[str] | None = None) -> DataFrame:
    """X5 / X6 for many tables: (table_name, severity, message).

    Row counts come from one job for all tables; column counts from the schema.  An
    empty table gets only the empty warning (the reference stops checking there)."""
    names = names or list(tables)
    spark = tables.spark
    ncols = spark.createDataFrame([(n, len(tables.plain(n).columns)) for n in names],
                                  "table_name string, column_count int")
    info = row_counts(tables, names).join(ncols, "table_name")
    empty = info.filter(F.col("row_count") == 0).select(
        "table_name", F.lit("warning").alias("severity"), F.lit(MSG_EMPTY).alias("message"))
    many = info.filter((F.col("row_count") > 0) & (F.col("column_count") > MAX_COLUMNS)).select(
        "table_name", F.lit("warning").alias("severity"),
        fill(MSG_TOO_MANY_COLUMNS, n=F.col("column_count")).alias("message"))
    few = info.filter((F.col("row_count") > 0) & (F.col("column_count") < MIN_COLUMNS)).select(
        "table_name", F.lit("warning").alias("severity"), F.lit(MSG_TOO_FEW_COLUMNS).alias("message"))
    return reduce(DataFrame.unionByName, [empty, many, few])
