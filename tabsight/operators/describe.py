"""X9 ``describe()``: count, mean, std, min, 25/50/75 %, max of the numeric columns.

Quartiles are exact and interpolated (pandas), from :mod:`quantiles`; Spark's
``DataFrame.summary()`` uses approximate percentiles and gives other numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.catalog import ROW_ID
from tabsight.operators.quantiles import exact_quantiles

# Pandas describe() statistic labels, in pandas order.
STATISTICS = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")


def numeric_columns(df: DataFrame) -> list[str]:
    """pandas ``select_dtypes('number')``: ints, floats, decimals; not bool."""
    return [f.name for f in df.schema.fields
            if f.name != ROW_ID and isinstance(f.dataType, T.NumericType)]


def describe_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per numeric column: column, ordinal, count, mean, std, min, p25, p50, p75, max."""
    cols = columns if columns is not None else numeric_columns(df)
    if not cols:
        spark = df.sparkSession
        return spark.createDataFrame([], "column string, ordinal int, count bigint, mean double, std double, "
                                         "min double, p25 double, p50 double, p75 double, max double")
    exprs = []
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`").cast("double")
        x = F.when(~F.isnan(x), x)
        exprs += [F.count(x).alias(f"c{i}"), F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}"),
                  F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    wide = df.agg(*exprs)
    scal = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("ordinal"), F.col(f"c{i}").alias("count"),
                 F.col(f"a{i}").alias("mean"), F.col(f"s{i}").alias("std"),
                 F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"))
        for i, c in enumerate(cols)])).alias("e")).select("e.*")
    qs = (exact_quantiles(df, cols, [0.25, 0.5, 0.75])
          .groupBy("column")
          .agg(F.max(F.when(F.col("q") == 0.25, F.col("value"))).alias("p25"),
               F.max(F.when(F.col("q") == 0.5, F.col("value"))).alias("p50"),
               F.max(F.when(F.col("q") == 0.75, F.col("value"))).alias("p75")))
    return (scal.join(qs, "column", "left")
                .select("column", "ordinal", "count", "mean", "std", "min", "p25", "p50", "p75", "max"))


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """pandas layout: a ``statistic`` column plus one column per numeric column.

    With no numeric column the result is the reference's one-row message frame."""
    cols = columns if columns is not None else numeric_columns(df)
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([("No numeric columns found for statistics",)], "Message string")
    long = describe_columns(df, cols)
    stat_cols = {"count": "count", "mean": "mean", "std": "std", "min": "min",
                 "25%": "p25", "50%": "p50", "75%": "p75", "max": "max"}
    rows = long.select("column", F.explode(F.array(*[
        F.struct(F.lit(i).alias("k"), F.lit(s).alias("statistic"), F.col(src).cast("double").alias("value"))
        for i, (s, src) in enumerate(stat_cols.items())])).alias("e")).select("column", "e.*")
    return (rows.groupBy("k", "statistic").pivot("column", cols).agg(F.first("value"))
                .orderBy("k").drop("k"))
