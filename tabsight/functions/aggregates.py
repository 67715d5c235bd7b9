"""Aggregate functions with the semantics of the reference's pandas ``groupby().agg``.

Every function is a plain Spark aggregate expression (partial/final, codegen'd).
Differences from Spark defaults that pandas users rely on:

* NaN counts as missing (``nan_as_null``);
* ``sum`` of an all-null group is 0, ``prod`` is 1;
* ``skew``/``kurt`` are the bias-corrected sample forms;
* ``first``/``last`` take the first/last non-null value in file order;
* ``median``/``quantile`` are exact and interpolated (never approximate), ``mode`` is the smallest of the
  most frequent values; these need :func:`tabsight.operators.grouped.grouped_aggregate`, because one
  aggregation buffer would hold a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class PlanError(ValueError):
    """A plan step that cannot run (reported per op, the run goes on)."""


# Aggregate names the planner vocabulary advertises or pandas accepts.
SUPPORTED_AGGS = (
    "sum", "mean", "count", "min", "max", "std", "median", "var", "nunique", "size",
    "first", "last", "quantile", "skew", "prod", "sem", "any", "idxmax", "idxmin",
    "kurt", "mode",
)

NUMERIC_ONLY = {"sum", "mean", "std", "median", "var", "quantile", "skew", "prod", "sem", "kurt",
                "idxmax", "idxmin"}


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType) or isinstance(dt, T.BooleanType)


def is_floating(dt: T.DataType) -> bool:
    return isinstance(dt, (T.DoubleType, T.FloatType))


def nan_as_null(c: Column, dt: T.DataType) -> Column:
    """pandas treats NaN as missing; Spark treats it as a value."""
    if is_floating(dt):
        return F.when(~F.isnan(c), c)
    return c


def _numeric(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, T.BooleanType):
        return c.cast("int")
    return c


def skew_corrected(x: Column) -> Column:
    """Adjusted Fisher-Pearson skewness (pandas ``skew``) from Spark's population form."""
    n = F.count(x).cast("double")
    g1 = F.skewness(x)
    corrected = g1 * F.sqrt(n * (n - 1)) / (n - 2)
    return (F.when(n < 3, F.lit(None).cast("double"))
             .when(F.var_pop(x) == 0, F.lit(0.0))
             .otherwise(corrected))


def kurt_corrected(x: Column) -> Column:
    """Unbiased excess kurtosis (pandas ``kurt``) from Spark's population excess form."""
    n = F.count(x).cast("double")
    g2 = F.kurtosis(x)
    corrected = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return (F.when(n < 4, F.lit(None).cast("double"))
             .when(F.var_pop(x) == 0, F.lit(0.0))
             .otherwise(corrected))


def agg_expr(func: str, col: str, dtype: T.DataType, row_id: str | None = None) -> Column:
    """Aggregate ``func`` over column ``col`` (of type ``dtype``), unaliased."""
    func = func.lower()
    if func not in SUPPORTED_AGGS:
        raise PlanError(f"unsupported aggregate function '{func}'")
    if func in NUMERIC_ONLY and not is_numeric(dtype):
        raise PlanError(f"aggregate '{func}' needs a numeric column, '{col}' is {dtype.simpleString()}")
    raw = F.col(f"`{col}`")
    c = nan_as_null(raw, dtype)
    x = _numeric(c, dtype)
    if func == "sum":
        zero = F.lit(0.0) if is_floating(dtype) else F.lit(0)
        return F.coalesce(F.sum(x), zero)
    if func == "mean":
        return F.avg(x)
    if func == "count":
        return F.count(c)
    if func == "min":
        return F.min(c)
    if func == "max":
        return F.max(c)
    if func == "std":
        return F.stddev_samp(x)
    if func == "var":
        return F.var_samp(x)
    if func == "sem":
        return F.stddev_samp(x) / F.sqrt(F.count(x))
    if func in ("median", "quantile", "mode"):
        return F.lit(None)    # placeholder: computed by grouped_aggregate
    if func == "nunique":
        return F.count_distinct(c)
    if func == "size":
        return F.count(F.lit(1))
    if func == "skew":
        return skew_corrected(x.cast("double"))
    if func == "kurt":
        return kurt_corrected(x.cast("double"))
    if func == "prod":
        return F.coalesce(F.product(x), F.lit(1.0))
    if func == "any":
        if isinstance(dtype, T.StringType):
            return F.coalesce(F.bool_or(F.length(c) > 0), F.lit(False))
        return F.coalesce(F.bool_or(x != 0), F.lit(False))
    if row_id is None:
        raise PlanError(f"aggregate '{func}' needs file order, the table has no row id")
    order = F.col(row_id)
    if func == "first":
        return F.min_by(c, F.when(c.isNotNull(), order))
    if func == "last":
        return F.max_by(c, F.when(c.isNotNull(), order))
    # row label = the row number in file order
    if func == "idxmax":
        return F.min_by(order, F.when(c.isNotNull(), F.struct((-x).alias("v"), order.alias("o"))))
    if func == "idxmin":
        return F.min_by(order, F.when(c.isNotNull(), F.struct(x.alias("v"), order.alias("o"))))
    raise PlanError(f"unsupported aggregate function '{func}'")  # pragma: no cover


def output_name(col: str, func: str) -> str:
    """Pandas flattens (column, function) to ``column_function``."""
    return f"{col}_{func}"
