"""Grouped and global aggregates of plan functions, none of which holds a group in one task.

Plain functions are one hash aggregate.  ``median``/``quantile`` are exact distributed quantiles, ``mode`` is a count per
value and a minimum over the counts, ``nth(k)`` a row number with a partial limit; their frames (one row per group) are
joined to the aggregate by key.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.functions.aggregates import PlanError, agg_expr, is_floating, nan_as_null, output_name

_CALL = re.compile(r"^\s*([A-Za-z]+)\s*(?:\(\s*([0-9.]+)\s*\))?\s*$")


def function_call(fn: str) -> tuple[str, float | None]:
    """``"quantile(0.9)"`` -> ("quantile", 0.9); a bare name has no argument."""
    m = _CALL.match(fn) if isinstance(fn, str) else None
    if not m:
        raise PlanError(f"aggregate function must be a name, got {fn!r}")
    return m[1].lower(), None if m[2] is None else float(m[2])


def needs_file_order(functions: list[str]) -> bool:
    return any(function_call(f)[0] in ("first", "last", "idxmax", "idxmin", "nth") for f in functions)


def present(name: str, dt: T.DataType) -> Column:
    """Neither null nor NaN."""
    c = F.col(f"`{name}`")
    return c.isNotNull() & ~F.isnan(c) if is_floating(dt) else c.isNotNull()


def grouped_aggregate(df: DataFrame, keys: list[str], specs: list[tuple[str, str]], row_id: str | None = None) -> DataFrame:
    """One row per group (or one row without ``keys``): the keys, then ``<column>_<function>`` in the order of ``specs``."""
    types = {f.name: f.dataType for f in df.schema.fields}
    kcols = [F.col(f"`{k}`") for k in keys]
    own = [k.alias(f"__g{i}") for i, k in enumerate(kcols)]
    gn = [f"__g{i}" for i in range(len(keys))]
    plain, quants, joined = [], [], []
    for i, (col, fn) in enumerate(specs):
        name, arg = function_call(fn)
        if name == "nth":
            if row_id is None:
                raise PlanError(f"aggregate 'nth' needs file order, the table has no row id")
            joined.append(_nth(df, own, gn, kcols, col, int(arg or 0), row_id, f"__o{i}"))
            continue
        e = agg_expr(name, col, types[col], row_id)   # validates name and type
        if name in ("median", "quantile"):
            q = 0.5 if arg is None or name == "median" else arg
            if not 0 <= q <= 1:
                raise PlanError(f"quantile must lie in 0..1, got {q}")
            quants.append((i, col, q))
        elif name == "mode":
            joined.append(_mode(df, own, gn, nan_as_null(F.col(f"`{col}`"), types[col]), f"__o{i}"))
        else:
            plain.append(e.alias(f"__o{i}"))
    base = df.groupBy(*own) if keys else df.groupBy()
    out = base.agg(*(plain or [F.count(F.lit(1)).alias("__rows")]))
    if quants:
        joined.append(_quantiles(df, keys, gn, quants))
    for frame in joined:
        if keys:
            right = frame.select(*[F.col(g).alias(f"j{g}") for g in gn], *[c for c in frame.columns if c not in gn])
            same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"j{g}")) for g in gn])
            out = out.join(right, same, "left").drop(*[f"j{g}" for g in gn])
        else:   # one struct-valued scalar subquery carries the one-row frame
            s = frame.agg(F.max(F.struct(*frame.columns)).alias("s")).scalar()
            out = out.select("*", *[s.getField(c).alias(c) for c in frame.columns])
    return out.select(*[F.col(g).alias(k) for g, k in zip(gn, keys)],
                      *[F.col(f"__o{i}").alias(output_name(c, f)) for i, (c, f) in enumerate(specs)])


def _quantiles(df: DataFrame, keys: list[str], gn: list[str], quants) -> DataFrame:
    from tabsight.operators.quantiles import quantile_rows
    cols, probs = sorted({c for _, c, _ in quants}), sorted({q for _, _, q in quants})
    rows = quantile_rows(df, cols, probs, by=keys)
    picks = [F.max(F.when((F.col("__c") == cols.index(c)) & (F.col("__q") == float(q)), F.col("__value"))).alias(f"__o{i}")
             for i, c, q in quants]
    return rows.groupBy(*[F.col(f"__k{i}").alias(g) for i, g in enumerate(gn)]).agg(*picks)


def _mode(df: DataFrame, own, gn: list[str], value: Column, out: str) -> DataFrame:
    """Most frequent value, the smallest of several."""
    counts = df.filter(value.isNotNull()).groupBy(*own, value.alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    best = F.min(F.struct((-F.col("__n")).alias("n"), F.col("__v").alias("v")))
    return counts.groupBy(*gn).agg(best.getField("v").alias(out))


def _nth(df: DataFrame, own, gn: list[str], kcols, col: str, k: int, row_id: str, out: str) -> DataFrame:
    """The value of the k-th row (from 0) of each group in file order."""
    rows = df.select(*own, F.col(f"`{col}`").alias(out), F.col(row_id).alias("__at"))
    w = Window.partitionBy(*gn).orderBy("__at")
    ranked = rows.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k + 1)
    return ranked.filter(F.col("__rn") == k + 1).select(*gn, out)
