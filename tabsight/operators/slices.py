"""Slices of a column's value range with about equally many rows each.

A slice number is a function of the row alone (the bounds are literals), so a task that runs again after an executor
loss puts every row into the same slice.  Rows are compared with the bounds in the column's own type (whole numbers beyond
2^53 and texts with a shared beginning included).  The bounds are approximate quantiles, measured by one small job when the
operator is built: outliers, NaN and narrow value ranges do not crowd one slice.
"""

from __future__ import annotations

import decimal
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.catalog import ROW_ID, ntz_micros


#: values sampled for each slice of a text column, and the characters of them that serve as cut points
TEXT_SAMPLE, TEXT_CHARS = 64, 256


def order_key(c: Column, dt: T.DataType) -> Column | None:
    """``c`` as a value that is compared as itself: whole numbers (times as microseconds, dates as days), decimals, doubles
    or text; None for types without an order."""
    if isinstance(dt, T.TimestampNTZType):
        return ntz_micros(c)
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(dt, T.DateType):
        return F.unix_date(c).cast("bigint")
    if isinstance(dt, T.DecimalType) or isinstance(dt, T.StringType):
        return c
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return c.cast("double")
    if isinstance(dt, T.NumericType):
        return c.cast("bigint")
    return None


def _after(value, dt: T.DataType):
    """The next larger value of the key's type."""
    if isinstance(value, str):
        return value + "\0"
    if isinstance(value, decimal.Decimal):
        return value + decimal.Decimal(1).scaleb(-dt.scale)
    return value + 1 if isinstance(value, int) else math.nextafter(value, math.inf)


def quantile_bounds(df: DataFrame, keys: list[Column], n: int) -> list[list]:
    """For each key column the ascending values that cut its rows into about ``n`` equal parts (with repeats).

    They are cut points only: a row's slice is decided by comparing its whole value.  Numbers: approximate quantiles.  Text:
    the quantiles of a bounded random sample."""
    probs = [i / n for i in range(1, n)]
    frame = df.select(*[k.alias(f"b{i}") for i, k in enumerate(keys)])
    kinds = [f.dataType for f in frame.schema.fields]
    numbers = [i for i, t in enumerate(kinds) if not isinstance(t, T.StringType)]
    out: list[list] = [[] for _ in keys]
    if numbers:
        def known(i):
            c = F.col(f"b{i}")
            return F.when(~F.isnan(c), c) if isinstance(kinds[i], T.DoubleType) else c

        row = frame.agg(*[F.approx_percentile(known(i), probs, 20 * n).alias(f"b{i}") for i in numbers]).first()   # n values a column
        for i, got in zip(numbers, row):
            out[i] = [b for b in (got or []) if b is not None]
    for i in set(range(len(keys))) - set(numbers):
        c = F.col(f"b{i}")
        text = frame.filter(c.isNotNull()).select(F.substring(c, 1, TEXT_CHARS).alias("v"))
        total, size = text.count(), TEXT_SAMPLE * n
        if total:
            got = sorted(r["v"] for r in (text.sample(min(1.0, 1.2 * size / total), seed=17) if total > size else text).collect())
            out[i] = [got[len(got) * k // n] for k in range(1, n)] if got else []
    return out


def slice_of(x: Column, bounds: list) -> Column:
    """How many of the ascending distinct ``bounds`` are <= x (0 for null), by binary search in the expression."""
    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x < F.lit(bounds[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return F.when(x.isNull(), F.lit(0)).otherwise(search(0, len(bounds)))


def order_slices(df: DataFrame, order: list[str], n: int) -> Column:
    """Slice number of the row in ascending ``order`` (nulls first), about ``n`` slices.

    A value that fills several slices by itself is cut further by the next order column, or by file order."""
    types = {f.name: f.dataType for f in df.schema.fields}
    x = order_key(F.col(f"`{order[0]}`"), types[order[0]])
    tie = order[1] if len(order) > 1 else (ROW_ID if ROW_ID in types else None)
    y = order_key(F.col(f"`{tie}`"), types[tie]) if tie else None
    if x is None:
        return F.lit(0)
    found = quantile_bounds(df, [x] + ([y] if y is not None else []), n)
    bounds = found[0]
    # a cut point that is a whole value (not the head of a longer text) and fills a slice
    whole = lambda b: not isinstance(b, str) or len(b) < TEXT_CHARS
    hot = sorted({b for b, c in zip(bounds, bounds[1:]) if b == c and whole(b)}) if y is not None else []
    cuts = sorted({*bounds, *(_after(h, types[order[0]]) for h in hot)})
    first = slice_of(x, cuts)
    if not hot:
        return first
    second = sorted(set(found[1]))
    return first * (len(second) + 1) + F.when(x.isin(*hot), slice_of(y, second)).otherwise(F.lit(0))
