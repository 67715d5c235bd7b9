"""Correlations of all pairs of numeric columns in one pass.

Every task turns its Arrow batches into co-moments of all pairs by matrix products, centred on the batch's own means, and merges
them into one block of pairs x 6 numbers; a shuffle of these blocks (their size depends on the columns only) merges the tasks'
co-moments by the parallel formula for means and deviations.  Sums of raw squares are never formed, so values far from zero (keys,
times) keep their precision.  A pair counts the rows that have both values (null and NaN are missing), as pandas does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBERS = ("n", "mx", "my", "sxx", "syy", "sxy")
#: deviations below this share of the mean cannot be told from rounding: the column counts as constant
_RESOLUTION = 1e-14


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _batch_moments(x: np.ndarray) -> np.ndarray:
    """6 x columns x columns co-moments of the rows of ``x`` (NaN = missing)."""
    here = ~np.isnan(x)
    count = here.sum(axis=0)
    centre = np.where(here, x, 0.0).sum(axis=0) / np.maximum(count, 1)
    z = np.where(here, x - centre, 0.0)
    m = here.astype(float)
    n = m.T @ m
    sx = z.T @ m                                   # [i, j]: sum of column i over the rows that also have j
    some = np.maximum(n, 1.0)
    dx = sx / some
    sxx = np.maximum((z * z).T @ m - sx * dx, 0.0)
    sxy = z.T @ z - sx * dx.T                       # dx.T[i, j]: mean of column j over the same rows
    mean = centre[:, None] + dx
    return np.stack([n, mean, mean.T, sxx, sxx.T, sxy])


def _merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    dx, dy, w = b[1] - a[1], b[2] - a[2], a[0] * share
    return np.stack([n, a[1] + dx * share, a[2] + dy * share, a[3] + b[3] + w * dx * dx, a[4] + b[4] + w * dy * dy,
                     a[5] + b[5] + w * dx * dy])


def _task_moments(d: int):
    at = np.triu_indices(d, 1)

    def run(batches):
        total = None
        with np.errstate(invalid="ignore"):      # infinite values turn their column's numbers into NaN
            for batch in batches:
                if batch.num_rows:
                    cols = [np.asarray(c.to_numpy(zero_copy_only=False), dtype=float) for c in batch.columns]
                    part = _batch_moments(np.column_stack(cols))
                    total = part if total is None else _merge(total, part)
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), *[pa.array(t[at]) for t in total]],
                names=["i", "j", *_NUMBERS])

    return run


def correlation_matrix(df: DataFrame, columns: list[str] | None = None, min_rows: int = 2) -> DataFrame:
    """Rows (column_a, column_b, n, correlation), one per pair of columns in their order (default: all numeric ones).

    ``n`` counts the rows that have both values; the correlation is null with fewer than ``min_rows`` of them, where a column is
    constant on them, and where a column holds infinite values.  An empty table gives every pair with n = 0."""
    names = columns if columns is not None else numeric_columns(df)
    d = len(names)
    pairs = df.sparkSession.createDataFrame(
        [(i, j, names[i], names[j]) for i in range(d) for j in range(i + 1, d)], "i int, j int, column_a string, column_b string")
    numbers = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    parts = numbers.mapInArrow(_task_moments(d), "i int, j int, " + ", ".join(f"{c} double" for c in _NUMBERS)).filter("n > 0")
    pair = Window.partitionBy("i", "j")      # one row a task and pair; the window and the sums share one shuffle
    total = F.sum("n").over(pair)
    parts = parts.withColumn("x", F.sum(F.col("n") * F.col("mx")).over(pair) / total) \
                 .withColumn("y", F.sum(F.col("n") * F.col("my")).over(pair) / total)
    dx, dy = F.col("mx") - F.col("x"), F.col("my") - F.col("y")
    both = parts.groupBy("i", "j").agg(
        F.sum("n").alias("n"), F.sum(F.col("sxx") + F.col("n") * dx * dx).alias("sxx"),
        F.sum(F.col("syy") + F.col("n") * dy * dy).alias("syy"), F.sum(F.col("sxy") + F.col("n") * dx * dy).alias("sxy"),
        F.max(F.abs("x")).alias("x"), F.max(F.abs("y")).alias("y"))
    varies = (F.sqrt(F.col("sxx") / F.col("n")) > F.col("x") * _RESOLUTION) & (F.sqrt(F.col("syy") / F.col("n")) > F.col("y") * _RESOLUTION)
    r = F.col("sxy") / F.sqrt("sxx") / F.sqrt("syy")
    r = F.when(varies & (F.col("n") >= min_rows) & ~F.isnan(r), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    return pairs.join(both, ["i", "j"], "left").select(
        "column_a", "column_b", F.coalesce(F.col("n").cast("long"), F.lit(0)).alias("n"), r.alias("correlation"))
