"""Exact, linearly interpolated quantiles (pandas ``quantile``/``median``/``describe``)
that never hold one group or one column in a single task.

Spark's built-in ``percentile`` keeps every distinct value of a group in one
aggregation buffer; with a hot group (a third of all rows) that buffer is one
task's memory.  Here:

1. ``vc``: (keys, value) -> n, a partially aggregated count (hot values collapse);
2. slices of each column's values with about equally many rows (:mod:`tabsight.operators.slices`);
   a hot group spreads over many slices, outliers and NaN do not move the bounds;
3. per (keys, slice): totals -> prefix offsets -> the few slices that hold a wanted rank;
4. only these are read again: a running sum inside each gives every value's rank interval;
5. keep the values whose rank interval covers floor/ceil of (N-1)q and interpolate.

Helper columns have reserved names, so keys may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.operators.slices import quantile_bounds, slice_of


def quantile_rows(df: DataFrame, columns: list[str], probs: list[float], by: list[str] | None = None,
                  partitions: int | None = None) -> DataFrame:
    """Rows (__k0.. for the keys, __c column number, __q, __value); missing values ignored."""
    by = list(by or [])
    types = {f.name: f.dataType for f in df.schema.fields}
    numbers = []
    for c in columns:
        x = F.col(f"`{c}`")
        x = (x.cast("int") if isinstance(types[c], T.BooleanType) else x).cast("double")
        numbers.append(F.when(~F.isnan(x), x))
    n = 4 * (partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = [sorted(set(b)) for b in quantile_bounds(df, numbers, n)]
    entries = [F.struct(F.lit(i).alias("__c"), x.alias("__v")) for i, x in enumerate(numbers)]
    kn = [f"__k{i}" for i in range(len(by))]
    long = (df.select(*[F.col(f"`{b}`").alias(k) for b, k in zip(by, kn)], F.explode(F.array(*entries)).alias("__e"))
              .select(*kn, "__e.__c", "__e.__v").filter(F.col("__v").isNotNull()))
    group = [*kn, "__c"]
    vc = long.groupBy(*group, F.when(F.col("__v") == 0, F.lit(0.0)).otherwise(F.col("__v")).alias("__v")) \
             .agg(F.count(F.lit(1)).alias("__n"))
    pid = F.lit(0)
    for i, b in enumerate(bounds):
        pid = F.when(F.col("__c") == i, slice_of(F.col("__v"), b)).otherwise(pid)
    vc = vc.withColumn("__pid", pid)
    # slice totals and their prefix offsets per group (small: slices x groups)
    slices = vc.groupBy(*group, "__pid").agg(F.sum("__n").alias("__size"))
    slices = (slices.withColumn("__off", F.sum("__size").over(Window.partitionBy(*group).orderBy("__pid")) - F.col("__size"))
                    .withColumn("__total", F.sum("__size").over(Window.partitionBy(*group))))
    targets = F.array(*[F.lit(float(q)) for q in probs])

    def inside(start, end):
        def hit(q):
            p = (F.col("__total") - 1) * q
            return ((start <= F.floor(p)) & (F.floor(p) <= end)) | ((start <= F.ceil(p)) & (F.ceil(p) <= end))
        return hit

    wanted = slices.filter(F.exists(targets, inside(F.col("__off"), F.col("__off") + F.col("__size") - 1)))
    wanted = wanted.select(*[F.col(c).alias(f"w{c}") for c in [*group, "__pid"]], "__off", "__total")
    if not by:
        wanted = F.broadcast(wanted)      # at most two slices per probability and column
    same = [F.col(c).eqNullSafe(F.col(f"w{c}")) for c in [*group, "__pid"]]
    near = vc.join(wanted, reduce(lambda a, b: a & b, same)).drop(*[f"w{c}" for c in [*group, "__pid"]])
    w = Window.partitionBy(*group, "__pid").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (near.withColumn("__end", F.col("__off") + F.sum("__n").over(w) - 1)
                  .withColumn("__start", F.col("__end") - F.col("__n") + 1))
    cand = (ranked.filter(F.exists(targets, inside(F.col("__start"), F.col("__end"))))
                  .select(*group, "__v", "__start", "__end", "__total", F.explode(targets).alias("__q")))
    p = (F.col("__total") - 1) * F.col("__q")
    hit_lo = (F.col("__start") <= F.floor(p)) & (F.floor(p) <= F.col("__end"))
    hit_hi = (F.col("__start") <= F.ceil(p)) & (F.ceil(p) <= F.col("__end"))
    picked = (cand.filter(hit_lo | hit_hi).groupBy(*group, "__q")
                  .agg(F.max(F.when(hit_lo, F.col("__v"))).alias("__lo"), F.max(F.when(hit_hi, F.col("__v"))).alias("__hi"),
                       F.max(p - F.floor(p)).alias("__frac")))
    return picked.select(*group, "__q",
                         (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__frac")).alias("__value"))


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float], by: list[str] | None = None,
                    partitions: int | None = None) -> DataFrame:
    """Rows (by..., column, q, value) with pandas' linear interpolation; missing values ignored."""
    by = list(by or [])
    rows = quantile_rows(df, columns, probs, by, partitions)
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("__c") + 1)
    return rows.select(*[F.col(f"__k{i}").alias(b) for i, b in enumerate(by)], names.alias("column"),
                       F.col("__q").alias("q"), F.col("__value").alias("value"))
