"""Running and rolling window aggregates that stay parallel inside a hot key.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task; with one
key holding a third of the data that task is the job.  Here a running aggregate
is a distributed prefix scan (A3, A15):

1. slices of the order column with about equally many rows (:mod:`tabsight.operators.slices`), so a
   hot key spans many slices;
2. slice totals per (key, slice) -> a small table -> prefix offsets per key;
3. the running aggregate inside each (key, slice) window, plus the slice's offset.

Rolling aggregates over the last ``n`` rows (A5) number the rows of each key by such a scan, cut
them into blocks of consecutive positions and copy the last ``n - 1`` rows of a block into the next
one: every window is computed from its own rows, never as a difference of prefixes.

Null keys form a group of their own; missing values (null or NaN) are skipped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsight.catalog import ROW_ID
from tabsight.functions.aggregates import nan_as_null
from tabsight.operators.slices import order_slices

# Running aggregates of the planner vocabulary (pandas names).
CUMULATIVE = ("cumsum", "cummax", "cummin", "cumprod", "cumcount")

#: rows of a key that one rolling block holds
BLOCK_ROWS = 1 << 16


def _slice_agg(op: str, x: Column) -> Column:
    return {"cumsum": F.sum(x), "cumcount": F.count(x), "cummax": F.max(x), "cummin": F.min(x),
            "cumprod": F.product(x)}[op]


def _combine(op: str, offset: Column, running: Column) -> Column:
    if op in ("cumsum", "cumcount"):
        return F.coalesce(offset, F.lit(0)) + running
    if op == "cummax":
        return F.greatest(offset, running)
    if op == "cummin":
        return F.least(offset, running)
    return F.coalesce(offset, F.lit(1.0)) * running


def _offset_agg(op: str, c: Column) -> Column:
    """Aggregate of the previous slices' totals."""
    return {"cumsum": F.sum(c), "cumcount": F.sum(c), "cummax": F.max(c), "cummin": F.min(c),
            "cumprod": F.product(c)}[op]


def running_many(df: DataFrame, by: list[str], order: list[str], specs: list[tuple[str, str, str]],
                 partitions: int | None = None) -> DataFrame:
    """Several running aggregates ``(value, op, out)`` in one prefix scan.

    pandas semantics: missing values stay missing in the output and are skipped in
    the running value (``skipna``); ties in ``order`` follow file order."""
    for _, op, _ in specs:
        if op not in CUMULATIVE:
            raise ValueError(f"unknown running aggregate '{op}'")
    spark = df.sparkSession
    types = {f.name: f.dataType for f in df.schema.fields}
    n = 4 * (partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))
    tie = [ROW_ID] if ROW_ID in df.columns else []
    keys = [F.col(f"`{c}`") for c in by]
    ordc = [F.col(f"`{c}`") for c in order] + [F.col(t) for t in tie]
    vals = [nan_as_null(F.col(f"`{v}`"), types[v]) for v, _, _ in specs]
    sliced = df.withColumn("__pid", order_slices(df, order, n))
    tots = [_slice_agg(op, x).alias(f"__tot{i}") for i, (x, (_, op, _)) in enumerate(zip(vals, specs))]
    own = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
    slices = sliced.groupBy(*own, F.col("__pid").alias("__spid")).agg(*tots)      # partial aggregation, small output
    names = [f"__k{i}" for i in range(len(by))]
    prev = Window.partitionBy(*names).orderBy("__spid").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(*names, "__spid", *[
        _offset_agg(op, F.col(f"__tot{i}")).over(prev).alias(f"__off{i}") for i, (_, op, _) in enumerate(specs)])
    inside = Window.partitionBy(*keys, "__pid").orderBy(*ordc).rowsBetween(Window.unboundedPreceding, 0)
    res = sliced.select("*", *[_slice_agg(op, x).over(inside).alias(f"__run{i}")
                               for i, (x, (_, op, _)) in enumerate(zip(vals, specs))])
    same = [k.eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)] + [F.col("__pid") == F.col("__spid")]
    res = res.join(slices, reduce(lambda a, b: a & b, same), "left")
    outs = {}
    for i, (x, (_, op, out)) in enumerate(zip(vals, specs)):
        val = _combine(op, F.col(f"__off{i}"), F.col(f"__run{i}"))
        outs[out] = val if op == "cumcount" else F.when(x.isNotNull(), val)
    return res.select(*[F.col(f"`{c}`") for c in df.columns if c not in outs], *[v.alias(o) for o, v in outs.items()])


def running(df: DataFrame, by: list[str], order: list[str], value: str, op: str = "cumsum",
            out: str | None = None, partitions: int | None = None) -> DataFrame:
    """A3: adds ``out`` = running ``op`` of ``value`` per ``by`` in ``order``."""
    return running_many(df, by, order, [(value, op, out or f"{value}_{op}")], partitions)


def rolling_many(df: DataFrame, by: list[str], order: list[str], value: str, n: int, outs: dict[str, str],
                 partitions: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A5: rolling aggregates ``{out: op}`` (sum / mean / count) over the last ``n`` rows per key;
    null until the window holds ``n`` non-missing values (pandas ``min_periods=n``)."""
    for op in outs.values():
        if op not in ("sum", "mean", "count"):
            raise ValueError("rolling supports sum, mean and count")
    size = max(n, block_rows)
    keys = [F.col(f"`{c}`") for c in by]
    numbered = running_many(df.withColumn("__one", F.lit(1)), by, order, [("__one", "cumcount", "__seq")], partitions)
    pos = F.col("__seq") - 1
    block = F.floor(pos / size)
    spread = numbered.withColumn("__own", block).withColumn("__block", F.explode(
        F.when(pos % size >= size - (n - 1), F.array(block, block + 1)).otherwise(F.array(block))))
    w = Window.partitionBy(*keys, "__block").orderBy("__seq").rowsBetween(-(n - 1), 0)
    x = nan_as_null(F.col(f"`{value}`"), df.schema[value].dataType).cast("double")
    aggs = {"sum": F.sum, "mean": F.avg, "count": lambda c: F.count(c).cast("double")}
    out = spread.select("*", F.count(x).over(w).alias("__n"),
                        *[aggs[op](x).over(w).alias(f"__w{i}") for i, op in enumerate(outs.values())])
    out = out.filter(F.col("__block") == F.col("__own"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in outs],
                      *[F.when(F.col("__n") == n, F.col(f"__w{i}")).alias(o) for i, o in enumerate(outs)])


def rolling(df: DataFrame, by: list[str], order: list[str], value: str, n: int, op: str = "mean",
            out: str | None = None, partitions: int | None = None) -> DataFrame:
    """A5 for one rolling aggregate."""
    return rolling_many(df, by, order, value, n, {out or f"{value}_rolling_{op}": op}, partitions)


def top_k_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """``nlargest``/``nsmallest`` per group.  ``row_number() <= k`` is planned with a
    partial ``WindowGroupLimit`` before the shuffle, so at most k rows per group and
    task cross the network, even for a hot group."""
    w = Window.partitionBy(*[F.col(f"`{c}`") for c in by]).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)
