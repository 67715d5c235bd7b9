"""Analytics of the planner vocabulary (A6-A19) as DataFrame compositions.

Every operator aggregates first (partial aggregation, one shuffle on the group
keys) and applies windows only to the aggregated result, whose size is bounded by
the number of groups (months, locations, categories), never by the row count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsight.catalog import ROW_ID
from tabsight.functions.aggregates import output_name
from tabsight.operators.grouped import grouped_aggregate, present

# Time grains accepted by resample (pandas aliases -> Spark date_trunc units).
GRAINS = {"D": "day", "day": "day", "daily": "day", "W": "week", "week": "week", "weekly": "week",
          "M": "month", "MS": "month", "month": "month", "monthly": "month",
          "Q": "quarter", "quarter": "quarter", "Y": "year", "year": "year", "H": "hour", "hour": "hour"}
STEP = {"day": "1 day", "week": "7 days", "month": "1 month", "quarter": "3 months", "year": "1 year",
        "hour": "1 hour"}


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _free(names: list[str], *wanted: str) -> None:
    """An output column must not take the name of a column that stays."""
    clash = [w for w in wanted if w.lower() in {n.lower() for n in names}]
    if clash:
        raise ValueError(f"output column '{clash[0]}' is already a column; choose another name")


def resample(df: DataFrame, time_col: str, grain: str, aggs: dict[str, list[str]], by: list[str] | None = None,
             fill_empty: bool = True, out: str = "period") -> DataFrame:
    """Totals per time bucket (``out`` = bucket start), optionally per ``by``.

    Empty buckets between the first and last bucket come back with count 0 / sum 0
    (pandas ``resample``): the bucket calendar is built from the aggregated min/max
    with ``sequence`` (size = number of buckets) and left-joined."""
    by = list(by or [])
    _free(by, out)
    unit = GRAINS[grain]
    types = {f.name: f.dataType for f in df.schema.fields}
    bucket = F.date_trunc(unit, _c(time_col).cast("timestamp_ntz")).cast("timestamp_ntz")
    specs = [(col, fn) for col, fns in aggs.items() for fn in (fns if isinstance(fns, list) else [fns])]
    rows = df.filter(_c(time_col).isNotNull()).withColumn("__bucket", bucket)
    for b in by:   # pandas drops rows whose group key is missing
        rows = rows.filter(present(b, types[b]))
    agg = grouped_aggregate(rows, [*by, "__bucket"], specs, ROW_ID if ROW_ID in df.columns else None)
    values = [c for c in agg.columns if c not in (*by, "__bucket")]
    _free(values, out)
    if not fill_empty:
        return agg.select(*[_c(b) for b in by], F.col("__bucket").alias(out), *[_c(c) for c in values])
    # each group's own calendar between its first and last bucket (pandas groupby+resample)
    bounds = agg.groupBy(*[_c(b) for b in by]).agg(F.min("__bucket").alias("__lo"), F.max("__bucket").alias("__hi"))
    calendar = bounds.select(*[_c(b) for b in by],
                             F.explode(F.sequence("__lo", "__hi", F.expr(f"INTERVAL {STEP[unit]}"))).alias("__bucket"))
    full = calendar.join(agg, [*by, "__bucket"], "left")
    zero_cols = {output_name(col, fn) for col, fn in specs if fn in ("sum", "count", "size", "nunique")}
    return full.select(*[_c(b) for b in by], F.col("__bucket").alias(out),
                       *[F.coalesce(_c(c), F.lit(0)).alias(c) if c in zero_cols else _c(c) for c in values])


def growth(df: DataFrame, period_col: str, value_col: str, by: list[str] | None = None,
           out: str = "growth_pct", previous: str = "previous") -> DataFrame:
    """Period-over-period change in percent on an aggregated series (``lag``;
    ``try_divide`` -> null when the previous value is 0 or missing)."""
    by = list(by or [])
    _free(df.columns, out, previous)
    w = Window.partitionBy(*[_c(b) for b in by]).orderBy(_c(period_col))
    return (df.withColumn(previous, F.lag(_c(value_col)).over(w))
              .withColumn(out, F.try_divide(_c(value_col) - _c(previous), _c(previous)) * 100))


def versus_average(df: DataFrame, key: str, value: str, agg: str = "sum", out: str = "vs_avg_pct") -> DataFrame:
    """Per key total and its difference to the average over keys in percent."""
    name = output_name(value, agg)
    per = grouped_aggregate(df.filter(present(key, df.schema[key].dataType)), [key], [(value, agg)],
                            ROW_ID if ROW_ID in df.columns else None)
    avg_all = per.agg(F.avg(_c(name))).scalar()   # scalar subquery: no global window, no join
    return (per.withColumn("average", avg_all)
               .withColumn(out, F.try_divide(_c(name) - F.col("average"), F.col("average")) * 100))


def ranking(df: DataFrame, value: str, by: list[str] | None = None, ascending: bool = False) -> DataFrame:
    """Rank and dense_rank (1 = best) per ``by``; missing values get no rank (pandas).

    Numbers, times and text use the distributed prefix scan (no task holds a whole group or
    the whole frame): rows per distinct value (partial aggregate), running sums over
    the value order in slices, then the ranks joined back by value."""
    from tabsight.operators.windows import running_many
    by = list(by or [])
    vt = df.schema[value].dataType
    distinct = (df.filter(present(value, vt))
                  .groupBy(*[_c(b) for b in by], _c(value).alias("__v"))
                  .agg(F.count(F.lit(1)).alias("__n")).withColumn("__one", F.lit(1)))
    up = running_many(distinct, by, ["__v"], [("__n", "cumsum", "__cum"), ("__one", "cumsum", "__dense")])
    if ascending:
        rank, dense = F.col("__cum") - F.col("__n") + 1, F.col("__dense")
    else:   # counted from the other end: the group's totals less what stands at or below the value
        total = distinct.groupBy(*[_c(b).alias(f"__t{i}") for i, b in enumerate(by)]).agg(
            F.sum("__n").alias("__all"), F.sum("__one").alias("__values"))
        if by:
            same = reduce(lambda a, b: a & b, [_c(b).eqNullSafe(F.col(f"__t{i}")) for i, b in enumerate(by)])
            up = up.join(total, same)
        else:
            s = total.select(F.struct("__all", "__values").alias("s")).scalar()
            up = up.withColumn("__all", s.getField("__all")).withColumn("__values", s.getField("__values"))
        rank, dense = F.col("__all") - F.col("__cum") + 1, F.col("__values") - F.col("__dense") + 1
    ranked = up.select(*[_c(b).alias(f"__r{i}") for i, b in enumerate(by)], F.col("__v").alias("__rv"),
                       rank.cast("int").alias("rank"), dense.cast("int").alias("dense_rank"))
    same = [_c(b).eqNullSafe(F.col(f"__r{i}")) for i, b in enumerate(by)] + [_c(value) == F.col("__rv")]
    out = df.join(ranked, reduce(lambda a, b: a & b, same), "left")
    return out.drop("__rv", *[f"__r{i}" for i in range(len(by))])


def share(df: DataFrame, key: str, out: str = "share") -> DataFrame:
    """Rows per key and their share of all rows."""
    per = df.filter(_c(key).isNotNull()).groupBy(_c(key)).agg(F.count(F.lit(1)).alias("count"))
    total = per.agg(F.sum("count")).scalar()
    return per.withColumn(out, F.col("count") / total)


def zscore_anomalies(series: DataFrame, value: str, threshold: float = 2.0) -> DataFrame:
    """Z-score of each point of an aggregated series against the whole series
    (sample std) and a flag |z| > threshold."""
    mean = series.agg(F.avg(_c(value))).scalar()
    std = series.agg(F.stddev_samp(_c(value))).scalar()
    z = (_c(value) - mean) / std
    return series.withColumn("zscore", z).withColumn("is_anomaly", F.abs(F.col("zscore")) > threshold)


def seasonal_anomalies(series: DataFrame, time_col: str, value: str, by: list[str] | None = None, season: str = "weekday",
                       threshold: float = 3.5, out: str = "robust_z") -> DataFrame:
    """Points that leave the usual range of their season (``weekday``, ``month`` or ``hour``).

    The baseline is the exact median of the season's points (per ``by``), the spread their exact median absolute deviation, both
    by the distributed quantiles; neither moves with a few outliers.  Adds ``<value>_median``, ``<value>_mad``, ``out`` =
    0.6745 * (value - median) / MAD and ``is_anomaly`` (|out| > threshold).  Where the MAD is 0 any point off the median is an anomaly
    and ``out`` is null.  Points without a time or value get nulls and no flag."""
    by = list(by or [])
    median, mad = f"{value}_median", f"{value}_mad"
    _free(series.columns, median, mad, out, "is_anomaly")
    t = _c(time_col)
    label = {"weekday": F.dayofweek, "month": F.month, "hour": F.hour}[season](t)
    x = _c(value).cast("double")
    rows = series.withColumn("__season", label).withColumn("__x", F.when(~F.isnan(x), x))
    keys = [*by, "__season"]

    def middle(df: DataFrame, column: str, name: str) -> DataFrame:
        from tabsight.operators.quantiles import quantile_rows
        q = quantile_rows(df.filter(F.col("__season").isNotNull()), [column], [0.5], keys)
        return q.select(*[F.col(f"__k{i}").alias(f"__s{i}") for i in range(len(keys))], F.col("__value").alias(name))

    def beside(df: DataFrame, stats: DataFrame) -> DataFrame:      # one row a season and group
        same = reduce(lambda a, b: a & b, [_c(k).eqNullSafe(F.col(f"__s{i}")) for i, k in enumerate(keys)])
        return df.join(stats, same, "left").drop(*[f"__s{i}" for i in range(len(keys))])

    rows = beside(rows, middle(rows, "__x", median))
    rows = rows.withColumn("__off", F.abs(F.col("__x") - _c(median)))
    rows = beside(rows, middle(rows, "__off", mad))
    score = F.when(_c(mad) > 0, F.lit(0.6745) * (F.col("__x") - _c(median)) / _c(mad))
    flag = F.when(_c(mad) > 0, F.abs(score) > threshold).otherwise(F.col("__off") > 0)
    return rows.withColumn(out, score).withColumn("is_anomaly", flag).drop("__season", "__x", "__off")


def time_patterns(df: DataFrame, time_col: str, value: str) -> DataFrame:
    """Activity by hour of day and day of week (1 = Sunday .. 7 = Saturday)."""
    ts = _c(time_col)
    return (df.groupBy(F.hour(ts).alias("hour"), F.dayofweek(ts).alias("day_of_week"))
              .agg(F.count(F.lit(1)).alias("events"), F.sum(_c(value)).alias(f"{value}_sum")))


def efficiency(df: DataFrame, key: str, value: str, time_col: str) -> DataFrame:
    """Total, average per row, active hours and value per active hour per key."""
    hours = F.count_distinct(F.date_trunc("hour", _c(time_col)))
    return (df.filter(_c(key).isNotNull()).groupBy(_c(key))
              .agg(F.sum(_c(value)).alias("total"), F.count(F.lit(1)).alias("rows"), hours.alias("active_hours"))
              .withColumn("avg_per_row", F.try_divide(F.col("total"), F.col("rows")))
              .withColumn("per_hour", F.try_divide(F.col("total"), F.col("active_hours"))))


def two_key_matrix(df: DataFrame, row_key: str, col_key: str, value: str, agg: str = "sum",
                   values: list | None = None) -> DataFrame:
    """Heatmap matrix ``groupBy(row_key).pivot(col_key)``; pass ``values`` to skip
    the extra distinct job Spark runs to find the pivot columns."""
    g = df.filter(_c(row_key).isNotNull()).groupBy(_c(row_key))
    p = g.pivot(col_key, values) if values is not None else g.pivot(col_key)
    return p.agg({"sum": F.sum, "mean": F.avg, "count": F.count, "max": F.max, "min": F.min}[agg](_c(value)))


def join_along(left: DataFrame, right: DataFrame, left_col: str, right_col: str, how: str = "inner") -> DataFrame:
    """Join two tables along a discovered key (P11 edge); the planner broadcasts a side only below
    ``spark.sql.autoBroadcastJoinThreshold`` bytes, and splits skewed partitions at run time."""
    r = right if right_col == left_col else right.withColumnRenamed(right_col, left_col)
    return left.join(r, left_col, how)


def correlation(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Pearson correlation of two columns (per group)."""
    by = list(by or [])
    return df.groupBy(*[_c(x) for x in by]).agg(F.corr(_c(a), _c(b)).alias(f"corr_{a}_{b}"))
