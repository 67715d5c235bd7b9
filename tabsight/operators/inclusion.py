"""Foreign-key candidates (P11) and joinable columns.

P11 is a unary inclusion-dependency search in the style of SINDY (Kruse,
Papenbrock, Naumann, 2015): for every value, the set S(v) of columns holding it;
column A is included in B iff B is in S(v) for every value v of A.  Here the
attribute sets are bit masks (one ``long`` per 64 columns), so the whole search
is partially-aggregated ``groupBy``s and no pair list is ever emitted:

1. ``groupBy(value) -> bit_or(1 << column_id)``: the set of columns holding the value.  One hash
   aggregate with fixed-width buffers and map-side combining (a value filling a third of all rows
   collapses before the shuffle), the only shuffle of the data;
2. ``groupBy(set) -> count``: few different sets are left, whatever the data;
3. each set is expanded into its columns: ``groupBy(A) -> sum, bit_and(mask)`` gives the
   distinct count of A and the columns that hold every value of A.

The reference keeps pairs with
A and B in different tables and ``n(A) < n(B)`` (proper subset); the value
domains follow Python set equality: ints, floats and bools compare as numbers
(1 == 1.0 == True), strings only with strings, datetimes with datetimes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.catalog import TableSet, ntz_micros
from tabsight.operators.profile import is_missing, pandas_dtype, short_key

WORD = 64


def domain_value(c, dt: T.DataType):
    """(domain, long, double, string) key so that equal Python values get equal keys
    (1 == 1.0 == True as numbers; integral doubles are keyed as longs), or None for
    unhashable types.  Primitive keys: no string conversion per row."""
    nl, nd, ns = F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(None).cast("string")
    if isinstance(dt, T.BooleanType):
        return F.lit("num"), c.cast("long"), nd, ns
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.lit("num"), c.cast("long"), nd, ns
    if isinstance(dt, T.DecimalType):
        # a value that a double holds exactly compares with other numbers, any other only with decimals
        x = c.cast("double")
        exact = x.cast(dt) == c
        integral = exact & (c == F.floor(c)) & (F.abs(x) < F.lit(9.0e18))
        return (F.lit("num"), F.when(integral, x.cast("long")), F.when(exact & ~integral, x),
                F.when(~exact, F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1")))
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        x = c.cast("double")
        integral = (x == F.floor(x)) & (F.abs(x) < F.lit(9.0e18))
        return (F.lit("num"), F.when(integral, x.cast("long")),
                F.when(~integral, x), ns)
    if isinstance(dt, T.StringType):
        return F.lit("str"), nl, nd, short_key(c)
    if isinstance(dt, T.TimestampNTZType):
        return F.lit("ts"), ntz_micros(c), nd, ns
    if isinstance(dt, T.TimestampType):
        # an instant compares with naive values by its wall clock in the session zone
        return F.lit("ts"), ntz_micros(c.cast("timestamp_ntz")), nd, ns
    if isinstance(dt, T.DateType):
        return F.lit("date"), F.unix_date(c).cast("long"), nd, ns
    return None   # arrays, maps, structs, binary: unhashable for the reference


def column_catalog(tables: TableSet, names: list[str] | None = None) -> list[tuple[int, str, str, T.DataType]]:
    """Driver-side schema list (id, table, column, type) of the hashable columns."""
    out = []
    for t in names or list(tables):
        for f in tables.plain(t).schema.fields:
            if domain_value(F.col("x"), f.dataType) is None:
                continue
            out.append((len(out), t, f.name, f.dataType))
    return out


VALUE_KEYS = ("domain", "vl", "vd", "vs")


def _long_values(tables: TableSet, cat) -> DataFrame:
    """Long form (cid, domain, vl, vd, vs) over every hashable column, missing values dropped."""
    parts = []
    by_table: dict[str, list] = {}
    for cid, t, c, dt in cat:
        by_table.setdefault(t, []).append((cid, c, dt))
    for t, cols in by_table.items():
        entries = []
        for cid, c, dt in cols:
            col = F.col(f"`{c}`")
            dom, vl, vd, vs = domain_value(col, dt)
            entries.append(F.struct(F.lit(cid).alias("cid"), F.when(~is_missing(col, dt), dom).alias("domain"),
                                    vl.alias("vl"), vd.alias("vd"), vs.alias("vs")))
        parts.append(tables.plain(t).select(F.explode(F.array(*entries)).alias("e")).select("e.*"))
    return reduce(lambda a, b: a.unionByName(b), parts).filter(F.col("domain").isNotNull())


def contained_pairs(long: DataFrame, keys: tuple[str, ...], n_columns: int) -> DataFrame:
    """(a, b, n_a, n_b): every value of column number ``a`` is one of ``b`` (a differs from b), with their distinct counts.

    ``long`` has (cid, keys...), one row per value and column; its shuffle by value is the only one of the data."""
    n_words = max(1, (n_columns + WORD - 1) // WORD)
    words = [f"m{w}" for w in range(n_words)]
    # 1. per value: the set of columns holding it, as bit masks
    masks = [F.bit_or(F.when(F.floor(F.col("cid") / WORD) == w, F.expr(f"shiftleft(1L, cid % {WORD})"))
                      .otherwise(F.lit(0).cast("long"))).alias(f"m{w}") for w in range(n_words)]
    per_value = long.groupBy(*keys).agg(*masks)
    # 2. values with the same set of columns count together; the few different sets are expanded into their columns
    sets = per_value.groupBy(*words).agg(F.count(F.lit(1)).alias("n"))
    members = F.explode(F.array(*[F.when(F.getbit(F.col(f"m{cid // WORD}"), F.lit(cid % WORD)) == 1, F.lit(cid))
                                  for cid in range(n_columns)])).alias("a")
    per_col = (sets.select(members, "n", *words).filter(F.col("a").isNotNull())
               .groupBy("a").agg(F.sum("n").alias("n_a"), *[F.bit_and(w).alias(w) for w in words]))
    # 3. decode the surviving bits into (a, b); n_b comes from the same relation
    bit_ids = F.explode(F.sequence(F.lit(0), F.lit(n_words * WORD - 1))).alias("b")
    cand = per_col.select("a", "n_a", *words, bit_ids)
    word_of_b = F.floor(F.col("b") / WORD)
    chosen = reduce(lambda acc, w: acc.when(word_of_b == w, F.col(f"m{w}")), range(1, n_words),
                    F.when(word_of_b == 0, F.col("m0")))
    cand = (cand.withColumn("word", chosen)
                .filter((F.expr(f"shiftright(word, b % {WORD}) & 1") == 1) & (F.col("b") != F.col("a"))))
    sizes = per_col.select(F.col("a").alias("b"), F.col("n_a").alias("n_b"))
    return cand.select("a", "b", "n_a").join(sizes, "b").select("a", "b", "n_a", "n_b")


def inclusion_dependencies(tables: TableSet, names: list[str] | None = None, proper: bool = True) -> DataFrame:
    """(dep_table, dep_column, ref_table, ref_column, dep_distinct, ref_distinct); ``proper=False`` also lists
    columns with equal sets of values."""
    spark = tables.spark
    cat = column_catalog(tables, names)
    schema = spark.createDataFrame([(cid, t, c) for cid, t, c, _ in cat],
                                   "cid int, table_name string, column_name string")
    pairs = contained_pairs(_long_values(tables, cat), VALUE_KEYS, len(cat))
    if proper:
        pairs = pairs.filter(F.col("n_a") < F.col("n_b"))
    # the column catalogue has one row per column (schema-sized): a bounded broadcast
    A = schema.select(F.col("cid").alias("a"), F.col("table_name").alias("dep_table"),
                      F.col("column_name").alias("dep_column"))
    B = schema.select(F.col("cid").alias("b"), F.col("table_name").alias("ref_table"),
                      F.col("column_name").alias("ref_column"))
    return (pairs.join(F.broadcast(A), "a").join(F.broadcast(B), "b")
                 .filter(F.col("dep_table") != F.col("ref_table"))
                 .select("dep_table", "dep_column", "ref_table", "ref_column",
                         F.col("n_a").alias("dep_distinct"), F.col("n_b").alias("ref_distinct")))


def joinable_columns(tables: TableSet, names: list[str] | None = None) -> DataFrame:
    """Same column name and same pandas dtype in two tables, each pair once (t1 < t2).

    The dtype depends on the data (an int column with a null reads as float64), so
    the null test is one aggregate per table."""
    parts = []
    for t in names or list(tables):
        df = tables.plain(t)
        fields = df.schema.fields
        if not fields:
            continue
        aggs = [F.max(is_missing(F.col(f"`{f.name}`"), f.dataType).cast("int")).alias(f"__n{i}")
                for i, f in enumerate(fields)]
        wide = df.agg(*aggs)
        entries = [F.struct(F.lit(t).alias("table_name"), F.lit(f.name).alias("column_name"),
                            pandas_dtype(f.dataType, F.coalesce(F.col(f"__n{i}"), F.lit(0)) == 1).alias("dtype"))
                   for i, f in enumerate(fields)]
        parts.append(wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*"))
    cols = reduce(lambda a, b: a.unionByName(b), parts)
    l, r = cols.alias("l"), cols.alias("r")
    return (l.join(r, (F.col("l.column_name") == F.col("r.column_name"))
                   & (F.col("l.dtype") == F.col("r.dtype"))
                   & (F.col("l.table_name") < F.col("r.table_name")))
             .select(F.concat_ws(".", "l.table_name", "l.column_name").alias("left_column"),
                     F.concat_ws(".", "r.table_name", "r.column_name").alias("right_column"),
                     F.col("l.dtype").alias("dtype")))
