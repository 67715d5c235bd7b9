"""Column and table profiles (P1-P10, P13-P15, P19) as two Spark jobs per table set.

Job 1 (wide aggregate, one per table): row count, non-null count, min and max of
every column in a single scan.  Job 2 (value-count relation, all tables at once):
``vc(table, column, value, n, first_row)`` from an ``explode`` of
(column, value) pairs and one ``groupBy`` with map-side partial aggregation, so
a value that fills a third of a column is combined before the shuffle.  Distinct
counts and primary-key candidates are read off ``vc``.  Samples come from the first rows of a table's first file where
they show five values there; only the other columns are grouped once more with their first rows, and
``row_number() <= 5`` is planned as a partial ``WindowGroupLimit`` before the exchange.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.catalog import (ROW_ID, ROW_ID_TYPE, TableSet, data_columns, edge_rows, normalize_table_name,
                              ntz_from_micros, ntz_micros)

SAMPLE_SIZE = 5
#: rows at the beginning of a table in which samples are looked for first
PREFIX_ROWS = 500


def pandas_dtype(dt: T.DataType, has_nulls: Column) -> Column:
    """The dtype name pandas would show for a column read from this table."""
    ints = {T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32", T.LongType: "int64"}
    for cls, name in ints.items():
        if isinstance(dt, cls):
            return F.when(has_nulls, F.lit("float64")).otherwise(F.lit(name))
    if isinstance(dt, T.FloatType):
        return F.lit("float32")
    if isinstance(dt, T.DoubleType):
        return F.lit("float64")
    if isinstance(dt, T.BooleanType):
        return F.when(has_nulls, F.lit("object")).otherwise(F.lit("bool"))
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.lit("datetime64[us]")
    return F.lit("object")


def is_missing(c: Column, dt: T.DataType) -> Column:
    """pandas ``isnull``: null, or NaN for floating columns."""
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def value_text(c: Column, dt: T.DataType) -> Column:
    """Canonical text of a value inside one column (equality-preserving)."""
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        c = F.when(c == 0, F.lit(0.0)).otherwise(c)   # -0.0 == 0.0
    if isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    if isinstance(dt, T.BinaryType):
        return F.base64(c)
    return c.cast("string")


def _orderable(dt: T.DataType) -> bool:
    return isinstance(dt, (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType)) \
        and not isinstance(dt, T.BooleanType)


ROWS_MARK = "\u0000rows"   # pseudo column whose single value counts the rows of a table


# value kinds of the typed long form (fixed per column)
K_INT, K_DOUBLE, K_TS, K_DATE, K_TEXT, K_BOOL, K_TS_NTZ, K_DEC = 0, 1, 2, 3, 4, 5, 6, 7

#: longer texts group by a 128-bit hash and their length instead of moving whole
LONG_TEXT = 64
_HASH_MARK = "\u0000hash"


def short_key(c: Column) -> Column:
    """The text itself up to ``LONG_TEXT`` characters, else a key of fixed size."""
    key = F.concat(F.lit(_HASH_MARK), F.hex(F.xxhash64(c)), F.lit("."), F.hex(F.xxhash64(F.lit(7919), c)), F.lit("."),
                   F.length(c).cast("string"))
    return F.when(F.length(c) > LONG_TEXT, key).otherwise(c)


def decimal_key(c: Column) -> Column:
    """Text that sorts like the decimal (values of one column have one scale)."""
    digits = F.lpad(F.abs(c).cast("string"), 42, "0")
    return F.when(c < 0, F.concat(F.lit("n"), F.translate(digits, "0123456789", "9876543210"))).otherwise(
        F.concat(F.lit("p"), digits))


def decimal_text(key: Column) -> Column:
    """The decimal's own text from its sort key."""
    digits = F.substring(key, 2, 42)
    shown = F.ltrim(F.when(key.startswith("n"), F.translate(digits, "0123456789", "9876543210")).otherwise(digits), F.lit("0"))
    shown = F.when(shown.startswith(".") | (shown == ""), F.concat(F.lit("0"), shown)).otherwise(shown)
    return F.when(key.startswith("n"), F.concat(F.lit("-"), shown)).otherwise(shown)


def typed_value(c: Column, dt: T.DataType) -> tuple[int, Column, Column, Column]:
    """(kind, long, double, string) key of a value: numbers and times group as
    primitives (no string conversion per row); only text stays a string."""
    null_l, null_d, null_s = F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(None).cast("string")
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return K_INT, c.cast("long"), null_d, null_s
    if isinstance(dt, T.DecimalType):
        return K_DEC, null_l, null_d, decimal_key(c)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        x = c.cast("double")
        return K_DOUBLE, null_l, F.when(x == 0, F.lit(0.0)).otherwise(x), null_s   # -0.0 == 0.0
    if isinstance(dt, T.TimestampNTZType):
        return K_TS_NTZ, ntz_micros(c), null_d, null_s
    if isinstance(dt, T.TimestampType):
        return K_TS, F.unix_micros(c), null_d, null_s
    if isinstance(dt, T.DateType):
        return K_DATE, F.unix_date(c).cast("long"), null_d, null_s
    if isinstance(dt, T.BooleanType):
        return K_BOOL, c.cast("long"), null_d, null_s
    return K_TEXT, null_l, null_d, value_text(c, dt)


def text_of_kind(kind: int, vl: Column, vd: Column, vs: Column) -> Column:
    """:func:`typed_text` of a kind that is known."""
    return {K_INT: lambda: vl.cast("string"), K_DOUBLE: lambda: vd.cast("string"), K_TS: lambda: F.timestamp_micros(vl).cast("string"),
            K_TS_NTZ: lambda: ntz_from_micros(vl).cast("string"), K_DATE: lambda: F.date_from_unix_date(vl.cast("int")).cast("string"),
            K_DEC: lambda: decimal_text(vs), K_BOOL: lambda: F.when(vl == 1, F.lit("true")).otherwise(F.lit("false"))}.get(kind, lambda: vs)()


def typed_text(kind: Column, vl: Column, vd: Column, vs: Column) -> Column:
    """Text of a typed value, equal to ``CAST(value AS STRING)`` of the original column."""
    return (F.when(kind == K_INT, vl.cast("string"))
             .when(kind == K_DOUBLE, vd.cast("string"))
             .when(kind == K_TS, F.timestamp_micros(vl).cast("string"))
             .when(kind == K_TS_NTZ, ntz_from_micros(vl).cast("string"))
             .when(kind == K_DATE, F.date_from_unix_date(vl.cast("int")).cast("string"))
             .when(kind == K_DEC, decimal_text(vs))
             .when(kind == K_BOOL, F.when(vl == 1, F.lit("true")).otherwise(F.lit("false")))
             .otherwise(vs))


ROWS_BASE = 1 << 30   # column id of a table's row-count pseudo column: ROWS_BASE + table index


def column_ids(tables: TableSet, names: list[str]) -> list[tuple[int, str, str, int, T.DataType | None]]:
    """Driver-side catalogue (cid, table, column, ordinal, type); row marks have type None."""
    out = []
    for ti, t in enumerate(names):
        for i, f in enumerate(tables.plain(t).schema.fields):
            out.append((len(out), t, f.name, i, f.dataType))
        out.append((ROWS_BASE + ti, t, ROWS_MARK, -1, None))
    return out


def value_counts(tables: TableSet, names: list[str] | None = None, with_first_row: bool = True,
                 only: set[int] | None = None) -> DataFrame | None:
    """vc(cid, vl, vd, vs, n, first_row) over all given tables in one shuffle; ``only``: these column ids (None if empty).

    ``cid`` is an integer column id (see :func:`column_ids`); values are typed
    primitives, so keys are narrow and every buffer is fixed-width: the aggregation
    stays hash-based with map-side combining (a value filling a third of a column
    collapses before the shuffle).  Missing values are dropped; each table adds one
    pseudo column whose only value counts its rows, so the profile needs no other scan."""
    names = names or list(tables)
    cat = column_ids(tables, names)
    parts = []
    for ti, name in enumerate(names):
        if only is not None and not any(t == name and cid in only for cid, t, *_ in cat):
            continue
        df = tables[name] if with_first_row else tables.plain(name)
        has_order = with_first_row and ROW_ID in df.columns
        pairs = [F.struct(F.lit(ROWS_BASE + ti).alias("cid"), F.lit(0).cast("long").alias("vl"),
                          F.lit(None).cast("double").alias("vd"), F.lit(None).cast("string").alias("vs"))] if only is None else []
        for cid, t, col, _, dt in cat:
            if t != name or dt is None or (only is not None and cid not in only):
                continue
            c = F.col(f"`{col}`")
            kind, vl, vd, vs = typed_value(c, dt)
            if kind == K_TEXT and (has_order or not with_first_row):
                vs = short_key(vs)    # the few sample texts are fetched by row id
            pairs.append(F.struct(F.when(~is_missing(c, dt), F.lit(cid)).alias("cid"),
                                  vl.alias("vl"), vd.alias("vd"), vs.alias("vs")))
        row_id = F.col(ROW_ID) if has_order else F.lit(None).cast(ROW_ID_TYPE)
        long = df.select(F.explode(F.array(*pairs)).alias("p"), row_id.alias("row_id")).select("p.*", "row_id")
        parts.append(long.filter(F.col("cid").isNotNull()))
    if not parts:
        return None
    long = reduce(lambda a, b: a.unionByName(b), parts)
    return long.groupBy("cid", "vl", "vd", "vs").agg(F.count(F.lit(1)).alias("n"),
                                                     F.min("row_id").alias("first_row"))


def catalogue_frame(tables: TableSet, names: list[str]) -> DataFrame:
    """The column catalogue as a small DataFrame (schema-sized)."""
    spark = tables.spark
    rows = [(cid, t, c, i, typed_value(F.col("x"), dt)[0] if dt is not None else K_INT,
             _type_class(dt) if dt is not None else "rows", _orderable(dt) if dt is not None else False)
            for cid, t, c, i, dt in column_ids(tables, names)]
    return spark.createDataFrame(rows, "cid int, table_name string, column_name string, ordinal int, kind int, "
                                       "type_class string, orderable boolean")


def prefix_samples(tables: TableSet, names: list[str], k: int = SAMPLE_SIZE, rows: int = PREFIX_ROWS) -> dict[int, list[str]]:
    """P8 from the first rows of file scans: column id -> its first ``k`` distinct values, for columns that show ``k`` of them
    there, and for all columns of a table that ends there.  One small job reads the beginning of each table's first file;
    its row numbers are checked, so a column is listed only if these are the table's first rows."""
    cat, parts = column_ids(tables, names), []
    for ti, name in enumerate(names):
        scan = tables.scan(name)
        if scan is None or not scan.columns:
            continue
        files = sorted({re.sub("^file:/+", "file:/", f) for f in scan.inputFiles()})
        if not files:
            continue
        at = F.col("_metadata.row_index")
        cells = []
        for cid, t, c, _, dt in cat:
            if t == name and dt is not None:
                kind, vl, vd, vs = typed_value(F.col(f"`{c}`"), dt)
                text = text_of_kind(kind, vl, vd, vs)
                cells.append((cid, F.when(~is_missing(F.col(f"`{c}`"), dt), text)))
        head = scan.select(at.alias("__at"), F.col("_metadata.file_path").alias("__file"), *[x.alias(f"v{cid}") for cid, x in cells])
        # one more row tells whether the table ends here
        head = (head.filter(F.col("__file") == files[0]) if len(files) > 1 else head).limit(rows + 1)
        # rows of one task in scan order; their numbers are checked below
        seen = [F.slice(F.array_distinct(F.collect_list(f"v{cid}")), 1, k) for cid, _ in cells]
        steps = F.count(F.when(F.col("__at") == F.col("__want"), 1))
        head = head.withColumn("__want", F.monotonically_increasing_id())
        parts.append(head.agg(F.count(F.lit(1)).alias("n"), steps.alias("in_order"), F.array(*seen).alias("seen")).select(
            F.lit(ti).alias("ti"), "n", "in_order", F.lit(len(files)).alias("files"), "seen"))
    done = {}
    for r in reduce(DataFrame.unionByName, parts).collect() if parts else []:      # k values a column
        if r["n"] == 0 or r["in_order"] != r["n"]:
            continue                                                                # not the first rows in order, or none
        whole = r["files"] == 1 and r["n"] <= rows
        cids = [cid for cid, t, _, _, dt in cat if t == names[r["ti"]] and dt is not None]
        done.update({cid: vals for cid, vals in zip(cids, r["seen"]) if whole or len(vals) == k})
    return done


def first_samples(vc: DataFrame, cat: DataFrame, tables: TableSet, names: list[str], k: int = SAMPLE_SIZE,
                  only: set[int] | None = None) -> DataFrame:
    """First ``k`` distinct non-null values per column, in order of first appearance;
    ``row_number() <= k`` is planned as a partial WindowGroupLimit before the shuffle.  Sample texts that were
    grouped by hash are read from their rows (at most ``k`` per column, matched by row id)."""
    w = Window.partitionBy("cid").orderBy("first_row", "vl", "vd", "vs")
    # filter the row-count marks only after the window: a filter on vc itself would be
    # pushed below the aggregation and stop the two consumers sharing one exchange
    top = vc.withColumn("rk", F.row_number().over(w)).filter((F.col("rk") <= k) & (F.col("cid") < ROWS_BASE))
    top = top.join(F.broadcast(cat.select("cid", "kind")), "cid")   # schema-sized side
    # the rows that hold hashed samples: at most k per column, one broadcast for all tables
    keys = top.filter(F.col("vs").startswith(_HASH_MARK)).select(F.col("first_row").alias("kat")).distinct()
    parts = []
    for t in names:
        cols = [(cid, c, dt) for cid, table, c, _, dt in column_ids(tables, names) if table == t and dt is not None
                and (only is None or cid in only) and typed_value(F.col("x"), dt)[0] == K_TEXT]
        if not cols or ROW_ID not in tables[t].columns:
            continue
        near = tables[t].join(F.broadcast(keys), F.col(ROW_ID) == F.col("kat"), "left_semi")
        cells = F.explode(F.array(*[F.struct(F.lit(cid).alias("tcid"), value_text(F.col(f"`{c}`"), dt).alias("whole"))
                                    for cid, c, dt in cols])).alias("e")
        parts.append(near.select(F.col(ROW_ID).alias("__at"), cells).select("__at", "e.tcid", "e.whole"))
    if parts:
        whole = reduce(lambda a, b: a.unionByName(b), parts)
        top = top.join(F.broadcast(whole), (F.col("cid") == F.col("tcid")) & (F.col("first_row") == F.col("__at"))
                       & F.col("vs").startswith(_HASH_MARK), "left")
        top = top.withColumn("vs", F.coalesce("whole", "vs"))
    text = typed_text(F.col("kind"), F.col("vl"), F.col("vd"), F.col("vs"))
    return (top.groupBy("cid")
               .agg(F.array_sort(F.collect_list(F.struct(F.col("rk"), text.alias("value")))).alias("s"))
               .select("cid", F.col("s.value").alias("sample_values")))


def _type_class(dt: T.DataType) -> str:
    if isinstance(dt, T.ByteType):
        return "int8"
    if isinstance(dt, T.ShortType):
        return "int16"
    if isinstance(dt, T.IntegerType):
        return "int32"
    if isinstance(dt, T.LongType):
        return "int64"
    if isinstance(dt, T.FloatType):
        return "float32"
    if isinstance(dt, (T.DoubleType, T.DecimalType)):
        return "float64"
    if isinstance(dt, T.BooleanType):
        return "bool"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "object"


def _logical_type_expr(tc: Column, has_nulls: Column) -> Column:
    return (F.when(tc.startswith("int"), F.when(has_nulls, F.lit("float")).otherwise(F.lit("int")))
             .when(tc.startswith("float"), F.lit("float"))
             .when(tc == "datetime", F.lit("datetime"))
             .otherwise(F.lit("string")))


def _dtype_expr(tc: Column, has_nulls: Column) -> Column:
    return (F.when(tc.startswith("int"), F.when(has_nulls, F.lit("float64")).otherwise(tc))
             .when(tc == "bool", F.when(has_nulls, F.lit("object")).otherwise(F.lit("bool")))
             .when(tc == "datetime", F.lit("datetime64[us]"))
             .otherwise(tc))


def profile_columns(tables: TableSet, names: list[str] | None = None, samples: bool = True, approx: bool = False) -> DataFrame:
    """P1-P8, P10 per column: file_name, table_name, column_name, ordinal, data_type, dtype,
    nullable, null_count, unique_count, distinct_value_ratio, min_value, max_value,
    sample_values, is_pk_candidate, row_count.  One shuffle of the data; with ``samples`` a second, narrow one of the columns that show
    fewer than five values in the first rows of their file (few values: combined before the shuffle).

    ``approx``: distinct counts from sketches, without the value shuffle (:func:`tabsight.operators.sketches.approximate_profile`:
    quantiles in place of samples, and key candidates only ruled out, never confirmed)."""
    if approx:
        from tabsight.operators.sketches import approximate_profile
        return approximate_profile(tables, names)
    names = names or list(tables)
    done = prefix_samples(tables, names) if samples else {}
    rest = {cid for cid, *_, dt in column_ids(tables, names) if dt is not None} - set(done)
    # a table set without any scan: one relation serves both
    alone = samples and not done
    vc = value_counts(tables, names, with_first_row=alone)
    cat = catalogue_frame(tables, names)
    decimals = any(isinstance(dt, T.DecimalType) for *_, dt in column_ids(tables, names))
    per_col = vc.groupBy("cid").agg(
        F.count(F.lit(1)).alias("unique_count"), F.sum("n").alias("non_null"), F.max("n").alias("max_n"),
        F.min("vl").alias("lo_l"), F.max("vl").alias("hi_l"), F.min("vd").alias("lo_d"), F.max("vd").alias("hi_d"),
        *([F.min("vs").alias("lo_s"), F.max("vs").alias("hi_s")] if decimals else []))
    lo_s, hi_s = (F.col(c) if decimals else F.lit(None).cast("string") for c in ("lo_s", "hi_s"))
    # one row per column and table mark; the catalogue is schema-sized (bounded broadcast).
    # Row counts travel by a window over this small relation (a filter on it would be
    # pushed into the value-count job and run it twice).
    per_table = Window.partitionBy("table_name")
    out = (cat.join(per_col, "cid", "left")
              .withColumn("row_count", F.max(F.when(F.col("cid") >= ROWS_BASE, F.col("non_null"))).over(per_table))
              .withColumn("min_value", typed_text(F.col("kind"), F.col("lo_l"), F.col("lo_d"), lo_s))
              .withColumn("max_value", typed_text(F.col("kind"), F.col("hi_l"), F.col("hi_d"), hi_s)))
    out = out.filter(F.col("cid") < ROWS_BASE)
    if samples:
        found = tables.spark.createDataFrame(list(done.items()), "cid int, sample_values array<string>")
        later = vc if alone else value_counts(tables, names, only=rest)
        if later is not None:
            found = found.unionByName(first_samples(later, cat, tables, names, only=rest))
        out = out.join(found, "cid", "left")
    else:
        out = out.withColumn("sample_values", F.lit(None).cast("array<string>"))
    rc = F.coalesce(F.col("row_count"), F.lit(0))
    uc = F.coalesce(F.col("unique_count"), F.lit(0))
    nulls = rc - F.coalesce(F.col("non_null"), F.lit(0))
    return out.orderBy("cid").select(      # one row a column: in schema order
        F.col("table_name").alias("file_name"),
        logical_name_col(F.col("table_name")).alias("table_name"),
        "column_name", "ordinal",
        _logical_type_expr(F.col("type_class"), nulls > 0).alias("data_type"),
        _dtype_expr(F.col("type_class"), nulls > 0).alias("dtype"),
        (nulls > 0).alias("nullable"), nulls.alias("null_count"),
        uc.alias("unique_count"),
        F.when(rc > 0, uc / rc).otherwise(F.lit(0.0)).alias("distinct_value_ratio"),
        F.when(F.col("orderable"), F.col("min_value")).alias("min_value"),
        F.when(F.col("orderable"), F.col("max_value")).alias("max_value"),
        F.coalesce(F.col("sample_values"), F.array().cast("array<string>")).alias("sample_values"),
        # P10: unique and no missing value (every column qualifies on an empty table)
        ((nulls == 0) & (F.coalesce(F.col("max_n"), F.lit(1)) <= 1)).alias("is_pk_candidate"),
        rc.alias("row_count"))


def logical_name_col(c: Column) -> Column:
    from tabsight.functions.names import logical_table_name
    return logical_table_name(c)


def row_counts(tables: TableSet, names: list[str] | None = None) -> DataFrame:
    """(table_name, row_count) of many tables as one job: a union of table tags and one
    ``groupBy`` (partial counts per task), instead of one aggregation job per table."""
    names = names or list(tables)
    tags = reduce(lambda a, b: a.unionByName(b),
                  [tables.plain(n).select(F.lit(n).alias("table_name")) for n in names])
    counts = tags.groupBy("table_name").agg(F.count(F.lit(1)).alias("row_count"))
    spark = tables.spark
    every = spark.createDataFrame([(n,) for n in names], "table_name string")
    return every.join(counts, "table_name", "left").select(
        "table_name", F.coalesce("row_count", F.lit(0)).alias("row_count"))


def profile_tables(tables: TableSet, names: list[str] | None = None) -> DataFrame:
    """table_name, file_name, row_count, column_count, columns."""
    names = names or list(tables)
    spark = tables.spark
    meta = spark.createDataFrame(
        [(n, normalize_table_name(n), len(tables.plain(n).columns), tables.plain(n).columns) for n in names],
        "file_name string, table_name string, column_count int, columns array<string>")
    counts = row_counts(tables, names).withColumnRenamed("table_name", "file_name")
    return meta.join(counts, "file_name").select("table_name", "file_name", "row_count", "column_count", "columns")


def head_tail(df: DataFrame, n_head: int = 5, n_tail: int = 5, scan: DataFrame | None = None) -> DataFrame:
    """First and last rows in file order, tagged ``part`` = head/tail with ``pos``.

    With ``scan`` (the table as a plain file scan) only the files that hold these rows are read; otherwise both
    sides are top-k queries (``TakeOrderedAndProject``), never a full sort."""
    if scan is not None:
        df = edge_rows(scan, n_head, n_tail)
    if ROW_ID not in df.columns:
        raise ValueError("head/tail needs a table read with file order (_row_id)")
    cols = data_columns(df)
    head = (df.orderBy(F.col(ROW_ID).asc()).limit(n_head)
              .withColumn("part", F.lit("head")))
    tail = (df.orderBy(F.col(ROW_ID).desc()).limit(n_tail)
              .withColumn("part", F.lit("tail")))
    both = head.unionByName(tail)
    w = Window.partitionBy("part").orderBy(F.col(ROW_ID))
    return both.withColumn("pos", F.row_number().over(w) - 1).select("part", "pos", *[F.col(f"`{c}`") for c in cols])
