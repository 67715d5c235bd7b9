"""Checks for the profiler."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsight.catalog import DRIVER_TABLES, TableSet
from tabsight.operators.inclusion import inclusion_dependencies, joinable_columns
from tabsight.operators.profile import head_tail, profile_columns, profile_tables
from tabsight.suite.base import files_for, register, rounded, tables

# Schema of the driver tables (name, type) as documented in FIXTURES.md.
DRIVER_SCHEMA = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "int"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp"), ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                 ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                 ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "timestamp")],
    "events": [("event_id", "bigint"), ("ts", "timestamp"), ("user_id", "bigint"), ("event_type", "string"),
               ("value", "double"), ("props", "string")],
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
                  ("n_chars", "bigint")],
    "embeddings": [("vec_id", "bigint"), ("embedding", "array"), ("label", "int")],
    "pages": [("page_id", "bigint"), ("url", "string"), ("html", "string")],
    "benchmark": [("item_id", "bigint"), ("text", "string")],
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
    "conversations": [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string")],
}

# Tables whose file order equals key order (checked on the driver data); the SQL side
# orders by the key where the Spark side uses the real file position.
KEY_ORDERED = {"region": "r_regionkey", "nation": "n_nationkey", "supplier": "s_suppkey",
               "customer": "c_custkey", "part": "p_partkey", "orders": "o_orderkey",
               "lineitem": "rowid", "events": "event_id", "labels": "doc_id", "documents": "doc_id", "pages": "page_id",
               "embeddings": "vec_id", "benchmark": "item_id", "conversations": "conv_id * 1000 + turn"}

_INT_DTYPE = {"int": "int32", "bigint": "int64"}


def _dtype_sql(c: str, typ: str) -> str:
    if typ in _INT_DTYPE:
        return f"CASE WHEN COUNT(*) > COUNT({c}) THEN 'float64' ELSE '{_INT_DTYPE[typ]}' END"
    return {"double": "'float64'", "timestamp": "'datetime64[us]'"}.get(typ, "'object'")


def _ltype_sql(c: str, typ: str) -> str:
    if typ in _INT_DTYPE:
        return f"CASE WHEN COUNT(*) > COUNT({c}) THEN 'float' ELSE 'int' END"
    return {"double": "'float'", "timestamp": "'datetime'"}.get(typ, "'string'")


def _column_profile_sql() -> str:
    parts = []
    for t, cols in DRIVER_SCHEMA.items():
        for i, (c, typ) in enumerate(cols):
            orderable = typ in ("int", "bigint", "double", "timestamp")
            lo = f"CAST(MIN({c}) AS VARCHAR)" if orderable else "CAST(NULL AS VARCHAR)"
            hi = f"CAST(MAX({c}) AS VARCHAR)" if orderable else "CAST(NULL AS VARCHAR)"
            parts.append(
                f"SELECT '{t}' AS table_name, '{c}' AS column_name, {i} AS ordinal, "
                f"{_ltype_sql(c, typ)} AS data_type, {_dtype_sql(c, typ)} AS dtype, "
                f"COUNT(*) > COUNT({c}) AS nullable, COUNT(*) - COUNT({c}) AS null_count, "
                f"COUNT(DISTINCT {c}) AS unique_count, "
                f"CASE WHEN COUNT(*) > 0 THEN COUNT(DISTINCT {c}) / COUNT(*) ELSE 0 END AS distinct_value_ratio, "
                f"{lo} AS min_value, {hi} AS max_value, "
                f"(COUNT(*) = COUNT({c}) AND COUNT(DISTINCT {c}) = COUNT(*)) AS is_pk_candidate, "
                f"COUNT(*) AS row_count FROM {t}")
    return "\nUNION ALL\n".join(parts)


@register("P1_table_row_and_column_counts", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, COUNT(*) AS row_count, {len(cols)} AS column_count FROM {t}"
    for t, cols in DRIVER_SCHEMA.items()))
def p1(spark, sf_dir):
    return profile_tables(tables(spark, sf_dir)).select("table_name", "row_count", "column_count")


@register("P2_P7_P10_column_profile_all_tables", _column_profile_sql())
def p2(spark, sf_dir):
    prof = profile_columns(tables(spark, sf_dir), samples=False)
    return rounded(prof.select("table_name", "column_name", "ordinal", "data_type", "dtype", "nullable",
                               "null_count", "unique_count", "distinct_value_ratio", "min_value",
                               "max_value", "is_pk_candidate", "row_count"), skip=("distinct_value_ratio",))


def _samples_sql() -> str:
    parts = []
    for t, key in KEY_ORDERED.items():
        for c, typ in DRIVER_SCHEMA[t]:
            if typ == "array" or t == "lineitem":   # file order and key order differ: compared by row number below
                continue
            parts.append(
                f"SELECT '{t}' AS table_name, '{c}' AS column_name, "
                f"(SELECT STRING_AGG(v, '|' ORDER BY fk) FROM (SELECT CAST({c} AS VARCHAR) AS v, MIN({key}) AS fk "
                f"FROM {t} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY fk LIMIT 5)) AS samples")
    return "\nUNION ALL\n".join(parts)


@register("P8_first_distinct_samples", _samples_sql())
def p8(spark, sf_dir):
    prof = profile_columns(tables(spark, sf_dir))
    # embeddings.embedding and lineitem have their own check
    return prof.filter("column_name <> 'embedding' AND table_name <> 'lineitem'").select(
        "table_name", "column_name", F.array_join("sample_values", "|").alias("samples"))


@register("P8_first_samples_lineitem_file_order", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, (SELECT STRING_AGG(v, '|' ORDER BY fk) FROM (SELECT CAST({c} AS VARCHAR) AS v, MIN(rn) AS fk "
    f"FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS rn "
    f"FROM lineitem) x GROUP BY 1 ORDER BY fk LIMIT 5)) AS samples"
    for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")))
def p8_lineitem(spark, sf_dir):
    from tabsight.catalog import TableSet
    from tabsight.session import scratch_path
    path = scratch_path(spark, "lineitem-in-files")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    rows = tables(spark, sf_dir, "lineitem").plain("lineitem")
    # files of bounded size, however large the table is
    rows.repartitionByRange(files_for(rows, 5), "l_orderkey").sortWithinPartitions(*order).write.parquet(path)
    prof = profile_columns(TableSet({}, {"lineitem": spark.read.parquet(path)}))
    return prof.filter(F.col("column_name").isin("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag",
                                                 "l_linestatus")).select(
        "column_name", F.array_join("sample_values", "|").alias("samples"))


@register("P5_P7_P10_wide_decimals", """
SELECT 'd' AS column_name, COUNT(DISTINCT o_orderkey) AS unique_count,
       CAST(12345678901234567890.12 + MIN(o_orderkey) AS DECIMAL(30,2))::VARCHAR AS min_value,
       CAST(CAST(12345678901234567890.12 AS DECIMAL(30,2)) + MAX(o_orderkey) AS DECIMAL(30,2))::VARCHAR AS max_value,
       COUNT(DISTINCT o_orderkey) = COUNT(*) AS is_pk_candidate FROM orders""".replace(
    "CAST(12345678901234567890.12 + MIN(o_orderkey) AS DECIMAL(30,2))",
    "CAST(CAST(12345678901234567890.12 AS DECIMAL(30,2)) + MIN(o_orderkey) AS DECIMAL(30,2))"))
def p5_decimals(spark, sf_dir):
    from tabsight.catalog import TableSet
    o = tables(spark, sf_dir, "orders").plain("orders")
    d = (F.lit("12345678901234567890.12").cast("decimal(30,2)") + F.col("o_orderkey").cast("decimal(19,0)")).cast("decimal(30,2)")
    prof = profile_columns(TableSet({"t": o.select(d.alias("d"))}), samples=False)
    return prof.select("column_name", "unique_count", "min_value", "max_value", "is_pk_candidate")


@register("P9_head_tail_samples", """
SELECT 'head' AS part, CAST(ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 AS INT) AS pos, o_orderkey, o_custkey,
       o_orderstatus, ROUND(o_totalprice, 4) AS o_totalprice, o_orderdate, o_orderpriority
FROM orders QUALIFY pos < 5
UNION ALL
SELECT 'tail' AS part, CAST(ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 - (COUNT(*) OVER () - 5) AS INT) AS pos,
       o_orderkey, o_custkey, o_orderstatus, ROUND(o_totalprice, 4) AS o_totalprice, o_orderdate, o_orderpriority
FROM orders QUALIFY pos >= 0""")
def p9(spark, sf_dir):
    t = tables(spark, sf_dir, "orders")
    return rounded(head_tail(t["orders"], scan=t.scan("orders")))


def _canon_sql(c: str, typ: str) -> tuple[str, str] | None:
    if typ in ("int", "bigint"):
        return "num", f"CAST({c} AS VARCHAR)"
    if typ == "double":
        return "num", (f"CASE WHEN {c} = FLOOR({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) "
                       f"ELSE CAST({c} AS VARCHAR) END")
    if typ == "string":
        return "str", c
    if typ == "timestamp":
        return "ts", f"CAST({c} AS VARCHAR)"
    return None


def _ind_sql() -> str:
    parts = []
    for t, cols in DRIVER_SCHEMA.items():
        for c, typ in cols:
            cv = _canon_sql(c, typ)
            if cv is None:
                continue
            d, v = cv
            parts.append(f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, '{d}' AS d, {v} AS v FROM {t} WHERE {c} IS NOT NULL")
    long = "\n  UNION ALL ".join(parts)
    return f"""
WITH long AS (
  {long}
),
cnt AS (SELECT t, c, COUNT(*) AS n FROM long GROUP BY t, c),
pairs AS (
  SELECT a.t AS dt, a.c AS dc, b.t AS rt, b.c AS rc, COUNT(*) AS k
  FROM long a JOIN long b ON a.d = b.d AND a.v = b.v AND a.t <> b.t
  GROUP BY a.t, a.c, b.t, b.c)
SELECT dt AS dep_table, dc AS dep_column, rt AS ref_table, rc AS ref_column,
       na.n AS dep_distinct, nb.n AS ref_distinct
FROM pairs JOIN cnt na ON na.t = dt AND na.c = dc JOIN cnt nb ON nb.t = rt AND nb.c = rc
WHERE k = na.n AND na.n < nb.n"""


@register("P11_foreign_key_candidates", _ind_sql())
def p11(spark, sf_dir):
    return inclusion_dependencies(tables(spark, sf_dir))


def _joinable_sql() -> str:
    parts = []
    for t, cols in DRIVER_SCHEMA.items():
        for c, typ in cols:
            parts.append(f"SELECT '{t}' AS t, '{c}' AS c, {_dtype_sql(c, typ)} AS dtype "
                         f"FROM {t} HAVING COUNT(*) >= 0")
    long = "\n  UNION ALL ".join(parts)
    return f"""
WITH cols AS (
  {long}
)
SELECT l.t || '.' || l.c AS left_column, r.t || '.' || r.c AS right_column, l.dtype AS dtype
FROM cols l JOIN cols r ON l.c = r.c AND l.dtype = r.dtype AND l.t < r.t"""


@register("P12_joinable_columns", _joinable_sql())
def p12(spark, sf_dir):
    return joinable_columns(tables(spark, sf_dir))


@register("P15_P19_report_summary_doc_labels", """
SELECT 'doc_id' AS column_name, 'int64' AS dtype, COUNT(*) - COUNT(doc_id) AS missing FROM documents d LEFT JOIN labels l USING (doc_id)
UNION ALL SELECT 'lang', 'object', COUNT(*) - COUNT(lang) FROM documents d LEFT JOIN labels l USING (doc_id)
UNION ALL SELECT 'source', 'object', COUNT(*) - COUNT(source) FROM documents d LEFT JOIN labels l USING (doc_id)
UNION ALL SELECT 'n_chars', 'int64', COUNT(*) - COUNT(n_chars) FROM documents d LEFT JOIN labels l USING (doc_id)
UNION ALL SELECT 'quality', CASE WHEN COUNT(*) > COUNT(quality) THEN 'float64' ELSE 'int32' END, COUNT(*) - COUNT(quality)
          FROM documents d LEFT JOIN labels l USING (doc_id)
UNION ALL SELECT 'toxic', CASE WHEN COUNT(*) > COUNT(toxic) THEN 'float64' ELSE 'int32' END, COUNT(*) - COUNT(toxic)
          FROM documents d LEFT JOIN labels l USING (doc_id)""")
def p15(spark, sf_dir):
    from tabsight.catalog import TableSet
    from tabsight.suite.views import doc_labels_view
    t = TableSet({"doc_labels": doc_labels_view(tables(spark, sf_dir, "documents", "labels"))})
    prof = profile_columns(t, samples=False)
    return prof.select("column_name", "dtype", F.col("null_count").alias("missing"))


assert set(DRIVER_SCHEMA) == set(DRIVER_TABLES)



def _schema_count_sql() -> str:
    return " + ".join(str(len(c)) for c in DRIVER_SCHEMA.values())


@register("P13_P14_catalog_parts", f"""
SELECT 'tables' AS part, {len(DRIVER_SCHEMA)} AS entries
UNION ALL SELECT 'columns', {_schema_count_sql()}
UNION ALL SELECT 'sample_data', (SELECT SUM(LEAST(n, 5) + LEAST(n, 5)) FROM ({" UNION ALL ".join(
    f"SELECT COUNT(*) AS n FROM {t}" for t in DRIVER_SCHEMA)}))""")
def p13(spark, sf_dir):
    from tabsight.operators.report_context import extract_catalog, light_catalog
    t = tables(spark, sf_dir)
    cat = extract_catalog(t)
    light = light_catalog(t, cat["columns"])
    parts = [cat["tables"].agg(F.count(F.lit(1)).alias("entries")).select(F.lit("tables").alias("part"), "entries"),
             light.agg(F.count(F.lit(1)).alias("entries")).select(F.lit("columns").alias("part"), "entries"),
             cat["sample_data"].agg(F.count(F.lit(1)).alias("entries")).select(F.lit("sample_data").alias("part"),
                                                                               "entries")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("P17_P18_result_context_flagship", f"""
SELECT 'operation_1' AS key, LEAST(COUNT(DISTINCT location), 10) AS row_count,
       'location:nominal|sales_count:quantitative|sales_mean:quantitative|sales_sum:quantitative' AS types
FROM (SELECT n_name AS location FROM orders JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus IS DISTINCT FROM 'F')""")
def p17(spark, sf_dir):
    from tabsight.catalog import TableSet
    from tabsight.operators.report_context import result_context
    from tabsight.plans.executor import PlanExecutor
    from tabsight.suite.plan_checks import FLAGSHIP_PLAN
    from tabsight.suite.views import sales_view
    t = TableSet({"sales": sales_view(tables(spark, sf_dir, "orders", "customer", "nation"))})
    run = PlanExecutor(t).run({"operations": [FLAGSHIP_PLAN]})
    ctx = result_context(run.results)
    types = F.array_join(F.array_sort(F.transform(F.map_entries("semantic_types"),
                                                   lambda e: F.concat(e["key"], F.lit(":"), e["value"]))), "|")
    return ctx.select("key", "row_count", types.alias("types"))


def _pk_sql() -> str:
    parts = []
    for t, cols in DRIVER_SCHEMA.items():
        for c, _ in cols:
            parts.append(f"SELECT '{t}' AS file_name, '{c}' AS column_name FROM {t} "
                         f"HAVING COUNT(*) = COUNT({c}) AND COUNT(DISTINCT {c}) = COUNT(*)")
    return "\nUNION ALL\n".join(parts)


@register("P13_catalog_primary_keys", _pk_sql())
def p13_keys(spark, sf_dir):
    from tabsight.operators.report_context import extract_catalog
    return extract_catalog(tables(spark, sf_dir))["primary_key_candidates"].select("file_name", "column_name")


_SAMPLED = {t: k for t, k in KEY_ORDERED.items() if t in ("region", "nation", "customer", "supplier", "part", "orders", "labels")}


@register("P13_catalog_sample_rows", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, part, CAST(pos AS INT) AS pos, CAST(k AS VARCHAR) AS key FROM ("
    f"SELECT 'head' AS part, ROW_NUMBER() OVER (ORDER BY {k}) - 1 AS pos, {k} AS k FROM {t} QUALIFY pos < 5 UNION ALL "
    f"SELECT 'tail', ROW_NUMBER() OVER (ORDER BY {k}) - 1 - (COUNT(*) OVER () - LEAST(5, COUNT(*) OVER ())) AS pos, {k} FROM {t} "
    f"QUALIFY pos >= 0) x" for t, k in _SAMPLED.items()))
def p13_samples(spark, sf_dir):
    from tabsight.operators.report_context import sample_rows
    rows = sample_rows(tables(spark, sf_dir, *_SAMPLED))
    key = F.lit(None).cast("string")
    for t, k in _SAMPLED.items():
        key = F.when(F.col("table_name") == t, F.get_json_object("record", f"$.{k}")).otherwise(key)
    return rows.select("table_name", "part", "pos", key.alias("key"))


@register("P14_light_catalog_content", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS report, '{c}' AS column_name, {_dtype_sql(c, typ)} AS dtype, COUNT(DISTINCT {c}) AS unique_count, "
    f"(SELECT STRING_AGG(v, '|' ORDER BY fk) FROM (SELECT CAST({c} AS VARCHAR) AS v, MIN({k}) AS fk FROM {t} "
    f"WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY fk LIMIT 5)) AS samples FROM {t}"
    for t, k in _SAMPLED.items() for c, typ in DRIVER_SCHEMA[t]))
def p14_content(spark, sf_dir):
    from tabsight.operators.report_context import light_catalog
    out = light_catalog(tables(spark, sf_dir, *_SAMPLED))
    return out.select("report", "column_name", "dtype", "unique_count", F.array_join("sample_values", "|").alias("samples"))


@register("P18_result_context_first_rows", """
SELECT 'operation_1' AS key, STRING_AGG(location, '|' ORDER BY total DESC, location) AS first_rows FROM (
  SELECT n_name AS location, SUM(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus IS DISTINCT FROM 'F'
  GROUP BY 1 ORDER BY total DESC, location LIMIT 3)""")
def p18_rows(spark, sf_dir):
    from tabsight.catalog import TableSet
    from tabsight.operators.report_context import result_context
    from tabsight.plans.executor import PlanExecutor
    from tabsight.suite.plan_checks import FLAGSHIP_PLAN
    from tabsight.suite.views import sales_view
    t = TableSet({"sales": sales_view(tables(spark, sf_dir, "orders", "customer", "nation"))})
    ctx = result_context(PlanExecutor(t).run({"operations": [FLAGSHIP_PLAN]}).results)
    names = F.transform("sample_data", lambda r: F.get_json_object(r, "$.location"))
    return ctx.select("key", F.array_join(names, "|").alias("first_rows"))


def _pair_key_sql(table: str, columns: list[str]) -> str:
    """Pairs of columns that are a key while neither column is one and none misses a value."""
    one = ", ".join(f"COUNT(DISTINCT {c}) AS d_{c}, COUNT({c}) AS n_{c}" for c in columns)
    pairs = " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{a},{b}' AS columns FROM one WHERE n_{a} = n AND n_{b} = n AND d_{a} < n AND d_{b} < n "
        f"AND (SELECT COUNT(*) FROM (SELECT DISTINCT {a}, {b} FROM {table})) = n"
        for k, a in enumerate(columns) for b in columns[k + 1:])
    return f"SELECT * FROM (WITH one AS (SELECT COUNT(*) AS n, {one} FROM {table}) {pairs})"


_PAIR_TABLES = {t: [c for c, _ in DRIVER_SCHEMA[t]] for t in ("lineitem", "conversations", "orders", "labels", "customer")}


@register("P10_two_column_keys", " UNION ALL ".join(_pair_key_sql(t, c) for t, c in _PAIR_TABLES.items()))
def p10_pairs(spark, sf_dir):
    from tabsight.operators.composite import composite_keys
    got = composite_keys(tables(spark, sf_dir, *_PAIR_TABLES))
    return got.select("table_name", F.concat_ws(",", "columns").alias("columns"))


_REF_PAIRS = [(a, b) for a in ("conv_id", "turn", "role", "text") for b in ("conv_id", "turn", "role", "text") if a != b]


@register("P11_two_column_foreign_keys", """
WITH replies AS (SELECT DISTINCT conv_id AS thread, turn - 1 AS answers FROM conversations WHERE turn > 0),
one AS (SELECT COUNT(*) AS n, COUNT(DISTINCT conv_id) AS conv_id, COUNT(DISTINCT turn) AS turn, COUNT(DISTINCT role) AS role,
               COUNT(DISTINCT text) AS text FROM conversations)
""" + " UNION ALL ".join(f"""
SELECT 'replies' AS dep_table, 'thread,answers' AS dep_columns, '{a},{b}' AS ref_columns, (SELECT COUNT(*) FROM replies) AS dep_distinct,
       (SELECT COUNT(*) FROM (SELECT DISTINCT {a}, {b} FROM conversations)) AS ref_distinct
FROM one WHERE ref_distinct = n AND one.{a} < n AND one.{b} < n AND NOT EXISTS (
    SELECT 1 FROM replies r WHERE NOT EXISTS (SELECT 1 FROM conversations c WHERE CAST(c.{a} AS VARCHAR) = CAST(r.thread AS VARCHAR)
                                                                        AND CAST(c.{b} AS VARCHAR) = CAST(r.answers AS VARCHAR)))"""
                                   for a, b in _REF_PAIRS if "role" not in (a, b) and "text" not in (a, b)))
def p11_pairs(spark, sf_dir):
    from tabsight.operators.composite import composite_inclusions
    c = tables(spark, sf_dir, "conversations").plain("conversations")
    replies = c.filter("turn > 0").select(F.col("conv_id").alias("thread"), (F.col("turn") - 1).alias("answers"))
    got = composite_inclusions(TableSet({"conversations": c, "replies": replies}))
    return got.filter("ref_table = 'conversations'").select("dep_table", F.concat_ws(",", "dep_columns").alias("dep_columns"),
                                                            F.concat_ws(",", "ref_columns").alias("ref_columns"), "dep_distinct", "ref_distinct")
