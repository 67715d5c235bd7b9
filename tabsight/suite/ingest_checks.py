"""Checks for ingest (S1-S19): every input file or payload is derived by Spark from
the driver tables, so the work grows with them."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from tabsight.functions.names import file_kind, logical_table_name
from tabsight.session import scratch_path
from tabsight.sinks.writers import CSV_OPTIONS
from tabsight.sources.archive_builder import build_archive_frame, write_archive_files
from tabsight.sources.csv import infer_types, read_csv_table, union_tables
from tabsight.sources.files import ingest_paths, outcome_summary, quick_text_summary
from tabsight.sources.payloads import csv_records, long_row_issues, parse_payload_rows, payload_types, route
from tabsight.sources.zipfiles import ingest_archives, provenance, scan_archive_files, scan_archives
from tabsight.suite.base import register, rounded, tables
from tabsight.suite.profile_checks import DRIVER_SCHEMA


def _write_csv(df, path):
    df.write.options(**CSV_OPTIONS).mode("overwrite").csv(path)
    return path


@register("S1_csv_read_nation", """
SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation""")
def s1(spark, sf_dir):
    path = _write_csv(tables(spark, sf_dir, "nation").plain("nation"), scratch_path(spark, "csv"))
    return read_csv_table(spark, path).df.drop("_row_id")


@register("S1_csv_read_orders_typed", """
SELECT o_orderkey, o_custkey, o_orderstatus, ROUND(o_totalprice, 4) AS o_totalprice,
       STRFTIME(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders""")
def s1b(spark, sf_dir):
    o = tables(spark, sf_dir, "orders").plain("orders")
    o = o.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return rounded(read_csv_table(spark, _write_csv(o, scratch_path(spark, "csv"))).df.drop("_row_id"))


@register("S1_csv_quoted_text_documents", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def s1c(spark, sf_dir):
    d = tables(spark, sf_dir, "documents").plain("documents")
    return read_csv_table(spark, _write_csv(d, scratch_path(spark, "csv"))).df.drop("_row_id")


@register("S1_csv_quotes_and_backslashes", r"""
SELECT conv_id, turn, role, '"' || text || '\",' || chr(10) || '"x' AS text FROM conversations""")
def s1d(spark, sf_dir):
    c = tables(spark, sf_dir, "conversations").plain("conversations")
    hard = F.concat(F.lit('"'), F.col("text"), F.lit('\\",\n"x'))
    path = _write_csv(c.select("conv_id", "turn", "role", hard.alias("text")), scratch_path(spark, "csv"))
    return read_csv_table(spark, path).df.drop("_row_id")


def _inference_sql(t: str) -> str:
    parts = []
    for i, (c, _) in enumerate(DRIVER_SCHEMA[t]):
        v = f"CAST({c} AS VARCHAR)"
        parts.append(
            f"SELECT '{c}' AS column_name, {i} AS ordinal, CASE "
            f"WHEN COUNT({c}) = 0 THEN 'float' "
            f"WHEN COUNT(CASE WHEN REGEXP_MATCHES({v}, '^\\s*[+-]?[0-9]+\\s*$') THEN 1 END) = COUNT({c}) "
            f"AND COUNT({c}) = COUNT(*) THEN 'int' "
            f"WHEN COUNT(TRY_CAST(TRIM({v}) AS DOUBLE)) = COUNT({c}) THEN 'float' "
            f"WHEN COUNT(CASE WHEN {v} IN ('True','TRUE','true','False','FALSE','false') THEN 1 END) = COUNT({c}) "
            f"AND COUNT({c}) = COUNT(*) THEN 'bool' ELSE 'string' END AS inferred FROM {t}")
    return "\nUNION ALL\n".join(parts)


@register("S2_type_inference_string_orders", _inference_sql("orders"))
def s2(spark, sf_dir):
    o = tables(spark, sf_dir, "orders").plain("orders")
    s = o.select(*[F.col(c).cast("string").alias(c) for c in o.columns])
    return infer_types(s, s.columns)


@register("S2_type_inference_string_lineitem", _inference_sql("lineitem"))
def s2b(spark, sf_dir):
    li = tables(spark, sf_dir, "lineitem").plain("lineitem")
    s = li.select(*[F.col(c).cast("string").alias(c) for c in li.columns])
    return infer_types(s, s.columns)


@register("S2_type_suffixes_and_wide_integers_stay_text", """
SELECT CAST(l_orderkey AS VARCHAR) || 'D' AS sku, '9999999999' || CAST(10000000000 + l_orderkey AS VARCHAR) AS wide,
       COUNT(*) AS n FROM lineitem GROUP BY l_orderkey""")
def s2c(spark, sf_dir):
    li = tables(spark, sf_dir, "lineitem").plain("lineitem")
    s = li.select(F.concat(F.col("l_orderkey").cast("string"), F.lit("D")).alias("sku"),
                  F.concat(F.lit("9999999999"), (F.lit(10000000000) + F.col("l_orderkey")).cast("string")).alias("wide"))
    back = read_csv_table(spark, _write_csv(s, scratch_path(spark, "csv"))).df
    return back.groupBy("sku", "wide").agg(F.count(F.lit(1)).alias("n"))


_ORDER_COLS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


def _order_payloads(spark, sf_dir):
    """CSV payloads of about 200 orders each (buckets of the primary key, so their size is
    bounded whatever the skew of other columns); every other payload is base64, and every
    third one has its columns in reverse order."""
    o = tables(spark, sf_dir, "orders")["orders"]
    n = F.greatest(F.lit(1), F.floor(o.agg(F.count(F.lit(1))).scalar() / 200)).cast("long")
    o = o.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")).withColumn("bucket", F.col("o_orderkey") % n)
    opts = {"escape": '"'}
    line = F.when(F.col("bucket") % 3 == 0, F.to_csv(F.struct(*[F.col(c) for c in reversed(_ORDER_COLS)]), opts)).otherwise(
        F.to_csv(F.struct(*[F.col(c) for c in _ORDER_COLS]), opts))
    per = (o.select("bucket", F.col("_row_id"), line.alias("line")).groupBy("bucket")
            .agg(F.array_sort(F.collect_list(F.struct("_row_id", "line"))).alias("ls")))
    head = F.when(F.col("bucket") % 3 == 0, F.lit(",".join(reversed(_ORDER_COLS)))).otherwise(F.lit(",".join(_ORDER_COLS)))
    text = F.concat(head, F.lit("\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n"))
    return per.select(F.col("bucket").alias("request_id"),
                      F.when(F.col("bucket") % 2 == 0, text).alias("csv_data"),
                      F.when(F.col("bucket") % 2 == 1, F.base64(F.encode(text, "UTF-8"))).alias("csv_base64"))


@register("S3_S4_S7_csv_payloads", """
SELECT o_orderkey, o_custkey, o_orderstatus, ROUND(o_totalprice, 4) AS o_totalprice,
       STRFTIME(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders""")
def s3(spark, sf_dir):
    records = csv_records(route(_order_payloads(spark, sf_dir)))
    parts = [parse_payload_rows(records, list(h)).select(*_ORDER_COLS) for h in (_ORDER_COLS, tuple(reversed(_ORDER_COLS)))]
    return rounded(parts[0].unionByName(parts[1]))


@register("S3_payload_types_per_request", """
WITH n AS (SELECT GREATEST(1, FLOOR(COUNT(*) / 200)) AS n FROM orders),
r AS (SELECT DISTINCT o_orderkey % n AS request_id FROM orders, n),
c AS (SELECT * FROM (VALUES ('o_orderkey', 0, 'int'), ('o_custkey', 1, 'int'), ('o_orderstatus', 2, 'string'),
      ('o_totalprice', 3, 'float'), ('o_orderdate', 4, 'string'), ('o_orderpriority', 5, 'string')) t(col, pos, inferred))
SELECT CAST(request_id AS BIGINT) AS request_id, CAST(CASE WHEN request_id % 3 = 0 THEN 5 - pos ELSE pos END AS INT) AS ordinal,
       col AS column, inferred FROM r, c""")
def s3b(spark, sf_dir):
    return payload_types(csv_records(route(_order_payloads(spark, sf_dir))))


@register("S3_S4_bad_payloads_are_isolated", """
SELECT request_id, CASE WHEN request_id % 4 = 1 THEN 'Invalid base64 CSV data'
                        WHEN request_id % 4 = 2 THEN 'Error tokenizing data: 1 row(s) have more fields than the header (2)' END AS message
FROM (SELECT c_custkey AS request_id FROM customer) r""")
def s3c(spark, sf_dir):
    c = tables(spark, sf_dir, "customer").plain("customer")
    good = F.concat(F.lit('a,b\n"x\ny",1\n"he said ""hi"", ok",'), F.col("c_nationkey").cast("string"), F.lit("\n"))
    long = F.concat(good, F.lit("1,2,3\n"))
    kind = F.col("c_custkey") % 4
    reqs = c.select(F.col("c_custkey").alias("request_id"),
                    F.when(kind == 0, good).when(kind == 2, long).alias("csv_data"),
                    F.when(kind == 1, F.base64(F.unhex(F.lit("612C620AFFFE")))).when(
                        kind == 3, F.base64(F.encode(good, "UTF-8"))).alias("csv_base64"))
    routed = route(reqs)
    issues = long_row_issues(csv_records(routed)).select("request_id", F.col("message").alias("long"))
    return routed.join(issues, "request_id", "left").select("request_id", F.coalesce("error", "long").alias("message"))


@register("S7_payload_routing_counts", """
WITH n AS (SELECT GREATEST(1, FLOOR(COUNT(*) / 200)) AS n FROM orders)
SELECT CASE WHEN (o_orderkey % n) % 2 = 0 THEN 'csv_data' ELSE 'csv_base64' END AS payload_kind,
       COUNT(DISTINCT o_orderkey % n) AS requests
FROM orders, n GROUP BY 1""")
def s7(spark, sf_dir):
    routed = route(_order_payloads(spark, sf_dir))
    return routed.groupBy("payload_kind").agg(F.count(F.lit(1)).alias("requests"))


def _zip_payload_udf(pdf: pd.DataFrame) -> pd.DataFrame:
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        bucket = int(pdf["bucket"].iloc[0])
        zf.writestr(f"orders_{bucket}.csv", pdf.drop(columns="bucket").to_csv(index=False))
    return pd.DataFrame({"bucket": [bucket], "zip": [buf.getvalue()]})


@register("S5_S6_S8_S11_zip_payloads", """
SELECT o_orderkey, o_custkey, o_orderstatus, ROUND(o_totalprice, 4) AS o_totalprice,
       STRFTIME(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders""")
def s5(spark, sf_dir):
    o = tables(spark, sf_dir, "orders").plain("orders")
    # hash buckets of a unique key: about 200 rows per payload whatever the skew
    buckets = F.greatest(F.lit(1), F.floor(o.agg(F.count(F.lit(1))).scalar() / 200)).cast("long")
    b = o.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")).withColumn(
        "bucket", F.pmod(F.xxhash64("o_orderkey"), buckets))
    zips = b.groupBy("bucket").applyInPandas(_zip_payload_udf, "bucket long, zip binary")
    reqs = zips.select(F.col("bucket").alias("request_id"),
                       F.when(F.col("bucket") % 2 == 0, F.decode("zip", "ISO-8859-1")).alias("zip_data"),
                       F.when(F.col("bucket") % 2 == 1, F.base64("zip")).alias("zip_base64"))
    routed = route(reqs)
    members = scan_archives(routed.withColumn("archive", F.col("request_id").cast("string")),
                            "archive", "zip_bytes", with_text=True)
    records = csv_records(members.filter("kept").withColumnRenamed("member_id", "request_id"), "request_id", "text")
    return rounded(parse_payload_rows(records, list(_ORDER_COLS)).drop("request_id", "line_no"))


_EXTRA = {
    "__MACOSX/region.csv": b"r_regionkey\n1\n",
    ".hidden.csv": b"a\n1\n",
    "docs/": b"",
    "docs/readme.txt": b"not a table\n",
    "d/.h2.csv": b"a,b\n1,2\n",
    "Two.CSV": b"x\n1\n2\n",
    "empty.csv": b"",
    "bad.csv": b"name\n\xff\xfe\xfa\n",
    "quoted.csv": b'a,b\n"x\ny",1\n"he said ""hi"", ok",2\n"C:\\dir\\",3\n',
}


def _member_group(m):
    return F.when(F.instr(m, "/part-") > 0, F.substring_index(m, "/", 1)).otherwise(m)


@register("S8_S12_S17_zip_archive_members", """
SELECT 'nation' AS member_group, 'ok' AS status, COUNT(*) AS rows, 3 AS columns FROM nation
UNION ALL SELECT 'region', 'ok', COUNT(*), 2 FROM region
UNION ALL SELECT 'supplier', 'ok', COUNT(*), 4 FROM supplier
UNION ALL SELECT 'd/.h2.csv', 'ok', 1, 2
UNION ALL SELECT 'Two.CSV', 'ok', 2, 1
UNION ALL SELECT 'quoted.csv', 'ok', 3, 2
UNION ALL SELECT 'empty.csv', 'error', NULL, NULL
UNION ALL SELECT 'bad.csv', 'error', NULL, NULL
UNION ALL SELECT '__MACOSX/region.csv', 'skipped', NULL, NULL
UNION ALL SELECT '.hidden.csv', 'skipped', NULL, NULL
UNION ALL SELECT 'docs/', 'skipped', NULL, NULL
UNION ALL SELECT 'docs/readme.txt', 'skipped', NULL, NULL""")
def s8(spark, sf_dir):
    t = tables(spark, sf_dir, "nation", "region", "supplier")
    archives = build_archive_frame(spark, {n: t[n] for n in ("nation", "region", "supplier")}, "tables.zip", extra=_EXTRA)
    members, read = ingest_archives(spark, archives)
    parts = [spark.createDataFrame([], "member string, rows long, columns int")]
    for name, tab in read.items():
        if tab.ok:
            parts.append(tab.df.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(name.split("#", 1)[1]).alias("member"), "rows", F.lit(len(tab.types)).alias("columns")))
    cnt = parts[0]
    for p in parts[1:]:
        cnt = cnt.unionByName(p)
    rows = (members.filter(F.col("member").isNotNull()).join(cnt, "member", "left")
                   .withColumn("status", F.when((F.col("status") == "ok") & F.col("rows").isNull(), F.lit("error"))
                                          .otherwise(F.col("status"))))
    return (rows.groupBy(_member_group(F.col("member")).alias("member_group"), "status")
                .agg(F.sum("rows").alias("rows"), F.max("columns").alias("columns")))


def _supplier_archives(spark, sf_dir, members):
    """Archives of 50 suppliers in so many members each; all archives of odd number are called a/r<n>.zip, the others b/r<n>.zip
    with the number halved, so that names repeat across folders."""
    s = tables(spark, sf_dir, "supplier").plain("supplier")
    no = F.floor((F.col("s_suppkey") - 1) / 50)
    name = F.concat(F.when(no % 2 == 1, F.lit("a/r")).otherwise(F.lit("b/r")), F.floor(no / 2).cast("string"), F.lit(".zip"))
    return build_archive_frame(spark, {"supplier": s}, "many.zip", split={"supplier": F.col("s_suppkey") % members}, archive=name)


@register("S9_all_members_of_equally_named_archives", """
SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, ROUND(s_acctbal, 4) AS s_acctbal FROM supplier""")
def s9a(spark, sf_dir):
    _, read = ingest_archives(spark, _supplier_archives(spark, sf_dir, 5))
    return rounded(union_tables(read.values()).drop("_row_id"))


@register("S9_S10_member_cap_and_size_limit", """
WITH m AS (SELECT FLOOR((s_suppkey - 1) / 50) AS a, COUNT(DISTINCT s_suppkey % 25) AS n FROM supplier GROUP BY 1)
SELECT 'ok' AS status, CAST(SUM(LEAST(n, 20)) AS BIGINT) AS members FROM m
UNION ALL SELECT 'skipped', CAST(SUM(n - 20) AS BIGINT) FROM m WHERE n > 20 HAVING COUNT(*) > 0
UNION ALL SELECT 'warning', COUNT(*) FROM m WHERE n > 20 HAVING COUNT(*) > 0""")
def s9(spark, sf_dir):
    listing = scan_archives(_supplier_archives(spark, sf_dir, 25), max_files=20)
    return listing.groupBy("status").agg(F.count(F.lit(1)).alias("members"))


@register("S8_S11_archive_files_read_by_member", """
SELECT 'c' || CAST(FLOOR(c_custkey / 3000) AS BIGINT) || '.zip' AS archive, 'customer/part=' || CAST(FLOOR(c_custkey / 100) AS BIGINT) || '.csv' AS member,
       COUNT(*) AS records, SUM(c_custkey) AS keys, 'ok' AS status
FROM customer GROUP BY 1, 2""")
def s11_files(spark, sf_dir):
    """Archives that are files, read in pieces: every record of every member, its key, and the listing."""
    c = tables(spark, sf_dir, "customer").plain("customer")
    frame = build_archive_frame(spark, {"customer": c}, "x.zip", split={"customer": F.floor(F.col("c_custkey") / 100)},
                                archive=F.concat(F.lit("c"), F.floor(F.col("c_custkey") / 3000).cast("string"), F.lit(".zip")))
    members, texts = scan_archive_files(spark, write_archive_files(spark, frame, scratch_path(spark, "zip-files")))
    lines = texts.select("member_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"), "seq")
    lines = lines.filter("seq > 1 OR pos > 0")        # the first line is the header
    key = F.from_csv("line", "c_custkey bigint", {"quote": '"', "escape": '"'})["c_custkey"]
    got = lines.groupBy("member_id").agg(F.count(F.lit(1)).alias("records"), F.sum(key).alias("keys"))
    return members.filter("member IS NOT NULL").join(got, "member_id").select(
        F.element_at(F.split("archive", "/"), -1).alias("archive"), "member", "records", "keys", "status")


@register("S10_member_size_cap_error", """
SELECT 'error' AS status, COUNT(DISTINCT FLOOR(c_custkey / 200)) AS members FROM customer""")
def s10(spark, sf_dir):
    c = tables(spark, sf_dir, "customer").plain("customer")
    archives = build_archive_frame(spark, {"customer": c}, "big.zip", split={"customer": F.floor(F.col("c_custkey") / 200)},
                                   archive=F.concat(F.floor(F.col("c_custkey") / 2000).cast("string"), F.lit(".zip")))
    listing = scan_archives(archives, max_bytes=16)
    return listing.filter(F.col("member").isNotNull()).groupBy("status").agg(F.count(F.lit(1)).alias("members"))


@register("S12_member_provenance", """
SELECT n_nationkey, n_name, 'nation-0.zip#nation/part-00000.csv' AS original_name, TRUE AS from_zip, 'nation-0.zip' AS zip_file
FROM nation""")
def s12(spark, sf_dir):
    t = tables(spark, sf_dir, "nation")
    _, read = ingest_archives(spark, build_archive_frame(spark, {"nation": t["nation"]}, "x.zip"))
    table = next(iter(read.values()))
    rows = provenance(table).filter("compressed_size > 0")
    return rows.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", "original_name", "from_zip", "zip_file")


@register("S13_S18_ingest_paths_outcome", """
SELECT 3 AS total_reports, 2 AS errors, 0 AS warnings, TRUE AS has_errors, FALSE AS has_warnings, FALSE AS success,
       (SELECT COUNT(*) FROM customer) + (SELECT COUNT(*) FROM supplier) + (SELECT COUNT(*) FROM part) AS rows_read""")
def s13(spark, sf_dir):
    t = tables(spark, sf_dir, "customer", "supplier", "part")
    root = scratch_path(spark, "paths")
    for n in t:
        _write_csv(t.plain(n), f"{root}/{n}.csv")
    read = ingest_paths(spark, [f"{root}/{n}.csv" for n in t] + [f"{root}/missing.csv", f"{root}/notes.txt"])
    total = None
    for tab in read.tables.values():
        n = tab.df.select(F.lit(1).alias("one"))
        total = n if total is None else total.unionByName(n)
    out = outcome_summary(read.issues_df(spark), len(read.tables))
    return out.withColumn("rows_read", total.agg(F.count(F.lit(1)).alias("n")).scalar())


@register("S15_S16_kind_and_table_name_rules", r"""
SELECT page_id,
       CASE WHEN STRPOS(url, '.') = 0 THEN 'unknown'
            WHEN LOWER(REGEXP_EXTRACT(url, '\.([^.]*)$', 1)) = 'csv' THEN 'csv'
            WHEN LOWER(REGEXP_EXTRACT(url, '\.([^.]*)$', 1)) = 'zip' THEN 'zip' ELSE 'unknown' END AS kind,
       LOWER(REGEXP_REPLACE(REGEXP_REPLACE(url, '\.[^.]*$', ''), '[^a-zA-Z0-9]+', '_', 'g')) AS table_name
FROM pages""")
def s15(spark, sf_dir):
    p = tables(spark, sf_dir, "pages").plain("pages")
    return p.select("page_id", file_kind(F.col("url")).alias("kind"), logical_table_name(F.col("url")).alias("table_name"))


@register("S19_quick_line_column_summary", """
SELECT 'nation' AS table_name, COUNT(*) AS rows, 3 AS columns FROM nation
UNION ALL SELECT 'region', COUNT(*), 2 FROM region
UNION ALL SELECT 'customer', COUNT(*), 5 FROM customer""")
def s19(spark, sf_dir):
    t = tables(spark, sf_dir, "nation", "region", "customer")
    root = scratch_path(spark, "csv-summary")
    for n in ("nation", "region", "customer"):
        _write_csv(t.plain(n), f"{root}/{n}")
    out = None
    for n in ("nation", "region", "customer"):
        s = quick_text_summary(spark, f"{root}/{n}").agg(F.sum("rows").alias("rows"), F.max("columns").alias("columns"))
        s = s.select(F.lit(n).alias("table_name"), "rows", "columns")
        out = s if out is None else out.unionByName(s)
    return out
