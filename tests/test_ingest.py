"""CSV reader parity with pandas.read_csv (FIXTURES edge cases), payloads, ZIP rules."""

import base64
import io
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsight.catalog import TableSet
from tabsight.operators.insights import date_ranges, insights_frame, kpi_summary, recommendations_frame
from tabsight.operators.profile import profile_columns
from tabsight.sources.csv import dedupe_header, read_csv_table
from tabsight.sources.payloads import csv_records, long_row_issues, parse_payload_rows, payload_headers, route
from tabsight.sources.zipfiles import ingest_archives, scan_archives

F1 = """Date,Shop,Sales,Orders,Basket_Value,Visitors
2023-03-05,North Gate,310.50,12,25.88,40
2023-03-06,North Gate,455.25,18,25.29,52
2023-03-07,North Gate,298.00,11,27.09,37
2023-03-08,North Gate,512.75,21,24.42,66
2023-03-09,North Gate,1200.50,44,27.28,130
"""


def test_f1_types_profile_and_kpis(spark, csv_file):
    t = read_csv_table(spark, csv_file(F1, "sample.csv"))
    assert t.types == {"Date": "string", "Shop": "string", "Sales": "float", "Orders": "int",
                       "Basket_Value": "float", "Visitors": "int"}
    prof = {r["column_name"]: r for r in profile_columns(TableSet({"sample.csv": t.df})).collect()}
    assert [c for c, r in prof.items() if r["is_pk_candidate"]] == \
        ["Date", "Sales", "Orders", "Basket_Value", "Visitors"]
    assert prof["Date"]["data_type"] == "string" and prof["Date"]["min_value"] is None
    assert prof["Date"]["sample_values"] == ["2023-03-05", "2023-03-06", "2023-03-07", "2023-03-08", "2023-03-09"]
    assert prof["Shop"]["unique_count"] == 1
    k = kpi_summary(t.df.drop("_row_id")).collect()
    assert [r["column"] for r in k] == ["Sales"]
    assert k[0]["total_text"] == "$2,777.00" and abs(k[0]["median"] - 455.25) < 1e-9
    assert recommendations_frame(t.df.drop("_row_id")).collect()[0]["Recommendation"] == \
        "No specific recommendations generated"
    dr = date_ranges(t.df.drop("_row_id")).collect()
    assert dr[0]["value"] == "2023-03-05 00:00:00 to 2023-03-09 00:00:00"
    rows = {(r["Category"], r["Metric"]): r["Value"] for r in insights_frame("sample", t.df.drop("_row_id")).collect()}
    assert rows[("File Information", "Total Rows")] == "5"
    assert rows[("Key Insights", "Sales Analysis")] == "$2,777.00"


def test_na_tokens_ragged_rows_and_duplicate_headers(spark, csv_file):
    t = read_csv_table(spark, csv_file("a,a,b\n1,NA,x\n2,,y\n3\n", "d.csv"))
    assert t.df.drop("_row_id").columns == ["a", "a.1", "b"]
    assert t.types == {"a": "int", "a.1": "float", "b": "string"}
    rows = [tuple(r) for r in t.df.drop("_row_id").collect()]
    assert rows == [(1, None, "x"), (2, None, "y"), (3, None, None)]
    assert not t.issues
    bad = read_csv_table(spark, csv_file("a,b\n1,2\n3,4,5\n", "long.csv"))
    assert bad.issues and bad.issues[0][1] == "error"
    assert dedupe_header(["x", "x", "x", "x.1"]) == ["x", "x.1", "x.2", "x.1.1"]


def test_lenient_dates(spark):
    df = spark.createDataFrame([("2024-01-01",), ("bad",), ("01/02/2024",)], "created_date string")
    assert date_ranges(df).collect()[0]["value"] == "2024-01-01 00:00:00 to 2024-01-01 00:00:00"


def test_empty_table_all_columns_pk(spark):
    df = spark.createDataFrame([], "a int, b string")
    prof = profile_columns(TableSet({"e": df}), samples=False).collect()
    assert all(r["is_pk_candidate"] for r in prof) and all(r["row_count"] == 0 for r in prof)


def _zip(members: dict) -> bytes:
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as zf:
        for n, data in members.items():
            if n.endswith("/"):
                zf.writestr(zipfile.ZipInfo(n), b"")
            else:
                zf.writestr(n, data)
    return buf.getvalue()


def test_payload_routing_and_zip_rules(spark):
    csv = "date,item,qty\n2024-01-01,a,1\n2024-01-02,b,2\n"
    zbytes = _zip({"sales_data.csv": csv, "__MACOSX/x.csv": "a\n1\n", ".h.csv": "a\n1\n", "d/": b"",
                   "d/.h2.csv": "a\n1\n", "Two.CSV": "x\n1\n", "bad.csv": b"\xff\xfe", "readme.txt": "x"})
    reqs = spark.createDataFrame(
        [(1, csv, None, None), (2, None, base64.b64encode(csv.encode()).decode(), None),
         (3, None, None, base64.b64encode(zbytes).decode()), (4, None, None, "%%%not base64"),
         (5, None, None, None)],
        "request_id int, csv_data string, csv_base64 string, zip_base64 string")
    routed = {r["request_id"]: r for r in route(reqs).collect()}
    assert [routed[i]["payload_kind"] for i in range(1, 6)] == ["csv_data", "csv_base64", "zip_base64",
                                                               "zip_base64", "error"]
    assert routed[4]["error"] == "Invalid base64 ZIP data" and routed[5]["error"] == "No file data provided"
    rows = parse_payload_rows(csv_records(route(reqs)), ["date", "item", "qty"]).collect()
    assert sorted((r["request_id"], r["qty"]) for r in rows) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    listing = scan_archives(route(reqs).filter("request_id = 3").withColumn("archive", F.lit("z.zip")),
                            "archive", "zip_bytes")
    st = {r["member"]: r["status"] for r in listing.collect() if r["member"]}
    assert st["sales_data.csv"] == "ok" and st["d/.h2.csv"] == "ok" and st["Two.CSV"] == "ok"
    assert st["__MACOSX/x.csv"] == "skipped" and st[".h.csv"] == "skipped" and st["readme.txt"] == "skipped"
    assert st["bad.csv"] == "error"


def test_f1_pandas_reference_values(csv_file):
    # the goldens above come from pandas itself; keep them honest
    pdf = pd.read_csv(csv_file(F1, "p.csv"))
    assert round(pdf["Sales"].sum(), 2) == 2777.0 and pdf["Sales"].median() == 455.25


@pytest.mark.parametrize("text", [
    'a,b\n1,"x\ny"\n2,z\n', 'a,b\n"he said ""hi"", ok",1\n', 'a,b\n"C:\\dir\\",1\nx,2\n', 'a,b\nab"c,2\n',
    'sku,v\n12D,1\n7F,2\n', 'a,v\n99999999999999999999,1\n5,2\n', 'a,v\ninf,1\n-Infinity,2\n', 'a,b\n"p,q,r,s",1\n"t"\n',
    'a,b\n1,\n2,NA\n', 'a,b\n\n1,2\n\n'])
def test_csv_reads_like_pandas(spark, csv_file, text):
    path = csv_file(text, "q.csv")
    t, want = read_csv_table(spark, path), pd.read_csv(path)
    assert t.ok and t.df.drop("_row_id").columns == list(want.columns)
    got = [tuple(r) for r in t.df.orderBy("_row_id").drop("_row_id").collect()]
    plain = [tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r) for r in want.itertuples(index=False)]
    assert got == plain


def test_header_names_that_differ_in_case(spark, csv_file):
    t = read_csv_table(spark, csv_file("Sales,sales\n1,2\n", "c.csv"))
    assert [tuple(r) for r in t.df.drop("_row_id").collect()] == [(1, 2)] and t.df.columns[:2] == ["Sales", "sales.1"]


def test_payloads_keep_their_own_header(spark):
    reqs = spark.createDataFrame([(1, "a,b\n1,2\n"), (2, "b,a\n3,4\n"), (3, "b,a\n1,2,3\n")], "request_id int, csv_data string")
    rec = csv_records(route(reqs))
    assert {tuple(r["header"]): r["requests"] for r in payload_headers(rec).collect()} == {("a", "b"): 1, ("b", "a"): 2}
    rows = parse_payload_rows(rec, ["b", "a"]).collect()
    assert [(r["request_id"], r["a"], r["b"]) for r in rows] == [(2, 4, 3)]
    assert [r["request_id"] for r in long_row_issues(rec).collect()] == [3]


def test_damaged_members_are_isolated_and_archives_keep_their_path(spark):
    whole = _zip({"m.csv": "k,v\n1,2\n", "n.csv": "k,v\n" + "1,2\n" * 500})
    broken = bytearray(whole)
    at = bytes(broken).rfind(b"1,2\n1,2\n")
    broken[at:at + 4] = b"9,9\n"
    df = spark.createDataFrame([("p/r.zip", bytearray(whole)), ("q/r.zip", broken)], "path string, content binary")
    members, tables = ingest_archives(spark, df)
    assert {"p/r.zip#m.csv", "p/r.zip#n.csv", "q/r.zip#m.csv"} == set(tables)
    bad = members.filter("status = 'error'").collect()
    assert [(r["archive"], r["member"]) for r in bad] == [("q/r.zip", "n.csv")]
    many = _zip({f"t{i:02d}.csv": "a\n1\n" for i in range(27)})
    listing = spark.createDataFrame([("z.zip", bytearray(many))], "path string, content binary")
    assert scan_archives(listing).filter("kept").count() == 27
    assert scan_archives(listing, max_files=20).filter("kept").count() == 20


@pytest.mark.parametrize("values", [["01/15/2024", "02/01/2024"], ["15/01/2024", "16/02/2024"], ["15-Jan-2024", "16-FEB-2024"],
                                    ["Jan 5, 2024", "bad"], ["2024/1/5", "2024/2/6"], ["20240105", "20240206"],
                                    ["2024-01-05", "01/02/2024"], ["01/15/2024 10:30", "02/01/2024 11:00"]])
def test_dates_take_the_first_values_layout(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "_row_id long, order_date string")
    want = pd.to_datetime(pd.Series(values), errors="coerce")
    assert date_ranges(df).collect()[0]["value"] == f"{want.min()} to {want.max()}"


def test_csv_file_order_across_many_splits(spark, tmp_path):
    # one ~11 MB file with the default 128 MB maxPartitionBytes: Spark still cuts it into
    # ~4 MB splits (openCostInBytes / bytes per core); the row id must follow file order
    n = 250000
    lines = ["k,v"] + [f"{i},{'x' * 40}" for i in range(n)]
    p = tmp_path / "big.csv"
    p.write_text("\n".join(lines) + "\n")
    t = read_csv_table(spark, str(p))
    assert t.df.rdd.getNumPartitions() > 1
    ks = [r["k"] for r in t.df.orderBy("_row_id").select("k").collect()]
    assert ks == list(range(n))
