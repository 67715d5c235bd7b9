"""File routing and issues (S13, S17, S18, P16) and sinks (K1-K5)."""

import glob
import io
import json
import os
import zipfile

from tabsight.sinks.writers import records, report_prefix, write_report_bundle, write_results
from tabsight.sources.files import combine, ingest_paths, outcome_summary, path_table


def test_ingest_paths_routes_and_reports(spark, tmp_path):
    good = tmp_path / "Sales Data.csv"
    good.write_text("a,b\n1,x\n2,y\n")
    long_row = tmp_path / "bad.csv"
    long_row.write_text("a,b\n1,2,3\n")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as zf:
        zf.writestr("m1.csv", "k,v\n1,2\n")
        zf.writestr("broken.csv", b"\xff\xfe")
    (tmp_path / "pack.zip").write_bytes(buf.getvalue())
    (tmp_path / "notes.txt").write_text("hello")
    paths = [str(good), str(long_row), str(tmp_path / "pack.zip"), str(tmp_path / "notes.txt")]
    res = ingest_paths(spark, paths)
    pack = "file:" + str(tmp_path / "pack.zip")
    assert set(res.tables) == {"Sales Data.csv", f"{pack}#m1.csv"}
    sev = {(f, s) for f, s, _ in res.issues}
    assert ("notes.txt", "error") in sev and (f"{pack}#broken.csv", "error") in sev
    assert any(f == "bad.csv" and s == "error" for f, s in sev)
    assert not res.success()
    summary = outcome_summary(res.issues_df(spark), len(res.tables)).collect()[0]
    assert summary["errors"] == 3 and summary["has_errors"] and not summary["success"]
    both = combine([res, res])
    assert len(both.issues) == 2 * len(res.issues)
    names = {r["file_name"]: (r["kind"], r["table_name"]) for r in path_table(spark, paths).collect()}
    assert names["Sales Data.csv"] == ("csv", "sales_data") and names["notes.txt"] == ("unknown", "notes")


def test_write_results_manifest_and_bundle(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", 2.5)], "k string, v double")
    empty = df.filter("v > 100")
    prefix, rid = report_prefix(str(tmp_path))
    assert "/reports/" in prefix and rid.startswith("req_") and len(rid.split("_")[-1]) == 8
    manifest = {r["result_key"]: r for r in write_results(spark, {"r1": df, "r2": empty}, prefix, rid).collect()}
    assert not os.path.exists(f"{prefix}/data/r2_data.csv")
    assert manifest["r1"]["rows"] == 2 and manifest["r1"]["written"] and not manifest["r2"]["written"]
    back = spark.read.option("header", True).csv(f"{prefix}/data/r1_data.csv")
    assert back.columns == ["k", "v"] and back.count() == 2
    assert glob.glob(os.path.join(prefix, "manifest.json", "*.json"))
    out = write_report_bundle(spark, "t", df, str(tmp_path / "bundle"))
    assert spark.read.parquet(out["original_data"]).count() == 2
    stats = spark.read.option("header", True).csv(out["summary_statistics"]).collect()
    assert [r["statistic"] for r in stats] == ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]
    recs = [json.loads(r["record"]) for r in records(df).collect()]
    assert recs == [{"k": "a", "v": 1.5}, {"k": "b", "v": 2.5}]


def test_streaming_ingest_reads_csv_and_zip(spark, tmp_path):
    from tabsight.streaming.folder_ingest import run_folder_ingest
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.csv").write_text("k,v\n1,2\n3,4\n")
    (inbox / "long.csv").write_text("k,v\n1,2,3\n")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as zf:
        zf.writestr("m.csv", "x\n1\n")
    (inbox / "p.zip").write_bytes(buf.getvalue())
    prof = run_folder_ingest(spark, str(inbox), str(tmp_path / "out"), max_files_per_trigger=2)
    assert {r["source_name"] for r in prof.select("source_name").distinct().collect()} == {"a.csv", "p.zip#m.csv"}
    assert spark.read.parquet(str(tmp_path / "out" / "issues")).filter("severity = 'error'").count() == 1
