"""File-level ingest: routing by path (S13, S15, S16), issue reports (S17), union of
per-file outcomes (S18) and the quick line/column summary of secondary files (S19)."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.functions.names import base_name, file_kind, logical_table_name

ISSUE_SCHEMA = "file string, severity string, message string"


def path_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    """S13/S15/S16 for a list of paths: (path, file_name, kind, table_name)."""
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    name = base_name(F.col("path"))
    return df.select("path", name.alias("file_name"), file_kind(name).alias("kind"),
                     logical_table_name(name).alias("table_name"))


@dataclass
class IngestResult:
    """Tables read from a set of files plus the issue rows."""
    tables: dict = field(default_factory=dict)          # name -> CsvTable
    issues: list[tuple[str, str, str]] = field(default_factory=list)

    def issues_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.issues, ISSUE_SCHEMA)

    def success(self) -> bool:
        """The run succeeds when at least one table was read and no file failed."""
        return bool(self.tables) and not any(sev == "error" for _, sev, _ in self.issues)

    def add(self, name: str, table) -> None:
        self.issues.extend(table.issues)
        if table.ok:
            self.tables[name] = table


def ingest_paths(spark: SparkSession, paths: list[str], workers: int = 8) -> IngestResult:
    """Read every path by its kind (csv -> CSV reader, zip -> archive ingest); any other extension, and any file
    that cannot be read, is an error for that file and the run goes on (S17).

    CSV files' jobs run ``workers`` at a time, all ZIP archives share one ingest.  Archive members are keyed
    ``<archive path>#<member>``, CSV files by their name, or by their path when two have one name."""
    from concurrent.futures import ThreadPoolExecutor

    from tabsight.sources.csv import CsvTable, read_csv_table
    from tabsight.sources.zipfiles import ingest_archive_files
    res, csvs, zips = IngestResult(), [], []
    names = [os.path.basename(p.rstrip("/")) for p in paths]
    for p, fname in zip(paths, names):
        kind = fname.rsplit(".", 1)[-1].lower() if "." in fname else ""
        if kind in ("csv", "zip"):
            (csvs if kind == "csv" else zips).append((p, fname if names.count(fname) == 1 else p))
        else:
            res.issues.append((fname, "error", f"Unsupported file type: {fname}"))

    def read(item):
        try:
            return read_csv_table(spark, item[0], name=item[1])
        except PySparkException as e:
            return CsvTable(None, {}, [(item[1], "error", str(e).split("\n")[0])])

    with ThreadPoolExecutor(max(1, workers)) as pool:
        for (_, name), table in zip(csvs, pool.map(read, csvs)):
            res.add(name, table)
    if zips:
        members, tables = ingest_archive_files(spark, [p for p, _ in zips])
        for r in members.filter(F.col("status").isin("error", "warning")).collect():
            res.issues.append((f"{r['archive']}#{r['member']}" if r["member"] else r["archive"], r["status"], r["message"]))
        for name, t in tables.items():
            res.add(name, t)
    return res


def combine(results: list[IngestResult]) -> IngestResult:
    """Union of per-file outcomes."""
    out = IngestResult()
    for r in results:
        out.tables.update(r.tables)
        out.issues.extend(r.issues)
    return out


def outcome_summary(issues: DataFrame, tables_read: int) -> DataFrame:
    """S18/P16 as an aggregate: totals, error and warning counts, success flag."""
    return issues.agg(
        F.lit(tables_read).alias("total_reports"),
        F.count(F.when(F.col("severity") == "error", 1)).alias("errors"),
        F.count(F.when(F.col("severity") == "warning", 1)).alias("warnings"),
    ).select("*", (F.col("errors") > 0).alias("has_errors"), (F.col("warnings") > 0).alias("has_warnings"),
             ((F.col("errors") == 0) & (F.col("total_reports") > 0)).alias("success"))


def quick_text_summary(spark: SparkSession, path: str) -> DataFrame:
    """Per text file, data rows = lines - 1 and columns = header split on ','.

    Counted the reference's way (no quote handling) from ``spark.read.text``: one
    partial aggregate per file; the header is the line at the smallest position."""
    from tabsight.catalog import text_row_id
    raw = spark.read.text(path)
    lines = raw.select(F.col("_metadata.file_path").alias("file"), "value",
                       text_row_id(raw).alias("pos"))
    return (lines.groupBy("file")
                 .agg(F.count(F.lit(1)).alias("lines"), F.min_by("value", "pos").alias("header"))
                 .select(base_name(F.col("file")).alias("filename"),
                         (F.col("lines") - 1).alias("rows"),
                         F.when(F.length("header") > 0, F.size(F.split("header", ","))).otherwise(0).alias("columns")))

