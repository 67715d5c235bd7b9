"""Result sinks (K1-K6): CSV per result, dated report layout, manifest, report
bundle, JSON records.

Writes are Spark writes (parallel, commit protocol); row counts for the manifest
come from ``DataFrame.observe`` during the same write, so nothing is computed
twice and nothing is collected.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tabsight.session import drop_path

#: quotes are doubled and backslashes are ordinary, as CSV readers other than Spark expect; text stays as it is
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False,
               "ignoreTrailingWhiteSpace": False}

MANIFEST_SCHEMA = ("request_id string, created_at string, result_key string, path string, rows long, "
                   "columns array<string>, written boolean")


def request_id(now: _dt.datetime | None = None) -> str:
    """K2: ``req_HHMMSS_<8 hex>``."""
    now = now or _dt.datetime.now(_dt.timezone.utc)
    return f"req_{now:%H%M%S}_{uuid.uuid4().hex[:8]}"


def report_prefix(root: str, rid: str | None = None, now: _dt.datetime | None = None) -> tuple[str, str]:
    """K2: ``<root>/reports/<YYYY-MM-DD>/<request id>`` and the request id."""
    now = now or _dt.datetime.now(_dt.timezone.utc)
    rid = rid or request_id(now)
    return f"{root.rstrip('/')}/reports/{now:%Y-%m-%d}/{rid}", rid


def write_results(spark: SparkSession, results: dict[str, DataFrame], prefix: str, rid: str,
                  fmt: str = "csv") -> DataFrame:
    """K1 + K3: one ``<key>_data.csv`` folder per result under ``prefix/data`` (header,
    columns in result order), then ``prefix/manifest.json``.  A result with no rows is
    listed with ``written = false`` (the reference uploads nothing for it)."""
    created = _dt.datetime.now(_dt.timezone.utc).isoformat()
    entries = []
    for key, df in results.items():
        obs = Observation(f"rows_{key}")
        path = f"{prefix}/data/{key}_data.{fmt}"
        observed = df.observe(obs, F.count(F.lit(1)).alias("rows"))
        w = observed.write.mode("overwrite")
        if fmt == "csv":
            w.options(**CSV_OPTIONS).csv(path)
        elif fmt == "json":
            w.json(path)
        else:
            w.parquet(path)
        n = obs.get.get("rows", 0)
        if n == 0:
            drop_path(spark, path)
        entries.append((rid, created, key, path, int(n), list(df.columns), n > 0))
    manifest = spark.createDataFrame(entries, MANIFEST_SCHEMA)
    manifest.coalesce(1).write.mode("overwrite").json(f"{prefix}/manifest.json")
    return manifest


def records(df: DataFrame, column: str = "record") -> DataFrame:
    """K5 + K6: one JSON object per row (JSON-safe values: numbers, strings, ISO times)."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias(column))


def write_report_bundle(spark: SparkSession, name: str, df: DataFrame, prefix: str) -> dict[str, str]:
    """K4: the reference's three sheets as datasets under one report folder:
    original data (Parquet), summary statistics (describe) and insights (CSV)."""
    from tabsight.operators.describe import describe
    from tabsight.operators.insights import insights_frame, recommendations_frame
    out = {"original_data": f"{prefix}/{name}/original_data",
           "summary_statistics": f"{prefix}/{name}/summary_statistics",
           "insights": f"{prefix}/{name}/insights",
           "recommendations": f"{prefix}/{name}/recommendations"}
    df.write.mode("overwrite").parquet(out["original_data"])
    df = spark.read.parquet(out["original_data"])    # the sheets below read the written copy, not the source again
    describe(df).write.mode("overwrite").options(**CSV_OPTIONS).csv(out["summary_statistics"])
    insights_frame(name, df).orderBy("seq").drop("seq").write.mode("overwrite").options(**CSV_OPTIONS) \
        .csv(out["insights"])
    recommendations_frame(df).write.mode("overwrite").options(**CSV_OPTIONS).csv(out["recommendations"])
    return out
