"""Request payload columns (S3-S7): inline CSV text, base64 CSV, ZIP bytes, base64 ZIP.

A request table has one row per request with optional payload columns
``csv_data``, ``csv_base64``, ``zip_data``, ``zip_base64``.  Routing (S7) is a
``when`` chain.  CSV payloads are cut into records by a CSV reader inside the task that holds the
request (quoted line breaks and doubled quotes included); every request keeps its own header and
types.  ZIP payloads become binary archives for :mod:`tabsight.sources.zipfiles`.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.session import scratch_path
from tabsight.sources.csv import _type_rows, cast_to, dedupe_header, na_to_null, type_stats

# Payload keys in the order the request handler tries them.
PAYLOAD_KEYS = ("csv_data", "csv_base64", "zip_data", "zip_base64")


def _has(df: DataFrame, c: str) -> Column:
    return F.col(c).isNotNull() if c in df.columns else F.lit(False)


def route(requests: DataFrame) -> DataFrame:
    """``payload_kind`` by key precedence csv_data -> csv_base64 -> zip_data ->
    zip_base64, else ``error``; plus ``csv_text`` / ``zip_bytes`` decoded columns.

    S4: base64 CSV is decoded as UTF-8 (other bytes: a null text and an error message); S5: a ZIP sent as text is turned back into
    bytes with ISO-8859-1 (every byte value survives); S6: invalid base64 gives a
    null archive and an error message."""
    kind = F.lit("error")
    for k in reversed(PAYLOAD_KEYS):
        kind = F.when(_has(requests, k), F.lit(k)).otherwise(kind)
    out = requests.withColumn("payload_kind", kind)
    csv_text = F.lit(None).cast("string")
    if "csv_base64" in out.columns:
        decoded = F.try_to_binary(F.col("csv_base64"), F.lit("base64"))
        csv_text = F.when((F.col("payload_kind") == "csv_base64") & F.is_valid_utf8(decoded.cast("string")),
                          decoded.cast("string"))
    if "csv_data" in out.columns:
        csv_text = F.when(F.col("payload_kind") == "csv_data", F.col("csv_data")).otherwise(csv_text)
    zip_bytes = F.lit(None).cast("binary")
    if "zip_base64" in out.columns:
        zip_bytes = F.when(F.col("payload_kind") == "zip_base64",
                           F.try_to_binary(F.col("zip_base64"), F.lit("base64")))
    if "zip_data" in out.columns:
        zip_bytes = F.when(F.col("payload_kind") == "zip_data",
                           F.encode(F.col("zip_data"), "ISO-8859-1")).otherwise(zip_bytes)
    error = (F.when(F.col("payload_kind") == "error", F.lit("No file data provided"))
              .when((F.col("payload_kind") == "zip_base64") & F.col("zip_bytes").isNull(),
                    F.lit("Invalid base64 ZIP data"))
              .when((F.col("payload_kind") == "csv_base64") & F.col("csv_text").isNull(),
                    F.lit("Invalid base64 CSV data")))
    return (out.withColumn("csv_text", csv_text).withColumn("zip_bytes", zip_bytes)
               .withColumn("error", error))


RECORD_SCHEMA = "request_id {t}, line_no long, header array<string>, fields array<string>"


def csv_records(requests: DataFrame, id_col: str = "request_id", text_col: str = "csv_text") -> DataFrame:
    """S3: one row per data record of every CSV payload: (id, line_no from 1, header, fields as read).

    Blank lines are skipped; ``header`` is the request's own first record (duplicate names numbered)."""
    kind = requests.schema[id_col].dataType.simpleString()

    def run(batches):
        import csv
        import io
        import sys
        csv.field_size_limit(min(sys.maxsize, 2 ** 31 - 1))
        for pdf in batches:
            held, size = [], 0
            for rid, text in zip(pdf[id_col], pdf[text_col]):
                if text is None:
                    continue
                header = None
                for n, fields in enumerate(csv.reader(io.StringIO(text, newline=""))):
                    if not fields or (len(fields) == 1 and not fields[0].strip()):
                        continue
                    if header is None:
                        header = dedupe_header(fields)
                        continue
                    held.append((rid, n, header, fields))
                    size += sum(map(len, fields)) + 50
                    if size > 8 << 20:
                        yield pd.DataFrame(held, columns=["request_id", "line_no", "header", "fields"])
                        held, size = [], 0
            if held:
                yield pd.DataFrame(held, columns=["request_id", "line_no", "header", "fields"])

    return (requests.filter(F.col(text_col).isNotNull()).select(id_col, text_col)
            .mapInPandas(run, RECORD_SCHEMA.format(t=kind)).withColumnRenamed("request_id", id_col))


def long_row_issues(records: DataFrame, id_col: str = "request_id") -> DataFrame:
    """(id, severity, message) per request with a record of more fields than its header."""
    bad = records.filter(F.size("fields") > F.size("header")).groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("header")).alias("k"))
    return bad.select(id_col, F.lit("error").alias("severity"), F.concat(
        F.lit("Error tokenizing data: "), F.col("n").cast("string"),
        F.lit(" row(s) have more fields than the header ("), F.col("k").cast("string"), F.lit(")")).alias("message"))


def payload_headers(records: DataFrame, id_col: str = "request_id") -> DataFrame:
    """(header, requests): the table layouts among the payloads."""
    return records.groupBy("header").agg(F.count_distinct(id_col).alias("requests"))


def payload_cells(records: DataFrame, id_col: str = "request_id") -> DataFrame:
    """Long form (id, line_no, ordinal, column, value): missing fields and NA tokens are null."""
    cells = records.select(id_col, "line_no", F.posexplode("header").alias("ordinal", "column"), "fields")
    value = F.get("fields", F.col("ordinal"))
    return cells.select(id_col, "line_no", "ordinal", "column", na_to_null(value).alias("value"))


def payload_types(records: DataFrame, id_col: str = "request_id") -> DataFrame:
    """S2 per request: (id, ordinal, column, inferred), from all records of that request."""
    stats = type_stats(payload_cells(records, id_col), ["value"], [id_col, "ordinal", "column"])
    return stats.select(id_col, "ordinal", "column", _type_rows(["value"])).select(id_col, "ordinal", "column", "e.inferred")


def parse_payload_rows(records: DataFrame, header: list[str], id_col: str = "request_id",
                       kinds: dict[str, str] | None = None) -> DataFrame:
    """The payloads laid out as ``header`` as one typed table (id, line_no, columns).

    Requests with another header, or with a record longer than it, are left out (see :func:`long_row_issues`).
    ``kinds`` (column -> int/float/bool/string) defaults to what all these requests' values allow.

    The records are read several times: they are written once below the checkpoint folder, so that the requests are decoded
    and parsed once."""
    names = dedupe_header(header)
    path = f"{scratch_path(records.sparkSession, 'payload-records')}/rows"
    chosen = records.filter(F.col("header") == F.array(*[F.lit(n) for n in names])).select(id_col, "line_no", "fields")
    chosen.write.parquet(path)
    mine = records.sparkSession.read.schema(chosen.schema).parquet(path)
    bad = mine.filter(F.size("fields") > len(names)).select(id_col).distinct()
    mine = mine.join(bad, id_col, "left_anti")
    strings = mine.select(id_col, "line_no", *[na_to_null(F.get("fields", F.lit(i))).alias(n) for i, n in enumerate(names)])
    if kinds is None:
        from tabsight.sources.csv import infer_types
        kinds = {r["column_name"]: r["inferred"] for r in infer_types(strings, names).collect()}
    return strings.select(id_col, "line_no", *[cast_to(F.col(f"`{n}`"), kinds[n]).alias(n) for n in names])
