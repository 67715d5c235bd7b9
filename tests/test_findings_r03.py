"""Steps whose cost or size grew faster than the input: many archive members, staged records, refuted column pairs, files written."""

import pytest
from pyspark.sql import functions as F

from tabsight.catalog import ROW_ID, with_text_row_id
from tabsight.functions.dates import parse_like
from tabsight.operators import composite
from tabsight.sources.csv import infer_types, union_tables
from tabsight.sources.payloads import csv_records, parse_payload_rows
from tabsight.sources.zipfiles import ingest_archives
from tabsight.suite.base import files_for


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_many_members_are_one_scan(spark):
    """300 members, one of them with a fraction and one with a missing value; the table of all has no union and no member lost."""
    import io
    import zipfile
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as zf:
        for i in range(300):
            zf.writestr(f"m{i}.csv", f"a,b\n{i},x{i}\n" + (f"{i}.5,y\n" if i == 7 else ",\n" if i == 9 else ""))
    archives = spark.createDataFrame([("p/z.zip", bytearray(buf.getvalue()))], "path string, content binary")
    _, read = ingest_archives(spark, archives)
    assert len(read) == 300
    both = union_tables(read.values())
    assert "Union" not in _plan(both) and both.schema["a"].dataType.simpleString() == "double"
    want = [(float(i), f"x{i}") for i in range(300)] + [(7.5, "y"), (None, None)]
    assert sorted(map(str, want)) == sorted(str((r["a"], r["b"])) for r in both.collect())
    few = [read["p/z.zip#m7.csv"], read["p/z.zip#m8.csv"]]
    assert sorted((r["a"], r["b"]) for r in union_tables(few).collect()) == [(7.0, "x7"), (7.5, "y"), (8.0, "x8")]
    assert [(r["a"], r["b"]) for r in read["p/z.zip#m8.csv"].df.collect()] == [(8, "x8")]
    assert union_tables([]) is None


@pytest.mark.parametrize("n", [3, 300])
def test_text_rows_are_numbered_in_file_order(spark, tmp_path, n):
    for i in range(n):
        (tmp_path / f"f{i:03d} +%.txt").write_text(f"{i:03d}a\n{i:03d}b\n")
    rows = with_text_row_id(spark.read.text(str(tmp_path)))
    assert [r["value"] for r in rows.orderBy(ROW_ID).collect()] == [f"{i:03d}{x}" for i in range(n) for x in "ab"]
    assert rows.schema[ROW_ID].dataType.simpleString() == "decimal(38,0)" and len(_plan(rows)) < 20_000


def test_free_layouts_build_no_word_iterator(spark):
    """``lower`` inside a bound expression is interpreted, with a title-case iterator for every value."""
    df = spark.createDataFrame([("01/02/2024 12:05 AM",), ("01/02/2024 1:05 pm",), ("2-FEB-24",), ("13:10",)], "v string")
    got = df.select(parse_like(F.col("v"), "01/02/2024 12:05 AM").alias("p"))
    assert "lower(" not in _plan(got)
    day = [str(r["p"]) for r in got.collect()]
    assert day[:3] == ["2024-01-02 00:05:00", "2024-01-02 13:05:00", "2024-02-02 00:00:00"] and day[3].endswith(" 13:10:00")


def test_pairs_that_are_no_key_do_not_move_all_rows(spark, monkeypatch):
    seen, real = [], composite._distinct_counts
    monkeypatch.setattr(composite, "_distinct_counts", lambda df, sets, types: seen.append(sets) or real(df, sets, types))
    df = spark.range(40_000).select((F.col("id") % 200).alias("a"), F.floor(F.col("id") / 200).alias("b"),
                                    F.pmod(F.xxhash64("id"), F.lit(300)).alias("c"))
    assert composite.table_keys(df) == [("a", "b")]
    assert [s for sets in seen for s in sets if len(s) > 1] == [("a", "b")]


def test_payload_records_are_parsed_once(spark):
    parsed = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            parsed.add(len(pdf))
            yield pdf

    requests = spark.createDataFrame([(i, f"a,b\n{i},x\n{i}.5,y\n" + ("1,2,3\n" if i == 3 else "")) for i in range(6)], "request_id long, csv_text string")
    got = parse_payload_rows(csv_records(requests.mapInPandas(count, requests.schema)), ["a", "b"])
    assert sorted(r["a"] for r in got.collect()) == sorted(x for i in range(6) if i != 3 for x in (i, i + 0.5))
    assert parsed.value == 6


def test_written_files_grow_with_the_rows(spark):
    assert files_for(spark.range(1_001), 5, rows_per_file=100) == 11 and files_for(spark.range(10), 5, rows_per_file=100) == 5


@pytest.mark.parametrize("values, kind", [
    (["9223372036854775807", " -9223372036854775808 ", "0000000000000000000000012"], "int"), (["9223372036854775808", "1"], "string"),
    (["123456789012345678901", "1"], "string"), (["1", "2.5", None], "float"), (["1", None], "float"), (["true", "False"], "bool"),
    (["1", "true"], "string"), (["12D"], "string"), ([None], "float")])
def test_types_by_classified_values(spark, values, kind):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r["inferred"] for r in infer_types(df, ["v"]).collect()] == [kind]
    assert "rlike" in _plan(infer_types(df, ["v"])).lower()
