"""Checks of sketch catalogues: approximate distinct counts (P5), sketches stored per file, and the running catalogue of a
stream (S14).  Exact parts are compared as they are; estimates by whether they keep their stated error against exact counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.catalog import DRIVER_TABLES, TableSet
from tabsight.operators.profile import profile_columns
from tabsight.operators.sketches import SketchStore, describe_sketches, distinct_error
from tabsight.session import scratch_path
from tabsight.streaming.running_catalog import run_folder_catalog
from tabsight.suite.base import files_for, register, tables
from tabsight.suite.profile_checks import DRIVER_SCHEMA

RANK_ERROR = 0.04     # three times a sketch's usual rank error


def _within(estimate, exact):
    return F.abs(estimate - exact) <= F.ceil(exact * distinct_error(deviations=5.0))


def _distinct_sql(table: str, columns: list[str]) -> str:
    cells = [f"""SELECT '{table}' AS file_name, '{c}' AS column_name, COUNT(*) AS row_count, COUNT(*) - COUNT({c}) AS null_count,
       COUNT(DISTINCT {c}) AS exact_count, TRUE AS within FROM {table}""" for c in columns]
    return "\nUNION ALL\n".join(cells)


def _against_exact(approx: DataFrame, exact: DataFrame) -> DataFrame:
    exact = exact.select("file_name", "column_name", F.col("unique_count").alias("exact_count"))
    return approx.join(exact, ["file_name", "column_name"]).select(
        "file_name", "column_name", "row_count", "null_count", "exact_count", _within(F.col("unique_count"), F.col("exact_count")).alias("within"))


@register("P5_approximate_distinct_counts", "\nUNION ALL\n".join(_distinct_sql(t, [c for c, _ in DRIVER_SCHEMA[t]]) for t in DRIVER_TABLES))
def p5_approx(spark, sf_dir):
    t = tables(spark, sf_dir)
    return _against_exact(profile_columns(t, approx=True), profile_columns(t, samples=False))


_LINEITEM_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _bounds_sql(where: str = "") -> str:
    rows = [f"""SELECT '{c}' AS column_name, COUNT(*) AS row_count, COUNT(*) - COUNT({c}) AS null_count,
       ROUND(MIN({c})::DOUBLE, 4) AS min_value, ROUND(MAX({c})::DOUBLE, 4) AS max_value, TRUE AS distinct_within, TRUE AS median_within
       FROM lineitem {where}""" for c in _LINEITEM_NUMBERS]
    return "\nUNION ALL\n".join(rows)


def _held_against_rows(catalog: DataFrame, rows: DataFrame) -> DataFrame:
    """Number columns of a catalogue with their bounds, and whether distinct counts and medians keep their stated error."""
    mid = catalog.filter(F.col("column_name").isin(*_LINEITEM_NUMBERS)).withColumn("median", F.col("quantiles")[1])
    medians = mid.agg(*[F.max(F.when(F.col("column_name") == c, F.col("median"))).alias(f"__m_{c}") for c in _LINEITEM_NUMBERS])
    held = rows.select(*_LINEITEM_NUMBERS).crossJoin(F.broadcast(medians))      # one row
    below = [F.avg((F.col(c).cast("double") < F.col(f"__m_{c}")).cast("int")).alias(f"below_{c}") for c in _LINEITEM_NUMBERS]
    upto = [F.avg((F.col(c).cast("double") <= F.col(f"__m_{c}")).cast("int")).alias(f"upto_{c}") for c in _LINEITEM_NUMBERS]
    ranks = held.agg(F.count(F.lit(1)).alias("n"), *below, *upto).filter("n > 0").select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"below_{c}").alias("below"), F.col(f"upto_{c}").alias("upto"))
        for c in _LINEITEM_NUMBERS])).alias("e")).select("e.*")
    exact = profile_columns(TableSet({"t": rows.select(*_LINEITEM_NUMBERS)}), samples=False).select(
        "column_name", F.col("unique_count").alias("exact_count"))
    return mid.join(ranks, "column_name").join(exact, "column_name").select(
        "column_name", "row_count", "null_count", F.round(F.col("min_value").cast("double"), 4).alias("min_value"),
        F.round(F.col("max_value").cast("double"), 4).alias("max_value"), _within(F.col("unique_count"), F.col("exact_count")).alias("distinct_within"),
        ((F.col("below") <= 0.5 + RANK_ERROR) & (F.col("upto") >= 0.5 - RANK_ERROR)).alias("median_within"))


@register("P5_sketch_store_of_files", _bounds_sql())
def p5_store(spark, sf_dir):
    """Sketches of lineitem's files: those of the first returnflag first, then only the files that came later."""
    rows = tables(spark, sf_dir, "lineitem").plain("lineitem")
    data = scratch_path(spark, "sketch-data")
    first = F.col("l_returnflag") == "A"
    rows.filter(first).write.parquet(f"{data}/a")
    store = SketchStore(spark, data, scratch_path(spark, "sketches"), schema=rows.schema)
    store.update()
    rows.filter(~first | F.col("l_returnflag").isNull()).write.parquet(f"{data}/b")
    store.update()
    return _held_against_rows(describe_sketches(store.sketches()), rows)


@register("S14_running_catalog_of_a_stream", _bounds_sql())
def s14_running(spark, sf_dir):
    """lineitem arrives as eight files, three a micro-batch (as many more of both as the table is larger); the state after the last
    batch describes the whole table."""
    rows = tables(spark, sf_dir, "lineitem").plain("lineitem")
    data = scratch_path(spark, "stream-data")
    files = files_for(rows, 8)
    rows.repartitionByRange(files, "l_orderkey").write.parquet(data)
    return _held_against_rows(run_folder_catalog(spark, data, rows.schema, scratch_path(spark, "stream-catalog"),
                                                 max_files_per_trigger=-(-3 * files // 8)), rows)


_BY_SOURCE = [f"""SELECT source, '{c}' AS column_name, COUNT(*) AS row_count, COUNT(*) - COUNT({c}) AS null_count,
       COUNT(DISTINCT {c}) AS exact_count, TRUE AS within FROM documents GROUP BY source""" for c in ("doc_id", "text", "lang", "n_chars")]


@register("S14_running_catalog_by_source", "\nUNION ALL\n".join(_BY_SOURCE))
def s14_by_source(spark, sf_dir):
    """One catalogue per source of documents, kept by one stream."""
    docs = tables(spark, sf_dir, "documents").plain("documents")
    data = scratch_path(spark, "stream-data")
    files = files_for(docs, 4, rows_per_file=20_000)      # rows of whole texts
    docs.repartitionByRange(files, "doc_id").write.parquet(data)
    got = run_folder_catalog(spark, data, docs.schema, scratch_path(spark, "stream-catalog"), by=["source"],
                             max_files_per_trigger=-(-files // 2))
    exact = reduce(DataFrame.unionByName, [
        docs.groupBy("source").agg(F.count_distinct(c).alias("exact_count")).withColumn("column_name", F.lit(c))
        for c in ("doc_id", "text", "lang", "n_chars")]).withColumnRenamed("source", "s").withColumnRenamed("column_name", "c")
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("column_name") == F.col("c"))
    return got.join(exact, same).select(
        "source", "column_name", "row_count", "null_count", "exact_count", _within(F.col("unique_count"), F.col("exact_count")).alias("within"))
