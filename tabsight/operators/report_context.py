"""Catalogue assembly and result context.

Everything here is a composition of the profile, relationship and plan outputs:
no extra pass over the data beyond the jobs those operators already run.  Rows of
different tables are carried as JSON records (one schema for all tables).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.catalog import ROW_ID, TableSet, data_columns
from tabsight.operators.inclusion import inclusion_dependencies, joinable_columns
from tabsight.operators.profile import head_tail, profile_columns, profile_tables
from tabsight.functions.names import DATE_NAME_KEYWORDS


def sample_rows(tables: TableSet, n_head: int = 5, n_tail: int = 5) -> DataFrame:
    """P9 for many tables: (table_name, part, pos, record) with each row as JSON (top-k per table)."""
    parts = []
    for name in tables:
        scan = tables.scan(name)
        ht = head_tail(tables[name] if scan is None else scan, n_head, n_tail, scan)
        cols = [c for c in ht.columns if c not in ("part", "pos")]
        parts.append(ht.select(F.lit(name).alias("table_name"), "part", "pos",
                               F.to_json(F.struct(*[F.col(f"`{c}`") for c in cols])).alias("record")))
    return reduce(DataFrame.unionByName, parts)


def extract_catalog(tables: TableSet) -> dict[str, DataFrame]:
    """The full catalogue the planner sees, as DataFrames keyed by part."""
    cols = profile_columns(tables)
    return {
        "tables": profile_tables(tables),
        "columns": cols,
        "primary_key_candidates": cols.filter("is_pk_candidate").select("file_name", "table_name", "column_name"),
        "foreign_key_candidates": inclusion_dependencies(tables),
        "joinable_columns": joinable_columns(tables),
        "sample_data": sample_rows(tables),
    }


def light_catalog(tables: TableSet, columns: DataFrame | None = None) -> DataFrame:
    """Per report table (name cut at the first '.'): column, raw dtype, unique count, samples.
    Pass ``columns`` (a profile already built, e.g. from :func:`extract_catalog`) to reuse it."""
    cols = profile_columns(tables) if columns is None else columns
    return cols.select(F.substring_index("file_name", ".", 1).alias("report"), "column_name", "dtype",
                       "unique_count", "sample_values")


def semantic_types(df: DataFrame) -> DataFrame:
    """(column, semantic_type) from the type of the FIRST row's value, as the reference
    does: numbers and bools are quantitative (NaN is a float), a string in a column
    named like a date/time is temporal, anything else (incl. a missing string) nominal."""
    first = df.limit(1)
    entries = []
    for f in df.schema.fields:
        if f.name == ROW_ID:
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            kind = F.lit("quantitative")
        elif isinstance(f.dataType, T.StringType) and any(k in f.name.lower() for k in DATE_NAME_KEYWORDS):
            kind = F.when(c.isNotNull(), F.lit("temporal")).otherwise(F.lit("nominal"))
        else:
            kind = F.lit("nominal")
        entries.append(F.struct(F.lit(f.name).alias("column"), kind.alias("semantic_type")))
    return first.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def result_context(results: dict, sample: int = 3) -> DataFrame:
    """Per op result: key, operation, row count, columns, first ``sample`` rows (JSON)
    and semantic types.  Results are the executor's OpResults (ordered output)."""
    parts = []
    for key, r in results.items():
        if r.df is None:
            continue
        df = r.ordered()
        cols = data_columns(df)
        firsts = df.limit(sample).select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in cols])).alias("j"))
        sem = semantic_types(r.df).agg(F.map_from_entries(F.collect_list(F.struct("column", "semantic_type")))
                                       .alias("types"))
        rows = r.df.agg(F.count(F.lit(1)).alias("row_count"))
        samples = firsts.agg(F.collect_list("j").alias("sample_data"))
        # one-row frames combined with scalar subqueries (no join of single rows)
        parts.append(rows.select(F.lit(key).alias("key"), F.lit(r.operation).alias("operation"), "row_count",
                                 F.array(*[F.lit(c) for c in cols]).cast("array<string>").alias("columns"),
                                 samples.scalar().alias("sample_data"), sem.scalar().alias("semantic_types")))
    return reduce(DataFrame.unionByName, parts)
