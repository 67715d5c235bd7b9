"""Registry helpers shared by the check modules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.catalog import TableSet, load_tables


@dataclass
class Check:
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Check] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate check {name}")
        REGISTRY[name] = Check(fn, sql)
        return fn
    return deco


def tables(spark: SparkSession, sf_dir: str, *names: str) -> TableSet:
    return load_tables(spark, sf_dir, list(names) if names else None)


#: rows of one file that a check writes as its input
ROWS_PER_FILE = 500_000


def files_for(df: DataFrame, least: int, rows_per_file: int = ROWS_PER_FILE) -> int:
    """Number of files for the rows of ``df``: at least ``least``, and more as the table grows, so that a writing task stays bounded."""
    return max(least, -(-df.count() // rows_per_file))


def rounded(df: DataFrame, digits: int = 4, skip: tuple[str, ...] = ()) -> DataFrame:
    """Round floating columns so that engine-dependent summation order does not
    change the compared value (the SQL side rounds the same columns).  Columns in
    ``skip`` are exact in both engines (a ratio of two counts) and stay unrounded."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in skip:
            c = F.round(c, digits).alias(f.name)
        out.append(c)
    return df.select(*out)
