"""Intermediate tables and files below the session's shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tabsight.session import scratch_path

#: stands for a null id inside the operators: one document before all others
NULL_ID = -(2 ** 63)


class Stage:
    """A folder of Parquet intermediates: ``put`` writes and rereads (cutting the lineage), ``drop`` removes."""

    def __init__(self, spark: SparkSession, kind: str):
        self.spark = spark
        self.root = scratch_path(spark, kind)
        self._n = 0

    def put(self, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        self._n += 1
        path = f"{self.root}/t{self._n:03d}"
        w = df.write
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stage_path = path
        return out

    def put_counted(self, df: DataFrame, *columns: str) -> tuple[DataFrame, tuple]:
        """``put``, and (rows, checksum of ``columns``) observed while writing."""
        seen = Observation(f"rows{self._n}")
        out = self.put(df.observe(seen, F.count(F.lit(1)).alias("n"),
                                  F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("sum")))
        got = seen.get
        return out, (got["n"], got["sum"])

    def drop(self, *frames: DataFrame) -> None:
        for f in frames:
            remove_path(self.spark, f._stage_path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, in whatever store it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def iid(col: str = "doc_id"):
    """The id as bigint, null ids as NULL_ID."""
    return F.coalesce(F.col(col).cast("bigint"), F.lit(NULL_ID))


def text_tie(col: str = "text"):
    """A hash of the text (null as empty); with the id it tells rows of one id apart, save exact repeats."""
    return F.xxhash64(F.coalesce(F.col(col).cast("string"), F.lit("")))


def from_iid(name: str):
    """Back to the caller's id: NULL_ID is null again."""
    return F.when(F.col(name) != F.lit(NULL_ID), F.col(name))


def open_store(uri: str):
    """(pyarrow file system, path) of a folder URI; works inside tasks for every store that Arrow reads."""
    from pyarrow import fs
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def process_cache() -> dict:
    """One dict per Python worker process; outlives the task, so that tokenizers and word caches are built once."""
    import sys
    import types
    mod = sys.modules.get("_tabsight_llm_process")
    if mod is None:
        mod = sys.modules["_tabsight_llm_process"] = types.ModuleType("_tabsight_llm_process")
        mod.cache = {}
    return mod.cache
