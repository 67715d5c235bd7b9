"""A running catalogue over a stream (Structured Streaming state instead of one profile per batch).

The stream's state holds one row per group (one in all without ``by``): exact row and null counts, bounds, and the mergeable
sketches of :mod:`tabsight.operators.sketches`.  Its size depends on groups and columns only, so no watermark is needed, and rows
are combined in the tasks before the state's shuffle.  After every micro-batch the whole catalogue is written to
``batch_id=<n>`` (overwrite): a batch that is replayed after a failure starts from the state before it and writes the same folder.
Readers take the last folder that was finished; older ones than ``keep`` batches are removed.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tabsight.operators.sketches import LG_K, describe_sketches, long_sketches, wide_sketches
from tabsight.session import drop_path, scratch_path


def _finished(spark: SparkSession, out_dir: str) -> list[int]:
    """Batch ids whose catalogue was written to the end, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out_dir)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = []
    for entry in fs.listStatus(path):
        m = re.fullmatch(r"batch_id=(\d+)", entry.getPath().getName())
        if m and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")):
            found.append(int(m.group(1)))
    return sorted(found)


def start_running_catalog(stream: DataFrame, out_dir: str, checkpoint: str | None = None, by: list[str] | None = None,
                          available_now: bool = True, keep: int = 2, lg_k: int = LG_K) -> StreamingQuery:
    """Keep the catalogue of a streaming DataFrame up to date; with ``by`` one catalogue per group (for example per source)."""
    spark, by = stream.sparkSession, list(by or [])
    columns = [c for c in stream.columns if c not in by]
    wide = wide_sketches(stream, columns, [F.col(f"`{b}`") for b in by], lg_k)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        long_sketches(batch, stream.schema, columns, by).write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")
        for old in [b for b in _finished(batch.sparkSession, out_dir) if b <= batch_id - keep]:
            drop_path(batch.sparkSession, f"{out_dir}/batch_id={old}")

    w = (wide.writeStream.outputMode("complete").foreachBatch(on_batch)
         .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-checkpoint")))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def running_sketches(spark: SparkSession, out_dir: str) -> DataFrame | None:
    """Sketch rows after the last finished batch (None before the first)."""
    done = _finished(spark, out_dir)
    return spark.read.parquet(f"{out_dir}/batch_id={done[-1]}") if done else None


def running_catalog(spark: SparkSession, out_dir: str, by: list[str] | None = None) -> DataFrame | None:
    """The catalogue after the last finished batch."""
    rows = running_sketches(spark, out_dir)
    return None if rows is None else describe_sketches(rows, by)


def run_folder_catalog(spark: SparkSession, input_dir: str, schema: T.StructType, out_dir: str, checkpoint: str | None = None,
                       by: list[str] | None = None, max_files_per_trigger: int = 1, **kw) -> DataFrame | None:
    """Take in the Parquet files that lie in a folder now, and return the catalogue of all files taken in so far."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(input_dir)
    start_running_catalog(stream, out_dir, checkpoint, by, available_now=True, **kw).awaitTermination()
    return running_catalog(spark, out_dir, by)
