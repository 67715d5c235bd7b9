"""Event-driven ingest of files arriving in a folder (Structured Streaming).

The reference handles one storage event and only its first record.  Here a
file-source stream lists new ``*.csv`` and ``*.zip`` files (``binaryFile`` with the content
column pruned, so only paths move), ``maxFilesPerTrigger`` bounds each micro-batch,
and ``foreachBatch`` reads the batch's files by kind, profiles the tables that were read without
an error and writes the profile and the issues under ``batch_id=<n>`` (overwrite, so a
replayed batch after a failure writes the same output once; a batch without a good table leaves an
empty profile).  The stream's
checkpoint lives in the shared checkpoint folder.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabsight.catalog import TableSet
from tabsight.session import scratch_path

# The schema of Spark's binaryFile source (a stream needs it up front).
BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


PROFILE_SCHEMA = ("file_name string, table_name string, column_name string, ordinal int, data_type string, dtype string, "
                  "nullable boolean, null_count long, unique_count long, distinct_value_ratio double, min_value string, "
                  "max_value string, sample_values array<string>, is_pk_candidate boolean, row_count long, "
                  "source_path string, source_name string")


def process_files(spark: SparkSession, paths: list[str], out_dir: str, batch_id: int) -> None:
    """Profile every good table of one micro-batch (each file or archive member is its own table)."""
    from tabsight.operators.profile import profile_columns
    from tabsight.sources.files import ingest_paths
    from tabsight.sources.zipfiles import release
    read = ingest_paths(spark, paths)
    by_name = {os.path.basename(p): p for p in paths}
    target = f"{out_dir}/profile/batch_id={batch_id}"
    prof = spark.createDataFrame([], PROFILE_SCHEMA)
    if read.tables:
        # all tables of the batch in one profile job (one value-count shuffle)
        frames = {by_name.get(name, name): t.df for name, t in read.tables.items()}
        got = profile_columns(TableSet(frames), samples=True)
        prof = got.withColumn("source_path", F.col("file_name")).withColumn(
            "source_name", F.regexp_extract("file_name", r"([^/]+)$", 1))
    prof.write.mode("overwrite").parquet(target)
    spark.createDataFrame(read.issues, "file string, severity string, message string") \
        .write.mode("overwrite").parquet(f"{out_dir}/issues/batch_id={batch_id}")
    release(spark, read.tables)


def start_folder_ingest(spark: SparkSession, input_dir: str, out_dir: str, checkpoint: str | None = None,
                        max_files_per_trigger: int = 1, available_now: bool = True,
                        glob: str = "*.{csv,CSV,zip,ZIP}") -> StreamingQuery:
    files: DataFrame = (spark.readStream.format("binaryFile")
                        .schema(BINARY_FILE_SCHEMA)
                        .option("pathGlobFilter", glob)
                        .option("recursiveFileLookup", "true")
                        .option("maxFilesPerTrigger", max_files_per_trigger)
                        .load(input_dir)
                        .select("path"))

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        # the batch lists at most max_files_per_trigger paths: bounded
        paths = [r["path"] for r in batch.select("path").collect()]
        if paths:
            process_files(batch.sparkSession, paths, out_dir, batch_id)

    w = (files.writeStream.foreachBatch(on_batch)
         .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-checkpoint")))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def run_folder_ingest(spark: SparkSession, input_dir: str, out_dir: str, **kw) -> DataFrame:
    """Process everything present now (``availableNow``) and return the profile rows."""
    q = start_folder_ingest(spark, input_dir, out_dir, available_now=True, **kw)
    q.awaitTermination()
    return spark.read.parquet(f"{out_dir}/profile")
