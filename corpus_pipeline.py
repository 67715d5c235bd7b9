"""Corpus pipeline: language ID, quality rules, line dedup, near-dedup, best-fit packing.

Every stage reads all that its predecessor kept (Parquet below the session's checkpoint folder) and its decisions take
effect; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabsight.llm.langid import held_out, learn_filters, score_limits, tag_languages  # noqa: E402
from tabsight.llm.linededup import dedup_lines  # noqa: E402
from tabsight.llm.oddsketch import near_duplicates  # noqa: E402
from tabsight.llm.packing import pack_documents  # noqa: E402
from tabsight.llm.quality import keep_quality, learn_quality  # noqa: E402
from tabsight.llm.queries import word_vocabulary  # noqa: E402
from tabsight.llm.staging import Stage, iid, remove_path, text_tie  # noqa: E402


#: bytes of one Arrow batch between Spark and Python.  Whole texts go through the stages' Python tasks: batches of 10,000 of them
#: (Spark's default, up to 64 MB) stay allocated outside the heap on both sides
ARROW_BATCH_BYTES = 1 << 20
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _small_batches(stage: Callable) -> Callable:
    """The stage with the session's Arrow batches bounded (a smaller setting of the caller stays)."""
    @functools.wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        now = int(spark.conf.get(_ARROW_BYTES).removesuffix("b"))
        if now <= 0 or now > ARROW_BATCH_BYTES:
            spark.conf.set(_ARROW_BYTES, ARROW_BATCH_BYTES)
        return stage(spark, docs, sf_dir)
    return bounded


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of whose 3-grams the best language explains less than its limit, go."""
    names = ("__lang_pred", "__lang_score")
    tagged = Stage(spark, "language").put(tag_languages(docs, learn_filters(docs.filter(~held_out())), *names))
    limits, other = score_limits(tagged, *names)
    limit = F.lit(other)
    if limits:
        rows = spark.createDataFrame(list(limits.items()), "__lang_pred string, __limit double")
        limit = F.coalesce("__limit", limit)
        tagged = tagged.join(F.broadcast(rows), "__lang_pred", "left")   # one row a learned language
    return tagged.filter((F.col("__lang_pred") != "und") & (F.col("__lang_score") >= limit)).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the likelihood ratio go."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return keep_quality(docs, learn_quality(spark, docs, labels))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a smaller doc_id holds go; n_chars follows the text."""
    names = docs.columns
    out = dedup_lines(spark, docs).withColumn("text", F.col("kept_text"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*names)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five-word shingles, similarity 0.8)."""
    verdict = near_duplicates(spark, docs, width=5, percent=80, ties=True)
    keyed = docs.withColumn("__doc", iid()).withColumn("__tie", text_tie())
    rows = verdict.groupBy(iid().alias("__doc"), F.col("tie").alias("__tie")).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    odd = Stage(spark, "copies").put(rows.filter(~F.col("kept") | (F.col("n") > 1)))
    gone = odd.filter(~F.col("kept")).select("__doc", "__tie")
    out = keyed.join(gone, ["__doc", "__tie"], "left_anti")     # few rows: broadcast where their files are small enough
    if not odd.filter("kept").isEmpty():
        out = out.dropDuplicates(["__doc", "__tie"])   # one of the exact repeats of a row
    return out.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return pack_documents(spark, docs, word_vocabulary(), end_id=1, max_len=4096, cache_words=100_000)


STAGES = [(name, _small_batches(stage)) for name, stage in (
    ("language_id", language_stage), ("quality_rules", quality_stage), ("line_dedup", line_stage),
    ("minhash_near_dedup", near_stage), ("best_fit_packing", packing_stage))]

#: learned models and tokenization are beyond SQL; tests hold the stages against brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; every stage's result is written and reread."""
    stage = Stage(spark, "pipeline")
    docs, last = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"), None
    for _, fn in STAGES:
        docs = stage.put(fn(spark, docs, sf_dir))
        if last is not None:
            remove_path(spark, last)
        last = docs._stage_path
    return docs
