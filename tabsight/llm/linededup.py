"""Line dedup with levelled sorted runs of line hashes.

Documents arrive in batches of ascending doc_id.  A run is a bucketed, sorted table of the 128-bit hashes of the lines
that one batch (or several merged batches) was first to hold.  A new batch reduces its lines to (hash -> smallest
doc_id), merge-anti-joins that against every run (the runs are bucketed by hash: they are read in place, only the new
batch is shuffled), and the survivors become a run of level 0.  When a level holds ``fanout`` runs they are merged into
one run of the next level, so a line is rewritten once per level and a batch meets at most ``fanout`` runs a level.

The survivors also say which document owns which line: a document's eligible lines stay where the document owns them.
A hot line is one row per task after the map-side minimum, and a document is joined with its own lines only.

Null ids come before all others.  Rows without an id, and rows that share one, are documents of their own, told apart by a
hash of their text (the tie); the smallest tie owns a line.  Rows equal in id and text are one document given
several times: they keep the same lines.

Null or empty text is one empty line.  Lines whose key is shorter than ``min_chars`` code points always stay.  Input columns
named like the added ones are replaced, others pass through.  An empty table gives no rows.
"""

from __future__ import annotations

import struct
import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.llm.staging import Stage, iid, remove_path

#: white space that a line's key loses at both ends: space and \x09-\x0D
_BLANK = b" \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SALT = 0x1B873593
#: the second hash is seeded with the hash of the salt
_SEED2 = xxhash.xxh64_intdigest(struct.pack("<i", _SALT), 42)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(_BLANK.decode())), _UPPER, _LOWER)


def key_hashes(key: bytes) -> tuple[int, int]:
    """The two 64-bit hashes of a key as the SQL functions give them (signed)."""
    a, b = xxhash.xxh64_intdigest(key, 42), xxhash.xxh64_intdigest(key, _SEED2)
    return a - (a >> 63 << 64), b - (b >> 63 << 64)


def lines_of(text: Column) -> Column:
    """The lines of a whole text; null or empty: one empty line."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _tie(text: Column) -> Column:
    """60 bits of the text's SHA-256 (null as empty), a hash that SQL engines share."""
    return F.conv(F.substring(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256), 1, 15), 16, 10).cast("bigint")


def _owner(tied: bool) -> list[Column]:
    """Smallest holder.  Where ids are unique only NULL_ID, the smallest doc, has ties (null elsewhere), so two minima are
    of one row."""
    if not tied:
        return [F.min("doc").alias("doc"), F.min("tie").alias("tie")]
    who = F.min(F.struct("doc", "tie"))
    return [who["doc"].alias("doc"), who["tie"].alias("tie")]


class LineRuns:
    """The levelled runs.  ``add`` takes one batch of (h1, h2, doc, tie) rows and returns the rows that the batch owns."""

    def __init__(self, spark: SparkSession, stage: Stage, buckets: int, fanout: int = 4, tied: bool = True):
        self.spark, self.stage, self.buckets, self.fanout, self.tied = spark, stage, buckets, fanout, tied
        self.levels: list[list[str]] = []
        self.names: list[str] = []

    def close(self) -> None:
        """Take the runs out of the catalogue; the files of level 0 stay for those who read what a batch owns."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (df.repartition(self.buckets, "h1", "h2").write.option("path", self.stage.path(name))
         .bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name))
        self.names.append(name)
        return name

    def _remove(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_path(self.spark, self.stage.path(name))

    def add(self, lines: DataFrame) -> DataFrame:
        new = lines.groupBy("h1", "h2").agg(*_owner(self.tied))
        for level in reversed(self.levels):
            for run in level:
                new = new.join(self.spark.table(run).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        run = self._write(new)
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(run)
        own = self.spark.read.schema("h1 bigint, h2 bigint, doc bigint, tie bigint").parquet(self.stage.path(run))
        return self._compacted(own)

    def _compacted(self, own: DataFrame) -> DataFrame:
        k = 0
        while len(self.levels[k]) >= self.fanout:
            if k + 1 == len(self.levels):
                self.levels.append([])
            merged = self.spark.table(self.levels[k][0])
            for run in self.levels[k][1:]:
                merged = merged.unionByName(self.spark.table(run))
            self.levels[k + 1].append(self._write(merged))
            if k:   # level-0 tables still say what their batch owns
                for run in self.levels[k]:
                    self._remove(run)
            self.levels[k] = []
            k += 1
        return own


def dedup_lines(spark: SparkSession, docs: DataFrame, min_chars: int = 10, batches: int = 5, fanout: int = 3) -> DataFrame:
    """``docs`` with the columns kept_text, n_lines and n_dropped added (names of the input that clash are replaced).

    Eligible lines stay only in the smallest doc_id that holds them; the others stay, joined by ``\\n``."""
    stage = Stage(spark, "linededup")
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    tied = not docs.filter("doc_id IS NOT NULL").groupBy(iid().alias("doc")).count().filter("count > 1").isEmpty()
    ident, tie = iid(), _tie(F.col("text")) if tied else F.when(F.col("doc_id").isNull(), _tie(F.col("text")))
    cuts = (docs.select(ident.alias("doc")).approxQuantile("doc", [i / batches for i in range(1, batches)], 0.01)
            if batches > 1 else [])
    batch = F.lit(0)
    for c in cuts:
        batch = batch + (F.col("doc") > F.lit(int(c))).cast("int")
    lines = (docs.select(ident.alias("doc"), tie.alias("tie"), F.explode(lines_of(F.col("text"))).alias("line"))
             .select("doc", "tie", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
             .select("doc", "tie", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(_SALT), F.col("key")).alias("h2"),
                     batch.alias("batch")))
    lines = stage.put(lines.groupBy("batch", "h1", "h2").agg(*_owner(tied)), ["batch"])
    runs = LineRuns(spark, stage, int(spark.conf.get("spark.sql.shuffle.partitions")), fanout, tied)
    owned = None
    try:
        for b in range(batches):
            got = runs.add(lines.filter(F.col("batch") == b).drop("batch"))
            owned = got if owned is None else owned.unionByName(got)
    finally:
        runs.close()    # also after a failed job: no table stays in the catalogue
    stage.drop(lines)
    owned = (owned.groupBy(F.col("doc").alias("__doc"), F.coalesce("tie", F.lit(0)).alias("__tie"))
             .agg(F.collect_list("h1").alias("__own1"), F.collect_list("h2").alias("__own2")))
    joined = (docs.withColumn("__doc", ident).withColumn("__tie", F.coalesce(tie, F.lit(0)))
              .join(owned, ["__doc", "__tie"], "left").select(*docs.columns, "__own1", "__own2"))
    names, added = docs.columns, ["kept_text", "n_lines", "n_dropped"]
    schema = T.StructType([*docs.schema.fields, T.StructField("kept_text", T.StringType()),
                           T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def rebuild(batches_):
        for b in batches_:
            texts = b.column(b.schema.get_field_index("text")).cast(pa.large_binary())
            own1, own2 = b.column(len(names)), b.column(len(names) + 1)
            kept, total, lost = [], [], []
            for t, o1, o2 in zip(texts, own1, own2):
                lines_ = (t.as_py() or b"").split(b"\n")
                own = set(zip(o1.values.to_numpy().tolist(), o2.values.to_numpy().tolist())) if o1.is_valid else ()
                stay = []
                for line in lines_:
                    key = line.strip(_BLANK).lower()
                    if (len(key) < min_chars or (h := key_hashes(key)) in own
                            or len(key.decode("utf-8", "replace")) < min_chars):
                        stay.append(line)
                kept.append(b"\n".join(stay).decode("utf-8", "replace"))
                total.append(len(lines_))
                lost.append(len(lines_) - len(stay))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(names))] + [
                pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(lost, pa.int64())], names=names + added)

    return joined.mapInArrow(rebuild, schema)
