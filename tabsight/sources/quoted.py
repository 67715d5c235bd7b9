"""Records of CSV files with quoted line breaks, read by many tasks.

Spark's line reader splits a file anywhere; whether a line starts inside a quoted field depends on all lines before it.  A
line is a function of that state (outside or inside a quoted field), and functions compose:

1. :func:`split_states`: each task composes the functions of its split's lines that hold a quote (the others change
   nothing): one short row per split;
2. :func:`split_starts`: along a file's splits, in order, the functions give the state in which each split starts;
3. :func:`quoted_records`: each task, knowing its splits' start states, joins the lines of a record again.  What lies before a
   split's first record, and a last record that goes on, are at most two fragments a split; they are put together by
   the split that the record starts in.

The states are exact for quotes that only open at the start of a field, as the CSV parsers have it: a quote inside an
unquoted field (``5" pipe``) is an ordinary character.  Line ends inside a field are kept as they are.  A task holds one
batch of lines and one record.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabsight.catalog import with_text_row_id
from tabsight.session import scratch_path

#: start states of at most so many splits are broadcast (16 bytes each); beyond it lines are shuffled by split
MAX_BROADCAST_SPLITS = 200_000

FILE_ID = "_metadata.file_path"


def file_id() -> Column:
    """A 64-bit hash of the row's file path: rows carry it to Python in place of the path."""
    return F.xxhash64(F.col(FILE_ID))


@functools.lru_cache
def _patterns(sep: str):
    """(line that starts outside and ends inside a quoted field, line that starts inside and ends inside)."""
    s, body = re.escape(sep), r'[^"]*+(?:""[^"]*+)*+'
    field = rf'(?:(?:"{body}"[^{s}]*+|[^"{s}][^{s}]*+)?+{s})*+'
    out = rf'{field}"{body}\Z'
    return re.compile(out, re.S).match, re.compile(rf'{body}(?:\Z|"[^{s}]*+{s}{out})', re.S).match


def ends_inside(line: str, inside: bool, sep: str = ",") -> bool:
    """Whether a quoted field is open behind a line, given whether one was open before it."""
    return _patterns(sep)[inside](line) is not None


def _lines(spark: SparkSession, path: str, sep: str, tag: str | None, numbered: bool = True) -> DataFrame:
    """(fid, block, tag, rid, value) of every line of the files, ended by line feeds alone; without ``rid`` if not ``numbered``."""
    if len(sep) != 1:
        raise ValueError("the separator must be one character")
    raw = spark.read.option("lineSep", "\n").text(path)
    raw = raw.select(file_id().alias("fid"), F.col("_metadata.file_block_start").alias("block"),
                     (F.col(tag) if tag else F.lit(None)).cast("string").alias("tag"), "value")
    return with_text_row_id(raw, name="rid").select("fid", "block", "tag", "rid", "value") if numbered else raw


def _written(spark: SparkSession, df: DataFrame, kind: str) -> DataFrame:
    path = f"{scratch_path(spark, kind)}/rows"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def split_states(spark: SparkSession, path: str, sep: str = ",", tag: str | None = None) -> DataFrame:
    """(fid, block, tag, from_out, from_in, opens) per split with a quote: the state behind it for either state before it,
    and whether a line that starts outside ends inside.  Written once below the checkpoint folder."""
    quoted = _lines(spark, path, sep, tag, numbered=False).filter(F.contains("value", F.lit('"'))).select("fid", "block", "tag", "value")
    names = ["fid", "block", "tag", "from_out", "from_in", "opens"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()]

    def run(batches):
        key, state, opens, out = None, (False, True), False, []
        for b in batches:
            for fid, block, tag_, line in zip(*(b.column(k).to_pylist() for k in range(4))):
                if (fid, block, tag_) != key:
                    if key is not None:
                        out.append((*key, *state, opens))
                    key, state, opens = (fid, block, tag_), (False, True), False
                f = (ends_inside(line, False, sep), ends_inside(line, True, sep))
                opens, state = opens or f[0], (f[state[0]], f[state[1]])
        if key is not None:
            out.append((*key, *state, opens))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), kinds)], names=names)

    return _written(spark, quoted.mapInArrow(
        run, "fid bigint, block bigint, tag string, from_out boolean, from_in boolean, opens boolean"), "csv-states")


def split_starts(blocks: DataFrame, states: DataFrame) -> DataFrame:
    """(fid, block) of the splits that start inside a quoted field; ``blocks`` lists all splits."""
    keyed = blocks.join(states.select("fid", "block", "from_out", "from_in"), ["fid", "block"], "left").select(
        "fid", "block", F.coalesce("from_out", F.lit(False)).alias("from_out"), F.coalesce("from_in", F.lit(True)).alias("from_in"))

    def fold(batches):
        file, inside = None, False
        for b in batches:
            found = []
            for fid, block, from_out, from_in in zip(*(b.column(k).to_pylist() for k in range(4))):
                if fid != file:
                    file, inside = fid, False
                if inside:
                    found.append((fid, block))
                inside = from_in if inside else from_out
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*found)], names=["fid", "block"])

    return keyed.repartition("fid").sortWithinPartitions("fid", "block").mapInArrow(fold, "fid bigint, block bigint")


_PIECE = "fid bigint, block bigint, part int, rid decimal(38,0), tag string, first boolean, value string"
_RECORD, _HEAD, _TAIL = 0, 1, 2


class _Held:
    """The record (or the rest of one before a split's first record) whose end is not yet seen."""

    def __init__(self, part: int, rid, tag, lines: list):
        self.part, self.rid, self.tag, self.lines = part, rid, tag, lines


def _glue(batches, sep: str):
    """Pieces of consecutive lines; columns fid, block, inside (state before the split), rid, tag, value."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.decimal128(38, 0), pa.string(), pa.bool_(), pa.string()]
    names = [c.split()[0] for c in _PIECE.split(", ")]
    key, inside, header, held = None, False, False, None

    def one(part: int):
        nonlocal header
        text = "\n".join(held.lines)
        first = header and part != _HEAD and bool(text.strip())
        header = header and not first
        row = (*key, part, held.rid, held.tag, first, text)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=names)

    for b in batches:
        fid, block, opened = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        rid, tag, values = b.column(3), b.column(4), b.column(5)
        quotes = pc.match_substring(values, '"').to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((fid[1:] != fid[:-1]) | (block[1:] != block[:-1])) + 1
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fid)]):
            if s == e:
                continue
            if (fid[s], block[s]) != key:
                if held is not None:
                    yield one(_HEAD if held.part == _HEAD else _TAIL if inside else _RECORD)
                key, inside, header = (fid[s], block[s]), bool(opened[s]), block[s] == 0
                held = _Held(_HEAD, rid[s].as_py(), tag[s].as_py(), []) if inside else None
            before, at = np.empty(e - s, bool), 0
            for k in np.flatnonzero(quotes[s:e]).tolist():
                before[at:k + 1] = inside
                inside, at = ends_inside(values[s + k].as_py(), inside, sep), k + 1
            before[at:] = inside
            starts = s + np.flatnonzero(~before)
            stop = int(starts[0]) if len(starts) else e
            if stop > s:
                held.lines += values.slice(s, stop - s).to_pylist()
            if not len(starts):
                continue
            if held is not None:
                yield one(held.part)
            n = len(starts) - 1
            if n:
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values), "\n")
                first = np.zeros(n, bool)
                if header:
                    full = np.flatnonzero(pc.greater(pc.binary_length(pc.utf8_trim_whitespace(texts)), 0).to_numpy(zero_copy_only=False))
                    if len(full):
                        first[full[0]], header = True, False
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fid[starts[:n]]), pa.array(block[starts[:n]]), pa.array(np.zeros(n, np.int32)),
                     rid.take(pa.array(starts[:n])), tag.take(pa.array(starts[:n])), pa.array(first), texts], names=names)
            last = int(starts[-1])
            held = _Held(_RECORD, rid[last].as_py(), tag[last].as_py(), values.slice(last, e - last).to_pylist())
    if held is not None:
        yield one(_HEAD if held.part == _HEAD else _TAIL if inside else _RECORD)


def quoted_records(spark: SparkSession, path: str, states: DataFrame, chosen: Column, sep: str = ",", tag: str | None = None,
                   max_broadcast: int = MAX_BROADCAST_SPLITS) -> DataFrame:
    """(rid, tag, first, value) of every record of the files of ``path`` for which ``chosen`` (a condition on ``fid`` or
    ``tag``) holds: ``rid`` orders the records of all files, ``first`` marks a file's first record that is not blank (its
    header).  Blank records go."""
    lines = _lines(spark, path, sep, tag).filter(chosen)
    inside = _written(spark, split_starts(lines.select("fid", "block").distinct(), states), "csv-starts").withColumn("inside", F.lit(True))
    if inside.count() <= max_broadcast:
        known = lines.join(F.broadcast(inside), ["fid", "block"], "left")
    else:
        known = lines.join(inside, ["fid", "block"], "left").repartition("fid", "block").sortWithinPartitions("fid", "block", "rid")
    pieces = known.select("fid", "block", F.coalesce("inside", F.lit(False)).alias("inside"), "rid", "tag", "value").mapInArrow(
        lambda batches: _glue(batches, sep), _PIECE)
    fragments = _written(spark, pieces.filter(F.col("part") != _RECORD), "csv-fragments")     # at most two a split
    w = W.partitionBy("fid").orderBy("block", "part").rowsBetween(W.unboundedPreceding, W.currentRow)
    owned = fragments.withColumn("owner", F.max(F.when(F.col("part") == _TAIL, F.col("block"))).over(w))
    parts = F.array_sort(F.collect_list(F.struct("block", "part", "rid", "tag", "first", "value")))
    whole = owned.groupBy("fid", "owner").agg(parts.alias("x")).select(
        F.col("x")[0]["rid"].alias("rid"), F.col("x")[0]["tag"].alias("tag"), F.col("x")[0]["first"].alias("first"),
        F.array_join(F.transform("x", lambda p: p["value"]), "\n").alias("value"))
    records = pieces.filter(F.col("part") == _RECORD).select("rid", "tag", "first", "value").unionByName(whole)
    value = F.when(F.endswith("value", F.lit("\r")), F.substring("value", F.lit(1), F.length("value") - 1)).otherwise(F.col("value"))
    return records.withColumn("value", value).filter(F.btrim("value", F.lit(" \t\r\n")) != "")
