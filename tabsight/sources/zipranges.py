"""ZIP archives as files: no archive and no member is ever one cell.

Archives of any size (ZIP64 included) are read by Spark's splittable reader, member by member:

1. :func:`archive_pieces`: the bytes of all archives as pieces of about ``PIECE_BYTES``.  The line reader hands out raw bytes
   between line feeds from any store that Spark reads; the lengths of a file's splits, summed in order, place every piece.
2. :func:`member_listing`: the end record from an archive's last pieces, then its central directory, streamed entry by entry;
   the member rules (S8-S10) as columns.
3. :func:`member_texts`: pieces meet the members that they overlap (by bins of the offset), each member's slices go to one
   task in order and are inflated as a stream: bounded output pieces, CRC and size checked, UTF-8 decoded incrementally.

A member is sequential by its format, so a hot member is one task's stream; its neighbours are other tasks'.  Memory is
one piece and one output chunk.  Of members with equal names the last counts, as ``zipfile`` reads them.
"""

from __future__ import annotations

import codecs
import re
import struct
import zlib
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabsight.session import scratch_path

#: small cells: readers hold thousands of rows at a time
PIECE_BYTES = 8 << 10
#: output text of one row (or one longer line)
CHUNK_BYTES = 16 << 10
#: offsets that members and pieces meet by
BIN_BYTES = 1 << 20
#: bytes of one Arrow batch
BATCH_BYTES = 4 << 20
#: end record, its comment, and the ZIP64 records before it
TAIL_BYTES = 22 + 65_535 + 20 + 56
MSG_NO_HEADER = "member header not found"

_PIECE = "fid bigint, block bigint, rel bigint, size bigint, data binary"
_ENTRY = ("fid bigint, ordinal bigint, member string, flags int, method int, crc bigint, compress_size bigint, file_size bigint, "
          "at bigint, directory bigint, status string")


def _batch(rows: list, schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    cols = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[t]) for v, (_, t) in zip(zip(*rows), cols)], names=[n for n, _ in cols])


def archive_pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(fid, off, size, data) of all ``*.zip`` files of a folder, or of the files given; written once to shared storage."""
    reader = spark.read.option("lineSep", "\n")
    raw = (reader.option("pathGlobFilter", "*.[zZ][iI][pP]") if isinstance(path, str) else reader).text(path)
    lines = raw.select(F.xxhash64("_metadata.file_path").alias("fid"), F.col("_metadata.file_block_start").alias("block"),
                       F.col("value").cast("binary").alias("data"))

    def run(batches):
        key, rel, held, size, out = None, 0, [], 0, []

        def piece():
            nonlocal rel, held, size
            out.append((*key, rel, size, b"\n".join(held) + b"\n"))
            rel, held, size = rel + size, [], 0

        for b in batches:
            for fid, block, data in zip(*(b.column(k).to_pylist() for k in range(3))):
                if (fid, block) != key:
                    if held:
                        piece()
                    key, rel = (fid, block), 0
                held.append(data)
                size += len(data) + 1
                if size >= PIECE_BYTES:
                    piece()
                    if len(out) >= BATCH_BYTES // PIECE_BYTES:
                        yield _batch(out, _PIECE)
                        out.clear()
        if held:
            piece()
        if out:
            yield _batch(out, _PIECE)

    root = f"{scratch_path(spark, 'zip-pieces')}/pieces"
    lines.mapInArrow(run, _PIECE).write.parquet(root)
    pieces = spark.read.schema(_PIECE).parquet(root)
    splits = pieces.groupBy("fid", "block").agg(F.sum("size").alias("bytes"))
    base = splits.select("fid", "block", (F.sum("bytes").over(W.partitionBy("fid").orderBy("block")) - F.col("bytes")).alias("base"))
    return pieces.join(base, ["fid", "block"]).select("fid", (F.col("base") + F.col("rel")).alias("off"), "size", "data")


def archive_names(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(fid, archive) of the files behind :func:`archive_pieces`: Spark's own file listing."""
    reader = spark.read.option("pathGlobFilter", "*.[zZ][iI][pP]") if isinstance(path, str) else spark.read
    names = [re.sub("^file:/+", "file:/", f) for f in reader.text(path).inputFiles()]
    rows = spark.createDataFrame([(f, unquote(f)) for f in names], "file string, archive string")
    return rows.select(F.xxhash64("file").alias("fid"), "archive")


def _end_record(tail: bytes, start: int) -> tuple[int, int, int]:
    """(absolute start of the central directory, its size, bytes before the archive); ValueError if there is none."""
    k = tail.rfind(b"PK\5\6")
    if k < 0 or len(tail) < k + 22:
        raise ValueError("no end record")
    size, off = struct.unpack_from("<II", tail, k + 12)
    end = start + k
    if k >= 76 and tail[k - 20:k - 16] == b"PK\6\7" and tail[k - 76:k - 72] == b"PK\6\6":     # the wide record stands before it
        size, off = struct.unpack_from("<QQ", tail, k - 76 + 40)
        end = start + k - 76
    return end - size, size, end - size - off


def _entries(data: bytes):
    """Complete central directory entries at the head of ``data``: (entry fields, bytes used)."""
    at = 0
    while len(data) - at >= 46 and data[at:at + 4] == b"PK\1\2":
        flags, method = struct.unpack_from("<HH", data, at + 8)
        crc, csize, usize, n, m, c = struct.unpack_from("<IIIHHH", data, at + 16)
        off = struct.unpack_from("<I", data, at + 42)[0]
        if len(data) - at < 46 + n + m + c:
            break
        raw, extra = data[at + 46:at + 46 + n], data[at + 46 + n:at + 46 + n + m]
        while len(extra) >= 4:
            kind, size = struct.unpack_from("<HH", extra)
            if kind == 1:
                wide = iter(struct.unpack(f"<{size // 8}Q", extra[4:4 + size // 8 * 8]))
                usize = next(wide, usize) if usize == 0xFFFFFFFF else usize
                csize = next(wide, csize) if csize == 0xFFFFFFFF else csize
                off = next(wide, off) if off == 0xFFFFFFFF else off
            extra = extra[4 + size:]
        name = raw.decode("utf-8" if flags & 0x800 else "cp437", "replace").split("\0")[0]
        at += 46 + n + m + c
        yield (name, flags, method, crc, csize, usize, off), at


def directory_entries(pieces: DataFrame) -> DataFrame:
    """One row per central directory entry, or one with ``status`` 'bad' for an archive without a readable directory."""
    sizes = pieces.groupBy("fid").agg(F.max(F.col("off") + F.col("size")).alias("total"))
    near = pieces.join(sizes, "fid").filter(F.col("off") + F.col("size") > F.col("total") - TAIL_BYTES)
    tails = near.groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("off", "data"))).alias("p"))

    def ends(batches):
        names = "fid bigint, first bigint, length bigint, before bigint"
        for b in batches:
            out = []
            for fid, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    out.append((fid, *_end_record(b"".join(p["data"] for p in parts), parts[0]["off"])))
                except (ValueError, struct.error):
                    out.append((fid, -1, 0, 0))
            if out:
                yield _batch(out, names)

    where = tails.mapInArrow(ends, "fid bigint, first bigint, length bigint, before bigint")
    holds = (F.col("first") < 0) | ((F.col("off") < F.col("first") + F.col("length")) & (F.col("off") + F.col("size") > F.col("first")))
    rows = pieces.join(where, "fid").select(
        "fid", "off", "first", "length", "before", F.when(F.col("first") >= 0, F.col("data")).alias("data"), holds.alias("holds"))
    # an archive with an empty or no directory still gets a row
    rows = rows.filter("holds OR (length = 0 AND off = 0)").drop("holds")
    placed = rows.repartition("fid").sortWithinPartitions("fid", "off")

    def parse(batches):
        file, buf, n, done, held = None, b"", 0, False, []

        def close():
            """What is left over of an archive's directory."""
            if file is not None and not done:
                held.append((file[0], n, None, None, None, None, None, None, None, file[1], "bad"))

        for b in batches:
            for fid, off, first, length, before, data in zip(*(b.column(k).to_pylist() for k in range(6))):
                if file is None or file[0] != fid:
                    close()
                    file, buf, n, done, seen = (fid, first), b"", 0, False, 0
                if done or first < 0:
                    continue
                part = data[max(0, first - off):first + length - off] if length else b""
                seen += len(part)
                buf, used = buf + part, 0
                for (name, flags, method, crc, csize, usize, at), used in _entries(buf):
                    held.append((fid, n, name, flags, method, crc, csize, usize, at + before, first, "ok"))
                    n += 1
                buf = buf[used:]
                if seen >= length and not buf:
                    done = True
                    if not n:
                        held.append((fid, 0, None, None, None, None, None, None, None, first, "empty"))
                if len(held) >= 4096:
                    yield _batch(held, _ENTRY)
                    held.clear()
        close()
        if held:
            yield _batch(held, _ENTRY)

    return placed.mapInArrow(parse, _ENTRY)


def keep_rule(member: Column) -> Column:
    """S8 on a member name."""
    return (~F.endswith(member, F.lit("/")) & F.endswith(F.lower(member), F.lit(".csv"))
            & ~F.startswith(member, F.lit("__MACOSX/")) & ~F.startswith(member, F.lit(".")))


def member_ranges(entries: DataFrame, max_files: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Entries with ``wanted`` (to be read), ``over`` (beyond the cap), ``again`` (a later member has the name) and ``until``, where
    the next member or the directory begins."""
    w = W.partitionBy("fid")
    good = entries.filter("status = 'ok'")
    keep = keep_rule(F.col("member"))
    out = good.withColumn("until", F.coalesce(F.lead("at").over(w.orderBy("at", "ordinal")), F.col("directory")))
    out = out.withColumn("again", F.row_number().over(W.partitionBy("fid", "member").orderBy(F.desc("ordinal"))) > 1)
    out = out.withColumn("rank", F.when(keep, F.sum(F.when(keep & ~F.col("again"), 1).otherwise(0)).over(w.orderBy("member", "again", "ordinal"))))
    over = F.col("rank") > max_files if max_files is not None else F.lit(False)
    large = F.col("file_size") > max_bytes if max_bytes is not None else F.lit(False)
    out = out.withColumn("over", keep & over).withColumn("large", keep & ~over & large)
    return out.withColumn("wanted", keep & ~F.col("over") & ~F.col("large") & ~F.col("again"))


_TEXT = "fid bigint, at bigint, seq bigint, text string, error string, header string"


class _Member:
    """Inflates one member from its slices."""

    def __init__(self, fid, at, crc, csize, usize):
        self.fid, self.at, self.crc, self.csize, self.usize = fid, at, crc, csize, usize
        self.head, self.left, self.z, self.sum, self.out = b"", csize, None, 0, 0
        self.text, self.seq, self.error, self.first = codecs.getincrementaldecoder("utf-8")(), 0, None, None
        self.held, self.open = "", False

    def feed(self, data: bytes):
        """Rows of text that are ready."""
        if self.error is not None:
            return
        try:
            if not self.open:
                self.head += data
                if len(self.head) < 30:
                    return
                n, m = struct.unpack_from("<HH", self.head, 26)
                if self.head[:4] != b"PK\3\4":
                    raise ValueError(MSG_NO_HEADER)
                if len(self.head) < 30 + n + m:
                    return
                flags, method = struct.unpack_from("<HH", self.head, 6)
                if flags & 1:
                    raise ValueError("encrypted")
                if method not in (0, 8):
                    raise ValueError("That compression method is not supported")
                self.z = zlib.decompressobj(-15) if method == 8 else None
                data, self.head, self.open = self.head[30 + n + m:], b"", True
            data, self.left = data[:self.left], self.left - min(self.left, len(data))
            while data:
                if self.z is None:
                    part, data = data, b""
                else:
                    part = self.z.decompress(data, CHUNK_BYTES)
                    data = self.z.unconsumed_tail
                self.sum, self.out = zlib.crc32(part, self.sum), self.out + len(part)
                self.held += self.text.decode(part)
                if len(self.held) >= CHUNK_BYTES and "\n" in self.held:
                    ready, _, self.held = self.held.rpartition("\n")
                    yield self.row(ready)
        except UnicodeDecodeError:
            self.error = "utf-8"
        except (ValueError, zlib.error, struct.error) as e:
            self.error = str(e)

    def row(self, text: str):
        if self.first is None:
            self.first = next((x.rstrip("\r") for x in text.split("\n") if x.strip()), None)
        self.seq += 1
        return self.fid, self.at, self.seq, text, None, None

    def close(self):
        if self.error is None:
            try:
                if not self.open or self.left or self.out != self.usize:
                    raise ValueError("member ends early")
                self.held += self.text.decode(b"", True)
                if self.sum != self.crc:
                    raise ValueError("Bad CRC-32")
            except UnicodeDecodeError:
                self.error = "utf-8"
            except ValueError as e:
                self.error = str(e)
        if self.error is None and self.held:
            yield self.row(self.held.removesuffix("\n"))
        yield self.fid, self.at, 0, None, self.error, self.first or ""


def member_texts(pieces: DataFrame, wanted: DataFrame) -> DataFrame:
    """Text of the ``wanted`` members (fid, at, until, crc, compress_size, file_size): rows of whole lines with ``seq`` 1, 2, ...
    (the line feed behind each row is left out), and one row with ``seq`` 0, the ``error`` and the first line that is not blank."""
    want = wanted.select("fid", "at", "until", "crc", "compress_size", "file_size")
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / BIN_BYTES), F.floor((hi - 1) / BIN_BYTES)))
    spread = want.filter("until > at").select("*", bins(F.col("at"), F.col("until")).alias("bin"))
    keys = pieces.select("fid", "off", "size", bins(F.col("off"), F.col("off") + F.col("size")).alias("bin"))
    met = keys.join(spread, ["fid", "bin"]).filter((F.col("at") < F.col("off") + F.col("size")) & (F.col("until") > F.col("off")))
    lists = met.groupBy("fid", "off").agg(F.collect_set(F.struct("at", "until", "crc", "compress_size", "file_size")).alias("members"))
    slice_schema = "fid bigint, at bigint, crc bigint, compress_size bigint, file_size bigint, off bigint, data binary"

    def cut(batches):
        for b in batches:
            out, size = [], 0
            for fid, off, data, members in zip(*(b.column(k).to_pylist() for k in range(4))):
                for m in members:
                    lo, hi = max(m["at"] - off, 0), min(m["until"] - off, len(data))
                    out.append((fid, m["at"], m["crc"], m["compress_size"], m["file_size"], off + lo, data[lo:hi]))
                    size += hi - lo
                    if size >= BATCH_BYTES:
                        yield _batch(out, slice_schema)
                        out, size = [], 0
            if out:
                yield _batch(out, slice_schema)

    slices = pieces.join(lists, ["fid", "off"]).select("fid", "off", "data", "members").mapInArrow(cut, slice_schema)
    placed = slices.repartition("fid", "at").sortWithinPartitions("fid", "at", "off")

    def inflate(batches):
        now, held, size = None, [], 0
        for b in batches:
            for fid, at, crc, csize, usize, _, data in zip(*(b.column(k).to_pylist() for k in range(7))):
                if now is None or (now.fid, now.at) != (fid, at):
                    held += now.close() if now is not None else ()
                    now = _Member(fid, at, crc, csize, usize)
                for row in now.feed(data):
                    held.append(row)
                    size += len(row[3])
                    if size >= BATCH_BYTES:
                        yield _batch(held, _TEXT)
                        held, size = [], 0
                if len(held) >= 1024:
                    yield _batch(held, _TEXT)
                    held, size = [], 0
        if now is not None:
            held += now.close()
        if held:
            yield _batch(held, _TEXT)

    return placed.mapInArrow(inflate, _TEXT)
