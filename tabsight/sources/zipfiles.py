"""ZIP archives of CSV files (S8-S12, S17) at cluster scale.

Archives that are files are read in pieces, of any size (:func:`ingest_archive_files`,
:mod:`tabsight.sources.zipranges`); archives in cells come from a payload column
(:func:`tabsight.sources.payloads.route`): one ``mapInPandas`` pass lists every archive.  The member rules are
the same, and members are read one at a time:

* S8  keep ``*.csv`` (any case), drop directories and names starting with
  ``__MACOSX/`` or ``.`` (only the root: ``d/.x.csv`` is kept);
* S9  with ``max_files``: sort the kept names and take the first ones (warning beyond);
* S10 with ``max_bytes``: larger members (uncompressed) are errors;
* S11 members must be readable and decode as UTF-8 (else an error for that member, the others
  go on); a good member is written unchanged to a staging folder under ``spark.checkpoint.dir``.

Both limits are off by default: every member is read.  The scan result is checkpointed once
(reliable checkpoint under ``spark.checkpoint.dir``), then Spark's text writer stages every kept
member as its own folder (``partitionBy(member_id)``) with the output commit protocol.  Each
staged member is a normal CSV file for the Spark reader, quoted line breaks included.  Tables are
keyed by the archive's full path, so equal archive names in two folders stay apart.  The binary
archive content is never shuffled.
"""

from __future__ import annotations

import hashlib
import io
import os
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.session import checkpoint_root, drop_path, scratch_path

# The reference's per-archive limits (opt-in here) and messages.
LIBRARY_MAX_FILES = 20
LIBRARY_MAX_BYTES = 50 * 1024 * 1024
MSG_BAD_ZIP = "Invalid or corrupted ZIP file"
MSG_NO_CSV = "No CSV files found in ZIP archive"
MSG_TOO_MANY = "ZIP contains {n} CSV files, processing only first {k}"
MSG_TOO_LARGE = "CSV file '{m}' is too large ({n} bytes)"
MSG_BAD_UTF8 = "Cannot decode CSV file '{m}' - invalid encoding"
MSG_BAD_MEMBER = "Error reading '{m}' from ZIP: {e}"

MEMBER_SCHEMA = ("archive string, member string, is_dir boolean, file_size long, compress_size long, "
                 "kept boolean, status string, message string, member_id string, header string, text string")


def keep_member(name: str, is_dir: bool) -> bool:
    """S8 on one name."""
    return (not is_dir and name.lower().endswith(".csv")
            and not name.startswith("__MACOSX/") and not name.startswith("."))


def member_id(archive: str, member: str) -> str:
    """Filesystem-safe id of one member (a staging folder name)."""
    return "m" + hashlib.sha1(f"{archive}#{member}".encode("utf-8")).hexdigest()[:20]


def _member_id(archive: Column, member: Column) -> Column:
    return F.concat(F.lit("m"), F.substring(F.sha1(F.concat(archive, F.lit("#"), member)), 1, 20))


_NAMES = [c.split()[0] for c in MEMBER_SCHEMA.split(", ")]


def _first_line(text: str) -> str:
    """The first line that is not blank (pandas skips blank lines before the header)."""
    for line in io.StringIO(text):
        if line.strip():
            return line.rstrip("\r\n")
    return ""


def _members(archive: str, content, max_files: int | None, max_bytes: int | None, with_text: bool):
    """Rows of one archive, one member in memory at a time."""
    def note(status: str, message: str):
        return (archive, None, None, None, None, False, status, message, None, None, None)

    try:
        zf = zipfile.ZipFile(io.BytesIO(content))
        infos = zf.infolist()
    except (zipfile.BadZipFile, TypeError, ValueError, OSError, EOFError, NotImplementedError):
        yield note("error", MSG_BAD_ZIP)
        return
    names = sorted(i.filename for i in infos if keep_member(i.filename, i.is_dir()))
    chosen = set(names[:max_files])
    if not names:
        yield note("error", MSG_NO_CSV)
    elif max_files is not None and len(names) > max_files:
        yield note("warning", MSG_TOO_MANY.replace("{n}", str(len(names))).replace("{k}", str(max_files)))
    for info in infos:
        name = info.filename
        row = [archive, name, info.is_dir(), info.file_size, info.compress_size, False, "skipped", None,
               member_id(archive, name), None, None]
        if name in chosen:
            if max_bytes is not None and info.file_size > max_bytes:
                row[6:8] = ["error", MSG_TOO_LARGE.replace("{m}", name).replace("{n}", str(info.file_size))]
            else:
                try:
                    text = zf.read(name).decode("utf-8")
                except UnicodeDecodeError:
                    row[6:8] = ["error", MSG_BAD_UTF8.replace("{m}", name)]
                except Exception as e:   # S17: damaged, encrypted or unsupported member; the others go on
                    row[6:8] = ["error", MSG_BAD_MEMBER.replace("{m}", name).replace("{e}", str(e))]
                else:
                    row[5], row[6], row[9] = True, "ok", _first_line(text)
                    row[10] = text if with_text else None
        elif keep_member(name, info.is_dir()):
            row[6:8] = ["skipped", f"beyond the first {max_files} CSV files"]
        yield tuple(row)


def _scan(batches, max_files: int | None, max_bytes: int | None, with_text: bool):
    for pdf in batches:
        for archive, content in zip(pdf["archive"], pdf["content"]):
            held, size = [], 0
            for row in _members(archive, content, max_files, max_bytes, with_text):
                held.append(row)
                size += len(row[10] or "")
                if size > 16 << 20 or len(held) >= 10_000:
                    yield pd.DataFrame(held, columns=_NAMES)
                    held, size = [], 0
            if held:
                yield pd.DataFrame(held, columns=_NAMES)


def scan_archives(archives: DataFrame, archive_col: str = "path", content_col: str = "content",
                  max_files: int | None = None, max_bytes: int | None = None, with_text: bool = False) -> DataFrame:
    """Member listing with rule outcomes (one row per member plus archive-level rows);
    ``with_text`` adds the decoded text of every kept member."""
    src = archives.select(F.col(archive_col).alias("archive"), F.col(content_col).alias("content"))
    return src.mapInPandas(lambda it: _scan(it, max_files, max_bytes, with_text), MEMBER_SCHEMA)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Archives from files: ``binaryFile`` gives (path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[zZ][iI][pP]").load(path)


def ingest_archives(spark: SparkSession, archives: DataFrame, archive_col: str = "path",
                    content_col: str = "content", max_files: int | None = None, max_bytes: int | None = None):
    """S8-S12 for archives in cells (payload columns): stage the kept members, then read each with the CSV reader.

    Returns ``(members, tables)``: the member listing DataFrame (without text) and a dict
    ``<archive path>#<member> -> CsvTable``; a table's ``origin`` holds its provenance (S12).  The listing comes to
    the driver: its size is the number of members, not their content.  The staged members lie in
    ``tables[...].staging`` below the checkpoint folder until :func:`release` removes them."""
    checkpoint_root(spark)
    members = scan_archives(archives, archive_col, content_col, max_files, max_bytes, with_text=True)
    members = members.checkpoint(eager=True)          # archives are read once
    return _staged_tables(spark, members.drop("text"), members.filter("kept").select("member_id", "text"))


def scan_archive_files(spark: SparkSession, path: str | list[str], max_files: int | None = None,
                       max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """S8-S12 for archives that are files, of any size: (listing like :func:`scan_archives`, texts (member_id, seq, text)).

    Archives are read in pieces and members are inflated as streams (:mod:`tabsight.sources.zipranges`)."""
    from tabsight.sources import zipranges as Z
    pieces, names = Z.archive_pieces(spark, path), Z.archive_names(spark, path)
    root = scratch_path(spark, "zip-scan")

    def stage(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    entries = stage(Z.directory_entries(pieces), "entries")
    ranges = stage(Z.member_ranges(entries, max_files, max_bytes), "ranges")
    texts = stage(Z.member_texts(pieces, ranges.filter("wanted")), "texts")
    ends = texts.filter("seq = 0").select("fid", "at", F.coalesce("error", F.lit("")).alias("error"), "header")
    name, keep = F.col("member"), Z.keep_rule(F.col("member"))
    ranged = ranges.join(ends, ["fid", "at"], "left")
    error = F.when(~F.col("wanted"), None).otherwise(F.coalesce("error", F.lit(Z.MSG_NO_HEADER)))     # no slice: it lies nowhere
    status = (F.when(F.col("again"), "skipped").when(F.col("over"), "skipped").when(F.col("large"), "error").when(~keep, "skipped")
              .when(error == "", "ok").otherwise("error"))

    def said(template: str, **values) -> Column:
        text = F.lit(template)
        for k, v in values.items():
            text = F.replace(text, F.lit("{%s}" % k), v)
        return text

    message = (F.when(F.col("again"), "replaced by a later member of the same name")
               .when(F.col("over"), f"beyond the first {max_files} CSV files")
               .when(F.col("large"), said(MSG_TOO_LARGE, m=name, n=F.col("file_size").cast("string")))
               .when(~keep | (error == ""), F.lit(None)).when(error == "utf-8", said(MSG_BAD_UTF8, m=name))
               .otherwise(said(MSG_BAD_MEMBER, m=name, e=error)))
    rows = ranged.join(names, "fid").select(
        "archive", "member", F.endswith(name, F.lit("/")).alias("is_dir"), "file_size", "compress_size", (status == "ok").alias("kept"),
        status.alias("status"), message.alias("message"), _member_id(F.col("archive"), name).alias("member_id"), "header", "fid", "at")
    # one or no row per archive: unreadable, without a CSV member, or with more of them than the cap
    csvs = ranges.groupBy("fid").agg(F.count(F.when(keep & ~F.col("again"), 1)).alias("n"))
    state = entries.groupBy("fid").agg(F.max(F.col("status") == "bad").alias("bad"))
    per = names.join(csvs, "fid", "left").join(state, "fid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    unread = F.coalesce("bad", F.lit(True))      # no row at all: an empty file
    note = F.when(unread, MSG_BAD_ZIP).when(F.col("n") == 0, MSG_NO_CSV)
    if max_files is not None:
        note = note.when(F.col("n") > max_files, said(MSG_TOO_MANY, n=F.col("n").cast("string"), k=F.lit(str(max_files))))
    notes = per.select("archive", note.alias("message"), F.when(unread | (F.col("n") == 0), "error").otherwise("warning").alias("status"))
    notes = notes.filter("message IS NOT NULL").select(
        "archive", *(F.lit(None).cast(t).alias(c) for c, t in (("member", "string"), ("is_dir", "boolean"), ("file_size", "bigint"),
                                                               ("compress_size", "bigint"))), F.lit(False).alias("kept"), "status", "message",
        F.lit(None).cast("string").alias("member_id"), F.lit(None).cast("string").alias("header"))
    ids = rows.filter("kept").select("fid", "at", "member_id")
    return rows.drop("fid", "at").unionByName(notes), texts.filter("seq > 0").join(ids, ["fid", "at"]).select("member_id", "seq", "text")


def ingest_archive_files(spark: SparkSession, path: str | list[str], max_files: int | None = None, max_bytes: int | None = None):
    """:func:`ingest_archives` for a folder of archives, or the archive files given, whatever their size."""
    members, texts = scan_archive_files(spark, path, max_files, max_bytes)
    # a member's rows stay in order within one file: the writer keeps an order that is there
    return _staged_tables(spark, members, texts.repartition("member_id").sortWithinPartitions("member_id", "seq").select("member_id", "text"))


def _staged_tables(spark: SparkSession, members: DataFrame, texts: DataFrame):
    from tabsight.sources.csv import read_csv_members
    staging = scratch_path(spark, "zip-members")
    texts.write.partitionBy("member_id").text(staging)
    listing = [r for r in members.collect() if r["kept"]]
    kept = {r["member_id"]: f"{r['archive']}#{r['member']}" for r in listing}
    heads = {r["member_id"]: r["header"] for r in listing}
    tables = read_csv_members(spark, staging, "member_id", kept, heads) if kept else {}
    for r in listing:
        t = tables[kept[r["member_id"]]]
        t.origin, t.staging = (r["archive"], r["member"], r["compress_size"]), staging
    return members.drop("header"), tables


def release(spark: SparkSession, tables: dict) -> None:
    """Remove the staged members of an ingest once its tables are no longer needed."""
    for root in {t.staging for t in tables.values() if t.staging}:
        drop_path(spark, root)


def provenance(table, uploaded_at=None) -> DataFrame:
    """The table of an archive member with its provenance columns."""
    archive, member, compress_size = table.origin
    return table.df.select("*", F.lit(f"{os.path.basename(archive)}#{member}").alias("original_name"),
                           F.lit(True).alias("from_zip"), F.lit(os.path.basename(archive)).alias("zip_file"),
                           F.lit(compress_size).cast("long").alias("compressed_size"),
                           F.lit(uploaded_at).cast("timestamp").alias("uploaded_at"))
