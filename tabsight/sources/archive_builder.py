"""Build ZIP archives from tables (check and bench input, never the ingest path).

All Spark: each member's text is one aggregate of its rows (``to_csv`` per row,
lines in file order), members are dealt over many archives, each packed into ZIP bytes in a group
of its own, and the resulting ``(path, content)`` frame is materialised with a reliable
``checkpoint()`` in the shared checkpoint folder.  No Python file I/O, so it works
on any cluster filesystem; :func:`tabsight.sources.zipfiles.ingest_archives` reads
the frame exactly as it reads ``binaryFile`` output.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.catalog import ROW_ID, data_columns
from tabsight.session import checkpoint_root

ARCHIVE_SCHEMA = "path string, content binary"


def member_texts(name: str, df: DataFrame, parts: int | None = None, split: Column | None = None,
                 by: Column | None = None) -> DataFrame:
    """(member, text) of one table, with ``by`` also (path): one CSV text per member with a header line.

    ``split`` (a Column) makes one member per distinct value; ``parts`` splits the
    rows into that many members by a hash of their file position; default one member."""
    cols = data_columns(df)
    order = F.col(ROW_ID) if ROW_ID in df.columns else F.lit(0)
    if split is not None:
        key = F.concat(F.lit(f"{name}/part="), split.cast("string"), F.lit(".csv"))
    elif parts:
        key = F.format_string(f"{name}/part-%05d.csv", F.pmod(F.xxhash64(order), F.lit(parts)))
    else:
        key = F.lit(f"{name}.csv")
    line = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in cols]), {"escape": '"', "quoteAll": "true"})
    keys = ["member", "path"] if by is not None else ["member"]
    rows = df.select(key.alias("member"), *([by] if by is not None else []), order.alias("pos"), line.alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]),
                        "\n")
    header = ",".join(cols)
    return rows.groupBy(*keys).agg(F.concat(F.lit(header + "\n"), body, F.lit("\n")).alias("text"))


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", compression=zipfile.ZIP_DEFLATED) as zf:
        for member, text, raw in sorted(zip(pdf["member"], pdf["text"], pdf["raw"]), key=lambda r: r[0]):
            if member.endswith("/"):
                zf.writestr(zipfile.ZipInfo(member), b"")
            else:
                zf.writestr(member, raw if raw is not None else text.encode("utf-8"))
    return pd.DataFrame({"path": [pdf["path"].iloc[0]], "content": [buf.getvalue()]})


ROWS_PER_MEMBER = 1000


def build_archive_frame(spark: SparkSession, tables: dict[str, DataFrame], archive_name: str,
                        extra: dict[str, bytes] | None = None, rows_per_member: int = ROWS_PER_MEMBER,
                        members_per_archive: int = 20, split: dict | None = None, archive: Column | None = None) -> DataFrame:
    """Archives as a checkpointed ``(path, content)`` frame: every table in members of about ``rows_per_member``
    rows, the members dealt over archives of about ``members_per_archive`` of them, so both stay bounded however
    large the tables are.  ``split`` (table -> Column) cuts one member per value instead, and ``archive`` (a Column of
    the table) names the archive of a row.  ``extra`` raw members (name -> bytes; a name ending in '/' is a
    directory) go into the archive ``archive_name``."""
    checkpoint_root(spark)
    frames = []
    for n, df in tables.items():
        cut = (split or {}).get(n)
        if archive is not None:
            one = member_texts(n, df, None, cut, by=archive.cast("string").alias("path"))
        else:
            parts = max(1, -(-df.count() // rows_per_member))
            one = member_texts(n, df, parts, cut)
            name = F.concat(F.lit(f"{n}-"), F.pmod(F.xxhash64("member"), F.lit(max(1, parts // members_per_archive)))
                            .cast("string"), F.lit(".zip"))
            one = one.withColumn("path", name)
        frames.append(one.select("path", "member", "text").withColumn("raw", F.lit(None).cast("binary")))
    if extra:
        frames.append(spark.createDataFrame([(archive_name, m, None, bytearray(b)) for m, b in extra.items()],
                                            "path string, member string, text string, raw binary"))
    members = frames[0]
    for f in frames[1:]:
        members = members.unionByName(f)
    return members.groupBy("path").applyInPandas(_pack, ARCHIVE_SCHEMA).checkpoint(eager=True)


def write_archive_files(spark: SparkSession, archives: DataFrame, root: str) -> str:
    """Write a ``(path, content)`` frame as files ``root/<path>`` on shared storage; returns ``root``."""
    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        local = "://" not in root or root.startswith("file:")
        store, base = (fs.LocalFileSystem(), "/" + root.removeprefix("file:").lstrip("/")) if local else fs.FileSystem.from_uri(root)
        for b in batches:
            for path, content in zip(*(b.column(k).to_pylist() for k in range(2))):
                store.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{base}/{path}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["path"])

    archives.select("path", "content").mapInArrow(run, "path string").count()
    return root
