"""ZIP files read in pieces against zipfile and against the reader of archives in cells."""

import io
import os
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from tabsight.sources import zipranges as Z
from tabsight.sources.zipfiles import ingest_archive_files, read_archives, scan_archive_files, scan_archives


def _archive(members, method=zipfile.ZIP_DEFLATED, prefix=b"", comment=b""):
    buf = io.BytesIO()
    buf.write(prefix)
    with zipfile.ZipFile(buf, "a" if prefix else "w", compression=method) as zf:
        for name, data in members:
            if name.endswith("/"):
                zf.writestr(zipfile.ZipInfo(name), b"")
            else:
                zf.writestr(name, data)
        zf.comment = comment
    return buf.getvalue()


@pytest.fixture
def folder(tmp_path, monkeypatch):
    rnd = random.Random(3)
    lines = lambda n: "id,v\n" + "".join(f"{k},{rnd.random()}\n" for k in range(n))
    good = [("a.csv", lines(2000)), ("d/b.CSV", lines(3)), ("d/.x.csv", lines(2)), (".hid.csv", "a\n1\n"), ("__MACOSX/a.csv", "a\n1\n"),
            ("docs/", ""), ("readme.txt", "hi"), ("é.csv", '\n\nid,t\n1,"x\ny"\n2,ü\n'), ("only.csv", "")]
    files = {"good.zip": _archive(good, comment=b"the end\n"), "stored.ZIP": _archive(good[:2], zipfile.ZIP_STORED, b"#!/bin/sh\nexit\n" * 50),
             "many.zip": _archive([(f"m{k:03}.csv", f"a,b\n{k},x\n") for k in range(300)]), "none.zip": _archive([("x.txt", "1")]),
             "empty.zip": _archive([]), "bad.zip": b"PK\3\4 not an archive\n" * 40, "utf.zip": _archive([("u.csv", b"a\n\xff\n"), ("v.csv", "a\n1\n")])}
    broken = bytearray(_archive([("c.csv", lines(500)), ("k.csv", "a\n1\n")]))
    broken[200:210] = b"0123456789"
    files["broken.zip"] = bytes(broken)
    twice = io.BytesIO()
    with zipfile.ZipFile(twice, "w") as zf:
        zf.writestr("t.csv", "a\n1\n")
        with pytest.warns(UserWarning):
            zf.writestr("t.csv", "a\n2\n")
    files["twice.zip"] = twice.getvalue()
    root = tmp_path / "my zips"
    root.mkdir()
    for name, data in files.items():
        (root / name).write_bytes(data)
    return str(root)


@pytest.fixture
def small(spark, monkeypatch):
    """Tiny splits, so that pieces, directories and members lie across many of them."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _listing(df):
    """One tuple a row; a header counts for members that are kept."""
    names = ["member", "is_dir", "file_size", "compress_size", "kept", "status"]
    return sorted(((os.path.basename(r["archive"]), *(r[c] for c in names), (r["header"] or "") if r["kept"] else None, (r["message"] or "")[:30])
                   for r in df.collect()), key=str)


def test_pieces_put_together_are_the_files(spark, folder, small):
    got = {}
    names = {r["fid"]: os.path.basename(r["archive"]) for r in Z.archive_names(spark, folder).collect()}
    for r in Z.archive_pieces(spark, folder).collect():
        got.setdefault(names[r["fid"]], []).append((r["off"], bytes(r["data"])))
    assert len(got) == 9 and sum(map(len, got.values())) > 20
    for name, parts in got.items():
        whole = b""
        for off, data in sorted(parts):
            assert off == len(whole)
            whole += data
        with open(f"{folder}/{name}", "rb") as f:
            assert whole.rstrip(b"\n") == f.read().rstrip(b"\n")


@pytest.mark.parametrize("caps", [(None, None), (2, None), (None, 1000), (20, 50)])
def test_listing_equals_the_reader_of_cells(spark, folder, small, caps):
    odd = ("twice.zip", "broken.zip")      # the later of two equal names counts; messages of damaged members differ
    old = _listing(scan_archives(read_archives(spark, folder), max_files=caps[0], max_bytes=caps[1]))
    new = _listing(scan_archive_files(spark, folder, *caps)[0])
    assert [r for r in new if r[0] not in odd] == [r for r in old if r[0] not in odd]
    if caps == (None, None):
        assert {(r[1], r[6]) for r in new if r[0] == "broken.zip"} == {("c.csv", "error"), ("k.csv", "ok")}
        assert sorted(r[6] for r in new if r[0] == "twice.zip") == ["ok", "skipped"]


def test_members_are_read_whole(spark, folder, small, monkeypatch):
    monkeypatch.setattr(Z, "CHUNK_BYTES", 500)
    members, tables = ingest_archive_files(spark, folder)
    by = {(os.path.basename(k.split("#")[0]), k.split("#")[1]): t for k, t in tables.items()}
    rows = lambda a, m: [tuple(r)[:2] for r in by[a, m].df.orderBy("_row_id").collect()]
    with zipfile.ZipFile(f"{folder}/good.zip") as zf:
        want = [line.split(",") for line in zf.read("a.csv").decode().splitlines()[1:]]
    assert rows("good.zip", "a.csv") == [(int(a), float(b)) for a, b in want] == rows("stored.ZIP", "a.csv")
    assert rows("good.zip", "é.csv") == [(1, "x\ny"), (2, "ü")]
    assert rows("many.zip", "m123.csv") == [(123, "x")]
    assert [r[0] for r in by["twice.zip", "t.csv"].df.collect()] == [2]
    assert not by["good.zip", "only.csv"].ok and len([k for k in by if k[0] == "many.zip"]) == 300


def test_wide_end_records_and_extra_fields():
    name, off, size = b"big.csv", 5 << 32, 6 << 32
    extra = struct.pack("<HHQQQ", 1, 24, size, 7 << 32, off)
    entry = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0, 8, 0, 0, 9, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0,
                        0xFFFFFFFF) + name + extra
    assert [e for e, _ in Z._entries(entry + entry[:20])] == [("big.csv", 0, 8, 9, 7 << 32, size, off)]
    at = 9 << 32
    wide = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, 1, 1, len(entry), at)
    tail = entry + wide + struct.pack("<4sIQI", b"PK\6\7", 0, at + len(entry), 1) + struct.pack(
        "<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert Z._end_record(tail, at) == (at, len(entry), 0)
