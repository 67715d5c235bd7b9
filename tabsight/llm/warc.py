"""WARC archives: writing segmented records, and reassembling them.

Writing: each task writes per-record gzip members into volumes of about ``volume_bytes`` in the shared folder.  A
response's block is an HTTP message with chunked transfer framing; a block above ``segment_bytes`` becomes a first
segment and ``continuation`` records (possibly in the next volume) that name the first record's id, their number and, in
the last one, the total length.  A payload that an earlier page already has is a ``revisit`` record without a payload.

Reading: each task streams whole volumes.  Unsegmented records are decoded on the spot; segments meet by origin id, are
ordered by number, checked against the total length and decoded.  A record that fails a check comes back with its
``error`` and no payload; the others are unaffected.

Null html is an empty payload.  Payloads under ``min_revisit`` bytes are always responses.  A row without a page_id owns no
payload: it revisits the smallest id that holds its payload, and is a response where only such rows hold it.  Rows that
repeat a page_id are written as often as they occur, those of the smallest id all as responses.  Extra columns are not
read, whatever their names; an empty table gives no volume and no rows.  A payload must fit in a task's memory.  File names
hold a random part; only files that the manifest names count.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.llm.staging import NULL_ID, Stage, open_store

MIN_REVISIT = 100
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page_id: int, digest: str) -> str:
    """A page's record id, the same wherever it is computed."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def chunked(data: bytes, size: int = 4096) -> bytes:
    """Chunked transfer framing of a payload."""
    out = [b"%x\r\n%b\r\n" % (len(data[i:i + size]), data[i:i + size]) for i in range(0, len(data), size)]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunk(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        eol = body.find(b"\r\n", at)
        if eol < 0:
            raise ValueError("chunk size line without end")
        n = int(body[at:eol].split(b";")[0].strip(), 16)
        at = eol + 2
        if n == 0:
            return b"".join(out)
        if body[at + n:at + n + 2] != b"\r\n":
            raise ValueError("chunk shorter than its size")
        out.append(body[at:at + n])
        at += n + 2


def http_payload(block: bytes) -> bytes:
    """The entity of an HTTP response message."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        raise ValueError("no end of the HTTP header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    return dechunk(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body


class VolumeWriter:
    """Gzip members into volumes; a new volume starts once one is full, also between the segments of a record."""

    def __init__(self, store, folder: str, prefix: str, volume_bytes: int, segment_bytes: int):
        self.store, self.folder, self.prefix = store, folder, prefix
        self.volume_bytes, self.segment_bytes = volume_bytes, segment_bytes
        self.names, self.out, self.size = [], None, 0

    def _member(self, head: list[tuple[str, str]], block: bytes) -> None:
        if self.out is None or self.size >= self.volume_bytes:
            self.close()
            self.names.append(f"{self.prefix}-{len(self.names):05d}.warc.gz")
            self.out, self.size = self.store.open_output_stream(f"{self.folder}/{self.names[-1]}", compression=None), 0
        text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + f"Content-Length: {len(block)}\r\n\r\n"
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        data = z.compress(text.encode() + block + b"\r\n\r\n") + z.flush()
        self.out.write(data)
        self.size += len(data)

    def record(self, head: list[tuple[str, str]], block: bytes) -> None:
        if len(block) <= self.segment_bytes:
            return self._member(head, block)
        parts = [block[i:i + self.segment_bytes] for i in range(0, len(block), self.segment_bytes)]
        self._member([*head, ("WARC-Segment-Number", "1")], parts[0])
        origin = dict(head)["WARC-Record-ID"]
        for n, part in enumerate(parts[1:], 2):
            more = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(n, origin)), ("WARC-Segment-Origin-ID", origin),
                    ("WARC-Segment-Number", str(n))]
            if n == len(parts):
                more.append(("WARC-Segment-Total-Length", str(len(block))))
            self._member(more, part)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def write_archives(spark: SparkSession, pages: DataFrame, min_revisit: int = MIN_REVISIT, segment_bytes: int = 16 << 10,
                   volume_bytes: int = 64 << 20) -> tuple[str, DataFrame]:
    """Write one record per row of ``pages`` (page_id, url, html); returns the folder and the manifest (part, volume, name)."""
    stage = Stage(spark, "warc")
    root = stage.path("archives")
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.coalesce(F.col("page_id").cast("bigint"), F.lit(NULL_ID)).alias("page_id"),
                        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), body.alias("body"),
                        F.sha2(body, 256).alias("digest"))
    first = (rows.filter((F.octet_length("body") >= min_revisit) & (F.col("page_id") != NULL_ID))
             .groupBy("digest").agg(F.min("page_id").alias("first")))
    # payloads that are always responses meet no key: an empty page is no hot group
    small = F.octet_length("body") < min_revisit
    rows = rows.filter(~small).join(first, "digest", "left").unionByName(rows.filter(small).withColumn("first", F.lit(None).cast("bigint")))

    def run(batches):
        from pyspark import TaskContext
        store, folder = open_store(root)
        store.create_dir(folder, recursive=True)
        part = TaskContext.get().partitionId()
        out = VolumeWriter(store, folder, f"{part:06d}-{uuid.uuid4().hex}", volume_bytes, segment_bytes)
        for b in batches:
            for pid, url, data, digest, origin in zip(*(b.column(i).to_pylist() for i in range(5))):
                again = origin is not None and origin != pid
                # a field value is one line: a url's control characters are percent-encoded
                safe = "".join(c if c.isprintable() else "".join(f"%{x:02X}" for x in c.encode()) for c in url)
                head = [("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", record_id(pid, digest)),
                        ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", safe),
                        ("WARC-Payload-Digest", f"sha256:{digest}"), ("Page-Id", str(pid)),
                        ("Content-Type", "application/http; msgtype=response")]
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
                if again:
                    head += [("WARC-Refers-To", record_id(origin, digest)), ("WARC-Profile", _PROFILE)]
                else:
                    block += chunked(data)
                out.record(head, block)
        out.close()
        if out.names:
            n = len(out.names)
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(range(n), pa.int32()),
                                              pa.array(out.names)], names=["part", "volume", "name"])

    manifest = rows.select("page_id", "url", "body", "digest", "first").mapInArrow(run, "part int, volume int, name string")
    return root, stage.put(manifest)


def parse_records(stream):
    """Yield (header fields, block) of an uncompressed WARC byte stream; a broken record ends the volume with an
    ``error`` field."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            yield {"error": "no WARC version line"}, b""
            return
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.partition(b":")
            head[k.strip().lower().decode("utf-8", "replace")] = v.strip().decode("utf-8", "replace")
        size = head.get("content-length", "")
        block = stream.read(int(size)) if size.isdigit() else b""
        if not size.isdigit() or len(block) < int(size):
            yield {**head, "error": "record shorter than its Content-Length"}, b""
            return
        yield head, block


_RECORD = ("part int, volume int, at bigint, type string, record_id string, page_id bigint, uri string, "
           "refers_to_id string, digest string, {}error string")
_FIELDS = ("part", "volume", "at", "type", "record_id", "page_id", "uri", "refers_to_id", "digest")


def _header_row(part: int, volume: int, at: int, head: dict) -> list:
    pid, digest = head.get("page-id", ""), head.get("warc-payload-digest", "")
    return [part, volume, at, head.get("warc-type"), head.get("warc-record-id"),
            int(pid) if pid.lstrip("-").isdigit() else None, head.get("warc-target-uri"), head.get("warc-refers-to"),
            digest.removeprefix("sha256:") or None]


def _decoded(block: bytes, head_type: str | None, digest: str | None):
    """(payload, error) of a complete block."""
    if head_type != "response":
        return None, None
    try:
        data = http_payload(block)
    except ValueError as e:
        return None, str(e)
    if digest and hashlib.sha256(data).hexdigest() != digest:
        return None, "payload digest differs"
    return data, None


def _volumes(batches, root: str):
    for b in batches:
        for row in b.to_pylist():
            store, folder = open_store(root)
            # the members are gzip already: no codec by file name
            with store.open_input_stream(f"{folder}/{row['name']}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                try:
                    for at, (head, block) in enumerate(parse_records(stream)):
                        yield row["part"], row["volume"], at, head, block
                except (OSError, EOFError, zlib.error) as e:   # a damaged volume: what was read before counts
                    yield row["part"], row["volume"], -1, {"error": f"damaged volume: {e}"}, b""


def _emit(rows: list, schema: pa.Schema):
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def _arrow(extra: list) -> pa.Schema:
    base = [("part", pa.int32()), ("volume", pa.int32()), ("at", pa.int64()), ("type", pa.string()), ("record_id", pa.string()),
            ("page_id", pa.int64()), ("uri", pa.string()), ("refers_to_id", pa.string()), ("digest", pa.string())]
    return pa.schema(base + extra + [("error", pa.string())])


def _in_batches(rows, schema: pa.Schema, size: int):
    held, n = [], 0
    for row, weight in rows:
        held.append(row)
        n += weight + 200
        if n >= size:
            yield _emit(held, schema)
            held, n = [], 0
    if held:
        yield _emit(held, schema)


def read_archives(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """All records of the manifest's volumes: header fields, payload (null for revisits and failures) and error."""
    n = max(1, min(manifest.count(), 10_000))
    volumes = manifest.repartition(n)
    whole_schema = _arrow([("payload", pa.binary())])
    part_schema = _arrow([("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])

    def whole(batches):
        def rows():
            for part, volume, at, head, block in _volumes(batches, root):
                if "warc-segment-number" in head and "error" not in head:
                    continue
                data, err = (None, head["error"]) if "error" in head else _decoded(
                    block, head.get("warc-type"), head.get("warc-payload-digest", "").removeprefix("sha256:"))
                yield [*_header_row(part, volume, at, head), data, err], len(data or b"")
        yield from _in_batches(rows(), whole_schema, 8 << 20)

    def segments(batches):
        def rows():
            for part, volume, at, head, block in _volumes(batches, root):
                num = head.get("warc-segment-number", "")
                if not num.isdigit() or "error" in head:
                    continue
                total = head.get("warc-segment-total-length", "")
                origin = head.get("warc-segment-origin-id") or head.get("warc-record-id")
                yield [*_header_row(part, volume, at, head), origin, int(num), int(total) if total.isdigit() else None,
                       block, None], len(block)
        yield from _in_batches(rows(), part_schema, 8 << 20)

    def assemble(batches):
        def rows():
            for b in batches:
                for group in b.column(0):
                    by_number: dict[int, list] = {}
                    for s in group.as_py():
                        by_number.setdefault(s["segment"], []).append(s)
                    for c, head in enumerate(by_number.get(1, [])):   # rows written twice have one id: the c-th copy of each
                        run = [by_number[k][c] for k in range(1, len(by_number) + 1) if len(by_number.get(k, ())) > c]
                        block, total = b"".join(s["block"] for s in run), run[-1]["total"]
                        data, err = None, None
                        if len(run) < len(by_number) or total is None:
                            err = "segments missing"
                        elif len(block) != total:
                            err = f"segments hold {len(block)} bytes of {total}"
                        else:
                            data, err = _decoded(block, head["type"], head["digest"])
                        yield [*(head[f] for f in _FIELDS), data, err], len(data or b"")
                    if 1 not in by_number:
                        s = min((x for v in by_number.values() for x in v), key=lambda x: x["segment"])
                        yield [*(s[f] for f in _FIELDS), None, "first segment missing"], 0
        yield from _in_batches(rows(), whole_schema, 8 << 20)

    out = _RECORD.format("payload binary, ")
    pieces = volumes.mapInArrow(segments, _RECORD.format("origin string, segment int, total bigint, block binary, "))
    one = F.struct("segment", "volume", "at", *[c for c in pieces.columns if c not in ("segment", "volume", "at", "error")])
    groups = pieces.groupBy("part", "origin").agg(F.sort_array(F.collect_list(one)).alias("segments")).select("segments")
    return volumes.mapInArrow(whole, out).unionByName(groups.mapInArrow(assemble, out))


def resolve_revisits(spark: SparkSession, records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, error) per record; a revisit takes length and
    digest from the response that it names."""
    stage = Stage(spark, "warc-digest")
    slim = stage.put(records.select(
        "page_id", "type", "record_id", "refers_to_id", F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"), "error"))
    target = (slim.filter("type = 'response' AND error IS NULL").dropDuplicates(["record_id"])
              .select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("to_page"),
                      F.col("payload_bytes").alias("to_bytes"), F.col("payload_digest").alias("to_digest")))
    page = F.when(F.col("page_id") != NULL_ID, F.col("page_id")).alias("page_id")
    back = slim.filter("type = 'revisit'").join(target, "refers_to_id", "left").select(
        page, F.col("to_bytes").alias("payload_bytes"), F.col("to_digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.when(F.col("to_page") != NULL_ID, F.col("to_page")).alias("refers_to"), "error")
    return back.unionByName(slim.filter("type <> 'revisit' OR type IS NULL").select(
        page, "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        F.lit(None).cast("bigint").alias("refers_to"), "error"))
