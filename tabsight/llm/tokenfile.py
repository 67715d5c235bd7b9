"""Token-id files: Arrow IPC files of fixed-size-list batches with zero-copy random access.

A part is a pair of Arrow files in one shared folder: ``tokens-*.arrow`` has one row per sequence of ``seq_len`` ids
(``ids`` fixed_size_list<uint16 or uint32>, ``mask`` fixed_size_list<bool>; only a part's last sequence is padded), and
``index-*.arrow`` one row per document (doc_id, start in the part, n_tokens).  Parts follow each other in ascending
doc_id order, so a document's position in the corpus is its part's base plus its start.  File names hold a random part:
a task that runs twice writes two files, and only those that the manifest names count.

Null text counts as empty (the end id alone).  Documents with equal ids stand next to each other, ordered by text.  An
empty table gives an empty manifest.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.llm.staging import Stage, from_iid, iid, open_store
from tabsight.llm.textbatch import lean, text_slices
from tabsight.llm.wordtok import WordTokenizer

#: largest id that 16 bits hold
MAX_NARROW = (1 << 16) - 1

#: sequences per record batch
BATCH_ROWS = 256


@dataclass
class TokenFiles:
    """Manifest of a written corpus: rows (part, tokens, index, n_docs, n_tokens, base) in corpus order."""
    root: str
    seq_len: int
    parts: list


def token_schema(seq_len: int, wide: bool) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), seq_len)),
                      ("mask", pa.list_(pa.bool_(), seq_len))])


class PartWriter:
    """Streams ids into equal-length sequences; memory is one record batch."""

    def __init__(self, sink, seq_len: int, wide: bool):
        self.schema, self.seq_len = token_schema(seq_len, wide), seq_len
        self.kind = np.uint32 if wide else np.uint16
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.buf = np.zeros(BATCH_ROWS * seq_len, dtype=self.kind)
        self.fill = 0

    def add(self, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            n = min(len(ids) - at, len(self.buf) - self.fill)
            self.buf[self.fill:self.fill + n] = ids[at:at + n]
            self.fill, at = self.fill + n, at + n
            if self.fill == len(self.buf):
                self._flush()

    def _flush(self) -> None:
        rows = -(-self.fill // self.seq_len)
        size = rows * self.seq_len
        self.buf[self.fill:size] = 0
        mask = np.arange(size) < self.fill
        ids = pa.FixedSizeListArray.from_arrays(pa.array(self.buf[:size].copy()), type=self.schema.field("ids").type)
        msk = pa.FixedSizeListArray.from_arrays(pa.array(mask), type=self.schema.field("mask").type)
        self.writer.write_batch(pa.record_batch([ids, msk], schema=self.schema))
        self.fill = 0

    def close(self) -> None:
        if self.fill:
            self._flush()
        self.writer.close()


class PartReader:
    """Random access to the sequences of one part; a local file is memory-mapped and its buffers are used in place."""

    def __init__(self, root: str, name: str):
        store, folder = open_store(root)
        path = f"{folder}/{name}"
        from pyarrow import fs
        self.source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.seq_len = self.file.schema.field("ids").type.list_size

    def batch(self, k: int) -> np.ndarray:
        """All ids of record batch ``k`` as one flat array (no copy on a memory map)."""
        col = self.file.get_batch(k).column(0)
        return col.values.to_numpy()[col.offset * self.seq_len:(col.offset + len(col)) * self.seq_len]

    def sequence(self, i: int):
        """(ids, mask) of sequence ``i``."""
        b = self.file.get_batch(i // BATCH_ROWS)
        r = i % BATCH_ROWS
        return b.column(0)[r].values.to_numpy(), b.column(1)[r].values

    def span(self, start: int, n: int):
        """The ids start..start+n, as consecutive pieces."""
        per = BATCH_ROWS * self.seq_len
        while n > 0:
            k, at = divmod(start, per)
            part = self.batch(k)[at:at + n]
            yield part
            start, n = start + len(part), n - len(part)

    def close(self) -> None:
        self.source.close()


def write_token_files(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 2,
                      seq_len: int = 2048, wide: bool | None = None, parts: int | None = None) -> TokenFiles:
    """Encode every document (+ ``end_id``) in ascending doc_id order into parts below the shared folder.

    ``wide`` stores 32-bit ids, False 16-bit ones (an error if the vocabulary or ``end_id`` does not fit); by default the
    largest id decides."""
    top = max(end_id, WordTokenizer.shared(tokenizer_path).top_id)
    if wide is None:
        wide = top > MAX_NARROW
    elif not wide and top > MAX_NARROW:
        raise ValueError(f"id {top} does not fit in 16 bits")
    stage = Stage(spark, "tokenfile")
    root = stage.path("parts")

    @lean
    def run(batches):
        from pyspark import TaskContext
        tok, part = WordTokenizer.shared(tokenizer_path), TaskContext.get().partitionId()
        store, folder = open_store(root)
        store.create_dir(folder, recursive=True)
        name = f"{part:06d}-{uuid.uuid4().hex}.arrow"
        sink = index = None
        n_docs = at = 0
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        for b in batches:
            ids = b.column(0).to_pylist()
            for lo, texts in text_slices(b):
                hi = lo + len(texts)
                flat, offs = tok.encode(texts)
                if sink is None:
                    out = store.open_output_stream(f"{folder}/tokens-{name}")
                    sink = PartWriter(out, seq_len, wide)
                    idx_out = store.open_output_stream(f"{folder}/index-{name}")
                    index = pa.ipc.new_file(idx_out, schema)
                # every document's ids, then its end id
                full = np.insert(flat, offs[1:], end_id).astype(sink.kind)
                sink.add(full)
                lens = np.diff(offs) + 1
                starts = at + np.cumsum(lens) - lens
                at += len(full)
                index.write_batch(pa.record_batch([pa.array(ids[lo:hi], pa.int64()), pa.array(starts, pa.int64()),
                                                   pa.array(lens, pa.int64())], schema=schema))
                n_docs += hi - lo
        if sink is not None:
            sink.close()
            out.close()
            index.close()
            idx_out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([f"tokens-{name}"]), pa.array([f"index-{name}"]),
                 pa.array([n_docs], pa.int64()), pa.array([at], pa.int64())],
                names=["part", "tokens", "index", "n_docs", "n_tokens"])

    rows = docs.select(iid().alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = (rows.repartitionByRange(parts, "doc_id") if parts else rows.repartitionByRange("doc_id"))
    manifest = stage.put(rows.sortWithinPartitions("doc_id", "text").mapInArrow(
        run, "part int, tokens string, index string, n_docs bigint, n_tokens bigint"))
    base, out = 0, []
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):   # one row per part
        out.append((r["part"], r["tokens"], r["index"], r["n_docs"], r["n_tokens"], base))
        base += r["n_tokens"]
    return TokenFiles(root, seq_len, out)


def read_token_index(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """Read the files back: one row per document (doc_id, start in the corpus, n_tokens, ids_crc32)."""
    root = files.root

    def run(batches):
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for b in batches:
            for row in b.to_pylist():
                tokens, index = PartReader(root, row["tokens"]), None
                store, folder = open_store(root)
                with store.open_input_file(f"{folder}/{row['index']}") as src:
                    index = pa.ipc.open_file(src)
                    for k in range(index.num_record_batches):
                        ib = index.get_batch(k)
                        starts, lens, crcs = ib.column(1).to_pylist(), ib.column(2).to_pylist(), []
                        for s, n in zip(starts, lens):
                            crc = 0
                            for part in tokens.span(s, n):
                                crc = zlib.crc32(part.astype("<u4"), crc)
                            crcs.append(crc)
                        yield pa.RecordBatch.from_arrays(
                            [ib.column(0), pa.array(np.array(starts, np.int64) + row["base"]), ib.column(2),
                             pa.array(crcs, pa.int64())], names=names)
                tokens.close()

    schema = "part int, tokens string, index string, n_docs bigint, n_tokens bigint, base bigint"
    parts = spark.createDataFrame(files.parts, schema)
    if files.parts:
        parts = parts.repartition(len(files.parts))
    return parts.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint").withColumn(
        "doc_id", from_iid("doc_id"))
