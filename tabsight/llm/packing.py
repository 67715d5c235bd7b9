"""Best-fit packing by exact-complement hashing.

1. One pass tokenizes whole texts, cuts only documents longer than ``max_len`` and numbers the pieces of every length
   inside its task (``chunk``, ``lrank``).  No text is shuffled.
2. The histogram of piece lengths (at most ``max_len`` rows, whatever the corpus) goes to the driver, where
   :func:`plan_packs` consumes, longest pieces first, singles, pairs and triples whose lengths exactly fill the gap, as
   many copies at once as the availability counts allow; gaps without exact complement take the best-fitting (longest)
   piece and are tried again.
3. A piece's rank among all pieces of its length (running sum of the per-chunk counts + ``lrank``) selects its place in
   the plan.  A hot length is spread over all chunks; no task holds a length or a sequence.

Null text counts as empty (the end id alone).  Repeated rows and ids are packed as often as they occur.  An empty
table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabsight.llm.staging import Stage, from_iid, iid
from tabsight.llm.textbatch import lean, text_slices
from tabsight.llm.wordtok import CACHE_WORDS, WordTokenizer

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, chunk int, lrank bigint"


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, max_len: int, cache_words: int = CACHE_WORDS) -> DataFrame:
    """One row per piece of at most ``max_len`` ids; ``lrank`` numbers the pieces of equal length within ``chunk``."""
    end = np.array([end_id], "<u4").tobytes()

    @lean
    def run(batches):
        from pyspark import TaskContext
        tok, chunk, seen = WordTokenizer.shared(tokenizer_path, cache_words), TaskContext.get().partitionId(), {}
        for b in batches:
            ids = b.column(0).to_pylist()
            for lo, texts in text_slices(b):
                flat, offs = tok.encode(texts)
                rows = []
                for d, s, e in zip(ids[lo:lo + len(texts)], offs[:-1].tolist(), offs[1:].tolist()):
                    data = flat[s:e].tobytes() + end
                    for p, at in enumerate(range(0, len(data), 4 * max_len)):
                        part = data[at:at + 4 * max_len]
                        n = len(part) // 4
                        r = seen.get(n, 0)
                        seen[n] = r + 1
                        rows.append((d, p, at // 4, n, zlib.crc32(part), chunk, r))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()),
                     pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int32()),
                     pa.array(cols[6], pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "lrank"])

    return docs.select(iid().alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _PIECES)


def _pair(avail: np.ndarray, gap: int, top: int):
    """A pair of available lengths (longest first) with the given sum, or None."""
    lo, hi = max(1, gap - top), min(top, gap - 1)
    if lo > hi:
        return None
    big = np.arange(hi, (gap - 1) // 2, -1)
    ok = (avail[big] > 0) & (avail[gap - big] > 0)
    if gap % 2 == 0 and avail[gap // 2] < 2:
        ok &= big != gap // 2
    k = int(ok.argmax()) if len(ok) else 0
    return (int(big[k]), gap - int(big[k])) if len(ok) and ok[k] else None


def plan_packs(hist: dict[int, int], max_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Packs as (piece lengths, number of sequences with exactly these lengths); uses every piece once."""
    avail = np.zeros(max_len + 1, dtype=np.int64)
    for n, c in hist.items():
        avail[n] = c
    packs, age, sums = [], 10 ** 9, None
    while True:
        left = np.flatnonzero(avail)
        if not len(left):
            return packs
        if age >= 64:   # sums of two available lengths; stale entries are only ever too many
            have = (avail > 0).astype(np.float64)
            size = 1 << (2 * max_len + 2).bit_length()
            f = np.fft.rfft(have, size)
            sums, age = np.fft.irfft(f * f, size)[:max_len + 1] > 0.5, 0
        age += 1
        top = int(left[-1])
        pack, gap = [top], max_len - top
        avail[top] -= 1
        while gap:
            if avail[gap] > 0:
                add = (gap,)
            else:
                add = _pair(avail, gap, top) if sums[gap] else None
                if add is None and gap >= 3:
                    first = np.arange(min(top, gap - 2), 0, -1)
                    for a in first[(avail[first] > 0) & sums[gap - first]]:
                        avail[a] -= 1
                        rest = _pair(avail, gap - int(a), top)
                        avail[a] += 1
                        if rest:
                            add = (int(a), *rest)
                            break
                if add is None:
                    fit = np.flatnonzero(avail[:gap + 1])
                    if not len(fit):
                        break
                    add = (int(fit[-1]),)
            for n in add:
                avail[n] -= 1
                pack.append(n)
                gap -= n
        lengths, counts = np.unique(pack, return_counts=True)
        more = int((avail[lengths] // counts).min())
        np.subtract.at(avail, lengths, counts * more)
        packs.append((tuple(pack), more + 1))


def plan_slots(packs, max_len: int):
    """Sorted arrays (key = length << 40 | first rank, first sequence id, offset) that map a piece's rank to its place."""
    keys, seqs, offs, used, base = [], [], [], {}, 0
    for lengths, n in packs:
        at = 0
        for ln in lengths:
            r = used.get(ln, 0)
            keys.append((ln << 40) | r)
            seqs.append(base)
            offs.append(at)
            used[ln] = r + n
            at += ln
        base += n
    order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
    return tuple(np.array(x, dtype=np.int64)[order] for x in (keys, seqs, offs))


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 1,
                   max_len: int = 4096, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Pack whole documents: (doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece.  ``cache_words`` bounds
    the words whose ids a worker keeps."""
    stage = Stage(spark, "packing")
    pieces = stage.put(token_pieces(docs, tokenizer_path, end_id, max_len, cache_words))
    counts = pieces.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n"))
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    keys, seqs, offs = plan_slots(plan_packs(hist, max_len), max_len)
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("chunk")) - F.col("n")).drop("n")

    def place(batches):
        for b in batches:
            ln, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            key = (ln << 40) | rank
            k = np.searchsorted(keys, key, side="right") - 1
            cols = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seqs[k] + (key - keys[k])), pa.array(offs[k])], names=[
                "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(before, ["length", "chunk"]).withColumn("rank", F.col("before") + F.col("lrank"))
    placed = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return placed.withColumn("doc_id", from_iid("doc_id"))
