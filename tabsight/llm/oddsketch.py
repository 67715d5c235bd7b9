"""MinHash near-duplicates verified by odd sketches.

1. Each task turns whole texts into sets of distinct word shingles (64-bit hashes), takes ``samples`` MinHash values and
   folds them into a parity bitmap of ``bits`` bits (the odd sketch).  ``bands`` groups of the samples become bucket keys.
2. Rows get a number; rows with equal sets collapse into one class, represented by its smallest row number.
3. Star phase: in every bucket each representative is a candidate with the bucket's smallest one.  Candidates whose
   sketches' XOR population count exceeds :func:`popcount_cut` are dropped (a true link fails with probability < 1e-9);
   the others are compared on their full sets.  Components of the confirmed links label the representatives.
4. Block phase: buckets that still hold several labels are dealt into chunks of about ``chunk`` members and
   ``chunk_shingles`` shingles (so a block's memory is bounded), every two chunks of a bucket meet in one block, and pairs with different labels that pass the sketch test are compared on full sets;
   a block reports only links between parts that it has not yet joined.  So every candidate pair of every bucket is
   either in one component already or has been tested, and no step emits the pairs of a group.
5. Components of all confirmed links.

A pair at the threshold of 0.8 shares no band with probability (1 - 0.8^4)^32 < 5e-8 with the defaults.

Everything between goes by row number; the id only orders and names: a component is named after its smallest id (null
ids come first) and keeps one row, the first by (id, text hash, row number).  So rows without an id, and rows that repeat
an id, are documents of their own.  Text without words (or null) has the empty set and is linked with nothing.  An empty
table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.llm.components import connected_components, joined_labels
from tabsight.llm.staging import Stage, from_iid, iid, text_tie
from tabsight.llm.textbatch import mix64, split_words, text_slices, word_hashes

BANDS, ROWS = 32, 4
BITS = 512
_WORDS = BITS // 64
_SKETCH = [f"s{i}" for i in range(_WORDS)]


def shingle_sets(texts: pa.Array, width: int):
    """Sorted distinct shingle hashes of each text, as one flat array and its offsets."""
    doc, word, words = split_words(pc.ascii_lower(texts))
    n = len(texts)
    counts = np.bincount(doc, minlength=n)
    starts = np.concatenate([[0], np.cumsum(counts)])
    h = mix64(word_hashes(words))[word] if len(words) else np.zeros(0, np.uint64)
    span = np.minimum(counts, width)
    m = np.where(counts > 0, counts - span + 1, 0)
    offs = np.concatenate([[0], np.cumsum(m)])
    at = np.arange(offs[-1]) - np.repeat(offs[:-1] - starts[:-1], m)
    size = np.repeat(span, m)
    flat = size.astype(np.uint64)
    for j in range(width):
        use = size > j
        nxt = flat * np.uint64(0x9E3779B97F4A7C15) + h[np.where(use, at + j, 0)] if len(h) else flat
        flat = np.where(use, nxt, flat)
    flat = mix64(flat)
    for s, e in zip(offs[:-1].tolist(), offs[1:].tolist()):
        flat[s:e].sort()
    first = np.ones(len(flat), dtype=bool)
    first[1:] = flat[1:] != flat[:-1]
    first[offs[:-1][m > 0]] = True
    owner = np.repeat(np.arange(n), m)[first]
    return flat[first], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def minhash(flat: np.ndarray, offs: np.ndarray, samples: int) -> np.ndarray:
    """(texts with a set) x samples MinHash values of 32 bits; rows of empty sets are left out."""
    full = offs[:-1][np.diff(offs) > 0]
    rng = np.random.default_rng(20240229)
    mul = rng.integers(0, 2 ** 31, samples, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 2 ** 32, samples, dtype=np.uint32)
    x = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
    out = np.empty((len(full), samples), dtype=np.uint32)
    if not len(full):
        return out
    step, lo = 1 << 15, 0
    bounds = np.append(full, len(x))
    while lo < len(full):   # runs of whole sets that stay in the processor's cache
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + step, side="right")) - 1)
        part, cut = x[bounds[lo]:bounds[hi]], bounds[lo:hi] - bounds[lo]
        for k in range(samples):
            out[lo:hi, k] = np.minimum.reduceat(part * mul[k] + add[k], cut)
        lo = hi
    return out


def odd_sketches(sig: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Parity bitmaps of the samples (sample number and value), as ``bits / 64`` 64-bit words a row."""
    n, k = sig.shape
    pos = (mix64((np.arange(k, dtype=np.uint64)[None, :] << np.uint64(32)) | sig) % np.uint64(bits)).astype(np.int64)
    flat = np.bincount((np.arange(n)[:, None] * bits + pos).ravel(), minlength=n * bits) & 1
    return np.packbits(flat.astype(np.uint8).reshape(n, bits), axis=1, bitorder="little").view(np.uint64)


def popcount_cut(samples: int, bits: int, similarity: float, sigmas: float = 6.5) -> int:
    """Largest XOR population count that a pair of at least this similarity shows, up to ``sigmas`` deviations."""
    miss = samples * (1 - similarity) + sigmas * math.sqrt(samples * similarity * (1 - similarity))
    toggles = 2 * min(miss, samples)
    mean = bits / 2 * (1 - (1 - 2 / bits) ** toggles)
    return int(mean + 3 * math.sqrt(mean * (1 - mean / bits)))


def estimated_jaccard(popcount: np.ndarray, samples: int, bits: int) -> np.ndarray:
    """Similarity that an XOR population count stands for."""
    return 1 + bits / (4 * samples) * np.log(np.maximum(1 - 2 * popcount / bits, 1e-9))


def document_profiles(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(id, tie, n_shingles, set hashes, bucket keys, sketch) per row; keys and sketch are null for empty sets."""

    def run(batches):
        for b in batches:
            ids, ties = _col(b, "id"), _col(b, "tie")
            for lo, texts in text_slices(b):
                flat, offs = shingle_sets(texts, width)
                n = np.diff(offs)
                full = np.flatnonzero(n > 0)
                sig = minhash(flat, offs, bands * rows)
                key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(full), bands)).copy()
                for r in range(rows):
                    key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::rows])
                sk = odd_sketches(sig) if len(full) else np.zeros((0, _WORDS), np.uint64)
                data, dig = flat.tobytes(), np.zeros((len(n), 2), dtype=np.int64)
                for i in full:
                    d = xxhash.xxh3_128_intdigest(memoryview(data)[8 * offs[i]:8 * offs[i + 1]])
                    dig[i] = np.array([d >> 64, d & (2 ** 64 - 1)], dtype=np.uint64).view(np.int64)
                row = np.full(len(n), -1)
                row[full] = np.arange(len(full))
                pick = pa.array(row, mask=row < 0)
                keys = pa.ListArray.from_arrays(np.arange(0, key.size + 1, bands, dtype=np.int32),
                                                pa.array(key.view(np.int64).ravel()))
                cols = [ids.slice(lo, len(n)), ties.slice(lo, len(n)), pa.array(n.astype(np.int64)), pa.array(dig[:, 0]), pa.array(dig[:, 1]),
                        keys.take(pick)]
                cols += [pa.array(np.ascontiguousarray(sk[:, i]).view(np.int64)).take(pick) for i in range(_WORDS)]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "tie", "n_shingles", "d1", "d2", "bands", *_SKETCH])

    return docs.select(iid().alias("id"), text_tie().alias("tie"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "id bigint, tie bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>, "
             + ", ".join(f"{s} bigint" for s in _SKETCH))


def document_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc, shingles): the full set of each document of ``docs`` (doc, text)."""

    def run(batches):
        for b in batches:
            ids = b.column(b.schema.get_field_index("doc"))
            for lo, texts in text_slices(b, max_bytes=2 << 20):
                flat, offs = shingle_sets(texts, width)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, len(texts)), pa.ListArray.from_arrays(offs.astype(np.int32), flat.view(np.int64))],
                    names=["doc", "shingles"])

    return docs.mapInArrow(run, "doc bigint, shingles array<bigint>")


def _xor_count(a: str, b: str):
    return sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in _SKETCH[1:]),
               F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))))


def _runs(batches, keys: list[str]):
    """Consecutive rows with equal keys, as record batches; a run may cross batches."""
    held = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy() for k in keys]
        new = np.zeros(b.num_rows, dtype=bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for s, e in zip(cuts[:-1], cuts[1:]):
            part = b.slice(s, e - s)
            if s == 0 and held and any(held[-1].column(held[-1].schema.get_field_index(k))[0] != part.column(
                    part.schema.get_field_index(k))[0] for k in keys):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            elif s and held:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _col(b: pa.RecordBatch, name: str):
    return b.column(b.schema.get_field_index(name))


def _open_pairs(b: pa.RecordBatch, cut: int, bands: int):
    """Index pairs of a block that differ in label, meet in no earlier band and pass the sketch test."""
    key, i, j = (_col(b, c)[0].as_py() for c in ("key", "i", "j"))
    label, side = _col(b, "label").to_numpy(), _col(b, "c").to_numpy()
    sk = np.column_stack([_col(b, s).to_numpy() for s in _SKETCH]).view(np.uint64)
    buckets = _col(b, "bands").values.to_numpy()
    off = _col(b, "bands").offset
    buckets = buckets[off * bands:(off + len(b)) * bands].reshape(-1, bands)
    left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
    for s in range(0, len(left), 64):
        rows = left[s:s + 64]
        pop = np.bitwise_count(sk[rows][:, None, :] ^ sk[right][None, :, :]).sum(axis=2)
        ok = (pop <= cut) & (label[rows][:, None] != label[right][None, :])
        if i == j:
            ok &= rows[:, None] < right[None, :]
        x, y = np.nonzero(ok)
        x, y = rows[x], right[y]
        if len(x):
            same = buckets[x] == buckets[y]
            first = same.argmax(axis=1)
            mine = buckets[x, first] == key
            yield from zip(x[mine].tolist(), y[mine].tolist())


def _block_members(cut: int, bands: int):
    """Members of each block that have an open pair there."""

    def run(batches):
        for b in _runs(batches, ["key", "i", "j"]):
            need = {x for pair in _open_pairs(b, cut, bands) for x in pair}
            if need:
                yield b.take(pa.array(sorted(need)))

    return run


def _block_links(cut: int, bands: int, percent: int):
    """Links between parts of a block that no label and no earlier link of the block has joined."""

    def run(batches):
        for b in _runs(batches, ["key", "i", "j"]):
            label, doc = _col(b, "label").to_pylist(), _col(b, "doc").to_pylist()
            sets = [s.values.to_numpy() for s in _col(b, "shingles")]
            up: dict = {}

            def root(x):
                while x in up:
                    x = up[x]
                return x

            found = []
            for x, y in _open_pairs(b, cut, bands):
                p, q = root(label[x]), root(label[y])
                if p == q:
                    continue
                n = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * n >= percent * (len(sets[x]) + len(sets[y]) - n):
                    up[max(p, q)] = min(p, q)
                    found.append((doc[x], doc[y]))
            if found:
                a, c = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])

    return run


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS,
                    rows: int = ROWS, chunk: int = 2048, chunk_shingles: int = 1 << 21, ties: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) and, with ``ties``, tie (the text's hash) per row of ``docs``: documents whose shingle sets have a Jaccard
    similarity of at least ``percent`` / 100 are linked; a component is named after its smallest doc_id."""
    stage = Stage(spark, "neardup")
    cut = popcount_cut(bands * rows, BITS, percent / 100)
    prof = stage.put(document_profiles(docs, width, bands, rows).withColumn("doc", F.monotonically_increasing_id()))
    classes = stage.put(prof.filter("n_shingles > 0").groupBy("d1", "d2").agg(
        F.min("doc").alias("rep"), F.min(F.struct("id", "tie", "doc")).alias("first")))
    reps = (prof.filter("n_shingles > 0").join(classes.select("d1", "d2", F.col("rep").alias("doc")), ["d1", "d2", "doc"])
            .select("doc", "id", "tie", "n_shingles", "bands", *_SKETCH))
    reps = stage.put(reps)

    keyed = reps.select("doc", "n_shingles", F.explode("bands").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("doc").alias("hub"), F.max("doc").alias("top"))
    shared = stage.put(keyed.join(hubs.filter("hub != top").drop("top"), "key"))
    texts = docs.select(iid().alias("id"), text_tie().alias("tie"), F.col("text").cast("string").alias("text"))
    full = texts.join(reps.select("doc", "id", "tie").join(shared.select("doc").distinct(), "doc", "left_semi"), ["id", "tie"])
    if not prof.groupBy("id", "tie").count().filter("count > 1").isEmpty():
        full = full.dropDuplicates(["id", "tie"])   # exact repeats of a row
    sets = stage.put(document_sets(full.select("doc", "text"), width))

    star = shared.filter("doc != hub").select("hub", "doc").distinct()
    sketch = reps.select("doc", *_SKETCH)
    star = (star.join(sketch.alias("x"), "doc")
            .join(sketch.withColumnRenamed("doc", "hub").alias("y"), "hub")
            .filter(_xor_count("x", "y") <= cut).select("hub", "doc"))
    links = stage.put(_confirmed(star, sets, percent))
    labels = connected_components(stage, links)

    marked = (shared.select("key", "doc", "n_shingles").join(labels, shared["doc"] == labels["node"], "left")
              .select("key", "doc", "n_shingles", F.coalesce("label", "doc").alias("label")))
    marked = stage.put(marked)
    mixed = (marked.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n"),
                                       F.sum("n_shingles").alias("size"))
             .filter("lo != hi")
             .select("key", F.ceil(F.greatest(F.col("n") / chunk, F.col("size") / chunk_shingles)).alias("chunks")))
    members = (marked.join(mixed, "key")
               .withColumn("c", F.pmod(F.xxhash64("doc"), F.col("chunks")))
               .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
               .select("key", F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j"), "c", "doc", "label"))
    block = members.join(reps.select("doc", "bands", *_SKETCH), "doc").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "doc")
    kind = block.schema
    needed = stage.put(block.mapInArrow(_block_members(cut, bands), kind))
    block = needed.join(sets, "doc").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "doc")
    more, (n_more, _) = stage.put_counted(block.mapInArrow(_block_links(cut, bands, percent), "a bigint, b bigint"), "a", "b")
    if n_more:
        labels = joined_labels(stage, labels, more)

    named = classes.join(labels, classes["rep"] == labels["node"], "left").select(
        "d1", "d2", "first", F.coalesce("label", "rep").alias("label"))
    rep_label = named.select("d1", "d2", "label").join(named.groupBy("label").agg(F.min("first").alias("first")), "label")
    out = stage.put(
        prof.filter("n_shingles > 0").select("id", "tie", "doc", "n_shingles", "d1", "d2").join(rep_label, ["d1", "d2"])
        .select("id", "tie", "n_shingles", F.col("first.id").alias("component"), (F.col("doc") == F.col("first.doc")).alias("kept"))
        .unionByName(prof.filter("n_shingles = 0").select("id", "tie", "n_shingles", F.col("id").alias("component"),
                                                          F.lit(True).alias("kept"))))
    stage.drop(prof, classes, reps, shared, sets, links, marked, needed, more)
    return out.select(from_iid("id").alias("doc_id"), "n_shingles", from_iid("component").alias("component_id"), "kept",
                      *(["tie"] if ties else []))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (hub, doc) whose full sets reach the similarity, as links (a, b)."""
    joined = (pairs.join(sets.select("doc", F.col("shingles").alias("p")), "doc")
              .join(sets.select(F.col("doc").alias("hub"), F.col("shingles").alias("q")), "hub"))
    # 100 * both >= percent * union, with union = |p| + |q| - both
    return (joined.filter((100 + percent) * F.size(F.array_intersect("p", "q")) >= percent * (F.size("p") + F.size("q")))
            .select(F.col("hub").alias("a"), F.col("doc").alias("b")))
