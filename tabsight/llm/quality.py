"""Quality rules: counts of each whole text, and a hashed n-gram log-likelihood ratio.

Two multinomials over ``buckets`` hash buckets of word and character-trigram features: the trusted target (every
document labelled 1) and the raw corpus (every document).  A document's score is the mean over its features of
log p_target(bucket) / p_raw(bucket); it passes if the score reaches one threshold, taken from the scores of all labelled
documents (:func:`learn_threshold`).  Both multinomials are smoothed with ``alpha`` per bucket.  Every document is scored
over its whole text.  Labels are joined by Spark and never come to the driver, save as a bitmap of fixed size that tells which
texts need not move to them (:func:`may_hold`).

Each task turns a slice of texts into word ids; features are computed once per distinct word of the slice.  Null text
has no words: it fails the base rules and scores 0.  An empty table gives no rows; without labelled documents the
ratio rejects nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.llm.staging import Stage, from_iid, iid
from tabsight.llm.textbatch import gram_chunks, lean, split_words, text_slices, word_hashes
from tabsight.operators.quantiles import exact_quantiles

BUCKETS = 1 << 16
#: share of the trusted documents that the threshold may reject
TRUSTED_LOSS = 0.002
#: slots of the bitmap that rules documents without a label out before a join (4 MB)
SLOTS = 1 << 25

_SYMBOLS = "[#*$%&|<>]"


def word_features(words: pa.Array, buckets: int):
    """Chunks of (word index, bucket) that hold every feature: the words themselves and their character trigrams.

    Trigrams are lower-cased, and salted in words with an upper-case letter behind the first character."""
    yield np.arange(len(words)), (word_hashes(words) % np.uint64(buckets)).astype(np.int64)
    shout = np.fromiter((x[1:] != x[1:].lower() for x in words.to_pylist()), dtype=bool, count=len(words))
    for w, g in gram_chunks(words, (3,)):
        yield w, (np.where(shout[w], g ^ np.uint64(0x5851F42D4C957F2D), g) % np.uint64(buckets)).astype(np.int64)


def feature_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over the column text of all rows."""

    @lean
    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for _, texts in text_slices(b):
                _, word, words = split_words(texts)
                if not len(word):
                    continue
                times = np.bincount(word, minlength=len(words))
                for w, h in word_features(words, buckets):
                    total += np.bincount(h, weights=times[w], minlength=buckets).astype(np.int64)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    part = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    return part.groupBy("bucket").agg(F.sum("n").alias("n"))


def ratio_table(raw_rows, target_rows, buckets: int = BUCKETS, alpha: float = 0.5) -> np.ndarray:
    """log p_target / p_raw per bucket from the (bucket, n) rows of all documents and of the target's."""
    raw, tgt = np.full(buckets, alpha), np.full(buckets, alpha)
    for counts, rows in ((raw, raw_rows), (tgt, target_rows)):
        for b, n in rows:
            counts[b] += n
    if tgt.sum() <= alpha * buckets:
        return np.zeros(buckets)
    return np.log(tgt / tgt.sum()) - np.log(raw / raw.sum())


def _line_counts(texts: pa.Array) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text, per text."""
    parts = pc.split_pattern(texts, "\n")
    doc = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    enc = parts.flatten().dictionary_encode()
    ids = enc.indices.to_numpy().astype(np.int64)
    words = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(enc.dictionary)), 0).to_numpy(zero_copy_only=False)
    ok = words[ids]
    key = doc[ok] * np.int64(len(words)) + ids[ok]
    first = np.unique(key) // max(len(words), 1)
    n = len(texts)
    return np.bincount(doc[ok], minlength=n) - np.bincount(first, minlength=n)


def _repeat_words(doc: np.ndarray, word: np.ndarray, n_docs: int, n: int = 5) -> np.ndarray:
    """Words covered by an n-word window that its text holds twice or more, per text (exact, by ranks of id pairs)."""
    out = np.zeros(n_docs, dtype=np.int64)
    m = len(word) - n + 1
    if m <= 0:
        return out
    at = np.flatnonzero(doc[:m] == doc[n - 1:])
    key = doc[at].astype(np.uint64)
    for j in range(n):
        key = (key ^ word[at + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    hit = np.zeros(len(at), dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    at = at[hit]   # windows with an equal hash: settle them exactly
    if not len(at):
        return out
    rows = np.column_stack([doc[at]] + [word[at + j] for j in range(n)])
    _, inv, cnt = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    at = at[cnt[inv.ravel()] > 1]
    cover = np.zeros(len(word) + 1, dtype=np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + n, -1)
    covered = np.cumsum(cover[:-1]) > 0
    return np.bincount(doc[covered], minlength=n_docs)


_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measured(texts: pa.Array, ratios: np.ndarray) -> dict[str, np.ndarray]:
    """Base counts and ``llr`` of a slice of texts."""
    n = len(texts)
    doc, word, words = split_words(texts)
    chars = pc.utf8_length(words).to_numpy().astype(np.int64) if len(words) else np.zeros(0, np.int64)
    syms = pc.count_substring_regex(words, _SYMBOLS).to_numpy().astype(np.int64) if len(words) else chars
    llr = np.zeros(n)
    if len(word):
        ws, wn = np.zeros(len(words)), np.zeros(len(words))
        for w, h in word_features(words, len(ratios)):
            ws += np.bincount(w, weights=ratios[h], minlength=len(words))
            wn += np.bincount(w, minlength=len(words))
        llr = (np.bincount(doc, weights=ws[word], minlength=n)
               / np.maximum(np.bincount(doc, weights=wn[word], minlength=n), 1))
    sums = [np.bincount(doc, weights=v[word], minlength=n).astype(np.int64) for v in (chars, syms)]
    counts = (np.bincount(doc, minlength=n).astype(np.int64), *sums, _line_counts(texts).astype(np.int64),
              _repeat_words(doc, word, n).astype(np.int64))
    return dict(zip(_MEASURES, counts)) | {"llr": llr}


def text_measures(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """Base counts and the length-normalised log-likelihood ratio of every whole text."""
    names = ["doc_id", *_MEASURES, "llr"]

    @lean
    def run(batches):
        for b in batches:
            ids = b.column(b.schema.get_field_index("doc_id"))
            for lo, texts in text_slices(b):
                got = _measured(texts, ratios)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, len(texts)), *(pa.array(got[c]) for c in names[1:])], names=names)

    return docs.select(iid().alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in _MEASURES) + ", llr double")


def _with_margin(t: float, below: float | None) -> float:
    """The threshold for the lowest trusted score ``t`` that is kept and the next lower score of a rejected label."""
    return float(np.nextafter(t, -np.inf)) if below is None else float((t + below) / 2)


def pick_threshold(scores: list[tuple[float, int]], loss: float = TRUSTED_LOSS) -> float:
    """Largest threshold that rejects at most the share ``loss`` of the trusted scores, moved down to halfway above
    the next lower score that belongs to a rejected label (so that trusted scores keep a margin)."""
    good = np.sort(np.array([s for s, q in scores if q == 1]))
    if not len(good):
        return -np.inf
    t = good[int(loss * len(good))]
    return _with_margin(t, max((s for s, q in scores if q == 0 and s < t), default=None))


def score_threshold(scores: DataFrame, loss: float = TRUSTED_LOSS) -> float:
    """:func:`pick_threshold` of a table (llr, quality) of any size; it is read several times."""
    good = scores.filter("quality = 1")
    n, top = good.agg(F.count(F.lit(1)), F.max("llr")).first()
    if not n:
        return -np.inf
    k, t = int(loss * n), top
    if k < n - 1:      # a value between the scores of rank k and k + 1; the first of them is the largest up to it
        between = exact_quantiles(good, ["llr"], [(k + 0.5) / (n - 1)]).first()["value"]
        t = good.filter(F.col("llr") <= between).agg(F.max("llr")).first()[0]
    return _with_margin(t, scores.filter((F.col("quality") == 0) & (F.col("llr") < t)).agg(F.max("llr")).first()[0])


def label_marks(labels: DataFrame) -> DataFrame:
    """(doc, quality): every labelled id, one row per id (lowest label)."""
    return (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
            .groupBy(F.col("doc_id").cast("bigint").alias("doc")).agg(F.min("quality").cast("int").alias("quality")))


@dataclass
class QualityModel:
    """Ratio per bucket, the threshold, and the limits of the base rules."""
    ratios: np.ndarray
    threshold: float
    min_words: int
    max_repeat_pct: int

    def base_failed(self, n_words, n_repeat_words):
        """For Columns and arrays alike."""
        return (n_words < self.min_words) | (100 * n_repeat_words > self.max_repeat_pct * n_words)


def may_hold(docs: DataFrame, ids: DataFrame, key: str, slots: int = SLOTS) -> DataFrame:
    """The rows of ``docs`` whose bigint column ``key`` is, or by its hash may be, in the bigint column ``key`` of ``ids``.

    A bitmap of hashes, a broadcast of at most ``slots`` / 8 bytes whatever the number of ids, rules out the others where they lie;
    with n ids about n / slots of them stay.  A join with the ids settles these."""
    slot = F.xxhash64(key).bitwiseAND(F.lit(slots - 1))
    page, bit = F.shiftright(slot, 15), slot.bitwiseAND(F.lit((1 << 15) - 1))     # Spark's bitmaps are of 4 KB
    pages = (ids.select(page.alias("__page"), bit.alias("__bit")).repartition("__page")
             .groupBy("__page").agg(F.bitmap_construct_agg("__bit").alias("__bits")))
    byte = F.substring("__bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))
    held = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (bit % 8).cast("int")) == 1
    return docs.withColumn("__page", page).join(F.broadcast(pages), "__page").filter(held).select(*docs.columns)


def learn_ratios(docs: DataFrame, marks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The raw model from all of ``docs``, the target model from all documents that ``marks`` has with quality 1.

    Texts are counted where they lie; only those that may be the target's move to their labels.  The hint keeps that join the same at
    every size: no list of ids goes through the driver."""
    trusted = marks.filter("quality = 1").select("doc")
    target = may_hold(docs.select(iid().alias("doc"), "text"), trusted, "doc")
    target = target.join(trusted.hint("merge"), "doc")      # ids are unique there; a semi join would be moved below the bitmap
    raw, tgt = ([tuple(r) for r in feature_counts(d, buckets).collect()] for d in (docs, target))   # <= buckets rows each
    return ratio_table(raw, tgt, buckets)


def learn_threshold(spark: SparkSession, measured: DataFrame, marks: DataFrame, model: QualityModel, loss: float = TRUSTED_LOSS) -> float:
    """The threshold from :func:`text_measures` of the labelled documents (others do not matter)."""
    # the ratio's threshold is for texts that the base rules let through
    passed = measured.filter(~model.base_failed(F.col("n_words"), F.col("n_repeat_words")))
    stage = Stage(spark, "quality-scores")
    scores = stage.put(passed.select(F.col("doc_id").alias("doc"), "llr").join(marks, "doc").select("llr", "quality"))
    threshold = score_threshold(scores, loss)
    stage.drop(scores)
    return threshold


def learn_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, loss: float = TRUSTED_LOSS,
                  min_words: int = 10, max_repeat_pct: int = 20) -> QualityModel:
    """The models and the threshold from all documents and all labels."""
    marks = label_marks(labels)
    model = QualityModel(learn_ratios(docs, marks, buckets), -np.inf, min_words, max_repeat_pct)
    known = may_hold(docs.select(iid().alias("doc_id"), "text"), marks.select(F.col("doc").alias("doc_id")), "doc_id")
    model.threshold = learn_threshold(spark, text_measures(known, model.ratios), marks, model, loss)
    return model


def judge_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS,
                  loss: float = TRUSTED_LOSS, min_words: int = 10, max_repeat_pct: int = 20) -> DataFrame:
    """Per document: the base counts, llr, threshold, base_failed and kept.

    Every text is measured once; the measures are staged, for the threshold and for the verdicts."""
    marks = label_marks(labels)
    model = QualityModel(learn_ratios(docs, marks, buckets), -np.inf, min_words, max_repeat_pct)
    measured = Stage(spark, "quality-measures").put(text_measures(docs, model.ratios))
    model.threshold = learn_threshold(spark, measured, marks, model, loss)
    failed, cut = model.base_failed(F.col("n_words"), F.col("n_repeat_words")), F.lit(model.threshold)
    return (measured.withColumn("base_failed", failed).withColumn("threshold", cut)
            .withColumn("kept", ~failed & (F.col("llr") >= cut)).withColumn("doc_id", from_iid("doc_id")))


def keep_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of ``docs`` that the model keeps, in one pass: whole rows go through the task that judges them."""
    docs = docs.withColumn("text", F.col("text").cast("string"))

    @lean
    def run(batches):
        for b in batches:
            for lo, texts in text_slices(b):
                got = _measured(texts, model.ratios)
                kept = ~model.base_failed(got["n_words"], got["n_repeat_words"]) & (got["llr"] >= model.threshold)
                yield b.slice(lo, len(texts)).filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
