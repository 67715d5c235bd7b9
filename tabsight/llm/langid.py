"""Language ID with language-bitmask n-gram filters.

Every language has a Bloom filter of its characteristic character n-grams.  The filters are bit-sliced: arrays of
``slots`` integers, one array per 64 languages, so that language L has bit L % 64 of array L // 64 and one probe of an
array (the AND of ``probes`` slots) returns all of its languages that hold an n-gram.  Every learned language has a bit.  A document's verdict: per language the population count of its bit over all n-grams,
corrected for that language's false-positive rate, largest first (ties: smaller language name).  The score is the winner's
corrected share of the 3-grams alone: single letters and most letter pairs belong to every language of a script, so they
tell languages apart but say nothing about whether a text is in one of them.  :func:`score_limits` turns the scores of
held-out documents into a limit per language.

An n-gram belongs to a language if its share of that language's n-grams is at least ``min_share`` and at least
``ratio`` of its largest share in any language.  ``min_share`` bounds a language's n-grams by 1 / min_share, so the
filter's size does not depend on the corpus; the counts behind it cover every training document.

Null text or text without a letter is ``und`` with score 0; so is everything when nothing was learned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.llm.staging import from_iid, iid
from tabsight.llm.textbatch import SLICE_BYTES, gram_chunks, lean, mix64, split_words, text_slices

ORDERS = (1, 2, 3)
#: the order whose n-grams make the score
SCORE_ORDER = 3
MIN_SHARE = 2e-6
RATIO = 0.25
SLOTS = 1 << 21
PROBES = 3
#: a language must explain this part of what it explains of its median held-out document: a text half in it still passes
LIMIT_PART = 0.5
#: languages of one array
WORD_BITS = 64
#: text bytes times languages that one vectorised step counts (slices get smaller beyond 8 languages)
COUNT_BYTES = 8 * SLICE_BYTES


@dataclass
class LanguageFilter:
    """Bit-sliced filters of the languages (sorted names); ``slices`` is arrays x slots, ``false_rate[L]`` is filter L's
    chance of a false hit."""
    languages: list[str]
    slices: np.ndarray
    false_rate: np.ndarray
    probes: int = PROBES

    def lookup(self, grams: np.ndarray, word: int = 0) -> np.ndarray:
        """Bitmask of the languages of array ``word`` that hold each n-gram hash."""
        mask, slices = None, self.slices[word]
        for j in range(self.probes):
            m = slices[probe_slot(grams, j, len(slices))]
            mask = m if mask is None else mask & m
        return mask


def probe_slot(grams: np.ndarray, j: int, slots: int) -> np.ndarray:
    """The j-th slot of each n-gram hash."""
    return (mix64(grams + np.uint64(0x632BE59BD9B4E019 * (j + 1) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(slots)).astype(np.int64)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): n-gram counts per language over the whole texts of ``docs`` (text, lang)."""

    @lean
    def run(batches):
        for b in batches:
            langs = b.column(b.schema.get_field_index("lang")).dictionary_encode()
            code = langs.indices.to_numpy().astype(np.int64)
            for lo, texts in text_slices(b):
                doc, word, words = split_words(texts)
                if not len(word):
                    continue
                own = code[lo:lo + len(texts)][doc]
                times = {}
                for k in np.unique(own).tolist():   # only the words that the language has
                    n = np.bincount(word[own == k], minlength=len(words))
                    times[k] = (at := np.flatnonzero(n)), n[at]
                dense = np.zeros(len(words), dtype=np.int64)
                for w, g in gram_chunks(words, ORDERS):
                    uniq, inv = np.unique(g, return_inverse=True)
                    for k, (has, n) in times.items():
                        dense[has] = n
                        c = np.bincount(inv, weights=dense[w], minlength=len(uniq)).astype(np.int64)
                        dense[has] = 0
                        at = np.flatnonzero(c)
                        yield pa.RecordBatch.from_arrays(
                            [pa.repeat(langs.dictionary[k], len(at)), pa.array(uniq[at].view(np.int64)), pa.array(c[at])],
                            names=["lang", "gram", "n"])

    part = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(
        run, "lang string, gram bigint, n bigint")
    return part.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn_filters(train: DataFrame, min_share: float = MIN_SHARE, ratio: float = RATIO, slots: int = SLOTS,
                  probes: int = PROBES) -> LanguageFilter:
    """Learn the filters from every document of ``train`` that has a text and a language."""
    counts = gram_counts(train.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())).persist()
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rows = totals.orderBy("lang").collect()   # one row a language
    names = sorted(r["lang"] for r in rows)
    bit = {name: i for i, name in enumerate(names)}
    share = counts.join(F.broadcast(totals.sparkSession.createDataFrame(
        [(r["lang"], r["total"], bit[r["lang"]]) for r in rows], "lang string, total bigint, bit int")), "lang")
    share = share.withColumn("share", F.col("n") / F.col("total")).filter(F.col("share") >= min_share)
    best = share.groupBy("gram").agg(F.max("share").alias("best"),
                                     F.collect_list(F.struct("bit", "share")).alias("langs"))
    sets = best.select("gram", F.explode(F.expr(f"transform(filter(langs, x -> x.share >= {ratio} * best), x -> x.bit)")).alias("bit"))
    got = sets.toArrow()   # at most languages / min_share rows of 12 bytes
    counts.unpersist()
    grams, bits = got["gram"].to_numpy().view(np.uint64), got["bit"].to_numpy()
    kind = next((k for k, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(names) <= n), np.uint64)
    slices = np.zeros((max(1, -(-len(names) // WORD_BITS)), slots), dtype=kind)
    mask = np.left_shift(np.uint64(1), (bits % WORD_BITS).astype(np.uint64)).astype(kind)
    for j in range(probes):
        np.bitwise_or.at(slices, (bits // WORD_BITS, probe_slot(grams, j, slots)), mask)
    fill = np.array([np.count_nonzero(slices[i // WORD_BITS] & kind(1 << i % WORD_BITS)) / slots for i in range(len(names))])
    return LanguageFilter(names, slices, fill ** probes, probes)


def _best_languages(model: LanguageFilter, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(language, score) of a slice of texts."""
    k, n = len(model.languages), len(texts)
    names = np.array([*model.languages, "und"], dtype=object)
    doc, word, words = split_words(texts)
    hits, total, letter = np.zeros((2, k, n)), np.zeros((2, n)), np.zeros(n)   # all orders, SCORE_ORDER
    if len(word):
        has = pc.match_substring_regex(words, r"\pL").to_numpy(zero_copy_only=False)
        letter = np.bincount(doc, weights=has[word], minlength=n)
        kind = model.slices.dtype.type
        for order in ORDERS:
            grams, found = np.zeros(len(words)), np.zeros((k, len(words)))
            for w, g in gram_chunks(words, (order,)):
                grams += np.bincount(w, minlength=len(words))
                for i in range(k):
                    if i % WORD_BITS == 0:
                        mask = model.lookup(g, i // WORD_BITS)
                    found[i] += np.bincount(w, weights=(mask >> kind(i % WORD_BITS)) & kind(1), minlength=len(words))
            to = slice(0, 2 if order == SCORE_ORDER else 1)
            total[to] += np.bincount(doc, weights=grams[word], minlength=n)
            for i in range(k):
                hits[to, i] += np.bincount(doc, weights=found[i][word], minlength=n)
    if k:
        f = model.false_rate[:, None]
        share = np.clip((hits - f * total[:, None]) / np.maximum((1 - f) * total[:, None], 1e-9), 0, 1)
        best = share[0].argmax(axis=0)
        score = share[1, best, np.arange(n)]
    else:
        best, score = np.zeros(n, dtype=int), np.zeros(n)
    none = (letter == 0) | (k == 0)
    return pa.array(names[np.where(none, k, best)], pa.string()), np.where(none, 0.0, score)


def tag_languages(docs: DataFrame, model: LanguageFilter, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``docs`` and two more (columns of those names are replaced), in one pass: whole rows go through the
    task that judges them.  The score is the winner's corrected share of the text's n-grams of order ``SCORE_ORDER``."""
    docs = docs.drop(pred, score)
    docs = docs.withColumn("text", F.col("text").cast("string"))
    slice_bytes = min(SLICE_BYTES, COUNT_BYTES // max(len(model.languages), 1))

    @lean
    def run(batches):
        for b in batches:
            for lo, texts in text_slices(b, max_bytes=slice_bytes):
                best, scores = _best_languages(model, texts)
                part = b.slice(lo, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, best, pa.array(scores)], names=[*b.schema.names, pred, score])

    schema = T.StructType([*docs.schema, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def predict_languages(docs: DataFrame, model: LanguageFilter, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, ``carry`` columns) of every whole text."""
    rows = docs.select(iid().alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    return tag_languages(rows, model).select(from_iid("doc_id").alias("doc_id"), "lang_pred", "score", *carry)


def held_out():
    """Documents that the query never learns from: crc32 of the id's text is divisible by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_limits(predicted: DataFrame, pred: str = "lang_pred", score: str = "score") -> tuple[dict[str, float], float]:
    """Smallest score that counts as the language, and the limit of languages without a correct held-out document.

    ``predicted`` holds doc_id, lang, and the columns ``pred`` and ``score``.  A limit is ``LIMIT_PART`` of the median score of
    the language's correctly labelled held-out documents (the median, as junk may be labelled too); the others take the
    smallest limit."""
    known = predicted.filter(held_out() & (F.col("lang") == F.col(pred)))
    rows = known.groupBy("lang").agg(F.percentile_approx(score, 0.5).alias("mid")).collect()   # one row a language
    limits = {r["lang"]: LIMIT_PART * r["mid"] for r in rows}
    return limits, min(limits.values(), default=LIMIT_PART)


def identify_languages(docs: DataFrame, train: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Learn from the documents that are not held out (or from ``train``) and predict all of ``docs``."""
    model = learn_filters((docs if train is None else train).filter(~held_out()))
    return predict_languages(docs, model, carry)
