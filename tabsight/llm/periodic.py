"""Periodic runs of words by difference-cover longest common extensions.

A run is a stretch of consecutive words of smallest period ``q`` and length of at least ``max(min_length, exponent * q)``
that no neighbouring word extends.  Per slice of whole texts (their words as integers, a unique separator behind each
text, so that nothing extends beyond its text):

1. :class:`CoverLCE` sorts only the suffixes that start at a position of a difference cover modulo 13 (4 of 13): first by
   13 words, then by doubling among those still tied; adjacent common prefixes come from the levels' ranks, range minima
   from a sparse table.  Two positions compare at most 12 words until both stand on sampled suffixes, whose range
   minimum is the rest of their common extension.
2. The grid: a run of period ``p`` and exponent 3 or more holds every second, third, ... position of a grid of step
   ``(exponent - 1) * p`` with its neighbour ``p`` words on.  For every ``p`` the grid's equal pairs are extended to the right,
   then, on the reversed words, to the left; a stretch long enough is a run of period ``p``.  The number of grid
   positions is harmonic: n / 3 * (1 + 1/2 + 1/3 + ...).
3. The same stretch found with several periods (multiples of the smallest) keeps its smallest.

Every text is worked on in the task that read it; nothing is shuffled.  A slice holds about ``SLICE_BYTES`` of text or
one longer text, so memory is bounded by the longest text.  Null or blank text has no words and no run.  Repeated rows
and ids are judged each for itself; null ids stay null and are never reworded.  Extra columns are not read, whatever
their names.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.llm.textbatch import split_words, text_slices

SLICE_BYTES = 4 << 20

#: grid positions in memory at a time
GRID_CHUNK = 1 << 20

#: a difference cover: every residue modulo V is a difference of two members (fixed values)
V, COVER = 13, (0, 1, 3, 9)


def _shifts() -> np.ndarray:
    """Smallest shift that brings residues i and j into the cover together."""
    inside = np.isin(np.arange(2 * V) % V, COVER)
    out = np.empty((V, V), np.int64)
    for i in range(V):
        for j in range(V):
            out[i, j] = next(d for d in range(V) if inside[i + d] and inside[j + d])
    return out


class CoverLCE:
    """Longest common extensions to the right of positions in one integer sequence.

    The last value must occur once, and no two different positions may agree up to the end (separators see to that)."""

    def __init__(self, seq: np.ndarray):
        n = len(seq)
        top = int(seq.max()) + 1 if n else 0
        blocks = -(-n // V)
        pad = (blocks + 1) * V - n
        self.seq = np.concatenate([seq, np.arange(top, top + pad)])
        self.slot = np.full(V, -1, np.int64)
        self.slot[list(COVER)] = np.arange(len(COVER))
        self.shift = _shifts()
        self.pos = (np.arange(blocks)[:, None] * V + np.array(COVER)).ravel()
        self._sort()
        self._adjacent()

    def _sort(self) -> None:
        """Levels of ranks: level k orders the samples by their first V * 2^k words; equal rank, equal words."""
        m = len(self.pos)
        bits = max(1, int(self.seq.max()).bit_length()) if m else 1
        per = max(1, 62 // bits)
        keys = []
        for lo in range(0, V, per):
            key = np.zeros(m, np.int64)
            for j in range(lo, min(lo + per, V)):
                key = (key << bits) | self.seq[self.pos + j]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(m, bool)
        for key in keys:
            k = key[order]
            new[1:] |= k[1:] != k[:-1]
        if m:
            new[0] = True
        rank = np.empty(m, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(m), 0))     # a group's rank is its first place
        self.levels, step = [rank], len(COVER)
        while m:
            starts = np.flatnonzero(new)
            tied = np.repeat(np.diff(np.append(starts, m)) > 1, np.diff(np.append(starts, m)))
            at = np.flatnonzero(tied)
            if not len(at):
                break
            who = order[at]
            nxt = rank[who + step]                  # tied samples never reach the end: its values are unique
            sub = np.lexsort([nxt, rank[who]])
            order[at] = who[sub]
            nxt, old = nxt[sub], rank[who][sub]
            fresh = np.ones(len(at), bool)
            fresh[1:] = (nxt[1:] != nxt[:-1]) | (old[1:] != old[:-1])
            new[at] = fresh
            rank = rank.copy()
            rank[order[at]] = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
            self.levels.append(rank)
            step *= 2
        self.order, self.rank = order, rank

    def _adjacent(self) -> None:
        """Sparse table over the common prefixes of neighbours in sorted order."""
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        lcp = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level, jump = self.levels[k], len(COVER) << k
            live = np.flatnonzero(np.maximum(a, b) < len(level))
            same = live[level[a[live]] == level[b[live]]]
            lcp[same] += V << k
            a[same] += jump
            b[same] += jump
        i, j, live = self.pos[self.order[:-1]] + lcp, self.pos[self.order[1:]] + lcp, np.arange(len(a))
        for _ in range(V - 1):
            live = live[self.seq[i[live]] == self.seq[j[live]]]
            if not len(live):
                break
            lcp[live] += 1
            i[live] += 1
            j[live] += 1
        self.levels = None
        self.table = [lcp.astype(np.int32)]
        while 2 << (len(self.table) - 1) <= len(lcp):
            t, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(t[:-half], t[half:]))

    def _sampled(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common extension of positions that both stand on samples."""
        c = len(COVER)
        a = self.rank[i // V * c + self.slot[i % V]]
        b = self.rank[j // V * c + self.slot[j % V]]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        k = np.log2(hi - lo).astype(np.int64)           # exact: widths are far below 2^52
        out = np.empty(len(lo), np.int64)
        for level in np.unique(k):
            w = k == level
            t = self.table[level]
            out[w] = np.minimum(t[lo[w]], t[hi[w] - (1 << level)])
        return out

    def extend(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from i and j on (i and j differ)."""
        out, live = np.zeros(len(i), np.int64), np.arange(len(i))
        due = self.shift[i % V, j % V]
        for d in range(V):
            here = due[live] == d
            ready = live[here]
            if len(ready):
                out[ready] = d + self._sampled(i[ready] + d, j[ready] + d)
            live = live[~here]
            same = self.seq[i[live] + d] == self.seq[j[live] + d]
            out[live[~same]] = d
            live = live[same]
            if not len(live):
                break
        return out


def _grid(first: np.ndarray, size: np.ndarray, min_length: int, exponent: int):
    """Chunks of (position, period) of all texts' grids; a text begins at ``first`` and has ``size`` words."""
    most = np.where(size >= min_length, size // exponent, 0)
    doc = np.repeat(np.arange(len(size)), most)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    gap = (exponent - 1) * period
    count = (size[doc] - period - 1) // gap + 1
    ends = np.cumsum(count)
    lo = 0
    while lo < len(doc):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + GRID_CHUNK, side="right")))
        c = count[lo:hi]
        k = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        p = np.repeat(period[lo:hi], c)
        yield np.repeat(first[doc[lo:hi]], c) + k * (exponent - 1) * p, p
        lo = hi


def find_runs(words: np.ndarray, size: np.ndarray, min_length: int = 6, exponent: int = 4):
    """Runs of consecutive texts: arrays (text, start in the text, length, period), by text, start and period.

    ``words``: word numbers (not negative) of all texts, one after the other; ``size``: words per text; exponent 2 or more."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if not len(words):
        return none
    n_docs, top = len(size), int(words.max()) + 1
    first = np.cumsum(size + 1) - (size + 1)
    seq = np.empty(len(words) + n_docs, np.int64)
    stop = first + size
    inside = np.ones(len(seq), bool)
    inside[stop] = False
    seq[inside], seq[stop] = words, top + np.arange(n_docs)
    pos, per = [], []
    for i, p in _grid(first, size, min_length, exponent):
        ok = seq[i] == seq[i + p]
        pos.append(i[ok])
        per.append(p[ok])
    if not pos or not sum(map(len, pos)):
        return none
    i, p = np.concatenate(pos), np.concatenate(per)
    need = np.maximum(min_length, exponent * p) - p     # equal pairs that a run has
    right = CoverLCE(seq).extend(i, i + p)
    # to the left: the same on the reversed sequence, whose separators stand behind each text again
    back = np.concatenate([seq[::-1][1:], seq[-1:]])
    n = len(seq)
    some = np.flatnonzero(right > 0)
    i, p, need, right = i[some], p[some], need[some], right[some]
    a, b = n - 1 - i, n - 1 - i - p                     # the words left of i and i + p in ``back``
    left = CoverLCE(back).extend(a, b) if len(i) else right
    ok = left + right >= need
    start, length, p = i[ok] - left[ok], (left + right + p)[ok], p[ok]
    order = np.lexsort([p, length, start])
    start, length, p = start[order], length[order], p[order]
    keep = np.ones(len(start), bool)
    keep[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])      # the smallest period of a stretch
    start, length, p = start[keep], length[keep], p[keep]
    doc = np.searchsorted(first, start, side="right") - 1
    order = np.lexsort([p, start])
    return doc[order], (start - first[doc])[order], length[order], p[order]


def planted_period(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(first word, period) of the words that a tenth of the documents repeat, or None."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


_COLUMNS = ("doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
            "runs_sha256 string, collapsed_sha256 string")


def _slice_runs(ids: list, texts: pa.Array, reword, min_length: int, exponent: int):
    """Words, their texts' offsets, and the runs of a slice."""
    doc, word, kinds = split_words(texts)
    size = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    offs = np.concatenate([[0], np.cumsum(size)])
    if reword is not None:
        source = np.arange(len(word))
        for d, (i, n) in enumerate(zip(ids, size.tolist())):
            got = reword(i, n)
            if got is not None:
                a, p = got
                source[offs[d] + a:offs[d + 1]] = offs[d] + a + np.arange(n - a) % p
        word = word[source]
    return word, offs, kinds, find_runs(word, size, min_length, exponent)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def periodic_runs(docs: DataFrame, reword: Callable | None = None, min_length: int = 6, exponent: int = 4) -> DataFrame:
    """One row per run: (doc_id, start, length, period) in words; ``reword``: see :func:`planted_period`."""
    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            for lo, texts in text_slices(b, max_bytes=SLICE_BYTES):
                _, _, _, (doc, start, length, period) = _slice_runs(ids[lo:lo + len(texts)], texts, reword, min_length, exponent)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, len(texts)).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(period)],
                    names=["doc_id", "start", "length", "period"])

    return _rows(docs).mapInArrow(run, "doc_id bigint, start bigint, length bigint, period bigint")


def _collapsed(texts, ids, reword, min_length, exponent):
    """(runs of the slice, per text: kept words as bytes)."""
    word, offs, kinds, runs = _slice_runs(ids, texts, reword, min_length, exponent)
    doc, start, length, period = runs
    mark = np.zeros(len(word) + 1, np.int64)
    at = offs[doc] + start
    np.add.at(mark, at + period, 1)
    np.add.at(mark, at + length, -1)
    keep = np.cumsum(mark[:-1]) == 0
    names = kinds.cast(pa.large_binary()).to_pylist()
    kept = [b" ".join(map(names.__getitem__, word[s:e][keep[s:e]].tolist())) for s, e in zip(offs[:-1].tolist(), offs[1:].tolist())]
    return runs, kept


def collapse_runs(docs: DataFrame, reword: Callable | None = None, min_length: int = 6, exponent: int = 4) -> DataFrame:
    """(doc_id, text): every run reduced to its first period, words joined by one space."""
    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            for lo, texts in text_slices(b, max_bytes=SLICE_BYTES):
                _, kept = _collapsed(texts, ids[lo:lo + len(texts)], reword, min_length, exponent)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(texts)), pa.array([k.decode("utf-8", "replace") for k in kept],
                                                                                              pa.string())], names=["doc_id", "text"])

    return _rows(docs).mapInArrow(run, "doc_id bigint, text string")


def run_digests(docs: DataFrame, reword: Callable | None = None, min_length: int = 6, exponent: int = 4) -> DataFrame:
    """Per document: number of runs, the longest one, and digests of all runs and of the collapsed text."""
    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            for lo, texts in text_slices(b, max_bytes=SLICE_BYTES):
                n = len(texts)
                (doc, start, length, period), kept = _collapsed(texts, ids[lo:lo + n], reword, min_length, exponent)
                count = np.bincount(doc, minlength=n)
                ends = np.cumsum(count)
                rows = []
                for d in range(n):
                    s = slice(ends[d] - count[d], ends[d])
                    got = list(zip(start[s].tolist(), length[s].tolist(), period[s].tolist()))
                    if got:
                        a, size, q = min(got, key=lambda r: (-r[1], r[0], r[2]))
                        best = (len(got), a, size, q, 1000 * size // q)
                    else:
                        best = (0, None, None, None, None)
                    text = "".join(f"{a},{size},{q}\n" for a, size, q in got)
                    rows.append((*best, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(kept[d]).hexdigest()))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, n), *(pa.array(c, pa.int64()) for c in cols[:5]), *(pa.array(c, pa.string()) for c in cols[5:])],
                    names=[c.split()[0] for c in _COLUMNS.split(", ")])

    return _rows(docs).mapInArrow(run, _COLUMNS)
