"""Arrow/numpy helpers for whole texts inside a task: slices of bounded size, words as integer ids."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: a special token is one only as it is written; and lower h, j, t, w, y compose with these marks, upper ones do not
_AS_WRITTEN = "<[|]|[\u0308\u030a\u030c\u0331]"

#: bytes of text that one vectorised step handles (a longer single text is a slice of its own)
SLICE_BYTES = 8 << 20


def text_slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = SLICE_BYTES):
    """Yield (row offset, text array without nulls) slices of about ``max_bytes`` of text."""
    col = batch.column(batch.schema.get_field_index(column))
    if col.type != pa.large_string():
        col = col.cast(pa.large_string())
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    lo, n = 0, len(col)
    ends = np.cumsum(sizes)
    while lo < n:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield lo, pc.fill_null(col.slice(lo, hi - lo), "")
        lo = hi


def folded(texts: pa.Array) -> pa.Array:
    """Texts with A-Z lower-cased where that changes no id of a tokenizer that composes (NFC) and then lower-cases."""
    odd = pc.match_substring_regex(texts, _AS_WRITTEN)
    lower = pc.ascii_lower(texts)
    return pc.if_else(odd, texts, lower) if pc.any(odd).as_py() else lower


def lean(run: Callable) -> Callable:
    """A ``mapInArrow`` function that hands freed memory back to the system when its task ends: workers outlive tasks."""
    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)   # glibc only
            if trim is not None:
                trim(0)
    return task


def split_words(texts: pa.Array):
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: (document index per word, word id per word, distinct words)."""
    parts = pc.ascii_split_whitespace(texts)
    offs = parts.offsets.to_numpy()
    flat = parts.flatten()
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(offs))
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        doc, flat = doc[full], flat.filter(pa.array(full))
    enc = flat.dictionary_encode()
    return doc, enc.indices.to_numpy().astype(np.int64), enc.dictionary


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (uint64 in, uint64 out)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each distinct word (xxh3 of its UTF-8 bytes)."""
    import xxhash
    f = xxhash.xxh3_64_intdigest
    return np.fromiter((f(w) for w in words.cast(pa.large_binary()).to_pylist()), dtype=np.uint64, count=len(words))


#: distinct words whose n-grams are in memory at a time
GRAM_WORDS = 1 << 16


def gram_chunks(words: pa.Array, orders: tuple[int, ...]):
    """Character n-grams of `` word `` (one space on either side), lower-cased: (word index, 64-bit n-gram hash) arrays, in
    chunks of ``GRAM_WORDS`` words and one order each.

    Grams of different orders hash differently; an n-gram that is the lone space is left out."""
    for lo in range(0, len(words), GRAM_WORDS):
        part = words.slice(lo, GRAM_WORDS)
        one = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.cast(pa.string()))
        text = "\x00 " + pc.binary_join(one, " \x00 ")[0].as_py().lower() + " \x00"
        cp = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
        stop = cp == 0
        owner = np.cumsum(stop, dtype=np.int64) + (lo - 1)
        for n in orders:
            m = len(cp) - n + 1
            if m <= 0:
                continue
            h, bad = np.full(m, n, dtype=np.uint64), stop[:m].copy()
            for j in range(n):
                h *= np.uint64(0x9E3779B97F4A7C15)
                h += cp[j:j + m]
                if j:
                    bad |= stop[j:j + m]
            if n == 1:
                bad |= cp == 32
            ok = ~bad
            yield owner[:m][ok], mix64(h[ok])


def char_grams(words: pa.Array, orders: tuple[int, ...]):
    """All of :func:`gram_chunks` at once."""
    got = list(gram_chunks(words, orders))
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([w for w, _ in got]), np.concatenate([h for _, h in got])
