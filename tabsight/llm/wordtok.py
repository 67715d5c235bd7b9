"""Whole-text encoding with the ``tokenizers`` library, one distinct word at a time.

The vocabulary named in the contracts drops white space and merges inside words only, so a text's ids are its
white-space-separated words' ids, one after the other.  A slice of texts is split and dictionary-encoded by Arrow; only
the slice's distinct words are looked up.  Each worker process keeps the ids of the words it has met in a two-generation
cache of bounded size and gives the library only unseen words.  A text with a ``<|`` (a special token may stand in it)
goes to the library whole.
"""

from __future__ import annotations

import gc
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tabsight.llm.staging import process_cache
from tabsight.llm.textbatch import folded

#: words per cache generation; two generations live at a time
CACHE_WORDS = 500_000

_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyz")


def gathered(ids: list, idx: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of texts, and each text's offsets in them: ``ids`` (bytes of uint32) per distinct word, ``idx`` the words of
    all texts, ``offs`` the texts' offsets in ``idx``."""
    size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
    first = np.cumsum(size) - size
    pool = np.frombuffer(b"".join(ids), "<u4")
    n = size[idx]
    ends = np.concatenate([[0], np.cumsum(n)])
    flat = pool[np.repeat(first[idx] - ends[:-1], n) + np.arange(ends[-1])]
    return flat, ends[offs - offs[0]]


def patched(flat: np.ndarray, offs: np.ndarray, whole: dict) -> tuple[np.ndarray, np.ndarray]:
    """The same with the ids of some texts (by number) replaced."""
    if not whole:
        return flat, offs
    pieces = [whole.get(i, flat[s:e]) for i, (s, e) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist()))]
    return np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])


class WordTokenizer:
    """Encodes texts to uint32 ids; equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    Valid for tokenizers that drop white space, lower-case, and split punctuation from letters (checked by tests)."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        #: largest id of the vocabulary
        self.top_id = max(vocab.values())
        #: ids that end a run of letters; a word of letters only is one run
        self.ends = np.zeros(self.top_id + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.cap = cache_words
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @classmethod
    def shared(cls, path: str, cache_words: int = CACHE_WORDS) -> "WordTokenizer":
        cache = process_cache()
        if ("wordtok", path, cache_words) not in cache:
            cache["wordtok", path, cache_words] = cls(path, cache_words)
        return cache["wordtok", path, cache_words]

    def _unseen(self, words) -> list:
        """Words of neither cache generation; those of the old one move to the new."""
        new, old, miss = self.new, self.old, []
        for w in words:
            v = old.get(w)
            if v is None:
                miss.append(w)
            else:
                new[w] = v
        return miss

    def _learn(self, words: list) -> None:
        """Make sure that the new generation holds all these distinct words."""
        new = self.new
        plain, odd, tails = set(), [], []
        for w in self._unseen([w for w in words if w not in new]):
            # a full stop or comma behind a letter is a word of its own to the tokenizer
            if w[-1] in b".," and len(w) > 1 and w[-2] in _LETTERS:
                tails.append(w)
            elif w.isalpha() or w.decode("utf-8", "replace").isalpha():
                plain.add(w)
            else:
                odd.append(w)
        if tails:
            for w in self._unseen({x for w in tails for x in (w[:-1], w[-1:])}.difference(new, plain)):
                if w.decode("utf-8", "replace").isalpha():
                    plain.add(w)
                else:
                    odd.append(w)
        plain = list(plain)
        for i in range(0, len(plain), 256):
            self._learn_letters(plain[i:i + 256])
        for i in range(0, len(odd), 4096):
            part = odd[i:i + 4096]
            texts = [w.decode("utf-8", "replace") for w in part]
            for w, e in zip(part, self.tok.encode_batch_fast(texts, add_special_tokens=False)):
                ids = e.ids
                new[w] = struct.pack(f"<{len(ids)}I", *ids)
        for w in tails:
            new[w] = new[w[:-1]] + new[w[-1:]]

    def _learn_letters(self, part: list) -> None:
        """Words of letters only, encoded as one text and cut behind the ids that end a word."""
        text = b" ".join(part).decode("utf-8", "replace")
        ids = np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(part) or (len(cuts) and cuts[-1] != len(ids)):   # a letter that normalises to something else
            for w in part:
                one = self.tok.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids
                self.new[w] = np.array(one, dtype="<u4").tobytes()
            return
        data, at = ids.tobytes(), 0
        for w, end in zip(part, (4 * cuts).tolist()):
            self.new[w] = data[at:end]
            at = end

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a large_string array without nulls, and each text's offsets in them."""
        was = gc.isenabled()
        gc.disable()    # millions of small acyclic objects: the cycle collector would only walk them
        try:
            return self._encode(texts)
        finally:
            if was:
                gc.enable()

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        whole = {i: np.array(self.tok.encode(texts[i].as_py(), add_special_tokens=False).ids, dtype="<u4")
                 for i in np.flatnonzero(special).tolist()}
        if whole:
            texts = pc.if_else(pa.array(special), pa.scalar("", texts.type), texts)
        parts = pc.ascii_split_whitespace(folded(texts))
        enc = parts.flatten().dictionary_encode()
        words = enc.dictionary.cast(pa.large_binary()).to_pylist()
        self.new.setdefault(b"", b"")
        self._learn(words)
        ids = list(map(self.new.__getitem__, words))
        if len(self.new) > self.cap:
            self.old, self.new = self.new, {}
        return patched(*gathered(ids, enc.indices.to_numpy(), parts.offsets.to_numpy()), whole)
