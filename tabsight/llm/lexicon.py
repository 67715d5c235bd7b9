"""BPE encoding and decoding by a minimal acyclic transducer of frequent words, with exact merging of all others.

1. :func:`frequent_words` counts the white-space-separated words of all documents; the most frequent ones (at most
   ``max_words``, a bound that does not grow with the corpus) are encoded and compiled by :func:`build_transducer`: an acyclic automaton
   over UTF-8 bytes whose arcs carry token ids, pushed as near to the start as the words allow, so that equal remainders
   share their states.  Byte 0 ends a word.
2. The automaton is one flat file below the shared folder; tasks memory-map it (a store that cannot be mapped is read
   into one buffer).  All distinct words of a slice of texts walk it together, one byte a step.
3. Words that it lacks are normalised and cut as the tokenizer file says; their parts walk it again, and what is still
   missing is merged exactly, all parts of a slice at once: in every step each part merges its leftmost pair of lowest
   rank.  Words with a special token, and those with code points younger than Unicode 3.2 (on which this Python's tables
   and the library's disagree), are given to the library.

The tokenizer file is a BPE model with an end-of-word suffix, normalised by NFC and lower-casing, that drops white space
(checked on loading).

Null text counts as empty: no ids, and the digest of nothing.  Repeated rows and ids are encoded as often as they occur;
null ids stay null.  Extra columns are not read, whatever their names.  An empty table gives no rows.  A text must fit in
a task's memory (one is a slice of its own at most).
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.llm.staging import Stage, open_store, process_cache
from tabsight.llm.textbatch import folded, lean, text_slices

#: frequent words in the automaton
MAX_WORDS = 1 << 17

#: longer words are not worth a place in it
MAX_WORD_BYTES = 64

#: how the tokenizer cuts a normalised text (fixed value of the public file)
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: white space of the Unicode property, which no token holds
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, others from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class MergeModel:
    """Vocabulary, merge ranks and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        import regex
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if (model["type"], model["end_of_word_suffix"], kinds, spec["decoder"]) != ("BPE", "</w>", ["NFC", "Replace", "Lowercase"], None) \
                or split["pattern"].get("Regex") != SPLIT or any(a["normalized"] or "<|" not in a["content"] for a in spec["added_tokens"]):
            raise ValueError(f"{path}: not a lower-casing BPE tokenizer with word ends")
        vocab = model["vocab"]
        self.tokens = {i: t.encode() for t, i in vocab.items()}
        self.tokens.update({a["id"]: a["content"].encode() for a in spec["added_tokens"]})
        self.path, self.library = path, None
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + "</w>"] for c in letters], np.int64)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        key = np.array([(a << 32) | b for a, b, _ in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.pair_key, self.pair_rank = key[order], order.astype(np.int64)
        self.pair_to = np.array([c for _, _, c in pairs], np.int64)
        self.findall = regex.compile(SPLIT.replace(r"\s", _SPACE) + "| ").findall

    @classmethod
    def shared(cls, path: str) -> "MergeModel":
        cache = process_cache()
        if ("merges", path) not in cache:
            cache["merges", path] = cls(path)
        return cache["merges", path]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, or a number above all ranks."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], len(self.pair_key))

    def merge(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of non-empty byte strings, and each one's offsets: all merge their leftmost lowest pair at each step."""
        n = len(parts)
        offs, raw = byte_view(parts)
        owner = np.repeat(np.arange(n), np.diff(offs))
        sym = self.inner[raw]
        sym[offs[1:] - 1] = self.last[raw[offs[1:] - 1]]
        none = len(self.pair_key)

        def pair_ranks(s, o):
            out = np.full(len(s), none, np.int64)
            if len(s) > 1:
                same = o[:-1] == o[1:]
                out[:-1][same] = self.ranks(s[:-1][same], s[1:][same])
            return out

        rank = pair_ranks(sym, owner)
        done_owner, done_sym = [], []
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            size = np.diff(np.append(first, len(sym)))
            low = np.minimum.reduceat(rank, first)
            more = low < none
            if not more.all():
                keep = np.repeat(more, size)
                done_owner.append(owner[~keep])
                done_sym.append(sym[~keep])
                sym, owner, rank, low, size = sym[keep], owner[keep], rank[keep], low[more], size[more]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, size))
            o = owner[hit]
            hit = hit[np.concatenate([[True], o[1:] != o[:-1]])]      # the leftmost of each part
            sym[hit] = self.pair_to[low]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            new = np.cumsum(stay) - 1
            sym, owner, rank, hit = sym[stay], owner[stay], rank[stay], new[hit]
            for at in (hit - 1, hit):                                   # only these pairs have changed
                at = at[(at >= 0)]
                ok = at[at < len(sym) - 1]
                rank[at] = none
                ok = ok[owner[ok] == owner[ok + 1]]
                rank[ok] = self.ranks(sym[ok], sym[ok + 1])
        if not done_sym:
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        owner, sym = np.concatenate(done_owner), np.concatenate(done_sym)
        order = np.argsort(owner, kind="stable")
        return sym[order].astype(np.uint32), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])

    def cut(self, words: list[str]) -> tuple[pa.Array, np.ndarray]:
        """Parts of words, and the number of each part's word."""
        got = pa.array(self.findall(_normal(" ".join(words))), pa.large_string())
        gap = pc.equal(got, " ").to_numpy(zero_copy_only=False)
        return got.filter(pa.array(~gap)), np.cumsum(gap)[~gap]

    def by_library(self, words: list[str]) -> np.ndarray:
        """Which words only the library can tell: those with a special token, and those with code points younger than
        Unicode 3.2, on whose classes and composition the tables of this Python and of the library disagree."""
        text = "".join(words)
        hard = "" if text.isascii() else "".join(c for c in set(text) if ord(c) > 127 and unicodedata.ucd_3_2_0.category(c) == "Cn")
        if not hard and "<|" not in text:
            return np.zeros(len(words), bool)
        import regex
        found = regex.compile("|".join(["<[|]", *([f"[{regex.escape(hard)}]"] if hard else [])])).search
        return np.fromiter((found(w) is not None for w in words), bool, len(words))

    def library_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets of words by the ``tokenizers`` library."""
        if self.library is None:
            from tokenizers import Tokenizer
            self.library = Tokenizer.from_file(self.path)
        got = [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for ids in got for i in ids], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int64)


def _normal(text: str) -> str:
    """NFC and letter-wise lower case (no final sigma)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def build_transducer(words: list[bytes], ids: list[tuple]) -> dict[str, np.ndarray]:
    """Arrays of the minimal acyclic transducer of sorted distinct words (without byte 0) and their id sequences.

    ``key``: state * 256 + byte of each arc, ascending; ``to``: its target; ``first``, ``size``: its ids in ``pool``.
    State 0 is the start."""
    pool: list[int] = []
    placed: dict[tuple, int] = {}
    register: dict[tuple, int] = {(): 0}
    states: list[tuple] = [()]            # arcs of each state; 0 is the end of all words

    def common(a: tuple, b: tuple) -> tuple:
        n = 0
        for x, y in zip(a, b):
            if x != y:
                break
            n += 1
        return a[:n]

    def close(arcs: list) -> tuple[int, tuple]:
        """State of (byte, target, whole output) arcs, and the output that all of them share."""
        low, high = min(a[2] for a in arcs), max(a[2] for a in arcs)
        shared = common(low, high)
        sign = tuple((b, t, out[len(shared):]) for b, t, out in arcs)
        state = register.get(sign)
        if state is None:
            state = register[sign] = len(states)
            states.append(sign)
        return state, shared

    open_arcs: list[list] = [[]]           # per depth of the word last added
    prev = b""
    for word, out in zip(words, ids):
        n = 0
        while n < len(prev) and n < len(word) and prev[n] == word[n]:
            n += 1
        for depth in range(len(prev), n, -1):
            state, shared = close(open_arcs.pop())
            open_arcs[-1].append((prev[depth - 1], state, shared))
        open_arcs += [[] for _ in range(len(word) - n)]
        open_arcs[-1].append((0, 0, tuple(out)))
        prev = word
    for depth in range(len(prev), 0, -1):
        state, shared = close(open_arcs.pop())
        open_arcs[-1].append((prev[depth - 1], state, shared))
    root = open_arcs[0]
    # the start is number 0, the state without arcs the last number
    number = [len(states)] + list(range(1, len(states)))
    rows = [(0, b, t, out) for b, t, out in root] + [(s, b, t, out) for s in range(1, len(states)) for b, t, out in states[s]]
    key, to, first, size = [], [], [], []
    for s, b, t, out in rows:
        if out not in placed:
            placed[out] = len(pool)
            pool.extend(out)
        key.append((s << 8) | b)
        to.append(number[t])
        first.append(placed[out])
        size.append(len(out))
    return {"key": np.array(key, np.int64), "to": np.array(to, np.int32), "first": np.array(first, np.int32),
            "size": np.array(size, np.int32), "pool": np.array(pool, np.uint32)}


_SECTIONS = (("key", np.int64), ("to", np.int32), ("first", np.int32), ("size", np.int32), ("pool", np.uint32))


def transducer_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """The file: five section lengths (int64), then the sections, each padded to 8 bytes."""
    out = [np.array([len(arrays[n]) for n, _ in _SECTIONS], np.int64).tobytes()]
    for name, kind in _SECTIONS:
        data = arrays[name].astype(kind).tobytes()
        out.append(data + b"\0" * (-len(data) % 8))
    return b"".join(out)


class Transducer:
    """A compiled lexicon over a (memory-mapped) buffer."""

    def __init__(self, raw: np.ndarray):
        sizes, at, got = raw[:40].view(np.int64), 40, {}
        for (name, kind), n in zip(_SECTIONS, sizes.tolist()):
            end = at + n * np.dtype(kind).itemsize
            got[name] = raw[at:end].view(kind)
            at = end + (-(end - at) % 8)
        self.key, self.to, self.first, self.size, self.pool = (got[n] for n, _ in _SECTIONS)

    @classmethod
    def open(cls, uri: str) -> "Transducer":
        """The lexicon of a file, mapped once per worker process."""
        from pyarrow import fs
        cache = process_cache()
        if cache.get("lexicon", ("",))[0] != uri:
            store, path = open_store(uri)
            if isinstance(store, fs.LocalFileSystem):
                raw = np.memmap(path, np.uint8, "r")
            else:
                with store.open_input_file(path) as f:
                    raw = np.frombuffer(f.read_buffer(), np.uint8)
            cache["lexicon"] = (uri, cls(raw))
        return cache["lexicon"][1]

    def lookup(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known, flat ids of the known words, offsets per word) of a large_binary array; all words advance together."""
        n = len(words)
        known = np.zeros(n, bool)
        if not n or not len(self.key):
            return known, np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        offs, raw = byte_view(words)
        word, state, end = np.arange(n), np.zeros(n, np.int64), offs[1:] - offs[:-1]
        out_word, out_first, out_size = [], [], []
        step = 0
        while len(word):
            here = offs[word] + step
            left = end[word] > step
            byte = np.zeros(len(word), np.int64)
            byte[left] = raw[here[left]]
            ok = ~left | (byte > 0)                       # byte 0 inside a word is not the end mark
            key = (state << 8) | byte
            arc = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            ok &= self.key[arc] == key
            word, arc, left = word[ok], arc[ok], left[ok]
            known[word[~left]] = True
            some = self.size[arc] > 0
            out_word.append(word[some])
            out_first.append(self.first[arc[some]])
            out_size.append(self.size[arc[some]])
            word, state = word[left], self.to[arc[left]].astype(np.int64)
            step += 1
        at, first, size = (np.concatenate(x).astype(np.int64) for x in (out_word, out_first, out_size))
        keep = known[at]
        at, first, size = at[keep], first[keep], size[keep]
        order = np.argsort(at, kind="stable")
        at, first, size = at[order], first[order], size[order]
        total = np.bincount(at, weights=size, minlength=n).astype(np.int64)
        return known, spans(self.pool, first, size), np.concatenate([[0], np.cumsum(total)])


def byte_view(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a large_binary array without nulls."""
    if not len(words):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offs = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    return offs - offs[0], np.frombuffer(words.buffers()[2] or b"", np.uint8)[offs[0]:offs[-1]]


def spans(pool: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Slices ``first .. first + size`` of ``pool``, one after the other."""
    ends = np.cumsum(size)
    return pool[np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


class LexiconEncoder:
    """Ids of whole texts; equal to the library's ``encode(text, add_special_tokens=False).ids``."""

    def __init__(self, model: MergeModel, lexicon: Transducer | None = None):
        self.model, self.lexicon = model, lexicon
        top = max(model.tokens) + 1
        self.token_list = [model.tokens.get(i, b"") for i in range(top)]

    def _known(self, words: pa.Array):
        if self.lexicon is None:
            return np.zeros(len(words), bool), np.zeros(0, np.uint32), np.zeros(len(words) + 1, np.int64)
        return self.lexicon.lookup(words)

    def parts_ids(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets of distinct parts (large_binary): the automaton, else merging."""
        known, flat, offs = self._known(parts)
        miss = np.flatnonzero(~known)
        return _filled(len(parts), flat, offs, miss, *self.model.merge(parts.take(pa.array(miss))))

    def word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets of distinct words (large_binary without white space)."""
        known, flat, offs = self._known(words)
        miss = np.flatnonzero(~known)
        if not len(miss):
            return flat, offs
        texts = [w.decode("utf-8", "replace") for w in words.take(pa.array(miss)).to_pylist()]
        hard = self.model.by_library(texts)
        if hard.any():
            flat, offs = _filled(len(words), flat, offs, miss[hard],
                                 *self.model.library_ids([w for w, h in zip(texts, hard.tolist()) if h]))
            texts, miss = [w for w, h in zip(texts, hard.tolist()) if not h], miss[~hard]
            if not len(miss):
                return flat, offs
        parts, owner = self.model.cut(texts)
        enc = parts.dictionary_encode()
        pflat, poffs = self.parts_ids(enc.dictionary.cast(pa.large_binary()))
        first, size = poffs[:-1], np.diff(poffs)
        idx = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.bincount(owner, weights=size[idx], minlength=len(miss)).astype(np.int64)
        return _filled(len(words), flat, offs, miss, spans(pflat, first[idx], size[idx]),
                       np.concatenate([[0], np.cumsum(total)]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a large_string array without nulls, and each text's offsets in them."""
        listed = pc.ascii_split_whitespace(folded(texts))
        enc = listed.flatten().dictionary_encode()
        flat, offs = self.word_ids(enc.dictionary.cast(pa.large_binary()))
        idx = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        first, size = offs[:-1][idx], np.diff(offs)[idx]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = listed.offsets.to_numpy().astype(np.int64)
        return spans(flat, first, size), ends[at - at[0]]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the library's ``decode(ids, skip_special_tokens=False)``: tokens joined by spaces."""
        return b" ".join(map(self.token_list.__getitem__, ids.tolist()))


def _filled(n, flat, offs, miss, mflat, moffs):
    """Known entries and those of ``miss`` in one flat array with offsets."""
    if not len(miss):
        return flat, offs
    size, first = np.diff(offs), offs[:-1].copy()
    size[miss], first[miss] = np.diff(moffs), moffs[:-1] + len(flat)
    return spans(np.concatenate([flat, mflat]), first, size), np.concatenate([[0], np.cumsum(size)])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, n) of all words of all texts, lower-cased, up to ``MAX_WORD_BYTES`` and without special tokens."""
    @lean
    def count(batches):
        for b in batches:
            for _, texts in text_slices(b):
                got = pc.value_counts(pc.ascii_split_whitespace(folded(texts)).flatten().cast(pa.large_binary()))
                yield pa.RecordBatch.from_arrays([got.field(0).cast(pa.binary()), got.field(1)], names=["word", "n"])

    words = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word binary, n bigint")
    words = words.filter((F.length("word") > 0) & (F.length("word") <= MAX_WORD_BYTES) & ~F.contains("word", F.lit(b"<|")))
    return words.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(spark: SparkSession, docs: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """The words (word binary, n) that occur at least as often as the smallest limit that at most ``max_words`` words reach;
    limits are 1, 2, 4, ... with 16 geometric steps between.  The driver sees one row a step."""
    counts = Stage(spark, "words").put(word_counts(docs))
    step = F.floor(F.log2("n") * 16).cast("int")
    reach, least = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("n")).collect(),
                    key=lambda r: -r["step"]):
        reach += r["words"]
        if reach > max_words:
            break
        least = r["n"]
    return counts.filter(F.col("n") >= least) if least is not None else counts.limit(0)


def write_lexicon(spark: SparkSession, docs: DataFrame, tokenizer_path: str, max_words: int = MAX_WORDS) -> str:
    """Compile the corpus's frequent words; the file's place below the shared folder."""
    words = sorted(bytes(r["word"]) for r in frequent_words(spark, docs, max_words).collect() if b"\0" not in r["word"])
    flat, offs = LexiconEncoder(MergeModel.shared(tokenizer_path)).word_ids(pa.array(words, pa.large_binary()))
    flat, offs = flat.tolist(), offs.tolist()
    data = transducer_bytes(build_transducer(words, [tuple(flat[a:b]) for a, b in zip(offs[:-1], offs[1:])]))
    uri = Stage(spark, "lexicon").path(f"words-{uuid.uuid4().hex}.fst")
    store, path = open_store(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path) as out:
        out.write(data)
    return uri


def encode_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str, max_words: int = MAX_WORDS,
                     lexicon: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text; ``lexicon``: a file of :func:`write_lexicon`."""
    return _mapped(spark, docs, tokenizer_path, max_words, lexicon, "ids array<int>", lambda enc, ids: ids.astype(np.int32))


def decode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): tokens joined by spaces, special tokens included; null ids as none."""
    def run(batches):
        enc = LexiconEncoder(MergeModel.shared(tokenizer_path))
        for b in batches:
            texts = [enc.decode(np.array(r or [], np.int64)).decode("utf-8", "replace") for r in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(run, "doc_id bigint, text string")


def encoding_digests(spark: SparkSession, docs: DataFrame, tokenizer_path: str, max_words: int = MAX_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests taken where the ids are, so no ids travel."""
    def digests(enc, ids):
        return (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(enc.decode(ids)).hexdigest())

    return _mapped(spark, docs, tokenizer_path, max_words, None,
                   "n_tokens bigint, ids_sha256 string, decoded_sha256 string", digests)


def _mapped(spark, docs, tokenizer_path, max_words, lexicon, schema, fn) -> DataFrame:
    uri = lexicon or write_lexicon(spark, docs, tokenizer_path, max_words)
    kinds = {"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    cols = [c.split() for c in schema.split(", ")]

    @lean
    def run(batches):
        enc = LexiconEncoder(MergeModel.shared(tokenizer_path), Transducer.open(uri))
        for b in batches:
            for lo, texts in text_slices(b):
                flat, offs = enc.encode(texts)
                rows = [fn(enc, flat[s:e]) for s, e in zip(offs[:-1].tolist(), offs[1:].tolist())]
                got = [rows] if len(cols) == 1 else list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, len(texts)), *(pa.array(v, kinds[k]) for v, (_, k) in zip(got, cols))],
                    names=["doc_id", *(c for c, _ in cols)])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id bigint, {schema}")
