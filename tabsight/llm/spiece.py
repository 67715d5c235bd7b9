"""SentencePiece encoding and decoding with batched Viterbi.

A text becomes words at white space (``U+2581`` marks it) and line feeds; no piece crosses either.  Distinct words of equal length
advance together, one character position at a time: rolling substring hashes probe the sorted piece keys, and the best
candidate per word (a vectorised maximum) is stored as a back-pointer.

* unigram models: the score of a path is the sum of its pieces' scores;
* BPE models: a path scores 0 if every two neighbouring pieces stay apart when the model merges their concatenation
  alone, else minus infinity; exactly one path per prefix has score 0, and it is the model's own merge result.
  :meth:`PieceModel.stays_apart` decides the neighbours by walking both pieces' merge trees.

Characters without a piece become byte pieces (or the unknown id).  Words that hold ``U+2581`` runs merge among pieces of
equal rank and take the plain merge loop instead.  Decoding joins pieces and bytes.  Null or empty text has no ids.
"""

from __future__ import annotations

import gc
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.llm.staging import from_iid, iid, process_cache
from tabsight.llm.textbatch import text_slices
from tabsight.llm.wordtok import gathered, patched

_P = 0x9E3779B97F4A7C15
_M = (1 << 64) - 1
_SPACE = "▁"
#: pseudo id of a character without a piece
_NONE = -1
CACHE_WORDS = 300_000
_WORDS = re.compile(r"▁*[^▁\n]+|▁+|\n")


def _hash(s: str) -> int:
    h = 0
    for c in s:
        h = (h * _P + ord(c) + 1) & _M
    return h


class PieceModel:
    """Piece tables of a SentencePiece model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.bpe = proto.trainer_spec.model_type == 2
        self.pieces = [p.piece for p in proto.pieces]
        self.types = [p.type for p in proto.pieces]
        self.unk = self.types.index(2)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models without text normalisation are supported")
        self.prefix = norm.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (1, 4)}
        if any("\n" in p or _SPACE in p.lstrip(_SPACE) for p in self.ids):
            raise ValueError("a piece crosses a word boundary")
        self.score = np.array([p.score for p in proto.pieces], dtype=np.float64)
        self.longest = max(map(len, self.ids))
        #: characters that may stand next to each other inside a piece; anywhere else a word can be cut
        self.touch = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        by_hash = sorted((_hash(p), i) for p, i in self.ids.items())
        if any(a[0] == b[0] for a, b in zip(by_hash, by_hash[1:])):
            raise ValueError("piece hashes collide")
        self.keys = np.array([h for h, _ in by_hash], dtype=np.uint64)
        self.key_ids = np.array([i for _, i in by_hash], dtype=np.int64)
        self.hash_of = np.zeros(len(self.pieces), dtype=np.uint64)
        self.len_of = np.zeros(len(self.pieces), dtype=np.int64)
        for p, i in self.ids.items():
            self.hash_of[i], self.len_of[i] = _hash(p), len(p)
        #: which low hash bits occur among the keys: most substrings are no piece and need no search
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.power = np.array([pow(_P, k, 1 << 64) for k in range(self.longest + 1)], dtype=np.uint64)
        if self.bpe:
            self._merge_trees()

    def _merge_trees(self) -> None:
        """rank (order of merging), left and right part of each piece, and whether merging its text yields the piece."""
        n = len(self.pieces)
        order = sorted(self.ids.values(), key=lambda i: -self.score[i])
        self.rank = np.full(n, n, dtype=np.int64)
        self.rank[order] = np.arange(len(order))
        self.left, self.right, self.whole = np.arange(n), np.arange(n), np.zeros(n, dtype=bool)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.whole[i] = True
                continue
            parts = self._merge(list(p), i)
            if len(parts) == 2 and all(x in self.ids for x in parts):
                self.left[i], self.right[i] = (self.ids[x] for x in parts)
                self.whole[i] = True

    def _merge(self, parts: list[str], below: int | None = None) -> list[str]:
        """Merge best-scored neighbours, leftmost first; with ``below``, stop before that piece."""
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and i != below and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes, _NONE where there is none."""
        out = np.full(h.shape, _NONE, dtype=np.int64)
        at = np.nonzero(self.filter[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        near = h[at]
        k = np.minimum(np.searchsorted(self.keys, near), len(self.keys) - 1)
        out[at] = np.where(self.keys[k] == near, self.key_ids[k], _NONE)
        return out

    def stays_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the texts of pieces a and b together leaves them as they are.

        Merging goes by rank.  From the top, the later-merged of the two neighbours is taken apart at the border, and at
        every step the pieces that touch must not form a piece that would have been merged before that border moved."""
        if not len(a):
            return np.zeros(0, dtype=bool)
        out, live = np.ones(len(a), dtype=bool), np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            x, y = a[live], b[live]
            size = self.len_of[x] + self.len_of[y]
            fits = size <= self.longest
            h = self.hash_of[x] * self.power[np.minimum(self.len_of[y], self.longest)] + self.hash_of[y]
            both = np.where(fits, self.find(h), _NONE)
            joins = (both >= 0) & (self.rank[both] < limit[live])
            out[live[joins]] = False
            live, x, y = live[~joins], x[~joins], y[~joins]
            # ranks of the merges that made the two; single characters were there from the start
            rx = np.where(self.len_of[x] > 1, self.rank[x], -1)
            ry = np.where(self.len_of[y] > 1, self.rank[y], -1)
            more = (rx >= 0) | (ry >= 0)
            live, x, y, rx, ry = (v[more] for v in (live, x, y, rx, ry))
            open_x = rx > ry
            limit[live] = np.where(open_x, rx, ry + 1)
            a[live] = np.where(open_x, self.right[x], x)
            b[live] = np.where(open_x, y, self.left[y])
        return out

    # -- words -----------------------------------------------------------------------------------------------------
    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words (no line feed inside, U+2581 only in front)."""
        out: list = [None] * len(words)
        by_len: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if self.bpe and w.startswith(_SPACE * 2):
                out[k] = self._spelled(self._merge(list(w)))
            else:
                by_len.setdefault(len(w), []).append(k)
        for n, at in by_len.items():
            step = max(1, 400_000 // max(n, 1))
            for s in range(0, len(at), step):
                part = at[s:s + step]
                for k, ids in zip(part, self._viterbi([words[i] for i in part], n)):
                    out[k] = ids
        return out

    def _spelled(self, parts: list[str]) -> list[int]:
        ids: list[int] = []
        for p in parts:
            i = self.ids.get(p)
            ids += [i] if i is not None else self._fallback(p)
        return ids

    def _fallback(self, c: str) -> list[int]:
        if not self.bytes:
            return [self.unk]
        return [self.bytes[x] for x in c.encode("utf-8", "replace")]

    def _viterbi(self, words: list[str], n: int) -> list[list[int]]:
        rows = len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(rows, n)
        pre = np.zeros((n + 1, rows), dtype=np.uint64)
        for i in range(n):
            pre[i + 1] = pre[i] * np.uint64(_P) + codes[:, i] + np.uint64(1)
        best = np.full((n + 1, rows), -np.inf)
        best[0] = 0
        last = np.full((n + 1, rows), _NONE, dtype=np.int64)
        back = np.ones((n + 1, rows), dtype=np.int32)
        worst = float(self.score[list(self.ids.values())].min()) - 10.0   # an unknown character's score
        for i in range(1, n + 1):
            top = min(self.longest, i)
            cand = np.stack([self.find(pre[i] - pre[i - ln] * self.power[ln]) for ln in range(1, top + 1)])
            gain = np.full(cand.shape, -np.inf)
            ln, col = np.nonzero(cand >= 0)
            ids, prev_at = cand[ln, col], i - 1 - ln
            if self.bpe:
                prev = last[prev_at, col]
                ok = self.whole[ids] & (best[prev_at, col] == 0)
                test = np.flatnonzero(ok & (prev >= 0) & (prev_at > 0))
                if len(test):
                    pair, inv = np.unique(prev[test] * len(self.pieces) + ids[test], return_inverse=True)
                    ok[test] = self.stays_apart(pair // len(self.pieces), pair % len(self.pieces))[inv]
                gain[ln, col] = np.where(ok, 0.0, -np.inf)
            else:
                gain[ln, col] = best[prev_at, col] + self.score[ids]
            unknown = cand[0] < 0
            gain[0] = np.where(unknown, best[i - 1] + (0.0 if self.bpe else worst), gain[0])
            pick = gain.argmax(axis=0)
            cols = np.arange(rows)
            best[i], back[i], last[i] = gain[pick, cols], pick + 1, cand[pick, cols]
        # all words walk their back-pointers together; steps run from the last piece to the first
        at, cols, steps, unknown_at = np.full(rows, n), np.arange(rows), [], set()
        while (at > 0).any():
            live = at > 0
            ids = np.where(live, last[at, cols], -2)
            unknown_at.update(np.flatnonzero(ids == _NONE).tolist())
            steps.append(ids)
            at = np.where(live, at - back[at, cols], 0)
        grid = np.column_stack(steps[::-1])
        keep = grid != -2
        flat, ends = grid[keep].tolist(), np.cumsum(keep.sum(axis=1)).tolist()
        out = [flat[s:e] for s, e in zip([0, *ends[:-1]], ends)]
        for r in unknown_at:
            ids, i = [], 0
            for p in out[r]:
                ids += [p] if p >= 0 else self._fallback(words[r][i])
                i += int(self.len_of[p]) if p >= 0 else 1
            out[r] = ids
        return out


class PieceEncoder:
    """Whole-text encoder with a bounded two-generation word cache per worker process."""

    def __init__(self, model: PieceModel, cache_words: int = CACHE_WORDS):
        self.model, self.cap = model, cache_words
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        pieces = [bytes([int(p[3:5], 16)]) if t == 6 else b" \xe2\x81\x87 " if t == 2 else b"" if t == 3 else
                  p.replace(_SPACE, " ").encode() for p, t in zip(model.pieces, model.types)]
        self.text_size = np.array([len(p) for p in pieces], dtype=np.int64)
        self.text_start = np.cumsum(self.text_size) - self.text_size
        self.text_pool = np.frombuffer(b"".join(pieces), dtype=np.uint8)

    @classmethod
    def shared(cls, model: PieceModel, path: str) -> "PieceEncoder":
        cache = process_cache()
        if ("pieces", path) not in cache:
            cache["pieces", path] = cls(model)
        return cache["pieces", path]

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

    def _learn(self, words) -> None:
        new, touch = self.new, self.model.touch
        tails, whole = [], set()
        for w in self._unseen([w for w in words if w not in new]):
            if len(w) > 1 and w[-1] in ".,;:!?" and w[-2:] not in touch:
                tails.append(w)
            else:
                whole.add(w)
        whole.update(self._unseen({x for w in tails for x in (w[:-1], w[-1])}.difference(new, whole)))
        whole = list(whole)
        for w, ids in zip(whole, self.model.encode_words(whole)):
            new[w] = struct.pack(f"<{len(ids)}I", *ids)
        for w in tails:
            new[w] = new[w[:-1]] + new[w[-1]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of a large_string array without nulls, and each text's offsets in them."""
        was = gc.isenabled()
        gc.disable()    # millions of small acyclic objects: the cycle collector would only walk them
        try:
            return self._encode(texts)
        finally:
            if was:
                gc.enable()

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        kind, mark = texts.type, _SPACE if self.model.prefix else ""
        self.new.setdefault("", b"")
        # runs of spaces stay together in front of their word: such texts are cut by the pattern
        odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, _SPACE)), pc.starts_with(texts, " "))
        odd = odd.to_numpy(zero_copy_only=False)
        whole = {}
        for i in np.flatnonzero(odd).tolist():
            words = _WORDS.findall(mark + texts[i].as_py().replace(" ", _SPACE))
            self._learn(set(words))
            whole[i] = np.frombuffer(b"".join(map(self.new.__getitem__, words)), "<u4")
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd | empty), pa.scalar("", kind),
                           pc.binary_join_element_wise(pa.scalar(mark, kind), texts, pa.scalar("", kind)))
        plain = pc.replace_substring(pc.replace_substring(plain, " ", " " + _SPACE), "\n", " \n ")
        parts = pc.split_pattern(plain, " ")
        enc = parts.flatten().dictionary_encode()
        words = enc.dictionary.to_pylist()
        self._learn(words)
        ids = list(map(self.new.__getitem__, words))
        if len(self.new) > self.cap:
            self.old, self.new = self.new, {}
        return patched(*gathered(ids, enc.indices.to_numpy(), parts.offsets.to_numpy()), whole)

    def decode(self, flat: np.ndarray, offs: np.ndarray) -> list[str]:
        """Texts of ids: pieces and byte pieces joined, without the added first space."""
        n = self.text_size[flat]
        ends = np.concatenate([[0], np.cumsum(n)])
        data = self.text_pool[np.repeat(self.text_start[flat] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        cuts, out = ends[offs].tolist(), []
        for s, e in zip(cuts[:-1], cuts[1:]):
            out.append(data[s + (self.model.prefix and data[s:s + 1] == b" " and e > s):e].decode("utf-8", "replace"))
        return out


_OUTPUTS = {"ids": "array<int>", "n_tokens": "bigint", "ids_crc32": "bigint", "decoded": "string", "decoded_crc32": "bigint"}


def encode_pieces(docs: DataFrame, model_path: str, outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """doc_id and ``outputs`` of every whole text: ids, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit
    integers), decoded (the text decoded from the ids) and decoded_crc32 (of its UTF-8 bytes)."""
    model = PieceModel(model_path)

    def column(name, enc, flat, offs):
        cuts = list(zip(offs[:-1].tolist(), offs[1:].tolist()))
        if name == "ids":
            return pa.ListArray.from_arrays(offs.astype(np.int32), pa.array(flat.astype(np.int32)))
        if name == "n_tokens":
            return pa.array(np.diff(offs))
        if name == "ids_crc32":
            return pa.array([zlib.crc32(flat[s:e]) for s, e in cuts], pa.int64())
        texts = enc.decode(flat, offs)
        return (pa.array(texts, pa.string()) if name == "decoded" else
                pa.array([zlib.crc32(t.encode("utf-8")) for t in texts], pa.int64()))

    def run(batches):
        enc = PieceEncoder.shared(model, model_path)
        for b in batches:
            for lo, texts in text_slices(b, max_bytes=4 << 20):
                flat, offs = enc.encode(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(texts)), *[column(c, enc, flat, offs) for c in outputs]],
                                                 names=["doc_id", *outputs])

    schema = ", ".join(["doc_id bigint", *[f"{c} {_OUTPUTS[c]}" for c in outputs]])
    return docs.select(iid().alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema).withColumn(
        "doc_id", from_iid("doc_id"))


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` (with ``ids``) with ``decoded`` added; null ids give an empty text."""
    model, fields = PieceModel(model_path), [f"`{n}` {t}" for n, t in encoded.dtypes]

    def run(batches):
        enc = PieceEncoder.shared(model, model_path)
        for b in batches:
            col = pc.fill_null(b.column(b.schema.get_field_index("ids")), pa.scalar([], pa.list_(pa.int32())))
            offs = col.offsets.to_numpy()
            out = enc.decode(col.values.to_numpy()[offs[0]:offs[-1]].astype(np.int64), offs - offs[0])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "decoded"])

    return encoded.mapInArrow(run, ", ".join([*fields, "decoded string"]))
