"""Packing, token files and SentencePiece against the tokenizer libraries and exact round trips."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tabsight.llm.packing import pack_documents, plan_packs
from tabsight.llm.queries import QUERIES, piece_vocabulary, word_vocabulary
from tabsight.llm.spiece import PieceEncoder, PieceModel, decode_pieces, encode_pieces
from tabsight.llm.tokenfile import PartReader, read_token_index, write_token_files
from tabsight.llm.wordtok import WordTokenizer

SF = "/root/testdata/sf0.001"


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(word_vocabulary())
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


def _check_packs(rows, ids_of, max_len):
    seqs, seen = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = ids_of[r["doc_id"]]
        part = ids[r["start"]:r["start"] + r["length"]]
        assert len(part) == r["length"] > 0 and r["start"] == max_len * r["piece"] and _crc(part) == r["ids_crc32"]
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        seen[r["doc_id"]].append(r["piece"])
    for parts in seqs.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= max_len
    return seqs, seen


def test_packing_query_is_gapless_and_near_the_bound(spark, docs, library):
    rows = QUERIES["op4_best_fit_packing"].fn(spark, SF).collect()
    ids = {r["doc_id"]: library(r["text"]) + [1] for r in docs.collect()}
    seqs, seen = _check_packs(rows, ids, 4096)
    assert all(sorted(seen[d]) == list(range(-(-len(v) // 4096))) for d, v in ids.items())
    assert len(seqs) <= -(-sum(map(len, ids.values())) // 4096) + 1


def test_packing_hard_rows_and_empty_table(spark, hard_docs, library):
    rows = pack_documents(spark, hard_docs.filter("doc_id IS NOT NULL AND doc_id <> 7"), word_vocabulary(), 1, 64).collect()
    ids = {r["doc_id"]: library(r["text"]) + [1] for r in hard_docs.collect()}
    _check_packs(rows, ids, 64)
    every = pack_documents(spark, hard_docs, word_vocabulary(), 1, 64).collect()
    assert sum(r["doc_id"] == 7 for r in every) == 2 and sum(r["doc_id"] is None for r in every) == 1
    assert pack_documents(spark, hard_docs.limit(0), word_vocabulary()).count() == 0


def test_plan_uses_every_piece_once_and_fills_exactly():
    rnd = random.Random(4)
    for case in range(30):
        cap = rnd.choice([10, 64, 512])
        hist = {n: rnd.randint(1, 50) for n in rnd.sample(range(1, cap + 1), rnd.randint(1, min(cap, 40)))}
        left = defaultdict(int)
        for lengths, n in plan_packs(dict(hist), cap):
            assert sum(lengths) <= cap and n > 0
            for ln in lengths:
                left[ln] += n
        assert dict(left) == hist
    # pairs and triples that fill exactly: no sequence is left open
    packs = plan_packs({60: 100, 40: 100, 50: 50, 30: 50, 20: 50}, 100)
    assert sum(n for _, n in packs) == 150 and all(sum(p) == 100 for p, _ in packs)
    # a hot length is a handful of steps, whatever its count
    assert len(plan_packs({7: 10 ** 12, 4096: 10 ** 9}, 4096)) < 5


def test_word_tokenizer_equals_the_library(docs, library):
    texts = [r["text"] for r in docs.collect()] + ["", "a. b, c.d", "İ ﬁ Å Σ.", "<|endoftext|>x <|", "it's we'll 1,2.", "ª ʰ ŉ,"]
    small = WordTokenizer(word_vocabulary(), cache_words=50)     # the cache turns over all the time
    for lo in range(0, len(texts), 20):
        flat, offs = small.encode(pa.array(texts[lo:lo + 20], pa.large_string()))
        for i, t in enumerate(texts[lo:lo + 20]):
            assert flat[offs[i]:offs[i + 1]].tolist() == library(t)


def test_token_files_query(spark, docs, library):
    got = {r["doc_id"]: r for r in QUERIES["op9_token_files"].fn(spark, SF).collect()}
    at = 0
    for r in docs.orderBy("doc_id").collect():
        ids = library(r["text"]) + [2]
        g = got[r["doc_id"]]
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (at, len(ids), _crc(ids))
        at += len(ids)
    assert len(got) == docs.count()


def test_token_files_random_access_and_hard_rows(spark, hard_docs, library):
    files = write_token_files(spark, hard_docs, word_vocabulary(), 2, seq_len=32, parts=3)
    rows = read_token_index(spark, files).collect()
    assert len(rows) == hard_docs.count() and sum(r["doc_id"] is None and r["start"] == 0 for r in rows) == 1
    texts = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in hard_docs.collect())
    want = [i for _, t in texts for i in library(t) + [2]]
    got = []
    for _, name, _, _, n, base in files.parts:
        reader = PartReader(files.root, name)
        assert base == len(got)
        for i in range(-(-n // 32)):
            ids, mask = reader.sequence(i)
            assert len(ids) == len(mask) == 32
            got += ids[mask.to_numpy(zero_copy_only=False)].tolist()
        reader.close()
    assert got == want
    assert read_token_index(spark, write_token_files(spark, hard_docs.limit(0), word_vocabulary())).count() == 0


def test_sentencepiece_query_equals_the_library(spark, docs):
    import sentencepiece as spm
    sp = spm.SentencePieceProcessor(model_file=piece_vocabulary())
    got = {r["doc_id"]: r for r in QUERIES["op7_sentencepiece"].fn(spark, SF).collect()}
    for r in docs.collect():
        ids = sp.encode(r["text"])
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_crc32"], g["decoded_crc32"]) == (len(ids), _crc(ids), zlib.crc32(r["text"].encode()))


def test_sentencepiece_hard_texts(spark, hard_docs):
    import sentencepiece as spm
    sp = spm.SentencePieceProcessor(model_file=piece_vocabulary())
    rows = decode_pieces(encode_pieces(hard_docs, piece_vocabulary()), piece_vocabulary()).collect()
    texts = {}
    for r in hard_docs.collect():
        texts.setdefault(r["doc_id"], r["text"] or "")
    for r in rows:
        assert r["ids"] == sp.encode(texts[r["doc_id"]]) and r["decoded"] == texts[r["doc_id"]]
    enc = PieceEncoder(PieceModel(piece_vocabulary()), cache_words=20)
    rnd = random.Random(2)
    alphabet = ["a", "b", "th", "er", " ", "  ", "▁", "\n", ".", "é", "日", "😀", "1", "in", "▁▁", "ing"]
    for _ in range(60):
        batch = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(20)]
        flat, offs = enc.encode(pa.array(batch, pa.large_string()))
        assert [flat[a:b].tolist() for a, b in zip(offs[:-1], offs[1:])] == [sp.encode(t) for t in batch]
        assert enc.decode(flat, offs) == [t.replace("▁", " ") for t in batch]


def test_unigram_lattice_takes_the_best_sum(tmp_path):
    """The same vocabulary marked as a unigram model: the best sum of scores, as brute force finds it."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    proto = pb.ModelProto()
    with open(piece_vocabulary(), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    path = tmp_path / "u.model"
    path.write_bytes(proto.SerializeToString())
    m = PieceModel(str(path))
    for word in ("▁theory", "▁inning", "▁a", "▁ereonthat"):
        best = [0.0] + [-np.inf] * len(word)
        for i in range(1, len(word) + 1):
            for j in range(max(0, i - m.longest), i):
                p = m.ids.get(word[j:i])
                if p is not None:
                    best[i] = max(best[i], best[j] + m.score[p])
        ids = m.encode_words([word])[0]
        assert "".join(m.pieces[i] for i in ids) == word and abs(sum(m.score[i] for i in ids) - best[-1]) < 1e-6
