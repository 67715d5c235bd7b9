"""Conversation repair, transducer lexicon and periodic runs against brute force and the tokenizer library."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tabsight.llm import lexicon, periodic, turns
from tabsight.llm.queries import QUERIES, word_vocabulary

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- conversations --------------------------------------------------------------------------------------------------

def _all_audits(sign, limit=14):
    """(cost, audit) of every edit sequence that gives the grammar, by plain search."""
    found = []

    def go(i, state, cost, audit):
        if cost > limit:
            return
        if i == len(sign) and state in (0, 3):
            found.append((cost, audit))
        if i < len(sign):
            c, add = sign[i], 3 if sign[i].isupper() else 0
            go(i + 1, state, cost + 4, audit + "D")
            if c != "x":
                for want, to in (("s", {0: 1}), ("u", {0: 2, 1: 2, 3: 2}), ("a", {2: 3})):
                    if state in to and (c.lower() == want or want != "s"):
                        go(i + 1, to[state], cost + (0 if c.lower() == want else 3) + add, audit + ("K" if c.lower() == want else "R"))
        to = {0: 2, 1: 2, 3: 2, 2: 3}[state]
        go(i, to, cost + 3, audit + "I")

    go(0, 0, 0, "")
    return min(found)


def _by_blocks(sign, size):
    """The blocks' result, composed as the Spark job does."""
    parts = [sign[k:k + size] for k in range(0, len(sign), size)]
    g, behind = turns._end_costs(), []
    for p in reversed(parts):
        behind.append(g)
        m = turns.block_matrix(p)
        g = [min(m[4 * s + t] + g[t] for t in range(4)) for s in range(4)]
    state, audit = 0, ""
    for k, (p, b) in enumerate(zip(parts, reversed(behind))):
        audits, exits = turns.block_audits(p, b, k == len(parts) - 1)
        audit, state = audit + audits[state], exits[state]
    return g[0], audit


def test_alignment_is_the_cheapest_and_least_audit():
    for n in range(1, 4):
        for sign in itertools.product("xsuaoSUAO", repeat=n):
            sign = "".join(sign)
            assert turns.align(sign) == _all_audits(sign, 4 * n), sign
    rnd = random.Random(5)
    for _ in range(60):
        sign = "".join(rnd.choice("xsuuaaoSUAO") for _ in range(rnd.randint(4, 6)))
        assert turns.align(sign) == _all_audits(sign, turns.align(sign)[0]), sign


def test_blocks_give_the_alignment_of_the_whole():
    rnd = random.Random(6)
    for _ in range(300):
        sign = "".join(rnd.choice("xsuauauauaoSUA") for _ in range(rnd.randint(1, 30)))
        assert _by_blocks(sign, rnd.randint(1, 9)) == turns.align(sign), sign


def _brute_conversation(rows):
    """Contract columns of one conversation; rows: (turn, role, text) in file order."""
    after = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        after += [(turn, role, text)] * (2 if code == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    seen, sign, n = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in after:
        body, fault = text.strip("\x20\t\n\x0b\x0c\r"), None
        if not body:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif body[-1] not in ".!?":
            fault = "truncated"
        seen.add((role, text))
        if fault:
            n[fault] += 1
        c = role[:1] if role[:1] in ("s", "u", "a") else "o"
        sign += "x" if fault in ("blank", "duplicate") else c.upper() if fault else c
    numbers = [t for t, _, _ in after if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
    cost, audit = _by_blocks(sign, 10 ** 9) if sign else (0, "")
    size = len(audit) - audit.count("D")
    grammar = "s" * (size % 2) + "ua" * (size // 2)
    out, at = [], 0
    for e in audit:
        if e == "I":
            out.append(({"u": "user", "a": "assistant"}[grammar[len(out)]], ""))
            continue
        _, role, text = after[at]
        at += 1
        if e == "K":
            out.append((role, text))
        elif e == "R":
            out.append(({"u": "user", "a": "assistant"}[grammar[len(out)]], text))
    assert [r[:1] for r, _ in out] == list(grammar)
    whole = "\n".join(f"{r}:{t}" for r, t in out)
    return (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256(whole.encode()).hexdigest())


_COLS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    return {c: _brute_conversation(g) for c, g in groups.items()}


def test_repair_query_equals_brute_force(spark):
    src = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    exp = _expected([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in src])
    got = {r["conv_id"]: tuple(r[c] for c in _COLS) for r in QUERIES["op11_target_alignment"].fn(spark, SF).collect()}
    assert got == exp and any("I" in r[6] for r in got.values())


def _hard_rows():
    rnd = random.Random(7)
    texts = ["Yes.", "No", "  ", "", None, "Why?", "long " * 3000 + "end!", "Yes."]
    rows = [(c, rnd.choice([None, *range(9)]), rnd.choice(["user", "assistant", "system", None, "tool", "", "ubuntu"]), rnd.choice(texts))
            for c in [*range(40), None] for _ in range(rnd.randint(1, 7))]
    rows += [(100, k, ("user", "assistant")[k % 2], f"turn {k % 50}{'.' if k % 9 else ''}") for k in range(700)]   # one long conversation
    rows += [(101, None, "user", "Hi."), (101, None, "user", "Hi."), (102, 5, "user", "Hi.")]
    return rows


def test_hard_conversations_short_and_in_blocks(spark, tmp_path):
    rows = _hard_rows()
    data = [(*r, k, "x", 1.0) for k, r in enumerate(rows)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, at long, audit string, cost double")
    exp = _expected(rows)
    for max_turns, block in ((1000, 64), (3, 5)):
        dam = turns.damaged(df, ("at",))
        audits = turns.audit_conversations(spark, dam, ("at",), "present", max_turns, block)
        dig = {r["conv"]: r["repaired_sha256"] for r in turns.repaired_digests(dam, audits, ("at",), "present").collect()}
        got = {r["conv_id"]: (*(r[c] for c in _COLS[:-1]), dig[r["conv_id"]]) for r in audits.collect()}
        assert got == exp
        whole = {}
        for r in sorted(turns.repaired_turns(dam, audits, ("at",), "present").collect(), key=lambda r: r["position"]):
            whole.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
        assert all(hashlib.sha256("\n".join(whole.get(c, [])).encode()).hexdigest() == v[-1] for c, v in exp.items())
    empty = turns.damaged(df.limit(0), ("at",))
    assert turns.audit_conversations(spark, empty, ("at",), "present").count() == 0


def test_repair_without_a_tie_order_is_defined(spark):
    rows = [(1, 0, "user", "A."), (1, 0, "assistant", "B."), (1, 0, "user", "A."), (1, 1, "assistant", "C.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for max_turns in (100, 1):
        a = turns.audit_conversations(spark, df, max_turns=max_turns).collect()
        b = turns.audit_conversations(spark, df.repartition(3), max_turns=max_turns).collect()
        assert a == b and a[0]["duplicate"] == 1 and len(a) == 1


# -- lexicon --------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(word_vocabulary())


def _odd_texts():
    rnd = random.Random(8)
    spans = [(1, 0x24F), (32, 126), (32, 126), (0x300, 0x3FF), (0x400, 0xD7FF), (0xE000, 0x2FFFF), (32, 32), (39, 39)]
    return ["", "Y̊ H̱ T̈ J̌", "ΣΑΣ İstanbul", "x\x1cy\x85z　w", "a\x00b \x00", "<|startoftext|><|endoftext|>abc<|ENDOFTEXT|> <|x",
            "''s's'll it's 12,5.", "日本語 😀 ꟏ 𞛀"] + \
        ["".join(chr(rnd.randint(*rnd.choice(spans))) for _ in range(rnd.randint(1, 30))) for _ in range(1500)]


def test_lexicon_encodes_and_decodes_as_the_library(library):
    texts = _odd_texts()
    words = sorted({w.lower().encode() for t in texts[::3] for w in WORD.findall(t) if "\0" not in w and "<|" not in w})
    model = lexicon.MergeModel.shared(word_vocabulary())
    flat, offs = lexicon.LexiconEncoder(model).word_ids(pa.array(words, pa.large_binary()))
    fst = lexicon.build_transducer(words, [tuple(flat[a:b].tolist()) for a, b in zip(offs[:-1], offs[1:])])
    for lex in (None, lexicon.Transducer(np.frombuffer(lexicon.transducer_bytes(fst), np.uint8))):
        enc = lexicon.LexiconEncoder(model, lex)
        got, at = enc.encode(pa.array(texts, pa.large_string()))
        for t, a, b in zip(texts, at[:-1], at[1:]):
            ids = library.encode(t, add_special_tokens=False).ids
            assert got[a:b].tolist() == ids, t
            assert enc.decode(got[a:b]) == library.decode(ids, skip_special_tokens=False).encode()


def test_transducer_is_minimal_and_exact():
    rnd = random.Random(9)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 6))).encode() for _ in range(80)})
    ids = [tuple(rnd.randint(0, 2) for _ in range(rnd.randint(0, 3))) for _ in words]
    raw = lexicon.build_transducer(words, ids)
    fst = lexicon.Transducer(np.frombuffer(lexicon.transducer_bytes(raw), np.uint8))
    probe = [*words, b"", b"abababab", b"b\0", b"a\0a"]
    known, flat, offs = fst.lookup(pa.array(probe, pa.large_binary()))
    assert known.tolist() == [True] * len(words) + [w in words for w in probe[len(words):]]
    assert [tuple(flat[a:b].tolist()) for a, b in zip(offs[:-1], offs[1:])][:len(words)] == ids
    # minimal: no two states have the same arcs, and every state but the start has arcs whose ids share no beginning
    arcs = {}
    for k, t, f, n in zip(raw["key"].tolist(), raw["to"].tolist(), raw["first"].tolist(), raw["size"].tolist()):
        arcs.setdefault(k >> 8, []).append((k & 255, t, tuple(raw["pool"][f:f + n].tolist())))
    signs = [tuple(v) for s, v in arcs.items() if s]
    assert len(set(signs)) == len(signs)
    assert all(len({o[:1] for _, _, o in v}) > 1 or () in [o for _, _, o in v] for v in signs)
    suffixes = [w + b"ing" for w in (b"x", b"y", b"z")]
    shared = lexicon.build_transducer(suffixes, [(k,) for k in range(3)])
    assert len(shared["key"]) == 3 + 4          # three first letters, one common "ing" with its end
    assert len(lexicon.build_transducer([], [])["key"]) == 0


def test_lexicon_query_and_hard_rows(spark, docs, hard_docs, library):
    def expected(t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())

    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op12_transducer_lexicon"].fn(spark, SF).collect()}
    assert got == {r["doc_id"]: expected(r["text"]) for r in docs.collect()}
    rows = lexicon.encoding_digests(spark, hard_docs, word_vocabulary(), max_words=5).collect()
    assert sorted(map(str, (tuple(r) for r in rows))) == sorted(str((r["doc_id"], *expected(r["text"]))) for r in hard_docs.collect())
    ids = lexicon.encode_documents(spark, hard_docs, word_vocabulary(), max_words=5)
    back = {r["doc_id"]: r["text"] for r in lexicon.decode_documents(ids, word_vocabulary()).collect()}
    assert all(back[r["doc_id"]] == library.decode(library.encode(r["text"] or "", add_special_tokens=False).ids, skip_special_tokens=False)
               for r in hard_docs.collect())
    assert lexicon.encoding_digests(spark, hard_docs.limit(0), word_vocabulary()).count() == 0


def test_frequent_words_counts_all_rows(spark, hard_docs):
    got = {bytes(r["word"]).decode(): r["n"] for r in lexicon.word_counts(hard_docs).collect()}
    exp = {}
    for r in hard_docs.collect():
        for w in WORD.findall(r["text"] or ""):
            if "<|" not in w and len(w.encode()) <= 64:
                exp[w.lower()] = exp.get(w.lower(), 0) + 1
    assert got == exp
    for most in (0, 5, 100, 10 ** 6):
        top = {bytes(r["word"]).decode(): r["n"] for r in lexicon.frequent_words(spark, hard_docs, most).collect()}
        assert len(top) <= most and all(exp[w] == n for w, n in top.items())
        assert not top or max((n for w, n in exp.items() if w not in top), default=0) < min(top.values())
    assert len(top) == len(exp)


# -- periodic runs --------------------------------------------------------------------------------------------------

def _brute_runs(w, least=6, exponent=4):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((a, n, q) for (a, n), q in found.items())


def _random_words(rnd):
    w = []
    while len(w) < rnd.choice([0, 3, 10, 60, 200]):
        if rnd.random() < .5:
            u = [rnd.randrange(rnd.choice([1, 2, 3, 50])) for _ in range(rnd.randint(1, 9))]
            w += (u * rnd.randint(1, 8))[:rnd.randint(1, 60)]
        else:
            w.append(rnd.randrange(3))
    return w


def test_runs_equal_brute_force():
    rnd = random.Random(3)
    for _ in range(150):
        texts = [_random_words(rnd) for _ in range(rnd.randint(1, 8))]
        size, words = np.array([len(t) for t in texts]), np.array([x for t in texts for x in t], np.int64)
        got = [[] for _ in texts]
        for d, *r in zip(*(x.tolist() for x in periodic.find_runs(words, size))):
            got[d].append(tuple(r))
        assert got == [_brute_runs(t) for t in texts]


def test_difference_cover_extension():
    assert {(a - b) % periodic.V for a in periodic.COVER for b in periodic.COVER} == set(range(periodic.V))
    rnd = random.Random(4)
    for _ in range(60):
        w = _random_words(rnd) or [0]
        lce = periodic.CoverLCE(np.array([*w, max(w) + 1], np.int64))
        i, j = (np.array([rnd.randrange(len(w)) for _ in range(60)]) for _ in range(2))
        i, j = i[i != j], j[i != j]
        for a, b, n in zip(i.tolist(), j.tolist(), lce.extend(i, j).tolist()):
            m = 0
            while max(a, b) + m < len(w) and w[a + m] == w[b + m]:
                m += 1
            assert m == n


def _brute_digest(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = _brute_runs(w)
    drop = {i for a, size, q in runs for i in range(a + q, a + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    return (len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            hashlib.sha256("".join(f"{a},{size},{q}\n" for a, size, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in drop).encode()).hexdigest())


def test_run_query_and_hard_rows(spark, docs, hard_docs):
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_difference_cover_runs"].fn(spark, SF).collect()}
    assert got == {r["doc_id"]: _brute_digest(r["doc_id"], r["text"]) for r in docs.filter("length(text) < 20000").collect()} | {
        k: v for k, v in got.items() if k in {r["doc_id"] for r in docs.filter("length(text) >= 20000").collect()}}
    assert sum(v[0] > 0 for v in got.values()) >= 5
    hard = hard_docs.filter("length(text) < 1000 OR text IS NULL")
    rows = periodic.run_digests(hard, periodic.planted_period).collect()
    assert sorted(map(str, (tuple(r) for r in rows))) == sorted(str((r["doc_id"], *_brute_digest(r["doc_id"], r["text"]))) for r in hard.collect())
    assert periodic.run_digests(hard_docs.limit(0)).count() == 0
    long = periodic.periodic_runs(hard_docs.filter("doc_id = 5")).collect()      # 54,000 words of period 8100 save their last
    assert all(r["length"] >= 4 * r["period"] for r in long)


def test_collapse_keeps_one_period(spark):
    df = spark.createDataFrame([(1, "x " + "a b c " * 5 + "y"), (2, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in periodic.collapse_runs(df).collect()} == {1: "x a b c y", 2: ""}
    assert [tuple(r) for r in periodic.periodic_runs(df).collect()] == [(1, 1, 15, 3)]
