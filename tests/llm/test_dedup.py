"""Line runs and odd-sketch near-duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tabsight.llm.components import connected_components, joined_labels
from tabsight.llm.linededup import _SALT, dedup_lines, key_hashes
from tabsight.llm.oddsketch import estimated_jaccard, near_duplicates, odd_sketches, popcount_cut
from tabsight.llm.queries import QUERIES
from tabsight.llm.staging import Stage

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_lines(rows, min_chars=10):
    """(n_lines, kept text) per row: eligible lines stay in the smallest id that holds them."""
    low = lambda i: float("-inf") if i is None else i
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    first = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            k = key(x)
            if len(k) >= min_chars:
                first[k] = min(first.get(k, float("inf")), low(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or first[key(x)] == low(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_hashes_equal_the_sql_functions(spark):
    from pyspark.sql import functions as F
    keys = ["", "a", "some longer line of text", "é" * 50, "日本語" * 40]
    df = spark.createDataFrame([(k,) for k in keys], "k string").select(
        "k", F.xxhash64("k").alias("a"), F.xxhash64(F.lit(_SALT), "k").alias("b"))
    for r in df.collect():
        assert key_hashes(r["k"].encode()) == (r["a"], r["b"])


@pytest.mark.parametrize("batches,fanout", [(1, 3), (5, 2), (7, 3)])
def test_line_runs_match_brute_force(spark, docs, batches, fanout):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = dedup_lines(spark, docs, batches=batches, fanout=fanout).collect()
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got) == sorted(brute_lines(rows))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_line_runs_hard_rows(spark, hard_docs):
    rows = [(r["doc_id"], r["text"]) for r in hard_docs.collect()]
    out = dedup_lines(spark, hard_docs, batches=3)
    assert out.columns == [*hard_docs.columns, "kept_text", "n_lines", "n_dropped"]
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in out.collect())
    assert got == Counter(brute_lines(rows))
    assert dedup_lines(spark, hard_docs.limit(0)).count() == 0


def test_line_query_digest(spark, docs):
    want = {i: (n, d, hashlib.sha256(t.encode()).hexdigest())
            for i, n, d, t in brute_lines([(r["doc_id"], r["text"]) for r in docs.collect()])}
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in QUERIES["op5_line_runs"].fn(spark, SF).collect()}
    assert got == want


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_components(rows, width, percent=80):
    sets = {i: shingles(t, width) for i, t in rows}
    ids, up = sorted(sets), {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for i in ids:
        for s in sets[i]:
            holders[s].append(i)
    shared = Counter()
    for i in ids:
        for s in sets[i]:
            for j in holders[s]:
                if j < i:
                    shared[i, j] += 1
    for (i, j), n in shared.items():
        if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicate_query_matches_brute_force(spark, docs):
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], 4)
    rows = QUERIES["op10_odd_sketches"].fn(spark, SF).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows) and len(rows) == docs.count()


def _near_group(n, seed, words=120, hot=0.4):
    """Edited copies of one text whose similarities straddle the threshold, plus exact copies and other texts."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randint(0, 5000)}" for _ in range(words)]
    rows = []
    for i in range(n):
        if rnd.random() < hot:
            t = list(base)
            for _ in range(rnd.choice([0, 0, 1, 3, 5, 8, 12])):
                t[rnd.randrange(words)] = f"e{rnd.randint(0, 10 ** 6)}"
        else:
            t = [f"w{rnd.randint(0, 5000)}" for _ in range(rnd.randint(3, 60))]
        rows.append((i * 3, " ".join(t)))
    return rows


@pytest.mark.parametrize("chunk", [4, 2048])
def test_hot_group_of_near_copies(spark, chunk):
    rows = _near_group(260, 11)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark, df, width=4, chunk=chunk).collect()}
    assert got == brute_components(rows, 4)


def test_near_duplicates_hard_rows(spark, hard_docs):
    rows = near_duplicates(spark, hard_docs, width=5).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert len(rows) == hard_docs.count() and len(by[7]) == 2
    assert by[None][0]["component_id"] is None and by[None][0]["kept"]
    assert by[1][0]["component_id"] is None and not by[1][0]["kept"] and not by[8][0]["kept"]
    assert by[6][0]["component_id"] == 5 and by[5][0]["kept"]
    assert [(by[i][0]["n_shingles"], by[i][0]["component_id"]) for i in (2, 3, 4)] == [(0, 2), (0, 3), (0, 4)]
    assert near_duplicates(spark, hard_docs.limit(0)).count() == 0


def test_odd_sketch_estimates():
    rnd = np.random.default_rng(0)
    k, bits = 128, 512
    base = rnd.integers(0, 2 ** 32, (400, k), dtype=np.uint32)
    for jaccard in (0.95, 0.9, 0.8):
        other = np.where(rnd.random((400, k)) < jaccard, base, rnd.integers(0, 2 ** 32, (400, k), dtype=np.uint32))
        pop = np.bitwise_count(odd_sketches(base) ^ odd_sketches(other)).sum(axis=1)
        assert abs(estimated_jaccard(pop, k, bits).mean() - jaccard) < 0.02
        assert (pop <= popcount_cut(k, bits, 0.8)).all()
    far = rnd.integers(0, 2 ** 32, (400, k), dtype=np.uint32)
    pop = np.bitwise_count(odd_sketches(base) ^ odd_sketches(far)).sum(axis=1)
    assert (pop > popcount_cut(k, bits, 0.8)).all()


def test_connected_components_paths_and_stars(spark):
    rnd = random.Random(3)
    for shape in ([(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)], [],
                  [(rnd.randrange(100), rnd.randrange(100)) for _ in range(60)]):
        df = spark.createDataFrame(shape, "a long, b long")
        got = {r["node"]: r["label"] for r in connected_components(Stage(spark, "cc"), df).collect()}
        up = {}

        def root(x):
            while up.get(x, x) != x:
                x = up[x]
            return x

        for a, b in shape:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
        nodes = {x for e in shape for x in e}
        assert got == {x: root(x) for x in nodes if root(x) != x}
        stage = Stage(spark, "cc")
        cut = len(shape) // 2
        first = connected_components(stage, spark.createDataFrame(shape[:cut], "a long, b long"))
        both = joined_labels(stage, first, spark.createDataFrame(shape[cut:], "a long, b long"))
        assert {r["node"]: r["label"] for r in both.collect()} == got


def _third_null(seed=2):
    """Rows of which a third have no id: shared lines, near copies and exact repeats within and across them."""
    rnd = random.Random(seed)
    base = [[f"w{rnd.randint(0, 5000)}" for _ in range(120)] for _ in range(4)]
    rows = []
    for i in range(150):
        t = list(base[i % 4])
        for _ in range(rnd.choice([0, 1, 2, 60])):
            t[rnd.randrange(120)] = f"e{rnd.randint(0, 10 ** 6)}"
        rows.append((None if i % 3 == 0 else i, " ".join(t) + f"\nthis line is shared by group {i % 5}\nown line of row number {i}"))
    rows += [(None, rows[0][1]), (None, rows[0][1]), (1, rows[1][1]), (1, rows[2][1] + " again"), (None, None), (None, "")]
    return rows


def test_line_runs_with_a_third_of_the_ids_null(spark):
    rows = _third_null()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["kept_text"], r["text"]) for r in dedup_lines(spark, df, batches=3).collect()]
    assert Counter((i, t) for i, _, t in got) == Counter(rows)
    holders = defaultdict(set)
    for i, kept, t in got:
        for line in kept.split("\n"):
            if len(line) >= 10:
                holders[line].add((i, t if i is None else None))   # a null-id document is its text
    assert set(holders) == {x for _, t in rows for x in (t or "").split("\n") if len(x) >= 10}
    low = {k: min((float("-inf") if i is None else i) for i, t in rows if k in (t or "").split("\n")) for k in holders}
    assert all(len(h) == 1 and [float("-inf") if i is None else i for i, _ in h] == [low[k]] for k, h in holders.items())


def test_near_duplicates_with_a_third_of_the_ids_null(spark):
    rows = _third_null()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = near_duplicates(spark, df, width=4, ties=True).collect()
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    comp = brute_components([(k, rows[j][1]) for k, j in enumerate(order)], 4)   # rows numbered by id
    want = Counter((rows[j][0], comp[k][0], rows[order[comp[k][1]]][0]) for k, j in enumerate(order))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == want
    full = [r for r in out if r["n_shingles"]]
    assert sum(r["kept"] for r in full) == len({c for n, c in comp.values() if n})   # one row a component
    assert all(r["kept"] for r in out if not r["n_shingles"])
