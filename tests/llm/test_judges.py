"""Quality rules, language ID, URL filter, top-k and WARC against brute force and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsight.llm import urlfilter
from tabsight.llm.langid import learn_filters, predict_languages, tag_languages
from tabsight.llm.quality import judge_quality, pick_threshold
from tabsight.llm.queries import QUERIES
from tabsight.llm.topk import exact_topk, quantised
from tabsight.llm.warc import chunked, dechunk, read_archives, resolve_revisits, write_archives

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
    cover = set()
    for k in range(len(w) - 4):
        if grams[tuple(w[k:k + 5])] > 1:
            cover.update(range(k, k + 5))
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover))


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_quality_query(spark, docs):
    got = {r["doc_id"]: r for r in QUERIES["op6_quality_ratio"].fn(spark, SF).collect()}
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for r in docs.collect():
        n, g = brute_counts(r["text"]), got[r["doc_id"]]
        assert tuple(g[f] for f in FIELDS) == n
        assert g["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert g["kept"] == (not g["base_failed"] and g["llr"] >= g["threshold"])
    good = [g["kept"] for i, g in got.items() if quality.get(i) == 1 and not g["base_failed"]]
    bad = [g["kept"] for i, g in got.items() if quality.get(i) == 0]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.05


def test_quality_ratio_is_the_documented_mean(spark):
    """The score of every text from dictionaries instead of arrays."""
    import pyarrow as pa
    from tabsight.llm.quality import BUCKETS, word_features
    rows = [(1, "good words here are nice and calm today my friend ok"), (2, "BAD!! WORDS!! SHOUT!! ALL!! THE!! TIME!! HERE!! OH!! MY!! NO!!"),
            (3, "good calm words and nice days here my dear friend ok")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    got = {r["doc_id"]: r["llr"] for r in judge_quality(spark, df, labels).collect()}
    feats = {i: Counter() for i, _ in rows}
    for i, t in rows:
        for w in t.split():
            for _, h in word_features(pa.array([w]), BUCKETS):
                feats[i].update(h.tolist())
    raw, target = sum(feats.values(), Counter()), feats[1]
    n_raw, n_target = sum(raw.values()) + 0.5 * BUCKETS, sum(target.values()) + 0.5 * BUCKETS
    for i, c in feats.items():
        want = sum(n * (math.log((target[h] + 0.5) / n_target) - math.log((raw[h] + 0.5) / n_raw)) for h, n in c.items()) / sum(c.values())
        assert abs(got[i] - want) < 1e-9


def test_quality_models_take_every_label(spark):
    """52,000 trusted documents are the corpus: both models are equal, so every ratio is 0."""
    from tabsight.llm.quality import learn_quality
    df = spark.range(52_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[
        F.concat(F.lit(w), F.pmod(F.xxhash64("id", F.lit(w)), F.lit(5000)).cast("string")) for w in ("one", "two", "three")]).alias("text"))
    model = learn_quality(spark, df, df.select("doc_id", F.lit(1).alias("quality")), min_words=1)
    assert np.abs(model.ratios).max() == 0


def test_quality_threshold_of_a_table(spark):
    from tabsight.llm.quality import score_threshold
    rng = random.Random(5)
    for n, loss in ((1, 0.5), (2, 0.5), (3, 0.002), (400, 0.01), (401, 0.3), (50, 0.99)):
        scores = [(round(rng.uniform(-1, 1), 2), int(rng.random() < 0.7)) for _ in range(n)]
        got = score_threshold(spark.createDataFrame(scores, "llr double, quality int"), loss)
        assert got == pick_threshold(scores, loss)
    assert score_threshold(spark.createDataFrame([(0.5, 0)], "llr double, quality int")) == -math.inf


def test_quality_hard_rows(spark, hard_docs):
    labels = spark.createDataFrame([(1, 1), (1, 1), (None, 1), (2, 0)], "doc_id long, quality int")
    rows = judge_quality(spark, hard_docs, labels).collect()
    assert len(rows) == hard_docs.count()
    texts = Counter((r["doc_id"], brute_counts(r["text"])) for r in hard_docs.collect())
    assert Counter((r["doc_id"], tuple(r[f] for f in FIELDS)) for r in rows) == texts
    none = judge_quality(spark, hard_docs, labels.limit(0)).collect()
    assert all(r["kept"] != r["base_failed"] for r in none)      # nothing labelled: the ratio rejects nothing
    assert judge_quality(spark, hard_docs.limit(0), labels).count() == 0
    assert pick_threshold([]) == -math.inf and -2 < pick_threshold([(0.0, 1), (-2.0, 0)]) < 0


def test_language_query_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op8_language_masks"].fn(spark, sf).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows) and len(rows) == len(lang)
    assert all(0 <= r["score"] <= 1 for r in rows)
    held = [lang[r["doc_id"]] == r["lang_pred"] for r in rows if r["held_out"]]
    assert len(held) > 100 and np.mean(held) >= 0.98


def test_language_filters_return_every_language_of_a_gram(spark):
    import pyarrow as pa
    from tabsight.llm.textbatch import char_grams
    train = spark.createDataFrame([("aaa bbb", "x"), ("bbb ccc", "y"), ("ccc ddd aaa", "z")], "text string, lang string")
    model = learn_filters(train, min_share=0.0, ratio=0.0)
    assert model.languages == ["x", "y", "z"]
    for word, langs in (("aaa", {0, 2}), ("bbb", {0, 1}), ("ddd", {2})):
        _, g = char_grams(pa.array([word]), (3,))
        for mask in model.lookup(g):
            assert langs <= {i for i in range(3) if int(mask) >> i & 1}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predict_languages(spark.createDataFrame(
        [(1, "aaa bbb"), (2, "12 -- 3"), (3, None), (4, ""), (5, "ddd ddd")], "doc_id long, text string"), model).collect()}
    assert got[1][0] == "x" and got[5][0] == "z" and [got[i] for i in (2, 3, 4)] == [("und", 0.0)] * 3


def test_more_languages_than_one_word_has_bits(spark):
    """150 languages, each with letters of its own; the last one has the fewest n-grams."""
    abc = [chr(0x4E00 + i) for i in range(600)]
    text = lambda i: " ".join("".join(abc[4 * i:4 * i + 4]) for _ in range(300 - i))
    rows = [(i, text(i), f"l{i:03d}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = learn_filters(docs)
    assert model.languages == [x for _, _, x in rows] and model.slices.shape[0] == 3
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predict_languages(docs, model).collect()}
    assert all(got[i][0] == x and got[i][1] > 0.99 for i, _, x in rows)


def test_language_hard_rows(spark, hard_docs):
    model = learn_filters(hard_docs)
    rows = predict_languages(hard_docs, model).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in hard_docs.collect())
    empty = learn_filters(hard_docs.limit(0))
    assert all(r["lang_pred"] == "und" for r in predict_languages(hard_docs, empty).collect())
    assert predict_languages(hard_docs.limit(0), model).count() == 0


def test_url_parts_rules_and_terms(spark):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/1", "http://www.example.com/en/", "http://x.net/fr/2?q=/es/", "http://net",
            "http://x.org/Cheap-Pills/", "http://x.org/cheappills", "http://x.org/free/bets", "http://x.org/freebets", "http://x.org/free?free",
            "http://notexample.com/en/1", "ftp://u@h.org:80#a/b", "://", "http://x.org/\nporn", "http://spam-farm.com/a"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: tuple(r)[1:5] for r in urlfilter.judge_urls(df).collect()}
    want = [("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
            ("a.example.com", "/en/1", "example.com/en/", "block"), ("www.example.com", "/en/", "www.example.com/", "allow"),
            ("x.net", "/fr/2", "net/fr/", "block"), ("net", "", None, "allow"), ("x.org", "/Cheap-Pills/", None, "block"),
            ("x.org", "/cheappills", None, "allow"), ("x.org", "/free/bets", None, "block"), ("x.org", "/freebets", None, "allow"),
            ("x.org", "/free", None, "allow"), ("notexample.com", "/en/1", "com/", "allow"), ("u@h.org:80", "", None, "allow"),
            ("", "", None, "allow"), ("x.org", "/\nporn", None, "block"), ("spam-farm.com", "/a", "com/", "allow")]
    assert [got[i] for i in range(len(urls))] == want
    assert urlfilter.judge_urls(df.limit(0)).count() == 0


def test_vocabulary_of_thousands_of_weighted_overlapping_terms(spark, tmp_path):
    rng = random.Random(9)
    terms = {"".join(rng.choices("abc-.1", k=rng.randint(1, 5))) for _ in range(6000)} | {"a", "ab", "b-a", "é", "a.c", "(a", "+"}
    terms = sorted(t for t in terms if t.strip())
    lines = ["# version\t7", "# limit\t2.5"]
    for i, t in enumerate(terms):
        lines.append(f"{t}\tc{i % 5}\tstrict" if len(t) > 4 and i % 7 == 0 else f"{t}\tc{i % 5}\tsoft\t{(i % 9 + 1) / 8}")
    rng.shuffle(lines)
    (tmp_path / "terms.tsv").write_text("\n".join(lines), encoding="utf-8")
    known = urlfilter.load_vocabulary(spark, str(tmp_path / "terms.tsv"))
    assert known.version == "7" and known.limit == 2.5 and len(known.strict) + len(known.soft) == len(terms) > 2000
    urls = [None, "", "É", "http://(a+b"] + ["https://h.org/" + "".join(rng.choices("abcABC-./1é", k=rng.randint(0, 14))) for _ in range(400)]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, categories string")
    got = {r["page_id"]: r for r in urlfilter.judge_urls(df, rules=(), vocabulary=known).collect()}
    verdicts = set()
    for i, u in enumerate(urls):
        u = (u or "").lower()
        hits = [t for t in terms if t in u and re.search(f"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", u)]
        strict, weight = [t for t in hits if t in known.strict], sum(known.soft[t][1] for t in hits if t in known.soft)
        cats = sorted({known.strict[t] if t in known.strict else known.soft[t][0] for t in hits})
        want = "block" if strict or weight >= 2.5 else "allow"
        verdicts.add(want)
        r = got[i]
        assert (r["n_strict"], r["soft_weight"], r["categories"], r["verdict"]) == (len(strict), pytest.approx(weight), cats, want)
    assert verdicts == {"allow", "block"}


def test_vocabulary_files_with_faults():
    for bad in (["a\tc"], ["a\tc\thard"], ["a\tc\tsoft\t1", "A\tc\tstrict"], ["a\tc\tsoft\tmuch"]):
        with pytest.raises(ValueError):
            urlfilter.parse_vocabulary(bad)
    empty = urlfilter.parse_vocabulary([])
    assert not empty.strict and not empty.soft


def test_language_counts_equal_exact_sets(spark):
    """Filters against exact per-language n-gram sets in plain Python: no false misses, and corrected shares near the exact ones."""
    rows = [("aa", "wir gehen heute nach hause und essen brot"), ("aa", "heute essen wir brot und gehen"),
            ("bb", "we go home today and eat bread"), ("bb", "today we eat some bread at home"),
            ("cc", "мы идем домой и едим хлеб"), ("cc", "сегодня едим хлеб дома")]
    train = spark.createDataFrame([(i, t, l) for i, (l, t) in enumerate(rows)], "doc_id long, text string, lang string")
    model = learn_filters(train)

    def grams(text, orders=(1, 2, 3)):
        out = []
        for w in text.split():
            w = f" {w} "
            out += [w[i:i + n] for n in orders for i in range(len(w) - n + 1) if w[i:i + n] != " "]
        return out

    share = {}
    for lang in ("aa", "bb", "cc"):
        c = Counter(g for l, t in rows if l == lang for g in grams(t))
        share[lang] = {g: n / sum(c.values()) for g, n in c.items()}
    best = Counter()
    for s in share.values():
        for g, x in s.items():
            best[g] = max(best[g], x)
    held = {lang: {g for g, x in s.items() if x >= 0.25 * best[g]} for lang, s in share.items()}
    texts = [t for _, t in rows] + ["wir go хлеб", "heute bread", "brot brot brot und home"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in tag_languages(df, model).collect():
        every = grams(texts[r["doc_id"]])
        hits = {lang: sum(g in held[lang] for g in every) / len(every) for lang in held}
        top = max(hits.values())
        assert hits[r["lang_pred"]] >= top - 0.02
        three = grams(texts[r["doc_id"]], (3,))
        assert r["score"] == pytest.approx(sum(g in held[r["lang_pred"]] for g in three) / len(three), abs=0.02)


def brute_topk(rows, k):
    vecs = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for qi, q in vecs:
        if qi is None or qi % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), float("-inf") if i is None else i) for i, v in vecs if i != qi)
        out += [(qi, r + 1, None if i == float("-inf") else i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("lists,block,qblock", [(1, 7, 2), (4, 16, 256), (64, 4096, 3)])
def test_topk_ties_hard_vectors_and_blocks(spark, lists, block, qblock):
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.normal(size=6).astype("float32").tolist()) for i in range(0, 1200, 10)]
    rows += [(5000 + i, rows[0][1]) for i in range(40)]          # one very common vector
    rows += [(3, None), (4, [1.0, None, 2.0]), (6, [float("nan")]), (8, [float("inf"), 1.0]), (9, []), (11, [1.0]), (None, [0.5] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = quantised(df).selectExpr("vec_id AS id", "vec")
    got = exact_topk(spark, v, v.filter("id % 100 = 0"), 10, lists, qblock, block, group=2).collect()
    assert sorted(map(tuple, got), key=str) == brute_topk(rows, 10)


def test_topk_few_or_no_rows(spark):
    df = spark.createDataFrame([(100, [1.0, 2.0]), (7, [0.5, 1.0])], "vec_id long, embedding array<float>")
    v = quantised(df).selectExpr("vec_id AS id", "vec")
    assert [tuple(r) for r in exact_topk(spark, v, v.filter("id % 100 = 0")).collect()] == [(100, 1, 7, 1024 * 512 + 2048 * 1024)]
    none = v.limit(0)
    assert exact_topk(spark, none, none).count() == 0 and exact_topk(spark, v, none).count() == 0


def test_chunked_framing_round_trip():
    for data in (b"", b"x", b"\r\n0\r\n\r\n" * 9, bytes(range(256)) * 50):
        assert dechunk(chunked(data, 7)) == data
    for broken in (b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b"3\r\nabc"):
        with pytest.raises(ValueError):
            dechunk(broken)


def _pages(spark):
    big = "".join(f"<p>{i} päge</p>" for i in range(9000))
    rows = [(3, "http://a/1", big), (1, "http://a/2", big), (2, None, None), (4, "u", ""), (5, "u", "x" * 99), (6, "u", "x" * 99),
            (7, "u", "y" * 100), (8, "u", "y" * 100), (9, "u", "y" * 100), (10, "h\r\nWARC-Type: revisit\r\n\r\n", "z" * 5000),
            (11, "u", big + "!"), (11, "u", big + "!"), (None, "u", "n" * 200)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def _expected(pages):
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    low = lambda i: float("-inf") if i is None else i
    first = {}
    for i, b in rows:
        if len(b) >= 100:
            first[b] = min(first.get(b, float("inf")), low(i))
    out = []
    for i, b in rows:
        again = b in first and first[b] != low(i)
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return Counter(out)


@pytest.mark.parametrize("segment,volume", [(700, 2000), (16 << 10, 64 << 20)])
def test_warc_round_trip_over_segments_and_volumes(spark, segment, volume):
    pages = _pages(spark)
    root, manifest = write_archives(spark, pages.repartition(2), segment_bytes=segment, volume_bytes=volume)
    records = read_archives(spark, root, manifest)
    got = resolve_revisits(spark, records)
    assert got.filter("error IS NOT NULL").count() == 0
    assert Counter(tuple(r)[:5] for r in got.collect()) == _expected(pages)
    empty = write_archives(spark, pages.limit(0))
    assert resolve_revisits(spark, read_archives(spark, *empty)).count() == 0


def test_warc_reports_broken_records(spark, tmp_path):
    import gzip
    import glob
    pages = spark.createDataFrame([(i, "u", f"{i}" * 3000) for i in range(1, 5)], "page_id long, url string, html string").coalesce(1)
    root, manifest = write_archives(spark, pages, segment_bytes=1000)
    paths = glob.glob(root.replace("file:", "") + "/*.warc.gz")
    for path in paths:
        with gzip.open(path) as f:
            raw = f.read()
        raw = raw.replace(b"2222222222", b"2222922222", 1)                                             # page 2: another digest
        raw = re.sub(rb"(Total-Length: )(\d+\r\nContent-Length: \d+\r\n\r\n1)", rb"\g<1>9\g<2>", raw)   # page 1: another length
        with gzip.open(path, "wb") as f:
            f.write(raw)
    got = {r["page_id"]: r for r in read_archives(spark, root, manifest).collect()}
    assert "segments hold" in got[1]["error"] and got[2]["error"] == "payload digest differs"
    assert got[3]["payload"] == b"3" * 3000 and got[4]["error"] is None
    for path in paths:
        with open(path, "r+b") as f:
            f.truncate(f.seek(0, 2) // 2)
    errors = [r["error"] for r in read_archives(spark, root, manifest).collect() if r["error"]]
    assert any("damaged volume" in e or "shorter" in e for e in errors)
