"""The corpus pipeline stage by stage against brute-force versions of what each stage decides."""

import corpus_pipeline as P
from tabsight.llm.queries import QUERIES

from .test_dedup import brute_components, brute_lines

SF = "/root/testdata/sf0.001"


def test_stages_and_registration():
    import __spark_entry__ as E
    assert [n for n, _ in P.STAGES] == ["language_id", "quality_rules", "line_dedup", "minhash_near_dedup", "best_fit_packing"]
    assert {*QUERIES, "pipeline"} <= set(E.queries()) and [n for n in QUERIES if n.startswith("op")] == list(QUERIES)


def test_stage_by_stage(spark, docs):
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    one = P.language_stage(spark, docs, SF)
    assert one.columns == docs.columns
    gone = {i for i, _ in rows(docs)} - {i for i, _ in rows(one)}
    assert all(not any(c.isalpha() for c in t or "") for i, t in rows(docs) if i in gone)   # clean documents stay
    two = P.quality_stage(spark, one, SF)
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {i for i, _ in rows(two)}
    assert two.columns == docs.columns and not any(quality.get(i) == 0 for i in left)
    three = P.line_stage(spark, two, SF)
    want = {i: t for i, _, _, t in brute_lines(rows(two))}
    assert three.columns == docs.columns and dict(rows(three)) == want
    assert all(r["n_chars"] == len(r["text"]) for r in three.collect())
    four = P.near_stage(spark, three, SF)
    comp = brute_components(rows(three), 5)
    assert {i for i, _ in rows(four)} == {i for i, (_, c) in comp.items() if c == i}
    five = P.packing_stage(spark, four, SF).collect()
    assert {r["doc_id"] for r in five} == {i for i, _ in rows(four)}
    whole = P.run(spark, SF).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole)) == sorted(map(key, five))


def test_stages_take_hard_and_empty_tables(spark, hard_docs):
    for name, fn in P.STAGES:
        for table in (hard_docs, hard_docs.limit(0)):
            out = fn(spark, table, SF)
            assert out.count() <= 400 and (name == "best_fit_packing" or out.columns == hard_docs.columns)


def test_language_stage_drops_gibberish_and_unlearned_languages(spark):
    """Planted rows of sf0.01: random letters, hex strings, Polish, Finnish and Italian go, every clean document stays."""
    import random
    from pyspark.sql import functions as F
    sf, rnd = "/root/testdata/sf0.01", random.Random(5)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = lambda abc, n: " ".join("".join(rnd.choice(abc) for _ in range(rnd.randint(2, 9))) for _ in range(n))
    texts = ([words("abcdefghijklmnopqrstuvwxyz", 60) for _ in range(8)] + [words("bcdfghjklmnpqrstvwxz", 40) for _ in range(8)]
             + [" ".join(f"{rnd.getrandbits(128):032x}" for _ in range(20)) for _ in range(4)]
             + ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem",
                "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki",
                "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione"])
    planted = spark.createDataFrame([(10 ** 9 + i, t, "en" if i % 2 else None) for i, t in enumerate(texts)],
                                    "doc_id long, text string, lang string")
    both = docs.unionByName(planted, allowMissingColumns=True)
    left = {r["doc_id"] for r in P.language_stage(spark, both, sf).select("doc_id").collect()}
    assert left == {r["doc_id"] for r in docs.filter(F.col("text").rlike("\\p{L}")).select("doc_id").collect()}


def test_stages_judge_rows_without_an_id_one_by_one(spark):
    """Null-id rows: gibberish goes though others stay, and of near copies and exact repeats one row stays."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = max((r["text"] for r in docs.filter("lang = 'en'").collect() if r["text"]), key=len)
    rows = [(None, text, "en"), (None, text, "en"), (None, text + " again", "en"), (None, "xqzv kjwq zzxv qkwj vvqx", "en")]
    nulls = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    both = docs.unionByName(nulls, allowMissingColumns=True)
    kept = [r["text"] for r in P.language_stage(spark, both, SF).filter("doc_id IS NULL").collect()]
    assert sorted(kept) == sorted([text, text, text + " again"])
    assert [r["text"].startswith(text) for r in P.near_stage(spark, nulls.filter("text NOT LIKE 'xqzv%'"), SF).collect()] == [True]
