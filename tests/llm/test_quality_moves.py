"""The quality operator's models: which texts move to their labels, and the counts against plain Python."""

import os
import random
import threading
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabsight.llm import quality as Q


class ShuffleFiles:
    """Bytes of the shuffle files written inside the block, read over and over: Spark removes them when it likes."""

    def __init__(self, spark):
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        self.dirs, self.seen, self.over = [str(d) for d in dirs], {}, threading.Event()
        self.old = set(self._look())

    def _look(self):
        out = {}
        for at, _, names in (x for d in self.dirs for x in os.walk(d)):
            for f in names:
                if f.startswith("shuffle_") and f.endswith(".data"):
                    try:
                        out[f] = os.path.getsize(os.path.join(at, f))
                    except FileNotFoundError:
                        pass
        return out

    def _watch(self):
        while not self.over.wait(0.02):
            self.seen |= self._look()

    def __enter__(self):
        self.thread = threading.Thread(target=self._watch)
        self.thread.start()
        return self

    def __exit__(self, *_):
        self.over.set()
        self.thread.join()
        self.moved = sum(n for f, n in (self.seen | self._look()).items() if f not in self.old)


@pytest.mark.parametrize("learn", ["ratios", "quality", "judge"])
def test_texts_without_a_label_do_not_move(spark, tmp_path, learn):
    """1 of 50 documents is labelled, and no table is small enough for a broadcast of Spark's own choice."""
    rnd = random.Random(3)
    rows = [(i, " ".join(f"{rnd.getrandbits(60):x}" for _ in range(300))) for i in range(1000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    spark.createDataFrame([(i, int(i % 100 == 0)) for i in range(0, 1000, 50)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels"))
    labels = spark.read.parquet(str(tmp_path / "labels"))     # of its own: no filter of these ids can be inferred for the documents
    packed = sum(len(zlib.compress(t.encode(), 1)) for _, t in rows)
    conf = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(conf)
    spark.conf.set(conf, "-1")
    try:
        with ShuffleFiles(spark) as files:
            if learn == "ratios":
                Q.learn_ratios(docs, Q.label_marks(labels), 512)
            elif learn == "quality":
                Q.learn_quality(spark, docs, labels, 512)
            else:
                assert Q.judge_quality(spark, docs, labels, 512).count() == len(rows)
    finally:
        spark.conf.set(conf, was)
    assert files.moved < 0.25 * packed, (files.moved, packed)


def test_may_hold_keeps_every_id(spark):
    docs = spark.range(20_000).select(F.when(F.col("id") % 7 == 0, -F.col("id") * 10 ** 14).otherwise(F.col("id")).alias("k"),
                                      F.lit("t").alias("t"))
    ids = docs.filter("abs(k) % 10 = 0").select("k")
    want = {r["k"] for r in ids.collect()}
    for slots, most in ((1 << 25, 1.01), (1 << 18, 1.2), (1 << 10, 10)):
        got = [r["k"] for r in Q.may_hold(docs, ids, "k", slots).collect()]
        assert want <= set(got) and len(got) == len(set(got)) <= most * len(want)
    assert Q.may_hold(docs, ids, "k").columns == docs.columns
    assert Q.may_hold(docs, ids.limit(0), "k").count() == 0


def test_ratios_equal_counts_in_plain_python(spark):
    """Null and repeated ids, null texts, labels given twice with both values, labels without a document."""
    rnd = random.Random(8)
    words = ["alpha", "Beta", "gAMMA", "delta", "ünï", "x", "42"]
    rows = [(rnd.choice([None, *range(60)]), rnd.choice([None, "", " ".join(rnd.choices(words, k=rnd.randint(1, 30)))]))
            for _ in range(300)]
    marks = [(i, i % 3 % 2) for i in range(0, 90, 2)] + [(4, 0), (4, 1), (None, 1), (10, 1), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    low = {}
    for i, q in marks:
        if i is not None and q is not None:
            low[i] = min(low.get(i, 1), q)
    raw, tgt = np.full(256, 0.5), np.full(256, 0.5)
    for i, t in rows:
        for w in (t or "").split():
            for _, h in Q.word_features(pa.array([w], pa.large_string()), 256):
                np.add.at(raw, h, 1)
                if low.get(i) == 1:
                    np.add.at(tgt, h, 1)
    got = Q.learn_ratios(docs, Q.label_marks(labels), 256)
    assert np.array_equal(got, np.log(tgt / tgt.sum()) - np.log(raw / raw.sum()))
    assert not Q.learn_ratios(docs, Q.label_marks(labels.limit(0)), 256).any()
