"""Sketch catalogues: error bounds, stored sketches per file, and the running catalogue of a stream."""

import os

import pytest
from pyspark.sql import functions as F

from tabsight.catalog import TableSet
from tabsight.operators.profile import profile_columns
from tabsight.operators.sketches import SketchStore, describe_sketches, distinct_error, table_sketches
from tabsight.streaming.running_catalog import run_folder_catalog

EXACT = ["column_name", "ordinal", "dtype", "null_count", "min_value", "max_value", "row_count"]


def _rows(spark, lo, hi):
    """A unique key beyond 2^53, a hot value with nulls, a float with NaN, a text, a decimal."""
    i = F.col("id")
    return spark.range(lo, hi).select(
        (F.lit(2 ** 60) + i).alias("big"), F.when(i % 7 == 0, None).when(i % 3 == 0, 5).otherwise(i % 500).alias("hot"),
        F.when(i % 11 == 0, F.lit(float("nan"))).otherwise(i / 8).alias("x"), F.concat(F.lit("name "), i % 2000).alias("name"),
        (i % 300).cast("decimal(30,2)").alias("d"))


def _exact(catalog):
    return {r["column_name"]: tuple(r[c] for c in EXACT) for r in catalog.select(EXACT).collect()}


def test_estimates_keep_their_error_and_the_rest_is_exact(spark):
    df = _rows(spark, 0, 20000)
    t = TableSet({"t": df})
    approx, exact = profile_columns(t, approx=True), profile_columns(t, samples=False)
    assert _exact(approx) == _exact(exact)
    want = {r["column_name"]: r for r in exact.collect()}
    for r in approx.collect():
        n = want[r["column_name"]]["unique_count"]
        assert abs(r["unique_count"] - n) <= 1 + distinct_error() * n
        assert r["is_pk_candidate"] in (None, False)
        if want[r["column_name"]]["is_pk_candidate"]:
            assert r["is_pk_candidate"] is None       # a sketch never rules out a true key
    hot = next(r for r in approx.collect() if r["column_name"] == "hot")     # 5 holds the ranks from 1 % to 34 %
    assert hot["is_pk_candidate"] is False and hot["quantiles"][0] == 5.0


def test_one_shuffle_of_fixed_size_rows(spark):
    plan = table_sketches(_rows(spark, 0, 100))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" in plan


def test_empty_table(spark):
    got = describe_sketches(table_sketches(_rows(spark, 0, 0))).collect()
    assert [r["row_count"] for r in got] == [0] * 5 and all(r["quantiles"] is None and r["unique_count"] == 0 for r in got)


def test_store_reads_only_new_files_and_forgets_removed_ones(spark, tmp_path):
    data, schema = str(tmp_path / "data"), _rows(spark, 0, 1).schema
    store = SketchStore(spark, data, str(tmp_path / "store"), schema=schema)
    _rows(spark, 0, 3000).coalesce(1).write.parquet(f"{data}/a")
    assert store.sketches() is None and store.update() == 1 and store.update() == 0
    _rows(spark, 3000, 5000).coalesce(1).write.parquet(f"{data}/b")
    twin = SketchStore(spark, data, str(tmp_path / "store"), schema=schema)
    assert store.update() == 1
    # an update that runs again without knowing the first one's rows
    twin._stored = lambda: None
    assert twin.update() == 2
    want = describe_sketches(table_sketches(_rows(spark, 0, 5000)))
    assert _exact(describe_sketches(store.sketches())) == _exact(want)
    _rows(spark, 10, 20).coalesce(1).write.mode("overwrite").parquet(f"{data}/b")     # replaced
    assert store.update() == 1
    want = describe_sketches(table_sketches(_rows(spark, 0, 3000).union(_rows(spark, 10, 20))))
    assert _exact(describe_sketches(store.sketches())) == _exact(want)


@pytest.mark.parametrize("by", [[], ["d"]])
def test_stream_state_equals_one_batch_profile_and_replay_changes_nothing(spark, tmp_path, by):
    data, out, ckpt = (str(tmp_path / n) for n in ("data", "out", "ckpt"))
    rows = _rows(spark, 0, 2000).withColumn("d", (F.col("big") % 2).cast("int")) if by else _rows(spark, 0, 6000)
    schema, key = rows.schema, F.col("big") - F.lit(2 ** 60)
    cut = 1500 if by else 4000

    def state(got):
        return {tuple(r[k] for k in [*by, *EXACT, "unique_count"]) for r in got.collect()}

    rows.filter(key < cut).repartition(3).write.parquet(f"{data}/day=1")
    run_folder_catalog(spark, f"{data}/*", schema, out, ckpt, by)
    rows.filter(key >= cut).repartition(2).write.parquet(f"{data}/day=2")
    last = state(run_folder_catalog(spark, f"{data}/*", schema, out, ckpt, by))
    whole = run_folder_catalog(spark, f"{data}/*", schema, str(tmp_path / "out1"), str(tmp_path / "ckpt1"), by, max_files_per_trigger=99)
    assert {r[:-1] for r in last} == {r[:-1] for r in state(whole)}
    for a, b in zip(sorted(last, key=str), sorted(state(whole), key=str)):
        assert abs(a[-1] - b[-1]) <= 1 + 2 * distinct_error() * b[-1]
    # the last batch was done but not recorded: it is run again from the state before it
    commits = sorted((f for f in os.listdir(f"{ckpt}/commits") if f.isdigit()), key=int)
    for name in (commits[-1], f".{commits[-1]}.crc"):
        os.remove(f"{ckpt}/commits/{name}")
    assert state(run_folder_catalog(spark, f"{data}/*", schema, out, ckpt, by)) == last
    kept = [f for f in os.listdir(out) if f.startswith("batch_id=")]
    assert len(kept) == 2
