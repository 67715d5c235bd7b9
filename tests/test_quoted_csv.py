"""CSV files with quoted line breaks over many splits, against csv / pandas."""

import csv
import io
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsight.sources.csv import read_csv_table
from tabsight.sources.quoted import ends_inside, quoted_records, split_states


def _random_rows(rnd, n):
    bits = ["a", "b c", ",", '"', "\n", "\r\n", "\n\n", "", "x" * 30, "é日", '""', ",\n", "  "]
    return [["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 5))) for _ in range(3)] for _ in range(n)]


def _written(rows):
    buf = io.StringIO()
    csv.writer(buf, lineterminator="\n").writerows([["id", "left", "mid", "right"], *([k, *r] for k, r in enumerate(rows))])
    return buf.getvalue()


@pytest.fixture
def small_splits(spark):
    """Splits of a few hundred bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")

    def use(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    yield use
    for k, v in old.items():
        spark.conf.set(k, v)


def test_states_agree_with_a_parser_by_characters():
    def slow(line, inside):
        """Field by field, one character at a time."""
        state = "quoted" if inside else "start"
        k = 0
        while k < len(line):
            c = line[k]
            if state == "start":
                state = "quoted" if c == '"' else "start" if c == "," else "plain"
            elif state == "plain":
                state = "start" if c == "," else "plain"
            elif c == '"':
                if line[k + 1:k + 2] == '"':
                    k += 1
                else:
                    state = "plain"
            k += 1
        return state == "quoted"

    rnd = random.Random(1)
    for _ in range(20_000):
        line = "".join(rnd.choice('ab,"" ') for _ in range(rnd.randint(0, 14)))
        for inside in (False, True):
            assert ends_inside(line, inside) == slow(line, inside), (line, inside)


@pytest.mark.parametrize("size,seed", [(40, 1), (150, 2), (1000, 3), (1 << 20, 4)])
def test_split_files_equal_the_csv_module(spark, csv_file, small_splits, size, seed):
    rows = _random_rows(random.Random(seed), 150)
    path = csv_file(_written(rows), f"q{seed}.csv")
    small_splits(size)
    table = read_csv_table(spark, path)
    assert table.ok and table.df.columns[:4] == ["id", "left", "mid", "right"]
    if size < 1000:
        assert spark.read.text(path).rdd.getNumPartitions() > 5
    got = [tuple(r)[:4] for r in table.df.orderBy("_row_id").collect()]
    want = pd.read_csv(io.StringIO(_written(rows), newline=""), dtype={"left": object, "mid": object, "right": object})
    want = [tuple(None if pd.isna(v) else v for v in r) for r in want.itertuples(index=False)]
    assert got == want


def test_shuffled_start_states_give_the_same_records(spark, csv_file, small_splits):
    rows = _random_rows(random.Random(9), 120)
    path = csv_file(_written(rows), "s.csv")
    small_splits(60)
    states = split_states(spark, path)
    texts = [[r["value"] for r in quoted_records(spark, path, states, F.lit(True), max_broadcast=n).orderBy("rid").collect()]
             for n in (10 ** 6, -1)]
    assert texts[0] == texts[1] and len(texts[0]) == 121


def test_stray_quotes_do_not_open_fields(spark, tmp_path, small_splits):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.csv").write_text('id,what\n1,5" pipe\n2,plain\n3,"two\nlines"\n4,6" and 7" pipes\n')
    (tmp_path / "d" / "b.csv").write_text('id,what\n5,"one"\n6,8" pipe\n')
    small_splits(20)
    t = read_csv_table(spark, str(tmp_path / "d"))
    assert t.types == {"id": "int", "what": "string"}
    assert [tuple(r)[:2] for r in t.df.orderBy("_row_id").collect()] == [
        (1, '5" pipe'), (2, "plain"), (3, "two\nlines"), (4, '6" and 7" pipes'), (5, "one"), (6, '8" pipe')]


def test_header_with_a_line_break_blank_lines_and_long_rows(spark, csv_file):
    t = read_csv_table(spark, csv_file('\n"a\nb",c\n\n1,"x\ny"\n   \n2,z\r\n', "h.csv"))
    assert t.types == {"a\nb": "int", "c": "string"}
    assert [tuple(r)[:2] for r in t.df.orderBy("_row_id").collect()] == [(1, "x\ny"), (2, "z")]
    bad = read_csv_table(spark, csv_file('a,b\n1,"x\ny"\n1,2,3\n', "l.csv"))
    assert not bad.ok
    short = read_csv_table(spark, csv_file('a,b,c\n1,"x\ny"\n2,w,5\n', "k.csv"))
    assert [tuple(r)[:3] for r in short.df.orderBy("_row_id").collect()] == [(1, "x\ny", None), (2, "w", 5.0)]


def test_rows_of_several_files_come_in_path_order(spark, tmp_path, small_splits):
    folder = tmp_path / "many files"
    folder.mkdir()
    for k, name in enumerate(["a b.csv", "a+b.csv", "b%20.csv", "c.csv", "dé.csv"]):
        body = '"x\ny"' if k % 2 else "z"
        (folder / name).write_text("id,t\n" + "".join(f"{10 * k + j},{body}\n" for j in range(4)))
    small_splits(16)
    t = read_csv_table(spark, str(folder))
    assert [r["id"] for r in t.df.orderBy("_row_id").collect()] == [10 * k + j for k in range(5) for j in range(4)]
