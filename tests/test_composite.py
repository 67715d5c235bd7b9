"""Keys and inclusions of several columns against brute force on random tables."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tabsight.catalog import TableSet
from tabsight.operators.composite import composite_inclusions, composite_keys, table_keys
from tabsight.operators.inclusion import inclusion_dependencies


def _brute_keys(rows, names, max_size):
    keys = []
    for size in range(1, max_size + 1):
        for s in itertools.combinations(range(len(names)), size):
            if any(set(k) <= set(s) for k in keys) or any(r[i] is None or r[i] != r[i] for r in rows for i in s):
                continue
            if rows and len({tuple(r[i] for i in s) for r in rows}) == len(rows):
                keys.append(s)
    return {tuple(names[i] for i in k) for k in keys}


def _random_table(rnd, n):
    return [(rnd.randint(0, 6), rnd.choice(["a", "b", "c", ""]), rnd.choice([0.5, 1.0, 2.0, 3.0]), rnd.choice([1, 2, None, 3]) if rnd.random() < .1 else 4,
             rnd.randint(0, 9)) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_keys_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    names = ["i", "s", "d", "n", "j"]
    rows = list(dict.fromkeys(_random_table(rnd, rnd.choice([8, 20, 60]))))
    df = spark.createDataFrame(rows, "i int, s string, d double, n int, j long")
    got = set(table_keys(df, 3))
    assert got == _brute_keys(rows, names, 3)
    listed = {tuple(r["columns"]) for r in composite_keys(TableSet({"t": df}), max_size=3).collect()}
    assert listed == {k for k in got if len(k) > 1}


def test_keys_of_hard_tables(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert table_keys(empty) == [] and composite_keys(TableSet({"e": empty})).count() == 0
    lists = spark.createDataFrame([(1, [1]), (1, [2])], "a int, l array<int>")
    assert table_keys(lists) == []
    same = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, float("nan"))], "a int, b double")      # a repeated row: no key at all
    assert table_keys(same) == []
    hot = spark.range(3000).select((F.col("id") % 3 * 0).alias("k"), F.col("id").alias("at"), F.lit("x").alias("c"))
    assert table_keys(hot) == [("at",)]


def _brute_inclusions(tables, max_size, ref_keys):
    """tables: name -> (column names, rows); sets of non-null combinations, compared as Python compares."""
    out = set()
    values = lambda t, cols: {tuple(r[tables[t][0].index(c)] for c in cols) for r in tables[t][1]
                              if all(r[tables[t][0].index(c)] is not None for c in cols)}
    for a, b in itertools.permutations(tables, 2):
        keys = _brute_keys(tables[b][1], tables[b][0], max_size)
        for size in range(2, max_size + 1):
            for dep in itertools.combinations(tables[a][0], size):
                if not values(a, dep) or any(not values(a, (c,)) for c in dep):
                    continue
                for ref in itertools.permutations(tables[b][0], size):
                    # every smaller part too: its values count also where another column of the row is missing
                    parts = [p for n in range(1, size + 1) for p in itertools.combinations(zip(dep, ref), n)]
                    if all(values(a, [d for d, _ in p]) <= values(b, [r for _, r in p]) for p in parts):
                        if not ref_keys or any(set(k) == set(ref) for k in keys):
                            out.add((a, dep, b, ref, len(values(a, dep)), len(values(b, ref))))
    return out


@pytest.mark.parametrize("ref_keys", [True, False])
@pytest.mark.parametrize("seed", range(3))
def test_inclusions_equal_brute_force(spark, seed, ref_keys):
    rnd = random.Random(seed)
    grid = [(i, j, rnd.choice("xyz"), float(i)) for i in range(5) for j in range(4)]
    some = rnd.sample(grid, 8)
    tables = {"grid": (["i", "j", "s", "f"], grid), "part": (["pj", "pi", "t"], [(j, i, s) for i, j, s, _ in some] + [(None, 1, "x")]),
              "wide": (["a", "b", "c"], [(float(i), j, rnd.choice("xyz")) for i, j, _, _ in rnd.sample(grid, 6)]),
              "odd": (["u", "v"], [(0, 9), (1, 0)])}
    types = {"grid": "i int, j long, s string, f double", "part": "pj int, pi int, t string", "wide": "a double, b int, c string", "odd": "u int, v int"}
    ts = TableSet({n: spark.createDataFrame(rows, types[n]) for n, (_, rows) in tables.items()})
    got = {(r["dep_table"], tuple(r["dep_columns"]), r["ref_table"], tuple(r["ref_columns"]), r["dep_distinct"], r["ref_distinct"])
           for r in composite_inclusions(ts, max_size=3, ref_keys=ref_keys).collect()}
    assert got == _brute_inclusions(tables, 3, ref_keys)
    assert any(r[0] == "part" and set(r[3]) == {"i", "j"} for r in got)


def test_unary_inclusions_may_be_equal_sets(spark):
    ts = TableSet({"a": spark.createDataFrame([(1,), (2,)], "x int"), "b": spark.createDataFrame([(2.0,), (1.0,), (1.0,)], "y double")})
    assert inclusion_dependencies(ts).count() == 0 and inclusion_dependencies(ts, proper=False).count() == 2
