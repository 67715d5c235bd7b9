"""Keys and foreign keys of several columns (P10, P11 beyond single columns).

Both searches go level by level through sets of columns, as Apriori does, and check all candidates of a level in one
shuffle of two 64-bit hashes per row and candidate:

* :func:`composite_keys`: a set of columns is a key candidate if no two rows agree on it and no smaller key lies within it.
  A column with missing values is in no key.  Sets whose columns have too few distinct values
  together (their product is below the row count) are ruled out without looking at a row; the exact counts of single columns
  that this takes are the first level.  Partial aggregation collapses repeated value combinations, hot ones included, before the shuffle.
* :func:`composite_inclusions`: (A1, A2, ...) of one table is included in (B1, B2, ...) of another if every combination of
  values is, and so is every smaller part (rows count for the parts in which they miss no value).  Only combinations of column-wise
  inclusions whose smaller parts hold are looked at, and only column sets
  that are a key of their table are referenced (a foreign key).  The check is the bit-mask search of
  :mod:`tabsight.operators.inclusion` on combinations instead of values.

Candidate lists are schema-sized and live on the driver; rows never do.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.catalog import TableSet
from tabsight.operators.inclusion import contained_pairs, domain_value, inclusion_dependencies
from tabsight.operators.profile import is_missing

#: the share of value combinations that may rule out a column set before all of them are compared: one in so many
REFUTE_PART = 64

_KEYS = "table_name string, columns array<string>"
_EDGES = "dep_table string, dep_columns array<string>, ref_table string, ref_columns array<string>, dep_distinct bigint, ref_distinct bigint"


def value_hash(column: str, dt: T.DataType, seed: int) -> Column:
    """64-bit hash of a value, null if it is missing; values that compare as equal across types hash alike."""
    c = F.col(f"`{column}`")
    domain, vl, vd, vs = domain_value(c, dt)
    # a null leaves a hash as it is: say which part holds the value
    part = F.when(vl.isNotNull(), 1).when(vd.isNotNull(), 2).otherwise(3)
    return F.when(~is_missing(c, dt), F.xxhash64(F.lit(seed), domain, part, vl, vd, vs))


def _hashable(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields if domain_value(F.col("x"), f.dataType) is not None}


def _combinations(df: DataFrame, sets: list[tuple[int, tuple[str, ...]]], types: dict[str, T.DataType]) -> DataFrame:
    """(cid, h1, h2) per row and numbered column set; rows with a missing value in the set are left out."""
    used = {c: k for k, c in enumerate(dict.fromkeys(c for _, columns in sets for c in columns))}
    # every value is hashed once, then its hashes once per set
    hashed = df.select(*(value_hash(c, types[c], seed).alias(f"h{seed}_{k}") for c, k in used.items() for seed in (1, 2)))
    entries = []
    for cid, columns in sets:
        ks = [used[c] for c in columns]
        full = reduce(lambda a, b: a & b, [F.col(f"h1_{k}").isNotNull() for k in ks])
        entries.append(F.struct(F.when(full, F.lit(cid)).alias("cid"), F.xxhash64(*(f"h1_{k}" for k in ks)).alias("h1"),
                                F.xxhash64(*(f"h2_{k}" for k in ks)).alias("h2")))
    return hashed.select(F.explode(F.array(*entries)).alias("e")).select("e.*").filter("cid IS NOT NULL")


def _distinct_counts(df: DataFrame, sets: list[tuple[str, ...]], types: dict[str, T.DataType]) -> dict[tuple[str, ...], int]:
    """Exact number of different value combinations of each column set, in one shuffle."""
    got = (_combinations(df, list(enumerate(sets)), types).groupBy("cid", "h1", "h2").agg(F.lit(1).alias("one"))
           .groupBy("cid").agg(F.count(F.lit(1)).alias("n")).collect())        # one row a set
    counts = {r["cid"]: r["n"] for r in got}
    return {s: counts.get(k, 0) for k, s in enumerate(sets)}


def _not_refuted(df: DataFrame, sets: list[tuple[str, ...]], types: dict[str, T.DataType]) -> list[tuple[str, ...]]:
    """The sets without two rows that agree on one of the value combinations in a ``REFUTE_PART``-th of the hash range."""
    part = _combinations(df, list(enumerate(sets)), types).filter(F.pmod("h1", F.lit(REFUTE_PART)) == 0)
    twice = part.groupBy("cid", "h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    refuted = {r["cid"] for r in twice.select("cid").distinct().collect()}      # at most one row a set
    return [s for k, s in enumerate(sets) if k not in refuted]


def table_keys(df: DataFrame, max_size: int = 2) -> list[tuple[str, ...]]:
    """Minimal key candidates of up to ``max_size`` columns, single columns included."""
    types = _hashable(df)
    if not types:
        return []
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(is_missing(F.col(f"`{c}`"), t), 1)).alias(f"m{i}")
                                                 for i, (c, t) in enumerate(types.items())]).first()
    rows, full = row["n"], [c for i, c in enumerate(types) if row[f"m{i}"] == 0]
    if rows == 0 or not full:
        return []
    single = {s[0]: n for s, n in _distinct_counts(df, [(c,) for c in full], types).items()}
    keys = [(c,) for c in full if single[c] == rows]
    rest = [c for c in full if single[c] < rows]
    for size in range(2, max_size + 1):
        sets = [s for s in itertools.combinations(rest, size)
                if math.prod(single[c] for c in s) >= rows and not any(set(k) <= set(s) for k in keys)]
        if sets:
            sets = _not_refuted(df, sets, types)
        if sets:
            keys += [s for s, n in _distinct_counts(df, sets, types).items() if n == rows]
    return keys


def composite_keys(tables: TableSet, names: list[str] | None = None, max_size: int = 2) -> DataFrame:
    """(table_name, columns): minimal key candidates of two to ``max_size`` columns, columns in schema order."""
    found = [(t, list(k)) for t in names or list(tables) for k in table_keys(tables.plain(t), max_size) if len(k) > 1]
    return tables.spark.createDataFrame(found, _KEYS)


def composite_inclusions(tables: TableSet, names: list[str] | None = None, max_size: int = 2,
                         ref_keys: bool = True) -> DataFrame:
    """(dep_table, dep_columns, ref_table, ref_columns, dep_distinct, ref_distinct) of two to ``max_size`` columns;
    ``dep_columns`` in schema order, ``ref_columns`` the columns that they match.  ``ref_keys=False`` also lists inclusions
    in column sets that are no key."""
    names = list(names or list(tables))
    spark = tables.spark
    edges = [((r["dep_table"], r["dep_column"]), (r["ref_table"], r["ref_column"]))
             for r in inclusion_dependencies(tables, names, proper=False).collect()]     # schema-sized
    position = {(t, c): k for t in names for k, c in enumerate(tables.plain(t).columns)}
    by_tables: dict[tuple[str, str], list] = {}
    for dep, ref in edges:
        by_tables.setdefault((dep[0], ref[0]), []).append((dep, ref))
    keys = {t: [set(k) for k in table_keys(tables.plain(t), max_size)] for t in {r for _, r in by_tables}} if ref_keys else {}
    holds = {frozenset([e]) for e in edges}
    found = []
    for size in range(2, max_size + 1):
        candidates = []
        for (dep_table, ref_table), here in by_tables.items():
            for some in itertools.combinations(sorted(here, key=lambda e: position[e[0]]), size):
                if len({d for d, _ in some}) < size or len({r for _, r in some}) < size:
                    continue
                if size > 2 and any(frozenset(part) not in holds for part in itertools.combinations(some, size - 1)):
                    continue
                candidates.append(some)
        if not candidates:
            break
        held = _checked(tables, candidates)
        for some, n_dep, n_ref in held:
            holds.add(frozenset(some))
            ref_table, columns = some[0][1][0], [r[1] for _, r in some]
            if not ref_keys or set(columns) in keys[ref_table]:
                found.append((some[0][0][0], [d[1] for d, _ in some], ref_table, columns, n_dep, n_ref))
    return spark.createDataFrame(found, _EDGES)


def _checked(tables: TableSet, candidates: list) -> list:
    """The candidates that hold, with both distinct counts: one shuffle for all tables."""
    sides = {}
    for some in candidates:
        for k in (0, 1):
            sides.setdefault((some[0][k][0], tuple(e[k][1] for e in some)), len(sides))
    parts = []
    for table in {t for t, _ in sides}:
        df = tables.plain(table)
        parts.append(_combinations(df, [(cid, cols) for (t, cols), cid in sides.items() if t == table], _hashable(df)))
    long = reduce(DataFrame.unionByName, parts)
    pairs = {(r["a"], r["b"]): (r["n_a"], r["n_b"]) for r in contained_pairs(long, ("h1", "h2"), len(sides)).collect()}   # schema-sized
    out = []
    for some in candidates:
        a, b = (sides[some[0][k][0], tuple(e[k][1] for e in some)] for k in (0, 1))
        if (a, b) in pairs:
            out.append((some, *pairs[a, b]))
    return out
