"""CSV ingest with the reference's ``pandas.read_csv`` semantics.

Spark reads every column as a string (no ``inferSchema`` pass, no driver-side
sampling); pandas' NA tokens become null; one aggregate over all columns decides
each column's type from the whole column (int -> float -> bool -> string); a
final projection casts.  Quotes are doubled inside quoted fields and backslashes are
ordinary characters.  Every file is split over tasks: a text pass finds the files with a quoted
line break, whose lines :mod:`tabsight.sources.quoted` joins to records for Spark's ``from_csv``.

pandas rules kept: dates stay strings, duplicate headers become ``a, a.1``, an int
column with a missing value is float, integers beyond 64 bits stay text, short rows are
padded with nulls and a row with more fields than the header fails the file.  Headers
that differ in letter case only also get a suffix (``Sales, sales.1``): Spark cannot
tell such names apart.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.catalog import ROW_ID, with_text_row_id
from tabsight.sources.quoted import ends_inside, file_id, quoted_records, split_states

# pandas' default NA tokens (read_csv ``na_values`` default list).
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# Strings pandas reads as booleans.
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")
INT_PATTERN = r"^\s*[+-]?[0-9]+\s*$"
#: integers that may have 64 bits: a failed cast of a longer one costs far more than this
SHORT_INT_PATTERN = r"^\s*[+-]?0*[0-9]{1,19}\s*$"
#: what pandas reads as a float (Java would also take type suffixes such as 12D)
FLOAT_PATTERN = r"(?i)^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?\s*$|^\s*[+-]?inf(inity)?\s*$"
CORRUPT = "_corrupt_record"
#: conditions list at most so many members or files one by one
MAX_LISTED = 256
#: appended to a record to see where its last field lies
_MARK = "\u0001end\u0001"


def _options(sep: str, multiline: bool = False) -> dict:
    return {"sep": sep, "quote": '"', "escape": '"', "nullValue": "\u0000", "multiLine": multiline}


def dedupe_header(names: list[str]) -> list[str]:
    """pandas ``mangle_dupe_cols``: the second ``a`` becomes ``a.1``, the third ``a.2``; letter case is ignored."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        n = "Unnamed: %d" % len(out) if n is None or n == "" else n
        low = n.lower()
        if low in seen:
            k = seen[low]
            cand = f"{n}.{k}"
            while cand.lower() in seen:
                k += 1
                cand = f"{n}.{k}"
            seen[low] = k + 1
            seen[cand.lower()] = 1
            out.append(cand)
        else:
            seen[low] = 1
            out.append(n)
    return out


def read_header(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """The names of the first file's header record (a limit-1 read)."""
    line = spark.read.option("lineSep", "\n").text(path).filter(F.btrim("value", F.lit(" \t\r")) != "").head()
    if line is None:
        return []
    if ends_inside(line[0], False, sep):      # a name with a line break
        first = spark.read.options(**_options(sep, True), header=False).csv(path).limit(1).collect()
        return dedupe_header([v for v in first[0]])
    return parse_header_line(line[0].rstrip("\r").removeprefix("\ufeff"), sep)


def na_to_null(c: Column) -> Column:
    return F.when(~c.isin(*NA_TOKENS), c)


@dataclass
class CsvTable:
    """A typed CSV table plus what the reader learnt about it."""
    source: DataFrame | Callable[[], DataFrame]   # the rows, or what plans them when they are first asked for
    types: dict[str, str]                       # column -> int / float / bool / string
    issues: list[tuple[str, str, str]] = field(default_factory=list)   # (file, severity, message)
    origin: tuple | None = None                 # (archive, member, compressed size) of an archive member
    staging: str | None = None                  # folder that holds the staged member
    shared: tuple | None = None                 # (text rows of many members, this one's id among them)

    @functools.cached_property
    def df(self) -> DataFrame:
        return self.source() if callable(self.source) else self.source

    @property
    def ok(self) -> bool:
        return not any(severity == "error" for _, severity, _ in self.issues)


def _try_double(c: Column) -> Column:
    t = F.trim(c)
    number = F.when(t.rlike(r"(?i)^[+]?inf(inity)?$"), F.lit("Infinity")).when(
        t.rlike(r"(?i)^-inf(inity)?$"), F.lit("-Infinity")).otherwise(t)
    return F.when(c.rlike(FLOAT_PATTERN), number.try_cast("double"))


def _value_class(v: Column) -> Column:
    """1: an integer of 64 bits, 2: a longer one, 3: another float, 4: a boolean token, 5: other text; null if missing."""
    integer = F.when(v.rlike(SHORT_INT_PATTERN) & F.trim(v).try_cast("bigint").isNotNull(), 1).otherwise(2)
    return (F.when(v.rlike(INT_PATTERN), integer).when(_try_double(v).isNotNull(), 3)
             .when(v.isin(*TRUE_TOKENS, *FALSE_TOKENS), 4).when(v.isNotNull(), 5))


def type_stats(df: DataFrame, columns: list[str], by: list[str] | None = None, **more: Column) -> DataFrame:
    """by..., ``__rows`` and per column (by number) the counts of values n, integers i, floats d and booleans b; ``more``: counts of
    further conditions.  Every value is classified once, before the aggregate; an integer beyond 64 bits keeps its column text."""
    classed = df.select(*(by or []), *[_value_class(F.col(f"`{c}`")).alias(f"__v{i}") for i, c in enumerate(columns)],
                        *[c.alias(n) for n, c in more.items()])
    counts = [F.count(F.lit(1)).alias("__rows")]
    for i in range(len(columns)):
        v = F.col(f"__v{i}")
        counts += [F.count(v).alias(f"n{i}"), F.count(F.when(v == 1, 1)).alias(f"i{i}"),
                   F.count(F.when(v.isin(1, 3), 1)).alias(f"d{i}"), F.count(F.when(v == 4, 1)).alias(f"b{i}")]
    return classed.groupBy(*(by or [])).agg(*counts, *[F.count(F.when(F.col(n), 1)).alias(n) for n in more])


def _type_rows(columns: list[str]) -> Column:
    rows = []
    for i, c in enumerate(columns):
        n, ints, dbl, bools, total = (F.col(f"n{i}"), F.col(f"i{i}"), F.col(f"d{i}"), F.col(f"b{i}"),
                                      F.col("__rows"))
        kind = (F.when(n == 0, F.lit("float"))
                 .when((ints == n) & (n == total), F.lit("int"))
                 .when(dbl == n, F.lit("float"))
                 .when((bools == n) & (n == total), F.lit("bool"))
                 .otherwise(F.lit("string")))
        rows.append(F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("ordinal"), kind.alias("inferred")))
    return F.explode(F.array(*rows)).alias("e")


def infer_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """One aggregate -> (column_name, ordinal, inferred) with inferred in int/float/bool/string.

    A column is int when every non-null value is an integer literal and nothing is
    missing (pandas: ints with NaN are float64), float when every value parses as a
    double (an all-missing column is float), bool when every value is a pandas
    boolean token and nothing is missing, else string."""
    return type_stats(df, columns).select(_type_rows(columns)).select("e.*")


def _kinds(header: list[str], row) -> dict[str, str]:
    """Column kinds from one row of the type aggregates."""
    out = {}
    for i, h in enumerate(header):
        n, ints, dbl, bools, total = row[f"n{i}"], row[f"i{i}"], row[f"d{i}"], row[f"b{i}"], row["__rows"]
        out[h] = ("float" if n == 0 else "int" if ints == n == total else "float" if dbl == n
                  else "bool" if bools == n == total else "string")
    return out


def cast_to(c: Column, kind: str) -> Column:
    if kind == "int":
        return F.trim(c).try_cast("long")
    if kind == "float":
        return _try_double(c)
    if kind == "bool":
        return F.when(c.isin(*TRUE_TOKENS), F.lit(True)).when(c.isin(*FALSE_TOKENS), F.lit(False))
    return c


def _too_long(n_columns: int, sep: str) -> Column:
    """A record that the reader flagged has more fields than the header: a mark appended behind its last field does
    not show among the first ``n_columns`` fields (counted by the CSV parser, so quotes are respected)."""
    schema = ", ".join(f"c{i} string" for i in range(n_columns))
    parsed = F.from_csv(F.concat(F.col(CORRUPT), F.lit(sep + _MARK)), schema,
                        {"sep": sep, "quote": '"', "escape": '"', "nullValue": "\u0000"})
    marks = F.array(*[F.coalesce(parsed.getField(f"c{i}"), F.lit("")) for i in range(n_columns)])
    return F.col(CORRUPT).isNotNull() & ~F.array_contains(marks, _MARK)


def _schema(n_columns: int) -> T.StructType:
    return T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(n_columns)] + [T.StructField(CORRUPT, T.StringType())])


def _parse_options(sep: str, multiline: bool) -> dict:
    return {**_options(sep, multiline), "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}


def _plain(spark: SparkSession, path: str, sep: str, n_columns: int) -> DataFrame:
    """String columns c0.., the corrupt record and the row number of files without a quoted line break."""
    raw = spark.read.options(**_parse_options(sep, False), header=True, enforceSchema=True).schema(_schema(n_columns)).csv(path)
    return with_text_row_id(raw)


def _glued(spark: SparkSession, path: str, sep: str, n_columns: int, states: DataFrame, chosen: Column,
           tag: str | None = None) -> DataFrame:
    """The same of files with quoted line breaks, and ``tag``."""
    rows = quoted_records(spark, path, states, chosen, sep, tag).filter(~F.col("first"))
    options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in _parse_options(sep, True).items()}
    parsed = rows.select(F.from_csv("value", _schema(n_columns).simpleString()[len("struct<"):-1].replace(":", " "), options).alias("r"),
                         F.col("rid").alias(ROW_ID), "tag")
    return parsed.select("r.*", ROW_ID, *([F.col("tag").alias(tag)] if tag else []))


def _read_strings(spark: SparkSession, path: str, sep: str, n_columns: int, states: DataFrame | None) -> DataFrame:
    """String columns c0.., the corrupt record and row numbers of all files; ``states``: see :func:`split_states`."""
    ids = [r[0] for r in states.filter("opens").select("fid").distinct().collect()] if states is not None else []
    if not ids:     # numbers of files: part of Spark's own file listing
        return _plain(spark, path, sep, n_columns)
    whole = _glued(spark, path, sep, n_columns, states, F.col("fid").isin(*ids))
    raw = spark.read.options(**_parse_options(sep, False), header=True, enforceSchema=True).schema(_schema(n_columns)).csv(path)
    rest = with_text_row_id(raw, ~file_id().isin(*ids))
    return rest.unionByName(whole)


def read_csv_table(spark: SparkSession, path: str, sep: str = ",", with_row_id: bool = True,
                   name: str | None = None, multiline: bool = True) -> CsvTable:
    """Read one CSV file (or a directory of files sharing one header) like pandas.

    ``multiline=False`` promises that no quoted field holds a line break and saves the pass that looks for them."""
    issues: list[tuple[str, str, str]] = []
    name = name or path
    header = read_header(spark, path, sep)
    if not header:
        issues.append((name, "error", "No columns to parse from file"))
        empty = spark.createDataFrame([], T.StructType([]))
        return CsvTable(empty, {}, issues)
    raw = _read_strings(spark, path, sep, len(header), split_states(spark, path, sep) if multiline else None)
    cleaned = raw.select(*[na_to_null(F.col(f"c{i}")).alias(h) for i, h in enumerate(header)], CORRUPT,
                         *([ROW_ID] if with_row_id else []))
    # one job: type statistics of every column + S17 long rows (more fields than the
    # header fail the file, as pandas raises ParserError)
    row = type_stats(cleaned, header, __long=_too_long(len(header), sep)).first()
    if row["__long"] > 0:
        issues.append((name, "error", f"Error tokenizing data: {row['__long']} row(s) have more fields than "
                                      f"the header ({len(header)})"))
    kinds = _kinds(header, row)
    typed = cleaned.select(*[cast_to(F.col(f"`{h}`"), kinds[h]).alias(h) for h in header],
                           *([ROW_ID] if with_row_id else []))
    return CsvTable(typed, kinds, issues)


def parse_header_line(line: str | None, sep: str = ",") -> list[str]:
    import csv as _csv
    if line is None or line.strip() == "":
        return []
    return dedupe_header(next(_csv.reader([line], delimiter=sep)))


def read_csv_members(spark: SparkSession, root: str, part_col: str, members: dict[str, str],
                     headers: dict[str, str], sep: str = ",") -> dict[str, CsvTable]:
    """Many CSV files staged as ``root/<part_col>=<id>/`` read with few jobs.

    ``members`` maps id -> table name, ``headers`` id -> header line (known since the archive scan).  Members with the
    same header share one CSV read (partition pruning on ``part_col``) and one statistics job grouped by member; each
    member's table is a filtered projection of that read, planned when it is asked for; :func:`union_tables` reads many at once."""
    states = split_states(spark, root, sep, tag=part_col)
    whole = {r[0] for r in states.filter("opens").select("tag").distinct().collect()}     # members with quoted line breaks
    out: dict[str, CsvTable] = {}
    groups: dict[tuple, list[str]] = {}
    for mid, name in members.items():
        hdr = parse_header_line(headers.get(mid), sep)
        if not hdr:
            out[name] = CsvTable(spark.createDataFrame([], T.StructType([])), {},
                                 [(name, "error", "No columns to parse from file")])
            continue
        groups.setdefault((mid in whole, tuple(hdr)), []).append(mid)
    for (multi, hdr), ids in groups.items():
        header = list(hdr)
        # members are few beside their rows: with many of them the ids are joined in place of a long condition
        short = len(ids) <= MAX_LISTED
        if multi:
            raw = _glued(spark, root, sep, len(header), states, F.col("tag").isin(*ids) if short else F.lit(True), part_col)
        else:
            raw = _plain(spark, root, sep, len(header))
            raw = raw.filter(F.col(part_col).isin(*ids)) if short else raw
        if not short:
            raw = raw.join(F.broadcast(spark.createDataFrame([(m,) for m in ids], f"{part_col} string")), part_col, "left_semi")
        cleaned = raw.select(F.col(part_col).alias("__member"),
                             *[na_to_null(F.col(f"c{i}")).alias(h) for i, h in enumerate(header)], CORRUPT, ROW_ID)
        stats = {r["__member"]: r for r in type_stats(cleaned, header, ["__member"], __long=_too_long(len(header), sep)).collect()}
        for mid in ids:
            name, row, issues = members[mid], stats.get(mid), []
            if row is None:      # header only: an empty table, every column float (all missing)
                kinds = {h: "float" for h in header}
            else:
                if row["__long"] > 0:
                    issues.append((name, "error", f"Error tokenizing data: {row['__long']} row(s) have more "
                                                  f"fields than the header ({len(header)})"))
                kinds = _kinds(header, row)
            out[name] = CsvTable(functools.partial(_member_frame, cleaned, mid, kinds), kinds, issues, shared=(cleaned, mid))
    return out


def _member_frame(cleaned: DataFrame, mid: str, kinds: dict[str, str]) -> DataFrame:
    return cleaned.filter(F.col("__member") == mid).select(*[cast_to(F.col(f"`{h}`"), k).alias(h) for h, k in kinds.items()], ROW_ID)


def union_tables(tables: Iterable[CsvTable]) -> DataFrame | None:
    """All rows of many tables of equal columns, as ``unionByName`` of their frames gives them (None without tables).

    Members of one read stay one scan, whatever their number: their rows are cast by their own member's kinds, which travel as one
    short row a member.  A column that is int in some members and float in others is float; other mixtures are text."""
    alone, groups = [], {}
    for t in tables:
        if t.shared is None:
            alone.append(t.df)
        else:
            groups.setdefault(id(t.shared[0]), []).append(t)
    frames = alone
    for ts in groups.values():
        cleaned, header = ts[0].shared[0], list(ts[0].types)
        kinds = cleaned.sparkSession.createDataFrame(
            [(t.shared[1], *(t.types[h] for h in header)) for t in ts], "__id string, " + ", ".join(f"__k{i} string" for i in range(len(header))))
        rows = cleaned.join(F.broadcast(kinds), F.col("__member") == F.col("__id"))
        cells = []
        for i, h in enumerate(header):
            c, found = F.col(f"`{h}`"), sorted({t.types[h] for t in ts})
            as_type = None if len(found) == 1 else "double" if found == ["float", "int"] else "string"
            value = cast_to(c, found[0])
            if as_type:
                value = F.coalesce(*[F.when(F.col(f"__k{i}") == k, cast_to(c, k).cast(as_type)) for k in found])
            cells.append(value.alias(h))
        frames.append(rows.select(*cells, ROW_ID))
    return functools.reduce(DataFrame.unionByName, frames) if frames else None
