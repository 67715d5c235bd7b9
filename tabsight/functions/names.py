"""File-name rules as Column expressions (S15, S16) and display formats."""

from __future__ import annotations

import re

import pandas as pd

from pyspark.sql import Column
from pyspark.sql import functions as F


def logical_table_name(name: Column) -> Column:
    """Drop the last extension, runs of non-alphanumerics -> '_', lower case."""
    base = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.lower(F.regexp_replace(base, r"[^a-zA-Z0-9]+", "_"))


def file_kind(name: Column) -> Column:
    """S15: 'csv' / 'zip' / 'unknown' from the extension, case-insensitive."""
    ext = F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1)))
    return (F.when(ext == "csv", F.lit("csv"))
             .when(ext == "zip", F.lit("zip"))
             .otherwise(F.lit("unknown")))


def base_name(path: Column) -> Column:
    """Last path segment."""
    return F.substring_index(path, "/", -1)


def fill(template: str, **values: Column) -> Column:
    """Message text from a template with ``{name}`` placeholders filled by columns
    (plain concatenation: the fixed texts may contain ``%``)."""
    parts = re.split(r"(\{[a-z_]+\})", template)
    cols = []
    for p in parts:
        if not p:
            continue
        m = re.fullmatch(r"\{([a-z_]+)\}", p)
        cols.append(values[m.group(1)].cast("string") if m else F.lit(p))
    return F.concat(*cols)


def _fixed2(x: pd.Series) -> pd.Series:
    """Python's ``f'{x:.2f}'`` (rounds the exact binary value, as pandas users see it)."""
    return x.map(lambda v: None if v is None or v != v else f"{v:.2f}")


def _money2(x: pd.Series) -> pd.Series:
    """``f'${x:,.2f}'`` above 1000, else ``f'{x:.2f}'``."""
    return x.map(lambda v: None if v is None or v != v else (f"${v:,.2f}" if v > 1000 else f"{v:.2f}"))


_UDFS: dict = {}


def _vectorized(fn):
    """Wrap lazily: a pandas UDF needs an active session when it is created."""
    if fn.__name__ not in _UDFS:
        _UDFS[fn.__name__] = F.pandas_udf(fn, "string")
    return _UDFS[fn.__name__]


def fixed2_text(x: Column) -> Column:
    """%.2f text with Python rounding; used on aggregated rows only (a handful per table)."""
    return _vectorized(_fixed2)(x.cast("double"))


def money_text(x: Column) -> Column:
    """Values above 1000 as ``$1,234.00``, others as ``123.40`` (Python rounding).

    Java's formatter rounds the shortest decimal text half-up (251485.485 -> .49)
    where Python rounds the binary value (-> .48); the texts are built on
    aggregated rows, so a vectorized pandas UDF gives exact parity at no cost."""
    return _vectorized(_money2)(x.cast("double"))


# Parts of the names of date columns.
DATE_NAME_KEYWORDS = ("date", "time", "created", "updated")


def is_date_named(name: str) -> bool:
    return any(k in name.lower() for k in DATE_NAME_KEYWORDS)
