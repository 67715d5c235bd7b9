"""Date parsing as pandas does it: one layout, taken from the column's first value.

The first non-null value decides.  If pandas can name its layout (a strptime format), :func:`compile_layout` turns the
format's directives into one regular expression with a named group per field, and a value of another layout is missing.
If not (two-digit years, most AM/PM times, month and year alone, ...), every value is tried on its own against the free grammar of
:data:`FREE`: optional weekday, numeric or named months in any usual order, optional time with seconds, fraction, AM/PM and
zone.  Numbers are month first unless only the day fits; two-digit years lie within 50 years of today; a time
alone is a time of today, as pandas has it.

Everything runs as built-in string functions: a match, one replacement that writes the fields in a fixed order, a cast.
Results are TIMESTAMP_NTZ (microseconds; finer fractions are cut).  With a zone in the layout they are wall-clock times in
the first value's zone, which :func:`date_zone` names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.catalog import ROW_ID

# English month and weekday names.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")

_SHORT = "|".join(m[:3] for m in MONTHS)
#: strptime directive -> regular expression; named groups are the fields
DIRECTIVES = {
    "Y": r"(?<Y>\d{4})", "y": r"(?<y>\d{2})", "m": r"(?<m>1[0-2]|0?[1-9])", "d": r"(?<d>3[01]|[12]\d|0?[1-9])",
    "H": r"(?<H>2[0-3]|[01]?\d)", "I": r"(?<H>1[0-2]|0?[1-9])", "M": r"(?<M>[0-5]?\d)", "S": r"(?<S>[0-5]?\d)",
    "f": r"(?<f>\d{1,6})\d{0,3}", "p": r"(?<p>am|pm)", "b": rf"(?<b>{_SHORT})", "B": rf"(?<b>{'|'.join(MONTHS)})",
    "a": rf"(?:{'|'.join(w[:3] for w in WEEKDAYS)})", "A": rf"(?:{'|'.join(WEEKDAYS)})", "z": r"(?<z>Z|[+-]\d{2}:?\d{2})"}
_FIELDS = ("Y", "y", "m", "b", "d", "H", "M", "S", "f", "p", "z")


def _clean(text: str) -> str:
    return "(?i)^" + text + "$"


def compile_layout(fmt: str) -> str | None:
    """Regular expression of a strptime format, or None if it has a directive that is not known."""
    out, k = [], 0
    while k < len(fmt):
        if fmt[k] == "%" and k + 1 < len(fmt):
            if fmt[k + 1] not in DIRECTIVES:
                return None
            out.append(DIRECTIVES[fmt[k + 1]])
            k += 2
        elif fmt[k].isspace():
            out.append(r"\s+")
            k += 1
        else:
            out.append(re.escape(fmt[k]))
            k += 1
    return _clean("".join(out))


def _free_grammar() -> tuple[str, ...]:
    """Regular expressions of the layouts that are read value by value, most specific first."""
    name = "(?<b>" + "|".join(m[:3] + (f"(?:{m[3:]})?" if m[3:] else "") for m in MONTHS).replace("sep(?:tember)?", "sept?(?:ember)?") + r")\.?"
    week = "(?:(?:" + "|".join(w[:3] + f"(?:{w[3:]})?" for w in WEEKDAYS) + r")\.?,?\s+)?"
    year, short, month, day = r"(?<Y>\d{4})", r"(?<y>\d{2})", r"(?<m>1[0-2]|0?[1-9])", r"(?<d>3[01]|[12]\d|0?[1-9])"
    nth = day + "(?:st|nd|rd|th)?"
    clock = r"(?<H>2[0-3]|[01]?\d):(?<M>[0-5]\d)(?::(?<S>[0-5]\d)(?:[.,](?<f>\d{1,6})\d*)?)?(?:\s*(?<p>am|pm))?"
    hour = r"(?<H>1[0-2]|0?[1-9])\s*(?<p>am|pm)"
    zone = r"(?:\s*(?:Z|UTC|GMT|[+-]\d{2}:?\d{2}))?"
    time = rf"(?:(?:\s+|T|,\s*)(?:{clock}){zone})?"
    gap = r"[-\s/.,]+"
    dates = []
    for y in (year, short):
        dates += [month + r"([-/. ])" + day + r"\1" + y, day + r"([-/. ])" + month + r"\1" + y,
                  nth + gap + name + gap + y, name + gap + nth + gap + y]
    dates += [year + r"([-/.])" + month + r"\1" + day, year + gap + name + gap + day, year + r"(?<m>0[1-9]|1[0-2])(?<d>0[1-9]|[12]\d|3[01])"]
    # the unnamed group of a date counts its number from the named ones before it: make it a named one
    dates = [d.replace("([-/. ])", "(?<s>[-/. ])").replace("([-/.])", "(?<s>[-/.])").replace(r"\1", r"\k<s>") for d in dates]
    alone = [name + gap + year, year + gap + name, month + "[-/]" + year, year + "[-/]" + month, year]
    ctime = week + name + r"\s+" + day + r"\s+" + clock + r"\s+" + year
    return tuple(_clean(x) for x in [*(week + d + time for d in dates), *(week + d + r"(?:\s+" + hour + ")" for d in dates), ctime, *alone,
                                     clock, hour])


FREE = _free_grammar()


def _groups(pattern: str) -> set[str]:
    return set(re.findall(r"\(\?<([A-Za-z])>", pattern))


def _offset_minutes(zone: Column) -> Column:
    digits = F.regexp_replace(zone, "[^0-9]", "")
    size = F.substring(digits, 1, 2).cast("int") * 60 + F.substring(digits, 3, 2).cast("int")
    return F.when(F.upper(zone) == "Z", 0).when(F.startswith(zone, F.lit("-")), -size).otherwise(size)


def _lower(c: Column) -> Column:
    """Latin letters in lower case; inside a bound expression ``F.lower`` builds a word iterator for every value."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _assembled(fields: Column, have: set[str], home: int | None) -> Column:
    """A time from an array of ``_FIELDS`` as text (empty: not in the layout); ``have``: the fields that may be filled."""
    # every part stands as few times as may be: a bound expression is evaluated as often as it is written
    part = {n: F.nullif(fields[k], F.lit("")) for k, n in enumerate(_FIELDS)}
    today, year, month, day = F.current_date(), part["Y"], part["m"], part["d"]
    if "y" in have:
        least = F.year(today) - 50
        year = F.coalesce(year, (least + F.pmod(part["y"].cast("int") - least, F.lit(100))).cast("string"))
    if "b" in have:
        table = F.create_map(*(F.lit(x) for k, m in enumerate(MONTHS) for x in (m[:3], str(k + 1))))
        month = F.coalesce(month, F.element_at(table, _lower(F.substring(part["b"], 1, 3))))
    # a date needs a year; a time alone is one of today
    alone = F.coalesce(part["m"], part["b"], day).isNull()
    date = F.coalesce(F.concat(year, F.lit("-"), F.coalesce(month, F.lit("1")), F.lit("-"), F.coalesce(day, F.lit("1"))),
                      F.when(alone, today.cast("string")))
    clock = F.concat(*(x for n, mark in (("H", " "), ("M", ":"), ("S", ":"), ("f", ".")) for x in (F.lit(mark), F.coalesce(part[n], F.lit("0")))))
    out = F.concat(date, clock).try_cast("timestamp_ntz")
    if "p" in have:
        p, hour = _lower(part["p"]), part["H"].cast("int")
        shift = F.when((p == "pm") & (hour < 12), 12).when((p == "am") & (hour == 12), -12).otherwise(0)
        # an hour that no half of the day has gives null
        shift = F.when(part["p"].isNull(), 0).when(hour.between(1, 12), shift)
        out = out + F.make_dt_interval(F.lit(0), shift)
    if home is not None and "z" in have:
        out = out + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(home) - _offset_minutes(part["z"]))
    return F.when(fields.isNotNull(), out)


def _written(c: Column, pattern: str) -> Column:
    """The fields of ``c``, in a fixed order, or null if it is not in the layout."""
    here = _groups(pattern)
    return F.when(c.rlike(pattern), F.regexp_replace(c, pattern, "|".join(f"${{{n}}}" if n in here else "" for n in _FIELDS)))


def _bound(fields: Column, have: set[str], home: int | None) -> Column:
    """:func:`_assembled` with the fields bound once: they stand in the assembly many times."""
    return F.transform(F.array(fields), lambda x: _assembled(x, have, home))[0]


def _read(c: Column, pattern: str, home: int | None = None) -> Column:
    """``c`` in one layout, else null; with ``home`` as wall-clock time at that offset (minutes)."""
    return _bound(F.split(_written(c, pattern), r"\|", -1), _groups(pattern), home)


def _read_free(c: Column) -> Column:
    """``c`` in the first layout of the free grammar that matches, else null."""
    return _bound(F.split(F.coalesce(*(_written(c, p) for p in FREE)), r"\|", -1), set().union(*map(_groups, FREE)), None)


def _layout_of(first: str) -> str | None:
    """strptime format of a value, as pandas names it."""
    from pandas.tseries.api import guess_datetime_format
    try:
        return guess_datetime_format(first)
    except (ValueError, OverflowError):
        return None


def first_values(df: DataFrame) -> dict[str, str | None]:
    """The first non-null value of every date-named text column in file order (without row numbers: in scan order), by one
    job, kept with the frame."""
    from tabsight.functions.names import is_date_named
    known = df.__dict__.setdefault("_first_dates", {})
    if not known:
        names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and is_date_named(f.name)]
        if names and ROW_ID in df.columns:
            row = df.agg(*[F.min_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col(ROW_ID))).alias(f"v{i}")
                           for i, c in enumerate(names)]).first()
            known.update({c: row[i] for i, c in enumerate(names)})
        for c in names:
            if c not in known:
                known[c] = _first_value(df, c)
    return known


def _first_value(df: DataFrame, col: str) -> str | None:
    c = F.col(f"`{col}`")
    row = (df.filter(c.isNotNull()).agg(F.min_by(c, F.col(ROW_ID))) if ROW_ID in df.columns
           else df.filter(c.isNotNull()).select(c)).head()
    return row[0] if row else None


def _value_of(df: DataFrame, col: str) -> str | None:
    known = first_values(df)
    if col not in known:
        known[col] = _first_value(df, col)
    return known[col]


def _zone_minutes(first: str | None) -> int | None:
    """Offset of a first value whose layout has a zone."""
    fmt = _layout_of(first.strip()) if first else None
    found = re.search(r"(Z|([+-])(\d{2}):?(\d{2}))\s*$", first.strip(), re.I) if fmt and "%z" in fmt else None
    if found is None:
        return None
    return 0 if found.group(2) is None else (-1 if found.group(2) == "-" else 1) * (60 * int(found.group(3)) + int(found.group(4)))


def parse_like(c: Column, first: str | None) -> Column:
    """``c`` as TIMESTAMP_NTZ in the layout of the value ``first``; null where it does not fit."""
    if first is None:
        return F.lit(None).cast("timestamp_ntz")
    text = F.trim(c)
    fmt = _layout_of(first.strip())
    pattern = compile_layout(fmt) if fmt else None
    if pattern is not None:
        return _read(text, pattern, _zone_minutes(first))
    return _read_free(text)


def parsed_date(df: DataFrame, col: str) -> Column:
    """Lenient parse of a date column of ``df`` (no-op for datetime columns)."""
    dt = df.schema[col].dataType
    c = F.col(f"`{col}`")
    if isinstance(dt, T.StringType):
        return parse_like(c, _value_of(df, col))
    return c.cast("timestamp_ntz")


def date_zone(df: DataFrame, col: str) -> str:
    """Offset that the column's parsed dates are in (``+02:00``), or nothing for columns without zones."""
    if not isinstance(df.schema[col].dataType, T.StringType):
        return ""
    at = _zone_minutes(_value_of(df, col))
    return "" if at is None else f"{'-' if at < 0 else '+'}{abs(at) // 60:02d}:{abs(at) % 60:02d}"
