"""Plan filters (F1-F10, A4) as Spark predicates with pandas comparison semantics.

Decisions are taken at plan-build time from the schema, never at run time: Spark's
ANSI mode would throw inside a task on a string/number comparison, pandas gives
"no rows" for ``==`` and an error for ``<``/``>``.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.functions.aggregates import PlanError, is_numeric

# Filter operators of the plan format (A4 adds between/isin/not_in).
OPERATORS = ("==", "!=", ">", "<", ">=", "<=", "in", "between", "isin", "not_in")


@dataclass
class FilterOutcome:
    predicate: Column | None      # None: the filter is skipped
    issue: str | None = None      # message for the issues table (severity info)


def _value_kind(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, (int, float)):
        return "number"
    if isinstance(v, (_dt.date, _dt.datetime)):
        return "datetime"
    if isinstance(v, str):
        return "string"
    if isinstance(v, (list, tuple)):
        return "list"
    return "other"


def _column_kind(dt: T.DataType) -> str:
    if isinstance(dt, T.BooleanType):
        return "bool"
    if is_numeric(dt):
        return "number"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(dt, T.StringType):
        return "string"
    return "other"


def _literal(v, col_kind: str, dt: T.DataType) -> Column | None:
    """Literal comparable with a column of kind ``col_kind``; None when pandas would not compare."""
    vk = _value_kind(v)
    if col_kind == "number" and vk in ("number", "bool"):
        return F.lit(int(v) if vk == "bool" else v)
    if col_kind == "bool" and vk in ("bool", "number"):
        return F.lit(bool(v)) if vk == "bool" else F.lit(v).cast("boolean")
    if col_kind == "string" and vk == "string":
        return F.lit(v)
    if col_kind == "datetime" and vk in ("string", "datetime"):
        target = "timestamp_ntz" if isinstance(dt, T.TimestampNTZType) else dt.simpleString()
        parsed = F.lit(v if vk == "datetime" else str(v))
        return parsed.cast(target) if vk == "datetime" else F.try_to_timestamp(parsed).cast(target)
    return None


def build_filter(schema: T.StructType, spec: dict) -> FilterOutcome:
    column = spec.get("column")
    op = spec.get("operator", "==") or "=="
    value = spec.get("value")
    names = {f.name: f.dataType for f in schema.fields}
    if column not in names:
        return FilterOutcome(None, f"filter skipped: unknown column '{column}'")
    if op not in OPERATORS:
        return FilterOutcome(None, f"filter skipped: unknown operator '{op}'")
    dt = names[column]
    ck = _column_kind(dt)
    c = F.col(f"`{column}`")
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        c = F.when(~F.isnan(c), c)  # NaN behaves like a missing value

    if op in ("in", "isin", "not_in"):
        if not isinstance(value, (list, tuple)):
            raise PlanError(f"operator '{op}' needs a list value, got {type(value).__name__}")
        lits = [x for x in (_literal(v, ck, dt) for v in value if v is not None) if x is not None]
        pred = c.isin(*lits) if lits else F.lit(False)
        if any(v is None for v in value):
            pred = pred | c.isNull()
        if op == "not_in":
            pred = ~F.coalesce(pred, F.lit(False))
        return FilterOutcome(F.coalesce(pred, F.lit(False)) if op != "not_in" else pred)

    if op == "between":
        if not isinstance(value, (list, tuple)) or len(value) != 2:
            raise PlanError("operator 'between' needs a [low, high] value")
        lo, hi = (_literal(v, ck, dt) for v in value)
        if lo is None or hi is None:
            raise PlanError(f"cannot compare column '{column}' ({dt.simpleString()}) with {value!r}")
        return FilterOutcome(c.between(lo, hi))

    if value is None:
        if op == "==":
            return FilterOutcome(F.lit(False))
        if op == "!=":
            return FilterOutcome(None, None)
        raise PlanError(f"cannot order-compare column '{column}' with null")

    lit = _literal(value, ck, dt)
    if lit is None:
        if op == "==":
            return FilterOutcome(F.lit(False), f"filter '{column} == {value!r}' compares different types: no rows")
        if op == "!=":
            return FilterOutcome(None, f"filter '{column} != {value!r}' compares different types: all rows")
        raise PlanError(f"cannot compare column '{column}' ({dt.simpleString()}) with {value!r}")
    if op == "==":
        return FilterOutcome(c == lit)
    if op == "!=":
        return FilterOutcome(~c.eqNullSafe(lit))
    if op == ">":
        return FilterOutcome(c > lit)
    if op == "<":
        return FilterOutcome(c < lit)
    if op == ">=":
        return FilterOutcome(c >= lit)
    return FilterOutcome(c <= lit)
